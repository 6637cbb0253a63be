"""Redaction of a text stream with the vault as keyed state: each scope's values live in the state store, and go with it.

Every scope keeps a map from value to token and a counter per category. A batch touches the state of its own scopes
only: nothing reads a vault table. What a batch adds to the vault is an output like the redacted texts, written to a
secret folder of its own and never read back by the stream. State survives restarts through the checkpoint; a scope's
state goes when a text marked as its last has been redacted, or after ``ttl_ms`` without use of a value.

The store needs ``spark.sql.streaming.stateStore.providerClass`` set to Spark's RocksDB provider.

Within a batch a scope's texts are redacted in ``order``, Arrow batch by Arrow batch: a scope is one task of its batch,
so bound the files per trigger where one scope fills the stream, or use :func:`maskwright.streaming.redact.stream_redact`,
which numbers a scope in pieces.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from maskwright.functions import patterns as P
from maskwright.functions.detectors import detect
from maskwright.functions.sql import once
from maskwright.session import cut_lineage

_DROPPED = re.compile("[" + P.SPACE + r"\-().,]+")
_COLUMNS = ["kind", "text_id", "scope_id", "redacted", "category", "value_key", "token", "first_value"]


def value_key(value: str) -> str:
    """The spelling-free key of a value, as ``operators.vault.value_key`` makes it."""
    return _DROPPED.sub("", unicodedata.normalize("NFKC", value).lower())


class ScopeVault(StatefulProcessor):
    """Texts of one scope in, redacted texts and new vault rows out."""

    def __init__(self, order: list[str], ttl_ms: int | None = None):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getMapState("tokens", "category string, value_key string", "token string", self.ttl_ms)
        self.numbers = handle.getMapState("numbers", "category string", "number bigint", self.ttl_ms)

    def _token(self, category: str, value: str) -> tuple[str, str, bool]:
        """(key, token, whether it is new)."""
        key = value_key(value)
        if self.tokens.containsKey((category, key)):
            token, new = self.tokens.getValue((category, key))[0], False
        else:
            number = self.numbers.getValue((category,))[0] + 1 if self.numbers.containsKey((category,)) else 1
            self.numbers.updateValue((category,), (number,))
            token, new = f"<PII:{category}:{number}>", True
        if new or self.ttl_ms:  # a use keeps a value alive
            self.tokens.updateValue((category, key), (token,))
        return key, token, new

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        over = False
        for batch in rows:
            out = []
            for row in batch.sort_values(self.order).itertuples(index=False):
                pieces, at = [], 0
                for start, end, category, value in zip(row.starts, row.ends, row.categories, row.values, strict=True):
                    name, token, new = self._token(category, value)
                    if new:
                        out.append(("value", None, key[0], None, category, name, token, value))
                    pieces += [row.text[at:start], token]
                    at = end
                redacted = None if row.text is None else "".join([*pieces, row.text[at:]])
                out.append(("text", row.text_id, key[0], redacted, None, None, None, None))
                over = over or bool(row.finished)
            frame = pd.DataFrame(out, columns=_COLUMNS)
            frame["text_id"] = frame["text_id"].astype(batch["text_id"].dtype.name.replace("int64", "Int64"))
            yield frame
        if over:
            self.tokens.clear()
            self.numbers.clear()

    def close(self) -> None:
        pass


def redacted_scopes(texts: DataFrame, order: list[str], finished: str = "false", ttl_ms: int | None = None) -> DataFrame:
    """The stream of redacted texts (kind ``text``) and of what they add to the vault (kind ``value``).

    ``texts``: text_id, scope_id, the order columns, text. ``finished``: SQL that is true for the last text of its scope.
    """
    found = texts.selectExpr("text_id", "scope_id", *order, "text", f"coalesce({finished}, false) AS finished", f"{once(detect('text'))} AS spans")
    narrow = found.selectExpr(
        "text_id", "scope_id", *order, "text", "finished", "coalesce(spans.start, cast(array() AS array<int>)) AS starts", "coalesce(spans.end, cast(array() AS array<int>)) AS ends",
        "coalesce(spans.category, cast(array() AS array<string>)) AS categories", "coalesce(spans.text, cast(array() AS array<string>)) AS values",
    )
    kind = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    schema = f"kind string, text_id {kind['text_id']}, scope_id {kind['scope_id']}, redacted string, category string, value_key string, token string, first_value string"
    return narrow.groupBy("scope_id").transformWithStateInPandas(
        statefulProcessor=ScopeVault(order, ttl_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )


def stream_redact_scopes(
    texts: DataFrame, vault_path: str, out_path: str, checkpoint: str, order: list[str], finished: str = "false", ttl_ms: int | None = None, once: bool = True
) -> StreamingQuery:
    """Start the stream: redacted rows to ``out_path``, new vault rows to ``vault_path``, one folder per batch in each.

    A batch that runs again after a lost executor starts from the same state and overwrites its own folders.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = cut_lineage(batch)  # read twice, made once
        rows.where("kind = 'text'").select("text_id", "scope_id", "redacted").write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        rows.where("kind = 'value'").select("scope_id", "category", "value_key", "token", "first_value").write.mode("overwrite").parquet(f"{vault_path}/batch={number}")

    writer = redacted_scopes(texts, order, finished, ttl_ms).writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
