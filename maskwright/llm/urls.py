"""URL filters (9): written rules first, gradient-boosted trees for the rest.

A rule names a host and the beginning of a path; it fits its host and every
subdomain, and the longest rule that fits decides. URLs that rules decide are
the labelled ones: trees are fitted on lexical features of at most
``MAX_ROWS`` of them (those whose ids hash lowest; the bound of the fit, nothing
else is limited) and judge every URL that no rule fits.

Features: lengths of url, host, path and query, depth, labels of the host,
digit ratio, entropy of the characters, parameters, hyphens, a scheme flag,
and for the host's last label and last two labels how common they are in the
whole table. Counts are summed per suffix before they are joined.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is judged by the trees on its (mostly zero) features; where
all labelled URLs have one label, that label is the verdict; without any, the
verdict is ``allow``; repeated rows are judged alike; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import ascii_lower, cut_lineage, slim, table
from maskwright.llm.registry import query

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A list of rules is one expression; longer lists do not belong in one.
MOST_RULES = 1000
MAX_ROWS, TREES, DEPTH, SEED = 20_000, 20, 4, 42
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "digits", "entropy", "parameters",
    "hyphens", "secure", "last_share", "pair_share",
)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    rows = slim(pages, page_id="page_id", url="url")
    has = F.coalesce(F.col("url").contains("://"), F.lit(False))
    rest = F.substring_index("url", "://", 1)
    after = F.when(has, F.expr("substr(url, length(substring_index(url, '://', 1)) + 4)")).otherwise("")
    rows = rows.withColumn("after", after).withColumn("scheme", F.when(has, rest).otherwise(""))
    host = F.regexp_extract("after", r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract("after", r"(?s)^[^/?#]*([^?#]*)", 1)
    return rows.select("page_id", "url", "scheme", "after", ascii_lower(host).alias("host"), path.alias("path"))


def with_rules(rows: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``rule`` (host and path as text) and ``ruled`` (its verdict), null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")

    def fits(host: str, path: str) -> Column:
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)

    rule = ruled = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest comes last, and so outermost
        rule, ruled = F.when(fits(host, path), host + path).otherwise(rule), F.when(fits(host, path), verdict).otherwise(ruled)
    return rows.withColumn("rule", rule).withColumn("ruled", ruled)


def with_features(rows: DataFrame) -> DataFrame:
    """The lexical features of every row."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.char_length(url), F.lit(1))
    count = lambda text, what: (F.char_length(text) - F.char_length(F.replace(text, F.lit(what), F.lit("")))).cast("double")
    asked = F.regexp_extract("after", r"(?s)\?([^#]*)", 1)
    entropy = F.expr("""coalesce(get(transform(array(coalesce(url, '')), u -> -aggregate(array_distinct(split(u, '')), 0D,
        (s, c) -> s + IF(c = '', 0D, get(transform(array((length(u) - length(replace(u, c, ''))) / length(u)), p -> p * log2(p)), 0)))), 0), 0D)""")
    last, pair = F.substring_index("host", ".", -1), F.substring_index("host", ".", -2)
    rows = rows.withColumn("last", last).withColumn("pair", pair)
    total = F.count(F.lit(1))
    all_rows = rows.agg(total.alias("n")).first().n or 1  # one number
    out = rows
    for name in ("last", "pair"):
        share = cut_lineage(rows.groupBy(name).agg((total / all_rows).alias(f"{name}_share")))
        out = out.join(share, name, "left")
    return out.select(
        *rows.columns, "last_share", "pair_share",
        F.char_length(url).cast("double").alias("url_length"), F.char_length("host").cast("double").alias("host_length"),
        F.char_length("path").cast("double").alias("path_length"), F.char_length(asked).cast("double").alias("query_length"),
        count(F.col("path"), "/").alias("depth"), (count(F.col("host"), ".") + F.when(F.col("host") == "", 0).otherwise(1)).alias("labels"),
        (F.regexp_count(url, F.lit("[0-9]")) / size).alias("digits"), entropy.alias("entropy"),
        (count(asked, "&") + F.when(F.char_length(asked) > 0, 1).otherwise(0)).alias("parameters"),
        count(url, "-").alias("hyphens"), (F.lower("scheme") == "https").cast("double").alias("secure"),
    )


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and ``score`` (the trees' probability of ``block``; null where a rule decides)."""
    rows = cut_lineage(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        with_features(with_rules(parsed(pages), rules))
    ).select("page_id", "url", "host", "path", "rule", "ruled", "features"))
    labelled = (
        rows.where("rule IS NOT NULL").orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(max_rows)
        .select("features", (F.col("ruled") == "block").cast("double").alias("label"))
    )
    labelled = cut_lineage(labelled)
    blocked = [r.label for r in labelled.select("label").distinct().collect()]  # two at most
    rest = rows.where("rule IS NULL")
    if len(blocked) == 2:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, cacheNodeIds=False).fit(labelled)
        margin = model.transform(rest).select("page_id", "host", "path", "rule", F.element_at(_array("probability"), 2).alias("score"))
    else:
        margin = rest.select("page_id", "host", "path", "rule", F.lit(blocked[0] if blocked else 0.0).alias("score"))
    verdict = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    ruled = rows.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(margin.withColumn("verdict", verdict))


def _array(vector: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(vector))


@query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
