from pyspark.sql import functions as F

from maskwright.llm import lines as op
from tests.llm import frames

LINE = "  A line that is long enough to be compared, Ä 1 "


def plain(rows):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans(op.UPPER, op.LOWER)
    key = lambda line: line.strip(strip).translate(lower)
    held = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= op.MIN_CHARS:
                held.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        all_lines = (text or "").split("\n")
        keep = [x for x in all_lines if len(held.get(key(x), ())) < op.MIN_DOCS or doc_id == max(i for i in held[key(x)] if i is not None)]
        out.append((doc_id, len(all_lines), len(all_lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def got(spark, docs):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in op.kept_text(docs, op.drop_bitmaps(docs)).collect()], key=repr)


def test_matches_the_plain_way(spark):
    more = [(100 + i, (LINE.upper() if i % 2 else LINE) + "\nown " + str(i) + ("\n" + LINE) * (i % 3) + "\nshort\n", None, "s", 0) for i in range(7)]
    more += [(None, LINE, None, None, 0), (200, "\n".join([LINE] * 70 + ["in between"] * 70 + [LINE]), None, "s", 0), (201, LINE, None, "s", 0)]
    rows = frames.ROWS + more
    assert got(spark, frames.documents(spark, rows)) == plain(rows)


def test_one_line_in_a_third_of_all_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, LINE).otherwise(F.concat(F.lit(LINE), "id")).alias("text"))
    out = op.kept_text(docs, op.drop_bitmaps(docs))
    assert out.agg(F.sum("n_dropped")).first()[0] == 999
    assert out.where("doc_id = 2997").first().kept == LINE


def test_empty_table(spark):
    assert got(spark, frames.empty(spark)) == []
