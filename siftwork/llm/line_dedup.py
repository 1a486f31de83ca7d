"""Line dedup in DataFrame operations only.

A line's key is the line stripped of blanks and lower-cased (ASCII). Keys of MIN_CHARS code points or more are hashed to
128 bits, and documents are counted for each hash in two aggregations (first distinct pairs of hash and document, then
documents), so a line that stands in a third of all documents is combined before and after either shuffle and no task gets a
hot key's rows. Keys found in MIN_DOCS documents lose all lines except those in the largest doc_id. The frequent keys are written;
the few that are heavy (a bounded number by definition) are broadcast to the lines, and their lines are dealt over all tasks. Positions to
drop are joined back by document and the text is put together from the other positions.

Defined cases: null or empty text is one empty line; rows with null doc_id count nowhere and lose nothing; rows that share a
doc_id are one document for the count and each is put together by itself; ties can't arise, as one doc_id is the largest; an empty table gives no
rows; extra columns of any name are kept as they are, n_lines and n_dropped too, which then aren't counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

MIN_CHARS, MIN_DOCS = 40, 5
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def long_lines(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), pos, h1, h2 of every line whose key is long enough."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = lines.filter(F.length("line") >= MIN_CHARS).select("doc_id", "t", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
    key = key.filter(F.length("key") >= MIN_CHARS).withColumn("key", F.translate("key", UPPER, LOWER))
    return key.select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text and others) -> the same rows with text put together anew, n_lines and n_dropped."""
    own = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    lines = long_lines(own)
    pairs = lines.select("h1", "h2", "doc_id").distinct()
    often = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= MIN_DOCS)
    gone = c.join_counted(lines, c.cut(often, "op9-often"), ["h1", "h2"], "n", ["keeper"], ["doc_id", "pos"]).filter("doc_id <> keeper")
    gone = gone.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.struct(*[F.col(c.quoted(x)) for x in docs.columns]).alias("row"))
    joined = rows.join(gone.hint("shuffle_hash"), (F.col("row.doc_id") == F.col("doc_id")) & (F.xxhash64("row.text") == F.col("t")), "left")
    text = F.coalesce("row.text", F.lit(""))
    split = F.split(text, "\n", -1)
    n = F.size(split)
    kept = F.array_except(F.sequence(F.lit(0), n - 1), "gone")
    joined = joined.withColumn("lines", F.when(F.col("gone").isNotNull(), split))
    rebuilt = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda p: F.get(F.col("lines"), p)), "\n"))
    counts = {"n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    kept_columns = [rebuilt.alias(x) if x == "text" else F.col(f"row.{c.quoted(x)}") for x in docs.columns]
    return joined.select(*kept_columns, *[v.alias(k) for k, v in counts.items() if k not in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = c.no_clash(c.table(spark, sf_dir, "documents"), ["doc_id", "text"])
    done = drop_repeated_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> o.keeper, false) AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
