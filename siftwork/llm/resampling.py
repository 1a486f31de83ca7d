"""Importance resampling towards a target distribution over hashed n-grams, in DataFrame operations only.

A feature is a run of 1 to NGRAM words, hashed to one of BUCKETS buckets. The corpus and the target are each one count for
each bucket: occurrences are exploded and summed before the shuffle, so what crosses it is BUCKETS rows at most from each task, however
frequent a word is. The counts, BUCKETS long, give the log ratio of each bucket (its gain), which goes back into the plan as one literal
array. Scoring explodes nothing and shuffles nothing: higher-order functions make a document's array of buckets and add up the gains.

The draw is Gumbel top-k: a document's score is its weight plus noise from a hash of seed and doc_id, and the highest scores are a sample
without replacement in proportion to exp(weight). Ranks are numbered by range (global_ordinal), so no task sorts all documents.

Defined cases: null or blank text has no features and weight 0; a null doc_id has a weight but no score and is never drawn; rows that
repeat a doc_id are documents of their own, ties of doc_id and score go to more features, and rows equal in these are
interchangeable; an empty table gives no rows, and an empty target has T = 0; extra columns of any name are ignored.
"""

from __future__ import annotations

import json
import math
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.operators.order import global_ordinal

from . import common as c

BUCKETS, NGRAM, SEED = 10_000, 1, 2024
MIN_WORDS, DRAWN_PERCENT = 20, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD, -1), lambda w: w != "")


def buckets(found: Column, ngram: int = NGRAM, of: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ngram of the words."""
    bucket = lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(of)).cast("int")
    runs = [F.transform(found, bucket)]
    for n in range(2, ngram + 1):
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, partial(lambda n, i: bucket(F.array_join(F.slice(found, i, n), " ")), n)))
    return runs[0] if ngram == 1 else F.concat(*runs)


def totals(texts: DataFrame, ngram: int = NGRAM, of: int = BUCKETS) -> np.ndarray:
    """Occurrences in each bucket over all texts(text)."""
    each = texts.select(F.explode(buckets(words(F.col("text")), ngram, of)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    out = np.zeros(of, np.int64)
    for bucket, n in each.collect():  # `of` rows at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed target to the smoothed corpus in each bucket, floored."""
    big_s, big_t, k = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (big_s + k) / ((s + 1) * (big_t + k)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs(doc_id, text)."""
    each = docs.select("doc_id", words(F.col("text")).alias("words"))
    each = each.select("doc_id", F.size("words").cast("long").alias("n_words"), buckets(F.col("words"), ngram, len(gain)).alias("buckets"))
    table = F.from_json(F.lit(json.dumps(gain.tolist())), "array<bigint>")  # folded to one literal array
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    return each.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS, ngram: int = NGRAM, of: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of docs(doc_id, text); percent of the documents
    with at least min_words words are drawn so that they look like target(text)."""
    docs = c.no_clash(docs, ["doc_id", "text"])
    gain = gains(totals(docs, ngram, of), totals(c.no_clash(target, ["text"]), ngram, of))
    scored = weighed(docs, gain, ngram).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = c.cut(scored, "op12-scored")
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    drawn = scored.filter(able).count() * percent // 100
    ranked = global_ordinal(scored.filter(able), [F.desc("score"), F.asc("doc_id"), F.desc("n_features")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    return resample(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: SQL has no crc32: 256 table entries by the polynomial's rule, then a fold over the bytes of each distinct word.
ORACLE = f"""
WITH RECURSIVE step(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT {_WORDS} AS ws FROM benchmark),
vocabulary AS (SELECT DISTINCT unnest(ws) AS w FROM (SELECT ws FROM d UNION ALL SELECT ws FROM b)),
bytes AS (SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS bs FROM vocabulary),
bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda a, x: xor(a // 256, t[1 + xor(a % 256, x)])), 4294967295) % 10000 AS k FROM bytes, crc),
dw AS (SELECT doc_id, k FROM (SELECT doc_id, unnest(ws) AS w FROM d) JOIN bucket USING (w)),
bw AS (SELECT k FROM (SELECT unnest(ws) AS w FROM b) JOIN bucket USING (w)),
s AS (SELECT k, count(*) AS s FROM dw GROUP BY k), t AS (SELECT k, count(*) AS t FROM bw GROUP BY k),
gain AS (SELECT i AS k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS gain
         FROM range(10000) r(i) LEFT JOIN s ON s.k = i LEFT JOIN t ON t.k = i),
weight AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN gain USING (k) GROUP BY doc_id),
scored AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
           FROM d LEFT JOIN weight ON weight.doc_id = d.doc_id),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM drawn) * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn ON drawn.doc_id = scored.doc_id
"""
