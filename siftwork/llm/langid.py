"""Language ID by a byte convolutional network, trained in numpy.

Bytes (ASCII letters lower-cased) are embedded in EMBED dimensions; filters of WIDTHS bytes run over windows of WINDOW
bytes, each filter's maximum over the window goes through a ReLU and a dense softmax layer. A text is cut into
windows on end, the last one ending with the text, and every window of the whole text is scored; the mean of their
probabilities gives the text's language and score.

Training takes TRAIN_DOCS labelled documents, those with the smallest hash of doc_id among rows whose lang is known
and that aren't held out (crc32(doc_id as text) mod 4 = 2), and TRAIN_WINDOWS windows of each at hashed places. That
bound holds at every size, as does the driver's memory. Only text goes into a prediction.

Defined cases: null text or one without a letter gives `und` with score 0; repeated rows are predicted one by one and alike; of equal
probabilities the language that sorts first is taken; without any labelled row all texts are `und`; null doc_id is not held out and is never
trained on; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

WINDOW, EMBED, WIDTHS, FILTERS = 192, 8, (2, 3, 4), 16
TRAIN_DOCS, TRAIN_WINDOWS, EPOCHS, BATCH, RATE, SEED = 3000, 2, 6, 64, 0.01, 7
ROWS_AT_ONCE = 64
SPAN = max(WIDTHS)
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
OUT_DDL = "doc_id bigint, held_out boolean, lang_pred string, score double"
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"
LETTER = re.compile(r"[^\W\d_]")


def windows_of(text: bytes) -> np.ndarray:
    """(n, WINDOW) bytes: the whole text, its last window ending with it; a short text is padded with blanks."""
    b = np.frombuffer(text.lower(), np.uint8)
    if len(b) <= WINDOW:
        return np.pad(b, (0, WINDOW - len(b)), constant_values=32)[None]
    n = len(b) // WINDOW
    out = b[: n * WINDOW].reshape(n, WINDOW)
    return np.concatenate([out, b[None, -WINDOW:]]) if len(b) % WINDOW else out


class ByteConvNet:
    def __init__(self, labels: list[str]):
        rng = np.random.default_rng(SEED)
        self.labels = labels
        n = FILTERS * len(WIDTHS)
        self.mask = np.concatenate([np.repeat((np.arange(SPAN) < w)[:, None], FILTERS, 1) for w in WIDTHS], 1).repeat(EMBED, 0).astype(np.float32)
        self.p = {
            "e": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "w": rng.normal(0, 0.3, (SPAN * EMBED, n)).astype(np.float32) * self.mask,
            "b": np.zeros(n, np.float32),
            "d": rng.normal(0, 0.2, (n, len(labels))).astype(np.float32),
            "c": np.zeros(len(labels), np.float32),
        }

    def _spans(self, x: np.ndarray) -> np.ndarray:
        e = self.p["e"][x]
        t = x.shape[1] - SPAN + 1
        return np.lib.stride_tricks.as_strided(e, (len(x), t, SPAN * EMBED), (e.strides[0], e.strides[1], e.strides[2]), writeable=False)

    def _top(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spans = np.ascontiguousarray(self._spans(x))
        conv = (spans.reshape(-1, SPAN * EMBED) @ self.p["w"]).reshape(len(x), -1, self.p["w"].shape[1])
        return spans, conv, conv.max(1) + self.p["b"]

    def _soft(self, top: np.ndarray) -> np.ndarray:
        z = np.maximum(top, 0) @ self.p["d"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._soft(self._top(x[i : i + ROWS_AT_ONCE])[2]) for i in range(0, len(x), ROWS_AT_ONCE)])

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross entropy of rows x with labels y."""
        spans, conv, top = self._top(x)
        dz = self._soft(top)
        dz[np.arange(len(x)), y] -= 1
        dz *= (weight / len(x))[:, None]
        act = np.maximum(top, 0)
        dtop = (dz @ self.p["d"].T) * (top > 0)
        best = conv.argmax(1)
        picked = np.take_along_axis(spans, best[:, :, None].repeat(1, 2), 1)  # the span each filter chose
        dw = np.einsum("nfk,nf->kf", picked, dtop) * self.mask
        dspan = dtop[:, :, None] * self.p["w"].T[None]
        byte = x[np.arange(len(x))[:, None, None], best[:, :, None] + np.arange(SPAN)]
        de = np.zeros_like(self.p["e"])
        np.add.at(de, byte.reshape(-1), dspan.reshape(-1, EMBED))
        return {"e": de, "w": dw, "b": dtop.sum(0), "d": act.T @ dz, "c": dz.sum(0)}

    def fit(self, x: np.ndarray, y: np.ndarray) -> "ByteConvNet":
        """Adam over EPOCHS in batches; languages weigh alike, however often they occur."""
        rng = np.random.default_rng(SEED)
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.labels)), 1) / len(self.labels)).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                at = order[i : i + BATCH]
                step += 1
                for k, g in self.gradients(x[at], y[at], weight[y[at]]).items():
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.001 * (g * g - v2[k])
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def training_windows(docs: DataFrame) -> pd.DataFrame:
    """The bounded training sample: lang and a window of text in each row."""
    spark = docs.sparkSession
    known = docs.filter(F.expr(f"doc_id is not null and lang is not null and not {HELD_OUT}"))
    # ids first: the sort sees no texts
    ids = known.select("doc_id", F.expr("xxhash64(doc_id, 17)").alias("h")).orderBy("h", "doc_id").limit(TRAIN_DOCS).select("doc_id").collect()
    chosen = F.broadcast(spark.createDataFrame([(r.doc_id,) for r in ids], "doc_id bigint").distinct())
    picked = known.filter("text is not null").join(chosen, "doc_id", "left_semi")
    place = f"1 + pmod(xxhash64(doc_id, k), greatest(char_length(text) - {WINDOW}, 1))"
    cut = picked.select("lang", F.expr(f"explode(transform(sequence(1, {TRAIN_WINDOWS}), k -> substring(text, cast({place} as int), {WINDOW})))").alias("text"))
    return cut.toPandas()


def trained(docs: DataFrame) -> ByteConvNet | None:
    sample = training_windows(docs)
    sample = sample[[bool(LETTER.search(t)) for t in sample["text"]]] if len(sample) else sample
    if not len(sample):
        return None
    sample = sample.sort_values(["lang", "text"], kind="stable")
    labels = sorted(sample["lang"].unique())
    x = np.concatenate([windows_of(t.encode())[:1] for t in sample["text"]])
    return ByteConvNet(labels).fit(x, np.searchsorted(labels, sample["lang"].to_numpy(str)))


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def judged(texts: list[bytes | None], model: ByteConvNet | None) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    x, langs, scores = [], ["und"] * len(texts), [0.0] * len(texts)
    for t in texts:
        ok = bool(t) and model is not None and has_letter(t.decode())
        x.append(windows_of(t) if ok else np.empty((0, WINDOW), np.uint8))
    if any(map(len, x)):
        prob = model.predict(np.concatenate(x)).astype(np.float64)
        at = 0
        for i, n in enumerate(map(len, x)):
            if n:
                mean = prob[at : at + n].mean(0)
                best = int(mean.argmax())
                langs[i], scores[i] = model.labels[best], float(min(1.0, max(0.0, mean[best])))
            at += n
    return langs, scores


def with_language(docs: DataFrame, model: ByteConvNet | None) -> DataFrame:
    """docs with all its columns, lang_pred and score."""
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part, texts in c.grouped(batch):
                langs, scores = judged(texts, model)
                names = [*part.schema.names, "lang_pred", "score"]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: ByteConvNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""

    def run(batches):
        for batch in batches:
            for part, texts in c.grouped(batch):
                langs, scores = judged(texts, model)
                yield c.rows_of(OUT, [part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), langs, scores])

    return docs.select(F.col("doc_id").cast("long"), F.expr(HELD_OUT).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, OUT_DDL)


def identify(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return predict(docs, trained(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return identify(c.table(spark, sf_dir, "documents"))
