import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftwork.llm import common, packing

from . import test_line_dedup, test_minhash, test_packing, test_secrets
from .helpers import HOSTILE, frame


def texts():
    rng = np.random.default_rng(3)
    line = "This line of boilerplate stands in many of the documents here"
    out = []
    for i in range(40):
        words = [f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in rng.integers(0, 100, 60)]
        out.append(" ".join(words) + (f"\n{line}\nfoot {i}" if i % 4 == 0 else "") + (" password=hunter22x" if i % 5 == 0 else ""))
    return out + [out[1], out[2] + " more", None, "12345 678", "", out[7]]


def test_stages_against_brute_force(spark, tmp_path):
    all_texts = texts()
    frame(spark, all_texts, extra=False).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = common.table(spark, str(tmp_path), "documents")
    columns = docs.columns
    kept = dict(enumerate(all_texts))
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        after[name] = {r.doc_id: r for r in docs.collect()}
    letters = {i: t for i, t in kept.items() if any(ch.isalpha() for ch in t or "")}
    assert set(after["language_id"]) == set(letters)
    lined = {i: v[2] for i, v in test_line_dedup.brute(letters).items()}
    assert {i: r.text for i, r in after["line_dedup"].items()} == lined
    assert all(r.n_chars == len(r.text) for r in after["line_dedup"].values())
    alone = {i: lined[i] for i, (_, _, k) in test_minhash.brute(lined).items() if k}
    assert set(after["minhash_near_dedup"]) == set(alone)
    assert {i for i, r in after["secret_scan"].items() if "[SECRET]" in r.text} == {i for i, t in alone.items() if test_secrets.base(t)}
    tok = Tokenizer.from_file(common.tokenizer_path(packing.VOCABULARY))
    test_packing.check(corpus_pipeline.run(spark, str(tmp_path)).collect(), {i: r.text for i, r in after["secret_scan"].items()}, tok)


def test_hostile_rows_through_every_stage(spark, tmp_path):
    """Null ids and texts, repeated rows, very long texts, clashing columns; then no rows at all."""
    clash = ["lang_pred", "score", "n_lines", "n_dropped", "base", "spans", "candidates", "row", "node", "key", "kept", "component", "ids", "gone", "__t", "a.b"]
    texts = [t for t in HOSTILE if t != "\x00\x01\x1c\x1f\x85 z"] + ["clean words of a plain text that says something " * 3] * 2
    df = frame(spark, texts, extra=False).selectExpr("*", *[f"'{x}' as `{x}`" for x in clash])
    df = df.unionAll(df.limit(5)).unionAll(df.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("source", F.lit(None).cast("string"))
    for rows in (df, df.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.cut(stage(spark, docs, str(tmp_path)), "hostile")
            assert docs.columns == df.columns
            assert {r[x] for r in docs.collect() for x in clash} <= set(clash)
            assert docs.filter(" or ".join(f"`{x}` <> '{x}'" for x in clash)).isEmpty()
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert bool(pieces) == (docs.count() > 0)


def test_entry_registers_all(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
