import hashlib
from collections import defaultdict

import duckdb

from siftwork.llm import line_dedup

from .helpers import HOSTILE, frame, with_null_id


def brute(texts):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    docs = defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            docs[key(x)].add(i)
    gone = lambda i, x: len(key(x)) >= 40 and len(docs[key(x)]) >= 5 and max(docs[key(x)]) != i
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not gone(i, x)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def run(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(df).collect()}


LINE = "A line that is Repeated É in many documents, 40+"


def texts():
    out = [f"own {i}\n{LINE if i % 2 else '  ' + LINE.lower().replace('é', 'É') + chr(13)}\n\nend {i}" for i in range(7)]
    out += [LINE + "\n" + LINE, "\n".join([LINE] * 3 + ["x"]), LINE.replace("É", "é"), "short line\nshort line"] + ["short line"] * 8
    return out + HOSTILE


def test_brute_force(spark):
    t = texts()
    assert run(frame(spark, t)) == brute(dict(enumerate(t)))


def test_oracle(spark, sf):
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in line_dedup.query(spark, sf).collect())
    assert got == sorted(duckdb.sql(line_dedup.ORACLE).fetchall())


def test_null_ids_repeats_and_empty(spark):
    df = frame(spark, texts())
    both = with_null_id(df.unionAll(df))
    rows = line_dedup.drop_repeated_lines(both).collect()
    want = brute(dict(enumerate(texts())))
    assert len(rows) == 2 * len(texts()) + 3
    assert all((r.n_lines, r.n_dropped, r.text) == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert all(r.n_dropped == 0 for r in rows if r.doc_id is None)
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() in {hashlib.sha256(v[2].encode()).hexdigest() for v in want.values()}


def test_extra_columns_of_any_name_and_a_heavy_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.c, "HEAVY", 2)  # the commonest lines are heavy, the others aren't
    other = "Another line that is repeated in a few documents, 40+"
    t = [f"{LINE}\n{other if i < 6 else ''}\n{i}" for i in range(60)]
    df = frame(spark, t, extra=False).selectExpr("*", "'a' __t", "'b' t", "'c' pos", "'d' gone", "'e' lines", "'f' `row`", "'g' n_lines", "'h' keeper", "'i' `x.y`")
    rows = line_dedup.drop_repeated_lines(df).collect()
    want = brute(dict(enumerate(t)))
    assert all((r.n_dropped, r.text) == want[r.doc_id][1:] for r in rows) and len(rows) == 60
    assert {(r["__t"], r.t, r.pos, r.gone, r.lines, r.row, r.n_lines, r.keeper, r["x.y"]) for r in rows} == set([tuple("abcdefghi")])
