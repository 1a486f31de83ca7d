import random
import re
from collections import Counter

from siftwork.llm import common, quality

from .helpers import HOSTILE, frame, with_null_id


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    on = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(on)], len(w) < 50 or 100 * len(on) > 50 * len(w)


def repeats(w):
    """Covered words and longest repeat of MIN_REPEAT words or more, by comparing all pairs of places."""
    on, longest = set(), 0
    for i in range(len(w)):
        for j in range(i):
            k = 0
            while i + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            if k >= quality.MIN_REPEAT:
                longest = max(longest, k)
                on |= {*range(i, i + k), *range(j, j + k)}
    return len(on), longest


def test_base_on_tables(spark, sf):
    texts = dict(common.table(spark, sf, "documents").select("doc_id", "text").collect())
    for r in quality.query(spark, sf).collect():
        counts, failed = base(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == counts
        assert r.base_failed == failed
        assert not (r.base_failed and r.kept)


def test_repeats_by_brute_force():
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        w = [rng.choice("abcd") for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            w += w[rng.randrange(len(w) + 1) :][: rng.randrange(40)]
        texts.append(" ".join(w).encode())
    out = quality.judge(texts, with_spans=True)
    for t, covered, longest, spans in zip(texts, out[5], out[6], out[9]):
        w = t.split()
        assert (covered, longest) == repeats(w)
        on = set()
        for s in spans:
            told = {tuple(w[a : a + s["length"]]) for a in s["starts"]}
            assert len(told) == 1 and len(s["starts"]) >= 2
            everywhere = [i for i in range(len(w)) if tuple(w[i : i + s["length"]]) in told]
            assert everywhere == s["starts"]
            on |= {i for a in s["starts"] for i in range(a, a + s["length"])}
        assert len(on) == covered and max([0, *(s["length"] for s in spans)]) == longest


def test_verdict():
    rng = random.Random(1)
    clean = " ".join(f"w{rng.randrange(10**6)}" for _ in range(500))
    twice = clean + " " + clean
    passage = clean + " " + " ".join(clean.split()[:30])
    assert quality.judge([clean.encode(), twice.encode(), passage.encode()])[8] == [True, False, True]


def test_verdict_adds_to_the_base_rule():
    rng = random.Random(2)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, short = new(2400), [new(50) for _ in range(40)]
    far = new(2600) + passage + new(2600) + passage  # one long passage twice: 48 % covered
    third = new(300) + passage[:250] + new(1200) + passage[:250]  # 25 % covered, fails by the longest repeat alone
    many = [w for x in short for w in x + new(65)] + [w for x in short for w in x + new(65)]  # 43 % in repeats of 50 words
    quote = new(1000) + passage[:40] + new(1000) + passage[:40]
    out = quality.judge([" ".join(x).encode() for x in (far, third, many, quote)])
    assert out[7] == [False] * 4
    assert out[8] == [False, False, False, True]


def test_hostile(spark):
    got = quality.assess(with_null_id(frame(spark)), with_spans=True).collect()
    assert len(got) == len(HOSTILE) + 3
    for r in got:
        if r.doc_id is not None:
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == base(HOSTILE[r.doc_id])[0]
    assert quality.assess(frame(spark).limit(0)).count() == 0
