"""Quality rules: base counts and repetition found by suffix arrays.

The words of a group of documents form one sequence whose symbols differ between documents. Prefix doubling sorts its
suffixes: in each round only suffixes that still share their rank are sorted, by the rank of what follows them, so
rounds stop at the longest repeat. The ranks of each round are kept; from them the longest common prefixes of
neighbouring suffixes are read off from the highest power of two down. Runs of neighbours with a common prefix of
MIN_REPEAT words or more are the LCP intervals of the maximal repeated substrings; the union of the spans of their
occurrences gives the covered fraction, their greatest length the longest repeat.

A text fails the method's verdict if the spans cover more than MAX_COVERED of its words, or the longest repeat is
longer than both LONG_WORDS words and MAX_LONGEST of its words. What the spans cover is part of the base rule's repeated
words, half of the text at most once that rule is passed, and a passage and its copy cover twice its length: so MAX_COVERED must
stay well below 0.5 and MAX_LONGEST well below 0.25 for the method to add anything.

Memory: a group of 1 MB of text at most, or one longer text, has a rank for each word and round; rounds end at the longest repeat, so a text that
says one word n times holds log2(n) arrays of n ranks.

Defined cases: null text has no words and fails; null doc_id is kept; repeated rows are judged one by one and alike; texts of any length; equal
suffixes of one text go by place; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

MIN_LEVEL = 3
MIN_REPEAT, MAX_COVERED, MAX_LONGEST, LONG_WORDS = 1 << MIN_LEVEL, 0.3, 0.1, 60
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
OUT = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
OUT_DDL = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, covered_words bigint, longest_repeat bigint, base_failed boolean, kept boolean"
SPAN = pa.struct([("length", pa.int64()), ("starts", pa.list_(pa.int64()))])


def suffix_ranks(symbols: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4... symbols, until all differ. left: symbols from each place to the end of
    its document; symbols of different documents differ."""
    n = len(symbols)
    _, rank, size = np.unique(symbols, return_inverse=True, return_counts=True)
    starts = np.cumsum(size) - size
    levels = [starts[rank]]
    active = np.flatnonzero(size[rank] > 1)
    k = 1
    while len(active):
        old = levels[-1]
        rest = left[active] > k
        after = np.where(rest, old[np.minimum(active + k, n - 1)] + 1, 0)
        order = np.argsort(old[active] * np.int64(n + 1) + after, kind="stable")
        at, a, b = active[order], old[active][order], after[order]
        group = np.append(True, a[1:] != a[:-1])
        new = group | np.append(True, b[1:] != b[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        of_group = np.flatnonzero(group)
        group_start = np.repeat(of_group, np.diff(np.append(of_group, len(at))))
        rank = old.copy()
        rank[at] = a + np.repeat(first, size) - group_start
        levels.append(rank)
        active = at[np.repeat(size > 1, size)]
        k *= 2
    return levels


def neighbours(levels: list[np.ndarray], left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of suffixes that are neighbours in the suffix array and share MIN_REPEAT words or more, in order: places a and
    b, and the length of their common prefix."""
    n = len(left)
    if len(levels) <= MIN_LEVEL:
        none = np.empty(0, np.int64)
        return none, none, none
    sa = np.empty(n, np.int64)
    sa[levels[-1]] = np.arange(n)
    shared = levels[MIN_LEVEL][sa]
    t = np.flatnonzero(shared[1:] == shared[:-1])
    a, b = sa[t], sa[t + 1]
    lcp = np.zeros(len(t), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        room = np.minimum(left[a], left[b]) - lcp >= (1 << level)
        x, y = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        lcp += np.where(room & (levels[level][x] == levels[level][y]), 1 << level, 0)
    return a, b, lcp


def intervals(a: np.ndarray, b: np.ndarray, lcp: np.ndarray) -> list[tuple[int, list[int]]]:
    """The LCP intervals of one document: length and ascending starts of each maximal repeated substring."""
    found: list[tuple[int, list[int]]] = []
    stack: list[tuple[int, list[int]]] = []

    def close(to: int) -> None:
        while stack and stack[-1][0] > to:
            length, own = stack.pop()
            found.append((length, sorted(set(own))))
            if stack and stack[-1][0] >= to and stack[-1][0] > 0:
                stack[-1][1].extend(own)
            elif to:
                stack.append((to, list(own)))

    last = None
    for x, y, n in zip(a.tolist(), b.tolist(), lcp.tolist()):
        if x != last:
            close(0)
        close(n)
        if not stack or stack[-1][0] < n:
            stack.append((n, [x]))
        stack[-1][1].append(y)
        last = y
    close(0)
    return found


def judge(texts: list[bytes | None], with_spans: bool = False) -> list[list]:
    """Columns of OUT without doc_id, and the repeats of each text if asked for."""
    words = [t.split() if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(counts)
    begin = ends - counts
    n = int(counts.sum())
    doc = np.repeat(np.arange(len(words)), counts)
    pos = c.ranges(counts)
    left = counts[doc] - pos
    w = np.concatenate([c.word_hashes(x) for x in words]) if n else np.empty(0, np.uint64)
    salt = c.mixed(np.arange(1, len(words) + 1, dtype=np.uint64))
    sums = lambda flags: np.append(0, np.cumsum(flags))[ends] - np.append(0, np.cumsum(flags))[begin]
    covers = lambda start, length: np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1))[:n] > 0
    own = c.mixed(w ^ salt[doc])
    tri = c.ngram_hashes(own, 3)
    at = np.flatnonzero(left[: len(tri)] >= 3)
    order = at[np.argsort(tri[at])]
    same = np.append(False, tri[order][1:] == tri[order][:-1])
    twice = order[same | np.append(same[1:], False)] if len(order) else order
    repeat_words = sums(covers(twice, 3)) if n else counts
    levels = suffix_ranks(own, left) if n else []
    a, b, lcp = neighbours(levels, left)
    spread = covers(np.append(a, b), np.append(lcp, lcp))
    covered = sums(spread) if n else counts
    longest = np.zeros(len(words), np.int64)
    np.maximum.at(longest, doc[a], lcp)
    chars, symbols, lines = [], [], []
    for t, ws in zip(texts, words):
        t = t or b""
        chars.append(len(t.decode()) - sum(map(t.count, map(bytes, zip(BLANKS)))))
        symbols.append(sum(map(t.count, map(bytes, zip(SYMBOLS)))))
        full = [x for x in t.split(b"\n") if x and x.strip()]
        lines.append(len(full) - len(set(full)))
    failed = (counts < 50) | (100 * repeat_words > 50 * counts)
    bad = (covered > MAX_COVERED * counts) | ((longest > LONG_WORDS) & (longest > MAX_LONGEST * counts))
    out = [counts.tolist(), chars, symbols, lines, repeat_words.tolist(), covered.tolist(), longest.tolist(), failed.tolist(), (~failed & ~bad).tolist()]
    if with_spans:
        spans: list[list] = [[] for _ in words]
        of = doc[a]
        for d in np.unique(of):
            pick = of == d
            spans[d] = [{"length": x, "starts": [s - int(begin[d]) for s in starts]} for x, starts in intervals(a[pick], b[pick], lcp[pick])]
        out.append(spans)
    return out


def assess(docs: DataFrame, with_spans: bool = False) -> DataFrame:
    """One row per document with its counts, covered_words, longest_repeat and verdict; with_spans adds repeats: the maximal
    repeated substrings of MIN_REPEAT words or more, as length and word starts."""
    schema = pa.schema([*OUT, ("repeats", pa.list_(SPAN))]) if with_spans else OUT
    ddl = OUT_DDL + (", repeats array<struct<length: bigint, starts: array<bigint>>>" if with_spans else "")

    def run(batches):
        for batch in batches:
            for part, texts in c.grouped(batch, most=1 << 20):
                yield c.rows_of(schema, [part.column("doc_id").to_pylist(), *judge(texts, with_spans)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def query(spark, sf_dir: str) -> DataFrame:
    return assess(c.table(spark, sf_dir, "documents"))
