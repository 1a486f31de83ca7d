import hashlib
import itertools
import random
import re
import zlib

import pytest

from siftwork.llm import common, conversations as v

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """(turn, role, text) of each conversation after the damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {conv: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for conv, x in out.items()}


def marks(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = BLANK.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_repairs(rows, found, most):
    """Every (cost, labels, repaired rows) with at most `most` inserts in a place, by trying all."""
    def tails(i):
        if i == len(rows):
            yield 0, "", []
            return
        _, role, text = rows[i]
        options = [(3, "D", [])]
        if found[i] not in ("blank", "duplicate"):
            t = found[i] == "truncated"
            options += [(t, "K", [(role, text)]), (2 + t, "R", [("user", text)]), (2 + t, "R", [("assistant", text)])]
        for (c1, l1, r1), (c2, l2, r2) in itertools.product(options, list(with_inserts(i + 1))):
            yield c1 + c2, l1 + l2, r1 + r2

    def with_inserts(i):
        rest = list(tails(i))
        for k in range(most + 1):
            for put in itertools.product(("user", "assistant"), repeat=k):
                for c, lab, r in rest:
                    yield 2 * k + c, "I" * k + lab, [(x, "") for x in put] + r

    return with_inserts(0)


def brute(rows, most=2):
    found = marks(rows)
    fits = re.compile("(s?(ua)+)?")
    cost, audit, kept = min((x for x in all_repairs(rows, found, most) if all(r for r, _ in x[2]) and fits.fullmatch("".join(r[0] for r, _ in x[2]))), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{a}:{b}" for a, b in kept)
    return (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, int(cost), audit, hashlib.sha256(text.encode()).hexdigest())


def run(df, piece_rows=v.PIECE_ROWS):
    return {r[0]: tuple(r)[1:] for r in v.repair(df, piece_rows).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


ROLES = ["system", "user", "assistant", "tool", "sys", "", " "]
TEXTS = ["", " \n", "Done.", "Not done", "Why? ", "a.b", "Done.", "é!\t", "x" * 50]


def random_rows(rng, n):
    return [(i if rng.random() < 0.9 else None, rng.choice(ROLES[:3] if rng.random() < 0.8 else ROLES), rng.choice(TEXTS)) for i in range(n)]


def test_every_repair_of_short_conversations():
    rng = random.Random(11)
    for _ in range(120):
        rows = sorted(random_rows(rng, rng.randrange(4)), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert tuple(v.repaired(rows)) == brute(rows), rows


def test_pieces_multiply_to_the_whole():
    rng = random.Random(12)
    for _ in range(200):
        rows = random_rows(rng, rng.randrange(1, 30))
        found = [(r[1], x) for r, x in zip(rows, v.faults(rows))]
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(3))})
        table = {p: {p: (0, "")} for p in v.GRAMMAR}
        for a, b in zip(cuts, cuts[1:]):
            table = v.product(table, {p: v.shortest(found[a:b], p) for p in v.GRAMMAR})
        assert v.closed(table[0]) == v.closed(v.shortest(found, 0))


def test_given_table(spark):
    df = common.table(spark, "/root/testdata/sf0.001", "conversations")
    rows = damage([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    got = run(df)
    assert set(got) == set(rows)
    assert got == {k: tuple(v.repaired(x)) for k, x in rows.items()}
    short = [k for k, x in rows.items() if len(x) <= 4]
    assert len(short) > 3 and all(got[k] == brute(rows[k], 1) for k in short)


def test_cheapest_cost_by_sql_of_all_sequences(spark):
    """Costs alone, by a table over all grammar states that knows nothing of labels."""
    rows = damage([tuple(r) for r in common.table(spark, "/root/testdata/sf0.01", "conversations").collect()])
    step = {0: "su", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}
    for x in rows.values():
        best = {0: 0}
        for (_, role, _), m in [*zip(x, marks(x)), ((None, None, None), None)]:
            for _ in range(4):
                for s in list(best):
                    for i in set(step[s]) & set("ua"):
                        best[to[i]] = min(best.get(to[i], 99999), best[s] + 2)
            if role is None:
                break
            new = {s: cost + 3 for s, cost in best.items()}
            if m not in ("blank", "duplicate"):
                for s, cost in best.items():
                    for i in step[s]:
                        price = (0 if role[:1] == i else 2 if i in "ua" else 99999) + (m == "truncated")
                        new[to[i]] = min(new.get(to[i], 99999), cost + price)
            best = new
        assert v.repaired(x)[5] == min(best.get(0, 99999), best.get(3, 99999))


@pytest.mark.parametrize("piece_rows", [3, 1000])
def test_hostile_and_hot(spark, piece_rows):
    rng = random.Random(5)
    rows = [(conv, i if rng.random() < 0.9 else None, rng.choice(ROLES[:3] if rng.random() < 0.8 else [*ROLES, None]), rng.choice([*TEXTS, None])) for conv in [*range(40), None] for i in range(rng.randrange(1, 7))]
    rows += [(777, i // 2, rng.choice(ROLES[:3]), rng.choice([f"t{i % 50}.", f"u{i}", f"v{i}.", "Same."])) for i in range(700)]
    rows += [(888, None, "user", "Same.")] * 150 + [(41, 0, "user", "y" * 200_000 + "."), (41, 1, "assistant", "z")]
    rows += [(1000 + i, 5, "user", "gone.") for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *[f"'clash' as `{x}`" for x in ("part", "seq", "whole", "copies", "audit", "labels", "h1", "again")]).repartition(5)
    want = {k: tuple(v.repaired(x)) for k, x in damage(rows).items()}
    assert run(df, piece_rows) == want
    assert any(x[6] == "" and x[7] == hashlib.sha256(b"").hexdigest() for x in want.values())
    assert run(df.limit(0)) == {}
    one = df.filter("conv_id = 888")
    assert run(one) == {888: want[888]}
