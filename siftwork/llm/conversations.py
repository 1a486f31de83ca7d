"""Conversation structure repair as weighted finite-state composition.

Three machines are composed: an input acceptor (the rows of a conversation in order), an edit transducer (Keep, Rerole, Delete, Insert with
their costs) and an acceptor of role initials, `(s?(ua)+)?`. Their composition is never built: arcs() makes those of a state when the search
reaches it. A weight is (cost, labels so far); the smaller cost wins, then the smaller label string. States in order of the row are a
topological order, so one sweep finds the shortest paths. Two strings of one row and one cost hold a label for each row and end in
one, hence neither begins with the other, and appending keeps their order: the weights form a semiring, and the table of shortest paths from
each grammar state to each (4 x 4) over a piece of a conversation can be multiplied with the next piece's.

That makes any conversation distributable. Rows are sorted by range over (conversation, turn, role, text), so a conversation of a third
of all rows lies in many partitions. What begins and ends within a partition and is short is repaired there. The rest is written in pieces of PIECE_ROWS
rows or PIECE_BYTES bytes at most; rows that repeat one of an earlier piece are found by hash aggregation; each piece becomes a table of
shortest paths, in parallel; the tables of a conversation are multiplied pairwise in a stream; and the text is replayed by the labels,
streaming, since a SHA-256 can only be taken in order. A task holds one piece, and the labels of one conversation, which are a field of the result.

Defined cases: null fields count as one space, a null turn sorts first and all rows of a null conv_id are one conversation, null in the
result; rows of equal turn are taken by role, then text, so equal rows stand side by side; an initial that the grammar lacks (or an
empty role) can't be kept; empty and very long texts are rows as others are; a conversation of which no row is left has zeros; an
empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

# fixed values: damage by crc32 % DAMAGES, costs of the edits, the role grammar
DAMAGES = 20
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
PIECE_ROWS, PIECE_BYTES = 1000, 1 << 20

Weights = dict[int, tuple[int, str]]
RESULT = [("conv_id", pa.int64()), *[(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())]
RESULT_DDL = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ROWS = [("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
PIECE = pa.schema([*RESULT, ("whole", pa.bool_()), ("part", pa.int32()), ("seq", pa.int32()), *ROWS])
PIECE_DDL = RESULT_DDL + ", whole boolean, part int, seq int, turns array<bigint>, roles array<string>, texts array<string>"
STATS = ["blank", "duplicate", "truncated", "illegal", "distinct", "least", "greatest"]
TABLE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("stats", pa.list_(pa.int64())), ("ends", pa.list_(pa.string())), ("at", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("labels", pa.list_(pa.string()))])
TABLE_DDL = "conv_id bigint, part int, seq int, stats array<bigint>, ends array<string>, at array<int>, costs array<bigint>, labels array<string>"


def fault(role: str, text: str, again: bool) -> str | None:
    """The row's first fault."""
    left = text.strip(BLANKS)
    return "blank" if not left else "duplicate" if again else "truncated" if left[-1] not in ".!?" else None


def edits(role: str, found: str | None):
    """Arcs of the edit transducer for one input row: label, cost, the initial put out (None: nothing)."""
    yield "D", DELETE, None
    if found not in ("blank", "duplicate"):
        more = TRUNCATED if found == "truncated" else 0
        yield "K", more, role[:1]
        for initial in ROLES:
            yield "R", REROLE + more, initial


def arcs(state: int, role: str, found: str | None):
    """Arcs of the composed machine out of (row, state), made on demand: label, cost, next state."""
    for label, cost, initial in edits(role, found):
        to = state if initial is None else GRAMMAR[state].get(initial)
        if to is not None:
            yield label, cost, to


def inserted(best: Weights) -> Weights:
    """With rows inserted in front of the next one; a cheapest path visits no grammar state twice there."""
    out, edge = dict(best), best
    for _ in GRAMMAR:
        new: Weights = {}
        for state, (cost, labels) in edge.items():
            for initial in ROLES:
                to = GRAMMAR[state].get(initial)
                if to is not None:
                    weight = (cost + INSERT, labels + "I")
                    if weight < out.get(to, (1 << 62, "")):
                        out[to] = new[to] = weight
        if not new:
            break
        edge = new
    return out


def shortest(rows: list[tuple[str, str | None]], start: int) -> Weights:
    """Lexicographically least (cost, labels) from the start to each state, over rows of (role, fault)."""
    best: Weights = {start: (0, "")}
    for role, found in rows:
        after: Weights = {}
        for state, (cost, labels) in inserted(best).items():
            for label, more, to in arcs(state, role, found):
                weight = (cost + more, labels + label)
                if to not in after or weight < after[to]:
                    after[to] = weight
        best = after
    return best


def product(a: dict[int, Weights], b: dict[int, Weights]) -> dict[int, Weights]:
    """Shortest paths over a's rows and then b's."""
    out: dict[int, Weights] = {}
    for start, row in a.items():
        best: Weights = {}
        for mid, (cost, labels) in row.items():
            for to, (more, further) in b[mid].items():
                weight = (cost + more, labels + further)
                if to not in best or weight < best[to]:
                    best[to] = weight
        out[start] = best
    return out


def closed(best: Weights) -> tuple[int, str]:
    return min(w for state, w in inserted(best).items() if state in FINAL)


class Replay:
    """Applies labels to rows that come in order; the grammar's state goes along, and the texts go into a digest."""

    def __init__(self, labels: str):
        self.labels, self.at, self.state, self.any, self.digest = labels, 0, 0, False, hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _follow(self, initial: str) -> None:
        self.state = GRAMMAR[self.state][initial]

    def _inserts(self) -> None:
        while self.at < len(self.labels) and self.labels[self.at] == "I":
            initial = next(x for x in ROLES if x in GRAMMAR[self.state])
            self._put(ROLES[initial], "")
            self._follow(initial)
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        label = self.labels[self.at]
        self.at += 1
        if label == "R":
            initial = next(x for x in ROLES if x in GRAMMAR[self.state])
            self._put(ROLES[initial], text)
            self._follow(initial)
        elif label == "K":
            self._put(role, text)
            self._follow(role[0])

    def end(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


@dataclass
class Stats:
    """Counts over consecutive rows; add() joins them with those of the rows that follow."""

    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0))
    first: tuple[str, str] | None = None  # initials of the first and last row
    least: int | None = None
    greatest: int | None = None

    @staticmethod
    def of(rows: list[tuple[int | None, str, str]], found: list[str | None]) -> Stats:
        s = Stats()
        for x in found:
            if x:
                s.counts[x] += 1
        initials = [role[:1] for _, role, _ in rows]
        s.counts["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        turns = {t for t, _, _ in rows if t is not None}
        s.counts["distinct"] = len(turns)
        if turns:
            s.least, s.greatest = min(turns), max(turns)
        if rows:
            s.first = (initials[0], initials[-1])
        return s

    def add(self, b: Stats) -> None:
        for k, v in b.counts.items():
            self.counts[k] += v
        if self.first and b.first:
            self.counts["illegal"] += self.first[1] + b.first[0] not in LEGAL
        if b.first:
            self.first = (self.first[0] if self.first else b.first[0], b.first[1])
        if b.least is not None:  # turns come in order
            self.counts["distinct"] -= self.greatest == b.least
            self.least = b.least if self.least is None else self.least
            self.greatest = b.greatest

    def row(self) -> list[int]:
        gaps = 0 if self.least is None else self.greatest - self.least + 1 - self.counts["distinct"]
        return [gaps, *(self.counts[x] for x in ("blank", "duplicate", "truncated", "illegal"))]


def faults(rows: list[tuple[int | None, str, str]], again: set[int] = frozenset()) -> list[str | None]:
    """Each row's first fault; again: numbers of rows whose like stands in front of these rows."""
    seen: set[tuple[str, str]] = set()
    out = []
    for i, (_, role, text) in enumerate(rows):
        out.append(fault(role, text, i in again or (role, text) in seen))
        seen.add((role, text))
    return out


def repaired(rows: list[tuple[int | None, str, str]]) -> list:
    """The result's fields behind conv_id, for all rows of one conversation."""
    found = faults(rows)
    cost, audit = closed(shortest([(role, x) for (_, role, _), x in zip(rows, found)], 0))
    replay = Replay(audit)
    for _, role, text in rows:
        replay.row(role, text)
    return [*Stats.of(rows, found).row(), cost, audit, replay.end()]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies: how often the row stands there after the damage."""
    space = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % DAMAGES
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(fate == 4, "user").otherwise(space("role"))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def in_pieces(piece_rows: int = PIECE_ROWS):
    """Rows in order -> results of the conversations that lie in this partition, pieces of those that are long or may go on in another."""

    def run(batches):
        part, seq, first, split = TaskContext.get().partitionId(), 0, True, False
        now: list | None = None  # [conv_id, rows, bytes]
        out: list[list] = [[] for _ in PIECE]

        def put(values: list) -> None:
            for col, x in zip(out, values):
                col.append(x)

        def piece() -> None:
            nonlocal seq
            seq += 1
            put([now[0], *[None] * 8, False, part, seq, *([r[k] for r in now[1]] for k in range(3))])

        def batch_of() -> pa.RecordBatch:
            made = c.rows_of(PIECE, out)
            for col in out:
                col.clear()
            return made

        held = 0
        for batch in batches:
            for conv, turn, role, text, copies in zip(*(col.to_pylist() for col in batch.columns)):
                if now is None or conv != now[0]:
                    if now is not None:
                        if first or split:
                            piece()
                        else:
                            put([now[0], *repaired(now[1]), True, None, None, None, None, None])
                        first = split = False
                    now = [conv, [], 0]
                for _ in range(copies):
                    now[1].append((turn, role, text))
                    now[2] += len(text)
                    held += len(text)
                    if len(now[1]) >= piece_rows or now[2] >= PIECE_BYTES:
                        piece()
                        now, split = [conv, [], 0], True
                if len(out[0]) >= 1000 or held >= 8 * PIECE_BYTES:
                    yield batch_of()
                    held = 0
        if now is not None:
            piece()
        if out[0]:
            yield batch_of()

    return run


def tables(batches):
    """Each piece's counts and its table of shortest paths."""
    for batch in batches:
        for row in batch.to_pylist():
            rows = list(zip(row["turns"], row["roles"], row["texts"]))
            found = faults(rows, set(row["again"] or ()))
            s = Stats.of(rows, found)
            ways = [(16 * p + q, *w) for p in GRAMMAR for q, w in shortest([(r[1], x) for r, x in zip(rows, found)], p).items()]
            stats = [s.counts.get(x) if x in s.counts else getattr(s, x) for x in STATS]
            yield c.rows_of(TABLE, [[row["conv_id"]], [row["part"]], [row["seq"]], [stats], [list(s.first) if s.first else None], *([[w[k] for w in ways]] for k in range(3))])


def _stats(row: dict) -> Stats:
    v = dict(zip(STATS, row["stats"]))
    return Stats({x: v[x] for x in STATS[:5]}, tuple(row["ends"]) if row["ends"] else None, v["least"], v["greatest"])


def joined(batches):
    """Tables in the order of their pieces -> a row for each conversation, with the labels and no digest yet."""
    schema = pa.schema(RESULT)
    now, counts, stack = None, None, []

    def done() -> pa.RecordBatch:
        while len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            stack.append((a[0] + b[0], product(a[1], b[1])))
        cost, audit = closed(stack[0][1][0])
        return c.rows_of(schema, [[x] for x in (now[0], *counts.row(), cost, audit, None)])

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != now[0]:
                if now is not None:
                    yield done()
                now, counts, stack = [row["conv_id"]], Stats(), []
            counts.add(_stats(row))
            table: dict[int, Weights] = {p: {} for p in GRAMMAR}
            for at, cost, labels in zip(row["at"], row["costs"], row["labels"]):
                table[at // 16][at % 16] = (cost, labels)
            stack.append((1, table))
            while len(stack) > 1 and stack[-1][0] == stack[-2][0]:  # products of equal length: each label is copied log(pieces) times
                b, a = stack.pop(), stack.pop()
                stack.append((a[0] + b[0], product(a[1], b[1])))
    if now is not None:
        yield done()


def replayed(batches):
    """A conversation's row with its labels, then its pieces in order -> the row with its digest."""
    schema = pa.schema(RESULT)
    head, replay = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == -1:
                if head:
                    yield c.rows_of(schema, [[head[x]] for x in schema.names[:-1]] + [[replay.end()]])
                head, replay = row, Replay(row["audit"])
            else:
                for role, text in zip(row["roles"], row["texts"]):
                    replay.row(role, text)
    if head:
        yield c.rows_of(schema, [[head[x]] for x in schema.names[:-1]] + [[replay.end()]])


def repeats(pieces: DataFrame) -> DataFrame:
    """part, seq, again: the rows of a piece whose like stands in an earlier piece of the conversation."""
    rows = pieces.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "x"))
    rows = rows.select("conv_id", "part", "seq", "i", F.xxhash64("x.roles", "x.texts").alias("h1"), F.xxhash64(F.lit(1), "x.texts", "x.roles").alias("h2"))
    keys = rows.groupBy("conv_id", "h1", "h2", "part", "seq").agg(F.min("i").alias("i"))  # further rows of the piece are seen there
    first = keys.groupBy("conv_id", "h1", "h2").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    later = keys.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter("struct(part, seq) > first")
    return later.groupBy("part", "seq").agg(F.collect_list("i").alias("again"))  # PIECE_ROWS at most


def repair(conversations: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """A row for each conv_id of conversations(conv_id, turn, role, text): what was wrong after the damage and how it is repaired."""
    rows = damaged(c.no_clash(conversations, ["conv_id", "turn", "role", "text"]))
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 200)).sortWithinPartitions("conv_id", "turn", "role", "text")
    done = c.cut(ranged.mapInArrow(in_pieces(piece_rows), PIECE_DDL), "op11-pieces")
    pieces = done.filter("not whole")
    marked = pieces.select("conv_id", "part", "seq", "turns", "roles", "texts").join(repeats(pieces), ["part", "seq"], "left")
    ways = marked.mapInArrow(tables, TABLE_DDL)
    heads = ways.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(joined, RESULT_DDL)
    head = heads.select("*", F.lit(-1).alias("part"), F.lit(0).alias("seq"), *[F.lit(None).cast("array<string>").alias(x) for x in ("roles", "texts")])
    ordered = head.unionByName(pieces.select(*head.columns)).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    names = [x for x, _ in RESULT]
    return done.filter("whole").select(*names).unionByName(ordered.mapInArrow(replayed, RESULT_DDL))


def query(spark, sf_dir: str) -> DataFrame:
    return repair(c.table(spark, sf_dir, "conversations"))
