"""Secret scan in DataFrame functions only: base patterns and a randomness test battery.

Base spans come from fixed patterns. A place is found without any index function: split() gives what lies between the
matches and regexp_extract_all() the matches, so their lengths add up to places in code points.

The method adds strings that look random. A candidate is a maximal run of at least CANDIDATE_CHARS characters of the
base64 alphabets with a digit and a letter. Its encoding is inferred (hex, base32, base36 or base64), and in that alphabet of k
symbols three tests of the hypothesis "drawn at random" are made:
- chi-squared against a uniform alphabet, upper tail, its first two moments exact for any length and its tail by the cube root
  (Wilson and Hilferty). A tenth of the alphabet may be missing (TOLERANCE), as in base58;
- runs above and below the alphabet's middle (Wald-Wolfowitz), two-sided;
- lag-1 serial correlation, two-sided.
The tails are those of the complementary error function, with a relative error below 2e-7 however far out. Fisher's rule combines the
three into one p (chi-squared with six degrees of freedom).

The null is that the candidate is written: a chain of lower-case, upper-case, digit and mark (STEPS) that draws a symbol by its
class (LETTERS, MARKS, digits alike). Against it stands "drawn at random from the alphabet, weighted by what the battery says": a random
string's battery p is uniform, so the weight (WEIGHT + 1) * p ** WEIGHT has mean 1 and leaves a distribution. The ratio of the two chances has mean
1 under the null, hence its reciprocal, times the CHOICES of encoding, is a p (Markov). The part of the ratio that symbols alone give counts up to
10 ** RATIO, so that no length outvotes the battery: letters in an order that fails a test at 1e-6 aren't random, however rare they are.

That p is controlled over the whole corpus by the Benjamini-Hochberg rule at the rate RATE among all candidates of an encoding and length band, since
short strings can't give small p. Candidates are counted in bins of p (bounded in number), and each threshold is the largest p whose expected
false discoveries stay below the rate. Base spans always stay; added ones that overlap them are left out.

Running sums over a text's matches are made in blocks of BLOCK, so time stays in proportion to the matches.

Defined cases: null text is empty; null doc_id is kept; repeated rows are scanned one by one; texts of any length; extra columns of any name
are carried (redacted) or ignored; an empty table gives no rows; without candidates nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

# fixed values of the base patterns
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 characters or more
KINDS = ("assign", "access", "hex", "random")
CANDIDATE_CHARS = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{CANDIDATE_CHARS},}}={{0,2}}"
RATE, RATIO, WEIGHT, TOLERANCE, BANDS, BINS, BLOCK = 1e-3, 12, 2, 0.1, (20, 32, 64), 300, 100
TESTS = ("chi", "runs", "serial")
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: encoding: pattern of the whole candidate, alphabet
SHAPE = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    "base32": (r"^[A-Z2-7]+=*$", _UP + "234567"),
    "base36": (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOW),
    "base64": (r"", _UP + _LOW + _DIGITS + "+/"),
}
# fixed values: Chebyshev coefficients of ln(erfc(w) * exp(w * w) / t) in t = 1 / (1 + w / 2), from Numerical Recipes
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
# the null: from 2,262 names, paths and identifiers of Python packages (those that mix digits and letters most left out), rounded,
# with a floor for what is rare, and steps between cases raised by hand, as CamelCase names else count as random
CLASSES = "LUDS"
#: class: chances that it is followed by each of CLASSES; a candidate begins as after a mark
STEPS = {"L": (0.79, 0.025, 0.03, 0.155), "U": (0.25, 0.57, 0.06, 0.12), "D": (0.03, 0.02, 0.80, 0.15), "S": (0.66, 0.12, 0.18, 0.04)}
LETTERS = (7, 2, 7, 5, 8, 2, 2, 3, 7, 1, 1.5, 5, 4, 6.5, 7.5, 5.5, 1, 5.5, 7, 7.5, 3.5, 1, 1, 1, 3, 1)
MARKS = {"/": 0.5, "_": 0.25, "-": 0.2, "+": 0.05}
#: hex and base36 in two cases, base32, base64 with two pairs of marks; rounded up
CHOICES = 8


def _costs(chances) -> str:
    return "array(" + ", ".join(f"{-math.log2(x):.6f}D" for x in chances) + ")"


def _written(m: str) -> str:
    """SQL: -log2 of the null's chance of the string m of base64 characters."""
    marks = "".join(MARKS)
    of_char = _costs([x / sum(LETTERS) for x in LETTERS] + [0.1] * 10 + list(MARKS.values()))
    of_step = _costs([x for a in CLASSES for x in STEPS[a]])
    after = f"translate({m}, '{_LOW + _UP + _DIGITS + marks}', '{'L' * 26 + 'U' * 26 + 'D' * 10 + 'S' * len(marks)}')"
    before = f"concat('S', left({after}, char_length({m}) - 1))"
    places = lambda v, of: f"transform(filter(split({v}, ''), y -> y <> ''), y -> locate(y, '{of}') - 1)"
    total = lambda costs: f"aggregate({costs}, 0D, (a, y) -> a + y)"
    symbols = f"transform({places(f'lower({m})', _LOW + _DIGITS + marks)}, y -> get({of_char}, y))"
    steps = f"zip_with({places(before, CLASSES)}, {places(after, CLASSES)}, (y, z) -> get({of_step}, {len(CLASSES)} * y + z))"
    return f"({total(symbols)} + {total(steps)})"


def _case(values: dict[str, str]) -> str:
    return "case x.enc " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"


def _scan(items: str, start: str, step: str, emit: str, kind: str) -> str:
    """SQL: array of blocks, with `emit` for each of the items; a is the state before item x, which `step` moves on."""
    inner = f"""aggregate(slice(z, cast(i * {BLOCK} + 1 as int), {BLOCK}), named_struct('a', b.a, 'own', cast(array() as array<{kind}>)),
      (u, x) -> named_struct('a', {step.replace('a.', 'u.a.')}, 'own', concat(u.own, array({emit.replace('a.', 'u.a.')}))),
      u -> named_struct('a', u.a, 'out', concat(b.out, array(u.own))))"""
    outer = f"aggregate(sequence(0, greatest(0, size(z) - 1) div {BLOCK}), named_struct('a', {start}, 'out', cast(array() as array<array<{kind}>>)), (b, i) -> {inner}, b -> b.out)"
    return f"get(transform(array({items}), z -> {outer}), 0)"


def _places(matches: str, gaps: str) -> str:
    """SQL: array of (s, e, m) from matches and what lies between them."""
    pairs = f"filter(zip_with({gaps}, {matches}, (g, m) -> named_struct('g', char_length(g), 'n', char_length(m), 'm', m)), x -> x.m is not null)"
    emit = "named_struct('s', a.at + x.g, 'e', a.at + x.g + x.n, 'm', x.m)"
    return f"flatten({_scan(pairs, "named_struct('at', 0)", "named_struct('at', a.at + x.g + x.n)", emit, 'struct<s: int, e: int, m: string>')})"


def _found(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds array column `name` of (s, e, m) for every match of pattern in __text."""
    df = df.withColumn(f"__m_{name}", F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
    df = df.withColumn(f"__g_{name}", F.when(F.size(f"__m_{name}") > 0, F.split("__text", pattern, -1)))
    return df.withColumn(name, F.expr(f"if(size(__m_{name}) > 0, {_places(f'__m_{name}', f'__g_{name}')}, cast(array() as array<struct<s: int, e: int, m: string>>))")).drop(f"__m_{name}", f"__g_{name}")


def _ln_erfc(w: str, t: str) -> str:
    poly = f"{ERFC[-1]}D"
    for x in reversed(ERFC[:-1]):
        poly = f"({x}D + {t} * {poly})"
    return f"(ln({t}) - {w} * {w} + {poly})"


def _tested(places: str, tests: tuple[str, ...] = TESTS) -> str:
    """SQL: array of (s, e, enc, band, bin of p) for the candidates in an array of (s, e, m)."""
    alphabet = _case({k: f"'{v[1]}'" for k, v in SHAPE.items()})
    halves = _case({k: "'" + "0" * (len(v[1]) // 2) + "1" * (len(v[1]) - len(v[1]) // 2) + "'" for k, v in SHAPE.items()})
    enc = "case " + " ".join(f"when x.m rlike '{v[0]}' then '{k}'" for k, v in SHAPE.items() if v[0]) + " else 'base64' end"
    own = "'s', x.s, 'e', x.e, 'enc', x.enc, 'n', x.n, 'k', x.k, 'cost', x.cost"
    root, tail = math.sqrt(0.5), lambda z: f"'w_{z}', abs(x.z_{z}) * {math.sqrt(0.5)}D, 't_{z}', 1 / (1 + abs(x.z_{z}) * {root / 2}D)"
    half = {"chi": "if(x.z_chi >= 0, x.chi, ln(1 - exp(x.chi)))", "runs": "x.runs", "serial": "x.serial"}
    tail_sum = " + ".join(f"pow(x.h, {j}) / {math.factorial(j)}" for j in range(len(tests)))
    steps = [
        f"named_struct('s', x.s, 'e', x.e, 'enc', {enc}, 'm', rtrim('=', x.m))",
        f"""named_struct('s', x.s, 'e', x.e, 'enc', x.enc, 'n', cast(char_length(x.m) as double), 'k', cast(char_length({alphabet}) as double), 'cost', {_written('x.m')},
            'v', if(x.enc in ('hex', 'base36'), lower(x.m), if(x.enc = 'base64', translate(x.m, '-_', '+/'), x.m)), 'alphabet', {alphabet}, 'halves', {halves})""",
        f"named_struct({own}, 'v', x.v, 'symbols', transform(filter(split(x.v, ''), y -> y <> ''), y -> cast(locate(y, x.alphabet) as double)), 'bits', translate(x.v, x.alphabet, x.halves))",
        f"""named_struct({own},
            'squares', aggregate(array_distinct(filter(split(x.v, ''), y -> y <> '')), 0D, (a, y) -> a + pow(x.n - char_length(replace(x.v, y, '')), 2)),
            'runs', 1 + (x.n - char_length(replace(x.bits, '01', ''))) / 2 + (x.n - char_length(replace(x.bits, '10', ''))) / 2,
            'ones', x.n - char_length(replace(x.bits, '1', '')),
            's1', aggregate(x.symbols, 0D, (a, y) -> a + y), 's2', aggregate(x.symbols, 0D, (a, y) -> a + y * y),
            's11', aggregate(zip_with(x.symbols, concat(slice(x.symbols, 2, size(x.symbols)), slice(x.symbols, 1, 1)), (y, z) -> y * z), 0D, (a, y) -> a + y))""",
        f"""named_struct({own}, 'chi', x.k / x.n * x.squares - x.n, 'chi_mean', x.k - 1 + (x.n - 1) * {TOLERANCE}D, 'chi_var', 2 * (x.k - 1) * (x.n - 1) / x.n + 4 * (x.n - 1) * {TOLERANCE}D,
            'runs', x.runs, 'mean', 2 * x.ones * (x.n - x.ones) / x.n + 1, 'r', (x.s11 - x.s1 * x.s1 / x.n) / (x.s2 - x.s1 * x.s1 / x.n))""",
        # 2 / (9 v) of the cube root, v = 2 mean^2 / variance degrees of freedom
        f"named_struct({own}, 'cube', x.chi_var / (9 * x.chi_mean * x.chi_mean), 'root', pow(x.chi / x.chi_mean, 1 / 3), 'z_runs', coalesce((x.runs - x.mean) / sqrt((x.mean - 1) * (x.mean - 2) / (x.n - 1)), 0D), 'z_serial', coalesce((x.r + 1 / (x.n - 1)) * sqrt(x.n), 0D))",
        f"named_struct({own}, 'z_chi', (x.root - 1 + x.cube) / sqrt(x.cube), 'z_runs', x.z_runs, 'z_serial', x.z_serial)",
        f"named_struct({own}, 'z_chi', x.z_chi, {tail('chi')}, {tail('runs')}, {tail('serial')})",
        f"named_struct({own}, 'z_chi', x.z_chi, 'chi', {_ln_erfc('x.w_chi', 'x.t_chi')} + {math.log(0.5)}D, 'runs', {_ln_erfc('x.w_runs', 'x.t_runs')}, 'serial', {_ln_erfc('x.w_serial', 'x.t_serial')})",
        # Fisher: half of the statistic is the sum of -ln p, and the tail is closed
        f"named_struct({own}, 'h', {' + '.join(['0D'] + [f'greatest(0D, - {half[t]})' for t in tests])})",
        f"named_struct({own}, 'battery', {f'(ln({tail_sum}) - x.h) * {math.log10(math.e)}D' if tests else '0D'})",
        f"""named_struct('s', x.s, 'e', x.e, 'enc', x.enc, 'n', x.n, 'p', least(0D, {math.log10(CHOICES)}D + greatest(-{RATIO}D, (x.n * log2(x.k) - x.cost) * {math.log10(2)}D)
            - {math.log10(WEIGHT + 1) if tests else 0}D - {WEIGHT} * x.battery))""",
    ]
    out = f"filter({places}, x -> x.m rlike '[0-9]' and x.m rlike '[A-Za-z]')"
    for step in steps:
        out = f"transform({out}, x -> {step})"
    band = "case " + " ".join(f"when x.n >= {b} then {b}" for b in reversed(BANDS)) + f" else {BANDS[0]} end"
    return f"transform({out}, x -> named_struct('s', x.s, 'e', x.e, 'enc', x.enc, 'band', {band}, 'bin', cast(least({BINS}, floor(-10 * x.p + 1e-9)) as int)))"


def scanned(docs: DataFrame, keep: list[str], tests: tuple[str, ...] = TESTS) -> DataFrame:
    """row (the columns of docs to keep), base spans (s, k: number of the kind, e) and candidates of each row."""
    df = docs.select(F.struct(*[F.col(c.quoted(x)) for x in keep]).alias("row"), F.coalesce("text", F.lit("")).alias("__text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("candidates", CANDIDATE)):
        df = _found(df, f"__{name}", pattern)
    value = F.expr(f"filter(__assign, x -> char_length(regexp_extract(x.m, {_quoted(ASSIGN)}, 1)) >= 6)")
    df = df.withColumn("__assign", value)
    base = "concat(" + ", ".join(f"transform(__{k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(KINDS[:3])) + ")"
    return df.select("row", F.expr(f"sort_array({base})").alias("base"), F.expr(_tested("__candidates", tests)).alias("candidates"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _limit(counts: dict[int, int], rate: float, total: int) -> int | None:
    """Benjamini-Hochberg over bins: the smallest bin of p that counts as a discovery."""
    so_far, out = 0, None
    for b in sorted(counts, reverse=True):
        so_far += counts[b]
        if 10 ** (-b / 10) <= so_far * rate / total:
            out = b
    return out


def thresholds(found: DataFrame) -> dict[tuple[str, int], int]:
    """For each encoding and length band that has one, the bin from which on "written" is rejected. Only the bins' counts, bounded
    in number, come to the driver."""
    counts: dict[tuple, dict[int, int]] = {}
    for r in found.select(F.explode("candidates").alias("x")).groupBy("x.enc", "x.band", "x.bin").count().collect():
        counts.setdefault((r.enc, r.band), {})[r.bin] = r["count"]
    limits = {kind: _limit(own, RATE, sum(own.values())) for kind, own in counts.items()}
    return {kind: limit for kind, limit in limits.items() if limit is not None}


def spanned(docs: DataFrame, keep: list[str], tests: tuple[str, ...] = TESTS) -> DataFrame:
    """row, base and spans: sorted array of (s, k, e), k a number in KINDS, places in code points."""
    found = c.cut(scanned(docs, keep, tests), "op3-found")
    test = " or ".join(f"(x.enc = '{enc}' and x.band = {band} and x.bin >= {at})" for (enc, band), at in sorted(thresholds(found).items())) or "false"
    kind = "struct<s: int, k: int, e: int, free: boolean>"
    # added spans that no base span overlaps: none before that ends later than they begin, none after that begins before they end
    both = f"transform(sort_array(concat(base, transform(filter(candidates, x -> {test}), x -> named_struct('s', x.s, 'k', 3, 'e', x.e)))), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'free', true))"
    free = lambda test: f"named_struct('s', x.s, 'k', x.k, 'e', x.e, 'free', x.free and (x.k < 3 or {test}))"
    after = f"flatten({_scan(both, "named_struct('at', -1)", "named_struct('at', if(x.k < 3, greatest(a.at, x.e), a.at))", free('a.at <= x.s'), kind)})"
    before = f"flatten({_scan(f'reverse({after})', f"named_struct('at', {2**31 - 1})", "named_struct('at', if(x.k < 3, x.s, a.at))", free('a.at >= x.e'), kind)})"
    spans = f"if(size(candidates) = 0, base, transform(filter(reverse({before}), x -> x.free), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)))"
    return found.select("row", "base", F.expr(spans).alias("spans"))


def find_secrets(docs: DataFrame, tests: tuple[str, ...] = TESTS) -> DataFrame:
    """doc_id, base and spans of each row of docs(doc_id, text). tests: those of the battery that take part."""
    return spanned(docs, ["doc_id"], tests).select("row.doc_id", "base", "spans")


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat(get({names}, x.k), ':', x.s, ':', x.e)), ',')"


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs(doc_id, text and others) with each found span, or group of overlapping ones, replaced by the mark. Rows are scanned
    with all their columns, so nothing is joined."""
    kind = "struct<f: int, t: int, first: boolean>"
    # what stands before each span, and whether a mark follows; then text by text of a block, as substring counts from a text's start
    blocks = _scan("spans", "named_struct('at', 0)", "named_struct('at', greatest(a.at, x.e))", "named_struct('f', a.at, 't', greatest(a.at, x.s), 'first', x.s >= a.at)", kind)
    cuts = spanned(docs, docs.columns).withColumn("__blocks", F.expr(f"if(size(spans) = 0, null, {blocks})"))
    held = "transform(__blocks, b -> named_struct('b', filter(b, x -> x.first), 'at', get(b, 0).f, 'x', substring(row.text, get(b, 0).f + 1, element_at(b, -1).t - get(b, 0).f)))"
    pieces = f"flatten(transform({held}, y -> transform(y.b, x -> substring(y.x, x.f - y.at + 1, x.t - x.f))))"
    end = "aggregate(spans, 0, (a, x) -> greatest(a, x.e))"
    text = F.expr(f"if(__blocks is null, row.text, array_join(concat({pieces}, array(substring(row.text, {end} + 1))), '{mark}'))")
    return cuts.select(*[text.alias(x) if x == "text" else F.col(f"row.{c.quoted(x)}") for x in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(c.table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    added = F.expr("cast(size(filter(spans, x -> x.k = 3)) as long)").alias("n_random")
    return found.select("doc_id", *counts, F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("spans")).alias("spans"), added)
