import gzip
import hashlib
import random
import time
import zlib

import duckdb

from siftwork.llm import common, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


BIG = "<p>" + "é" * 900
ROWS = [(1, "http://a/", BIG), (2, None, BIG), (3, "http://c/\r\nX: y", "short"), (4, "http://d/", "short"), (5, "u", None), (6, "u", ""), (7, "é", BIG), (None, "n", BIG), (7, "é", BIG), (8, "w", "WARC/1.1\r\n\r\n" * 200)]


def test_oracle(spark, sf):
    duckdb.sql(f"create or replace view pages as select * from '{sf}/pages.parquet'")
    assert sorted(tuple(r) for r in warc.query(spark, sf).collect()) == sorted(duckdb.sql(warc.ORACLE).fetchall())


def test_hostile_pages(spark, tmp_path):
    df = pages(spark, ROWS).selectExpr("*", "'clash' digest", "'clash' payload")
    manifest = warc.write_archives(df, f"file://{tmp_path}/w", archive_bytes=300)
    read = warc.read_archives(manifest)
    assert read.filter("status = 'gap'").count() == 0
    got = sorted(map(tuple, warc.digests(read).collect()), key=str)
    want = []
    for i, _, h in ROWS:
        b = (h or "").encode()
        revisit = h == BIG and i in (1, 2)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert got == sorted(want, key=str)
    empty = warc.write_archives(df.limit(0), f"file://{tmp_path}/e")
    assert warc.digests(warc.read_archives(empty)).count() == 0


def archive(n, packed, seed=0):
    rng = random.Random(seed)
    raws = []
    for i in range(n):
        p = "".join(rng.choice("abc <>\r\n") for _ in range(rng.randrange(2000))).encode()
        raws.append(warc.record("response", i, f"http://x/{i}", p, hashlib.sha1(p).digest(), len(p), None))
    return [gzip.compress(r) if packed else r for r in raws]


def salvage(tmp_path, data):
    path = tmp_path / "a.warc"
    path.write_bytes(data)
    with open(path, "rb") as f:
        items = list(warc.Salvager(f, len(data)).items())
    ids = [warc.page_of(x[4]["WARC-Record-ID"]) for x in items if x[0] == "record"]
    return ids, [(x[1], x[2]) for x in items if x[0] == "gap"]


def test_salvage_after_damage(tmp_path):
    for packed in (True, False):
        parts = archive(12, packed)
        at = [sum(map(len, parts[:i])) for i in range(13)]
        data = b"".join(parts)
        assert salvage(tmp_path, data) == (list(range(12)), [])
        hurt = bytearray(data)
        mid = at[4] + len(parts[4]) * 2 // 3
        hurt[mid : mid + 3] = b"\xff\x00\xff"
        ids, gaps = salvage(tmp_path, bytes(hurt))
        assert ids == [i for i in range(12) if i != 4] and gaps == [(at[4], at[5])]
        ids, gaps = salvage(tmp_path, data[:-7])  # cut off
        assert ids == list(range(11)) and gaps == [(at[11], len(data) - 7)]
        ids, gaps = salvage(tmp_path, b"junk\r\n" + data)
        assert ids == list(range(12)) and gaps == [(0, 6)]
        junk = b"\x1f\x8b\x08 no member WARC/1. nor this"
        ids, gaps = salvage(tmp_path, data[: at[3]] + junk + data[at[3] :])
        assert ids == list(range(12)) and gaps == [(at[3], at[3] + len(junk))]
        lost = data[: at[5] + 40] + data[at[6] + 40 :]  # a hole over a boundary
        ids, gaps = salvage(tmp_path, lost)
        assert [i for i in ids if i not in (5, 6)] == [0, 1, 2, 3, 4, *range(7, 12)] and (gaps or not packed)


def test_wrong_length_and_digest(tmp_path):
    parts = archive(5, False)
    at = [sum(map(len, parts[:i])) for i in range(6)]
    longer = parts[2].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    ids, gaps = salvage(tmp_path, b"".join([*parts[:2], longer, *parts[3:]]))
    assert ids == [0, 1, 3, 4] and gaps == [(at[2], at[2] + len(longer))]
    changed = parts[2].replace(b"sha1:", b"sha1:A", 1)
    ids, gaps = salvage(tmp_path, b"".join([*parts[:2], changed, *parts[3:]]))
    assert ids == [0, 1, 3, 4] and len(gaps) == 1


def test_one_member_for_all(tmp_path):
    parts = archive(6, False)
    assert salvage(tmp_path, gzip.compress(b"".join(parts))) == (list(range(6)), [])
    assert salvage(tmp_path, b"") == ([], [])


def test_long_payload_that_quotes_records(tmp_path):
    rng = random.Random(4)
    quoted = archive(1, False, seed=5)[0]
    page = b"".join(rng.randbytes(50_000) + b"\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n" + quoted for _ in range(8))
    big = warc.record("response", 77, "http://q/", page, hashlib.sha1(page).digest(), len(page), None)
    small = archive(3, False)
    wrong = big.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    for pack in (gzip.compress, bytes):
        data = b"".join(map(pack, [small[0], big, *small[1:]]))
        assert salvage(tmp_path, data) == ([0, 77, 1, 2], [])
    assert salvage(tmp_path, gzip.compress(b"".join([small[0], big, *small[1:]]))) == ([0, 77, 1, 2], [])
    ids, gaps = salvage(tmp_path, gzip.compress(small[0]) + gzip.compress(wrong) + gzip.compress(small[1]))
    assert ids == [0, 1] and gaps == [(len(gzip.compress(small[0])), len(gzip.compress(small[0]) + gzip.compress(wrong)))]


def test_damage_in_a_member_of_many(tmp_path):
    parts = archive(6, False)
    at = [sum(map(len, parts[:i])) for i in range(7)]
    other = gzip.compress(archive(1, False)[0].replace(b"page:0", b"page:9"))
    for bad in (0, 2, 5):
        for name in (b"sha1:", b"Content-Length: "):  # a wrong digest, a wrong length
            hurt = [*parts[:bad], parts[bad].replace(name, name + b"9", 1), *parts[bad + 1 :]]
            ids, gaps = salvage(tmp_path, gzip.compress(b"".join(hurt)) + other)
            assert ids == [*(i for i in range(6) if i != bad), 9] and gaps == [(0, None)]
            with open(tmp_path / "a.warc", "rb") as f:
                (gap,) = [x for x in warc.Salvager(f, (tmp_path / "a.warc").stat().st_size).items() if x[0] == "gap"]
            assert gap[3].endswith(f"bytes {at[bad]} to {at[bad + 1] + 1} of the member")
    whole = gzip.compress(b"".join(parts))
    for end in (len(whole) - 7, len(whole) - 8):  # without a good checksum, but with all records
        assert salvage(tmp_path, whole[:end] + other) == ([*range(6), 9], [(0, end)])
    stored = gzip.compress(b"".join(parts), compresslevel=0)
    cut = stored[: 15 + at[3] + 50]
    assert salvage(tmp_path, cut) == ([0, 1, 2], [(0, len(cut))])
    data = bytearray(zlib.compress(b"", wbits=31)[:10])
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    data += z.compress(b"".join(parts[:3])) + z.flush(zlib.Z_FULL_FLUSH) + b"\xff" * 50  # bytes that can't be decompressed
    assert salvage(tmp_path, bytes(data) + other) == ([0, 1, 2, 9], [(0, len(data))])


def test_long_urls_headers_and_quoted_records_survive_the_query(spark, tmp_path):
    rows = [(1, "http://u/" + "x" * 150_000, "<p>one"), (2, "http://v/", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" * 8000), (3, "w" * 70_000, None)]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    duckdb.sql(f"create or replace view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in warc.query(spark, str(tmp_path)).collect())
    assert got == sorted(duckdb.sql(warc.ORACLE).fetchall()) and len(got) == 3
    raw = warc.record("response", 5, "x" * 150_000, b"body", hashlib.sha1(b"body").digest(), 4, None)
    assert salvage(tmp_path, raw + raw) == ([5, 5], [])


def seconds(f):
    start = time.perf_counter()
    f()
    return time.perf_counter() - start


def test_time_is_linear(tmp_path):
    rng = random.Random(1)

    def damaged(n):
        parts = [bytearray(gzip.compress(x)) for x in archive(n, False)]
        for p in parts[::2]:
            p[len(p) // 2 : len(p) // 2 + 3] = b"\xff\x00\xff"
        return b"".join(parts)

    few, many = damaged(250), damaged(2000)
    a, b = (min(seconds(lambda d=d: salvage(tmp_path, d)) for _ in range(2)) for d in (few, many))
    assert b < 8 * 3 * a + 0.1, (a, b)
    page = rng.randbytes(64 << 20)
    for pack in (bytes, lambda x: gzip.compress(x, 1)):
        big = pack(warc.record("response", 1, "u", page, hashlib.sha1(page).digest(), len(page), None))
        assert seconds(lambda: salvage(tmp_path, big)) < 20
        assert salvage(tmp_path, big) == ([1], [])


def test_foreign_ids_and_tasks_by_archive_bytes(spark):
    assert [warc.page_of(x) for x in (warc.urn(5), warc.urn(None), None, "<urn:uuid:7c1d>", "<urn:page:x>", "<urn:page:99999999999999999999>")] == [5] + [None] * 5
    manifest = spark.createDataFrame([(f"p{i}", 8 << 30, 9) for i in range(100)], "path string, bytes long, records long")
    assert warc.archive_parts(manifest) == 100 * (8 << 30) // warc.READ_BYTES
