"""TIFF, JPEG, DNG and RAF bytes, built here field by field."""

import random
import struct

import pytest

from siftwork.sources import containers as k

TIME = b"2023:05:06 07:08:09\0"


def tiff(order, directories, tail=b"", base=8):
    """directories: lists of (tag, type, count, value bytes or ('dir', n) or ('tail', offset, size)); each follows the one before."""
    e = order
    sizes = [2 + 12 * len(d) + 4 for d in directories]
    starts = [base + sum(sizes[:i]) for i in range(len(sizes))]
    extra_at = base + sum(sizes)
    body, extra = b"", b""
    tail_at = extra_at + sum(len(v) for d in directories for _, _, _, v in d if isinstance(v, bytes) and len(v) > 4)
    for d in directories:
        body += struct.pack(e + "H", len(d))
        for tag, kind, count, v in d:
            if isinstance(v, tuple):
                value = struct.pack(e + "I", starts[v[1]] if v[0] == "dir" else tail_at + v[1])
            elif len(v) > 4:
                value, extra = struct.pack(e + "I", extra_at + len(extra)), extra + v
            else:
                value = v.ljust(4, b"\0")
            body += struct.pack(e + "HHI", tag, kind, count) + value
        body += struct.pack(e + "I", 0)
    return (b"II" if order == "<" else b"MM") + struct.pack(e + "HI", 42, base) + body + extra + tail


def long_(order, x):
    return struct.pack(order + "I", x)


def exif(order, time=TIME):
    return tiff(order, [[(k.EXIF_DIRECTORY, 4, 1, ("dir", 1))], [(k.ORIGINAL_TIME, 2, len(time), time)]])


def jpeg(*segments, rest=b"\xff\xda\0\x02data\xff\xd9"):
    return k.JPEG + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b for m, b in segments) + rest


APP0, COMMENT = (0xE0, b"JFIF\0" + b"x" * 9), (0xFE, b"no \xff\xe1 here")


@pytest.mark.parametrize("order", "<>")
def test_time_of_a_jpeg_wherever_its_segment_stands(order):
    app1 = (0xE1, k.EXIF + exif(order))
    other = (0xE1, b"http://ns.adobe.com/xap/1.0/\0<x/>")
    for segments in ([app1], [APP0, app1], [APP0, COMMENT, other, app1], [app1, APP0]):
        assert k.capture_text(jpeg(*segments)) == "2023:05:06 07:08:09"
    assert k.capture_text(jpeg(APP0, rest=b"\xff\xff\xff\xe1" + struct.pack(">H", len(app1[1]) + 2) + app1[1])) == "2023:05:06 07:08:09"  # fill bytes
    for segments in ([APP0], [other], [(0xE1, k.EXIF + b"XX")]):
        assert k.capture_text(jpeg(*segments)) is None
    late = jpeg(APP0) + b"\xff\xe1" + struct.pack(">H", len(app1[1]) + 2) + app1[1]
    assert k.capture_text(late) is None  # behind the scan's start
    only_changed = tiff(order, [[(k.DATE_TIME, 2, 20, TIME)]])
    assert k.capture_text(jpeg((0xE1, k.EXIF + only_changed))) is None and k.capture_text(only_changed) == "2023:05:06 07:08:09"


def dng(order, previews):
    """One directory for each (width, height, bytes, photometric), as sub-directories of the first."""
    tail, rows = b"", []
    for w, h, b, p in previews:
        rows.append([(k.WIDTH, 4, 1, long_(order, w)), (k.HEIGHT, 4, 1, long_(order, h)), (k.PHOTOMETRIC, 4, 1, long_(order, p)), (k.STRIP_OFFSETS, 4, 1, ("tail", len(tail), 0)), (k.STRIP_BYTES, 4, 1, long_(order, len(b)))])
        tail += b
    head = [(k.DATE_TIME, 2, 20, b"2001:01:01 00:00:00\0"), (k.EXIF_DIRECTORY, 4, 1, ("dir", len(rows) + 1))]
    chain = [row + ([(k.SUB_DIRECTORIES, 4, 1, ("dir", i + 2))] if i + 1 < len(rows) else []) for i, row in enumerate(rows)]
    return tiff(order, [[*head, (k.SUB_DIRECTORIES, 4, 1, ("dir", 1))], *chain, [(k.ORIGINAL_TIME, 2, 20, TIME)]], tail)


@pytest.mark.parametrize("order", "<>")
def test_previews(order):
    small, large, raw = jpeg(APP0), jpeg(APP0, COMMENT), b"\xff\xd8" + b"r" * 500
    data = dng(order, [(160, 120, small, 6), (9000, 6000, raw, 32803), (1600, 1200, large, 6), (5000, 5000, b"BM" + b"x" * 90, 2)])
    assert k.embedded_preview(data) == large and k.capture_text(data) == "2023:05:06 07:08:09"
    assert k.embedded_preview(dng(order, [(10, 10, b"BMxxxx", 2)])) is None  # not a JPEG
    assert k.embedded_preview(data[:-200]) in (None, small, large)
    inner = jpeg((0xE1, k.EXIF + exif(order)))
    raf = k.RAF + b"0" * (k.RAF_PREVIEW - 16) + struct.pack(">II", 160, len(inner)) + b"\0" * (160 - k.RAF_PREVIEW - 8) + inner + b"sensor"
    assert k.embedded_preview(raf) == inner and k.capture_text(raf) == "2023:05:06 07:08:09"
    assert k.embedded_preview(raf[:170]) is None and k.capture_text(raf[:170]) is None


def test_circles_and_damage():
    circle = tiff("<", [[(k.SUB_DIRECTORIES, 4, 1, ("dir", 1)), (k.EXIF_DIRECTORY, 4, 1, ("dir", 0))], [(k.EXIF_DIRECTORY, 4, 1, ("dir", 0)), (k.SUB_DIRECTORIES, 4, 1, ("dir", 1))]])
    assert k.capture_text(circle) is None and k.embedded_preview(circle) is None
    rng = random.Random(1)
    whole = [jpeg(APP0, (0xE1, k.EXIF + exif(">"))), dng("<", [(9, 9, jpeg(APP0), 6)]), circle]
    for _ in range(1500):
        b = bytearray(rng.choice(whole))
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b))] = rng.choice([0, 255, rng.randrange(256)])
        b = bytes(b[: rng.randrange(len(b) + 1)])
        k.capture_text(b)
        k.embedded_preview(b)
    huge = struct.pack("<2sHIHHHII", b"II", 42, 8, 1, k.SUB_DIRECTORIES, 4, 0xFFFFFFF, 8)
    assert k.capture_text(huge) is None


def test_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg((0xE1, k.EXIF + exif("<"))))
    (tmp_path / "b.dng").write_bytes(dng(">", [(9, 9, jpeg(APP0), 6)]))
    (tmp_path / "c.jpg").write_bytes(b"\xff")
    (tmp_path / "d.jpg").write_bytes(jpeg((0xE1, k.EXIF + exif("<", b"2023-05-06\0"))))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path[-5:]: r.captured_at for r in k.capture_times(files, ["path", "length"]).collect()}
    assert got == {"a.jpg": 1683356889, "b.dng": 1683356889, "c.jpg": None, "d.jpg": None}
    assert {r.path[-5:]: r.preview and bytes(r.preview) for r in k.previews(files, ["path"]).collect()} == {"a.jpg": None, "b.dng": jpeg(APP0), "c.jpg": None, "d.jpg": None}
    none = spark.createDataFrame([("x", None), ("y", bytearray())], "path string, content binary")
    assert [tuple(r) for r in k.capture_times(none, ["path"]).orderBy("path").collect()] == [("x", None, None), ("y", None, None)]
    assert k.previews(none.limit(0), ["path"]).count() == 0
