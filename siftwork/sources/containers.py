"""Capture times and embedded previews from the bytes of JPEG, DNG and RAF files; no codec takes part.

A TIFF structure is walked with both byte orders: chains of directories, sub-directories and the EXIF directory. Offsets that lead out of the file
or in circles end that branch, so damaged and cut-off files give what can still be read, or nothing; a file never stops a job.

Fixed values below are tag numbers and signatures of the public TIFF, EXIF, JPEG and RAF formats.

Defined cases: null or empty content, another format, or a file without the field give null; the first directory that holds a field wins; a
preview that isn't a JPEG is a failure; of several previews the one of most pixels is taken, the first among equals.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import capture_seconds

# fixed values
WIDTH, HEIGHT, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, STRIP_BYTES, DATE_TIME = 256, 257, 259, 262, 273, 279, 306
SUB_DIRECTORIES, JPEG_OFFSET, JPEG_BYTES, EXIF_DIRECTORY, ORIGINAL_TIME = 330, 513, 514, 34665, 36867
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 7: 1, 13: 4}  # bytes of a value by type
SENSOR = (32803, 34892)  # photometric interpretations of raw data
RAF, RAF_PREVIEW, EXIF, JPEG = b"FUJIFILMCCD-RAW ", 84, b"Exif\0\0", b"\xff\xd8"
STANDALONE = {0x01, *range(0xD0, 0xD9)}  # JPEG markers without a length
START_OF_SCAN, APP1 = 0xDA, 0xE1


class Tiff:
    """Directories of a TIFF structure that begins at `base` of the data."""

    def __init__(self, data: bytes, base: int = 0):
        self.data, self.base = data, base
        mark = bytes(data[base : base + 2])
        self.order = {b"II": "<", b"MM": ">"}.get(mark, "")
        self.ok = bool(self.order) and self._number(2, 2) == 42

    def _number(self, at: int, size: int) -> int | None:
        raw = bytes(self.data[self.base + at : self.base + at + size])
        return struct.unpack(self.order + {1: "B", 2: "H", 4: "I"}[size], raw)[0] if len(raw) == size else None

    def _directory(self, at: int) -> tuple[dict[int, tuple[int, int, int]], int]:
        """tag: (type, count, place of the values), and the next directory's place."""
        n, out = self._number(at, 2) or 0, {}
        for i in range(n):
            entry = at + 2 + 12 * i
            tag, kind, count = self._number(entry, 2), self._number(entry + 2, 2), self._number(entry + 4, 4)
            if count is None:
                return out, 0  # cut off
            size = SIZES.get(kind, 0) * count
            place = entry + 8 if size <= 4 else self._number(entry + 8, 4)
            if size and place is not None:
                out.setdefault(tag, (kind, count, place))
        return out, self._number(at + 2 + 12 * n, 4) or 0

    def numbers(self, entry: tuple[int, int, int] | None) -> list[int]:
        if entry is None or entry[0] == 2:
            return []
        size = SIZES[entry[0]]
        count = min(entry[1], max(0, len(self.data) - self.base - entry[2]) // size)
        return [x for x in (self._number(entry[2] + size * i, size) for i in range(count)) if x is not None]

    def text(self, entry: tuple[int, int, int] | None) -> str | None:
        if entry is None or entry[0] != 2:
            return None
        raw = bytes(self.data[self.base + entry[2] : self.base + entry[2] + entry[1]])
        return raw.split(b"\0")[0].decode("latin-1").strip() if len(raw) == entry[1] else None

    def directories(self) -> Iterator[dict[int, tuple[int, int, int]]]:
        """Every directory once, each before those it leads to."""
        seen: set[int] = set()
        todo = [self._number(4, 4) or 0] if self.ok else []
        while todo:
            at = todo.pop(0)
            if at < 8 or at in seen:
                continue
            seen.add(at)
            held, following = self._directory(at)
            yield held
            todo += [*self.numbers(held.get(EXIF_DIRECTORY)), *self.numbers(held.get(SUB_DIRECTORIES)), following]


def exif_of(data: bytes) -> Tiff | None:
    """The EXIF structure of a JPEG, in whichever APP1 segment it stands."""
    at = 2
    while bytes(data[:2]) == JPEG and at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
        elif marker in STANDALONE:
            at += 2
        elif marker == START_OF_SCAN:
            return None
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == APP1 and bytes(data[at + 4 : at + 10]) == EXIF:
                return Tiff(data[: at + 2 + size], at + 10)
            at += 2 + max(2, size)
    return None


def capture_text(data: bytes | None) -> str | None:
    """DateTimeOriginal of a JPEG; of a raw file that too, or else its DateTime. RAF files hold it in their preview."""
    if not data:
        return None
    view = memoryview(data)
    is_raw = bytes(view[:2]) != JPEG
    if bytes(view[:16]) == RAF:
        view = memoryview(embedded_preview(data) or b"")
    found = exif_of(view) if bytes(view[:2]) == JPEG else Tiff(view)
    if found is None or not found.ok:
        return None
    held = list(found.directories())
    for tag in (ORIGINAL_TIME, DATE_TIME) if is_raw else (ORIGINAL_TIME,):
        text = next((t for t in (found.text(d.get(tag)) for d in held) if t), None)
        if text:
            return text
    return None


def embedded_preview(data: bytes | None) -> bytes | None:
    """The JPEG that a DNG or RAF file carries."""
    if not data:
        return None
    view = memoryview(data)
    if bytes(view[:16]) == RAF:
        at, size = (int.from_bytes(view[RAF_PREVIEW + k : RAF_PREVIEW + k + 4], "big") for k in (0, 4))
        return _jpeg(view, at, size)
    found, best = Tiff(view), None
    for held in found.directories() if found.ok else ():
        first = lambda tag, default=0: next(iter(found.numbers(held.get(tag))), default)  # noqa: E731, B023
        if first(PHOTOMETRIC) in SENSOR:
            continue
        whole = len(found.numbers(held.get(STRIP_OFFSETS))) == 1
        at, size = (first(STRIP_OFFSETS), first(STRIP_BYTES)) if whole else (first(JPEG_OFFSET), first(JPEG_BYTES))
        made = _jpeg(view, at, size)
        pixels = first(WIDTH) * first(HEIGHT)
        if made and (best is None or pixels > best[0]):
            best = pixels, made
    return best[1] if best else None


def _jpeg(view: memoryview, at: int, size: int) -> bytes | None:
    whole = bytes(view[at : at + size])
    return whole if at and size > 2 and len(whole) == size and whole[:2] == JPEG else None


def _mapped(files: DataFrame, keep: list[str], content: str, name: str, kind: pa.DataType, ddl: str, read) -> DataFrame:
    source = files.select(*keep, content)

    def run(batches):
        for batch in batches:
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            made = [read(x.as_buffer() if x.is_valid else None) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(made, kind)], names=[*batch.schema.names[:-1], name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(run, ", ".join([*fields, f"{name} {ddl}"]))


def capture_times(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """The columns to keep and captured_at (epoch seconds in the session's zone), of files with their bytes, as the binaryFile source has them. The
    session's spark.sql.execution.arrow.maxBytesPerBatch bounds what a worker holds."""
    out = _mapped(files, keep, content, "captured_text", pa.string(), "string", lambda b: capture_text(b.to_pybytes() if b is not None else None))
    return out.select(*keep, "captured_text", capture_seconds(F.col("captured_text")).alias("captured_at"))


def previews(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """The columns to keep and preview: the embedded JPEG, null where it fails."""
    return _mapped(files, keep, content, "preview", pa.binary(), "binary", lambda b: embedded_preview(b.to_pybytes() if b is not None else None))
