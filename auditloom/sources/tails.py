"""What growing files have gained: read by byte ranges, up to the last complete line, however large the files are.

A pass lists the files, joins their sizes with the ledger, looks at each file's fingerprint and last line end, and then
reads the ranges that are new, some megabytes in a task. ``Tails`` is the same as a streaming source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that are read in one task; bytes that are read at a time; bytes at either end that a short fingerprint covers.
PIECE_BYTES, STEP, EDGE = 8 << 20, 1 << 20, 64 << 10
#: First bytes of a file that tell the stream whether it is another one.
HEAD = 64


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it (``file:/a b``, ``hdfs://host/x``, ``s3://bucket/x`` or ``/x``), and the path there."""
    if m := re.match(r"(?:file:)?/+([^/].*)?$", path):
        return fs.LocalFileSystem(), f"/{m[1] or ''}"
    scheme, rest = path.split("://", 1)
    host, _, below = rest.partition("/")
    found, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return found, f"{root.rstrip('/')}/{below}"


def open_file(path: str) -> BinaryIO:
    found, at = place(path)
    return found.open_input_file(at)


def read_range(file: BinaryIO, start: int, end: int) -> Iterator[bytes]:
    """The bytes from ``start`` to ``end``, in steps; a file that has become shorter is an error, and the pass is done again."""
    file.seek(start)
    while start < end:
        data = file.read(min(STEP, end - start))
        if not data:
            raise OSError("the file was cut while it was read")
        start += len(data)
        yield bytes(data)


def line_end(file: BinaryIO, floor: int, end: int) -> int:
    """The place after the last line end in ``[floor, end)``; ``floor`` if there is none."""
    step = min(4096, STEP)
    while end > floor:
        start = max(floor, end - step)
        at = b"".join(read_range(file, start, end)).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end, step = start, STEP
    return floor


# --- fingerprints ---


def whole_digest(file: BinaryIO, sizes: list[int]) -> list[str]:
    """SHA-256 of the first bytes, for each of the ascending ``sizes``."""
    told, hasher, at = [], hashlib.sha256(), 0
    for size in sizes:
        for data in read_range(file, at, size):
            hasher.update(data)
        at = size
        told.append(hasher.copy().hexdigest())
    return told


def edge_digest(file: BinaryIO, size: int) -> str:
    """SHA-256 of the first and last EDGE of the first ``size`` bytes."""
    hasher = hashlib.sha256()
    for start, end in ((0, min(EDGE, size)), (max(0, size - EDGE), size)):
        for data in read_range(file, start, end):
            hasher.update(data)
    return hasher.hexdigest()


def probe(file: BinaryIO, length: int, offset: int | None, fingerprint: str | None, whole: bool) -> tuple[int, int, str] | None:
    """Where to read from and to, and the fingerprint there; None if no complete line is new.

    A file that is shorter than its offset, whose fingerprint is missing or no longer fits, has been rotated and is read
    from its beginning. Of fingerprints of version 2 (all bytes) and 3 (both ends), either is understood, and ``whole`` says which is
    made: version 2 has to read everything before the offset again.
    """
    start, known, digests = offset or 0, re.fullmatch(r"(v[23]):(\d{1,18}):([0-9a-f]+)", fingerprint or ""), {}
    size = int(known[2]) if known else 0
    if start:
        fits = bool(known) and max(start, size) <= length
        if fits and known[1] == "v3":
            fits = edge_digest(file, size) == known[3]
        elif fits:
            end = line_end(file, start, length)
            wanted = sorted({size, end}) if whole and end > start else [size]
            digests = dict(zip(wanted, whole_digest(file, wanted), strict=True))
            fits = digests[size] == known[3]
        if not fits:
            start = 0
    end = line_end(file, start, length)
    if end == start:
        return None
    if not whole:
        return start, end, f"v3:{end}:{edge_digest(file, end)}"
    return start, end, f"v2:{end}:{digests[end] if end in digests else whole_digest(file, [end])[0]}"


def gained(file: BinaryIO, floor: int, begin: int, end: int) -> tuple[int, int, bytes] | None:
    """The lines that end in the range after ``begin``: from, to and bytes. A line that began before it, though not before ``floor``, is whole."""
    to = line_end(file, begin, end)
    if to == begin:
        return None
    start = line_end(file, floor, begin)
    return start, to, b"".join(read_range(file, start, to))


# --- a pass ---


def new_chunks(files: DataFrame, ledger: DataFrame, piece_bytes: int = PIECE_BYTES, whole: bool = True, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """What ``files(path, length)`` have gained since ``ledger(path, offset, fingerprint)``, up to the last complete line.

    Gives ``path, from_offset, to_offset, chunk, fingerprint``, a row for about ``piece_bytes``, cut at line ends; a longer line is
    a row of its own. Only a file's last row has the fingerprint that the ledger keeps. Invalid bytes are
    replaced in the text, and offsets stay those of the file. A file without a new complete line gives no row.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def look(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, length, offset, fingerprint in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opener(path) as file:
                    if found := probe(file, length, offset, fingerprint, whole):
                        out.append((path, *found))
            yield _batch(out, (("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("fingerprint", pa.string())))

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, fingerprint, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin, stop = start + k * piece_bytes, min(end, start + (k + 1) * piece_bytes)
                with opener(path) as file:
                    if found := gained(file, start, begin, stop):
                        yield _batch([(path, *found, fingerprint if found[1] == end else None)], _CHUNK)

    known = files.select("path", "length").join(ledger.select("path", "offset", "fingerprint"), "path", "left").where("length > 0")
    looked = known.repartition(parts, "path").select("path", "length", "offset", "fingerprint").mapInArrow(look, "path string, start bigint, end bigint, fingerprint string")
    pieces = looked.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("end") - F.col("start") - 1) / piece_bytes))).alias("k"))
    chunks = pieces.repartition(parts, "path", "k").mapInArrow(read, "path string, from_offset bigint, to_offset bigint, data binary, fingerprint string")
    return chunks.select("path", "from_offset", "to_offset", F.make_valid_utf8(F.col("data").cast("string")).alias("chunk"), "fingerprint")


_CHUNK = (("path", pa.string()), ("from_offset", pa.int64()), ("to_offset", pa.int64()), ("data", pa.binary()), ("fingerprint", pa.string()))


def _batch(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


# --- a stream ---


class Range(InputPartition):
    """Bytes of one file that one task reads."""

    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))


class TailStream(DataSourceStreamReader):
    """Offsets are each file's size and first bytes; a range gives the lines that end in it, so one that waits for its end comes once."""

    def __init__(self, options: dict):
        self.path, self.piece = options["path"], int(options.get("piece_bytes", PIECE_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, root = place(self.path)
        scheme = "" if isinstance(system, fs.LocalFileSystem) else self.path[: len(self.path) - len(root)]
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and info.size and info.base_name[0] not in "._":  # as Spark lists files
                with system.open_input_file(info.path) as file:
                    found[scheme + info.path] = [info.size, file.read(HEAD).hex() if info.size >= HEAD else ""]
        return found

    def partitions(self, start: dict, end: dict) -> list[Range]:
        ranges = []
        for path, (size, head) in sorted(end.items()):
            before, was = start.get(path, [0, ""])
            begin = 0 if size < before or (was and was != head) else before
            ranges += [Range(path, a, min(size, a + self.piece)) for a in range(begin, size, self.piece)]
        return ranges

    def read(self, partition: Range) -> Iterator[tuple]:
        path, begin, end = partition.value
        with open_file(path) as file:
            if found := gained(file, 0, begin, end):
                start, to, data = found
                yield path, start, to, data.decode("utf-8", "replace")


class Tails(DataSource):
    """``spark.dataSource.register(Tails)``, then ``spark.readStream.format("tails").load(folder)``: chunks of complete lines as files grow.

    A file that gets shorter or begins with other bytes starts over. The listing and each file's first bytes are read on the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "tails"

    def schema(self) -> str:
        return "path string, from_offset bigint, to_offset bigint, chunk string"

    def streamReader(self, schema) -> TailStream:  # noqa: ARG002, N802
        return TailStream(self.options)

