"""Growing files by byte ranges: what is read, how lines are cut, rotation, the stream."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.functions import scalars as S
from auditloom.sources import logs as L
from auditloom.sources import tails as T


class Counting:
    """A file that counts the bytes that are read from it."""

    def __init__(self, path):
        self.file, self.bytes = open(path, "rb"), 0  # noqa: SIM115

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        data = self.file.read(n)
        self.bytes += len(data)
        return data


def test_of_a_large_file_only_what_is_new_is_read(spark, tmp_path):
    log, old, gained = tmp_path / "big.log", 3 << 30, b"denied a line of text\n" * 50_000
    with log.open("wb") as f:  # sparse: three gigabytes that take no room
        f.truncate(old - 1)
        f.seek(old - 1)
        f.write(b"\n" + gained + b"half a li")
    size = log.stat().st_size
    before = f"v3:{old}:{T.edge_digest(Counting(log), old)}"
    file = Counting(log)
    start, end, after = T.probe(file, size, old, before, whole=False)
    assert (start, end) == (old, old + len(gained))
    pieces = [T.gained(file, start, a, min(end, a + 300_000)) for a in range(start, end, 300_000)]
    assert b"".join(p[2] for p in pieces) == gained
    assert file.bytes < len(gained) + 4 * T.EDGE + 10 * 4096 * len(pieces)
    ledger = spark.createDataFrame([(f"file:{log}", old, before)], L.LEDGER)
    rows = T.new_chunks(L.listed(spark, str(tmp_path)), ledger, piece_bytes=300_000, whole=False).orderBy("from_offset").collect()
    assert "".join(r["chunk"] for r in rows).encode() == gained and [r["fingerprint"] for r in rows] == [None] * (len(rows) - 1) + [after]


@pytest.mark.parametrize("whole", [True, False])
def test_pieces_are_cut_at_line_ends(spark, tmp_path, whole):
    r = random.Random(4)
    texts = {f"f{i}.log": b"".join(bytes(r.choices(b"ab \xff", k=r.choice([0, 3, 40, 200]))) + b"\n" for _ in range(r.randint(0, 60))) + r.choice([b"", b"rest"]) for i in range(12)}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    rows = T.new_chunks(L.listed(spark, str(tmp_path)), spark.createDataFrame([], L.LEDGER), piece_bytes=64, whole=whole).collect()
    for name, data in texts.items():
        own = sorted((x for x in rows if x["path"].endswith(name)), key=lambda x: x["from_offset"])
        at = 0
        for x in own:
            assert x["from_offset"] == at and data[: x["to_offset"]].endswith(b"\n")
            assert x["chunk"] == data[at : x["to_offset"]].decode("utf-8", "replace")
            at = x["to_offset"]
        assert at == data.rfind(b"\n") + 1


def test_fingerprints_of_either_version_notice_rotation(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\ntwo\n")
    whole = spark.range(1).select(S.rotation_fingerprint(F.lit(b"one\ntwo\n"), F.lit(8))).first()[0]
    ends = f"v3:8:{T.edge_digest(Counting(log), 8)}"
    assert T.probe(Counting(log), 8, 0, None, whole=True) == (0, 8, whole)
    for data, start in ((b"one\ntwo\nthree\n", 8), (b"ONE\ntwo\nthree\n", 0), (b"x\n", 0)):
        log.write_bytes(data)
        for known in (whole, ends):
            for kind in (True, False):
                assert T.probe(Counting(log), len(data), 8, known, kind)[:2] == (start, len(data))
        assert T.probe(Counting(log), len(data), 8, None, whole=True)[0] == 0
    log.write_bytes(b"one\ntwo\nhalf")
    assert T.probe(Counting(log), 12, 8, ends, whole=False) is None and T.probe(Counting(log), 12, 8, whole, whole=True) is None
    with pytest.raises(OSError):
        list(T.read_range(Counting(log), 0, 99))


def test_names_of_files(tmp_path):
    for path in ("file:/tmp/a b%20c", "file:///tmp/a b%20c", "/tmp/a b%20c"):
        assert T.place(path)[1] == "/tmp/a b%20c"


def test_the_stream_gives_each_line_once(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    spark.dataSource.register(T.Tails)

    def run():
        spark.readStream.format("tails").option("piece_bytes", 16).load(str(logs)).writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").start(f"{out}/rows").awaitTermination(120)
        return "".join(r["chunk"] for r in spark.read.parquet(f"{out}/rows").where("path like '%a.log'").orderBy("from_offset").collect())

    (logs / "a.log").write_bytes(b"a first line of the file\nand a longer second one that ta")
    (logs / "_hidden").write_bytes(b"nothing\n")
    assert run() == "a first line of the file\n"
    (logs / "b.log").write_bytes(b"x\n" * 100)
    with (logs / "a.log").open("ab") as f:
        f.write(b"kes two passes\nlast\n")
    whole = "a first line of the file\nand a longer second one that takes two passes\nlast\n"
    assert run() == whole and run() == whole
    (logs / "b.log").write_bytes(b"new\n")  # shorter: another file
    run()
    rows = spark.read.parquet(f"{out}/rows")
    assert sorted(r["chunk"] for r in rows.where("path like '%b.log'").collect())[0] == "new\n"
    assert rows.where("path like '%hidden'").count() == 0
