"""Sources of log text: growing files with a ledger, dead letters, runtime logs, watch events."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import DEAD_LETTER
from .tails import new_chunks  # noqa: F401

LEDGER = "path string, offset bigint, fingerprint string"


def read_files(spark: SparkSession, path: str | list[str], modified_after: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(path, length, modificationTime, content)`` of whole files; both options prune before anything is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def newest_files(spark: SparkSession, path: str, newest: int) -> DataFrame:
    """``read_files`` of the ``newest`` files below ``path``: all are listed, and only these are read."""
    listed = read_files(spark, path).select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path").limit(newest)
    found = [r["path"] for r in listed.collect()]  # newest rows at most
    return read_files(spark, found) if found else read_files(spark, path).limit(0)


def listed(spark: SparkSession, path: str | list[str], modified_after: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(path, length)`` of files; none is read."""
    return read_files(spark, path, modified_after, pattern).select("path", "length")


def lossy_text(content):
    """Text of bytes, invalid ones replaced; offsets stay those of the original bytes."""
    return F.make_valid_utf8(F.col(content).cast("string") if isinstance(content, str) else content.cast("string"))


def next_ledger(ledger: DataFrame, chunks: DataFrame) -> DataFrame:
    """The ledger after ``chunks`` have been taken over."""
    moved = chunks.groupBy("path").agg(F.max("to_offset").alias("offset"), F.max_by("fingerprint", "to_offset").alias("fingerprint"))
    return ledger.join(moved.select("path"), "path", "left_anti").select("path", "offset", "fingerprint").unionByName(moved)


def split_lines(chunks: DataFrame) -> DataFrame:
    """``(path, from_offset, to_offset, line_no, line)``; one trailing carriage return goes."""
    lines = chunks.select("path", "from_offset", "to_offset", F.posexplode(F.split(F.regexp_replace("chunk", r"\n$", ""), "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.regexp_replace("line", r"\r$", ""))


def parse_dead_letters(lines: DataFrame) -> DataFrame:
    """Dead letters of ``lines(line)``: the literal tag and a time, queue and class, or the line is dropped."""
    line = F.col("line")
    pick = lambda name: F.nullif(F.regexp_extract(line, rf"(?:^|\s){name}=(\S+)", 1), F.lit(""))
    found = lines.where(line.contains("tag=DEAD_LETTER")).select(S.epoch_of(pick("TIMESTAMP")).alias("epoch"), pick("QUEUE").alias("queue"), pick("ERROR_CLASS").alias("error_class"), line.alias("line"))
    return found.where("epoch is not null and queue is not null and error_class is not null")


def read_dead_letters(spark: SparkSession, path: str | None) -> tuple[DataFrame, bool]:
    """Dead letters below ``path``, and whether the source is degraded: missing or unreadable, which isn't the same as empty."""
    try:
        if path is None:
            raise ValueError("no path")
        return parse_dead_letters(spark.read.option("recursiveFileLookup", "true").text(path).withColumnRenamed("value", "line")), False
    except (AnalysisException, Py4JJavaError, ValueError):  # missing, or the listing was refused
        return spark.createDataFrame([], DEAD_LETTER), True


SERVICES = ("watcher", "analyzer", "alerts", "sentinel", "issues")


def runtime_logs(files: DataFrame, newest: int = 120, tail: int = 64_000, services: tuple = SERVICES) -> DataFrame:
    """The newest files' last bytes: ``(file, service, epoch, mtime, text)``; the epoch is in the name, the service begins it."""
    file = F.element_at(F.split("path", "/"), -1)
    known = F.regexp_extract(file, rf"^({'|'.join(services)})\.", 1)
    named = files.select(file.alias("file"), F.nullif(known, F.lit("")).alias("service"), F.try_to_number(F.nullif(F.regexp_extract(file, r"(\d{10})", 1), F.lit("")), F.lit("9999999999")).cast("bigint").alias("epoch"), F.col("modificationTime").alias("mtime"), "content")
    last = named.where("service is not null").orderBy(F.desc("mtime"), "file").limit(newest)
    return last.select("file", "service", F.coalesce("epoch", F.unix_seconds("mtime")).alias("epoch"), "mtime", lossy_text(F.expr(f"substring(content, greatest(1, length(content) - {tail - 1}), {tail})")).alias("text"))


def watch_events(files: DataFrame, newest: int = 20, tail: int = 48_000, lines: int = 200) -> DataFrame:
    """Events of watched files: the last lines of the newest files, with what can be told of each.

    ``(file, line_no, timestamp, actor, ip, command, action, outcome, suspicious, line)``.
    """
    last = files.orderBy(F.desc("modificationTime"), "path").limit(newest)
    rows = last.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(F.split(lossy_text(F.expr(f"substring(content, greatest(1, length(content) - {tail - 1}), {tail})")), r"\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")
    rows = rows.withColumn("_back", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("line_no")))).where(F.col("_back") <= lines).drop("_back")
    return rows.select("*", *watch_columns(F.col("line")))


def watch_columns(line):
    pick = lambda p, g=1: F.nullif(F.regexp_extract(line, p, g), F.lit(""))
    stamp = F.coalesce(pick(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\S*)"), pick(r"^([A-Z][a-z]{2}\s+\d+\s\d\d:\d\d:\d\d)"))
    actor = F.coalesce(pick(r"(?:user|actor)=(\S+)"), pick(r"\bfor (?:invalid user )?(\S+) from"), pick(r"sudo:\s+(\S+)\s:"))
    action = F.coalesce(pick(r"action=(\S+)"), F.when(line.contains("sudo"), "sudo"), F.when(line.contains("sshd"), "ssh"), F.lit("log"))
    bad = line.rlike("(?i)fail|denied|not allowed|invalid|refused|unauthorized")
    return [
        stamp.alias("timestamp"), actor.alias("actor"), pick(r"(\d{1,3}(?:\.\d{1,3}){3})").alias("ip"), pick(r"COMMAND=(.*)$").alias("command"), action.alias("action"),
        F.coalesce(pick(r"outcome=(\S+)"), F.when(bad, "failure").otherwise("success")).alias("outcome"), line.rlike(SHOWN_SUSPICIOUS).alias("suspicious"),
    ]


#: The words of the report's own test, another list than the gate's.
SHOWN_SUSPICIOUS = "(?i)(failed password|not in sudoers|denied|forbidden|unauthorized|critical|suspicious|brute|shadow|token|secret)"
