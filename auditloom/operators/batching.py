"""Batches of suspicious lines, each at most 8192 bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BATCH_BYTES
from ..functions import scalars as S
from ..functions.redaction import redact_log_line
from .walk import walk


def chunk_numbers(lines: DataFrame, keys: list[str], order: list[str], limit: int = BATCH_BYTES) -> DataFrame:
    """``lines`` with ``chunk`` (0, 1, ...): a new one begins where a line would pass ``limit`` bytes, each line costing one more.

    The running sum starts anew with each chunk, so it follows no window frame; a key's lines are those of one bounded read.
    """

    def step(state, size):
        chunk, used = state
        if used and used + size > limit:
            chunk, used = chunk + 1, 0
        return (chunk, used + size), (chunk,)

    rows = lines.withColumn("_bytes", (F.octet_length("line") + 1).cast("long"))
    return walk(rows, keys, order, ["_bytes"], lambda: (0, 0), step, "chunk long").drop("_bytes")


def make_batches(lines: DataFrame) -> DataFrame:
    """Batches from ``(path, from_offset, to_offset, line_no, line)``: redacted, cut, packed, identified.

    Lines of one read of a file go together; the content is redacted again after packing, which changes nothing.
    """
    safe = lines.withColumn("line", S.truncate_bytes(redact_log_line("line")))
    numbered = chunk_numbers(safe, ["path", "from_offset", "to_offset"], ["line_no"])
    packed = numbered.groupBy("path", "from_offset", "to_offset", "chunk").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"), F.count(F.lit(1)).cast("int").alias("line_count"))
    content = packed.withColumn("content", F.array_join(F.col("rows.line"), "\n"))
    return content.select(
        F.lit("watcher.batch.v3").alias("schema"), S.batch_id(F.col("path"), F.col("from_offset"), F.col("to_offset"), F.col("chunk"), F.col("content")).alias("batch_id"), S.truncate_bytes("path", 512).alias("source_path"), "line_count",
        F.struct(F.col("from_offset").alias("from"), F.col("to_offset").alias("to")).alias("byte_range"), F.lit("text/redacted-lines").alias("content_schema"), "content", F.sha2("content", 256).alias("content_checksum"),
    ).withColumn("dedup_key", S.dedup_key("audit-batch", F.col("batch_id")))
