"""Sources of audit records and issues: landed pages, snapshots, tolerant JSON lines, salvage of cut JSON, issue lists."""

from __future__ import annotations

import json
import re
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import AUDIT_FIELDS
from .logs import lossy_text, read_files

_RECORD = ", ".join(f"{f}: string, {f[0].upper() + f[1:]}: string" for f in AUDIT_FIELDS)
_RECORDS = f"array<struct<{_RECORD}>>"
_CONTROL = "nextCursor: string, NextCursor: string, queryWatermark: string, QueryWatermark: string"
PAGE = f"struct<records: {_RECORDS}, Records: {_RECORDS}, items: {_RECORDS}, data: struct<records: {_RECORDS}, Records: {_RECORDS}, {_CONTROL}>, {_CONTROL}>"


@contextmanager
def _case_sensitive(spark: SparkSession):
    """camelCase and PascalCase twins are different fields while a plan over pages is made."""
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Landed pages ``(source_id, window_id, page_no, body)`` with ``page_records``, ``next_cursor`` and ``watermark``.

    Records come from the first of records, Records, data.records, data.Records and items that is there. Control fields:
    camelCase, then PascalCase, then nested; an empty one is null. ``whole`` says whether the body is a JSON object: a page
    that isn't has failed.
    """
    with _case_sensitive(pages.sparkSession):
        page = pages.withColumn("_page", F.from_json("body", PAGE))
        pick = lambda *names: F.coalesce(*(F.nullif(F.trim(f"_page.{n}"), F.lit("")) for n in names))
        whole = F.coalesce(F.try_parse_json("body").isNotNull() & F.ltrim("body").startswith("{"), F.lit(False)).alias("whole")
        return page.select(
            *pages.columns, whole, F.coalesce(*(F.col(f"_page.{n}") for n in ("records", "Records", "data.records", "data.Records", "items")), F.array().cast(_RECORDS)).alias("page_records"),
            pick("nextCursor", "NextCursor", "data.nextCursor", "data.NextCursor").alias("next_cursor"),
            pick("queryWatermark", "QueryWatermark", "data.queryWatermark", "data.QueryWatermark").alias("watermark"),
        )


def page_records(parsed: DataFrame) -> DataFrame:
    """One row a record, with its place: the fifteen fields as strings."""
    with _case_sensitive(parsed.sparkSession):
        rows = parsed.select("source_id", "window_id", "page_no", F.posexplode("page_records").alias("pos", "r"))
        value = lambda f: F.coalesce(F.col(f"r.{f}"), F.col(f"r.{f[0].upper() + f[1:]}"), F.lit("")).alias(f)
        nested = lambda c: F.when(c.rlike(r"^\s*[\[{]"), "").otherwise(c)
        flat = rows.select("source_id", "window_id", "page_no", "pos", *(value(f) for f in AUDIT_FIELDS))
        return flat.select("source_id", "window_id", "page_no", "pos", *(nested(F.col(f)).alias(f) for f in AUDIT_FIELDS))


def window_checkpoints(parsed: DataFrame) -> DataFrame:
    """``(source_id, window_id, pages, records, exhausted, watermark)`` for each fixed window of pages.

    A window is exhausted once its last page, one without a next cursor, is there, and only then does its watermark count:
    the first one reported in the window. A page that has failed blocks its window, and adds nothing.
    """
    first = F.min_by(F.col("watermark"), F.when(F.col("watermark").isNotNull(), F.col("page_no")))
    last = F.bool_or(F.col("whole") & F.col("next_cursor").isNull()) & F.bool_and("whole")
    groups = parsed.groupBy("source_id", "window_id").agg(F.count_if("whole").alias("pages"), F.sum(F.size("page_records")).alias("records"), last.alias("exhausted"), first.alias("watermark"))
    return groups.withColumn("watermark", F.when(F.col("exhausted"), F.col("watermark")))


def pages_within_budget(parsed: DataFrame, records: int = 1000, pages: int = 12) -> DataFrame:
    """Whole pages of each window until the budget is met: a page starts only while fewer records have been taken, and none after a failed one."""
    before = Window.partitionBy("source_id", "window_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.size("page_records")
    kept = parsed.withColumn("_taken", F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn("_pages", F.count(F.lit(1)).over(before)).withColumn("_failed", F.coalesce(F.bool_or(~F.col("whole")).over(before), F.lit(False)))
    return kept.where(F.col("whole") & ~F.col("_failed") & (F.col("_taken") < records) & (F.col("_pages") < pages)).drop("_taken", "_pages", "_failed")


def strict_snapshot(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and status of whole snapshot files ``files(file, content)``: ``(file, lines, error, valid)`` for each.

    An unterminated last line, an empty line or one that isn't a JSON object rejects its whole file, with the reason and
    number of the first such line; an empty file is valid and has no records.
    """
    text = lossy_text("content")
    ended = F.col("_text").endswith("\n")
    split = F.split(F.when(ended, F.expr("left(_text, length(_text) - 1)")).otherwise(F.col("_text")), "\n", -1)
    whole = files.select("file", text.alias("_text"))
    lines = whole.where("_text <> ''").select("file", ended.alias("_ended"), F.size(split).alias("_size"), F.posexplode(split).alias("_at", "line"))
    number, parsed = F.col("_at") + 1, F.try_parse_json("line")
    bad = F.when(~F.col("_ended") & (number == F.col("_size")), "unterminated-line").when(F.trim("line") == "", F.concat(F.lit("empty-line-"), number)).when(
        parsed.isNull() | ~F.trim("line").startswith("{"), F.concat(F.lit("invalid-json-line-"), number))
    marked = lines.withColumn("_bad", bad)
    told = marked.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("_at"))).alias("error"))
    status = files.select("file").join(told, "file", "left").fillna(0, ["lines"]).withColumn("valid", F.col("error").isNull())
    good = lines.join(told.where("error is null").select("file"), "file", "left_semi")
    return json_records(good), status


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``strict_snapshot`` of the files at ``path``; an empty file, which the reader passes over, is a valid one."""
    found = read_files(spark, path)
    named = [(re.sub("^file:/+", "file:/", unquote(x)), b"") for x in found.inputFiles()]  # a row a file
    content = found.select(F.regexp_replace("path", "^file:/+", "file:/").alias("file"), F.col("content").alias("_content"))
    files = spark.createDataFrame(named, "file string, content binary").join(content, "file", "left")
    return strict_snapshot(files.select("file", F.coalesce("_content", "content").alias("content")))


def json_records(lines: DataFrame) -> DataFrame:
    """The fifteen fields of JSON lines, in either spelling; lines that aren't objects are skipped. A line is parsed once."""
    with _case_sensitive(lines.sparkSession):
        objects = lines.where(F.coalesce(F.try_parse_json("line").isNotNull(), F.lit(False)) & F.ltrim("line").startswith("{"))
        rows = objects.select(F.explode(F.array(F.from_json("line", f"struct<{_RECORD}>"))).alias("r"))
        flat = lambda c: F.when(~c.rlike(r"^\s*[\[{]"), c)
        value = lambda f: F.coalesce(flat(F.col(f"r.{f}")), flat(F.col(f"r.{f[0].upper() + f[1:]}")), F.lit("")).alias(f)
        return rows.select(*(value(f) for f in AUDIT_FIELDS))


def tolerant_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-lines files, bad lines skipped."""
    return json_records(spark.read.text(path).withColumnRenamed("value", "line"))


def salvage_records(excerpts: DataFrame) -> DataFrame:
    """Records of JSON that may have been cut: ``excerpts(key, excerpt)`` to ``(key, pos, record)``.

    The whole text is tried first; else every object of its records array that had closed before the cut counts, up to
    the first bad one. Runs as a bulk job over a table of excerpts.
    """

    def objects(text: str):
        try:
            page = json.loads(text)
            page = page.get("data", page) if isinstance(page, dict) and not isinstance(page.get("records", page.get("Records")), list) else page
            found = next((page[k] for k in ("records", "Records", "items") if isinstance(page.get(k), list)), []) if isinstance(page, dict) else []
            return [x for x in found if isinstance(x, dict)]
        except ValueError:
            pass
        starts = [i for i in (text.find(f'"{k}"') for k in ("records", "Records", "items")) if i >= 0]
        at, out, decoder = text.find("[", min(starts)) + 1 if starts else 0, [], json.JSONDecoder()
        while at > 0:
            at += len(text[at:]) - len(text[at:].lstrip(" \t\r\n,"))
            try:
                found, at = decoder.raw_decode(text, at)
            except ValueError:
                break
            if not isinstance(found, dict):
                break
            out.append(found)
        return out

    def run(batches):
        for batch in batches:
            rows = [(key, i, json.dumps(r, sort_keys=True, ensure_ascii=False)) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, r in enumerate(objects(text or ""))]
            columns = [*zip(*rows, strict=True)] or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], ["key", "pos", "record"])

    return excerpts.select(F.col("key").cast("string"), F.col("excerpt").cast("string")).mapInArrow(run, "key string, pos int, record string")


ISSUES_JSON = "array<struct<number: bigint, title: string, body: string, state: string, updatedAt: string, created_at: string, user: struct<login: string>, author: struct<login: string>, labels: array<struct<name: string>>, assignees: array<struct<login: string>>, pull_request: struct<url: string>>>"


def issue_lists(pages: DataFrame) -> DataFrame:
    """Issues of ``pages(repo, body)``: each body a JSON array of issues, or of such arrays; anything else is an error.

    Pull requests are left out.
    """
    flat = F.when(F.col("body").rlike(r"(?s)^\s*\[\s*\["), F.flatten(F.from_json("body", f"array<{ISSUES_JSON}>", {"mode": "FAILFAST"}))).when(F.col("body").rlike(r"(?s)^\s*\["), F.from_json("body", ISSUES_JSON, {"mode": "FAILFAST"})).otherwise(
        F.raise_error(F.concat(F.lit("not an issue list: "), F.substring("body", 1, 80))).cast(ISSUES_JSON))
    rows = pages.select("repo", F.explode(flat).alias("i")).where("i.pull_request is null")
    return rows.select("repo", "i.number", "i.title", "i.body", F.lower("i.state").alias("state"), F.coalesce("i.author.login", "i.user.login").alias("author"), F.coalesce("i.labels.name", F.array().cast("array<string>")).alias("labels"), F.coalesce("i.assignees.login", F.array().cast("array<string>")).alias("assignees"), F.coalesce("i.created_at", F.lit("")).alias("created_at"), F.col("i.updatedAt").alias("updated_at"), F.lit(False).alias("is_pull_request"))
