"""The driver's ``events`` table as audit records, log lines, dead letters and ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalars as S
from ..schemas import AUDIT_FIELDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_epoch():
    """Seconds of ``ts`` read as UTC, whatever the session's zone."""
    return S.epoch_of(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))


def audit_records(events: DataFrame) -> DataFrame:
    """Audit records from ``events(event_id, ts, user_id, event_type, props)``, all fields strings, with ``event_id``."""
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    base = F.element_at(F.array(F.lit("workflow.run"), F.lit("job.exec"), F.lit("identity.binding.sync")), (user % 3).cast("int") + 1)
    columns = {
        "id": F.concat(F.lit("audit-"), event), "scopeId": F.concat(F.lit("scope-"), user % 4), "auditActorId": F.concat(F.lit("actor-"), user), "identityKeyId": F.concat(F.lit("key-"), user % 7),
        "action": F.concat(base, F.when(kind == "error", ".failed").when(kind == "signup", ".attempted").otherwise("")),
        "outcome": F.when(kind == "error", F.when(event % 2 == 0, "Success").otherwise("Error")).when((kind == "click") & (event % 97 == 0), "").when(kind == "view", "Accepted").otherwise("Success"),
        "occurredAtUtc": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "resourceType": F.lit("workflow"),
        "resourceId": F.concat(F.lit("wf-"), F.get_json_object("props", "$.k")), "correlationId": F.concat(F.lit("corr-"), event),
    }
    return events.select("event_id", *(S.text(columns[f]).alias(f) if f in columns else F.lit("").alias(f) for f in AUDIT_FIELDS))


def project_fields(raw: DataFrame) -> DataFrame:
    """Records of any shape to the fifteen string fields: camelCase before PascalCase, nested or missing values empty."""
    have = dict(raw.dtypes)

    def one(name: str):
        found = [F.col(f"`{n}`").cast("string") for n in (name, name[0].upper() + name[1:]) if n in have and not have[n].startswith(("struct", "array", "map"))]
        return F.coalesce(*found, F.lit("")).alias(name)

    return raw.select(*(one(f) for f in AUDIT_FIELDS))


def render_line(prefix: str, identity: bool = True):
    """One line of an audit record for the alerting path, at most 2048 bytes."""
    parts = [("id", "id"), ("scope", "scopeId"), ("actor", "auditActorId"), *([("identityKey", "identityKeyId")] if identity else []), ("action", "action"), ("outcome", "outcome"), ("occurredAt", "occurredAtUtc")]
    shown = [F.concat(F.lit(f"{name}="), S.text(column)) for name, column in parts]
    resource = F.concat(F.lit("resource="), S.text("resourceType"), F.lit("/"), S.text("resourceId"))
    return F.concat_ws(" ", F.lit(prefix), *shown, resource)


def audit_line(cfg: Config | None = None):
    return S.truncate_bytes(F.concat_ws(" ", render_line((cfg or Config()).event_prefix), F.concat(F.lit("correlation="), S.text("correlationId"))))


def evidence_line(cfg: Config | None = None):
    """One line of an audit record for the stability path: no identity key, a trace reference, non-empty diagnostics."""
    digest = S.sha_hex("correlationId", 32)
    trace = F.concat_ws("-", F.lit("cr"), *(F.substring(digest, i, 8) for i in (1, 9, 17, 25)))
    given = F.when(S.text("correlationId") != "", F.concat(F.lit("correlation="), S.text("correlationId"), F.lit(" trace_ref="), trace))
    extra = [("error_code", "errorCode"), ("stage", "stage"), ("http_status", "httpStatus"), ("dependency", "dependency"), ("owner", "componentOwner")]
    more = [F.when(S.text(c) != "", F.concat(F.lit(f"{name}="), S.text(c))) for name, c in extra]
    return S.truncate_bytes(F.concat_ws(" ", render_line((cfg or Config()).event_prefix, identity=False), given, *more))


def dead_letters(events: DataFrame) -> DataFrame:
    """Synthetic dead letters ``(epoch, queue, error_class, line)``: queue = event_type, class = user_id % 5."""
    klass = F.concat(F.lit("class-"), F.col("user_id") % 5)
    line = F.concat(F.lit("TIMESTAMP="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" LEVEL=error MSG=watcher tag=DEAD_LETTER DELIVERY="), F.col("event_id"), F.lit(" QUEUE="), F.col("event_type"), F.lit(" ERROR_CLASS="), klass)
    return events.select(event_epoch().alias("epoch"), F.col("event_type").alias("queue"), klass.alias("error_class"), line.alias("line"))
