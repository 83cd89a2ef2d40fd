"""Queries over the driver's tables. Each has a function and, where SQL can express it, the DuckDB text it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalars as S
from ..functions.redaction import mask_log_line, redact_outbound
from ..operators import alerts as A
from ..operators import dropclose as D
from ..operators import findings as FI
from ..operators import gates as G
from ..operators import incidents as I
from ..operators import issues as IS
from ..operators import outbox as O
from ..operators import reports as R
from ..operators import snapshots as SN
from ..operators import stability as ST
from ..operators.batching import make_batches
from ..sources import audit as AU
from ..sources import logs as L
from ..sources.adapter import audit_line, audit_records, dead_letters, event_epoch, table
from ..sources.staging import spread, staged

#: One bucket a day: the driver's events are spread over 30 days.
CFG = Config.of(bucket_minutes=1440, dlq_window_minutes=1440, dlq_threshold=15)
SCAN = 1_705_320_000  # 2024-01-15 12:00 UTC

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _records(spark, sf_dir):
    return audit_records(_events(spark, sf_dir))


# --- SQL that several oracles begin with -------------------------------------------------------------------------------

REC = """rec AS (SELECT event_id, 'audit-'||event_id AS id, 'scope-'||(user_id%4) AS scope, 'actor-'||user_id AS actor, 'key-'||(user_id%7) AS ikey,
  (['workflow.run','job.exec','identity.binding.sync'])[(user_id%3)::INT+1] || CASE event_type WHEN 'error' THEN '.failed' WHEN 'signup' THEN '.attempted' ELSE '' END AS action,
  CASE WHEN event_type='error' AND event_id%2=0 THEN 'Success' WHEN event_type='error' THEN 'Error' WHEN event_type='click' AND event_id%97=0 THEN '' WHEN event_type='view' THEN 'Accepted' ELSE 'Success' END AS outcome,
  strftime(ts,'%Y-%m-%dT%H:%M:%SZ') AS tm, floor(epoch(ts))::BIGINT AS ep, 'wf-'||json_extract_string(props,'$.k') AS rid, user_id, event_type FROM events)"""

LINE = "'audit event id='||id||' scope='||scope||' actor='||actor||' action='||action||' outcome='||outcome||' occurredAt='||tm||' resource=workflow/'||rid||' correlation=corr-'||event_id||' trace_ref=cr-'||substr(sha256('corr-'||event_id),1,8)||'-'||substr(sha256('corr-'||event_id),9,8)||'-'||substr(sha256('corr-'||event_id),17,8)||'-'||substr(sha256('corr-'||event_id),25,8)"

EV = f"""{REC}, ev AS (SELECT regexp_replace(action,'\\.(failed|rejected|denied|error|cancelled)$','') AS family, scope, 'workflow' AS rtype, ep, ep//86400 AS bucket,
  CASE WHEN regexp_matches(action,'\\.(failed|rejected|denied|error|cancelled)$') THEN true WHEN outcome='' THEN false ELSE lower(outcome) NOT IN ('accepted','success','succeeded') END AS failed,
  action LIKE '%.attempted' AS attempt, {LINE} AS line FROM rec)"""

GRID = f"""{EV}, b AS (SELECT family,scope,rtype,bucket,count(*) FILTER (failed) AS fails,count(*) AS total FROM ev WHERE NOT attempt GROUP BY ALL),
 cov AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM ev),
 grid AS (SELECT g.family,g.scope,g.rtype,c.bucket,coalesce(b.fails,0) AS fails,coalesce(b.total,0) AS total FROM (SELECT DISTINCT family,scope,rtype FROM b) g
  CROSS JOIN (SELECT unnest(generate_series(lo,hi)) AS bucket FROM cov) c LEFT JOIN b ON b.family=g.family AND b.scope=g.scope AND b.rtype=g.rtype AND b.bucket=c.bucket)"""

W = "PARTITION BY family,scope,rtype ORDER BY bucket"


def djb2_sql(text: str) -> str:
    """djb2 of an ASCII text expression."""
    return f"list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({text},''), lambda c: ord(c)::BIGINT)), lambda h, b: (h*33+b)%4294967296)"


FP = f"printf('%08x', {djb2_sql(chr(39) + 'stability-v1|' + chr(39) + '||signal||' + chr(39) + '|' + chr(39) + '||family||' + chr(39) + '|' + chr(39) + '||scope||' + chr(39) + '|' + chr(39) + '||rtype')})"

# --- gates -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {REC} SELECT coalesce(CASE WHEN outcome='' THEN 'missing-outcome' WHEN lower(outcome) NOT IN ('accepted','success','succeeded') THEN 'outcome:'||lower(outcome) WHEN action='' THEN 'missing-action'
 WHEN action LIKE '%.attempted' THEN NULL WHEN regexp_matches(action,'\\.(failed|rejected|denied|error|cancelled)$') THEN 'failure-action' WHEN action LIKE 'identity.binding.%' THEN 'high-impact-action' END,'none') AS reason, count(*) AS n FROM rec GROUP BY 1""")
def audit_risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy(F.coalesce(G.risk_reason("action", "outcome"), F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {REC} SELECT event_id, 'action='||action||' outcome='||outcome AS line FROM rec
 WHERE regexp_matches(lower('action='||action||' outcome='||outcome),'denied|failure|failed|invalid|unauthorized|refused|privilege|sudo|su\\[|useradd|usermod|passwd|segfault|audit|anomal|error')""")
def suspicious_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("action="), "action", F.lit(" outcome="), "outcome")
    return G.suspicious_lines(_records(spark, sf_dir).select("event_id", line.alias("line")))


# --- stability ---------------------------------------------------------------------------------------------------------


def _grid(spark, sf_dir):
    """Failures and totals on the dense calendar; records are read once, and only their counts by bucket are written."""
    events = ST.stability_events(_records(spark, sf_dir), CFG)
    counts = staged(events.groupBy(*ST.GROUP, "bucket", "attempt").agg(F.count_if("failed").alias("fails"), F.count(F.lit(1)).alias("total")), "counts")
    return ST.dense(counts)


@query(f"WITH {EV} SELECT family,scope,rtype,bucket,count(*) FILTER (failed) AS fails,count(*) AS total FROM ev WHERE NOT attempt GROUP BY ALL")
def component_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.component_buckets(ST.stability_events(_records(spark, sf_dir), CFG))


@query(f"WITH {GRID} SELECT family,scope,rtype,bucket,fails,total,CASE WHEN total>0 THEN printf('%.1f%%',fails*1.0/total*100) ELSE '-' END AS rate,sum(fails) OVER w::BIGINT AS sum_fails,sum(total) OVER w::BIGINT AS sum_total,count(*) OVER w AS buckets FROM grid WINDOW w AS ({W} ROWS 7 PRECEDING)")
def bucket_calendar_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.group_summary(_grid(spark, sf_dir), CFG)


RECURRING = f"SELECT *, fail_buckets>=3 AND sum_fails>=5 AS fired FROM (SELECT family,scope,rtype,bucket,fails,total,count(*) FILTER (fails>0) OVER w AS fail_buckets,sum(fails) OVER w::BIGINT AS sum_fails FROM grid WINDOW w AS ({W} ROWS 7 PRECEDING))"


@query(f"WITH {GRID} SELECT * FROM ({RECURRING}) WHERE fired")
def recurring_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.recurring(_grid(spark, sf_dir), CFG).where("fired")


SPIKE = f"""SELECT *, total>=10 AND fails>=5 AND (prior IS NULL OR rate>=round(greatest(prior*3.0,prior+0.25),9)) AS fired FROM (SELECT family,scope,rtype,bucket,fails,total,
 round(avg(CASE WHEN total>=5 THEN fails::DOUBLE/total END) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),9) AS prior, CASE WHEN total>0 THEN round(fails::DOUBLE/total,9) END AS rate FROM grid)"""


@query(f"WITH {GRID} {SPIKE}")
def error_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.error_spike(_grid(spark, sf_dir), CFG)


FLAP = """SELECT g.family,g.scope,g.rtype,g.bucket,g.fails,g.total,coalesce(x.changes,0)::BIGINT AS changes,coalesce(x.f,0)::BIGINT AS sum_fails,coalesce(x.ok,0)::BIGINT AS sum_ok, coalesce(x.changes,0)>=6 AND coalesce(x.f,0)>=3 AND coalesce(x.ok,0)>=3 AS fired
 FROM grid g LEFT JOIN (SELECT family,scope,rtype,last,count(*) FILTER (was<>failed) AS changes,count(*) FILTER (failed) AS f,count(*) FILTER (NOT failed) AS ok FROM
 (SELECT e.family,e.scope,e.rtype,r.bucket AS last,e.failed,lag(e.failed) OVER (PARTITION BY e.family,e.scope,e.rtype,r.bucket ORDER BY e.ep,e.line) AS was FROM grid r JOIN ev e ON NOT e.attempt AND e.family=r.family AND e.scope=r.scope AND e.rtype=r.rtype AND e.bucket BETWEEN r.bucket-3 AND r.bucket) GROUP BY ALL) x
 ON x.family=g.family AND x.scope=g.scope AND x.rtype=g.rtype AND x.last=g.bucket"""


@query(f"WITH {GRID} {FLAP}")
def flapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.flapping(staged(ST.bucket_counts(ST.stability_events(_records(spark, sf_dir), CFG, line=True)), "bucket-counts"), CFG)


@query(f"SELECT event_type AS queue,'class-'||(user_id%5) AS error_class,count(*) FILTER (floor(epoch(ts)) BETWEEN {SCAN}-604800 AND {SCAN}) AS letters,count(*) AS all_letters,count(*) FILTER (floor(epoch(ts)) BETWEEN {SCAN}-604800 AND {SCAN})>=3 AS fired FROM events GROUP BY ALL")
def burst_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.dead_letter_bursts(dead_letters(_events(spark, sf_dir)), SCAN, CFG.but(dlq_window_minutes=10_080, dlq_threshold=3))


@query(f"""WITH l AS (SELECT event_type AS queue,'class-'||(user_id%5) AS error_class,floor(epoch(ts))::BIGINT AS ep FROM events), g AS (SELECT DISTINCT queue,error_class FROM l),
 c AS (SELECT unnest(generate_series(({SCAN}-604800)//86400,{SCAN}//86400)) AS bucket), n AS (SELECT queue,error_class,ep//86400 AS bucket,count(*) AS fails FROM l WHERE ep BETWEEN {SCAN}-604800 AND {SCAN} GROUP BY ALL)
 SELECT g.queue,g.error_class,c.bucket::BIGINT AS bucket,strftime(make_timestamp((c.bucket*86400)::BIGINT*1000000),'%Y-%m-%dT%H%M') AS label,coalesce(fails,0) AS fails,coalesce(fails,0) AS total,CASE WHEN coalesce(fails,0)>0 THEN '100.0%' ELSE '-' END AS rate
 FROM g CROSS JOIN c LEFT JOIN n ON n.queue=g.queue AND n.error_class=g.error_class AND n.bucket=c.bucket""")
def dead_letter_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.dead_letter_summary(dead_letters(_events(spark, sf_dir)), SCAN, CFG.but(dlq_window_minutes=10_080, dlq_threshold=3))


@query("""SELECT floor(epoch(ts))::BIGINT AS epoch, event_type AS queue, 'class-'||(user_id%5) AS error_class, count(*) AS n FROM events GROUP BY ALL""")
def dead_letter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dead_letters(_events(spark, sf_dir)).select("line")
    return L.parse_dead_letters(lines).groupBy("epoch", "queue", "error_class").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV}, sig AS (SELECT unnest(['recurring-failure','error-spike','flapping']) AS signal), g AS (SELECT DISTINCT family,scope,rtype FROM ev WHERE NOT attempt) SELECT signal,family,scope,rtype,{FP} AS fp FROM g CROSS JOIN sig")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ST.stability_events(_records(spark, sf_dir), CFG).where("not attempt").select(*ST.GROUP).distinct()
    each = events.select(*ST.GROUP, F.explode(F.array(*map(F.lit, S.SIGNALS[:3]))).alias("signal"))
    return each.select("signal", *ST.GROUP, S.fingerprint(F.col("signal"), F.col("family"), F.col("scope"), F.col("rtype")).alias("fp"))


@query(f"""WITH {EV}, r AS (SELECT family,scope,rtype,ep,failed,line,row_number() OVER (PARTITION BY family,scope,rtype ORDER BY ep DESC,line DESC) AS k FROM ev WHERE NOT attempt AND bucket>(SELECT max(bucket) FROM ev)-8)
 SELECT family,scope,rtype,row_number() OVER (PARTITION BY family,scope,rtype ORDER BY k DESC) AS place,ep AS epoch,failed,line FROM r WHERE k<=20""")
def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.evidence(ST.stability_events(_records(spark, sf_dir), CFG, line=True), CFG)


# --- incidents ---------------------------------------------------------------------------------------------------------

LETTERS = """SELECT g.queue,g.error_class,c.bucket,count(l.ep) FILTER (l.ep BETWEEN c.bucket*86400-1 AND c.bucket*86400+86399) AS letters,count(l.ep) FILTER (l.ep//86400=c.bucket) AS own FROM (SELECT DISTINCT queue,error_class FROM dl) g CROSS JOIN (SELECT unnest(generate_series(min(ep)//86400,max(ep)//86400)) AS bucket FROM dl) c
 LEFT JOIN dl l ON l.queue=g.queue AND l.error_class=g.error_class AND l.ep//86400 IN (c.bucket,c.bucket-1) GROUP BY ALL"""

TICKS = f"""{GRID}, dl AS (SELECT event_type AS queue,'class-'||(user_id%5) AS error_class,floor(epoch(ts))::BIGINT AS ep FROM events), t0 AS (SELECT 'recurring-failure' AS signal,family,scope,rtype,bucket,fired,fails=0 AS q FROM ({RECURRING}) UNION ALL SELECT 'error-spike',family,scope,rtype,bucket,fired,fails=0 FROM ({SPIKE}) UNION ALL SELECT 'flapping',family,scope,rtype,bucket,fired,fails=0 FROM ({FLAP}) UNION ALL SELECT 'pipeline-dead-letter',queue,error_class,'framework-log',bucket,letters>=15,own=0 FROM ({LETTERS})),
 k AS (SELECT signal,family,scope,rtype,{FP} AS fp FROM (SELECT DISTINCT signal,family,scope,rtype FROM t0)),
 t AS (SELECT fp,bucket,fired,q,strftime(make_timestamp((bucket*86400)::BIGINT*1000000),'%Y-%m-%dT%H%M') AS lab,row_number() OVER (PARTITION BY fp ORDER BY bucket) AS n FROM t0 JOIN k USING (signal,family,scope,rtype))"""

MACHINE = """st AS (SELECT fp,0::BIGINT AS n,NULL::BIGINT AS bucket,false AS fired,false AS q,''::VARCHAR AS lab,'none'::VARCHAR AS state,''::VARCHAR AS opened,''::VARCHAR AS lastf,0::INT AS cnt,''::VARCHAR AS quiet,''::VARCHAR AS action FROM (SELECT DISTINCT fp FROM t)
 UNION ALL SELECT t.fp,t.n,t.bucket,t.fired,t.q,t.lab,
 CASE s.state WHEN 'none' THEN CASE WHEN t.fired THEN 'candidate' ELSE 'none' END WHEN 'candidate' THEN CASE WHEN t.fired THEN CASE WHEN s.lastf<>t.bucket::VARCHAR THEN 'open' ELSE 'candidate' END ELSE 'none' END
  WHEN 'open' THEN CASE WHEN NOT t.fired AND t.q THEN 'recovering' ELSE 'open' END WHEN 'recovering' THEN CASE WHEN t.fired THEN 'open' WHEN t.q AND (CASE WHEN t.lab<>s.quiet THEN s.cnt+1 ELSE s.cnt END)>=6 THEN 'closed' ELSE 'recovering' END
  ELSE CASE WHEN t.fired THEN 'candidate' ELSE 'closed' END END,
 CASE WHEN s.state='candidate' THEN CASE WHEN NOT t.fired THEN '' WHEN s.lastf<>t.bucket::VARCHAR THEN t.lab ELSE s.opened END WHEN s.state='closed' AND t.fired THEN '' ELSE s.opened END,
 CASE WHEN s.state='candidate' AND NOT t.fired THEN '' WHEN t.fired THEN t.bucket::VARCHAR ELSE s.lastf END,
 CASE WHEN s.state='open' AND NOT t.fired AND t.q THEN 1 WHEN s.state='candidate' AND NOT t.fired THEN 0 WHEN s.state='closed' AND t.fired THEN 0 WHEN s.state='recovering' THEN CASE WHEN t.fired THEN 0 WHEN t.q THEN CASE WHEN t.lab<>s.quiet THEN s.cnt+1 ELSE s.cnt END WHEN t.lab<>'' AND t.lab<>s.quiet THEN 0 ELSE s.cnt END ELSE s.cnt END,
 CASE WHEN s.state='open' AND NOT t.fired AND t.q THEN t.lab WHEN s.state='candidate' AND NOT t.fired THEN '' WHEN s.state='closed' AND t.fired THEN '' WHEN s.state='recovering' THEN CASE WHEN t.fired THEN '' WHEN t.q THEN CASE WHEN t.lab<>s.quiet THEN t.lab ELSE s.quiet END WHEN t.lab<>'' AND t.lab<>s.quiet THEN '' ELSE s.quiet END ELSE s.quiet END,
 CASE WHEN s.state='candidate' AND t.fired AND s.lastf<>t.bucket::VARCHAR THEN 'open' WHEN s.state='recovering' AND t.fired THEN 'comment' WHEN s.state='recovering' AND t.q AND (CASE WHEN t.lab<>s.quiet THEN s.cnt+1 ELSE s.cnt END)>=6 THEN 'close' ELSE '' END
 FROM st s JOIN t ON t.fp=s.fp AND t.n=s.n+1)"""


def _candidates(spark, sf_dir):
    """All four rules; records and dead letters are each read once."""
    return staged(ST.candidates(audit_records(spread(_events(spark, sf_dir))), CFG, dead_letters(_events(spark, sf_dir))), "candidates")


def _timeline(spark, sf_dir):
    return I.timeline(I.ticks_of(_candidates(spark, sf_dir), CFG), CFG)


@query(f"WITH RECURSIVE {TICKS}, {MACHINE} SELECT fp,bucket AS seq,bucket::VARCHAR AS tick_id,fired,q AS quiet_ok,lab AS latest_bucket,state,opened AS open_bucket,lastf AS last_fired_tick,cnt AS quiet_count,quiet AS last_quiet_bucket,action FROM st WHERE n>0")
def incident_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir)


@query(f"""WITH RECURSIVE {TICKS}, {MACHINE}, c AS (SELECT fp,bucket,state,lag(state,1,'none') OVER (PARTITION BY fp ORDER BY n) AS was FROM st WHERE n>0)
 SELECT fp,arg_max(state,bucket) AS state,count(*) AS transitions,max(bucket) AS last_seen FROM c WHERE state<>was GROUP BY fp""")
def incident_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    was = F.lag("state", 1, "none").over(Window.partitionBy("fp").orderBy("seq"))
    moved = _timeline(spark, sf_dir).withColumn("was", was).where("state <> was").select("fp", F.lit("").alias("signal"), F.col("state").alias("to_state"), F.lit(0).alias("fails"), F.lit(0).alias("total"), F.lit(0).alias("buckets"), F.col("seq").alias("epoch"))
    return R.latest_incidents(moved, ["epoch"]).select("fp", "state", "transitions", "last_seen")


@query(f"""WITH RECURSIVE {TICKS}, {MACHINE}, k2 AS (SELECT fp,signal,family FROM k) SELECT action AS kind,fp AS fingerprint,signal,CASE WHEN signal='flapping' THEN 'medium' ELSE 'high' END AS severity,
 '[stability] '||CASE signal WHEN 'recurring-failure' THEN 'recurring failure' WHEN 'error-spike' THEN 'error spike' WHEN 'pipeline-dead-letter' THEN 'dead letters' ELSE signal END||': '||family||' (fp:'||fp||')' AS title,fp||'-'||opened AS incident_id,
 CASE WHEN action='comment' THEN 'stability-issue/comment/'||fp||'/'||opened||'/'||(bucket*86400//21600) ELSE 'stability-issue/'||action||'/'||fp||'/'||opened END AS dedup_key,CASE WHEN signal='pipeline-dead-letter' THEN 'org/pipeline' ELSE 'org/platform' END AS repo,CASE WHEN signal='pipeline-dead-letter' THEN '' ELSE '1' END AS devloop_enabled FROM st JOIN k2 USING (fp) WHERE action<>''""")
def issue_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _candidates(spark, sf_dir)
    acted = I.timeline(I.ticks_of(rules, CFG), CFG).where("action <> ''").join(rules.select("fp", F.col("bucket").alias("seq"), "signal", "family", "all_fails", "all_total"), ["fp", "seq"])
    row = F.array(F.struct(F.col("latest_bucket").alias("label"), F.col("all_fails").alias("fails"), F.col("all_total").alias("total")))
    ready = acted.withColumn("epoch", F.col("seq") * CFG.bucket_seconds).withColumn("rows", row).withColumn("lines", F.array().cast("array<string>"))
    return I.requests(ready, CFG).select("kind", "fingerprint", "signal", "severity", "title", "incident_id", "dedup_key", "repo", "devloop_enabled")


# --- text --------------------------------------------------------------------------------------------------------------

SENSITIVE_SQL = "|".join("[_.-]*".join(w) for w in ("token", "secret", "password", "passwd", "apikey", "authorization", "cookie", "credential", "privatekey", "signature", "webhook"))


DOC_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text,''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text,''), chr(10)),1)-1 AS line_no FROM documents)"


def _document_lines(spark, sf_dir):
    """Lines of all documents; a null text is one empty line."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


@query(f"""WITH {DOC_LINES}
 SELECT doc_id, line_no::INT AS line_no, regexp_replace(regexp_replace(regexp_replace(line,'(?i)(^|[^A-Za-z0-9_.-])((?:[A-Za-z0-9_.-]*(?:{SENSITIVE_SQL})[A-Za-z0-9_.-]*|[_.-]*a[_.-]*u[_.-]*t[_.-]*h[_.-]*)[ \\t]*[=:][ \\t]*).*$','\\1\\2***'),
 '([A-Za-z][A-Za-z0-9+.-]*://)[^@/\\s]+@','\\1','g'),'(^|[^A-Za-z0-9])([0-9A-Fa-f]{{8}})[0-9A-Fa-f]{{24,}}([^A-Za-z0-9]|$)','\\1\\2...\\3','g') AS line FROM l""")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_lines(spark, sf_dir).select("doc_id", "line_no", mask_log_line("line").alias("line"))


def _outbound_sql(line: str) -> str:
    """The outbound rules one after the other; a key's left edge is a group here, where Spark looks behind."""
    word = "[A-Za-z0-9_.-]"
    key = f"{word}*(?:{SENSITIVE_SQL}|a[_.-]*u[_.-]*t[_.-]*h){word}*"
    short = "|".join("[_.-]*".join(w) for w in ("id", "actor", "identitykey", "correlation", "scope", "resource"))
    left, end, stop = "(^|[^A-Za-z0-9_.-])", """[^\\s&,;"'')]+""", """[^\\s&,;"'')…]"""
    rules = (
        (f'(?i)("{key}"\\s*:\\s*")(?:\\\\.|[^"\\\\])*(")', "\\1***\\2"), (f'(?i){left}({key}\\s*=\\s*")[^"]*(")', "\\1\\2***\\3"), (f"(?i){left}({key}\\s*=\\s*'')[^'']*('')", "\\1\\2***\\3"),
        (f"(?i){left}({key}\\s*=\\s*)\\([^()]*\\)", "\\1\\2***"), (f"(?i){left}({key}\\s*=\\s*)bearer\\s+{end}", "\\1\\2***"), (f"(?i){left}({key}\\s*=\\s*){end}", "\\1\\2***"), (f"(?i)^(\\s*{key}:\\s*).*$", "\\1***"),
        ("(?i)\\bbearer\\s+\\S+", "Bearer ***"), ("(^|[^A-Za-z0-9])gh[pousr]_[A-Za-z0-9_-]+", "\\1***github-token***"), ("([A-Za-z][A-Za-z0-9+.-]*://)[^@/\\s]+@", "\\1"), ("eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", "***jwt***"),
        ("(^|[^A-Za-z0-9])([0-9A-Fa-f]{8})[0-9A-Fa-f]{24,}([^A-Za-z0-9]|$)", "\\1\\2…\\3"), (f"(?i){left}({word}*(?:{short}){word}*={stop}{{8}}){stop}[^\\s&,;\"'')]*", "\\1\\2…"),
    )
    for pattern, to in rules:
        line = f"regexp_replace({line},'{pattern}','{to}','g')"
    return line


@query(f"WITH {DOC_LINES} SELECT doc_id, line_no::INT AS line_no, {_outbound_sql('line')} AS line FROM l")
def outbound_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_lines(spark, sf_dir).select("doc_id", "line_no", redact_outbound("line").alias("line"))


@query("""SELECT conv_id, turn, regexp_matches(text,'(?i)(failed password|not in sudoers|denied|forbidden|unauthorized|critical|suspicious|brute|shadow|token|secret)') AS suspicious, sha256(text) AS sha FROM conversations""")
def shown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("text", "line")
    return R.shown_words(rows).select("conv_id", "turn", "suspicious", S.sha_hex("line").alias("sha"))


#: Bytes of one read of a file, and events that it stands for here.
READ, READ_EVENTS = 1 << 20, 4096

CUT = "CASE WHEN length({0})>8 THEN left({0},8)||'...' ELSE {0} END"
BATCH_LINE = f"""'audit event id='||{CUT.format("id")}||' scope='||{CUT.format("scope")}||' actor='||{CUT.format("actor")}||' identityKey='||ikey||' action='||action||' outcome='||CASE WHEN outcome='' THEN '-' ELSE outcome END||' occurredAt='||tm||' resource=workflow/'||rid||' correlation='||{CUT.format("('corr-'||event_id)")}"""
PATHS = "'/var/log/audit-'||(user_id%8)||'.log'"


def _batches(spark, sf_dir):
    records, part = audit_records(spread(_events(spark, sf_dir))), F.floor(F.col("event_id") / READ_EVENTS)
    lines = records.select(F.concat(F.lit("/var/log/audit-"), F.regexp_extract("auditActorId", r"(\d+)", 1).cast("bigint") % 8, F.lit(".log")).alias("path"), (part * READ).alias("from_offset"), ((part + 1) * READ).alias("to_offset"), F.col("event_id").alias("line_no"), audit_line(CFG).alias("line"))
    return make_batches(G.suspicious_lines(lines))


@query(f"""WITH RECURSIVE {REC}, l AS (SELECT {PATHS} AS path,event_id//{READ_EVENTS} AS part,event_id,{BATCH_LINE} AS line FROM rec), o AS (SELECT *,row_number() OVER (PARTITION BY path,part ORDER BY event_id) AS n,length(line)+1 AS sz FROM l),
 c AS (SELECT path,part,n,line,event_id,sz AS used,0::BIGINT AS chunk FROM o WHERE n=1 UNION ALL SELECT o.path,o.part,o.n,o.line,o.event_id,CASE WHEN c.used+o.sz>8192 THEN o.sz ELSE c.used+o.sz END,CASE WHEN c.used+o.sz>8192 THEN c.chunk+1 ELSE c.chunk END FROM c JOIN o ON o.path=c.path AND o.part=c.part AND o.n=c.n+1),
 b AS (SELECT path,part,chunk,count(*)::INT AS line_count,string_agg(line,chr(10) ORDER BY n) AS content FROM c GROUP BY ALL)
 SELECT path AS source_path,line_count,content,sha256(content) AS content_checksum,'v3-'||regexp_replace(path,'[^A-Za-z0-9._-]','_','g')||'-'||printf('%08x',{djb2_sql('path')})||'-'||part*1048576||'-'||(part+1)*1048576||'-'||chunk||'-'||substr(sha256(content),1,16) AS batch_id FROM b""")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select("source_path", "line_count", "content", "content_checksum", "batch_id")


def _finding_tables(spark, sf_dir):
    made = staged(_batches(spark, sf_dir), "batches")
    lines = made.select("batch_id", F.posexplode(F.split("content", "\n")).alias("k", "line"))
    severity = F.element_at(F.array(*map(F.lit, S.SEVERITIES)), (F.col("k") % 4 + 1).cast("int"))
    copied = F.when(F.col("k") % 5 == 0, F.col("line")).when(F.col("k") % 7 == 0, F.concat(F.lit("x"), F.col("line")))
    told = lines.where(copied.isNotNull()).select("batch_id", severity.alias("severity"), F.lit("auth.failure").alias("category"), copied.alias("evidence_line"), F.lit("copied").alias("why"), F.lit("look").alias("recommended_action"))
    return told, made


@query(f"""WITH RECURSIVE {REC}, l AS (SELECT {PATHS} AS path,event_id//{READ_EVENTS} AS part,event_id,{BATCH_LINE} AS line FROM rec), o AS (SELECT *,row_number() OVER (PARTITION BY path,part ORDER BY event_id) AS n,length(line)+1 AS sz FROM l),
 c AS (SELECT path,part,n,line,sz AS used,0::BIGINT AS chunk,0::BIGINT AS k FROM o WHERE n=1 UNION ALL SELECT o.path,o.part,o.n,o.line,CASE WHEN c.used+o.sz>8192 THEN o.sz ELSE c.used+o.sz END,CASE WHEN c.used+o.sz>8192 THEN c.chunk+1 ELSE c.chunk END,CASE WHEN c.used+o.sz>8192 THEN 0 ELSE c.k+1 END FROM c JOIN o ON o.path=c.path AND o.part=c.part AND o.n=c.n+1)
 SELECT path AS source_path,CASE WHEN k%4=3 THEN 'critical' ELSE 'high' END AS severity,'auth.failure' AS category,'copied' AS summary,line AS evidence,'look' AS action FROM c WHERE k%5=0 AND k%4 IN (2,3)""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, made = _finding_tables(spark, sf_dir)
    return FI.alerts_of(FI.with_evidence(told, made), made).select("source_path", "severity", "category", "summary", "evidence", "action")


@query("""SELECT user_id%7 AS shape, CASE user_id%7 WHEN 0 THEN NULL WHEN 1 THEN 'not-a-json-array' WHEN 2 THEN 'too-many-findings' WHEN 3 THEN 'invalid-finding' WHEN 4 THEN NULL WHEN 5 THEN 'not-a-json-array' ELSE 'invalid-finding' END AS error_class, count(*) AS n, CASE user_id%7 WHEN 0 THEN count(*) ELSE 0 END AS findings FROM events GROUP BY 1,2""")
def finding_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = '{"severity":"high","category":"auth","evidence_line":"line %s","why":"w","recommended_action":"a"}'
    one = F.format_string(good, F.col("event_id"))
    shape = F.col("user_id") % 7
    output = F.when(shape == 0, F.concat(F.lit(" ["), one, F.lit("] "))).when(shape == 1, F.concat(F.lit("Here: "), one)).when(shape == 2, F.concat(F.lit("["), F.array_join(F.array_repeat(one, 6), ","), F.lit("]"))).when(
        shape == 3, F.lit('[{"severity":"urgent","category":"auth","evidence_line":"l","why":"w","recommended_action":"a"}]')).when(shape == 4, "[]").when(shape == 5, one).otherwise('[{"severity":"high","category":"auth","why":"w","recommended_action":"a"}]')
    parsed = G.parse_findings(_events(spark, sf_dir).select(shape.alias("shape"), F.col("event_id").alias("batch_id"), output.alias("output")))
    return parsed.groupBy("shape", "error_class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("findings"), F.lit(0))).alias("findings"))


# --- alerts ------------------------------------------------------------------------------------------------------------

KEYED = "SELECT 'k-'||(user_id%40) AS k,CASE WHEN user_id%10=0 THEN 'issue-filed' ELSE 'auth' END AS cat,floor(epoch(ts))::BIGINT AS at_,event_id FROM events WHERE event_type='error'"


def _keyed_alerts(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type = 'error'").select(F.concat(F.lit("k-"), F.col("user_id") % 40).alias("dedup_key"), F.col("event_id").alias("seq"), F.when(F.col("user_id") % 10 == 0, "issue-filed").otherwise("auth").alias("category"), event_epoch().alias("at"))


@query(f"""WITH RECURSIVE a AS (SELECT *,row_number() OVER (PARTITION BY k ORDER BY at_,event_id) AS n FROM ({KEYED})), s AS (SELECT k,n,event_id,cat,at_,at_ AS mark,true AS sent FROM a WHERE n=1 UNION ALL
 SELECT a.k,a.n,a.event_id,a.cat,a.at_,CASE WHEN a.at_>=s.mark+CASE WHEN a.cat='issue-filed' THEN 2678400 ELSE 86400 END OR a.cat='issue-filed' THEN a.at_ ELSE s.mark END,a.at_>=s.mark+CASE WHEN a.cat='issue-filed' THEN 2678400 ELSE 86400 END FROM s JOIN a ON a.k=s.k AND a.n=s.n+1)
 SELECT k AS dedup_key,event_id AS seq,cat AS category,at_ AS \"at\",sent FROM s""")
def alerts_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.suppress(_keyed_alerts(spark, sf_dir))


def _alert_entries(spark, sf_dir):
    events, n = _events(spark, sf_dir), F.col("event_id")
    return events.where("event_type in ('error', 'click')").select(
        F.concat(F.lit("key-"), F.col("user_id") % 30).alias("dedup_key"), F.when(n % 3 == 0, "real").otherwise("dry-run").alias("mode"), event_epoch().alias("at"), n.alias("arrival"), F.element_at(F.array(*map(F.lit, S.SEVERITIES)), (n % 4 + 1).cast("int")).alias("severity"),
        F.concat(F.lit("c"), n % 5).alias("category"), F.concat(F.lit("event "), n).alias("summary"), F.when(n % 7 == 0, "duplicate").otherwise("new").alias("status"), F.when(n % 3 == 0, "sent").otherwise("skipped").alias("delivery"),
    )


ENTRIES = "SELECT 'key-'||(user_id%30) AS dedup_key,CASE WHEN event_id%3=0 THEN 'real' ELSE 'dry-run' END AS mode,floor(epoch(ts))::BIGINT AS at_,event_id,(['low','medium','high','critical'])[(event_id%4)::INT+1] AS severity,'c'||(event_id%5) AS category,'event '||event_id AS summary,CASE WHEN event_id%7=0 THEN 'duplicate' ELSE 'new' END AS status,CASE WHEN event_id%3=0 THEN 'sent' ELSE 'skipped' END AS delivery FROM events WHERE event_type IN ('error','click')"


@query(f"WITH e AS ({ENTRIES}) SELECT dedup_key,mode,count(*) AS n,max(at_) AS \"at\",arg_max(summary,at_*100000000-event_id) AS summary,arg_max(status,at_*100000000-event_id) AS status,arg_max(delivery,at_*100000000-event_id) AS delivery,arg_min(severity,event_id) AS severity,arg_min(category,event_id) AS category FROM e GROUP BY ALL")
def alert_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collapse_alerts(_alert_entries(spark, sf_dir))


@query(f"""WITH {REC}, e AS (SELECT *,CASE WHEN outcome='' THEN true WHEN lower(outcome) NOT IN ('accepted','success','succeeded') THEN true WHEN action LIKE '%.attempted' THEN false WHEN action LIKE '%.failed' OR action LIKE 'identity.binding.%' THEN true ELSE false END AS s FROM rec WHERE ep>={SCAN}-86400)
 SELECT count(*) AS all_events,count(*) FILTER (s) AS suspect,count(*) FILTER (NOT s) AS normal,max(tm) AS newest FROM e""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = R.shown_events(_records(spark, sf_dir))
    return R.facets(shown.where(G.in_time_range("timestamp", "24h", F.lit(SCAN))))


@query("SELECT user_id AS number, CASE user_id%4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN user_id%4=0 THEN 4 WHEN user_id%4=1 THEN 3 WHEN user_id%4=2 THEN 2 ELSE 1 END AS rank, CASE WHEN user_id%4 IN (0,1) THEN count(*) ELSE 0 END AS passed FROM events GROUP BY user_id")
def severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("critical alert", "HIGH", "warning", "note")))
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("number"), S.loose_severity(F.element_at(words, (F.col("user_id") % 4 + 1).cast("int"))).alias("severity"))
    return rows.groupBy("number", "severity").agg(F.first(S.severity_rank("severity")).alias("rank"), F.sum(F.when(G.at_least("severity"), 1).otherwise(0)).alias("passed"))


# --- snapshots and pages -----------------------------------------------------------------------------------------------


@query(f"WITH {REC}, v AS (SELECT *,row_number() OVER (PARTITION BY id ORDER BY v DESC) AS k FROM (SELECT *,0 AS v FROM rec UNION ALL SELECT * REPLACE (CASE WHEN event_id%3=0 THEN 'Late' ELSE outcome END AS outcome),1 FROM rec WHERE event_type='error')) SELECT id,action,outcome,tm AS occurredAtUtc FROM v WHERE k=1 ORDER BY tm DESC,id DESC LIMIT 1000")
def snapshot_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    late = records.where(F.col("action").endswith(".failed")).withColumn("outcome", F.when(F.col("event_id") % 3 == 0, "Late").otherwise(F.col("outcome"))).withColumn("arrival", F.col("event_id"))
    return SN.merge_snapshot(records, late, CFG.snapshot_rows).select("id", "action", "outcome", "occurredAtUtc")


def _pages(spark, sf_dir):
    records = _records(spark, sf_dir)
    window, page = F.col("event_id") % 37, F.floor(F.col("event_id") / 370)
    body = F.struct(*[F.col(c) for c in ("id", "action", "outcome", "occurredAtUtc")])
    rows = records.select(window.alias("w"), page.alias("p"), body.alias("r")).groupBy("w", "p").agg(F.array_sort(F.collect_list("r")).alias("records"))
    more = F.when((F.col("w") % 5 == 0) | (F.col("p") < 2), F.concat(F.lit("c-"), F.col("p")))
    page_json = F.when(F.col("w") % 3 == 0, F.to_json(F.struct(F.struct(F.col("records").alias("Records"), more.alias("nextCursor"), F.concat(F.lit("mark-"), F.col("p")).alias("QueryWatermark")).alias("data")))).otherwise(F.to_json(F.struct(F.col("records"), more.alias("NextCursor"), F.concat(F.lit("mark-"), F.col("p")).alias("queryWatermark"))))
    return rows.select(F.lit("trail").alias("source_id"), F.concat(F.lit("w-"), "w").alias("window_id"), F.col("p").alias("page_no"), page_json.alias("body"))


@query("""WITH p AS (SELECT event_id%37 AS w,event_id//370 AS p,count(*) AS n FROM events GROUP BY ALL) SELECT 'trail' AS source_id,'w-'||w AS window_id,count(*) AS pages,sum(n)::BIGINT AS records,bool_or(NOT (w%5=0 OR p<2)) AS exhausted,CASE WHEN bool_or(NOT (w%5=0 OR p<2)) THEN 'mark-'||min(p) END AS watermark FROM p GROUP BY w""")
def window_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.window_checkpoints(AU.parse_pages(_pages(spark, sf_dir)))


@query(f"WITH {REC} SELECT id,action,outcome,tm AS occurredAtUtc FROM rec")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.page_records(AU.parse_pages(_pages(spark, sf_dir))).select("id", "action", "outcome", "occurredAtUtc")


@query(f"WITH {REC} SELECT id,action FROM rec WHERE NOT (event_id%4=0 AND ep>{SCAN}-604800)")
def unseen_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir).withColumn("source_id", F.lit("trail"))
    ledger = records.where("event_id % 4 = 0").select(F.lit("trail/risk-v2").alias("source_id"), "id", S.epoch_of("occurredAtUtc").alias("at"))
    return SN.unseen(records, ledger, SCAN).select("id", "action")


# --- issues ------------------------------------------------------------------------------------------------------------

ISSUE_FP = "printf('%08x',(user_id*2654435761)%4294967296)"


def _issue_fp():
    return F.lpad(F.lower(F.hex(F.pmod(F.col("user_id") * 2654435761, F.lit(1 << 32)))), 8, "0")


def _issue_tables(spark, sf_dir):
    events = _events(spark, sf_dir).where("event_type = 'error'").withColumn("fp", _issue_fp())
    day, n = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id")
    kind = F.when(n % 5 == 3, "comment").when(n % 5 == 4, "close").otherwise("open")
    repo = F.concat(F.lit("org/r"), F.col("user_id") % 3)
    requests = events.select(
        F.lit("issues.issue.v1").alias("schema"), kind.alias("kind"), "fp", F.lit("error-spike").alias("signal"), F.when(n % 53 == 0, "urgent").otherwise("high").alias("severity"), F.concat(F.lit("[stability] error spike: x (fp:"), "fp", F.lit(")")).alias("title"),
        F.lit("body").alias("body_md"), F.concat_ws("-", "fp", day).alias("incident_id"), F.concat_ws("/", F.lit("stability-issue"), kind, "fp", n.cast("string")).alias("dedup_key"), repo.alias("repo"), F.lit("").alias("devloop_enabled"), n.alias("arrival"), day.alias("day"),
    ).withColumnRenamed("fp", "fingerprint")
    users = _events(spark, sf_dir).select("user_id").distinct().where("user_id % 4 <> 0").withColumn("fp", _issue_fp())
    kind_of = F.col("user_id") % 4
    issues = users.select(
        repo.alias("repo"), F.col("user_id").alias("number"), F.concat(F.lit("[stability] error spike: x (fp:"), "fp", F.lit(")")).alias("title"), F.lit("").alias("body"), F.when(kind_of == 2, "closed").otherwise("open").alias("state"), F.lit("bot").alias("author"),
        F.filter(F.array(F.lit("stability"), F.when(F.col("user_id") % 8 == 3, "muted"), F.when(F.col("user_id") % 8 == 6, "wontfix"), F.when(F.col("user_id") % 8 == 5, "autodev:claimed")), lambda x: x.isNotNull()).alias("labels"),
        F.array().cast("array<string>").alias("assignees"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit(False).alias("is_pull_request"),
    )
    done = requests.where("arrival % 11 = 0").select("repo", "dedup_key")
    return requests, issues, done


def _repeating(rows):
    """Requests whose keys repeat: a key for each third of a day's requests of a kind and fingerprint."""
    return rows.withColumn("dedup_key", F.concat_ws("/", F.lit("stability-issue"), "kind", "fingerprint", "day", (F.col("arrival") % 3).cast("string")))


DECISIONS = f"""WITH RECURSIVE r0 AS (SELECT event_id,user_id,{ISSUE_FP} AS fp,'org/r'||(user_id%3) AS repo,strftime(ts,'%Y-%m-%d') AS day,CASE event_id%5 WHEN 3 THEN 'comment' WHEN 4 THEN 'close' ELSE 'open' END AS kind,event_id%53=0 AS bad FROM events WHERE event_type='error'),
 r AS (SELECT *,concat_ws('/',kind,fp,day,event_id%3) AS k FROM r0), dn AS (SELECT DISTINCT k FROM r WHERE event_id%11=0), q AS (SELECT r.*,dn.k IS NOT NULL AS done FROM r LEFT JOIN dn USING (k)),
 w AS (SELECT fp,day,bool_or(kind='open') AS o,bool_or(kind='close') AS c FROM q WHERE NOT bad AND NOT done GROUP BY ALL),
 d AS (SELECT q.*,(user_id%8=3 OR user_id%8=6) AS muted,(user_id%4 IN (1,3) AND user_id%8<>3) AS has,coalesce(w.o,false) AS o,coalesce(w.c,false) AS c FROM q LEFT JOIN w ON w.fp=q.fp AND w.day=q.day),
 n AS (SELECT repo,count(*) FILTER (user_id%4<>2) AS openu FROM (SELECT DISTINCT user_id,'org/r'||(user_id%3) AS repo FROM events WHERE user_id%4<>0) GROUP BY repo),
 ak AS (SELECT d.repo,fp,day,coalesce(any_value(openu),0) AS openu,min(event_id) AS e FROM d LEFT JOIN n USING (repo) WHERE NOT bad AND NOT done AND NOT muted AND NOT has AND NOT c AND kind='open' GROUP BY d.repo,fp,day),
 an AS (SELECT *,row_number() OVER (PARTITION BY repo ORDER BY e) AS i FROM ak),
 wk AS (SELECT DISTINCT repo,0::BIGINT AS i,0::BIGINT AS e,''::VARCHAR AS fp,''::VARCHAR AS day,false AS ok,[]::VARCHAR[] AS fps,[]::VARCHAR[] AS days FROM an UNION ALL
  SELECT repo,i,e,fp,day,ok,CASE WHEN ok THEN list_append(fps,fp) ELSE fps END,CASE WHEN ok THEN list_append(days,day) ELSE days END FROM (
   SELECT a.repo,a.i,a.e,a.fp,a.day,wk.fps,wk.days,NOT list_contains(wk.fps,a.fp) AND len(list_filter(wk.days,lambda z: z=a.day))<5 AND a.openu+len(wk.fps)<120 AS ok FROM wk JOIN an a ON a.repo=wk.repo AND a.i=wk.i+1)),
 f AS (SELECT repo,fp,e FROM wk WHERE ok), fd AS (SELECT repo,day,list(e) AS es FROM wk WHERE ok GROUP BY ALL),
 t AS (SELECT d.*,f.e,coalesce(f.e<event_id,false) AS there,coalesce(len(list_filter(es,lambda z: z<d.event_id)),0) AS spent FROM d LEFT JOIN f ON f.repo=d.repo AND f.fp=d.fp LEFT JOIN fd ON fd.repo=d.repo AND fd.day=d.day),
 x AS (SELECT *,CASE WHEN bad THEN 'invalid-severity' WHEN done THEN 'duplicate-marker' WHEN muted THEN 'muted' WHEN kind='open' AND (has OR there) THEN 'open-issue-adopted' WHEN kind='comment' AND NOT has AND NOT there THEN CASE WHEN o THEN 'waiting-for-pending-open' ELSE 'no-open-issue' END
  WHEN kind='close' AND NOT has AND NOT there THEN CASE WHEN o THEN 'recovered-before-open-filed' ELSE 'no-open-issue' END WHEN kind='close' AND user_id%8=5 THEN 'devloop-managed' WHEN kind='close' THEN 'autoclose-disabled' WHEN kind='open' AND c THEN 'recovered-before-open-filed'
  WHEN kind='comment' THEN kind WHEN event_id=e THEN 'file' WHEN spent>=5 THEN 'budget-day' ELSE 'budget-open' END AS why FROM t),
 m AS (SELECT *,min(event_id) FILTER (NOT bad AND why NOT IN ('waiting-for-pending-open','budget-day','budget-open')) OVER (PARTITION BY repo,k) AS fin FROM x)"""


@query(f"{DECISIONS} SELECT event_id AS arrival,kind,CASE WHEN NOT bad AND event_id>fin THEN 'duplicate-marker' ELSE why END AS reason FROM m")
def issue_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, issues, _ = _issue_tables(spark, sf_dir)
    requests = _repeating(requests)
    done = requests.where("arrival % 11 = 0").select("repo", "dedup_key")
    return IS.decide(requests, issues, done, CFG.but(max_open=120)).select("arrival", "kind", "reason")


@query(f"""WITH r AS (SELECT DISTINCT user_id,'org/r'||(user_id%3) AS repo,{ISSUE_FP} AS fp FROM events WHERE user_id%4<>0) SELECT repo,fp AS fingerprint,user_id%8=6 AS closed_muted,user_id%8=3 AS open_muted,CASE WHEN user_id%4 IN (1,3) AND user_id%8<>3 THEN user_id END AS open_number FROM r""")
def issue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IS.fp_states(_issue_tables(spark, sf_dir)[1], CFG).select("repo", "fingerprint", "closed_muted", "open_muted", "open_number")


@query("""SELECT 'org/r'||(user_id%3) AS repo,CASE WHEN event_id%3=0 THEN '' ELSE event_id::VARCHAR END AS issue_number,CASE WHEN event_id%3=0 THEN 'reserved' ELSE 'finalized' END AS phase FROM events WHERE event_type='error' AND event_id>0 AND NOT (event_id%3<>0 AND event_id%2=0)""")
def outbox_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _issue_tables(spark, sf_dir)[0].where("arrival > 0").withColumn("number", F.col("arrival"))
    merged, _ = O.merge(O.reserve(requests), O.finalize(requests.where("arrival % 3 <> 0")))
    acks = merged.where("phase = 'finalized' and cast(issue_number as bigint) % 2 = 0").select(F.lit("alerts.delivery-ack.v1").alias("schema"), F.lit("issue-filed").alias("kind"), "repo", "issue_number", F.col("alert_dedup_key").alias("dedup_key"))
    return O.acknowledge(merged, acks).select("repo", "issue_number", "phase")


@query("""SELECT 'org/r'||(user_id%3) AS repo,count(*) FILTER (user_id%4<>2) AS open_used,count(*) AS used,'2024-01-01' AS day FROM (SELECT DISTINCT user_id FROM events WHERE user_id%4<>0) GROUP BY 1""")
def issue_budget_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _issue_tables(spark, sf_dir)[1]
    return IS.open_counts(issues, CFG).join(IS.created_by_day(issues, "bot", CFG), "repo").select("repo", "open_used", "used", "day")


@query("""SELECT DISTINCT 'org/r'||(user_id%3) AS repo,n AS name,CASE n WHEN 'severity:high' THEN 'd93f0b' ELSE 'ededed' END AS color FROM events CROSS JOIN (SELECT unnest(['stability','signal:error-spike','severity:high']) AS n) WHERE event_type='error' UNION
 SELECT DISTINCT 'org/r'||(user_id%3),'severity:urgent','ededed' FROM events WHERE event_type='error' AND event_id%53=0""")
def label_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IS.label_specs(_issue_tables(spark, sf_dir)[0], CFG).select("repo", "name", "color")


@query("SELECT c_custkey AS number FROM customer WHERE c_custkey>0 AND c_custkey%14 NOT IN (1,3)")
def drop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.drop_candidates(_drop_tables(spark, sf_dir)[0], CFG).select("number")


@query("SELECT c_custkey AS number FROM customer WHERE c_custkey%3<>0 AND c_custkey>0")
def content_change_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    issues = customers.select(F.lit("org/app").alias("repo"), F.col("c_custkey").alias("number"), F.col("c_name").alias("title"), F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("body"), F.array(F.lit("bug")).alias("labels"))
    old = issues.withColumn("body", F.when(F.col("number") % 3 == 1, F.concat("body", F.lit(" edited"))).otherwise(F.col("body"))).where("number % 3 <> 2")
    ledger = IS.changed_issues(old, old.select(F.lit("").alias("task_id"), F.lit(0).alias("at")), CFG, SCAN).select("task_id", F.lit(SCAN - 60).alias("at"))
    return IS.changed_issues(issues, ledger, CFG, SCAN).select("number")


def _old_body(signal):
    """The body of an issue that was filed before there were markers, with the advice for a signal."""
    row = F.array(F.struct(F.lit("2024-01-05T0000").alias("label"), F.lit(7).cast("bigint").alias("fails"), F.lit(9).cast("bigint").alias("total")))
    return I.detail_body(F.lit("open"), F.lit(signal), F.lit("svc"), row, F.array(F.lit("audit event id=1")), F.col("dedup_key"), F.col("fingerprint"), F.col("incident_id"))


def _drop_tables(spark, sf_dir):
    n = F.col("c_custkey")
    v = n % 14
    base = spread(table(spark, sf_dir, "customer")).where("c_custkey > 0").select(n, F.lpad(F.lower(F.hex(F.pmod(n * 2654435761, F.lit(1 << 32)))), 8, "0").alias("fingerprint"), F.lit("org/app").alias("repo"))
    named = base.withColumn("incident_id", F.concat("fingerprint", F.lit("-2024-01-05T0000"))).withColumn("dedup_key", F.concat(F.lit("stability-issue/open/"), "fingerprint", F.lit("/2024-01-05T0000"))).withColumn("title", F.concat(F.lit("[stability] error spike: svc (fp:"), "fingerprint", F.lit(")")))
    marker = IS.provenance_marker(F.col("repo"), F.when(v == 7, "another title").otherwise(F.col("title")))
    labels = F.array_union(F.array(F.lit("stability"), F.lit("autodev:enabled"), F.lit("severity:high"), F.lit("signal:error-spike")), F.when(v == 3, F.array(F.lit("x"))).otherwise(F.array(F.lit("autodev:blocked"))))
    labels = F.when(v == 4, F.concat(labels, F.array(F.lit("stability")))).when(v == 5, F.concat(labels, F.array(F.lit("muted")))).otherwise(labels)
    issues = named.select(
        "repo", n.alias("number"), "title", F.when(v == 11, "no marker").when(v == 12, _old_body("error-spike")).when(v == 13, _old_body("flapping")).otherwise(IS.with_provenance(F.lit("text\n\n---\nfooter"), marker)).alias("body"), F.when(v == 1, "closed").otherwise("open").alias("state"), F.when(v == 2, "someone").otherwise("bot").alias("author"), labels.alias("labels"),
        F.when(v == 6, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("bot"))).alias("assignees"), F.lit("").alias("created_at"), F.lit(False).alias("is_pull_request"),
    )
    proposal = F.concat(F.lit("workflow/issue/org/app/"), n)
    version = F.concat(proposal, F.lit("/v1/loop/2"))
    state = F.concat(F.lit('<!-- workflow:state:v1 proposal="'), proposal, F.lit('" state="blocked" version="'), version, F.lit('" stage_rank="800" marker_order_key="0002" -->'))
    of = F.when(v == 10, F.concat(F.lit("consensus:other/"), version)).otherwise(F.concat(F.lit("consensus:"), version))
    drop = F.concat(F.lit('<!-- workflow:reconcile:v1 proposal="'), proposal, F.lit('" version="'), of, F.lit('" round="2" action="drop" terminal_cause="stale" dedup="reconcile:'), of, F.lit('" -->'))
    later = F.concat(F.lit('<!-- workflow:state:v1 proposal="'), proposal, F.lit('" state="ready" version="v2" stage_rank="100" marker_order_key="'), F.when(v == 8, "0003").when(v == 9, "0002").otherwise("0001"), F.lit('" -->'))
    comment = lambda i, body: named.select("repo", n.alias("number"), (n * 10 + i).alias("id"), F.lit("bot").alias("author"), body.alias("body"), F.lit("2024-01-06T00:00:00Z").alias("created_at"))
    return issues, comment(1, F.concat(state, F.lit("\n"), drop)).unionByName(comment(2, later))


@query("""SELECT c_custkey AS number,(['close','issue-not-open','issue-author-untrusted','required-labels','duplicate-label','muted','issue-claim-untrusted','audit-provenance-checksum','drop-not-current','state-marker-order-ambiguous','drop-lineage-mismatch','audit-provenance-legacy','close','audit-provenance-legacy'])[(c_custkey%14)::INT+1] AS reason FROM customer WHERE c_custkey>0""")
def drop_close_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, comments = _drop_tables(spark, sf_dir)
    return D.drop_close(issues, comments, "bot", CFG).select("number", "reason")


# --- report ------------------------------------------------------------------------------------------------------------


@query(f"""SELECT event_id,CASE WHEN event_id%6 IN (0,1,2) THEN {ISSUE_FP} END AS fp,CASE WHEN event_id%6=0 THEN 'filed' WHEN event_id%6=1 THEN 'skip' WHEN event_id%6=2 THEN 'outbound' WHEN event_id%6=3 THEN 'probe' WHEN event_id%6=4 THEN 'budget' END AS action,CASE WHEN event_id%6=0 THEN event_id END AS number,CASE WHEN event_id%6=1 THEN 'muted' END AS reason,CASE WHEN event_id%6=3 THEN 'all is well' END AS detail FROM events WHERE event_id%6<>5""")
def issue_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp, n, v = _issue_fp(), F.col("event_id").cast("string"), F.col("event_id") % 6
    head = F.concat(F.lit("TIMESTAMP=2024-01-01T00:00:00Z LEVEL=info MSG=issues dept=file "))
    line = F.concat(head, F.when(v == 0, F.concat(F.lit("ISSUE_FILED kind=open fp="), fp, F.lit(" number="), n, F.lit(" url=https://x/y/z/issues/"), n)).when(v == 1, F.concat(F.lit("ISSUE_SKIP kind=open fp="), fp, F.lit(" reason=muted")))
        .when(v == 2, F.concat(F.lit("ISSUE_OUTBOUND mode=dry-run kind=open fp="), fp, F.lit(" severity=high signal=error-spike repo=a/b title='[stability] x y'"))).when(v == 3, "ISSUE_PROBE kind=auth ok=1 detail=all is well")
        .when(v == 4, "ISSUE_BUDGET_EXCEEDED scope=day used=5 cap=5").otherwise("ISSUE_FILED kind=open fp=zz number=x"))
    rows = R.facts(spread(_events(spark, sf_dir)).select("event_id", line.alias("line")), R.issue_line)
    return rows.select("event_id", "i.fp", "i.action", "i.number", "i.reason", "i.detail")


@query(f"""WITH c AS (SELECT user_id%3 AS s,{ISSUE_FP} AS fp,event_id,user_id FROM events) SELECT fp,arg_max('s'||((event_id+1)%4),event_id) AS state,count(*) AS transitions,arg_max(event_id%10,event_id) AS fails FROM c GROUP BY fp""")
def incident_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    line = F.concat(F.lit("MSG=sentinel INCIDENT fp="), _issue_fp(), F.lit(" signal=error-spike state=s"), n % 4, F.lit("->s"), (n + 1) % 4, F.lit(" fails="), n % 10, F.lit(" total=12 buckets=6-covered"))
    rows = R.facts(spread(_events(spark, sf_dir)).select(n.alias("epoch"), line.alias("line")), R.incident_line).select("epoch", "i.*")
    return R.latest_incidents(rows, ["epoch"]).select("fp", "state", "transitions", "fails")


@query("""SELECT event_id,CASE event_id%5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS failed FROM events""")
def log_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("event_id") % 5
    text = F.when(v == 0, "timeout=600 EXIT=0 inside\nEXIT=1\nELAPSED_MS=3").when(v == 1, "action=x.failed ERROR_CLASS=none\nEXIT=2\nEXIT=0").when(v == 2, "[framework] pipeline failed: x\nEXIT=0").when(v == 3, "tag=DEAD_LETTER\nEXIT=0").otherwise("still running")
    file = F.when(v == 3, "watcher.dead_letter-1700000000.log").otherwise("watcher.collect-1700000000.log")
    return _events(spark, sf_dir).select("event_id", file.alias("file"), text.alias("text")).select("event_id", G.log_failed("file", "text").alias("failed"))


@query("""SELECT event_id, replace(replace(replace(replace(replace(event_type||' '||props,'{','%7B'),'}','%7D'),'"','%22'),':','%3A'),' ','%20') AS encoded, true AS same FROM events""")
def percent_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat_ws(" ", "event_type", "props")
    return _events(spark, sf_dir).select("event_id", S.percent_encode(value).alias("encoded"), (S.percent_decode(S.percent_encode(value)) == value).alias("same"))


# queries of other modules register themselves
from . import contract_queries, log_queries  # noqa: E402, F401
