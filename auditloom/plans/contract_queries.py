"""Queries on contracts, outboxes, redaction, checksums, texts and streams, each with the DuckDB text it equals."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction as RD
from ..functions import scalars as S
from ..operators import alerts as A
from ..operators import findings as FI
from ..operators import gates as G
from ..operators import incidents as I
from ..operators import issues as IS
from ..operators import outbox as O
from ..operators import snapshots as SN
from ..operators import stability as ST
from ..sources import adapter as AD
from ..sources import audit as AU
from ..sources.adapter import table
from ..sources.staging import parquet_or_none, shared_folder, spread, staged
from ..streaming import jobs as J
from .queries import CFG, EV, ISSUE_FP, MACHINE, ORACLE_SQL, READ_EVENTS, REC, SCAN, TICKS, _candidates, _events, _issue_fp, _issue_tables, _keyed_alerts, _pages, _records, _repeating, djb2_sql, query

# --- contracts ---------------------------------------------------------------------------------------------------------


@query("""SELECT event_id,CASE event_id%6 WHEN 1 THEN 'checksum-mismatch' WHEN 3 THEN CASE WHEN event_id%12=3 THEN NULL ELSE 'missing-content' END WHEN 4 THEN 'unknown-schema' WHEN 5 THEN 'invalid-content' END AS error_class,CASE WHEN event_id%12=3 THEN 'stored '||event_id WHEN event_id%6=3 THEN NULL WHEN event_id%6=5 THEN '' ELSE 'line '||event_id END AS content FROM events""")
def batch_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    v = n % 6
    content = F.when(v == 5, "").otherwise(F.concat(F.lit("line "), n))
    schema = F.when(v == 2, "watcher.batch.v2").when(v == 3, "watcher.batch.v1").when(v == 4, "watcher.batch.v9").otherwise("watcher.batch.v3")
    checksum = F.when(v == 1, "0").when(v == 2, S.djb2("content").cast("string")).otherwise(F.sha2("content", 256))
    made = _events(spark, sf_dir).select("event_id", F.concat(F.lit("b-"), n).alias("batch_id"), schema.alias("schema"), content.alias("content")).withColumn("content_checksum", checksum)
    store = _events(spark, sf_dir).where("event_id % 12 = 3").select(F.concat(F.lit("b-"), "event_id").alias("batch_id"), F.concat(F.lit("stored "), "event_id").alias("content"))
    return G.with_content(made, store).select("event_id", "error_class", "content")


def _alerts(spark, sf_dir):
    """Alerts of eight kinds, most of them broken in one way."""
    n = F.col("event_id")
    v, repo = n % 8, F.when(n % 8 >= 5, "org/r0")
    filed = v.isin(5, 6)
    address = F.concat(F.lit("https://github.com/org/r0/issues/"), n)
    key = F.when(v == 5, F.concat(F.lit("issue-alert/issue-filed/org/r0/"), n)).otherwise(F.concat(F.lit("k-"), n))
    return _events(spark, sf_dir).where("event_id > 0").select(
        "event_id", F.when(v == 4, "other").otherwise("alerts.alert.v1").alias("schema"), F.when(v == 1, "urgent").otherwise("HIGH").alias("severity"), F.when(v == 2, "").when(filed, "issue-filed").otherwise("auth").alias("category"),
        F.when(v == 3, F.repeat(F.lit("é"), 601)).otherwise("summary").alias("summary"), F.when(v != 7, "evidence").alias("evidence"), F.lit("look").alias("action"), F.when(filed, address).otherwise("/var/log/a").alias("source_path"), F.lit(None).cast("string").alias("batch_id"),
        key.alias("dedup_key"), F.when(filed, repo).alias("repo"), F.when(filed, n.cast("string")).alias("issue_number"), F.when(filed, address).alias("issue_url"),
    )


@query("""SELECT event_id,(['invalid-severity','invalid-category','invalid-summary','unknown-schema',NULL,'invalid-issue-filed-alert','invalid-evidence'])[(event_id%8)::INT] AS error_class FROM events WHERE event_id>0 AND event_id%8 NOT IN (0,5)""")
def alert_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.quarantine(_alerts(spark, sf_dir), G.alert_error())[1].select("event_id", "error_class")


OUTBOX = "WITH a AS (SELECT event_id,event_id%8=5 AS filed,event_id%3=0 OR (event_id%3=1 AND event_id%8=5) AS live,CASE WHEN event_id%8=5 THEN 'issue-alert/issue-filed/org/r0/' ELSE 'k-' END||event_id AS dedup_key FROM events WHERE event_id>0 AND event_id%8 IN (0,5))"


def _outbox(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    n = F.col("event_id") % 3
    ledger = alerts.where(n < 2).select("dedup_key", F.when(n == 0, SCAN - 100).otherwise(SCAN - 172_800).cast("long").alias("sent_at"), (F.col("event_id") % 8 == 5).alias("filed"))
    return A.outbox(alerts, ledger, SCAN, writing=True)


@query(f"{OUTBOX} SELECT dedup_key,CASE WHEN live THEN 'duplicate' ELSE 'real' END AS mode FROM a")
def alert_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outbox(spark, sf_dir)[0].select("dedup_key", "mode")


@query(f"{OUTBOX}, l AS (SELECT CASE WHEN event_id%8=5 THEN 'issue-alert/issue-filed/org/r0/' ELSE 'k-' END||event_id AS dedup_key,CASE WHEN event_id%3=0 THEN {SCAN}-100 ELSE {SCAN}-172800 END AS sent_at FROM events WHERE event_id>0 AND (event_id%3=0 OR (event_id%3=1 AND event_id%8=5))), m AS (SELECT dedup_key FROM a WHERE NOT live OR filed) SELECT dedup_key,{SCAN}::BIGINT AS sent_at FROM m UNION ALL SELECT dedup_key,sent_at::BIGINT FROM l WHERE dedup_key NOT IN (SELECT dedup_key FROM m)")
def alert_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outbox(spark, sf_dir)[1].select("dedup_key", "sent_at")


FILED = f"""f AS (SELECT event_id,'org/r'||(user_id%3) AS repo,{ISSUE_FP} AS fp,strftime(ts,'%Y-%m-%d') AS day,CASE WHEN event_id%53=0 THEN 'urgent' ELSE 'high' END AS severity FROM events WHERE event_type='error' AND event_id>0 AND event_id%3<>0),
 fa AS (SELECT *,'issue-alert/issue-filed/'||repo||'/'||event_id AS k,'https://github.com/'||repo||'/issues/'||event_id AS url,'[stability] error spike: x (fp:'||fp||')' AS title,'fp:'||fp||' '||fp||'-'||day AS evidence FROM f)"""


@query(f"""WITH {FILED}, h AS (SELECT *,sha256('alerts:issue-filed:v1'||chr(31)||k) AS s FROM fa) SELECT k AS dedup_key,url AS issue_url,'severity: '||severity||chr(10)||'category: issue-filed'||chr(10)||'summary: '||title||chr(10)||'evidence: '||evidence||chr(10)||'action: Review the issue.'||chr(10)||'source: '||url||chr(10)||'key: '||k||chr(10)||'a: 1'||chr(10)||'b: 2' AS body,
 '{{"header":{{"title":"'||upper(severity)||' issue-filed","colour":"'||CASE severity WHEN 'high' THEN 'orange' ELSE 'grey' END||'"}},"sections":[{{"title":"what","text":"'||title||'"}},{{"title":"evidence","text":"'||evidence||'"}},{{"title":"what to do","text":"Review the issue."}},{{"title":"source","text":"'||url||'"}}],"key":"'||k||'"}}' AS card,
 substr(s,1,8)||'-'||substr(s,9,4)||'-8'||substr(s,14,3)||'-a'||substr(s,18,3)||'-'||substr(s,21,12) AS message_id FROM h""")
def filed_alert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = O.finalize(_issue_tables(spark, sf_dir)[0].where("arrival > 0 and arrival % 3 <> 0").withColumn("number", F.col("arrival")))
    told = A.filed_alerts(final).withColumn("extras", F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))
    return told.select("dedup_key", "issue_url", A.text_body("extras").alias("body"), A.card_json().alias("card"), A.message_id().alias("message_id"))


@query(f"""WITH l AS (SELECT DISTINCT CASE WHEN event_id%2=0 THEN 'd-'||event_id ELSE {ISSUE_FP} END AS k,user_id%5 AS c FROM events) SELECT 'dead-letter/analyzer/'||{djb2_sql("k")} AS dedup_key,'analyzer dropped a delivery: class-'||c AS summary,'it broke at '||c AS evidence FROM l""")
def dead_letter_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    klass = (F.col("user_id") % 5).cast("string")
    letters = _events(spark, sf_dir).select(F.concat(F.lit("d-"), "event_id").alias("delivery_id"), F.when(F.col("event_id") % 2 == 0, "").otherwise(_issue_fp()).alias("fingerprint"), F.concat(F.lit("class-"), klass).alias("error_class"), F.concat(F.lit(" it  broke\n\tat "), klass, F.lit(" ")).alias("why"))
    return A.dead_letter_alerts(letters, "analyzer").select("dedup_key", "summary", "evidence")


@query(f"WITH {REC} SELECT id,action,event_id::VARCHAR AS \"httpStatus\",'' AS dependency,'Yes' AS outcome,'' AS stage FROM rec")
def projected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _records(spark, sf_dir).select(F.col("id").alias("Id"), "action", F.col("event_id").alias("HttpStatus"), F.struct("event_id").alias("dependency"), F.lit("Yes").alias("Outcome"), F.lit("x").alias("other"))
    return AD.project_fields(raw).select("id", "action", "httpStatus", "dependency", "outcome", "stage")


# --- findings ----------------------------------------------------------------------------------------------------------


def _digest(frames):
    for frame in frames:
        yield frame.assign(output=[hashlib.sha256(p.encode()).hexdigest() for p in frame["prompt"]])[["batch_id", "output"]]


@query(f"""WITH b AS (SELECT event_id//10 AS k,string_agg('line '||event_id,chr(10) ORDER BY event_id) AS content FROM events GROUP BY 1)
 SELECT 'b-'||k AS batch_id,CASE WHEN k%4=0 THEN 'cached' ELSE sha256('{FI.task()}'||chr(10)||'-----BEGIN LINES-----'||chr(10)||content||chr(10)||'-----END LINES-----') END AS output FROM b""")
def scored_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 10).alias("k")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.lit("line "), "event_id").alias("line")))).alias("l"))
    made = rows.select("k", F.concat(F.lit("b-"), "k").alias("batch_id"), F.array_join("l.line", "\n").alias("content"))
    cached = made.where("k % 4 < 2").select("batch_id", F.lit("cached").alias("output"), F.when(F.col("k") % 4 == 0, SCAN - 60).otherwise(SCAN - 86_400).alias("at"))
    return FI.score(made.select("batch_id", "content"), _digest, cached, SCAN)


# --- issues ------------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {TICKS}, {MACHINE}, last AS (SELECT max(bucket) AS b FROM st), n AS (SELECT * FROM st WHERE bucket=(SELECT b FROM last)), p AS (SELECT fp,state FROM st WHERE bucket=(SELECT b-1 FROM last))
 SELECT n.fp,coalesce(p.state,'none') AS from_state,n.fired,n.state,n.opened AS open_bucket,n.cnt AS quiet_count,n.action,n.state NOT IN ('none','closed') AS live FROM n LEFT JOIN p USING (fp) WHERE n.state<>'none' OR coalesce(p.state,'none')<>'none'""")
def newest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan as the detector makes it: tracked incidents of the bucket before meet what fires in the newest one."""
    rules = _candidates(spark, sf_dir)
    last = rules.agg(F.max("bucket")).first()[0]
    before = I.timeline(I.ticks_of(rules.where(F.col("bucket") < last), CFG), CFG).where((F.col("seq") == last - 1) & (F.col("state") != "none"))
    keys = rules.select("fp", "signal", *ST.GROUP).distinct()
    tracked = before.select("fp", "state", "open_bucket", "last_fired_tick", "quiet_count", "last_quiet_bucket").join(keys, "fp")
    newest = rules.where(F.col("bucket") == last)
    quiet = newest.groupBy(*ST.GROUP).agg(F.bool_and("quiet_ok").alias("quiet_ok"))
    label = newest.select(S.bucket_label(F.col("bucket"), CFG.bucket_seconds).alias("b")).first()[0]
    ticks = I.join_tick(newest.where("fired").select("fp", "signal", *ST.GROUP), tracked, quiet, label)
    moved = staged(I.advance(ticks, str(last), CFG, SCAN), "scan")
    index = I.next_index(tracked.select("fp"), moved).withColumn("live", F.lit(True))
    return moved.join(index, "fp", "left").select("fp", "from_state", "fired", "state", "open_bucket", "quiet_count", "action", F.coalesce("live", F.lit(False)).alias("live"))


@query(f"""WITH RECURSIVE {TICKS}, {MACHINE} SELECT fp,bucket AS seq FROM st WHERE state='open' AND fired AND bucket%3=0""")
def reemitted_opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = I.timeline(I.ticks_of(_candidates(spark, sf_dir), CFG), CFG).withColumn("now", F.col("seq") * 86_400)
    emitted = told.withColumn("last_emit", F.when(F.col("seq") % 3 == 0, F.col("now") - I.REEMIT_SECONDS).otherwise(F.col("now") - I.REEMIT_SECONDS + 1))
    return I.reemit_opens(emitted, F.col("now")).select("fp", "seq")


@query("""SELECT 'org/r'||(event_id%3) AS repo,'d-'||event_id AS dedup_key,CASE event_id%5 WHEN 0 THEN event_id END AS number,(['recovered','none','ambiguous','provenance-author-mismatch','none'])[(event_id%5)::INT+1] AS recovery FROM events WHERE event_type='error'""")
def recovered_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    v = n % 5
    reserved = _events(spark, sf_dir).where("event_type = 'error'").select(
        "event_id", F.concat(F.lit("org/r"), n % 3).alias("repo"), F.concat(F.lit("title "), n).alias("title"), _issue_fp().alias("fingerprint"), F.concat(F.lit("i-"), n).alias("incident_id"), F.concat(F.lit("d-"), n).alias("dedup_key"),
        F.lit("flapping").alias("signal"), F.lit("medium").alias("severity"), F.lit("1").alias("devloop_enabled"),
    )
    body = F.when(v == 4, "no marker").otherwise(IS.with_provenance(F.lit("text\n\n---\nfoot"), IS.provenance_marker(F.col("repo"), F.col("title"))))
    made = reserved.where(v != 1).select("repo", "title", n.alias("number"), body.alias("body"), F.when(v == 3, "someone").otherwise("bot").alias("author"), IS.labels(CFG).alias("labels"))
    twice = made.where("number % 5 = 2").withColumn("number", F.col("number") + 10_000_000)
    return IS.recover_created(reserved.drop("event_id"), made.unionByName(twice), CFG, "bot")


@query(f"""WITH r AS (SELECT event_id,{ISSUE_FP} AS fp,'org/r'||(user_id%3) AS repo,strftime(ts,'%Y-%m-%d') AS day,CASE event_id%5 WHEN 3 THEN 'comment' WHEN 4 THEN 'close' ELSE 'open' END AS kind,CASE WHEN event_id%53=0 THEN 'urgent' ELSE 'high' END AS severity FROM events WHERE event_type='error'),
 t AS (SELECT *,'[stability] error spike: x (fp:'||fp||')' AS title,fp||'-'||day AS incident,'stability-issue/'||kind||'/'||fp||'/'||event_id AS k FROM r), c AS (SELECT *,{djb2_sql("(repo||chr(31)||fp||chr(31)||incident||chr(31)||k||chr(31)||title)")} AS sum FROM t)
 SELECT event_id AS arrival,to_json({{'title':title,'body':'body'||chr(10)||chr(10)||'<!-- issues:file:v1 repo="'||replace(repo,'/','%2F')||'" fingerprint="'||fp||'" incident="'||incident||'" dedup="'||replace(k,'/','%2F')||'" request_checksum="'||sum||'" -->','labels':['stability','signal:error-spike','severity:'||severity]}})::VARCHAR AS json FROM c""")
def issue_jsons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issue_tables(spark, sf_dir)[0].select("arrival", IS.issue_json(CFG).alias("json"))


@query("SELECT user_id,min(event_id) AS arrival FROM events GROUP BY user_id ORDER BY arrival DESC,user_id LIMIT 50")
def newest_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IS.capped_distinct(_events(spark, sf_dir).select("user_id", F.col("event_id").alias("arrival")), "user_id", 50, keep_newest=True)


@query("SELECT event_id AS arrival,CASE event_id%5 WHEN 3 THEN 'comment' WHEN 4 THEN 'close' ELSE 'open' END AS kind FROM events WHERE event_type='error' ORDER BY CASE event_id%5 WHEN 4 THEN 0 WHEN 3 THEN 2 ELSE 1 END,event_id LIMIT 400")
def first_to_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IS.reconcile_order(_issue_tables(spark, sf_dir)[0]).select("arrival", "kind").limit(400)


@query("""WITH d AS (SELECT repo,day,scope,cap FROM (SELECT 'org/r'||(event_id%3) AS repo,strftime(ts,'%Y-%m-%d') AS day,CASE WHEN event_id%2=0 THEN 'day' ELSE 'open' END AS scope,CASE WHEN event_id%2=0 THEN 5 ELSE 20 END AS cap FROM events WHERE event_id%4<2) GROUP BY ALL) SELECT 'issue-alert/budget/'||scope||'/'||repo||'/'||day AS dedup_key,cap FROM d""")
def budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    decided = _events(spark, sf_dir).select(F.concat(F.lit("org/r"), n % 3).alias("repo"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(n % 4 >= 2, "muted").when(n % 2 == 0, "budget-day").otherwise("budget-open").alias("reason"))
    return IS.budget_alerts(decided, CFG).select("dedup_key", "cap")


def truncated_sql(text: str, limit: int) -> str:
    """The longest prefix of at most ``limit`` bytes: one of the lengths that are left when extra bytes are taken off."""
    return f"CASE WHEN strlen({text})<={limit} THEN {text} ELSE left({text},coalesce(list_max(list_filter(range(greatest(0,{limit}-(strlen({text})-length({text}))),{limit}+1), lambda k: strlen(left({text},k::BIGINT))<={limit})),0)::BIGINT) END"


@query(f"SELECT doc_id,{truncated_sql('t', 90)} AS cut,CASE WHEN strlen(t)<=90 THEN t ELSE ({truncated_sql('t', 90)})||'…' END AS marked FROM (SELECT doc_id,coalesce(text,'') AS t FROM documents)")
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.truncate_bytes("text", 90).alias("cut"), S.truncate_marked("text", 90).alias("marked"))


@query(f"SELECT doc_id,sha256('org/app#'||doc_id||chr(10)||chr(10)||{truncated_sql('t', 400)}||chr(10)||chr(10)||{truncated_sql('t', 60_000)}) AS sha FROM (SELECT doc_id,coalesce(text,'') AS t FROM documents)")
def task_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "documents").select(F.lit("org/app").alias("repo"), F.col("doc_id").alias("number"), F.coalesce("text", F.lit("")).alias("title")).withColumn("body", F.col("title"))
    return tasks.select(F.col("number").alias("doc_id"), F.sha2(IS.task_text(), 256).alias("sha"))


FNV = "lpad((list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(t,''), lambda c: ord(c)::HUGEINT)), lambda h, b: (h*16777619+b)%4294967291))::VARCHAR,10,'0')"


@query(f"""WITH e AS (SELECT event_id,event_type||' '||props AS t,sha256(event_type||' '||props) AS s,event_id%4 AS v FROM events) SELECT event_id,{FNV} AS fnv,substr(s,1,8)||'-'||substr(s,9,4)||'-8'||substr(s,14,3)||'-a'||substr(s,18,3)||'-'||substr(s,21,12) AS uuid,('0x'||substr(s,1,12))::BIGINT AS number,CASE v WHEN 0 THEN event_id WHEN 1 THEN event_id END AS issue,v IN (0,2) AS success FROM e""")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, value = F.col("event_id"), F.concat_ws(" ", "event_type", "props")
    v = n % 4
    url = F.concat(F.lit("https://github.com/o/"), F.when(v == 2, "issues/").otherwise("r/issues/"), n.cast("string"), F.when(v == 1, "/").when(v == 3, "x").otherwise(""))
    status = F.when(v == 0, "200").when(v == 1, "2000").when(v == 2, "204").otherwise("404")
    return _events(spark, sf_dir).select("event_id", S.fnv_decimal(value).alias("fnv"), S.stable_uuid(value).alias("uuid"), S.sha_number(value).alias("number"), S.issue_number(url).alias("issue"), S.is_success_status(status).alias("success"))


# --- redaction ---------------------------------------------------------------------------------------------------------

N = "event_id::VARCHAR"
#: Lines that meet one rule each, and what the log and the outbound rules make of them: text parts around the event's number.
CASES = (
    (("login passwd: s3cr", " and more"), ("login passwd: ***",), ("login passwd: s3cr", " and more")),
    (('{"client_secret":"a\\"b', '","k":2}'), ('{"client_secret":"***","k":2}',), ('{"client_secret":"***","k":2}',)),
    (('warn {"webhook_list":[', "]} tail"), ('warn {"webhook_list":"***"',), ('warn {"webhook_list":[', "]} tail")),
    (("zone= region= part=", ""), ("zone=- region=- part=", ""), ("zone= region= part=", "")),
    (("pull ftp://ann:pw", "@files.test/x"), ("pull ftp://files.test/x",), ("pull ftp://files.test/x",)),
    (("used AKIAABCDEF", "ZZ now"), ("used ***access-key*** now",), ("used AKIAABCDEF", "ZZ now")),
    (("then bearer tok", " left"), ("then Bearer *** left",), ("then Bearer *** left",)),
    (("saw gho_zz", "q here"), ("saw ***github-token*** here",), ("saw ***github-token*** here",)),
    (("sum ab12cd34" + "ef56ab78" * 4, " ok"), None, None),
    (("jwt eyJhbGci.eyJzdWIi.c2ln", " done"), ("jwt ***jwt*** done",), ("jwt ***jwt*** done",)),
    (("author=ann", " plain words"), ("author=ann", " plain words"), ("author=*** plain words",)),
    (("DEPLOY_SECRET='qwerty", "' rest"), ("DEPLOY_SECRET=***",), ("DEPLOY_SECRET='***' rest",)),
)


def _expected(side: int) -> str:
    quoted = lambda parts: "||".join(f"'{p.replace(chr(39), chr(39) * 2)}'" for p in parts).replace("||", f"||{N}||", 1)
    whens = []
    for i, case in enumerate(CASES):
        parts = case[side]
        if parts is None:
            whens.append(f"WHEN {i} THEN 'sum ab12cd34{'...' if side == 1 else '…'} ok'")
        else:
            whens.append(f"WHEN {i} THEN {quoted(parts)}")
    return f"CASE event_id%{len(CASES)} {' '.join(whens)} END"


def _case_lines(spark, sf_dir):
    n = F.col("event_id")
    line = F.lit("")
    for i, (parts, *_) in enumerate(CASES):
        made = F.concat(F.lit(parts[0]), F.lit("") if "ab12cd34" in parts[0] else n.cast("string"), F.lit(parts[1]))
        line = F.when(n % len(CASES) == i, made).otherwise(line)
    return spread(_events(spark, sf_dir)).select("event_id", line.alias("line"))


@query(f"SELECT event_id,{_expected(1)} AS log_line,{_expected(2)} AS outbound,true AS same FROM events")
def redaction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = _case_lines(spark, sf_dir).select("event_id", RD.mask_log_line("line").alias("log_line"), RD.redact_outbound("line", shortened=()).alias("outbound"))
    return once.withColumn("same", (RD.mask_log_line("log_line") == F.col("log_line")) & (RD.redact_outbound("outbound", shortened=()) == F.col("outbound")))


@query(f"""SELECT event_id,'id='||left('job-'||{N}||'-x',8)||'... actor='||CASE WHEN length('a'||{N})>8 THEN left('a'||{N},8)||'...' ELSE 'a'||{N} END||' resource=queue/orders-e...' AS log_line,'id='||left('job-'||{N}||'-x',8)||CASE WHEN length('job-'||{N}||'-x')>8 THEN '…' ELSE '' END||' ticket ***' AS outbound FROM (SELECT event_id+10000 AS event_id FROM events)""")
def shortened_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") + 10_000).cast("string")
    log = F.concat(F.lit("id=job-"), n, F.lit("-x actor=a"), n, F.lit(" resource=queue/orders-eu-west"))
    out = F.concat(F.lit("id=job-"), n, F.lit("-x ticket no"), n)
    return spread(_events(spark, sf_dir)).select((F.col("event_id") + 10_000).alias("event_id"), RD.redact_log_line(log).alias("log_line"), RD.redact_outbound(out, ("no[0-9]+", "(.*)")).alias("outbound"))


@query("""SELECT event_id,event_id%6 IN (0,1,2) AS exact,event_id%6 IN (0,1,2,3) AS inside FROM events""")
def sensitive_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("X-Api_Key-", "my.Pass_Word.", "AUTH", "author", "toke.x", "plain")
    n = F.col("event_id") % 6
    key = F.concat(F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int")), F.when(n.isin(0, 1), F.col("event_id").cast("string")).otherwise(""))
    return _events(spark, sf_dir).select("event_id", key.alias("k")).select("event_id", RD.is_sensitive_key("k").alias("exact"), RD.is_sensitive_key("k", "inside").alias("inside"))


# --- streams -----------------------------------------------------------------------------------------------------------


def _streamed(spark, sf_dir):
    """The driver's events as a stream."""
    rows = _events(spark, sf_dir)
    return spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _place(spark, name):
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/auditloom/{name}-{uuid.uuid4().hex}"


@query(f"WITH {EV}, mx AS (SELECT max(ep) AS top FROM ev) SELECT family,scope,rtype,bucket,attempt,count(*) FILTER (failed) AS fails,count(*) AS total FROM ev GROUP BY ALL HAVING (bucket+1)*86400<=(SELECT top-7200 FROM mx)")
def streamed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _place(spark, "buckets")
    J.write_stream(J.bucket_stream(AD.audit_records(_streamed(spark, sf_dir)), CFG), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(f"WITH {REC} SELECT id,action FROM rec")
def streamed_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = AD.audit_records(_streamed(spark, sf_dir)).withColumn("source_id", F.lit("trail"))
    out = _place(spark, "unseen")
    J.write_stream(J.unseen_stream(records.unionByName(records)), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("id", "action")


@query(f"WITH RECURSIVE {TICKS} SELECT t0.signal,family,scope,rtype,bucket,fired,q AS quiet_ok FROM t0 WHERE signal<>'pipeline-dead-letter' AND bucket=(SELECT max(bucket) FROM t0 WHERE signal='flapping') AND (family,scope,rtype) IN (SELECT family,scope,rtype FROM ev WHERE NOT attempt AND bucket>(SELECT max(bucket) FROM ev)-8)")
def streamed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _place(spark, "scan")
    J.scan_job(AD.audit_records(_streamed(spark, sf_dir)), out, f"{out}-state", CFG).awaitTermination()
    return spark.read.parquet(f"{out}/candidates").select("signal", *ST.GROUP, "bucket", "fired", "quiet_ok")


@query(ORACLE_SQL["issue_decisions"].replace("WHERE event_id%11=0", "WHERE false"))
def streamed_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, issues, _ = _issue_tables(spark, sf_dir)
    requests = _repeating(requests)
    out = _place(spark, "decisions")
    requests.write.parquet(f"{out}/requests")
    J.issues_job(spark.readStream.schema(requests.schema).parquet(f"{out}/requests"), f"{out}/told", f"{out}/state", lambda: issues, CFG.but(max_open=120)).awaitTermination()
    return spark.read.parquet(f"{out}/told/decisions").select("arrival", "kind", "reason")


@query(f"""WITH RECURSIVE {TICKS}, {MACHINE}, k2 AS (SELECT fp,signal,family,scope,rtype FROM k) SELECT fp,signal,family,scope FROM st JOIN k2 USING (fp) WHERE fired ORDER BY family||'|'||scope||'|'||rtype,signal,bucket LIMIT 200""")
def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.candidate_order(_candidates(spark, sf_dir).where("fired")).select("fp", "signal", "family", "scope").limit(200)


@query(f"WITH {REC} SELECT id,outcome FROM rec ORDER BY tm DESC,id DESC LIMIT 1000")
def streamed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _place(spark, "snapshot")
    J.snapshot_job(AD.audit_records(_streamed(spark, sf_dir)).withColumn("arrival", F.col("event_id")), out, f"{out}-state", CFG).awaitTermination()
    return SN.current(spark, out).select("id", "outcome")


@query(f"""WITH l AS (SELECT user_id,event_id//{READ_EVENTS} AS part,event_id,event_type FROM events WHERE event_type='error') SELECT '/s/'||user_id||'-'||part AS source_path,event_id||' '||event_type AS line FROM l""")
def streamed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.floor(F.col("event_id") / READ_EVENTS)
    lines = _streamed(spark, sf_dir).select(F.concat(F.lit("/s/"), "user_id", F.lit("-"), part).alias("path"), F.lit(0).cast("long").alias("from_offset"), F.lit(9).cast("long").alias("to_offset"), F.col("event_id").alias("line_no"), F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("line"))
    out = _place(spark, "batches")
    J.batches_job(lines, out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select("source_path", F.explode(F.split("content", "\n")).alias("line"))


def _in_files(spark, name, rows, part, n=3):
    """``rows`` as a stream of n files, one for each value of ``part``, a file a batch."""
    out = _place(spark, name)
    for i in range(n):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(out)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(out)


@query(f"""WITH {REC}, b AS (SELECT ep,CASE WHEN event_id%50=0 THEN 2 ELSE event_id*3//(SELECT max(event_id)+1 FROM events) END AS part FROM rec), m AS (SELECT part,max(max(ep)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM b GROUP BY part)
 SELECT part::INT AS run,ep//86400 AS bucket,count(*) AS late FROM b JOIN m USING (part) WHERE (ep//86400+1)*86400<=mark-7200 GROUP BY ALL""")
def streamed_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in three batches; one of fifty waits for the last."""
    n = F.col("event_id")
    part = F.when(n % 50 == 0, 2).otherwise(F.floor(n * 3 / F.lit(_events(spark, sf_dir).agg(F.max("event_id")).first()[0] + 1)))
    stream = _in_files(spark, "late-in", AD.audit_records(_events(spark, sf_dir)), part)
    out = _place(spark, "late")
    J.late_job(stream, out, f"{out}-state", CFG).awaitTermination()
    return spark.read.parquet(f"{out}/late").select("run", "bucket", "late")


@query(ORACLE_SQL["alerts_suppressed"])
def streamed_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts in three batches in order of time; the state is each key's mark."""
    rows = _keyed_alerts(spark, sf_dir)
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    stream = _in_files(spark, "alerts-in", rows, F.floor((F.col("at") - F.lit(first)) * 3 / F.lit((last or 0) - (first or 0) + 1)))
    out = _place(spark, "suppressed")
    J.write_stream(J.suppressed_stream(stream), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(f"""WITH q AS (SELECT user_id,'org/r'||(user_id%3) AS repo,min(event_id) AS arrival FROM events WHERE event_type='error' AND user_id%4=0 GROUP BY ALL), k AS (SELECT *,arrival%53=0 AS bad,row_number() OVER (PARTITION BY repo,arrival%53=0 ORDER BY arrival) AS n FROM q)
 SELECT run,arrival,CASE WHEN bad THEN 'invalid-severity' WHEN n<=3*(run+1) THEN 'file' ELSE 'budget-day' END AS reason FROM k CROSS JOIN (SELECT unnest([0,1,2])::INT AS run) WHERE CASE WHEN bad THEN run=0 ELSE n>3*run END""")
def streamed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each user without an issue, then two ticks without requests: what waits for the budget is filed by and by, and what is invalid stops nothing."""
    requests, issues, _ = _issue_tables(spark, sf_dir)
    firsts = requests.where("cast(conv(fingerprint, 16, 10) as bigint) is not null").join(_events(spark, sf_dir).where("event_type = 'error' and user_id % 4 = 0").groupBy("user_id").agg(F.min("event_id").alias("arrival")).select("arrival"), "arrival", "left_semi")
    firsts = firsts.withColumn("kind", F.lit("open")).withColumn("day", F.lit("2024-01-01"))
    out = _place(spark, "replay")
    firsts.coalesce(1).write.parquet(f"{out}/requests")
    ticks = _in_files(spark, "ticks", spark.range(3), F.col("id"))

    def now_open() -> DataFrame:
        """The issues, and those that earlier runs have filed."""
        told = parquet_or_none(spark, f"{out}/told/decisions")
        if told is None:
            return issues
        filed = told.where("decision = 'file'").select("repo", (F.col("arrival") + 1_000_000).alias("number"), "title", F.lit("").alias("body"), F.lit("open").alias("state"), F.lit("bot").alias("author"), F.array(F.lit("stability")).alias("labels"), F.array().cast("array<string>").alias("assignees"), F.lit("2024-02-02T00:00:00Z").alias("created_at"), F.lit(False).alias("is_pull_request"))
        return issues.unionByName(filed)

    stream = spark.readStream.schema(firsts.schema).parquet(f"{out}/requests")
    J.issues_job(stream, f"{out}/told", f"{out}/state", now_open, CFG.but(max_per_day=3, max_open=100_000), ticks=ticks, now=lambda: SCAN).awaitTermination()
    return spark.read.parquet(f"{out}/told/decisions").select("run", "arrival", "reason")


@query(f"WITH RECURSIVE {TICKS.replace('t AS (', 'all_t AS (')}, t AS (SELECT * REPLACE (CASE WHEN blind THEN false ELSE fired END AS fired,CASE WHEN blind THEN false ELSE q END AS q,CASE WHEN blind THEN '' ELSE lab END AS lab) FROM (SELECT all_t.*,bucket%3=0 AND signal<>'pipeline-dead-letter' AS blind FROM all_t JOIN k USING (fp))), {MACHINE} SELECT fp,bucket AS seq,fired,q AS quiet_ok,lab AS latest_bucket,state,cnt AS quiet_count,action FROM st WHERE n>0")
def frozen_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third scan's snapshot is broken: nothing recovers in it."""
    told = _candidates(spark, sf_dir)
    ticks = I.ticks_of(told, CFG).join(told.select("fp", "signal").distinct(), "fp")
    scans = told.select(F.col("bucket").alias("seq"), (F.col("bucket") % 3 != 0).alias("valid")).distinct()
    return I.timeline(I.frozen(ticks, scans), CFG).select("fp", "seq", "fired", "quiet_ok", "latest_bucket", "state", "quiet_count", "action")


@query("""WITH p AS (SELECT event_id%37 AS w,event_id//370 AS p,count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *,coalesce(sum(n) OVER (PARTITION BY w ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS taken,row_number() OVER (PARTITION BY w ORDER BY p) AS k FROM p) SELECT 'w-'||w AS window_id,p AS page_no,n::INT AS records FROM c WHERE taken<CASE WHEN w%2=0 THEN 85 ELSE 1000 END AND k<=12""")
def budgeted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages up to 85 records for half of the windows, and up to 12 pages for the others."""
    parsed = AU.parse_pages(_pages(spark, sf_dir))
    even = F.regexp_extract("window_id", r"(\d+)$", 1).cast("int") % 2 == 0
    kept = AU.pages_within_budget(parsed.where(even), records=85).unionByName(AU.pages_within_budget(parsed.where(~even), records=1000))
    return kept.select("window_id", "page_no", F.size("page_records").alias("records"))


@query("""SELECT event_id AS arrival,CASE WHEN event_id%3=0 THEN '' ELSE (event_id+1)::VARCHAR END AS issue_number,CASE WHEN event_id%3=0 THEN 'reserved' ELSE 'finalized' END AS phase,(CASE WHEN event_id%12=1 THEN 1 ELSE 0 END+CASE WHEN event_id%10=7 THEN 1 ELSE 0 END)::BIGINT AS conflicts FROM events WHERE event_type='error'""")
def outbox_change_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set that reserves, finalizes, finalizes again with another number and reserves under another title."""
    requests = _issue_tables(spark, sf_dir)[0].withColumn("number", F.col("arrival") + 1)
    n, numbered = F.col("arrival"), lambda rows, seq: rows.withColumn("seq", F.lit(seq))
    sets = (
        numbered(O.reserve(requests), 0), numbered(O.finalize(requests.where(n % 3 != 0)), 1), numbered(O.finalize(requests.where(n % 12 == 1).withColumn("number", n + 2)), 2),
        numbered(O.reserve(requests.where(n % 10 == 7).withColumn("title", F.lit("another (fp:deadbeef)"))), 3),
    )
    changes = staged(sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(sets[3]), "changes")
    merged, clashes = O.merge(O.reserve(requests.limit(0)), changes)
    told = merged.join(clashes.groupBy("request_dedup_key").agg(F.count(F.lit(1)).alias("conflicts")), "request_dedup_key", "left")
    return told.select(F.element_at(F.split("request_dedup_key", "/"), -1).cast("bigint").alias("arrival"), "issue_number", "phase", F.coalesce("conflicts", F.lit(0).cast("bigint")).alias("conflicts"))
