"""Queries on log files, snapshots, runtime logs and reports, each with the DuckDB text it equals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import gates as G
from ..operators import reports as R
from ..sources import audit as AU
from ..sources import logs as L
from ..sources.adapter import table
from ..sources.staging import shared_folder, staged
from ..sources.tails import Tails
from .queries import ISSUE_FP, READ_EVENTS, REC, _events, _issue_fp, _records, query

# --- files -------------------------------------------------------------------------------------------------------------


FILE_EVENTS = 65_536


def _files(spark, sf_dir):
    """Files on the shared folder, one for each group of users and block of events: a line an event, for some groups a line that is no text, and an incomplete last line.

    Gives ``path, length``, the file's name, group and content without the incomplete line.
    """
    line = F.concat_ws(" ", F.col("event_id").cast("string"), "event_type")
    rows = _events(spark, sf_dir).groupBy((F.col("user_id") % 40).alias("u"), F.floor(F.col("event_id") / FILE_EVENTS).alias("part")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l"))
    odd = F.when(F.col("u") % 5 == 0, F.unhex(F.lit("FF0A"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.concat(F.array_join("l.line", "\n"), F.lit("\n")).cast("binary"), odd)
    rows = staged(rows.select("u", "part", content.alias("content"), (F.length(F.element_at("l", 1)["line"]) + 1).alias("first")), "log-contents")
    folder = f"{shared_folder(spark).rstrip('/')}/auditloom/logs-{uuid.uuid4().hex}"
    whole = F.concat("content", F.lit("not yet").cast("binary")).cast("string").alias("value")
    rows.select("u", "part", whole).write.partitionBy("u", "part").option("lineSep", "~").text(folder)  # a row a file
    found = L.listed(spark, folder).select("*", *(F.regexp_extract("path", rf"/{c}=(\d+)/", 1).cast("long").alias(c) for c in ("u", "part")))
    return found.join(rows, ["u", "part"]).withColumn("name", F.concat(F.lit("/logs/u"), "u", F.lit("-"), "part", F.lit(".log")))


LOG_FILES = f"l AS (SELECT user_id%40 AS u,event_id//{FILE_EVENTS} AS part,event_id,event_id||' '||event_type AS line FROM events)"


@query(f"""WITH {LOG_FILES}, h AS (SELECT u,part,string_agg(line,chr(10) ORDER BY event_id)||chr(10) AS head,length(arg_min(line,event_id))+1 AS first FROM l GROUP BY ALL),
 c AS (SELECT *,head||CASE WHEN u%5=0 THEN chr(65533)||chr(10) ELSE '' END AS whole,'/logs/u'||u||'-'||part||'.log' AS path,CASE WHEN u%4=1 THEN first ELSE 0 END AS f,length(head)+CASE WHEN u%5=0 THEN 2 ELSE 0 END AS t FROM h) SELECT path,f::BIGINT AS from_offset,t AS to_offset,sha256(substr(whole,f+1)) AS chunk_sha,CASE WHEN u%5<>0 THEN 'v2:'||t||':'||sha256(whole) END AS fingerprint FROM c WHERE t>f""")
def log_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    u = F.col("u") % 4
    offset = F.when(u == 1, F.col("first")).when(u == 2, 5).otherwise(1 << 30).cast("long")
    ledger = files.where(u > 0).select("path", offset.alias("offset"), F.when(u == 1, S.rotation_fingerprint(F.col("content"), F.col("first"))).otherwise("v2:5:other").alias("fingerprint"))
    told = L.new_chunks(files, ledger).join(files.select("path", "u", "name"), "path")
    return told.select(F.col("name").alias("path"), "from_offset", "to_offset", S.sha_hex("chunk").alias("chunk_sha"), F.when(F.col("u") % 5 != 0, F.col("fingerprint")).alias("fingerprint"))


@query(f"""WITH {LOG_FILES}, n AS (SELECT u,part,row_number() OVER (PARTITION BY u,part ORDER BY event_id)-1 AS line_no,line FROM l) SELECT '/logs/u'||u||'-'||part||'.log' AS path,line_no,line FROM n
 UNION ALL SELECT '/logs/u'||u||'-'||part||'.log',count(*),chr(65533) FROM l WHERE u%5=0 GROUP BY u,part""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    lines = L.split_lines(L.new_chunks(files, spark.createDataFrame([], L.LEDGER))).join(files.select("path", "name"), "path")
    return lines.select(F.col("name").alias("path"), F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"""WITH {LOG_FILES} SELECT '/logs/u'||u||'-'||part||'.log' AS path,count(*) AS lines,sum(length(line)+1)::BIGINT AS to_offset FROM l WHERE u%5<>0 GROUP BY ALL""")
def followed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that are all text, followed by the streaming source; the incomplete last lines wait."""
    files = _files(spark, sf_dir).where("u % 5 <> 0")
    where = files.select(F.regexp_extract("path", r"^(.*)/u=", 1)).first()
    if where is None:
        return spark.createDataFrame([], "path string, lines bigint, to_offset bigint")
    spark.dataSource.register(Tails)
    out = f"{shared_folder(spark).rstrip('/')}/auditloom/followed-{uuid.uuid4().hex}"
    tails = spark.readStream.format("tails").load(where[0])
    tails.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").start(f"{out}/rows").awaitTermination()
    told = spark.read.parquet(f"{out}/rows").withColumn("tail", F.element_at(F.split("path", "/u="), -1))
    named = told.join(files.select(F.element_at(F.split("path", "/u="), -1).alias("tail"), "name"), "tail")
    return named.groupBy(F.col("name").alias("path")).agg(F.sum(F.size(F.split("chunk", "\n")) - 1).cast("long").alias("lines"), F.max("to_offset").alias("to_offset"))


def _snapshot_files(spark, sf_dir):
    """Snapshot files of 200 events, their fields in either spelling; four files of five are broken in one way each."""
    n, file = F.col("event_id"), F.floor(F.col("event_id") / 200)
    names = ("id", "action", "outcome")
    whole = F.when(n % 3 == 0, F.to_json(F.struct(*(F.col(c).alias(c.capitalize()) for c in names)))).otherwise(F.to_json(F.struct(*names)))
    line = F.when((file % 5 == 2) & (n % 200 == 50), "{broken").when((file % 5 == 3) & (n % 200 == 70), "").when((file % 5 == 4) & (n % 200 == 9), "[1]").otherwise(whole)
    rows = _records(spark, sf_dir).groupBy(file.alias("file")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l"))
    end = F.when(F.col("file") % 5 == 1, "").otherwise("\n")
    return rows.select(F.concat(F.lit("s-"), "file").alias("file"), F.concat(F.array_join("l.line", "\n"), end).cast("binary").alias("content"))


SNAPSHOT = f"""{REC}, s AS (SELECT *,event_id//200 AS file,row_number() OVER (PARTITION BY event_id//200 ORDER BY event_id) AS n,count(*) OVER (PARTITION BY event_id//200) AS size FROM rec),
 b AS (SELECT *,CASE WHEN file%5=1 AND n=size THEN 'unterminated-line' WHEN file%5=2 AND event_id%200=50 THEN 'invalid-json-line-'||n WHEN file%5=3 AND event_id%200=70 THEN 'empty-line-'||n WHEN file%5=4 AND event_id%200=9 THEN 'invalid-json-line-'||n END AS bad FROM s)"""


@query(f"WITH {SNAPSHOT} SELECT 's-'||file AS file,count(*) AS lines,max(bad) AS error,max(bad) IS NULL AS valid FROM b GROUP BY file")
def snapshot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.strict_snapshot(_snapshot_files(spark, sf_dir))[1]


@query(f"WITH {SNAPSHOT} SELECT id,action,outcome FROM b WHERE file NOT IN (SELECT file FROM b WHERE bad IS NOT NULL)")
def snapshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.strict_snapshot(_snapshot_files(spark, sf_dir))[0].select("id", "action", "outcome")


@query(f"WITH {SNAPSHOT} SELECT id,action,outcome FROM b WHERE bad IS NULL OR bad='unterminated-line'")
def tolerant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _snapshot_files(spark, sf_dir).select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    return AU.json_records(lines).select("id", "action", "outcome")


@query("""WITH e AS (SELECT event_id,event_id//20 AS k,row_number() OVER (PARTITION BY event_id//20 ORDER BY event_id)-1 AS pos,count(*) OVER (PARTITION BY event_id//20) AS n FROM events)
 SELECT k::VARCHAR AS key,pos::INT AS pos,'audit-'||event_id AS id FROM e WHERE CASE k%3 WHEN 0 THEN true WHEN 1 THEN pos<n-1 ELSE pos<2 END""")
def salvaged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.to_json(F.struct(F.concat(F.lit("audit-"), "event_id").alias("id"), F.col("event_id").alias("n")))
    pages = _events(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 20).alias("k")).agg(F.array_sort(F.collect_list(F.struct("event_id", one.alias("o")))).alias("l"))
    objects = F.when(F.col("k") % 3 == 2, F.concat(F.slice("l.o", 1, 2), F.array(F.lit("oops")), F.slice("l.o", 3, 100))).otherwise(F.col("l.o"))
    whole = F.concat(F.lit('{"records": ['), F.array_join(objects, ", "), F.lit("]}"))
    cut = F.when(F.col("k") % 3 == 1, F.left(whole, F.length(whole) - 5)).otherwise(whole)
    return AU.salvage_records(pages.select(F.col("k").cast("string").alias("key"), cut.alias("excerpt"))).select("key", "pos", F.get_json_object("record", "$.id").alias("id"))


@query("SELECT 'org/app' AS repo,c_custkey AS number,c_name AS title,'open' AS state,'u'||(c_custkey%5) AS author,'bug,l'||(c_custkey%3) AS labels FROM customer WHERE c_custkey%7<>0")
def issue_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    pull = F.when(n % 7 == 0, F.struct(F.lit("u").alias("url")))
    issue = F.struct(n.alias("number"), F.col("c_name").alias("title"), F.lit("OPEN").alias("state"), F.struct(F.concat(F.lit("u"), n % 5).alias("login")).alias("user"), F.array(F.struct(F.lit("bug").alias("name")), F.struct(F.concat(F.lit("l"), n % 3).alias("name"))).alias("labels"), pull.alias("pull_request"))
    pages = table(spark, sf_dir, "customer").groupBy(F.floor(n / 50).alias("page")).agg(F.to_json(F.collect_list(issue)).alias("body"))
    body = F.when(F.col("page") % 2 == 1, F.concat(F.lit("["), "body", F.lit("]"))).otherwise(F.col("body"))
    return AU.issue_lists(pages.select(F.lit("org/app").alias("repo"), body.alias("body"))).select("repo", "number", "title", "state", "author", F.array_join("labels", ",").alias("labels"))


# --- runtime logs ------------------------------------------------------------------------------------------------------

BASE = 1_700_000_000


def _logs(spark, sf_dir):
    """A runtime log for each event, of five services and one that is unknown: ``(file, service, epoch, mtime, text)``."""
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    service = F.element_at(F.array(*map(F.lit, ("watcher", "analyzer", "alerts", "sentinel", "issues", "other"))), (n % 6 + 1).cast("int"))
    poll = F.concat(F.lit("MSG=watcher audit-poll mode=x records="), n % 50, F.lit(" seen="), n % 7, F.lit(" batches="), n % 3, F.lit("\nEXIT="), F.when(n % 4 == 0, 1).otherwise(0))
    told = F.concat(F.lit("batch=b-"), n, F.lit(" findings="), n % 4, F.lit(" alerts="), n % 3, F.lit(" cached_result=true\nEXIT=0"))
    dead = F.concat(F.lit("tag=DEAD_LETTER DELIVERY=q/dedup/audit-batch_2f_v3-"), n, F.lit(" WHY=broken "), n, F.lit("\nEXIT=0"))
    alert = F.concat(F.lit("OUTBOUND mode="), F.when(n % 4 == 0, "real").otherwise("dry-run"), F.lit(" severity="), F.when(n % 5 == 0, "critical").otherwise("medium"), F.lit(" category=c"), n % 3, F.lit(" dedup_key=k-"), user, F.lit("\nEXIT=0"))
    fact = F.concat(F.lit("INCIDENT fp="), _issue_fp(), F.lit(" signal=flapping state=open->recovering fails=1 total=2 buckets=3\nEXIT=0"))
    issue = F.concat(F.lit("ISSUE_OUTBOUND mode=dry-run kind=open fp="), _issue_fp(), F.lit(" severity=high signal=flapping title='t x'\nISSUE_SKIP kind=open fp="), _issue_fp(), F.lit(" reason=muted\nEXIT=0"))
    text = F.when(n % 6 == 0, poll).when(n % 12 == 1, told).when(n % 6 == 1, dead).when(n % 6 == 2, alert).when(n % 6 == 3, fact).when(n % 6 == 4, issue).otherwise("nothing")
    file = F.concat(service, F.when(n % 12 == 7, ".dead_letter-").otherwise(".run-"), (n + BASE).cast("string"), F.lit(".log"))
    return _events(spark, sf_dir).select(file.alias("file"), F.when(service != "other", service).alias("service"), (n + BASE).alias("epoch"), F.timestamp_seconds(n + BASE).alias("mtime"), text.alias("text"))


LOGS = f"""g AS (SELECT event_id,{BASE}+event_id AS epoch,(['watcher','analyzer','alerts','sentinel','issues','other'])[(event_id%6)::INT+1] AS service,user_id,{ISSUE_FP} AS fp FROM events),
 lg AS (SELECT *,service||CASE WHEN event_id%12=7 THEN '.dead_letter-' ELSE '.run-' END||epoch||'.log' AS file,CASE WHEN event_id%6=0 THEN event_id%4=0 WHEN event_id%12=7 THEN true ELSE false END AS failed,
  CASE WHEN event_id%6=0 THEN 'watcher audit-poll mode=x records='||(event_id%50)||' seen='||(event_id%7)||' batches='||(event_id%3) WHEN event_id%12=1 THEN 'batch=b-'||event_id||' findings='||(event_id%4)||' alerts='||(event_id%3)||' cached_result=true'
  WHEN event_id%6=1 THEN 'tag=DEAD_LETTER DELIVERY=q/dedup/audit-batch_2f_v3-'||event_id||' WHY=broken '||event_id WHEN event_id%6=2 THEN 'OUTBOUND mode='||CASE WHEN event_id%4=0 THEN 'real' ELSE 'dry-run' END||' severity='||CASE WHEN event_id%5=0 THEN 'critical' ELSE 'medium' END||' category=c'||(event_id%3)||' dedup_key=k-'||user_id
  WHEN event_id%6=3 THEN 'EXIT=0' ELSE 'ISSUE_OUTBOUND mode=dry-run kind=open fp='||fp||' severity=high signal=flapping title=''t x''' END AS summary FROM g WHERE service<>'other')"""
HEALTH = "he AS (SELECT service,CASE WHEN arg_max(failed,epoch) THEN 'danger' ELSE 'ok' END AS status,arg_max(summary,epoch) AS summary,max(epoch) AS last_seen,count(*) AS logs,count(*) FILTER (failed) AS failed_logs FROM lg GROUP BY service)"
ALERTS = """al AS (SELECT 'k-'||user_id AS dedup_key,CASE WHEN event_id%4=0 THEN 'real' ELSE 'dry-run' END AS mode,max(epoch) AS "at",arg_max(summary,epoch) AS summary,arg_max(CASE WHEN event_id%5=0 THEN 'critical' ELSE 'medium' END,epoch) AS severity FROM lg WHERE event_id%6=2 GROUP BY ALL)"""


@query(f"WITH {LOGS} SELECT file,service,epoch,length(CASE WHEN event_id%6=3 THEN 'INCIDENT fp='||fp||' signal=flapping state=open->recovering fails=1 total=2 buckets=3'||chr(10)||'EXIT=0' WHEN event_id%6=4 THEN summary||chr(10)||'ISSUE_SKIP kind=open fp='||fp||' reason=muted'||chr(10)||'EXIT=0' WHEN event_id%6=0 THEN 'MSG='||summary||chr(10)||'EXIT=0' ELSE summary||chr(10)||'EXIT=0' END) AS size FROM lg ORDER BY epoch DESC,file LIMIT 120")
def newest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _logs(spark, sf_dir).select(F.concat(F.lit("/var/run/"), "file").alias("path"), F.col("mtime").alias("modificationTime"), F.col("text").cast("binary").alias("content"))
    return L.runtime_logs(files).select("file", "service", "epoch", F.length("text").cast("long").alias("size"))


@query(f"WITH {LOGS}, {HEALTH} SELECT * FROM he")
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.service_health(_logs(spark, sf_dir))


@query(f"WITH {LOGS} SELECT epoch,event_id%50 AS records,event_id%7 AS seen,event_id%3 AS batches FROM lg WHERE service='watcher' ORDER BY epoch DESC LIMIT 1")
def newest_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.poll_stats(_logs(spark, sf_dir))


@query(f"""WITH {LOGS}, d AS (SELECT * FROM lg WHERE event_id%12=7 AND event_id%24<>7), x AS (SELECT 'finding-'||file AS id,'b-'||event_id AS batch_id,CASE WHEN event_id%3>0 THEN 'high' ELSE 'medium' END AS severity,'analysis' AS category,CASE WHEN event_id%4=0 THEN event_id%3 ELSE event_id%4 END||' findings, '||(event_id%3)||' alerts' AS summary,true AS cached,epoch AS "at" FROM lg WHERE event_id%12=1 AND (event_id%4>0 OR event_id%3>0)
 UNION ALL SELECT 'finding-pipeline-health','pipeline-health','high','pipeline_health',count(*)||' batches were dropped: '||arg_max('broken '||event_id,epoch),false,max(epoch) FROM d HAVING count(*)>0) SELECT * FROM x ORDER BY "at" DESC,id LIMIT 80""")
def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = _events(spark, sf_dir).where("event_id % 24 = 7").select(F.concat(F.lit("v3-"), "event_id").alias("batch_id"))
    return R.finding_logs(_logs(spark, sf_dir), fresh)


@query(f"WITH {LOGS} SELECT file,'broken '||event_id AS why,'v3-'||event_id AS batch_id FROM lg WHERE event_id%12=7 AND event_id%24<>7")
def unresolved_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = _events(spark, sf_dir).where("event_id % 24 = 7").select(F.concat(F.lit("v3-"), "event_id").alias("batch_id"))
    return R.unresolved(R.dead_letter_batches(_logs(spark, sf_dir).where("service = 'analyzer'")), fresh).select("file", "why", "batch_id")


@query(f"""WITH {LOGS}, x AS (SELECT file,epoch,0 AS line_no,'outbound' AS action,fp,'dry-run' AS mode,NULL AS reason,'t x' AS title FROM lg WHERE event_id%6=4 UNION ALL SELECT file,epoch,1,'skip',fp,NULL,'muted',NULL FROM lg WHERE event_id%6=4) SELECT * FROM x ORDER BY epoch DESC,file DESC,line_no DESC LIMIT 80""")
def newest_issue_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.issue_activity(_logs(spark, sf_dir)).select("file", "epoch", "line_no", "action", "fp", "mode", "reason", "title")


@query(f"WITH {LOGS} SELECT fp,count(*) AS n FROM lg WHERE event_id%6=4 GROUP BY fp")
def would_have_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = R.facts(R.log_lines(_logs(spark, sf_dir).where("service = 'issues'")), R.issue_line).select("i.*")
    return R.would_have_filed(actions).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOGS}, {HEALTH}, {ALERTS}, x AS (SELECT 0 AS rank,'service' AS what,service AS subject,summary,last_seen AS "at" FROM he WHERE status='danger' UNION ALL SELECT 1,'alert',dedup_key,summary,"at" FROM al WHERE severity='critical' AND mode='real') SELECT what,subject,summary,"at" FROM x ORDER BY rank,"at" DESC,subject LIMIT 1""")
def top_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    return R.top_attention(R.service_health(logs), R.collapse_alerts(R.alert_entries(logs)))


@query(f"""WITH {LOGS}, {ALERTS} SELECT count(*) FILTER (event_id%12=1 AND event_id%3>0) AS high_findings,(SELECT count(*) FROM al WHERE severity='critical' AND mode='real') AS real_alerts FROM lg""")
def high_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir)
    return R.severity_counts(R.told_findings(logs), R.collapse_alerts(R.alert_entries(logs)))


@query(f"""WITH {REC}, x AS (SELECT id,tm AS "timestamp",min(o) AS o FROM (SELECT id,tm,0 AS o FROM rec WHERE event_id%2=0 UNION ALL SELECT id,tm,1 FROM rec WHERE event_id%3=0 UNION ALL SELECT id,tm,2 FROM rec WHERE event_id%5=0) GROUP BY ALL) SELECT id,"timestamp",(['log','cache','file'])[o+1] AS origin FROM x ORDER BY "timestamp" DESC,id DESC LIMIT 500""")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda k, origin: R.shown_events(_records(spark, sf_dir).where(F.col("event_id") % k == 0)).withColumn("origin", F.lit(origin))
    return R.merge_events([shown(2, "log"), shown(3, "cache"), shown(5, "file")]).select("id", "timestamp", "origin")


@query(f"""WITH {REC} SELECT id,'actor-'||user_id AS actor,action,coalesce(nullif(outcome,''),'unknown') AS outcome,'workflow/'||rid AS resource FROM rec WHERE contains(lower('actor-'||user_id||' '||action),'binding.sync')""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = R.shown_events(_records(spark, sf_dir))
    return shown.where(G.matches_search(["actor", "action"], " Binding.SYNC ")).select("id", "actor", "action", "outcome", "resource")


@query("""SELECT event_id,CASE WHEN event_id%4=3 THEN false ELSE event_id*1000000000+event_id%2>500000000000 END AS fresh FROM events""")
def cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.when(n % 4 == 3, "no cache").otherwise(F.concat(F.lit("head\nfindings-cache-v1 expires_at="), (n * 1_000_000_000 + n % 2).cast("string"), F.lit("\n[]")))
    return _events(spark, sf_dir).select("event_id", text.alias("text")).select("event_id", G.cache_fresh("text", F.lit(500_000)).alias("fresh"))


WATCHED = "'Jan  1 10:00:00 host '||CASE event_id%3 WHEN 0 THEN 'sshd[1]: Failed password for u'||event_id||' from 10.0.0.'||(event_id%250) WHEN 1 THEN 'sudo:  u'||event_id||' : user NOT in sudoers ; COMMAND=/bin/x'||event_id ELSE 'app: action=job.run outcome=ok user=u'||event_id END"


@query(f"""WITH f AS (SELECT user_id,event_id//{READ_EVENTS} AS part,max(event_id) AS m FROM events GROUP BY ALL ORDER BY m DESC LIMIT 20), l AS (SELECT 'w'||e.user_id||'-'||f.part||'.log' AS file,e.event_id,row_number() OVER (PARTITION BY f.user_id,f.part ORDER BY e.event_id DESC) AS back,{WATCHED} AS line FROM events e JOIN f ON f.user_id=e.user_id AND f.part=e.event_id//{READ_EVENTS})
 SELECT file,line,'Jan  1 10:00:00' AS "timestamp",'u'||event_id AS actor,CASE WHEN event_id%3=0 THEN '10.0.0.'||(event_id%250) END AS ip,CASE WHEN event_id%3=1 THEN '/bin/x'||event_id END AS command,CASE event_id%3 WHEN 0 THEN 'ssh' WHEN 1 THEN 'sudo' ELSE 'job.run' END AS action,CASE event_id%3 WHEN 0 THEN 'failure' WHEN 1 THEN 'success' ELSE 'ok' END AS outcome,event_id%3 IN (0,1) AS suspicious FROM l WHERE back<=200""")
def watched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    line = F.concat(F.lit("Jan  1 10:00:00 host "), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("sshd[1]: Failed password for u"), n, F.lit(" from 10.0.0."), F.col("event_id") % 250)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("sudo:  u"), n, F.lit(" : user NOT in sudoers ; COMMAND=/bin/x"), n)).otherwise(F.concat(F.lit("app: action=job.run outcome=ok user=u"), n)))
    files = _events(spark, sf_dir).groupBy("user_id", F.floor(F.col("event_id") / READ_EVENTS).alias("part")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l"), F.max("event_id").alias("m"))
    path = F.concat(F.lit("/watch/w"), "user_id", F.lit("-"), "part", F.lit(".log"))
    return L.watch_events(files.select(path.alias("path"), F.timestamp_seconds("m").alias("modificationTime"), F.concat(F.array_join("l.line", "\n"), F.lit("\n")).cast("binary").alias("content"))).drop("line_no")
