"""Sources and operators on small inline rows: the cases of the contracts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from auditloom import schemas
from auditloom.config import Config
from auditloom.functions import scalars as S
from auditloom.operators import alerts as A
from auditloom.operators import findings as FI
from auditloom.operators import gates as G
from auditloom.operators import incidents as I
from auditloom.operators import issues as IS
from auditloom.operators import outbox as O
from auditloom.operators import reports as R
from auditloom.operators import snapshots as SN
from auditloom.operators import stability as ST
from auditloom.operators.batching import chunk_numbers, make_batches
from auditloom.sources import adapter as AD
from auditloom.sources import audit as AU
from auditloom.sources import logs as L
from auditloom.sources import staging
from auditloom.operators.incidents import next_state

CFG = Config()


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- sources ---


def lines_of(df):
    return [r["line"] for r in L.split_lines(df).orderBy("path", "line_no").collect()]


def test_growing_files_are_read_once_and_rotation_starts_over(spark, tmp_path):
    log = tmp_path / "a.log"
    empty = spark.createDataFrame([], L.LEDGER)
    read = lambda ledger: L.new_chunks(L.read_files(spark, str(tmp_path)), ledger)
    log.write_bytes(b"one\r\ntwo\npart")
    first = read(empty)
    assert lines_of(first) == ["one", "two"] and first.first()["to_offset"] == 9
    ledger = spark.createDataFrame(L.next_ledger(empty, first).collect(), L.LEDGER)
    assert read(ledger).count() == 0
    log.write_bytes(b"one\r\ntwo\npartial\n\xff\xfe bad\n")
    assert lines_of(read(ledger)) == ["partial", "�� bad"]
    log.write_bytes(b"ONE\r\ntwo\n")  # as long as before, other content
    assert lines_of(read(ledger)) == ["ONE", "two"]
    log.write_bytes(b"x\n")
    assert lines_of(read(ledger)) == ["x"]
    assert lines_of(read(ledger.withColumn("fingerprint", F.lit(None).cast("string")))) == ["x"]


def test_no_newline_consumes_nothing(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"no end")
    assert L.new_chunks(L.read_files(spark, str(tmp_path)), spark.createDataFrame([], L.LEDGER)).count() == 0


RECORD = {"id": "a1", "action": "workflow.delete", "outcome": "Denied", "occurredAtUtc": "2026-07-09T08:00:01Z", "httpStatus": 502, "dependency": {"x": 1}}


@pytest.mark.parametrize("shape", [lambda r: {"records": r}, lambda r: {"Records": r}, lambda r: {"data": {"records": r}}, lambda r: {"data": {"Records": r}}, lambda r: {"items": r}])
def test_pages_of_every_shape(spark, shape):
    pascal = {k[0].upper() + k[1:]: v for k, v in RECORD.items()}
    pages = spark.createDataFrame([("s", "w", 0, json.dumps(shape([RECORD, pascal])))], "source_id string, window_id string, page_no int, body string")
    got = AU.page_records(AU.parse_pages(pages)).collect()
    assert [(r["id"], r["httpStatus"], r["dependency"], r["stage"]) for r in got] == [("a1", "502", "", "")] * 2
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_watermark_moves_only_when_a_window_is_exhausted(spark):
    page = lambda n, cursor, mark: ("s", "w" if cursor != "stuck" else "v", n, json.dumps({"records": [RECORD] * 3, "nextCursor": cursor, "queryWatermark": mark}))
    pages = spark.createDataFrame([page(0, "c1", "m1"), page(1, "", "m2"), page(0, "stuck", "m9")], "source_id string, window_id string, page_no int, body string")
    parsed = AU.parse_pages(pages)
    assert rows(AU.window_checkpoints(parsed).select("window_id", "pages", "records", "exhausted", "watermark"), "window_id") == [("v", 1, 3, False, None), ("w", 2, 6, True, "m1")]
    assert AU.pages_within_budget(parsed, records=2).count() == 2  # a page that was begun is whole
    assert AU.pages_within_budget(parsed, records=4).count() == 3


def test_strict_and_tolerant_snapshots(spark, tmp_path):
    good = json.dumps(RECORD)
    pascal = json.dumps({k[0].upper() + k[1:]: v for k, v in RECORD.items()})
    files = {"ok": f"{good}\n{pascal}\n", "cut": good, "bad": f"{good}\n{{x\n", "list": "[1]\n", "gap": "\n", "late": f"{good}\n\n{good}", "none": ""}
    records, status = AU.strict_snapshot(spark.createDataFrame([(k, v.encode()) for k, v in files.items()], "file string, content binary"))
    assert [(r["id"], r["httpStatus"], r["dependency"]) for r in records.collect()] == [("a1", "502", "")] * 2
    assert dict(rows(status.select("file", "error"))) == {"ok": None, "cut": "unterminated-line", "bad": "invalid-json-line-2", "list": "invalid-json-line-1", "gap": "empty-line-1", "late": "empty-line-2", "none": None}
    assert {r["file"]: (r["lines"], r["valid"]) for r in status.collect()}["none"] == (0, True)
    (tmp_path / "x.jsonl").write_text(f"{good}\nnot json\n{pascal}\n")
    (tmp_path / "y.jsonl").write_text("")
    assert [(r["id"], r["outcome"]) for r in AU.tolerant_jsonl(spark, str(tmp_path)).collect()] == [("a1", "Denied")] * 2
    assert {r["error"] for r in AU.read_snapshot(spark, str(tmp_path))[1].collect()} == {"invalid-json-line-2", None}


def test_a_failed_page_blocks_its_window(spark):
    page = lambda n, body: ("s", "w", n, body)
    good = json.dumps({"records": [RECORD], "nextCursor": "c", "queryWatermark": "m1"})
    last = json.dumps({"records": [RECORD]})
    for pages, want in (([page(0, good), page(1, "<html>")], (1, 1, False, None)), ([page(0, good), page(1, None)], (1, 1, False, None)), ([page(0, good), page(1, "oops"), page(2, last)], (2, 2, False, None)), ([page(0, good), page(1, last)], (2, 2, True, "m1"))):
        parsed = AU.parse_pages(spark.createDataFrame(pages, "source_id string, window_id string, page_no int, body string"))
        assert rows(AU.window_checkpoints(parsed).select("pages", "records", "exhausted", "watermark")) == [want]
        assert AU.pages_within_budget(parsed).count() == (2 if want[2] else 1)


def test_salvage_stops_at_the_cut(spark):
    whole = json.dumps({"records": [{"id": "1"}, {"id": "2", "x": [1, {"y": 2}]}]})
    cut = '{"records": [{"id": "1"}, {"id": "2"}, {"id": "3'
    frame = spark.createDataFrame([("a", whole), ("b", cut), ("c", '{"records": [{"id": "1"}, oops {"id": "2"}]'), ("d", "nothing"), ("e", None)], "key string, excerpt string")
    got = rows(AU.salvage_records(frame).select("key", "pos", F.get_json_object("record", "$.id")), "key", "pos")
    assert got == [("a", 0, "1"), ("a", 1, "2"), ("b", 0, "1"), ("b", 1, "2"), ("c", 0, "1")]


def test_issue_lists(spark):
    issue = {"number": 1, "title": "t", "labels": [{"name": "x"}], "user": {"login": "me"}}
    pages = spark.createDataFrame([("r", json.dumps([issue, issue | {"number": 2, "pull_request": {"url": "u"}}])), ("r", json.dumps([[issue | {"number": 3}]]))], "repo string, body string")
    assert [(r["number"], r["labels"], r["author"]) for r in AU.issue_lists(pages).orderBy("number").collect()] == [(1, ["x"], "me"), (3, ["x"], "me")]
    with pytest.raises(Exception, match="not an issue list"):
        AU.issue_lists(spark.createDataFrame([("r", '{"a": 1}')], "repo string, body string")).collect()


def test_dead_letters_and_a_missing_source(spark, tmp_path):
    (tmp_path / "x.log").write_text("TIMESTAMP=2026-07-13T08:00:00Z tag=DEAD_LETTER QUEUE=q ERROR_CLASS=c WHY=x\nTIMESTAMP=2026-07-13T08:00:00Z tag=DEAD_LETTER QUEUE=q\nother\n")
    letters, degraded = L.read_dead_letters(spark, str(tmp_path))
    assert rows(letters.select("queue", "error_class")) == [("q", "c")] and not degraded
    letters, degraded = L.read_dead_letters(spark, str(tmp_path / "none"))
    assert degraded and letters.count() == 0


def test_watch_events(spark, tmp_path):
    (tmp_path / "auth.log").write_text("Jan  1 10:00:00 h sshd[1]: Failed password for root from 10.0.0.9\n\nJan  1 10:00:01 h sudo:  eve : user NOT in sudoers ; COMMAND=/bin/sh\n")
    got = L.watch_events(L.newest_files(spark, str(tmp_path), 20)).orderBy("line_no").collect()
    assert [(r["actor"], r["ip"], r["action"], r["outcome"], r["suspicious"]) for r in got][0] == ("root", "10.0.0.9", "ssh", "failure", True)
    assert got[1]["command"] == "/bin/sh" and got[1]["actor"] == "eve"


# --- gates ---


def test_both_failure_rules(spark):
    cases = [("x.failed", "Success"), ("x", ""), ("x", "Error"), ("x", "Accepted"), ("", "Success"), ("x.attempted", "Success"), ("identity.binding.sync", "succeeded"), ("a.policy.b", "Success"), ("x", " ")]
    got = rows(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, o string").select("i", G.risk_reason("a", "o"), G.is_failure("a", "o"), G.risk_reason("a", "o", trim=True)), "i")
    assert [r[1] for r in got] == ["failure-action", "missing-outcome", "outcome:error", None, "missing-action", None, "high-impact-action", "high-impact-action", "outcome: "]
    assert [r[2] for r in got] == [True, False, True, False, False, False, False, False, True] and got[8][3] == "missing-outcome"


def test_suspicious_lines(spark):
    texts = ["Jan 1 sshd[100]: Failed password for root", "Jan 1 systemd[1]: Started daily cleanup.", "su[1]: x\r", "", "eve ; PRIVILEGE escalation"]
    assert {r["line"] for r in G.suspicious_lines(spark.createDataFrame([(t,) for t in texts], "line string")).collect()} == {texts[0], "su[1]: x", texts[4]}


FINDING = {"severity": "high", "category": "auth.fail", "evidence_line": "l", "why": "w", "recommended_action": "a"}


@pytest.mark.parametrize(("output", "error"), [([FINDING], None), ([], None), (FINDING, "not-a-json-array"), ("prose", "not-a-json-array"), ([FINDING] * 6, "too-many-findings"), ([FINDING | {"severity": "urgent"}], "invalid-finding"), ([{k: v for k, v in FINDING.items() if k != "why"}], "invalid-finding"), ([FINDING | {"category": "Not OK"}], "invalid-finding")])
def test_findings_contract(spark, output, error):
    text = output if isinstance(output, str) else f" {json.dumps(output)} "
    assert G.parse_findings(spark.createDataFrame([("b", text)], "batch_id string, output string")).first()["error_class"] == error


def test_evidence_is_a_whole_redacted_line(spark):
    batches = spark.createDataFrame([("b", "first line\nsecond line", "/p")], "batch_id string, content string, source_path string")
    found = spark.createDataFrame([("b", s, "c", e, "why", "act") for s, e in (("high", "second line"), ("low", "first line"), ("critical", "second"), ("high", "first line\nsecond line"))], schemas.FINDING)
    kept = FI.with_evidence(found, batches)
    assert sorted(r["evidence_line"] for r in kept.collect()) == ["first line", "second line"]
    assert [r["evidence"] for r in FI.alerts_of(kept, batches).collect()] == ["second line"]
    with pytest.raises(ValueError):
        G.at_least("severity", "loud")


def test_scorer_sees_only_what_is_not_cached(spark):
    batches = spark.createDataFrame([("a", "x"), ("b", "y")], "batch_id string, content string")
    cached = spark.createDataFrame([("a", "[]", 1000), ("b", "[]", 0)], "batch_id string, output string, at bigint")

    def scorer(frames):
        for f in frames:
            yield f.assign(output=f.prompt.str.contains("BEGIN LINES").map({True: "scored", False: "?"}))[["batch_id", "output"]]

    assert rows(FI.score(batches, scorer, cached, now=1000 + 86_399), "batch_id") == [("a", "[]"), ("b", "scored")]
    assert FI.score(batches, None).count() == 0


def test_batch_contract(spark):
    content = "a line"
    sha, old = S.sha_hex("content"), S.djb2("content").cast("string")
    frame = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate([("w.batch.v3", content), ("w.batch.v3", ""), ("w.batch.v2", content), ("w.batch.v9", content), ("w.batch.v1", None), ("w.batch.v1", None), ("w.batch.v3", "x" * 8193)])], "i int, schema string, content string")
    named = frame.withColumn("batch_id", F.concat(F.lit("b"), "i")).withColumn("content_checksum", F.when(F.col("i") == 2, old).otherwise(sha))
    store = spark.createDataFrame([("b4", "kept")], "batch_id string, content string")
    assert [r["error_class"] for r in G.with_content(named, store).orderBy("i").collect()] == [None, "invalid-content", None, "unknown-schema", None, "missing-content", "invalid-content"]


def test_title_tokens(spark):
    titles = ["x (fp:1a2b3c4d)", "fp:1a2b3c4d", "xfp:1a2b3c4d", "[fp:1a2b3c4d] fp:deadbeef", "fp:1a2b3c4dd"]
    got = rows(spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string").select("i", G.fp_tokens("t")), "i")
    assert [r[1] for r in got] == [["1a2b3c4d"], ["1a2b3c4d"], [], ["1a2b3c4d", "deadbeef"], []]


# --- batches ---


def test_chunks_keep_to_their_bytes(spark):
    lines = [("p", i, "denied " + "a" * (i * 37 % 1900)) for i in range(60)]
    frame = spark.createDataFrame(lines, "path string, line_no int, line string")
    got = chunk_numbers(frame, ["path"], ["line_no"]).orderBy("line_no").collect()
    chunk, used, want = 0, 0, []
    for _, _, line in lines:
        if used and used + len(line) + 1 > 8192:
            chunk, used = chunk + 1, 0
        used += len(line) + 1
        want.append(chunk)
    assert [r["chunk"] for r in got] == want


def test_batches_are_redacted_and_bounded(spark):
    lines = spark.createDataFrame([("/a.log", 0, 9, i, f"denied token=abc{i} " + "é" * 900) for i in range(20)], "path string, from_offset bigint, to_offset bigint, line_no bigint, line string")
    made = make_batches(lines).collect()
    assert sum(b["line_count"] for b in made) == 20 and all(len(b["content"].encode()) <= 8192 and "abc" not in b["content"] for b in made)
    assert len({b["batch_id"] for b in made}) == len(made)


def test_rows_are_spread_however_few_parts_hold_them(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(staging, "ROWS", 50)
    path = str(tmp_path / "one.parquet")
    spark.range(1000).coalesce(1).write.parquet(path)
    for frame in (spark.read.parquet(path), spark.range(1000).repartition(8, F.lit(1))):
        sizes = [len(part) for part in staging.spread(frame).rdd.glom().collect()]
        assert sum(sizes) == 1000 and len(sizes) == 20 and max(sizes) <= 60


# --- stability ---


def records(spark, spec):
    """Records of (time, action, outcome)."""
    return AD.project_fields(spark.createDataFrame([(f"a{i}", "s", a, o, t, "workflow") for i, (t, a, o) in enumerate(spec)], "id string, scopeId string, action string, outcome string, occurredAtUtc string, resourceType string"))


def at(minute, second=0):
    return f"2026-07-13T{8 + minute // 60:02d}:{minute % 60:02d}:{second:02d}Z"


def fired(spark, spec):
    last = ST.candidates(records(spark, spec), CFG)
    newest = last.agg(F.max("bucket")).first()[0]
    return {r["signal"] for r in last.where((F.col("bucket") == newest) & F.col("fired")).collect()}


OK, BAD = ("job.exec", "Success"), ("job.exec.failed", "Success")
SIGNAL_CASES = {
    "recurring": ([(at(30 * b, i), *BAD) for b in range(3) for i in range(2)], {"recurring-failure"}),
    "single burst": ([(at(0, i), *BAD) for i in range(10)], {"error-spike"}),
    "spike": ([(at(30 * b, i), *OK) for b in range(2) for i in range(10)] + [(at(60, i), *(OK if i < 4 else BAD)) for i in range(10)], {"error-spike"}),
    "high prior": ([(at(0, i), *(OK if i < 7 else BAD)) for i in range(10)] + [(at(30, i), *(OK if i < 4 else BAD)) for i in range(10)], set()),
    "flapping": ([(at(0, i), *(OK if i % 2 else BAD)) for i in range(8)], {"flapping"}),
    "attempts": ([(at(0, i), "job.exec.attempted", "Denied") for i in range(12)] + [(at(0, 20 + i), *BAD) for i in range(6)], set()),
    "clock moved": ([(at(30 * b, i), *BAD) for b in range(3) for i in range(2)] + [(at(60 + 270), "other", "Success")], set()),
}


@pytest.mark.parametrize("case", SIGNAL_CASES)
def test_signals(spark, case):
    spec, want = SIGNAL_CASES[case]
    assert fired(spark, spec) == want


def test_flapping_has_no_predecessor_outside_its_range(spark):
    spec = [(at(0), *OK)] + [(at(120, i), *(BAD if i % 2 == 0 else OK)) for i in range(7)]
    grid = {r["bucket"]: r["changes"] for r in ST.flapping(ST.bucket_counts(ST.stability_events(records(spark, spec), CFG, True)), CFG).collect()}
    assert grid[max(grid)] == 6
    near = [(at(90), *OK)] + spec[1:]
    grid = {r["bucket"]: r["changes"] for r in ST.flapping(ST.bucket_counts(ST.stability_events(records(spark, near), CFG, True)), CFG).collect()}
    assert grid[max(grid)] == 7


def test_evidence_lines(spark):
    line = ST.stability_events(AD.project_fields(spark.createDataFrame([("a", "x", "2026-07-13T08:00:00Z", "corr", "E1")], "id string, action string, occurredAtUtc string, correlationId string, errorCode string")), CFG, True).first()["line"]
    assert line.startswith("audit event id=a scope= ") and " correlation=corr trace_ref=cr-" in line and line.endswith(" error_code=E1")


# --- incidents ---

B = [f"2026-07-13T{9 + i // 2:02d}{i % 2 * 30:02d}" for i in range(20)]
#: ticks (tick_id, fired, quiet, bucket) and the expected (state, action) after each
TICKS = {
    "a blip never opens": [("1", 1, 0, B[0], "candidate", ""), ("2", 0, 1, B[1], "none", "")],
    "two ticks open": [("1", 1, 0, B[0], "candidate", ""), ("2", 1, 0, B[1], "open", "open"), ("3", 1, 0, B[2], "open", "")],
    "the same tick again": [("1", 1, 0, B[0], "candidate", ""), ("1", 1, 0, B[0], "candidate", "")],
    "closing": [("1", 1, 0, B[0], "candidate", ""), ("2", 1, 0, B[1], "open", "open"), ("3", 0, 1, B[2], "recovering", ""), ("4", 0, 1, B[2], "recovering", ""), ("5", 0, 1, B[3], "closed", "close")],
    "not covered": [("1", 1, 0, B[0], "candidate", ""), ("2", 1, 0, B[1], "open", "open"), ("3", 0, 1, B[2], "recovering", ""), ("4", 0, 0, "", "recovering", ""), ("5", 0, 1, B[3], "closed", "close")],
    "a break in the run": [("1", 1, 0, B[0], "candidate", ""), ("2", 1, 0, B[1], "open", "open"), ("3", 0, 1, B[2], "recovering", ""), ("4", 0, 0, B[3], "recovering", ""), ("5", 0, 1, B[4], "recovering", ""), ("6", 0, 1, B[5], "closed", "close")],
    "refire": [("1", 1, 0, B[0], "candidate", ""), ("2", 1, 0, B[1], "open", "open"), ("3", 0, 1, B[2], "recovering", ""), ("4", 1, 0, B[3], "open", "comment")],
    "a new generation": [("1", 1, 0, B[0], "candidate", ""), ("2", 1, 0, B[1], "open", "open"), ("3", 0, 1, B[2], "recovering", ""), ("4", 0, 1, B[3], "closed", "close"), ("5", 1, 0, B[4], "candidate", ""), ("6", 1, 0, B[5], "open", "open")],
}


def test_incident_machine(spark):
    cfg = CFG.but(quiet_windows=2)
    ticks = [(name, i, t[0], bool(t[1]), bool(t[2]), t[3]) for name, case in TICKS.items() for i, t in enumerate(case)]
    got = I.timeline(spark.createDataFrame(ticks, "fp string, seq int, tick_id string, fired boolean, quiet_ok boolean, latest_bucket string"), cfg).orderBy("seq").collect()
    for name, case in TICKS.items():
        assert [(r["state"], r["action"]) for r in got if r["fp"] == name] == [t[4:] for t in case], name
        state = {"state": "none", "open_bucket": "", "last_fired_tick": "", "quiet_count": 0, "last_quiet_bucket": ""}
        for t, row in zip(case, [r for r in got if r["fp"] == name], strict=True):
            state, action = next_state(state, {"tick_id": t[0], "fired": bool(t[1]), "quiet_ok": bool(t[2]), "latest_bucket": t[3]}, 2)
            assert (state, action) == ({k: row[k] for k in state}, row["action"])
    assert [r["open_bucket"] for r in got if r["fp"] == "a new generation"] == ["", B[1], B[1], B[1], "", B[5]]


def test_one_scan_at_a_time(spark):
    fired_now = spark.createDataFrame([("f1", "error-spike", "job", "s", "w")], "fp string, signal string, family string, scope string, rtype string")
    tracked = spark.createDataFrame([("f2", "flapping", "other", "s", "w", "open", B[0], "1", 0, "")], "fp string, signal string, family string, scope string, rtype string, state string, open_bucket string, last_fired_tick string, quiet_count int, last_quiet_bucket string")
    grid = spark.createDataFrame([("job", "s", "w", False)], "family string, scope string, rtype string, quiet_ok boolean")
    after = {r["fp"]: r for r in I.advance(I.join_tick(fired_now, tracked, grid, B[3]), "9", CFG, now=5).collect()}
    assert after["f1"]["state"] == "candidate" and after["f2"]["state"] == "recovering"
    frozen = {r["fp"]: r for r in I.advance(I.join_tick(fired_now.limit(0), tracked, grid.limit(0), ""), "9", CFG, now=5).collect()}
    assert frozen["f2"]["state"] == "open"  # an invalid snapshot covers nothing, so nothing recovers


def test_requests_are_valid_and_bounded(spark):
    base = spark.createDataFrame([("deadbeef", s, "组" * 100, a, B[1], 2, 1783929901) for s in S.SIGNALS for a in ("open", "comment", "close")], "fp string, signal string, family string, action string, open_bucket string, quiet_count int, epoch bigint")
    full = base.withColumn("rows", F.array(F.struct(F.lit(B[1]).alias("label"), F.lit(3).cast("bigint").alias("fails"), F.lit(12).cast("bigint").alias("total")))).withColumn("lines", F.array_repeat(F.lit("x" * 1000), 30))
    made = I.requests(full, CFG)
    got = made.withColumn("e", G.request_error()).collect()
    assert all(r["e"] is None and len(r["title"].encode()) <= 200 and r["title"].endswith("(fp:deadbeef)") and len(r["body_md"].encode()) <= 16384 for r in got)
    assert {r["repo"] for r in got if r["signal"] == "pipeline-dead-letter"} == {CFG.pipeline_repo}
    assert "| 25.0% |" in got[0]["body_md"]


# --- alerts, issues, outbox ---


def alert(**given):
    base = {"schema": "alerts.alert.v1", "severity": "high", "category": "auth", "summary": "s", "evidence": "e", "action": "a", "source_path": "p", "batch_id": None, "dedup_key": "k", "repo": None, "issue_number": None, "issue_url": None}
    return tuple((base | given).values())


ALERT = schemas.ALERT.replace("issue_number bigint", "issue_number string")
FILED = {"category": "issue-filed", "repo": "o/r", "issue_number": "7", "dedup_key": "issue-alert/issue-filed/o/r/7", "issue_url": "https://github.com/o/r/issues/7", "source_path": "https://github.com/o/r/issues/7"}


def test_outbox_dry_run_and_duplicates(spark):
    frame = spark.createDataFrame([alert(), alert(dedup_key="k2"), alert(severity="loud"), alert(**FILED), alert(**FILED | {"issue_url": "x"})], ALERT)
    none = spark.createDataFrame([], "dedup_key string, sent_at bigint, filed boolean")
    out, ledger, acks, bad = A.outbox(frame, none, 100, writing=False)
    assert {r["mode"] for r in out.collect()} == {"dry-run"} and ledger.count() == 0 and acks.count() == 0
    assert sorted(r["error_class"] for r in bad.collect()) == ["invalid-issue-filed-alert", "invalid-severity"]
    old = spark.createDataFrame([("k", 50, False), (FILED["dedup_key"], 60, True)], "dedup_key string, sent_at bigint, filed boolean")
    out, ledger, acks, _ = A.outbox(frame, old, 100, writing=True)
    assert {r["dedup_key"]: r["mode"] for r in out.collect()} == {"k": "duplicate", "k2": "real", FILED["dedup_key"]: "duplicate"}
    assert dict(rows(ledger.select("dedup_key", "sent_at"))) == {"k": 50, "k2": 100, FILED["dedup_key"]: 100} and acks.count() == 1
    out, *_ = A.outbox(frame, old, 50 + 86_400, writing=True)
    assert {r["dedup_key"]: r["mode"] for r in out.collect()}["k"] == "real"


def test_alert_texts(spark):
    frame = spark.createDataFrame([alert(**FILED)], ALERT).withColumn("extra", F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("2")))
    row = frame.select(A.text_body("extra").alias("t"), A.card_json().alias("c"), A.message_id().alias("m")).first()
    assert row["t"].endswith("a: 2\nz: 1") and json.loads(row["c"])["header"]["colour"] == "orange" and len(row["m"]) == 36


def test_dead_letter_alerts_collapse(spark):
    letters = spark.createDataFrame([("d1", "fp", "c", "a  b\n c"), ("d2", "fp", "c", "x"), ("d3", "", "c", "")], "delivery_id string, fingerprint string, error_class string, why string")
    made = A.dead_letter_alerts(letters, "analyzer")
    assert made.count() == 2 and made.where("evidence like '%\\n%'").count() == 0


def test_dead_letters_with_one_checksum_keep_their_alerts(spark):
    letters = spark.createDataFrame([("d-142078", "", "c", "x"), ("d-1", "f6b8c9d1", "c", "x"), ("d-3", "fp", "a", "a"), ("d-5", "fp", "a", "a"), ("d-7", "fp", "b", "b")], "delivery_id string, fingerprint string, error_class string, why string")
    made = rows(A.dead_letter_alerts(letters, "analyzer").select("evidence", "dedup_key"), "evidence")
    assert [r[0] for r in made] == ["a", "b", "x", "x"] and made[2][1] == made[3][1]


def test_provenance_marker_goes_before_the_last_footer(spark):
    frame = spark.createDataFrame([("r/a", "t", "deadbeef", 'i"', "d", "x\n\n---\ny\n\n---\nz"), ("r/a", "t", "deadbeef", "i", "d", "plain")], "repo string, title string, fingerprint string, incident_id string, dedup_key string, body string")
    marker = IS.provenance_marker(F.col("repo"), F.col("title"))
    made = frame.select(IS.with_provenance(F.col("body"), marker).alias("b"), marker.alias("m"))
    a, b = made.collect()
    assert a["b"] == f"x\n\n---\ny\n\n{a['m']}\n\n---\nz" and b["b"] == f"plain\n\n{b['m']}" and "i%22" in a["m"]
    assert [r[0] for r in made.select(IS.has_provenance(F.col("b"), F.col("m"))).collect()] == [True, True]
    assert [r[0] for r in made.select(IS.has_provenance(F.concat("b", "m"), F.col("m"))).collect()] == [False, False]


def test_created_issues_are_recovered(spark):
    reserved = spark.createDataFrame([("r/a", "t1", "deadbeef", "i", "d1", "error-spike", "high", ""), ("r/a", "t2", "deadbeef", "i", "d2", "error-spike", "high", ""), ("r/a", "t3", "deadbeef", "i", "d3", "error-spike", "high", ""), ("r/a", "t4", "deadbeef", "i", "d4", "error-spike", "high", "")], "repo string, title string, fingerprint string, incident_id string, dedup_key string, signal string, severity string, devloop_enabled string")
    body = IS.with_provenance(F.lit("b"), IS.provenance_marker(F.col("repo"), F.col("title")))
    made = reserved.select("repo", "title", body.alias("body"), IS.labels(CFG).alias("labels"))
    issues = made.where("title in ('t1', 't2')").withColumn("number", F.lit(1)).unionByName(made.where("title = 't2'").withColumn("number", F.lit(2))).withColumn("author", F.lit("bot")).unionByName(made.where("title = 't3'").withColumn("number", F.lit(3)).withColumn("author", F.lit("eve")))
    assert rows(IS.recover_created(reserved, issues, CFG, "bot").select("dedup_key", "recovery", "number"), "dedup_key") == [("d1", "recovered", 1), ("d2", "ambiguous", None), ("d3", "provenance-author-mismatch", None), ("d4", "none", None)]


def request(n, kind="open", **given):
    base = {"schema": "issues.issue.v1", "kind": kind, "fingerprint": "deadbeef", "signal": "error-spike", "severity": "high", "title": "x (fp:deadbeef)", "body_md": "b", "incident_id": "deadbeef-1", "dedup_key": f"k{n}", "repo": "o/r", "devloop_enabled": ""}
    return tuple((base | given).values()) + (n, "2026-07-13")


def issue(number, state="open", labels=("stability",), author="bot", title="x (fp:deadbeef)"):
    return ("o/r", number, title, "", state, author, list(labels), [], "2026-07-13T01:00:00Z", False)


def decided(spark, requests, issues=(), done=(), **cfg):
    frame = spark.createDataFrame(list(requests), schemas.REQUEST + ", arrival int, day string")
    out = IS.decide(frame, spark.createDataFrame(list(issues), schemas.ISSUE), spark.createDataFrame(list(done), "repo string, dedup_key string"), CFG.but(**cfg), login="bot")
    return out, [r["reason"] for r in out.orderBy("arrival").collect()]


def test_issue_decisions(spark):
    assert decided(spark, [request(1), request(2, severity="x")])[1] == ["file", "invalid-severity"]
    assert decided(spark, [request(1)], done=[("o/r", "k1")])[1] == ["duplicate-marker"]
    assert decided(spark, [request(1)], writing=False)[1] == ["dry-run"]
    assert decided(spark, [request(1)], [issue(5, "closed", ("stability", "wontfix"))])[1] == ["muted"]
    assert decided(spark, [request(1), request(2, "comment"), request(3, "close")], [issue(5)])[1] == ["open-issue-adopted", "comment", "autoclose-disabled"]
    assert decided(spark, [request(3, "close")], [issue(5)], autoclose=True)[1] == ["close"]
    assert decided(spark, [request(3, "close")], [issue(5, labels=("stability", "autodev:claimed"))], autoclose=True)[1] == ["devloop-managed"]
    assert decided(spark, [request(1, devloop_enabled="1")], [issue(5, author="eve")])[1] == ["open-issue-adopted-untrusted-author"]
    assert decided(spark, [request(1), request(2, "comment")])[1] == ["file", "comment"]  # what was filed on the way is there
    assert decided(spark, [request(1, "comment"), request(2)])[1] == ["waiting-for-pending-open", "file"]
    assert decided(spark, [request(2, "comment")])[1] == ["no-open-issue"]
    out, reasons = decided(spark, [request(1), request(2, "close")])
    assert reasons == ["recovered-before-open-filed"] * 2 and IS.next_pending(out).count() == 0


def test_requests_are_served_one_after_the_other(spark):
    again = request(2)[:8] + ("k1",) + request(2)[9:]
    assert decided(spark, [request(1), again, request(3)])[1] == ["file", "duplicate-marker", "open-issue-adopted"]
    assert decided(spark, [request(1), again], max_per_day=0)[1] == ["budget-day", "budget-day"]  # what waits isn't finished
    assert decided(spark, [request(1), request(2, "comment", incident_id="deadbeef-2"), request(3, "close", incident_id="deadbeef-3"), request(4, incident_id="deadbeef-4"), request(5, "comment", incident_id="deadbeef-4")], autoclose=True)[1] == ["file", "comment", "close", "file", "comment"]
    assert decided(spark, [request(1), request(2, "close", incident_id="deadbeef-2")])[1] == ["file", "autoclose-disabled"]


def serial(requests, open_issues, done, cfg):
    """The same, one request at a time: requests ``(arrival, day, repo, fp, incident, kind, key)``."""
    finished, there, filed, touched, out = set(done), set(open_issues), {}, set(), {}
    opens = {(r[2], r[4]) for r in requests if r[5] == "open" and (r[2], r[6]) not in done}
    closes = {(r[2], r[4]) for r in requests if r[5] == "close" and (r[2], r[6]) not in done}
    for arrival, day, repo, fp, incident, kind, key in sorted(requests):
        mine, has = (repo, fp), (repo, fp) in there
        if (repo, key) in finished:
            reason = "duplicate-marker"
        elif kind == "open":
            reason = "open-issue-adopted" if has else "recovered-before-open-filed" if (repo, incident) in closes else "budget-day" if filed.get((repo, day), 0) >= cfg.max_per_day else "budget-open" if sum(r == repo for r, _ in there) >= cfg.max_open else "file"
            if reason == "file":
                there.add(mine)
                touched.add(mine)
                filed[repo, day] = filed.get((repo, day), 0) + 1
        elif kind == "comment":
            reason = "comment" if has or mine in touched else "waiting-for-pending-open" if (repo, incident) in opens else "no-open-issue"
        else:
            reason = "close" if has and cfg.autoclose else "autoclose-disabled" if has else "recovered-before-open-filed" if (repo, incident) in opens and mine not in touched else "no-open-issue"
            if reason == "close":
                there.discard(mine)
                touched.add(mine)
        if reason not in ("waiting-for-pending-open", "budget-day", "budget-open"):
            finished.add((repo, key))
        out[arrival] = reason
    return out


@pytest.mark.parametrize("autoclose", [False, True])
def test_many_requests_equal_serving_them_one_by_one(spark, autoclose):
    import random

    for seed in range(4):
        r = random.Random(seed)
        cfg = CFG.but(max_per_day=r.choice([2, 4]), max_open=r.choice([5, 9]), autoclose=autoclose)
        asked = []
        for i in range(160):
            fp = r.randrange(12)
            kind = r.choice(["open", "open", "comment", "close"])
            asked.append((i, f"2026-07-{10 + i // 60}", f"o/r{r.randrange(2)}", f"{fp:08x}", f"{fp}-{r.randrange(6)}", kind, f"{kind}/{fp}/{r.randrange(40)}"))
        for i in range(0, 160, 9):  # repeats: the whole request, later
            j = r.randrange(160)
            asked[j] = (j, asked[j][1], *asked[i][2:])
        open_issues = {(f"o/r{n % 2}", f"{n:08x}") for n in range(3)}
        done = {(asked[0][2], asked[0][6])}
        frame = [request(i, kind, fingerprint=fp, title=f"x (fp:{fp})", incident_id=incident, dedup_key=key, repo=repo)[:-2] + (i, day) for i, day, repo, fp, incident, kind, key in asked]
        frame = spark.createDataFrame(frame, schemas.REQUEST + ", arrival int, day string")
        issues = spark.createDataFrame([("o/r" + str(n % 2),) + issue(n + 1, title=f"x (fp:{n:08x})")[1:] for n in range(3)], schemas.ISSUE)
        got = {x["arrival"]: x["reason"] for x in IS.decide(frame, issues, spark.createDataFrame(list(done), "repo string, dedup_key string"), cfg).collect()}
        assert got == serial(asked, open_issues, done, cfg)


def test_budgets(spark):
    many = [request(i, fingerprint=f"{i:08x}", title=f"x (fp:{i:08x})", incident_id=f"{i}") for i in range(1, 9)]
    out, reasons = decided(spark, many, [issue(i, title=f"old (fp:{100 + i:08x})") for i in range(2)], max_per_day=6, max_open=5)
    assert reasons == ["file"] * 3 + ["budget-open"] * 5  # a request that is refused on one budget doesn't use up the other
    assert {(r["scope"], r["cap"]) for r in IS.budget_alerts(out, CFG.but(max_per_day=6, max_open=5)).collect()} == {("open", 5)}
    few, reasons = decided(spark, many, [issue(i, title=f"old (fp:{100 + i:08x})") for i in range(2)], max_per_day=3, max_open=5)
    assert reasons == ["file"] + ["budget-day"] * 7
    assert {(r["scope"], r["cap"]) for r in IS.budget_alerts(few, CFG.but(max_per_day=3, max_open=5)).collect()} == {("day", 3)}
    assert IS.next_pending(out).count() == 5


def test_outbox_phases(spark):
    frame = spark.createDataFrame([request(1), request(2)], schemas.REQUEST + ", arrival int, day string").withColumn("number", F.col("arrival") + 40)
    merged, _ = O.merge(O.reserve(frame).limit(0), O.reserve(frame))
    final, clash = O.merge(merged, O.finalize(frame))
    assert {r["phase"] for r in final.collect()} == {"finalized"} and clash.count() == 0 and final.where(G.outbox_error().isNotNull()).count() == 0
    again, clash = O.merge(final, O.finalize(frame.withColumn("number", F.lit(9))))
    assert clash.count() == 2 and {r["issue_number"] for r in again.collect()} == {"41", "42"}
    back, _ = O.merge(final, O.reserve(frame))
    assert {r["phase"] for r in back.collect()} == {"finalized"}
    _, clash = O.merge(final, O.reserve(frame.withColumn("title", F.lit("other (fp:deadbeef)"))))
    assert clash.count() == 2
    assert A.filed_alerts(final).withColumn("e", G.alert_error()).where("e is not null").count() == 0
    with pytest.raises(Exception, match="number of 1 or more"):
        O.finalize(frame.withColumn("number", F.lit(0))).collect()


def test_several_changes_of_one_key_are_one_record(spark):
    frame = spark.createDataFrame([request(1), request(2)], schemas.REQUEST + ", arrival int, day string").withColumn("number", F.col("arrival") + 40)
    none, other = O.reserve(frame).limit(0), F.lit("other (fp:deadbeef)")
    both = O.reserve(frame).unionByName(O.finalize(frame))
    for changes in (both, both.unionByName(both)):
        merged, clash = O.merge(none, changes)
        assert sorted((r["phase"], r["issue_number"]) for r in merged.collect()) == [("finalized", "41"), ("finalized", "42")] and clash.count() == 0
    again = both.unionByName(O.finalize(frame.where("arrival = 1").withColumn("number", F.lit(99)))).unionByName(O.reserve(frame.where("arrival = 2").withColumn("title", other)).withColumn("title", other))
    for records in (none, O.reserve(frame), O.finalize(frame)):
        merged, clash = O.merge(records, again.withColumn("seq", F.monotonically_increasing_id()))
        assert sorted(r["issue_number"] for r in merged.collect()) == ["41", "42"]
        assert sorted((r["issue_number"], r["title"]) for r in clash.collect()) == [("", "other (fp:deadbeef)"), ("99", "x (fp:deadbeef)")]
    merged, clash = O.merge(none, O.finalize(frame.unionByName(frame)))  # a repeated request
    assert merged.count() == 2 and clash.count() == 0


def test_index_capacity(spark):
    frame = spark.range(300).select(F.col("id").cast("string").alias("k"), F.col("id").alias("arrival"))
    assert IS.capped_distinct(frame, "k", keep_newest=True).count() == 256
    with pytest.raises(ValueError):
        IS.capped_distinct(frame, "k")


# --- snapshots and reports ---


def test_snapshot_upsert(spark, tmp_path):
    old = records(spark, [(at(0), "a", "x"), (at(1), "b", "x"), (at(2), "c", "x")])
    new = records(spark, [(at(9), "a", "y")]).withColumn("arrival", F.lit(1).cast("bigint"))
    assert [r["outcome"] for r in SN.merge_snapshot(old, new, 2).collect()] == ["y", "x"]
    assert SN.current(spark, str(tmp_path)) is None
    SN.switch(spark, str(tmp_path), SN.publish(old, str(tmp_path)))
    SN.switch(spark, str(tmp_path), SN.publish(old.limit(1), str(tmp_path)))
    assert SN.current(spark, str(tmp_path)).count() == 1


def test_a_writer_that_stops_leaves_the_old_version_or_the_new_one(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    old = records(spark, [(at(0), "a", "x"), (at(1), "b", "x")])
    folder, told = str(tmp_path), lambda: SN.current(spark, str(tmp_path)).count()

    def renew(rows):
        SN.switch(spark, folder, SN.publish(rows, folder))
        SN.expire(spark, folder)

    renew(old)
    writes = {"parquet": DataFrameWriter.parquet, "text": DataFrameWriter.text}
    for kind in writes:
        for late in (False, True):
            before = told()

            def stop(self, *given, kind=kind, late=late):
                if late:
                    writes[kind](self, *given)
                raise OSError("stopped")

            monkeypatch.setattr(DataFrameWriter, kind, stop)
            with pytest.raises(OSError, match="stopped"):
                renew(old.limit(1) if before == 2 else old)
            monkeypatch.undo()
            assert told() == (3 - before if (kind, late) == ("text", True) else before)
            (tmp_path / "pointers" / "number=98").mkdir(parents=True, exist_ok=True)  # one that was begun and has no row
            assert told() in (1, 2)
            renew(old)
            assert told() == 2
    for _ in range(3):
        renew(old.limit(1))
    assert told() == 1 and len(list(tmp_path.glob("v-*"))) == 2 and SN.expire(spark, folder, keep=1) == 1 and told() == 1


BAD_LINES = ["", "ISSUE_FILED", "ISSUE_FILED kind=open fp=xyz number=1 url=u", "ISSUE_FILED kind=open fp=deadbeef number=a url=u", "ISSUE_SKIP kind=shut fp=deadbeef reason=r", "ISSUE_SKIP kind=open fp=deadbeef", "ISSUE_PROBE kind=auth ok=2", "ISSUE_BUDGET_EXCEEDED scope=week used=1 cap=2", "ISSUE_OUTBOUND mode=dry-run kind=open fp=deadbeef severity=loud signal=s title='t'", "XISSUE_FILEDX kind=open", "INCIDENT fp=deadbeef"]


def test_fact_lines(spark):
    good = ["T=1 MSG=x ISSUE_FILED kind=comment fp=deadbeef number=42 url=https://x/42", "ISSUE_SKIP kind=open fp=0badcafe reason=open-issue-adopted", "ISSUE_PROBE kind=auth ok=1 detail=gh auth status ok", "ISSUE_BUDGET_EXCEEDED scope=open used=3 cap=3", "ISSUE_OUTBOUND mode=dry-run kind=open fp=deadbeef severity=high signal=flapping title='a b'"]
    frame = spark.createDataFrame(list(enumerate(good + BAD_LINES)), "i int, line string")
    got = [r["x"] for r in frame.select("i", R.issue_line("line").alias("x")).orderBy("i").collect()]
    assert [x["action"] for x in got[:5]] == ["filed", "skip", "probe", "budget", "outbound"] and got[0]["number"] == 42 and got[2]["detail"] == "gh auth status ok" and got[4]["title"] == "a b"
    assert got[5:] == [None] * len(BAD_LINES)
    lines = ["x INCIDENT fp=deadbeef signal=error-spike state=candidate->open fails=7 total=12 buckets=6-covered", "INCIDENT fp=deadbeef signal=s state=->open fails=7 total=12 buckets=6", "INCIDENT fp=deadbeef signal=s state=a->b fails=x total=12 buckets=6", "nothing"]
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", R.incident_line("line").alias("x")).orderBy("i").collect()]
    assert (got[0]["from_state"], got[0]["to_state"], got[0]["buckets"]) == ("candidate", "open", 6) and got[1:] == [None] * 3


def test_report_over_logs(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (int(name[-14:-4]),) * 2)

    put("sentinel.detect-1700000000.log", "INCIDENT fp=deadbeef signal=s state=none->candidate fails=1 total=2 buckets=1\nINCIDENT fp=deadbeef signal=s state=candidate->open fails=7 total=12 buckets=6\nEXIT=0\n")
    put("issues.file-1700000001.log", "ISSUE_OUTBOUND mode=dry-run kind=open fp=deadbeef severity=high signal=flapping title='t'\nISSUE_SKIP kind=open fp=deadbeef reason=dry-run\nEXIT=0\n")
    put("alerts.send-1700000002.log", "OUTBOUND mode=real severity=critical category=auth dedup_key=k\nEXIT=0\n")
    put("alerts.send-1700000003.log", "SKIP duplicate mode=real dedup_key=k\nEXIT=0\n")
    put("analyzer.dead_letter-1700000004.log", "tag=DEAD_LETTER DELIVERY=q/dedup/audit-batch_2f_v3-x WHY=broken\nEXIT=0\n")
    put("watcher.collect-1700000005.log", "MSG=watcher audit-poll mode=x records=5 seen=2 batches=1\nEXIT=1\n")
    put("other-1700000006.log", "EXIT=1\n")
    assert L.newest_files(spark, str(tmp_path), 2).count() == 2
    logs = L.runtime_logs(L.newest_files(spark, str(tmp_path), 120)).cache()
    assert logs.count() == 6 and {r["epoch"] for r in logs.collect()} == {1700000000 + i for i in range(6)}
    latest = R.latest_incidents(R.incident_entries(logs), ["mtime", "line_no"]).first()
    assert (latest["state"], latest["transitions"], latest["fails"]) == ("open", 2, 7)
    assert R.would_have_filed(R.issue_activity(logs)).count() == 1
    alerts = R.collapse_alerts(R.alert_entries(logs))
    row = alerts.first()
    assert (row["n"], row["mode"], row["severity"]) == (2, "real", "high")
    health = R.service_health(logs)
    assert {r["service"]: r["status"] for r in health.collect()} == {"sentinel": "ok", "issues": "ok", "alerts": "ok", "analyzer": "danger", "watcher": "danger"}
    assert R.top_attention(health, alerts).first()["subject"] == "watcher"
    assert rows(R.poll_stats(logs).select("records", "seen", "batches")) == [(5, 2, 1)]
    found = R.finding_logs(logs)
    assert [r["id"] for r in found.collect()] == ["finding-pipeline-health"]
    assert R.finding_logs(logs, spark.createDataFrame([("v3-x",)], "batch_id string")).count() == 0
    assert rows(R.severity_counts(found, alerts)) == [(1, 1)]


def test_merged_events_prefer_the_cached_copy(spark):
    a = spark.createDataFrame([("1", "2026-01-01", "cached"), ("2", "2026-01-03", "cached")], "id string, timestamp string, x string")
    b = spark.createDataFrame([("1", "2026-01-01", "salvaged"), ("3", "2026-01-02", "salvaged")], "id string, timestamp string, x string")
    assert [(r["id"], r["x"]) for r in R.merge_events([a, b]).collect()] == [("2", "cached"), ("3", "salvaged"), ("1", "cached")]


def test_freshness_and_ranges(spark):
    now = 1_783_929_901
    texts = [(f"x-cache-v1 expires_at={now * 1000 * 1_000_000 + d}",) for d in (1, 0)] + [("none",)]
    assert [r[0] for r in spark.createDataFrame(texts, "t string").select(G.cache_fresh("t", F.lit(now * 1000))).collect()] == [True, False, False]
    stamps = spark.createDataFrame([("2026-07-13T08:05:01Z",), ("2026-07-13T06:00:00Z",), ("?",)], "t string")
    assert [r[0] for r in stamps.select(G.in_time_range("t", "1h", F.lit(now))).collect()] == [True, False, True]
