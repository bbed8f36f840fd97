import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_threads import frame, message

from mailweave.operators.classify import batch_classifier, word_topic
from mailweave.sources import inbox, state
from mailweave.streaming import scanner

IDS = "message_id string, thread_id string"


def mailbox(spark):
    user = ["INBOX", "UNREAD"]
    return frame(
        spark,
        [
            message("a", 0, "a tour please", "1", user),
            message("b", 0, "buy my seo", "1", user),
            message("c", 0, "a trip", "1", user), message("c", 1, "reply", "2", ["DRAFT"]),
            message("d", 0, "tour one", "1", user), message("d", 1, "tour two", "2", user),
        ],
    )


def ids(spark, *names):
    return spark.createDataFrame([(n, n.split(":")[0]) for n in names], IDS)


def outcomes(spark, base):
    return {r.message_id: r.outcome for r in state.read_state(spark, f"{base}/state").collect()}


OPTIONS = scanner.ScanOptions(classifier=word_topic(("tour", "trip")))
ALL = ("a:0", "b:0", "c:0", "d:0", "d:1")
WANT = {"a:0": "drafted", "b:0": "non_travel", "c:0": "thread_has_draft", "d:0": "thread_has_draft", "d:1": "drafted"}


def test_route(spark):
    known = spark.createDataFrame([("d:0", "drafted", None)], state.STATE_SCHEMA)
    rows = scanner.route(ids(spark, *ALL, "a:0", "ghost:0"), mailbox(spark), known, OPTIONS).collect()
    got = {r.message_id: r for r in rows}
    assert len(rows) == 5 and "d:0" not in got
    assert {m: r.outcome for m, r in got.items() if m != "ghost:0"} == {k: v for k, v in WANT.items() if k != "d:0"}
    assert sum(r.outcome == "drafted" for r in rows if r.thread_id == "d") == 1
    assert got["ghost:0"].outcome is None and got["ghost:0"].error
    # The transcript of a message ends with it; its thread's later mail is not shown.
    assert "MESSAGE 2" in got["d:1"].transcript and "MESSAGE 2" not in got["a:0"].transcript
    assert got["a:0"].reply_subject == "Re: Hi" and got["a:0"].in_reply_to == "<a.0>"


def test_batches_are_idempotent(spark, tmp_path):
    base, sent = str(tmp_path), []

    def send(requests, batch_id):
        sent.append((batch_id, sorted(r.message_id for r in requests.collect())))

    for batch_id, names in ((0, ALL[:3]), (0, ALL[:3]), (1, ALL)):
        scanner.process_batch(ids(spark, *names), batch_id, mailbox(spark), base, OPTIONS, send)
    assert outcomes(spark, base) == WANT
    assert sent == [(0, ["a:0"]), (0, ["a:0"]), (1, ["d:1"])]


def test_dry_run_stores_skips_only(spark, tmp_path):
    base = str(tmp_path)
    options = scanner.ScanOptions(classifier=OPTIONS.classifier, dry_run=True)

    def send(requests, batch_id):
        raise AssertionError("nothing may be sent")

    scanner.process_batch(ids(spark, *ALL), 0, mailbox(spark), base, options, send)
    assert outcomes(spark, base) == {"b:0": "non_travel", "c:0": "thread_has_draft"}


def test_dry_run_leaves_its_drafts_for_a_real_one(spark, tmp_path):
    base, sent = str(tmp_path), []
    dry = scanner.ScanOptions(classifier=OPTIONS.classifier, dry_run=True)
    scanner.process_batch(ids(spark, *ALL), 0, mailbox(spark), base, dry)
    drafts = spark.read.parquet(f"{base}/dry-results").where("outcome = 'drafted'")
    assert sorted(r.message_id for r in drafts.collect()) == ["a:0", "d:0", "d:1"]

    def send(requests, batch_id):
        sent.extend(sorted(r.message_id for r in requests.collect()))

    scanner.process_batch(ids(spark, *ALL), 0, mailbox(spark), base, OPTIONS, send)
    assert outcomes(spark, base) == WANT and sent == ["a:0", "d:1"]
    assert not list(tmp_path.glob("work*"))


def test_one_draft_per_thread_over_batches(spark, tmp_path):
    for remember, second in ((True, "thread_has_draft"), (False, "drafted")):
        base = str(tmp_path / str(remember))
        options = scanner.ScanOptions(classifier=OPTIONS.classifier, remember_drafts=remember)
        for batch_id, name in enumerate(("d:0", "d:1")):
            scanner.process_batch(ids(spark, name), batch_id, mailbox(spark), base, options)
        assert outcomes(spark, base) == {"d:0": "drafted", "d:1": second}


def test_compacted_state_keeps_batches(spark, tmp_path):
    base = str(tmp_path / "scan")
    for batch_id, names in enumerate((ALL[:3], ALL)):
        scanner.process_batch(ids(spark, *names), batch_id, mailbox(spark), base, OPTIONS)
    assert state.compact(spark, f"{base}/state")
    assert outcomes(spark, base) == WANT
    first = state.read_state(spark, f"{base}/state", without_batch=1).collect()
    assert sorted(r.message_id for r in first) == ["a:0", "b:0", "c:0"]


def test_what_a_batch_reads_does_not_grow(spark, tmp_path, monkeypatch):
    """Forty batches: buckets are split as the history grows, and a look-up opens few of them."""
    monkeypatch.setattr(state, "BUCKET_ROWS", 60)
    path, want, read = str(tmp_path / "state"), {}, []
    at = datetime(2026, 1, 1)
    for batch in range(40):
        rows = [(f"m{batch}-{i}", "drafted", at) for i in range(30)]
        if batch:
            rows.append((f"m{batch - 1}-0", "non_travel", at + timedelta(days=batch)))
        want.update({m: o for m, o, _ in rows})
        state.compact(spark, path, batch, after=4)
        asked = spark.createDataFrame([(f"m{k}-1",) for k in (0, batch, batch + 7)], "message_id string")
        seen = state.outcomes_of(asked, path)
        if batch > 7:
            read.append(sum(os.path.getsize(f.removeprefix("file:")) for f in seen.inputFiles()))
        assert {r.message_id for r in seen.collect()} == ({"m0-1"} if batch else set())
        state.append_outcomes(spark.createDataFrame(rows, state.STATE_SCHEMA).coalesce(1), path, batch)
    assert {r.message_id: r.outcome for r in state.read_state(spark, path).collect()} == want
    assert max(read[-8:]) < 1.5 * max(read[:8])
    assert len(os.listdir(f"{path}/log")) <= 5
    again = state.read_state(spark, path, without_batch=3).where("message_id like 'm3-%'").collect()
    assert [r.message_id for r in again] == ["m3-0"]  # batch 4 wrote it again


def test_open_messages_are_carried_in_a_small_table(spark, tmp_path):
    down, base = {"now": True}, str(tmp_path)

    def model(text):
        if down["now"]:
            raise TimeoutError("no answer")
        return "yes en"

    for batch_id, name in enumerate(("a:0", "c:0", "d:0")):
        options = scanner.ScanOptions(classifier=batch_classifier(model))
        scanner.process_batch(ids(spark, name), batch_id, mailbox(spark), base, options)
        held = spark.read.parquet(f"{base}/open/batch={batch_id}")
        assert held.count() == batch_id + 1
    down["now"] = False
    options = scanner.ScanOptions(classifier=batch_classifier(model))
    for batch_id in (3, 3, 4):
        scanner.process_batch(ids(spark), batch_id, mailbox(spark), base, options)
        assert spark.read.parquet(f"{base}/open/batch={batch_id}").count() == 0
    assert set(outcomes(spark, base)) == {"a:0", "c:0", "d:0"}


def test_repeats_in_a_stream_with_event_time(spark, tmp_path):
    """Repeats within the watermark are dropped, late rows too, and old ids are forgotten."""
    source, day = str(tmp_path / "in"), datetime(2026, 1, 1)
    files = [[(f"m{d}-{i}", "t", day + timedelta(days=d)) for i in range(20)] for d in range(8)]
    for d in range(1, 8):
        files[d] += files[d - 1][:5] + files[d][:3]  # repeats of yesterday and today
    files[7].append(("late", "t", day))
    for d, rows in enumerate(files):
        df = spark.createDataFrame(rows, "message_id string, thread_id string, at timestamp")
        df.coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    arrivals = spark.readStream.schema("message_id string, thread_id string, at timestamp").option(
        "maxFilesPerTrigger", 1
    ).parquet(source)
    query = (
        scanner.deduplicated(arrivals, "at", "2 days").writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = [r.message_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(f"m{d}-{i}" for d in range(8) for i in range(20))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 4 * 20 + 20 < len(got)


def test_mail_that_arrives_between_batches(spark, tmp_path):
    box, base = str(tmp_path / "box"), str(tmp_path / "scan")

    def read():
        return spark.read.parquet(box)

    mailbox(spark).where("thread_id = 'a'").write.parquet(box)
    scanner.process_batch(ids(spark, "a:0"), 0, read, base, OPTIONS)
    mailbox(spark).where("thread_id = 'd'").write.mode("append").parquet(box)
    scanner.process_batch(ids(spark, "d:0", "d:1"), 1, read, base, OPTIONS)
    assert outcomes(spark, base) == {k: WANT[k] for k in ("a:0", "d:0", "d:1")}


def test_failed_messages_are_retried(spark, tmp_path):
    base = str(tmp_path)

    def failing(body):
        if "tour one" in body and "tour two" not in body:
            raise TimeoutError("no answer")
        return "yes en" if "tour" in body or "trip" in body else "no en"

    broken = scanner.ScanOptions(classifier=batch_classifier(failing))
    scanner.process_batch(ids(spark, *ALL), 0, mailbox(spark), base, broken)
    assert outcomes(spark, base) == {k: v for k, v in WANT.items() if k != "d:0"}
    scanner.process_batch(ids(spark), 1, mailbox(spark), base, OPTIONS)
    assert outcomes(spark, base) == WANT


def test_failure_after_sending_is_not_stored(spark, tmp_path):
    base = str(tmp_path)

    def send(requests, batch_id):
        raise ConnectionError("mail store")

    with pytest.raises(ConnectionError):
        scanner.process_batch(ids(spark, *ALL), 0, mailbox(spark), base, OPTIONS, send)
    assert outcomes(spark, base) == {}
    scanner.process_batch(ids(spark, *ALL), 0, mailbox(spark), base, OPTIONS)
    assert outcomes(spark, base) == WANT


def test_stream_equals_batch(spark, tmp_path):
    arrived, base = str(tmp_path / "in"), str(tmp_path / "scan")

    def deliver(*names):
        ids(spark, *names).coalesce(1).write.mode("append").parquet(arrived)

    def run():
        stream = spark.readStream.schema(IDS).option("maxFilesPerTrigger", 1).parquet(arrived)
        scanner.start_scan(stream, mailbox(spark), base, OPTIONS).awaitTermination()

    deliver("a:0", "b:0")
    deliver("c:0", "a:0")
    run()
    assert outcomes(spark, base) == {k: WANT[k] for k in ("a:0", "b:0", "c:0")}
    deliver("d:0", "d:1", "b:0")
    run()
    run()
    assert outcomes(spark, base) == WANT


def test_loop_survives_a_failing_pass():
    class Query:
        def awaitTermination(self):
            pass

    tries = iter([RuntimeError("down"), None, RuntimeError("again")])

    def start():
        problem = next(tries)
        if problem:
            raise problem
        return Query()

    assert scanner.scan_loop(start, passes=3, interval_seconds=0) == "again"


def test_inbox_limit(spark):
    assert inbox.unread(mailbox(spark), 2).count() == 2
    assert inbox.unread(mailbox(spark), None).count() == 5
    newest = [r.message_id for r in inbox.unread(mailbox(spark), 1).collect()]
    assert newest == ["d:1"]
    got = inbox.thread_messages(mailbox(spark), ids(spark, "c:0", "c:0"))
    assert got.where(F.col("thread_id") == "c").count() == got.count() == 2
