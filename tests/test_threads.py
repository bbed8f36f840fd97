import base64
import random

import pytest
from pyspark.sql import functions as F

from mailweave.functions import fixed, mail
from mailweave.operators import lookups, threads
from mailweave.operators.messages import message_parts

SCHEMA = (
    "thread_id string, api_pos int, message_id string, internal_date string, "
    "label_ids array<string>, headers array<struct<name:string,value:string>>, "
    "parts array<struct<path:string,mime_type:string,data:string>>"
)


def coded(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def message(thread, pos, body, date="0", labels=(), sender="Guest <g@example.com>", subject="Hi", parts=None):
    headers = [("From", sender), ("Message-ID", f"<{thread}.{pos}>")]
    if subject is not None:
        headers.append(("Subject", subject))
    if parts is None:
        parts = [("0", "text/plain", coded(body))]
    labels = None if labels is None else list(labels)
    return (thread, pos, f"{thread}:{pos}", date, labels, headers, parts)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def parsed(spark, *rows):
    return message_parts(frame(spark, rows)).orderBy("thread_id", "api_pos").collect()


def test_body_decoding(spark):
    got = parsed(
        spark,
        message("t", 0, "Hello Wörld"),
        message("t", 1, "", parts=[("0", "multipart/alternative", None), ("0.1", "text/plain", coded("plain")), ("0.0", "text/html", coded("<p>"))]),
        message("t", 2, "", parts=[("0", "text/plain", ""), ("1", "text/plain", coded("second"))]),
        message("t", 3, "", parts=[("0", "text/html", coded("<p>"))]),
        message("t", 4, "", parts=[("0", "text/plain", base64.urlsafe_b64encode(b"a\xff\xfeb").decode())]),
        message("t", 5, "", parts=[("0", "text/plain", "A")]),
    )
    assert [r.body for r in got] == ["Hello Wörld", "plain", "second", "", "a��b", ""]


def test_headers(spark):
    row = list(message("t", 0, "x", subject=None))
    row[5] = [("subject", "old"), ("SUBJECT", "new"), ("from", "a@b.c"), ("To", "d@e.f")]
    got = parsed(spark, tuple(row), message("t", 1, "x", subject=None))
    assert (got[0].subject, got[0].sender, got[0].recipient, got[0].references) == ("new", "a@b.c", "d@e.f", "")
    assert got[1].subject == "(no subject)"


def test_dates(spark):
    dates = ["1767225600000", " 5 ", "n/a", "", None, "12.5"]
    got = parsed(spark, *[message("t", i, "x", date=d) for i, d in enumerate(dates)])
    assert [r.date_ms for r in got] == [1767225600000, 5, None, None, None, None]
    assert got[0].received_at == "2026-01-01 00:00 UTC" and got[2].received_at == ""


def test_received_at_ignores_session_zone(spark):
    df = frame(spark, [message("t", 0, "x", date="1767225600000")])
    spark.conf.set("spark.sql.session.timeZone", "America/Lima")
    try:
        assert message_parts(df).first().received_at == "2026-01-01 00:00 UTC"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_staff_flag(spark):
    senders = ["Desk <desk@AGENCY.example>", "x@agency.example", "Agency <g@example.com>", "nobody", "", None]
    df = spark.createDataFrame([(s,) for s in senders], "s string")
    for domains in (["agency.example"], ["@Agency.Example "]):
        got = [r[0] for r in df.select(mail.is_staff(F.col("s"), domains)).collect()]
        assert got == [True, True, False, False, False, False]


def test_subject_and_references(spark):
    df = spark.createDataFrame([("  re: Trip ", ""), ("Trip", " <a>  <b>\n<c> ")], "s string, r string")
    rows = df.select(mail.reply_subject(F.col("s")), mail.reference_chain(F.col("r"), F.lit("<z>"))).collect()
    assert [tuple(r) for r in rows] == [("re: Trip", "<z>"), ("Re: Trip", "<a> <b> <c> <z>")]


def order(spark, rows, **kw):
    df = message_parts(frame(spark, rows)).where("not is_draft")
    got = threads.order_messages(df, **kw).orderBy("thread_id", "ordinal").collect()
    return [r.message_id for r in got]


def test_order(spark):
    dated = [message("t", 0, "a", "300"), message("t", 1, "b", "100"), message("t", 2, "c", "100")]
    assert order(spark, dated) == ["t:1", "t:2", "t:0"]
    broken = dated + [message("t", 3, "d", "n/a")]
    assert order(spark, broken) == ["t:0", "t:1", "t:2", "t:3"]
    draft = dated + [message("t", 3, "d", None, ["DRAFT"])]
    assert order(spark, draft) == ["t:1", "t:2", "t:0"]


def test_anchor(spark):
    rows = [
        message("a", 0, "x", "200"), message("a", 1, "y", "100", sender="d@agency.example"),
        message("b", 0, "x", "1"), message("b", 1, "y", None, sender="d@agency.example"),
        message("b", 2, "z", "9", ["DRAFT"]),
        message("c", 0, "x", "1", ["DRAFT"]),
    ]
    got = {r.thread_id: r for r in threads.latest_anchors(frame(spark, rows), ["agency.example"]).collect()}
    assert (got["a"].anchor_id, got["a"].is_staff) == ("a:0", False)
    assert (got["b"].anchor_id, got["b"].is_staff) == ("b:1", True)
    assert (got["b"].raw_message_count, got["b"].non_draft_message_count) == (3, 2)
    assert got["c"].anchor_id is None and got["c"].error


def spec(messages, budget):
    """Transcript of already ordered segments, by dropping from the front."""
    segments = list(messages)
    text = "\n\n".join(segments)
    if len(text) <= budget:
        return text
    for start in range(len(segments)):
        kept = segments[start:]
        lead = f"{fixed.OMISSION_BANNER_HEAD}{len(kept)}{fixed.OMISSION_BANNER_TAIL}\n\n"
        text = "\n\n".join(kept)
        if len(lead + text) <= budget:
            return lead + text
    room = max(0, budget - len(lead))
    return lead + (text[-room:] if room else "")


def segment(n, row):
    received = {None: "(unknown time)"}.get(row[3], "1970-01-01 00:00 UTC")
    body = base64.urlsafe_b64decode(row[6][0][2] + "==").decode()
    return (
        f"--- MESSAGE {n} ---\nReceived: {received}\nFrom: Guest <g@example.com>\n"
        f"Subject: Hi\nBody:\n{body or '(no plain-text body)'}"
    )


def random_threads(seed, n):
    rng = random.Random(seed)
    out = {}
    for t in range(n):
        dated = rng.random() < 0.7
        rows = []
        for i in range(rng.choice([1, 2, 3, 5, 12, 40])):
            date = str(rng.randint(0, 5)) if dated or rng.random() < 0.8 else None
            rows.append(message(f"t{t}", i, "é" * rng.choice([0, 1, 5, 30, 300]), date))
        if all(r[3] is not None for r in rows):
            ordered = sorted(rows, key=lambda r: int(r[3]))
        else:
            ordered = rows
        out[f"t{t}"] = (rows, ordered)
    return out


@pytest.mark.parametrize("budget", [90, 130, 220, 500, 1000, 5000])
def test_random_transcripts_match_spec(spark, budget):
    data = random_threads(budget, 25)
    rows = [r for stored, _ in data.values() for r in stored]
    random.Random(1).shuffle(rows)
    df = frame(spark, rows).cache()
    want = {
        t: spec([segment(i + 1, r) for i, r in enumerate(o)], budget) for t, (_, o) in data.items()
    }
    plain = threads.latest_transcripts(df, budget).collect()
    assert {r.thread_id: r.transcript for r in plain} == want
    hot = threads.latest_transcripts(df, budget, hot_rows=4).collect()
    assert {r.thread_id: r.transcript for r in hot} == want

    anchors = df.select("thread_id", F.col("message_id").alias("anchor_id"))
    each = threads.anchored_transcripts(df, anchors, budget).collect()
    got = {(r.thread_id, r.anchor_id): r.transcript for r in each}
    assert len(got) == len(rows)
    for t, (_, o) in data.items():
        segments = [segment(i + 1, r) for i, r in enumerate(o)]
        for i, r in enumerate(o):
            assert got[(t, r[2])] == spec(segments[: i + 1], budget)
    df.unpersist()


def test_budget_must_be_positive(spark):
    with pytest.raises(ValueError):
        threads.latest_transcripts(frame(spark, [message("t", 0, "x")]), 0)
    assert [threads.thread_budget(n) for n in (None, 5, 2000)] == [48_000, 1_000, 2_000]


def test_missing_anchor(spark):
    df = frame(spark, [message("t", 0, "x"), message("t", 1, "y", labels=["DRAFT"])])
    anchors = spark.createDataFrame([("t", "t:0"), ("t", "t:1"), ("t", "nope")], "thread_id string, anchor_id string")
    got = threads.missing_anchors(df, anchors).collect()
    assert {r.anchor_id for r in got} == {"t:1", "nope"}


def test_metadata_keeps_order_and_repeats(spark):
    df = frame(spark, [message("t", 0, "x"), message("t", 1, "y")])
    ids = spark.createDataFrame([(0, "t:1"), (1, "gone"), (2, "t:0"), (3, "t:1")], "pos int, message_id string")
    got = lookups.metadata(ids, df).collect()
    assert [(r.pos, r.message_id, r.error) for r in got] == [
        (0, "t:1", None), (1, "gone", "not found"), (2, "t:0", None), (3, "t:1", None)
    ]


def test_missing_labels_count_as_sent(spark):
    df = frame(spark, [message("t", 0, "x", labels=None), message("u", 0, "x", labels=["DRAFT"])])
    assert [r.thread_id for r in threads.non_draft(df).collect()] == ["t"]
    assert [r.thread_id for r in lookups.threads_with_draft(df).collect()] == ["u"]


def test_manual_requests(spark):
    from mailweave.operators import replies

    rows = [
        message("a", 0, "grazie per il tour, vorrei una data", "1"),
        message("b", 0, "hello", "1"), message("b", 1, "answer", "2", sender="d@agency.example"),
        message("c", 0, "", "1", subject="  Just a subject"),
        message("d", 0, "x", "1", ["DRAFT"]),
    ]
    df = frame(spark, rows)
    got = {r.thread_id: r for r in replies.manual_requests(df, ["agency.example"]).collect()}
    assert set(got) == {"a", "c"}
    assert (got["a"].language, got["a"].anchor_id, got["a"].reply_subject) == ("it", "a:0", "Re: Hi")
    assert got["c"].turn == "  Just a subject" and got["c"].reply_subject == "Re: Just a subject"
    forced = replies.manual_requests(df, ["agency.example"], forced_language="es").collect()
    assert {r.language for r in forced} == {"es"}
    assert [r.thread_id for r in replies.answered_threads(df, ["agency.example"]).collect()] == ["b"]
