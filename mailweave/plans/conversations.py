"""Queries for messages, threads, lookups and scanning."""

from __future__ import annotations

import math

from dataclasses import replace


from pyspark.sql import functions as F

from mailweave.functions import fixed, mail
from mailweave.operators import health, lookups, replies, threads
from mailweave.operators.classify import word_topic
from mailweave.operators.messages import message_parts
from mailweave.plans import inputs
from mailweave.plans.registry import query
from mailweave.plans.retrieval import SQL_LANGUAGE, sql_transcripts
from mailweave.session import scratch_path
from mailweave.sources import inbox, state
from mailweave.streaming import scanner

_M = f"WITH {inputs.SQL_MAILBOX}"
_KEYS = "thread_id, message_id"
BUDGET = 1_000
# Topic words of the test queries; they occur in part of the generated text.
TOPIC = word_topic(("the", "de", "und", "is"))


def _parts(spark, sf):
    return message_parts(inputs.mailbox(spark, sf))


# --- message columns ------------------------------------------------------------


@query("m1_headers", f"{_M} SELECT {_KEYS}, subject, sender, 'desk@agency.example' AS recipient, message_id_header, refs AS \"references\" FROM m")
def m1(spark, sf):
    return _parts(spark, sf).select(
        "thread_id", "message_id", "subject", "sender", "recipient", "message_id_header",
        "references",
    )


@query("m2_plain_body", f"{_M} SELECT {_KEYS}, body FROM m")
def m2(spark, sf):
    return _parts(spark, sf).select("thread_id", "message_id", "body")


@query("m3_date_ms", f"{_M} SELECT {_KEYS}, date_ms FROM m")
def m3(spark, sf):
    return _parts(spark, sf).select("thread_id", "message_id", "date_ms")


@query("m4_received_at", f"{_M} SELECT {_KEYS}, received_at FROM m")
def m4(spark, sf):
    return _parts(spark, sf).select("thread_id", "message_id", "received_at")


@query("m5_non_draft", f"{_M} SELECT {_KEYS} FROM m WHERE NOT is_draft")
def m5(spark, sf):
    return threads.non_draft(inputs.mailbox(spark, sf)).select("thread_id", "message_id")


@query("m6_staff_sender", f"{_M} SELECT {_KEYS}, role <> 'user' AS is_staff FROM m")
def m6(spark, sf):
    staff = mail.is_staff(F.col("sender"), inputs.STAFF_DOMAINS)
    return _parts(spark, sf).select("thread_id", "message_id", staff.alias("is_staff"))


@query(
    "m7_reply_subject",
    f"""{_M} SELECT {_KEYS}, CASE WHEN lower(trim(subject)) LIKE 're:%' THEN trim(subject)
        ELSE 'Re: ' || trim(subject) END AS reply_subject FROM m""",
)
def m7(spark, sf):
    reply = mail.reply_subject(F.col("subject"))
    return _parts(spark, sf).select("thread_id", "message_id", reply.alias("reply_subject"))


@query(
    "m8_reference_chain",
    f"""{_M} SELECT {_KEYS}, CASE WHEN refs = '' THEN message_id_header
        ELSE regexp_replace(refs, '\\s+', ' ', 'g') || ' ' || message_id_header END AS chain
        FROM m""",
)
def m8(spark, sf):
    chain = mail.reference_chain(F.col("references"), F.col("message_id_header"))
    return _parts(spark, sf).select("thread_id", "message_id", chain.alias("chain"))


@query("m9_segments", f"{_M} SELECT {_KEYS}, segment FROM segments")
def m9(spark, sf):
    tail = mail.segment_tail(
        F.col("received_at"), F.col("sender"), F.col("subject"), F.col("body")
    )
    rows = threads.order_messages(_parts(spark, sf).where(~F.col("is_draft")))
    segment = F.concat(mail.segment_head(F.col("ordinal")), tail)
    return rows.select("thread_id", "message_id", segment.alias("segment"))


# --- threads ----------------------------------------------------------------------


def _ordered(spark, sf, **kw):
    rows = threads.non_draft(inputs.mailbox(spark, sf)).withColumn(
        "date_ms", mail.date_ms(F.col("internal_date"))
    )
    return threads.order_messages(rows, **kw).select("thread_id", "message_id", "ordinal")


@query("w1_thread_order", f"{_M} SELECT {_KEYS}, ordinal FROM placed")
def w1(spark, sf):
    return _ordered(spark, sf)


@query("w1_thread_order_hot", f"{_M} SELECT {_KEYS}, ordinal FROM placed")
def w1_hot(spark, sf):
    """All threads of more than three messages take the path for very large ones."""
    return _ordered(spark, sf, hot_rows=3)


_ANCHORS = """
counts AS (SELECT thread_id, count(*) AS raw_message_count,
                  count(*) FILTER (WHERE NOT is_draft) AS non_draft_message_count
           FROM m GROUP BY thread_id),
lasts AS (SELECT thread_id, arg_max(message_id, ordinal) AS anchor_id,
                 arg_max(sender, ordinal) AS sender, arg_max(role, ordinal) AS role
          FROM placed GROUP BY thread_id)"""


@query(
    "w2_latest_anchor",
    f"""{_M}, {_ANCHORS}
    SELECT thread_id, anchor_id, sender, role <> 'user' AS is_staff, raw_message_count,
      non_draft_message_count, CASE WHEN non_draft_message_count = 0
        THEN 'thread contains no non-draft messages' END AS error
    FROM counts LEFT JOIN lasts USING (thread_id)""",
)
def w2(spark, sf):
    return threads.latest_anchors(inputs.mailbox(spark, sf), inputs.STAFF_DOMAINS)


@query(
    "w3_through_anchor",
    f"""{_M}, ends AS (SELECT thread_id, arg_max(ordinal, api_pos) AS last FROM placed
                       WHERE role = 'user' GROUP BY thread_id)
    SELECT {_KEYS}, ordinal FROM placed JOIN ends USING (thread_id) WHERE ordinal <= last""",
)
def w3(spark, sf):
    mailbox = inputs.mailbox(spark, sf)
    last = F.max_by("message_id", "api_pos")
    anchors = inbox.unread(mailbox, None).groupBy("thread_id").agg(last.alias("anchor_id"))
    return threads.through_anchor(mailbox, anchors).select("thread_id", "message_id", "ordinal")


@query(
    "w3_missing_anchors",
    f"""{_M} SELECT thread_id, message_id AS anchor_id,
        'anchor message not found after draft filtering' AS error FROM m WHERE is_draft""",
)
def w3_missing(spark, sf):
    mailbox = inputs.mailbox(spark, sf)
    anchors = mailbox.select("thread_id", F.col("message_id").alias("anchor_id"))
    return threads.missing_anchors(mailbox, anchors)


_TRANSCRIPTS = f"{_M}, {sql_transcripts(BUDGET)} SELECT * FROM transcripts"


@query("w4_transcript", _TRANSCRIPTS)
def w4(spark, sf):
    return threads.latest_transcripts(inputs.mailbox(spark, sf), BUDGET)


@query("w4_transcript_hot", _TRANSCRIPTS)
def w4_hot(spark, sf):
    """Threads of more than three messages take the path for very large ones."""
    return threads.latest_transcripts(inputs.mailbox(spark, sf), BUDGET, hot_rows=3)


_ANCHORED = f"""{_M},
pairs AS (
  SELECT a.message_id AS anchor_id, a.ordinal AS n, s.* EXCLUDE (message_id)
  FROM segments a JOIN segments s ON s.thread_id = a.thread_id AND s.ordinal <= a.ordinal
),
sized AS (
  SELECT *, sum(length(segment) + 2) OVER (PARTITION BY anchor_id ORDER BY ordinal DESC
              ROWS UNBOUNDED PRECEDING) - 2 AS suffix,
         sum(length(segment) + 2) OVER (PARTITION BY anchor_id) - 2 AS total
  FROM pairs
),
kept AS (
  SELECT * FROM sized WHERE total <= {BUDGET} OR ordinal = n
    OR length('{fixed.OMISSION_BANNER_HEAD}' || (n - ordinal + 1)
              || '{fixed.OMISSION_BANNER_TAIL}') + 2 + suffix <= {BUDGET}
),
joined AS (
  SELECT thread_id, anchor_id, max(n) AS message_count, count(*) AS kept_messages,
         max(total) AS total,
         string_agg(segment, chr(10) || chr(10) ORDER BY ordinal) AS body
  FROM kept GROUP BY thread_id, anchor_id
),
anchored AS (
  SELECT thread_id, anchor_id, message_count, kept_messages,
    CASE WHEN total <= {BUDGET} THEN body ELSE
      '{fixed.OMISSION_BANNER_HEAD}' || kept_messages || '{fixed.OMISSION_BANNER_TAIL}'
      || chr(10) || chr(10)
      || right(body, {BUDGET} - length('{fixed.OMISSION_BANNER_HEAD}' || kept_messages
               || '{fixed.OMISSION_BANNER_TAIL}') - 2) END AS transcript
  FROM joined
)"""


@query("w4_transcript_per_message", f"{_ANCHORED} SELECT * FROM anchored")
def w4_each(spark, sf):
    mailbox = inputs.mailbox(spark, sf)
    anchors = mailbox.select("thread_id", F.col("message_id").alias("anchor_id"))
    return threads.anchored_transcripts(mailbox, anchors, BUDGET)


@query(
    "w5_clamped_budget",
    f"""{_M}, {sql_transcripts(1000)}
    SELECT thread_id, message_count, kept_messages, length(transcript) AS chars
    FROM transcripts""",
)
def w5(spark, sf):
    budget = threads.thread_budget(10)
    return threads.latest_transcripts(inputs.mailbox(spark, sf), budget).select(
        "thread_id",
        "message_count",
        "kept_messages",
        F.length("transcript").cast("bigint").alias("chars"),
    )


_WAITING = f"""{_M}, {_ANCHORS}, {sql_transcripts(BUDGET)},
asked AS (
  SELECT s.*, t.transcript, regexp_split_to_array(lower(t.transcript), '\\s+') AS w
  FROM lasts l JOIN segments s ON s.message_id = l.anchor_id
       JOIN transcripts t ON t.thread_id = l.thread_id
  WHERE l.role = 'user'
)"""


@query(
    "manual_reply_requests",
    f"""{_WAITING}
    SELECT thread_id, message_id AS anchor_id, sender AS reply_to,
      CASE WHEN lower(trim(subject)) LIKE 're:%' THEN trim(subject)
           ELSE 'Re: ' || trim(subject) END AS reply_subject,
      message_id_header AS in_reply_to,
      CASE WHEN refs = '' THEN message_id_header
           ELSE regexp_replace(refs, '\\s+', ' ', 'g') || ' ' || message_id_header END
        AS reply_references,
      CASE body WHEN '' THEN subject ELSE body END AS turn, transcript,
      {SQL_LANGUAGE} AS language, CAST(NULL AS VARCHAR) AS error FROM asked""",
)
def manual(spark, sf):
    return replies.manual_requests(
        inputs.mailbox(spark, sf), inputs.STAFF_DOMAINS, max_chars=BUDGET
    )


@query(
    "manual_answered_threads",
    f"{_M}, {_ANCHORS} SELECT thread_id, anchor_id FROM lasts WHERE role <> 'user'",
)
def manual_answered(spark, sf):
    return replies.answered_threads(inputs.mailbox(spark, sf), inputs.STAFF_DOMAINS)


# --- lookups ------------------------------------------------------------------------


def _log(spark, sf):
    """A state log in which every other user turn was handled, some twice."""
    c = inputs.table(spark, sf, "conversations")
    message_id = F.concat(
        F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")
    )
    rows = c.where(F.col("turn") % 4 == 0)
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("conv_id"))
    first = rows.select(
        message_id.alias("message_id"),
        F.when(F.col("conv_id") % 2 == 0, F.lit(fixed.OUTCOME_OFF_TOPIC)).alias("outcome"),
        at.alias("processed_at"),
    )
    second = rows.where(F.col("conv_id") % 4 == 0).select(
        message_id.alias("message_id"),
        F.lit(fixed.OUTCOME_DRAFTED).alias("outcome"),
        (at + F.expr("INTERVAL 1 HOUR")).alias("processed_at"),
    )
    return first.unionByName(second)


_LOG = """
log AS (
  SELECT conv_id || ':' || turn AS message_id,
         CASE WHEN conv_id % 2 = 0 THEN 'non_travel' END AS outcome,
         CAST(1767225600 + conv_id AS BIGINT) AS done_at FROM conversations WHERE turn % 4 = 0
  UNION ALL
  SELECT conv_id || ':' || turn, 'drafted', CAST(1767225600 + conv_id + 3600 AS BIGINT)
  FROM conversations WHERE turn % 4 = 0 AND conv_id % 4 = 0
),
current AS (
  SELECT message_id, arg_max(coalesce(outcome, 'drafted'), done_at) AS outcome, max(done_at) AS done_at
  FROM log GROUP BY message_id
)"""


@query("s12_inbox", f"{_M} SELECT {_KEYS} FROM m WHERE role = 'user'")
def s12(spark, sf):
    return inbox.unread(inputs.mailbox(spark, sf), None).select("thread_id", "message_id")


@query(
    "k5_inbox_batch",
    f"""{_M} SELECT {_KEYS} FROM m WHERE role = 'user'
        ORDER BY date_ms DESC NULLS LAST, thread_id, api_pos DESC LIMIT 50""",
)
def k5(spark, sf):
    return inbox.unread(inputs.mailbox(spark, sf)).select("thread_id", "message_id")


@query(
    "s15_state_defaults",
    f"WITH {_LOG} SELECT message_id, coalesce(outcome, 'drafted') AS outcome, done_at FROM log",
)
def s15(spark, sf):
    rows = state.with_default_outcome(_log(spark, sf))
    return rows.select("message_id", "outcome", F.unix_seconds("processed_at").alias("done_at"))


@query("st4_state_upsert", f"WITH {_LOG} SELECT * FROM current")
def st4(spark, sf):
    path = scratch_path(spark, "state")
    state.append_outcomes(_log(spark, sf), path, 0)
    state.append_outcomes(_log(spark, sf), path, 0)
    state.compact(spark, path)
    # The buckets of all ids, then the log of a batch on top.
    state.append_outcomes(_log(spark, sf), path, 1)
    rows = state.outcomes_of(_log(spark, sf), path)
    return rows.select("message_id", "outcome", F.unix_seconds("processed_at").alias("done_at"))


@query("a8_outcome_counts", f"WITH {_LOG} SELECT outcome, count(*) AS messages FROM current GROUP BY outcome")
def a8(spark, sf):
    return health.outcome_counts(state.latest_outcomes(_log(spark, sf)))


@query(
    "j1_unprocessed",
    f"""{_M}, {_LOG} SELECT {_KEYS} FROM m
        WHERE message_id NOT IN (SELECT message_id FROM current)""",
)
def j1(spark, sf):
    found = lookups.unprocessed(
        inputs.mailbox(spark, sf), state.latest_outcomes(_log(spark, sf))
    )
    return found.select("thread_id", "message_id")


@query(
    "j1_stored_outcome",
    f"{_M}, {_LOG} SELECT m.thread_id, m.message_id, c.outcome FROM m LEFT JOIN current c USING (message_id)",
)
def j1_outcome(spark, sf):
    found = lookups.outcomes(
        inputs.mailbox(spark, sf), state.latest_outcomes(_log(spark, sf))
    )
    return found.select("thread_id", "message_id", "outcome")


@query("j2_threads_with_draft", f"{_M} SELECT DISTINCT thread_id FROM m WHERE is_draft")
def j2(spark, sf):
    return lookups.threads_with_draft(inputs.mailbox(spark, sf))


@query(
    "j3_metadata_lookup",
    f"""{_M}, ids AS (SELECT event_id AS pos, (user_id % 120) || ':' || (event_id % 9) AS message_id
                      FROM events)
    SELECT pos, message_id, subject, sender, received_at,
           CASE WHEN m.thread_id IS NULL THEN 'not found' END AS error
    FROM ids LEFT JOIN m USING (message_id)""",
)
def j3(spark, sf):
    events = inputs.table(spark, sf, "events")
    ids = events.select(
        F.col("event_id").alias("pos"),
        F.concat(
            (F.col("user_id") % 120).cast("string"),
            F.lit(":"),
            (F.col("event_id") % 9).cast("string"),
        ).alias("message_id"),
    )
    found = lookups.metadata(ids, inputs.mailbox(spark, sf))
    return found.select("pos", "message_id", "subject", "sender", "received_at", "error")


# --- scanning -------------------------------------------------------------------------

_ROUTED = f"""{_ANCHORED}, {_LOG},
asked AS (
  SELECT a.thread_id, a.anchor_id AS message_id,
    list_has_any(regexp_split_to_array(lower(s.subject || chr(10) || chr(10)
      || left(a.transcript, 8000)), '\\s+'), ['the', 'de', 'und', 'is']) AS related,
    a.thread_id IN (SELECT thread_id FROM m WHERE is_draft) AS has_draft
  FROM anchored a JOIN segments s ON s.message_id = a.anchor_id
  WHERE s.role = 'user'
),
considered AS (
  SELECT k.*, m.date_ms, m.api_pos FROM asked k JOIN m USING (message_id)
  WHERE k.message_id NOT IN (SELECT message_id FROM seen)
),
routed AS (
  SELECT message_id, thread_id, CASE WHEN NOT related THEN 'non_travel'
    WHEN has_draft OR EXISTS (
      SELECT 1 FROM considered o WHERE o.thread_id = c.thread_id AND o.related
        AND (coalesce(o.date_ms, -1), o.api_pos) > (coalesce(c.date_ms, -1), c.api_pos)
    ) THEN 'thread_has_draft' ELSE 'drafted' END AS outcome FROM considered c
)"""
_FIRST = _ROUTED.replace("k.message_id NOT IN (SELECT message_id FROM seen)", "true")
_ROUTED = _ROUTED.replace("FROM seen", "FROM current")
_OPTIONS = scanner.ScanOptions(max_chars=BUDGET, classifier=TOPIC)


_DRY = replace(_OPTIONS, dry_run=True)


def _routed(spark, sf, options=_OPTIONS):
    mailbox = inputs.mailbox(spark, sf)
    known = state.latest_outcomes(_log(spark, sf))
    return scanner.route(inbox.unread(mailbox, None), mailbox, known, options)


@query("st3_route_messages", f"{_ROUTED} SELECT * FROM routed")
def st3(spark, sf):
    return _routed(spark, sf).select("message_id", "thread_id", "outcome")


@query(
    "st3_reply_requests",
    f"""{_ROUTED} SELECT r.message_id, s.sender AS reply_to,
        CASE WHEN lower(trim(s.subject)) LIKE 're:%' THEN trim(s.subject)
             ELSE 'Re: ' || trim(s.subject) END AS reply_subject,
        s.message_id_header AS in_reply_to,
        CASE s.body WHEN '' THEN s.subject ELSE s.body END AS turn, a.transcript
        FROM routed r JOIN segments s USING (message_id)
        JOIN anchored a ON a.anchor_id = r.message_id
        WHERE outcome = 'drafted'""",
)
def st3_requests(spark, sf):
    return scanner.reply_requests(_routed(spark, sf)).select(
        "message_id", "reply_to", "reply_subject", "in_reply_to", "turn", "transcript"
    )


@query(
    "st6_dry_run",
    f"""{_ROUTED} SELECT message_id, CASE WHEN related THEN 'thread_has_draft'
        ELSE 'non_travel' END AS outcome FROM considered WHERE has_draft OR NOT related""",
)
def st6(spark, sf):
    routed = _routed(spark, sf, _DRY)
    return scanner.settled(routed, dry_run=True).select("message_id", "outcome")


def arrivals(spark, sf_dir):
    """The conversation table, one file or a folder of files, as a file stream of message ids, all roles."""
    # A stream refuses the plain path of a file; a pattern finds files and folders.
    source = spark.readStream.schema("conv_id bigint, turn bigint, role string, text string").parquet(
        f"{sf_dir}/conversations*.parquet"
    )
    thread = F.col("conv_id").cast("string")
    return source.where(F.col("role") == "user").select(
        F.concat(thread, F.lit(":"), F.col("turn").cast("string")).alias("message_id"),
        thread.alias("thread_id"),
    )


def _scan(spark, sf, options=_OPTIONS):
    base = scratch_path(spark, "scan")
    mailbox = inputs.mailbox(spark, sf)
    scanner.start_scan(arrivals(spark, sf), mailbox, base, options).awaitTermination()
    return base


@query("st1_scan_once", f"{_FIRST} SELECT message_id, outcome FROM routed")
def st1(spark, sf):
    base = _scan(spark, sf)
    return state.read_state(spark, f"{base}/state").select("message_id", "outcome")


@query("st6_dry_then_real", f"{_FIRST} SELECT message_id, outcome FROM routed")
def st6_real(spark, sf):
    """A dry pass, then a real one, which drafts what the dry one left."""
    base = scratch_path(spark, "scan")
    for options in (_DRY, _OPTIONS):
        scanner.start_scan(
            arrivals(spark, sf), lambda: inputs.mailbox(spark, sf), base, options
        ).awaitTermination()
    return state.read_state(spark, f"{base}/state").select("message_id", "outcome")


@query("st2_scan_loop", f"{_FIRST} SELECT message_id, outcome FROM routed")
def st2(spark, sf):
    """Three passes over the same progress; the first one fails to start."""
    base = scratch_path(spark, "scan")
    tries = iter(range(3))

    def start():
        if next(tries) == 0:
            raise RuntimeError("mail store not reachable")
        return scanner.start_scan(
            arrivals(spark, sf), lambda: inputs.mailbox(spark, sf), base, _OPTIONS
        )

    scanner.scan_loop(start, passes=3, interval_seconds=0)
    return state.read_state(spark, f"{base}/state").select("message_id", "outcome")


@query(
    "st5_error_isolation",
    f"""{_ANCHORED}, asked AS (
      SELECT a.anchor_id AS message_id,
        length(s.subject || '  ' || left(a.transcript, 8000)) % 5 = 0 AS failed,
        a.thread_id IN (SELECT thread_id FROM m WHERE is_draft) AS has_draft,
        s.thread_id, (coalesce(s.date_ms, -1), s.api_pos) AS place
      FROM anchored a JOIN segments s ON s.message_id = a.anchor_id WHERE s.role = 'user'),
    best AS (SELECT thread_id, max(place) AS place FROM asked WHERE NOT failed GROUP BY thread_id)
    SELECT message_id, CASE WHEN failed THEN NULL
        WHEN has_draft OR k.place < b.place THEN 'thread_has_draft' ELSE 'drafted' END AS outcome,
      CASE WHEN failed THEN 'TimeoutError: no answer' END AS error
    FROM asked k LEFT JOIN best b USING (thread_id)""",
)
def st5(spark, sf):
    """A model that fails on some texts: those stay open, the rest is settled."""
    from mailweave.operators.classify import batch_classifier

    def model(body: str) -> str:
        if len(body) % 5 == 0:
            raise TimeoutError("no answer")
        return "yes en"

    options = scanner.ScanOptions(max_chars=BUDGET, classifier=batch_classifier(model))
    base = _scan(spark, sf, options)
    results = spark.read.parquet(f"{base}/results")
    return results.select("message_id", "outcome", "error")


@query(
    "st7_duplicate_delivery",
    f"{_FIRST} SELECT message_id, count(*) AS rows FROM routed GROUP BY message_id",
)
def st7(spark, sf):
    """The same batch delivered twice leaves one state row per message."""
    mailbox = inputs.mailbox(spark, sf)
    base = scratch_path(spark, "scan")
    batch = inbox.unread(mailbox, None).select("message_id", "thread_id")
    for batch_id in (0, 0, 1):
        scanner.process_batch(batch.unionByName(batch), batch_id, mailbox, base, _OPTIONS)
    rows = state.read_state(spark, f"{base}/state")
    return rows.groupBy("message_id").agg(F.count(F.lit(1)).alias("rows"))




_SLICES = """
cut AS (SELECT *, least(5, CAST(floor(6 * (epoch(ts) - lo) / (hi - lo + 1)) AS BIGINT)) AS part
        FROM events, (SELECT min(epoch(ts)) AS lo, max(epoch(ts)) AS hi FROM events))"""


@query(
    "st7_event_time_duplicates",
    f"""WITH {_SLICES}
    SELECT CAST(part AS BIGINT) AS part, count(DISTINCT event_id) AS messages, count(DISTINCT event_id) AS rows
    FROM cut GROUP BY part""",
)
def st7_event_time(spark, sf):
    """The events as a stream of files by time, each with repeats of its own rows and of a third of
    the file before; each event comes out once."""
    events = inputs.table(spark, sf, "events").select("event_id", "ts")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    low, high = events.agg(F.min(seconds), F.max(seconds)).first()
    part = F.least(F.lit(5), F.floor(6 * (seconds - low) / (high - low + 1))).cast("bigint")
    rows = events.select(
        F.col("event_id").cast("string").alias("message_id"), part.alias("part"),
        F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3 == 0).alias("again"),
    )
    source = scratch_path(spark, "arrivals")
    for i in range(6):
        own = rows.where(F.col("part") == i)
        sent = own.unionByName(own.where("again")).unionByName(rows.where((F.col("part") == i - 1) & F.col("again")))
        sent.drop("again").coalesce(1).write.mode("append").parquet(source)
    arrivals = spark.readStream.schema("message_id string, part bigint, at timestamp").option(
        "maxFilesPerTrigger", 1
    ).parquet(source)
    out = scratch_path(spark, "deduplicated")
    lateness = f"{math.ceil((high - low) / 3)} seconds"
    scanner.deduplicated(arrivals, "at", lateness).writeStream.format("parquet").option(
        "checkpointLocation", scratch_path(spark, "progress")
    ).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("part").agg(
        F.count_distinct("message_id").alias("messages"), F.count(F.lit(1)).alias("rows")
    )
