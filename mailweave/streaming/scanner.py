"""Routing of new messages to outcomes, as a batch and as a stream."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailweave.functions import fixed, mail
from mailweave.operators import lookups, skew, threads
from mailweave.operators.classify import Classifier, classify_topic
from mailweave.session import materialize, remove
from mailweave.sources import state
from mailweave.sources.inbox import thread_messages

# A mailbox table, or a function that reads it anew for every batch.
Mailbox = DataFrame | Callable[[], DataFrame]
_LOG = logging.getLogger(__name__)
_IDS = "message_id string, thread_id string"


@dataclass(frozen=True)
class ScanOptions:
    """Settings of a scan pass.

    ``remember_drafts``: a thread drafted by an earlier batch counts as having a
    draft. Turn it off where the mailbox itself shows the drafts that ``send`` makes;
    a thread can then get a new draft once the old one was sent or deleted.
    ``event_time`` names the column of a stream's arrivals with the time they carry; repeats within
    ``lateness`` are then dropped before they reach a batch.
    """

    max_chars: int = fixed.THREAD_MAX_CHARS
    dry_run: bool = False
    classifier: Classifier | None = None
    hot_rows: int = skew.HOT_ROWS
    remember_drafts: bool = True
    event_time: str | None = None
    lateness: str = "1 day"


def route(
    new_messages: DataFrame,
    mailbox: DataFrame,
    processed: DataFrame,
    options: ScanOptions = ScanOptions(),
    drafted_threads: DataFrame | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Outcome of every new message that has none yet.

    ``new_messages`` needs ``message_id, thread_id``; a message delivered twice
    counts once. Cheap tests come first: stored state, then topic, then drafts.
    ``outcome`` is null where the classifier failed or the message is not in its
    thread; such rows carry an ``error`` and stay open for the next pass.

    A thread gets one draft: its newest message on the topic, in inbox order. The
    others count as ``thread_has_draft``, as do all messages on the topic of threads in
    ``drafted_threads`` or with a draft in the mailbox. A dry run makes no draft, so
    there every such message would be drafted. ``folder`` takes intermediate tables.
    """
    fresh = new_messages.select("message_id", "thread_id").dropDuplicates(["message_id"])
    candidates = materialize(lookups.unprocessed(fresh, processed), "candidates", folder)
    turn = F.when(F.col("body") != "", F.col("body")).otherwise(F.col("subject"))
    # The threads concerned are read and parsed once.
    context = materialize(
        threads.render(thread_messages(mailbox, candidates), options.max_chars).select(
            "thread_id",
            "message_id",
            "api_pos",
            "date_ms",
            "is_draft",
            "tail",
            "tail_chars",
            "subject",
            "sender",
            "message_id_header",
            "references",
            turn.alias("turn"),
        ),
        "context",
        folder,
    )
    transcripts = threads.transcripts_of(
        threads.segment_rows(context),
        candidates.select("thread_id", F.col("message_id").alias("anchor_id")),
        options.max_chars,
        options.hot_rows,
    )
    parsed = context.where(~F.col("is_draft")).select(
        "thread_id",
        "message_id",
        "subject",
        "sender",
        "message_id_header",
        "references",
        "turn",
        "date_ms",
        "api_pos",
    )
    keys = ["thread_id", "message_id"]
    asked = classify_topic(
        candidates.join(parsed, keys, "left").join(
            transcripts.select(
                "thread_id", F.col("anchor_id").alias("message_id"), "transcript"
            ),
            keys,
            "left",
        ),
        "subject",
        "transcript",
        options.classifier,
    )
    drafts = context.where("is_draft").select("thread_id")
    if drafted_threads is not None:
        drafts = drafts.unionByName(drafted_threads.select("thread_id"))
    drafted = drafts.distinct().withColumn("_has_draft", F.lit(True))
    missing = F.when(F.col("transcript").isNull(), F.lit("message not found in its thread"))
    # Written before the choice below, so that no message is classified twice.
    judged = materialize(
        asked.join(drafted, "thread_id", "left").withColumn(
            "error", F.coalesce(missing, F.col("error"))
        ),
        "judged",
        folder,
    )
    waiting = judged.where("error IS NULL AND related AND _has_draft IS NULL")
    if not options.dry_run:
        newest = F.max(F.struct("date_ms", "api_pos", "message_id"))
        waiting = waiting.groupBy("thread_id").agg(newest.alias("_newest")).select(
            F.col("_newest.message_id").alias("message_id")
        )
    chosen = waiting.select("message_id", F.lit(True).alias("_chosen"))
    outcome = (
        F.when(F.col("error").isNotNull(), F.lit(None))
        .when(~F.col("related"), F.lit(fixed.OUTCOME_OFF_TOPIC))
        .when(F.col("_chosen"), F.lit(fixed.OUTCOME_DRAFTED))
        .otherwise(F.lit(fixed.OUTCOME_HAS_DRAFT))
    )
    return (
        judged.join(chosen, "message_id", "left")
        .withColumn("outcome", outcome)
        .select(
            "message_id",
            "thread_id",
            "outcome",
            "error",
            "language",
            F.col("sender").alias("reply_to"),
            mail.reply_subject(F.col("subject")).alias("reply_subject"),
            F.col("message_id_header").alias("in_reply_to"),
            mail.reference_chain(F.col("references"), F.col("message_id_header")).alias(
                "reply_references"
            ),
            "turn",
            "transcript",
        )
    )


def reply_requests(routed: DataFrame) -> DataFrame:
    """Rows that ask for a reply."""
    return routed.where(F.col("outcome") == fixed.OUTCOME_DRAFTED).drop("error")


def settled(routed: DataFrame, *, dry_run: bool) -> DataFrame:
    """Rows whose outcome is stored; a dry run stores only the skips."""
    done = routed.where(F.col("outcome").isNotNull())
    if dry_run:
        done = done.where(F.col("outcome") != fixed.OUTCOME_DRAFTED)
    return done


def _open_rows(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Messages that the batch before left open; each batch carries over what stays open."""
    before = [int(b) for b in state.batches(spark, path) if int(b) < batch_id]
    return spark.read.schema(_IDS).parquet(f"{path}/batch={max(before)}") if before else None


def deduplicated(arrivals: DataFrame, event_time: str, lateness: str) -> DataFrame:
    """Each message of a stream once, by the time it carries.

    Repeats that come at most ``lateness`` after the first one are dropped, and so are rows that are
    late by more than that; ids older than the watermark are forgotten, so the state is bounded by
    ``lateness``. Later repeats meet the stored outcomes.
    """
    return arrivals.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["message_id"])


def process_batch(
    batch: DataFrame,
    batch_id: int,
    mailbox: Mailbox,
    base: str,
    options: ScanOptions = ScanOptions(),
    send: Callable[[DataFrame, int], None] | None = None,
) -> None:
    """Route one batch, hand over reply requests, then store the outcomes.

    All writes are keyed by the batch id and what the batch itself stored before
    is left out of its view, so a replay gives the same tables. The routed rows are
    written once and read back for both uses. ``send`` receives the reply requests
    and must be idempotent per batch id.

    Open messages are carried from batch to batch in a small table, and stored outcomes and drafted
    threads are looked up for the batch's own ids only, so what a batch reads does not grow with
    the history. Every few batches the stores are compacted.

    A dry run keeps results of its own (``dry-results``) and stores only the skips,
    under batch keys of its own, so a real pass later drafts what it left.
    """
    spark = batch.sparkSession
    kind = "dry-" if options.dry_run else ""
    key = f"{kind}{batch_id}"
    results, work = f"{base}/{kind}results", f"{base}/work-{key}"
    fresh = batch.select("message_id", "thread_id")
    held = _open_rows(spark, f"{base}/{kind}open", batch_id)
    if held is not None:
        fresh = fresh.unionByName(held)
    # Batches before this one have ended and will not run again.
    for store in ("state", "drafts"):
        state.compact(spark, f"{base}/{store}", key, state.COMPACT_AFTER)
    known = state.outcomes_of(fresh, f"{base}/state", without_batch=key)
    drafted = None
    if options.remember_drafts and not options.dry_run:
        ours = fresh.select(F.col("thread_id").alias("message_id"))
        drafted = state.outcomes_of(ours, f"{base}/drafts", without_batch=key).select(
            F.col("message_id").alias("thread_id")
        )
    messages = mailbox() if callable(mailbox) else mailbox
    target = f"{results}/batch={batch_id}"
    try:
        routed = route(fresh, messages, known, options, drafted, work)
        routed.write.mode("overwrite").parquet(target)
    finally:
        remove(spark, work)
    routed = spark.read.parquet(target)
    if send is not None and not options.dry_run:
        send(reply_requests(routed), batch_id)
    routed.where(F.col("outcome").isNull()).select("message_id", "thread_id").write.mode(
        "overwrite"
    ).parquet(f"{base}/{kind}open/batch={batch_id}")
    rows = settled(routed, dry_run=options.dry_run).withColumn("processed_at", F.current_timestamp())
    if not options.dry_run:
        threads_drafted = reply_requests(rows).select(
            F.col("thread_id").alias("message_id"), "outcome", "processed_at"
        )
        state.append_outcomes(threads_drafted, f"{base}/drafts", key)
    state.append_outcomes(rows, f"{base}/state", key)


def start_scan(
    arrivals: DataFrame,
    mailbox: Mailbox,
    base: str,
    options: ScanOptions = ScanOptions(),
    send: Callable[[DataFrame, int], None] | None = None,
    *,
    once: bool = True,
    interval_seconds: int = fixed.SCAN_INTERVAL_SECONDS,
) -> StreamingQuery:
    """Scan a stream of arriving messages.

    ``once`` handles what is there and stops; otherwise a pass runs every
    ``interval_seconds``. A long stream needs ``mailbox`` as a function, for a table
    of files does not see mail that arrives later. A dry run has progress of its own.
    """
    kind = "dry-" if options.dry_run else ""
    if options.event_time:
        arrivals = deduplicated(arrivals, options.event_time, options.lateness)
    writer = arrivals.writeStream.option("checkpointLocation", f"{base}/{kind}progress")
    trigger = {"availableNow": True} if once else {"processingTime": f"{interval_seconds} seconds"}
    return (
        writer.foreachBatch(
            lambda batch, batch_id: process_batch(
                batch, batch_id, mailbox, base, options, send
            )
        )
        .trigger(**trigger)
        .start()
    )


def scan_loop(
    start: Callable[[], StreamingQuery],
    *,
    passes: int | None = None,
    interval_seconds: float = fixed.SCAN_INTERVAL_SECONDS,
) -> str | None:
    """Run passes with a pause between them; a failing pass does not end the loop.

    Every error is logged and the last one returned. ``passes`` bounds the loop; None
    runs forever.
    """
    last: str | None = None
    done = 0
    while passes is None or done < passes:
        if done:
            time.sleep(interval_seconds)
        try:
            start().awaitTermination()
        except Exception as exc:  # noqa: BLE001 - the next pass retries
            last = str(exc)
            _LOG.exception("scan pass failed")
        done += 1
    return last
