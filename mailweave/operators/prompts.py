"""Prompt blocks and the prompt table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.functions.answers import language_name
from mailweave.functions.text import latest_turn
from mailweave.operators.skew import number_rows

# Characters of an example block that may be sent to executors; no model reads more at once.
MAX_EXAMPLE_CHARS = 8_000_000


class PoolTooLargeError(ValueError):
    """The example pool is larger than the caller allows."""


def _joined(order: str, rendered: Column) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), rendered.alias("text"))))
    return F.array_join(F.transform(pairs, lambda p: p["text"]), "\n\n")


def reference_blocks(hits: DataFrame) -> DataFrame:
    """One delimited block per query from its ranked hits (at most k rows each)."""
    rendered = F.concat(F.lit("Source: "), F.col("source_path"), F.lit("\n"), F.col("text"))
    return hits.groupBy("query_id").agg(
        F.concat(
            F.lit(fixed.REFERENCE_OPEN + "\n\n"),
            _joined("rank", rendered),
            F.lit("\n\n" + fixed.REFERENCE_CLOSE),
        ).alias("reference_block")
    )


def numbered_examples(exemplars: DataFrame) -> DataFrame:
    """Examples in title order with their rendered text, one row each."""
    keyed = exemplars.withColumn("_title", F.lower("title"))
    placed = number_rows(keyed, [F.col("_title"), F.col("source_id")], "example_no")
    return placed.select(
        "example_no",
        "title",
        "source_id",
        F.concat(
            F.lit("Example "),
            F.col("example_no").cast("string"),
            F.lit(" — "),
            F.col("title"),
            F.lit("\n"),
            F.col("text"),
        ).alias("example"),
    )


def example_parts(exemplars: DataFrame) -> DataFrame:
    """The pool as the rows ``(part_no, part)`` of one delimited block; none for an empty pool.

    Part 0 opens the block, the last one closes it. In this order, with a blank line between
    any two, the parts are the block. It stays a table however large the pool is.
    """
    examples = numbered_examples(exemplars)
    edges = examples.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    opening = F.lit(f"{fixed.EXAMPLES_HEADER}\n\n{fixed.EXAMPLES_OPEN}")
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("part_no"), opening.alias("part")),
                F.struct(
                    (F.col("n") + 1).alias("part_no"), F.lit(fixed.EXAMPLES_CLOSE).alias("part")
                ),
            )
        )
    )
    return examples.select(
        F.col("example_no").cast("bigint").alias("part_no"), F.col("example").alias("part")
    ).unionByName(ends)


def block_text(parts: DataFrame, max_chars: int = MAX_EXAMPLE_CHARS) -> str:
    """The block of :func:`example_parts` as one string, '' for an empty pool.

    A pool above ``max_chars`` is refused before any part is read: it fits no prompt.
    """
    size = parts.agg(F.sum(F.length("part").cast("bigint") + 2)).first()[0] or 0
    if size > max_chars:
        raise PoolTooLargeError(f"example pool has {size} characters, limit {max_chars}")
    return "\n\n".join(r.part for r in parts.orderBy("part_no").collect())


def prompt_opening(language: Column, turn: Column, transcript: Column, reference_block: Column) -> Column:
    """The prompt up to the place of the examples."""
    wording = F.replace(F.lit(fixed.PROMPT_LANGUAGE), F.lit("{lang}"), language_name(language))
    reference = F.coalesce(reference_block, F.lit(""))
    return F.concat(
        wording,
        F.lit(fixed.PROMPT_TASK),
        latest_turn(turn, transcript),
        F.lit("\n\n"),
        F.when(
            reference != "",
            F.concat(F.lit(fixed.PROMPT_REFERENCE_USE), reference, F.lit("\n\n")),
        ).otherwise(""),
    )


def prompt_closing(language: Column, transcript: Column) -> Column:
    """The prompt from the end of the examples on."""
    closing = F.replace(F.lit(fixed.PROMPT_REPLY), F.lit("{lang}"), language_name(language))
    return F.concat(F.lit(fixed.PROMPT_THREAD), transcript, F.lit("\n\n"), closing)


def prompt_table(
    threads: DataFrame,
    blocks: DataFrame,
    pool: str | None = None,
    system: str | None = None,
) -> DataFrame:
    """(thread_id, language, turn, transcript) rows to prompts with their examples by reference.

    ``blocks`` is keyed by ``query_id`` = thread id; ``pool`` names the example pool that
    :func:`send_prompts` fills in; ``system``, where given, is a column beside the prompt. A
    prompt is ``opening``, the pool named in ``examples`` if there is one, and ``closing``.
    Examples only belong below a reference block, so ``examples`` is null without one.
    """
    joined = threads.join(
        blocks.withColumnRenamed("query_id", "thread_id"), "thread_id", "left"
    )
    extra = [] if system is None else [F.lit(system).alias("system")]
    language, transcript = F.col("language"), F.col("transcript")
    named = F.when(F.coalesce("reference_block", F.lit("")) != "", F.lit(pool).cast("string"))
    return joined.select(
        "thread_id",
        *extra,
        prompt_opening(language, F.col("turn"), transcript, F.col("reference_block")).alias("opening"),
        named.alias("examples"),
        prompt_closing(language, transcript).alias("closing"),
    )


def whole_prompts(
    table: DataFrame, parts: DataFrame | None = None, max_chars: int = MAX_EXAMPLE_CHARS
) -> DataFrame:
    """:func:`prompt_table` with every prompt written out as ``prompt``, its examples included.

    The example block, within ``max_chars``, goes to the executors once and is put into a prompt
    where the prompt is written.
    """
    block = "" if parts is None else block_text(parts, max_chars)
    sent = table.sparkSession.createDataFrame([(block and f"{block}\n\n",)], "_block string")
    shown = F.when(F.col("examples").isNull(), "").otherwise(F.col("_block"))
    kept = [c for c in table.columns if c not in ("opening", "examples", "closing")]
    return table.crossJoin(F.broadcast(sent)).select(
        *kept, F.concat("opening", shown, "closing").alias("prompt")
    )


def send_prompts(
    table: DataFrame,
    answer: Callable[[str], str],
    parts: DataFrame | None = None,
    max_chars: int = MAX_EXAMPLE_CHARS,
) -> DataFrame:
    """``(thread_id, reply, error)``: every prompt of :func:`prompt_table` given to ``answer``.

    The example block reaches an executor once, within ``max_chars``, and is put into a prompt
    at the moment it is sent, so no table holds it more than once. A prompt whose call fails
    has no reply and the failure as ``error``. An answer that is not a text is an error too.
    """
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast("" if parts is None else block_text(parts, max_chars))
    kind = table.schema["thread_id"].dataType.simpleString()

    def reply(opening: str, examples: str | None, closing: str) -> tuple[str | None, str | None]:
        block = "" if examples is None or not sent.value else sent.value + "\n\n"
        try:
            said = answer(opening + block + closing)
            if not isinstance(said, str):
                raise TypeError(f"answer is {type(said).__name__}, not str")
        except Exception as problem:  # one prompt must not end the batch
            return None, f"{type(problem).__name__}: {problem}"
        return said, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
            replies = [reply(*row) for row in given]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r for r, _ in replies], pa.string()),
                    pa.array([e for _, e in replies], pa.string()),
                ],
                names=["thread_id", "reply", "error"],
            )

    asked = table.select("thread_id", "opening", "examples", "closing")
    return asked.mapInArrow(run, f"thread_id {kind}, reply string, error string")
