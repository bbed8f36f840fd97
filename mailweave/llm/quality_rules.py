"""Document quality rules with thresholds that follow the data.

Each document gets its counts; per language and source, mergeable KLL sketches hold the
distribution of four measures (symbols per word, repeated lines per word, share of words in
repeated windows, letters per word). A limit is the upper quartile plus FENCE times the spread
of the quartiles (a lower one likewise), where the spread counts as MIN_SPREAD at least. Groups below
MIN_DOCS documents take the merged sketch of their language, languages below it the one
of all documents. The limits join the documents, which are then filtered.

Everything is DataFrame functions; no Python runs on the executors.

Null texts have no words. Null languages and sources are groups of their own. An empty
table gives no rows; repeated rows are judged each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.llm.common import text_column
from mailweave.session import scratch_path

BLANK = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SKETCH_K = 1024
FENCE = 3.0
MIN_DOCS = 100
# Least spread of each measure; a group that does not vary must not reject every deviation.
MIN_SPREAD = {
    "symbols_per_word": 0.05,
    "lines_per_word": 0.02,
    "repeat_share": 0.1,
    "chars_per_word": 0.4,
}
TWO_SIDED = ("chars_per_word",)


def counts(
    df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str
) -> DataFrame:
    """Base counts of every row; each step's arrays are computed once."""
    rows = df.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"), text_column(text_col).alias("text"),
    )
    rows = rows.select(
        "id", "lang", "source",
        F.filter(F.split("text", BLANK), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD_CHAR)).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    last = F.greatest(F.size("words") - 2, F.lit(0))
    windows = F.transform(
        F.slice("words", F.lit(1), last),
        lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2)),
    )
    rows = rows.select(
        "id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Only texts with a repeated window are sorted.
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(
        F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    )
    rows = rows.withColumn(
        "placed", F.when(some, placed).otherwise(F.slice(placed, 1, 0))
    ).drop("windows")

    def same(offset: int):
        return lambda p, i: F.get("placed", i + offset)["w"] == p["w"]

    repeated = F.transform(
        F.filter(
            "placed",
            lambda p, i: F.coalesce(same(-1)(p, i), F.lit(False))
            | F.coalesce(same(1)(p, i), F.lit(False)),
        ),
        lambda p: p["i"],
    )
    rows = rows.withColumn("at", F.sort_array(repeated)).drop("placed")
    covered = F.aggregate(
        "at", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(
            p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")
        ),
        lambda acc: acc["n"].cast("long"),
    )
    return rows.select(
        "id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        covered.alias("n_repeat_words"),
    )


def measures() -> dict[str, Column]:
    """The judged measures; null without words."""
    words = F.when(F.col("n_words") > 0, F.col("n_words").cast("double"))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "lines_per_word": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


def _limits(sketch: str, name: str) -> list[Column]:
    low, high = (
        F.kll_sketch_get_quantile_double(sketch, F.lit(rank)) for rank in (0.25, 0.75)
    )
    spread = F.greatest(high - low, F.lit(MIN_SPREAD[name])) * FENCE
    out = [(high + spread).alias(f"{name}_max")]
    if name in TWO_SIDED:
        out.append((low - spread).alias(f"{name}_min"))
    return out


def limits(judged: DataFrame) -> DataFrame:
    """``(lang_key, source_key, <measure>_max, ...)`` for every language and source."""
    names = list(MIN_SPREAD)
    by_group = judged.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.kll_sketch_agg_double(n, F.lit(SKETCH_K)).alias(n) for n in names],
    )
    merged = [F.kll_merge_agg_double(n, F.lit(SKETCH_K)).alias(f"{n}_up") for n in names]
    by_lang = by_group.groupBy(F.col("lang").alias("lang_up")).agg(
        F.sum("docs").alias("docs_up"), *merged
    )
    # One row of sketches of bounded size.
    overall = by_group.agg(
        *[F.kll_merge_agg_double(n, F.lit(SKETCH_K)).alias(n) for n in names]
    ).first()
    joined = by_group.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_up")))
    chosen = joined.select(
        "lang", "source",
        *[
            F.when(F.col("docs") >= MIN_DOCS, F.col(n))
            .when(F.col("docs_up") >= MIN_DOCS, F.col(f"{n}_up"))
            .otherwise(F.lit(None if overall[n] is None else bytes(overall[n])).cast("binary"))
            .alias(n)
            for n in names
        ],
    )
    return chosen.select(
        F.col("lang").alias("lang_key"), F.col("source").alias("source_key"),
        *[c for n in names for c in _limits(n, n)],
    )


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Counts and verdict of every row: ``(id_col, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept)``."""
    spark = df.sparkSession
    path = scratch_path(spark, "quality-rules")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = counts(df, id_col, text_col, lang_col, source_col).withColumn("base_failed", failed)
    counted.write.parquet(path)
    rows = spark.read.schema(counted.schema).parquet(path).select(
        "*", *[c.alias(n) for n, c in measures().items()]
    )
    found = limits(rows.where(~F.col("base_failed")))
    keys = F.col("lang").eqNullSafe(F.col("lang_key")) & F.col("source").eqNullSafe(
        F.col("source_key")
    )
    inside = ~F.col("base_failed")
    for n in MIN_SPREAD:
        inside = inside & (F.col(n) <= F.col(f"{n}_max"))
        if n in TWO_SIDED:
            inside = inside & (F.col(n) >= F.col(f"{n}_min"))
    return rows.join(found, keys, "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", F.coalesce(inside, F.lit(False)).alias("kept"),
    )
