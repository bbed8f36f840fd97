"""URL filter: fixed rules, and a likelihood ratio of two character models for the rest.

Accepted and rejected URLs (as the rules say) each train a variable-order Markov model over
characters: contexts of 0 to ORDER characters, blended from short to long, where a context
counts as much as it has been seen against how many different characters followed it. A URL
scores the difference of its two log-likelihoods per character. The models see whole URLs, from the
scheme to the fragment; host and path are for the rules and the output. The threshold is
calibrated on the rule-decided URLs that were kept out of training (one in four, by the
checksum of host and path, so that variants of an address stay on one side).

URLs are worked on as windows of a context and a character. Equal windows are looked
up once, joined back by the window and summed; partial sums come before every shuffle,
and adaptive execution splits the join's frequent windows.

Null URLs and URLs without ``://`` have an empty host and path. Null and empty URLs have no score
and are allowed. Without labelled URLs every
score is 0 and the verdict is allow. Repeated rows get the same verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.llm.common import let
from mailweave.session import scratch_path

ORDER = 4
ALPHABET = 256.0  # characters the shortest context is smoothed over
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BINS = 2_000
SALTS = 16
START = "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(found, pattern, 1), UPPER, LOWER)
    return host, F.regexp_extract(found, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def windows(text: Column) -> Column:
    """Every character of a text with the ORDER characters before it."""
    # Characters once as an array: a substring would count its way through the text each time.
    padded = F.split(F.concat(F.lit(START * ORDER), text), "")
    return F.when(
        F.length(text) > 0,
        let(padded, lambda chars: F.transform(
            F.sequence(F.lit(1), F.length(text)),
            lambda i: F.array_join(F.slice(chars, i, ORDER + 1), ""),
        )),
    ).otherwise(F.array().cast("array<string>"))


def salted(df: DataFrame, by: str) -> DataFrame:
    """Adds ``salt``: for the two shortest sizes, whose few keys all texts share, one of SALTS by the
    hash of ``by``, or all of them with ``by="copy"`` (at most alphabet x SALTS rows); else 0."""
    short = F.col("size") <= 2
    if by == "copy":
        salts = F.when(short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return df.withColumn("salt", F.explode(salts))
    return df.withColumn(
        "salt", F.when(short, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
    )


def model(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``(window, good, n)``: counts of grams of every order by class, and of their
    contexts: seen and different followers."""
    orders = F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("size")
    grams = (
        labelled.select("good", "n", "window", orders)
        .select(
            "size", "good", "n",
            F.expr(f"substring(window, {ORDER + 2} - size, size)").alias("gram"),
        )
        .groupBy("size", "gram")
        .agg(
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("good"), F.lit(0)).otherwise(F.col("n"))).alias("bad"),
        )
    )
    contexts = grams.groupBy(
        "size", F.expr("substring(gram, 1, size - 1)").alias("context")
    ).agg(
        F.sum("good").alias("good_seen"), F.sum("bad").alias("bad_seen"),
        F.sum((F.col("good") > 0).cast("long")).alias("good_kinds"),
        F.sum((F.col("bad") > 0).cast("long")).alias("bad_kinds"),
    )
    return grams, contexts


def window_scores(asked: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(window, ratio)``: log-likelihood difference of each distinct window."""
    levels = (
        asked.select("window", F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("size"))
        .withColumn("gram", F.expr(f"substring(window, {ORDER + 2} - size, size)"))
        .withColumn("context", F.expr("substring(gram, 1, size - 1)"))
    )
    numbers = ["good", "bad", "good_seen", "bad_seen", "good_kinds", "bad_kinds"]
    joined = (
        salted(levels, "window").join(salted(grams, "copy"), ["size", "gram", "salt"], "left")
        .join(salted(contexts, "copy"), ["size", "context", "salt"], "left")
        .fillna(0, numbers)
    )
    by_window = joined.groupBy("window").agg(
        F.array_sort(F.collect_list(F.struct("size", *numbers))).alias("levels")
    )

    def chance(side: str) -> Column:
        return F.aggregate(
            "levels", F.lit(1.0 / ALPHABET),
            lambda lower, x: F.when(
                x[f"{side}_seen"] > 0,
                (x[side] + x[f"{side}_kinds"] * lower) / (x[f"{side}_seen"] + x[f"{side}_kinds"]),
            ).otherwise(lower),
        )

    return by_window.select("window", (F.log(chance("good")) - F.log(chance("bad"))).alias("ratio"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row ``limit``: the score that separates ``(score, good)`` with the least sum of
    both classes' error shares; 0 where a class is missing."""
    clipped = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("score")))
    bins = scored.groupBy(F.floor((clipped + 5.0) / 10.0 * BINS).alias("bin")).agg(
        F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b")
    )
    # At most BINS + 1 rows.
    upto, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    def share(side: str) -> Column:
        before = F.coalesce(F.sum(side).over(upto), F.lit(0))
        return F.try_divide(before, F.sum(side).over(whole))

    errors = bins.select("bin", (share("g") + 1 - share("b")).alias("error"))
    at = F.expr("min_by(bin, struct(error, bin))") / BINS * 10.0 - 5.0
    return errors.where("error is not null").agg(F.coalesce(at, F.lit(0.0)).alias("limit"))


def _only(one_row: DataFrame) -> float:
    return float(one_row.first()[0])


def judge(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES
) -> DataFrame:
    """``(id_col, host, path, rule, verdict, score)`` for every row; ``score`` is null where a
    rule decides."""
    spark = df.sparkSession
    folder = scratch_path(spark, "url-filter")

    def written(part: DataFrame, name: str) -> DataFrame:
        part.write.parquet(f"{folder}/{name}")
        return spark.read.schema(part.schema).parquet(f"{folder}/{name}")

    host, path = parts(F.col(url_col))
    rows = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        host.alias("host"), path.alias("path"),
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    # Equal URLs are judged once.
    aside = (F.crc32(F.concat("host", "path")) % 4 == 0).alias("aside")
    texts = written(
        rows.groupBy("url", "verdict", aside).agg(F.count(F.lit(1)).alias("n")), "urls"
    )
    pieces = texts.select("url", "verdict", "aside", "n", F.explode(windows(F.col("url"))).alias("window"))
    train = pieces.where("verdict is not null and not aside").groupBy(
        "window", (F.col("verdict") == "allow").alias("good")
    ).agg(F.sum("n").alias("n"))
    grams, contexts = model(written(train, "train"))
    asked = pieces.where("verdict is null or aside")
    known = window_scores(asked.select("window").distinct(), grams, contexts)
    scored = written(
        asked.join(known, "window").groupBy("url", "verdict")
        .agg(F.avg("ratio").alias("score")), "scored",
    )
    limit = _only(threshold(
        scored.where("verdict is not null").select("score", (F.col("verdict") == "allow").alias("good"))
    ))
    free = scored.where("verdict is null").select("url", "score")
    out = rows.withColumn(
        "url", F.when(F.col("verdict").isNull(), F.col("url"))
    ).join(free, "url", "left")
    said = F.when(F.coalesce("score", F.lit(0.0)) >= limit, F.lit("allow")).otherwise(F.lit("block"))
    return out.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("score").isNull(), F.lit("allow")).otherwise(said)).alias("verdict"),
        "score",
    )
