"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

The model is an interpolated, modified Kneser-Ney n-gram model over UTF-8 bytes, trained on all
trusted documents but one in four, which set the limits. Counts, continuation counts and
context sums are tables keyed by n-gram, each in shards by its key; the distinct n-grams of
the corpus meet them in joins by key, order by order, and nothing of the model is collected
or broadcast but the three discounts of each order.

Documents travel in blocks of ids, packed and compressed, to where the scores of their block's
n-grams are. What a block asks for is its distinct n-grams, so the exchange grows with the
corpus, but far less than one row per word.

A document is rejected when the logarithm of its perplexity is above its language's limit: the
upper quantile of the held-out trusted documents plus a margin that shrinks with the square root
of the length. Languages with few trusted documents use the limit of all.

Null and empty texts have no perplexity and are not rejected. Null languages are one group. If
nothing is trusted, nothing is rejected. Rows with the same id are scored each on its own; one
trusted id makes all of them trusted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.llm.common import offsets, slices
from mailweave.session import scratch_path

ORDER = 4
BLOCK_IDS = 8_192
START = b"\n" * (ORDER - 1)
PACKET_BYTES = 2 << 20  # text of a packet, and so what a task unpacks at a time
DENSE = 1 << 24  # entries of the lookup table of a block; wider blocks are searched
QUANTILE, MARGIN, BASE_BYTES = 0.99, 0.5, 150.0
MIN_TRUSTED = 50


def packed(df: DataFrame) -> DataFrame:
    """``(block, body)``: rows ``(id, lang, text)`` of a block of ids as compressed Arrow batches."""

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for part in slices(batch, 2, PACKET_BYTES):
                table = pa.Table.from_batches([part])
                blocks = part.column(3).to_numpy()
                for block in np.unique(blocks).tolist():
                    sink = pa.BufferOutputStream()
                    chosen = table.filter(pa.array(blocks == block)).select([0, 1, 2])
                    with pa.ipc.new_stream(sink, chosen.schema, options=options) as writer:
                        writer.write_table(chosen.combine_chunks())
                    body = sink.getvalue().to_pybytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([body], pa.binary())],
                        names=["block", "body"],
                    )

    block = F.floor(F.coalesce("id", F.lit(-1)) / BLOCK_IDS).alias("block")
    return df.select("id", "lang", "text", block).mapInArrow(run, "block long, body binary")


def opened(bodies: pa.Array):
    """The packed rows, one packet at a time."""
    for body in bodies.to_pylist():
        yield pa.ipc.open_stream(body).read_all().combine_chunks()


def byte_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of all texts, as a number, and how many each has."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    joined = np.frombuffer(b"".join(START + t for t in raw), np.uint8).astype(np.uint32)
    n = len(joined) - ORDER + 1
    key = joined[:n] << 24
    for j in range(1, ORDER):
        key |= joined[j : n + j] << np.uint32(8 * (ORDER - 1 - j))
    starts = offsets(sizes + ORDER - 1)[:-1]
    keep = np.ones(len(key) + ORDER - 1, bool)
    for j in range(1, ORDER):  # n-grams that begin in the text before
        keep[starts[1:] - j] = False
    return key[keep[: len(key)]], sizes


class Grams:
    """Sums by n-gram over many texts: dense by pairs of byte pairs where these are few."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        found, counts = _tally(keys, weights)
        both = np.concatenate([self.keys, found])
        self.keys, inverse = np.unique(both, return_inverse=True)
        self.counts = np.bincount(
            inverse, np.concatenate([self.counts, counts]), len(self.keys)
        ).astype(np.int64)


def _pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Compact numbers of both byte pairs of every key; the pairs themselves."""
    seen = np.zeros(1 << 16, bool)
    high, low = keys >> np.uint32(16), keys & np.uint32(0xFFFF)
    seen[high] = True
    seen[low] = True
    names = np.flatnonzero(seen)
    number = np.zeros(1 << 16, np.int64)
    number[names] = np.arange(len(names))
    return number, names, len(names)


def _tally(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    number, names, n = _pairs(keys)
    if n * n > DENSE:
        found, inverse = np.unique(keys, return_inverse=True)
        return found, np.bincount(inverse, weights, len(found)).astype(np.int64)
    cell = number[keys >> np.uint32(16)] * n + number[keys & np.uint32(0xFFFF)]
    seen = np.zeros(n * n, bool)
    seen[cell] = True
    at = np.flatnonzero(seen)
    place = np.zeros(n * n, np.int32)
    place[at] = np.arange(len(at), dtype=np.int32)
    sums = np.bincount(place[cell], weights, len(at))
    found = (names[at // n] << 16 | names[at % n]).astype(np.uint32)
    return found, sums.astype(np.int64)


class Scores:
    """Lookup of the log-probability of every key of a block."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order].astype(np.uint32), values[order].astype(np.float32)
        self.table = None
        if len(keys):
            self.number, _, n = _pairs(self.keys)
            if n * n <= DENSE:
                self.n, self.table = n, np.zeros(n * n, np.float32)
                self.table[self.cells(self.keys)] = self.values

    def cells(self, keys: np.ndarray) -> np.ndarray:
        return self.number[keys >> np.uint32(16)] * self.n + self.number[keys & np.uint32(0xFFFF)]

    def of(self, keys: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[self.cells(keys)]
        return self.values[np.searchsorted(self.keys, keys)]


def held_out(c: Column) -> Column:
    """One in four ids, by checksum."""
    return F.crc32(c.cast("string")) % 4 == 3


def block_grams(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``(block, gram, n)``: the distinct n-grams of each block of documents, and how often
    each occurs in its training documents."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("id").combine_chunks().to_numpy()
        grams = Grams()
        for rows in opened(left.column("body").combine_chunks()):
            if not rows.num_rows:
                continue
            keys, sizes = byte_grams(rows.column(2).combine_chunks())
            own = rows.column(0).combine_chunks()
            usable = own.is_valid().to_numpy(zero_copy_only=False)
            usable &= np.isin(own.fill_null(-1).to_numpy(), ids)
            grams.add(keys, np.repeat(usable, sizes).astype(np.float64))
        n = len(grams.keys)
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * n, pa.int64()),
                "gram": pa.array(grams.keys.astype(np.int64)), "n": pa.array(grams.counts),
            }
        )

    return docs.groupBy("block").cogroup(training.groupBy("block")).applyInArrow(
        run, "block long, gram long, n long"
    )


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more."""
    ns = counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in ns)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5

    def part(k: int, a: float, b: float) -> float:
        d = k - (k + 1) * y * b / a if a else 0.5 * k
        return min(max(d, 0.1), k - 0.05)

    return part(1, n1, n2), part(2, n2, n3), part(3, n3, n4)


def probabilities(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """``(gram, logp)`` of each n-gram in ``asked (gram)`` under the model of ``counts (gram, n)``."""
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts
        tail = (F.col("gram") % (1 << (8 * k))).alias("gram")
        by_order[k] = by_order[k + 1].groupBy(tail).agg(F.count(F.lit(1)).alias("n"))
    out = asked.withColumn("p", F.lit(1.0 / 256))
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(by_order[k])
        n = F.col("n")
        cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        grams = by_order[k].select(F.col("gram").alias("tail"), (n - cut).alias("left"))
        contexts = by_order[k].groupBy(F.shiftright("gram", 8).alias("context")).agg(
            F.sum("n").cast("double").alias("total"), F.sum(cut).alias("given")
        )
        out = (
            out.withColumn("tail", F.col("gram") % (1 << (8 * k)))
            .withColumn("context", F.shiftright("tail", 8))
            .join(grams, "tail", "left").join(contexts, "context", "left")
            .select(
                "gram",
                F.when(
                    F.col("total") > 0,
                    (F.coalesce("left", F.lit(0.0)) + F.col("given") * F.col("p")) / F.col("total"),
                ).otherwise(F.col("p")).alias("p"),
            )
        )
    return out.select("gram", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, scores: DataFrame, kind: str) -> DataFrame:
    """``(id, lang, n_bytes, log_prob)`` of every document from ``(block, gram, logp)``."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        scores = Scores(right.column("gram").to_numpy(), right.column("logp").to_numpy())
        out = []
        for rows in opened(left.column("body").combine_chunks()):
            if not rows.num_rows:
                continue
            keys, sizes = byte_grams(rows.column(2).combine_chunks())
            ends = offsets(sizes)
            run = np.zeros(len(keys) + 1)
            if len(keys):
                np.cumsum(scores.of(keys), out=run[1:], dtype=np.float64)
            out.append(
                pa.table(
                    [rows.column(0), rows.column(1), pa.array(sizes),
                     pa.array(run[ends[1:]] - run[ends[:-1]])],
                    names=["id", "lang", "n_bytes", "log_prob"],
                )
            )
        empty = pa.table(
            {"id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()),
             "n_bytes": pa.array([], pa.int64()), "log_prob": pa.array([], pa.float64())}
        )
        return pa.concat_tables(out) if out else empty

    return docs.groupBy("block").cogroup(scores.groupBy("block")).applyInArrow(
        run, f"id {kind}, lang string, n_bytes long, log_prob double"
    )


def _with_limits(rows: DataFrame) -> DataFrame:
    """Adds ``limit`` from the held-out trusted rows of the language."""
    held = rows.where("held_out and n_bytes > 0")
    level = F.percentile_approx("level", QUANTILE, 10_000)
    by_lang = held.groupBy(F.col("lang").alias("lang_key")).agg(
        level.alias("own"), F.count(F.lit(1)).alias("docs")
    )
    overall = held.agg(level).first()[0]  # one number
    limit = F.when(F.col("docs") >= MIN_TRUSTED, F.col("own")).otherwise(F.lit(overall).cast("double"))
    return rows.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_key")), "left").withColumn(
        "limit", limit
    ).drop("lang_key", "own", "docs")


def slack() -> Column:
    """Allowance for the chance of short texts."""
    return F.lit(MARGIN) * F.sqrt(F.lit(BASE_BYTES) / F.greatest(F.col("n_bytes"), F.lit(1)))


def quality(
    df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``(id_col, n_bytes, perplexity, max_perplexity, rejected)`` for every row of ``df``; ids are
    integers, and ``trusted`` has those of the trusted documents in its column ``id_col``."""
    spark = df.sparkSession
    folder = scratch_path(spark, "kneser-ney")

    def written(part: DataFrame, name: str) -> DataFrame:
        part.write.parquet(f"{folder}/{name}")
        return spark.read.schema(part.schema).parquet(f"{folder}/{name}")

    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    known = trusted.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    docs = packed(rows)
    block = F.floor(F.col("id") / BLOCK_IDS).alias("block")
    grams = written(block_grams(docs, known.where(~held_out(F.col("id"))).select(block, "id")), "grams")
    counts = written(grams.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    known_p = written(probabilities(grams.select("gram").distinct(), counts), "scores")
    answers = grams.select("block", "gram").join(known_p, "gram").select("block", "gram", "logp")
    scored = written(perplexities(docs, answers, "long"), "scored")
    level = (-F.col("log_prob") / F.when(F.col("n_bytes") > 0, F.col("n_bytes"))).alias("level")
    marked = scored.select("id", "lang", "n_bytes", level).join(
        known.select("id", F.lit(True).alias("trusted")), "id", "left"
    )
    marked = marked.withColumn(
        "held_out", F.coalesce("trusted", F.lit(False)) & held_out(F.col("id"))
    )
    limited = _with_limits(marked)
    return limited.select(
        F.col("id").alias(id_col), "n_bytes",
        F.exp("level").alias("perplexity"), F.exp(F.col("limit") + slack()).alias("max_perplexity"),
        F.coalesce(F.col("level") > F.col("limit") + slack(), F.lit(False)).alias("rejected"),
    )
