"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before kept.
The first four return the columns of ``documents``; the last one returns the pieces of the
packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm import jaccard, kneser_ney, language, packing, secrets
from mailweave.llm.common import without
from mailweave.llm.queries import WORD_BPE, trusted, vocabulary
from mailweave.session import materialize, scratch_path

# Share of a text's letters that its main language must have.
LEAST_SHARE = 0.5
ROW = "_row"
# Near copies: so much Jaccard similarity of the sets of word shingles of this width.
COPY_WORDS, COPY_PERCENT = 5, 80


def _with_row_numbers(docs: DataFrame) -> DataFrame:
    """The documents with a number of its own for every row, stored so that it stays: ids may be
    null or come several times, and a decision is about a row."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that read unlike trusted text."""
    rows = _with_row_numbers(docs)
    known = rows.select("doc_id", ROW).join(trusted(spark, sf_dir), "doc_id", "left_semi")
    judged = kneser_ney.quality(rows, known.select(ROW), id_col=ROW)
    return rows.join(judged.where("rejected").select(ROW), ROW, "left_anti").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letters or no main language."""
    aside = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.train(docs.where(~F.coalesce(aside, F.lit(False))))
    # Rows go through the operator whole, as ids of their own.
    whole = docs.select(F.struct(*docs.columns).alias(ROW), "text")
    found = language.identify(whole, model, id_col=ROW)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select(f"{ROW}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least id.

    Near copies share at least COPY_PERCENT of their shingles of COPY_WORDS words; op2 has limits
    of its own. Texts without words are no copies of each other.
    """
    rows = _with_row_numbers(docs)
    key = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", ROW).alias("key")
    groups = jaccard.linked_groups(
        rows.select(key, "text"), id_col="key", width=COPY_WORDS, percent=COPY_PERCENT
    )
    others = materialize(groups.where("key <> component_id").select(f"key.{ROW}"), "copies")
    return without(rows, others, ROW).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secrets.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    pieces = packing.pack(docs, vocabulary(WORD_BPE))
    return pieces.withColumn("ids_crc32", F.crc32("token_bytes")).drop("token_bytes")


STAGES = [
    ("quality classifier", quality_classifier),
    ("language id", language_id),
    ("n-gram jaccard join", near_duplicates),
    ("secret scan", secret_scan),
    ("packing", pack),
]
# The language model, the word scores and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
