"""Registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm import (
    alignment,
    bpe,
    chat_format,
    fingerprints,
    jaccard,
    kneser_ney,
    language,
    packing,
    prefix_trie,
    quality_rules,
    secrets,
    token_counts,
    url_filter,
)
from mailweave.llm.common import hex_digest

Query = Callable[[SparkSession, str], DataFrame]
BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> bpe.Vocabulary:
    return bpe.load(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and digest both."""
    v = vocabulary(BYTE_BPE)
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), v), v)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        hex_digest(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_groups(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        hex_digest(joined(F.filter("spans", lambda s: s["kind"] != "novel"))).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    aside = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    model = language.train(docs.where(~aside))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", aside, "lang_pred", "score")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", hex_digest(F.col("edited")).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next",
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = alignment.load_sides(public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))
    return alignment.align(table(spark, sf_dir, "documents"), sides)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


# The CRC-32 of an id's digits, bit by bit.
_CRC32 = """
  xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda acc, code: list_reduce(
      list_prepend(xor(acc, code), range(8)),
      lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))
"""

OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, count(*) AS own, {_CRC32} % 9 AS h FROM turns GROUP BY c),
plan AS (
  SELECT v.c, v.h, v.c - v.c % 5 AS base, v.own,
         least(v.h, coalesce(b.own, 0)) AS k FROM convs v LEFT JOIN convs b ON b.c = v.c - v.c % 5),
rebuilt AS (
  SELECT l.c, t.p AS d, t.role, t.text FROM plan l JOIN turns t ON t.c = l.base AND t.p <= l.k
  UNION ALL
  SELECT l.c, l.k + t.p - l.h, t.role, t.text FROM plan l JOIN turns t ON t.c = l.c AND t.p > l.h),
paths AS (
  SELECT c, d, strlen(text) AS bytes, string_agg(sha256(strlen(role) || ':' || role || text), '')
           OVER (PARTITION BY c ORDER BY d) AS path,
         d = max(d) OVER (PARTITION BY c) AS is_last FROM rebuilt
  UNION ALL
  SELECT c, 0, 0, '', k + greatest(own - h, 0) = 0 FROM plan),
nodes AS (
  SELECT path, d, any_value(bytes) AS bytes, min(c) AS c, count(*) AS n,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE is_last), '')) AS ends
  FROM paths GROUP BY path, d),
-- A node lies below all nodes on the path of its smallest member.
below AS (
  SELECT p.path AS above, p.d AS above_d, v.path, v.d, (v.n - 1) * v.bytes AS saved
  FROM nodes v JOIN paths p ON p.c = v.c AND p.d <= v.d),
children AS (SELECT above AS path, above_d AS d, count(*) AS n FROM below WHERE d = above_d + 1 GROUP BY 1, 2),
sums AS (
  SELECT b.above AS path, b.above_d AS d, sum(b.saved) AS saved,
         count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM below b LEFT JOIN children k ON k.path = b.path AND k.d = b.d GROUP BY 1, 2),
tops AS (
  SELECT b.path, b.d, a.c FROM below b JOIN nodes a ON a.path = b.above AND a.d = b.above_d
  WHERE b.above_d = b.d - 1)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, t.c AS parent_conv_id, n.n::BIGINT AS n_convs,
       coalesce(k.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path AND s.d = n.d
LEFT JOIN children k ON k.path = n.path AND k.d = n.d
LEFT JOIN tops t ON t.path = n.path AND t.d = n.d
"""

# Conversation -7: what the template's own control strings do inside texts.
TRAP_ID, TRAP_TEXT = -7, "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and read the turns and the text under the mask back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(TRAP_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRAP_TEXT).alias("text"),
    )
    done = chat_format.format_chats(turns.unionByName(trap))
    read = done.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat_format.read_spans(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    joined = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        hex_digest(joined).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), hex_digest(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


def _escaped_length(column: str, control: list[str]) -> str:
    """SQL for the length of an escaped string."""
    sql = column
    for i, mark in enumerate(control):
        quoted = "chr(10)" if mark == "\n" else "'" + mark + "'"
        sql = f"replace({sql}, {quoted}, '\\{i}')"
    return f"length({sql})"


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {TRAP_ID}, 0, 'user', '{TRAP_TEXT}'
  UNION ALL SELECT {TRAP_ID}, 1, 'assistant', '{TRAP_TEXT}'),
numbered AS (
  SELECT *, row_number() OVER w AS p, coalesce(lag(role) OVER w <> role, true) AS head
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
joined AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY p) AS whole,
         coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum({_escaped_length("text", chat_format.CONTROL)} + CASE WHEN head THEN
           {len(chat_format.OPEN + chat_format.HEAD_END + chat_format.CLOSE)}
           + {_escaped_length("role", chat_format.ROLE_CONTROL)} ELSE {len(chat_format.NEXT)} END) AS chars
  FROM numbered GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM joined
"""

QUERIES: dict[str, Query] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_jaccard_groups": op2_jaccard_groups,
    "op3_token_counts": op3_token_counts,
    "op4_pack_sequences": op4_pack_sequences,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scan": op6_secret_scan,
    "op7_kneser_ney_quality": op7_kneser_ney_quality,
    "op8_url_filter": op8_url_filter,
    "op9_language_spans": op9_language_spans,
    "op10_fingerprints": op10_fingerprints,
    "op11_token_alignment": op11_token_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_chat_format": op13_chat_format,
}
ORACLES: dict[str, str] = {"op12_prefix_trie": OP12_SQL, "op13_chat_format": OP13_SQL}
