"""Queries for embedding, retrieval, prompts and model answers."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from mailweave.functions import answers, fixed
from mailweave.functions import text as tx
from mailweave.functions.redact import sanitize
from mailweave.functions.vectors import unit
from mailweave.operators import classify, embedding, exemplars, prompts, retrieval, threads
from mailweave.operators.chunking import chunk_documents
from mailweave.operators.messages import message_parts
from mailweave.plans import inputs
from mailweave.plans.corpus import SQL_CHUNKS, _write
from mailweave.plans.redaction import sql_sanitize
from mailweave.plans.registry import query
from mailweave.session import materialize
from mailweave.sources import index_store

_SCORE = """round(list_sum(list_transform(list_zip(v.unit, q.vector),
    lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(q.vector, lambda x: x * x))), 12)"""
_UNIT_SCORE = """round(list_sum(list_transform(list_zip(v.unit, list_transform(q.vector,
    lambda x: CAST(CAST(x / sqrt(list_sum(list_transform(q.vector, lambda y: y * y)))
                        AS FLOAT) AS DOUBLE))), lambda p: p[1] * p[2])), 12)"""


@query(
    "k1_top_k",
    f"""WITH {inputs.SQL_VECTORS}, {inputs.SQL_MEAN_QUERY}
    SELECT source_id, chunk_index, text, round(score, 6) AS score FROM (
      SELECT v.*, {_SCORE} AS score FROM vecs v, mean_query q)
    ORDER BY score DESC, source_id, chunk_index LIMIT 10""",
)
def k1(spark, sf):
    hits = retrieval.top_k(inputs.vectors(spark, sf), inputs.mean_query(spark, sf), 10)
    return hits.select("source_id", "chunk_index", "text", F.round("score", 6).alias("score"))


@query(
    "j4_similarity",
    f"""WITH {inputs.SQL_VECTORS}, {inputs.SQL_MEAN_QUERY}
    SELECT source_id, chunk_index, round({_SCORE}, 6) AS score FROM vecs v, mean_query q""",
)
def j4(spark, sf):
    from mailweave.functions.vectors import dot

    q = inputs.mean_query(spark, sf)
    size = sum(x * x for x in q) ** 0.5
    score = F.round(dot(F.col("unit_embedding"), [x / size for x in q]), 6)
    return inputs.vectors(spark, sf).select("source_id", "chunk_index", score.alias("score"))


_RETRIEVE = f"""WITH {inputs.SQL_VECTORS},
ranked AS (
  SELECT q.query_id, v.source_id, v.source_path, v.chunk_index, v.text, {_UNIT_SCORE} AS score
  FROM vecs v, label_queries q
),
hits AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id
         ORDER BY score DESC, source_id, chunk_index) AS INTEGER) AS rank FROM ranked
)
"""


@query(
    "k2_retrieve_batch",
    _RETRIEVE
    + """SELECT query_id, rank, round(score, 6) AS score, source_id, chunk_index, source_path,
         text FROM hits WHERE rank <= 4""",
)
def k2(spark, sf):
    hits = retrieval.retrieve(
        inputs.vectors(spark, sf),
        inputs.label_queries(spark, sf),
        columns=("source_path", "text"),
    )
    return hits.withColumn("score", F.round("score", 6))


@query(
    "k2_retrieve_blocked",
    _RETRIEVE
    + """SELECT query_id, rank, round(score, 6) AS score, source_id, chunk_index
         FROM hits WHERE rank <= 4""",
)
def k2_blocked(spark, sf):
    """Query sets too large to send to every task go block by block."""
    hits = retrieval.retrieve(
        inputs.vectors(spark, sf),
        inputs.label_queries(spark, sf),
        columns=(),
        query_bytes=4 * 8 * 64,
    )
    return hits.withColumn("score", F.round("score", 6))


@query(
    "j5_model_guard",
    """SELECT CAST(vec_id AS VARCHAR) AS source_id, label AS chunk_index FROM embeddings""",
)
def j5(spark, sf):
    chunks = index_store.open_index(spark, _write(spark, sf), "m/1")
    return chunks.select("source_id", "chunk_index")


def _checksum(vector):
    """Whole-number digest of a hashed vector: places weighted by their position."""
    weighted = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x).cast("bigint")


def _sql_hashed(source: str, keys: str) -> str:
    """Tokens of ``source(keys, text)`` with their place and sign."""
    return f"""(SELECT {keys}, CAST(h % 256 AS BIGINT) AS place,
             CASE WHEN (h >> 32) & 1 = 1 THEN -1 ELSE 1 END AS sign
      FROM (SELECT {keys}, md5_number_lower('0:' || w) AS h
            FROM (SELECT {keys}, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w
                  FROM {source}) WHERE w <> ''))"""


@query(
    "e1_embed_chunks",
    f"""WITH {SQL_CHUNKS}
    SELECT source_id, chunk_index, CAST(sum(sign * (place + 1)) AS BIGINT) AS checksum
    FROM {_sql_hashed('chunks', 'source_id, chunk_index')} GROUP BY ALL""",
)
def e1(spark, sf):
    chunks = chunk_documents(inputs.documents(spark, sf))
    embedded = embedding.embed_texts(chunks, embedding.HashEmbedder())
    return embedded.select(
        "source_id", "chunk_index", _checksum(F.col("embedding")).alias("checksum")
    )


@query(
    "e2_embed_queries",
    f"""SELECT item_id, CAST(sum(sign * (place + 1)) AS BIGINT) AS checksum
    FROM {_sql_hashed('benchmark', 'item_id')} GROUP BY ALL""",
)
def e2(spark, sf):
    items = inputs.table(spark, sf, "benchmark")
    embedded = embedding.embed_texts(items, embedding.HashEmbedder())
    return embedded.select("item_id", _checksum(F.col("embedding")).alias("checksum"))


def _index(spark, sf, embedder):
    """All documents as chunks with unit vectors, stored as an index is."""
    chunks = embedding.embed_texts(chunk_documents(inputs.documents(spark, sf)), embedder)
    stored = chunks.withColumn("unit_embedding", unit(F.col("embedding"))).drop("embedding")
    return materialize(stored, "index")


def search_items(spark, sf):
    """Documents to chunks to vectors; every benchmark item is looked up in them."""
    embedder = embedding.HashEmbedder()
    items = embedding.embed_texts(inputs.table(spark, sf, "benchmark"), embedder, output="vector")
    queries = items.select(F.col("item_id").cast("string").alias("query_id"), "vector")
    return retrieval.retrieve(_index(spark, sf, embedder), queries)


def _sql_units(name: str, source: str, keys: str) -> str:
    """Sparse unit vectors ``name(keys, place, x)`` of hashed texts."""
    return f"""
{name}_raw AS (SELECT {keys}, place, sum(sign) AS v
               FROM {_sql_hashed(source, keys)} GROUP BY ALL),
{name} AS (SELECT {keys}, place, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY {keys}))
                                      AS FLOAT) AS DOUBLE) AS x
           FROM {name}_raw WHERE v <> 0)"""


@query(
    "k2_search_documents",
    f"""WITH {SQL_CHUNKS}, {_sql_units('c', 'chunks', 'source_id, chunk_index')},
    {_sql_units('q', 'benchmark', 'item_id')},
    found AS (
      SELECT item_id, source_id, chunk_index, round(coalesce(sum(q.x * c.x), 0), 12) AS score
      FROM c JOIN q USING (place) GROUP BY item_id, source_id, chunk_index
    ),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY item_id
                ORDER BY score DESC, source_id, chunk_index) AS INTEGER) AS rank FROM found
    )
    SELECT CAST(item_id AS VARCHAR) AS query_id, rank, round(score, 6) AS score, source_id,
           chunk_index
    FROM ranked WHERE rank <= 4""",
)
def k2_documents(spark, sf):
    return search_items(spark, sf).select(
        "query_id", "rank", F.round("score", 6).alias("score"), "source_id", "chunk_index"
    )


@query(
    "a6_reference_blocks",
    _RETRIEVE
    + f"""SELECT query_id, '{fixed.REFERENCE_OPEN}' || chr(10) || chr(10)
         || string_agg('Source: ' || source_path || chr(10) || text, chr(10) || chr(10)
                       ORDER BY rank)
         || chr(10) || chr(10) || '{fixed.REFERENCE_CLOSE}' AS reference_block
         FROM hits WHERE rank <= 4 GROUP BY query_id""",
)
def a6(spark, sf):
    hits = retrieval.retrieve(inputs.vectors(spark, sf), inputs.label_queries(spark, sf))
    return prompts.reference_blocks(hits)


# --- texts around retrieval ---------------------------------------------------


@query(
    "q1_language_sample",
    f"""SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text ELSE left(text, 2000)
        || '{fixed.LANGUAGE_SAMPLE_BANNER}' || right(text, 2000) END AS sample FROM documents""",
)
def q1(spark, sf):
    d = inputs.table(spark, sf, "documents")
    return d.select("doc_id", tx.language_sample(F.col("text")).alias("sample"))


@query(
    "q2_retrieval_query",
    """SELECT doc_id, trim('Subject: ' || source || chr(10) || chr(10) || 'Latest customer turn:'
       || chr(10) || CASE WHEN lang = 'en' THEN trim(right(text, 4000), ' ' || chr(10))
                          ELSE right(text, 4000) END
       || chr(10) || chr(10) || 'Recent thread context:' || chr(10) || right(text, 4000),
       ' ' || chr(9) || chr(10) || chr(13)) AS query FROM documents""",
)
def q2(spark, sf):
    d = inputs.table(spark, sf, "documents")
    turn = F.when(F.col("lang") == "en", F.right("text", F.lit(4000))).otherwise(" \n")
    return d.select(
        "doc_id", tx.retrieval_query(F.col("text"), F.col("source"), turn).alias("query")
    )


@query("q3_classifier_input", "SELECT doc_id, left(text, 8000) AS body FROM documents")
def q3(spark, sf):
    d = inputs.table(spark, sf, "documents")
    return d.select("doc_id", tx.classifier_body(F.col("text")).alias("body"))


@query(
    "q4_preview",
    """SELECT doc_id,
       CASE WHEN length(t) > 240 THEN left(t, 237) || '...' ELSE t END AS preview,
       CASE WHEN length(t) > 200 THEN left(t, 197) || '...' ELSE t END AS example_preview
       FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)""",
)
def q4(spark, sf):
    d = inputs.table(spark, sf, "documents")
    return d.select(
        "doc_id",
        tx.preview(F.col("text")).alias("preview"),
        tx.preview(F.col("text"), 200).alias("example_preview"),
    )


@query(
    "q5_link_id",
    """WITH links AS (SELECT page_id, url, CASE page_id % 4
         WHEN 0 THEN ' https://drive.example/folders/F_' || page_id || '?usp=x'
         WHEN 1 THEN 'https://docs.example/document/d/D-' || page_id || '/edit'
         WHEN 2 THEN 'https://x.example/open?a=1&id=Q' || page_id
         ELSE '  raw' || page_id || ' ' END AS link FROM pages)
       SELECT page_id,
         coalesce(nullif(regexp_extract(link, '/folders/([a-zA-Z0-9_-]+)', 1), ''),
                  nullif(regexp_extract(link, '[?&]id=([a-zA-Z0-9_-]+)', 1), ''),
                  trim(link)) AS folder_id,
         coalesce(nullif(regexp_extract(link, '/document/d/([a-zA-Z0-9_-]+)', 1), ''),
                  nullif(regexp_extract(link, '[?&]id=([a-zA-Z0-9_-]+)', 1), ''),
                  trim(link)) AS document_id FROM links""",
)
def q5(spark, sf):
    page = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    link = (
        F.when(kind == 0, F.concat(F.lit(" https://drive.example/folders/F_"), page, F.lit("?usp=x")))
        .when(kind == 1, F.concat(F.lit("https://docs.example/document/d/D-"), page, F.lit("/edit")))
        .when(kind == 2, F.concat(F.lit("https://x.example/open?a=1&id=Q"), page))
        .otherwise(F.concat(F.lit("  raw"), page, F.lit(" ")))
    )
    return inputs.table(spark, sf, "pages").select(
        "page_id",
        tx.link_id(link).alias("folder_id"),
        tx.link_id(link, fixed.DOCUMENT_ID_PATTERNS).alias("document_id"),
    )


# --- answers ------------------------------------------------------------------

_RAW_ANSWERS = """
raw AS (SELECT doc_id, text, CASE doc_id % 7
  WHEN 0 THEN upper(lang) || '.' WHEN 1 THEN 'The language is: ' || lang
  WHEN 2 THEN lang || chr(10) || 'because it is' WHEN 3 THEN 'yes ' || lang || ' it'
  WHEN 4 THEN ' No, ' || lang WHEN 5 THEN '' ELSE text END AS answer FROM documents),
low AS (SELECT *, lower(trim(answer, ' ' || chr(9) || chr(10) || chr(13))) AS a FROM raw),
firsts AS (SELECT *, trim(regexp_split_to_array(a, '\\r\\n|\\n|\\r')[1],
                          ' ' || chr(9) || '.:;,!?"''') AS f FROM low)
"""


def _answers(spark, sf):
    d = inputs.table(spark, sf, "documents")
    kind = F.col("doc_id") % 7
    answer = (
        F.when(kind == 0, F.concat(F.upper("lang"), F.lit(".")))
        .when(kind == 1, F.concat(F.lit("The language is: "), "lang"))
        .when(kind == 2, F.concat("lang", F.lit("\nbecause it is")))
        .when(kind == 3, F.concat(F.lit("yes "), "lang", F.lit(" it")))
        .when(kind == 4, F.concat(F.lit(" No, "), "lang"))
        .when(kind == 5, F.lit(""))
        .otherwise(F.col("text"))
    )
    return d.select("doc_id", "lang", answer.alias("answer"))


# RE2 knows ASCII word borders only, so letters are listed.
_INSIDE = "(?:^|[^\\p{L}\\p{N}\\p{M}_])(it|es|en)(?:$|[^\\p{L}\\p{N}\\p{M}_])"


@query(
    "l1_language_code",
    f"""WITH {_RAW_ANSWERS}
    SELECT doc_id, CASE WHEN a IN ('it', 'es', 'en') THEN a WHEN f IN ('it', 'es', 'en') THEN f
      ELSE coalesce(nullif(regexp_extract(f, '{_INSIDE}', 1), ''), 'en') END AS language
    FROM firsts""",
)
def l1(spark, sf):
    return _answers(spark, sf).select(
        "doc_id", answers.language_code(F.col("answer")).alias("language")
    )


@query(
    "l2_topic_answer",
    f"""WITH {_RAW_ANSWERS},
    t AS (SELECT doc_id, list_filter(regexp_split_to_array(a, '\\s+'), lambda w: w <> '') AS w
          FROM low)
    SELECT doc_id, coalesce(starts_with(w[1], 'y'), false) AS related,
      CASE WHEN list_contains(w[2:], 'it') THEN 'it' WHEN list_contains(w[2:], 'es') THEN 'es'
           ELSE 'en' END AS language FROM t""",
)
def l2(spark, sf):
    parsed = _answers(spark, sf).select(
        "doc_id", answers.topic_answer(F.col("answer")).alias("p")
    )
    return parsed.select("doc_id", "p.related", "p.language")


@query(
    "l3_language_name",
    """SELECT doc_id, CASE lang WHEN 'it' THEN 'Italian' WHEN 'es' THEN 'Spanish'
       ELSE 'English' END AS language_name FROM documents""",
)
def l3(spark, sf):
    d = inputs.table(spark, sf, "documents")
    return d.select("doc_id", answers.language_name(F.col("lang")).alias("language_name"))


@query(
    "l4_empty_answer",
    f"""WITH {_RAW_ANSWERS}
    SELECT doc_id, CASE WHEN a = '' THEN 'empty reply' END AS error FROM low""",
)
def l4(spark, sf):
    return _answers(spark, sf).select(
        "doc_id", answers.reply_error(F.col("answer")).alias("error")
    )


def _hits_sql(code: str) -> str:
    listed = ", ".join(f"'{w}'" for w in classify.STOP_WORDS[code])
    return f"len(list_filter(w, lambda x: x IN ({listed})))"


SQL_LANGUAGE = f"""CASE WHEN {_hits_sql('en')} >= {_hits_sql('es')}
  AND {_hits_sql('en')} >= {_hits_sql('it')} THEN 'en'
  WHEN {_hits_sql('es')} >= {_hits_sql('it')} THEN 'es' ELSE 'it' END"""


@query(
    "e4_detect_language",
    f"""WITH s AS (SELECT doc_id, regexp_split_to_array(lower(
          CASE WHEN length(text) <= 4000 THEN text ELSE left(text, 2000)
          || '{fixed.LANGUAGE_SAMPLE_BANNER}' || right(text, 2000) END), '\\s+') AS w
        FROM documents)
    SELECT doc_id, {SQL_LANGUAGE} AS language FROM s""",
)
def e4(spark, sf):
    d = inputs.table(spark, sf, "documents")
    return classify.detect_language(d, "text").select("doc_id", "language")


@query(
    "e5_topic",
    f"""WITH s AS (SELECT doc_id, regexp_split_to_array(lower(
          source || chr(10) || chr(10) || left(text, 8000)), '\\s+') AS w FROM documents)
    SELECT doc_id, list_has_any(w, {list(classify.TOPIC_WORDS)!r}) AS related,
      {SQL_LANGUAGE} AS language FROM s""",
)
def e5(spark, sf):
    d = inputs.table(spark, sf, "documents")
    return classify.classify_topic(d, "source", "text").select("doc_id", "related", "language")


# --- example pool and prompts ---------------------------------------------------


@query(
    "e6_exemplar_pool",
    f"""WITH {inputs.SQL_FILES},
    pool AS (SELECT name AS title, file_id AS source_id, text FROM extracted
             WHERE extract_error IS NULL AND text <> ''),
    {sql_sanitize('pool', 'title, source_id')}
    SELECT title, source_id, text FROM pool_clean""",
)
def e6(spark, sf):
    return exemplars.exemplar_pool(inputs.files(spark, sf))


@query(
    "k4_title_order",
    f"""WITH {inputs.SQL_FILES},
    pool AS (SELECT name AS title, file_id AS source_id FROM extracted
             WHERE extract_error IS NULL AND text <> '')
    SELECT row_number() OVER (ORDER BY lower(title), source_id) AS example_no, title, source_id
    FROM pool""",
)
def k4(spark, sf):
    pool = exemplars.exemplar_pool(inputs.files(spark, sf))
    return prompts.numbered_examples(pool).select("example_no", "title", "source_id")


def _pool(spark, sf):
    """The benchmark table as a pool of examples, sanitized like any pool."""
    items = inputs.table(spark, sf, "benchmark")
    return items.select(
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title"),
        sanitize(F.col("text")).alias("text"),
        F.col("item_id").cast("string").alias("source_id"),
    )


_SQL_EXAMPLES = f"""
pool AS (
  SELECT 'item ' || item_id AS title, CAST(item_id AS VARCHAR) AS source_id, text FROM benchmark
),
{sql_sanitize('pool', 'title, source_id')},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY lower(title), source_id) AS n FROM pool_clean
),
parts AS (
  SELECT n AS part_no, 'Example ' || n || ' — ' || title || chr(10) || text AS part FROM numbered
  UNION ALL SELECT 0, '{fixed.EXAMPLES_HEADER}' || chr(10) || chr(10) || '{fixed.EXAMPLES_OPEN}'
  FROM numbered HAVING count(*) > 0
  UNION ALL SELECT count(*) + 1, '{fixed.EXAMPLES_CLOSE}' FROM numbered HAVING count(*) > 0
)"""


@query("a7_example_block", f"WITH {_SQL_EXAMPLES} SELECT * FROM parts")
def a7(spark, sf):
    return prompts.example_parts(_pool(spark, sf))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_LANG_NAME = "(CASE WHEN lang = 'es' THEN 'Spanish' WHEN lang = 'it' THEN 'Italian' ELSE 'English' END)"

_SQL_TRANSCRIPT = f"""
sized AS (
  SELECT *, count(*) OVER w AS n, ordinal = count(*) OVER w AS is_last,
         sum(length(segment) + 2) OVER (PARTITION BY thread_id ORDER BY ordinal DESC
             ROWS UNBOUNDED PRECEDING) - 2 AS suffix,
         sum(length(segment) + 2) OVER w - 2 AS total
  FROM segments WINDOW w AS (PARTITION BY thread_id)
),
kept AS (
  SELECT *, n - ordinal + 1 AS k FROM sized
  WHERE total <= BUDGET OR ordinal = n
     OR length('{fixed.OMISSION_BANNER_HEAD}' || (n - ordinal + 1)
               || '{fixed.OMISSION_BANNER_TAIL}') + 2 + suffix <= BUDGET
),
joined AS (
  SELECT thread_id, max(n) AS message_count, count(*) AS kept_messages, max(total) AS total,
         string_agg(segment, chr(10) || chr(10) ORDER BY ordinal) AS body
  FROM kept GROUP BY thread_id
),
transcripts AS (
  SELECT thread_id, message_count, kept_messages,
    CASE WHEN total <= BUDGET THEN body ELSE
      '{fixed.OMISSION_BANNER_HEAD}' || kept_messages || '{fixed.OMISSION_BANNER_TAIL}'
      || chr(10) || chr(10)
      || right(body, BUDGET - length('{fixed.OMISSION_BANNER_HEAD}' || kept_messages
               || '{fixed.OMISSION_BANNER_TAIL}') - 2) END AS transcript
  FROM joined
)"""


def sql_transcripts(budget: int) -> str:
    return _SQL_TRANSCRIPT.replace("BUDGET", str(budget))


def _thread_rows(spark, sf):
    """Latest state of every thread: subject, turn, transcript and a stand-in language."""
    mailbox = inputs.mailbox(spark, sf)
    anchors = threads.latest_anchors(mailbox).where("error is null").select(
        "thread_id", F.col("anchor_id").alias("message_id")
    )
    parsed = message_parts(mailbox).select("thread_id", "message_id", "subject", "body")
    turn = F.when(F.col("body") == "", F.col("subject")).otherwise(F.col("body"))
    number = F.col("thread_id").cast("bigint") % 3
    language = F.when(number == 0, F.lit("it")).when(number == 1, F.lit("es")).otherwise("xx")
    rows = (
        threads.latest_transcripts(mailbox, 4000)
        .join(anchors.join(parsed, ["thread_id", "message_id"]), "thread_id")
        .select("thread_id", language.alias("language"), "subject", turn.alias("turn"), "transcript")
    )
    # Read by the search and by the prompt.
    return materialize(rows, "thread-rows")


def thread_hits(spark, sf, rows):
    """Hits of every thread's own search text among the chunks of all documents."""
    embedder = embedding.HashEmbedder()
    asked = rows.select(
        F.col("thread_id").alias("query_id"),
        tx.retrieval_query(F.col("transcript"), F.col("subject"), F.col("turn")).alias("text"),
    )
    vectors = embedding.embed_texts(asked, embedder, output="vector")
    return retrieval.retrieve(
        _index(spark, sf, embedder), vectors.select("query_id", "vector"), fixed.DEFAULT_TOP_K
    )


_STRIP = "' ' || chr(9) || chr(10) || chr(13)"
_SQL_THREAD_BLOCKS = f"""
last AS (SELECT thread_id, subject, CASE body WHEN '' THEN subject ELSE body END AS turn,
                CASE CAST(thread_id AS BIGINT) % 3 WHEN 0 THEN 'it' WHEN 1 THEN 'es'
                     ELSE 'xx' END AS lang
         FROM sized WHERE is_last),
asked AS (
  SELECT thread_id, trim('Subject: ' || subject || chr(10) || chr(10) || 'Latest customer turn:'
    || chr(10) || CASE WHEN trim(turn, {_STRIP}) = '' THEN right(transcript, 4000)
                       ELSE trim(turn, {_STRIP}) END
    || chr(10) || chr(10) || 'Recent thread context:' || chr(10) || right(transcript, 4000),
    {_STRIP}) AS text
  FROM transcripts JOIN last USING (thread_id)
),
{_sql_units('c', 'chunks', 'source_id, chunk_index')},
{_sql_units('q', 'asked', 'thread_id')},
found AS (
  SELECT thread_id, source_id, chunk_index, round(sum(q.x * c.x), 12) AS score
  FROM c JOIN q USING (place) GROUP BY ALL
),
hits AS (
  SELECT * FROM found
  QUALIFY row_number() OVER (PARTITION BY thread_id
                             ORDER BY score DESC, source_id, chunk_index) <= 4
),
blocks AS (
  SELECT thread_id, '{fixed.REFERENCE_OPEN}' || chr(10) || chr(10)
      || string_agg('Source: ' || source_path || chr(10) || chunks.text, chr(10) || chr(10)
                    ORDER BY score DESC, source_id, chunk_index)
      || chr(10) || chr(10) || '{fixed.REFERENCE_CLOSE}' AS block
  FROM hits JOIN chunks USING (source_id, chunk_index) JOIN sources USING (source_id)
  GROUP BY thread_id
)"""
_SYSTEM = "You write for the guest desk."
_POOL = "benchmark"
_SQL_PROMPTS = f"""WITH {inputs.SQL_MAILBOX}, {sql_transcripts(4000)}, {SQL_CHUNKS},
    {_SQL_THREAD_BLOCKS}, {_SQL_EXAMPLES},
    prompts AS (
    SELECT t.thread_id, replace({_sql_text(fixed.PROMPT_LANGUAGE)}, '{{lang}}', {_LANG_NAME})
      || {_sql_text(fixed.PROMPT_TASK)}
      || CASE WHEN trim(turn, {_STRIP}) = '' THEN transcript ELSE trim(turn, {_STRIP}) END
      || chr(10) || chr(10)
      || CASE WHEN block IS NOT NULL THEN {_sql_text(fixed.PROMPT_REFERENCE_USE)} || block
           || chr(10) || chr(10) ELSE '' END AS opening,
      CASE WHEN block IS NOT NULL THEN '{_POOL}' END AS examples,
      {_sql_text(fixed.PROMPT_THREAD)} || transcript || chr(10) || chr(10)
      || replace({_sql_text(fixed.PROMPT_REPLY)}, '{{lang}}', {_LANG_NAME}) AS closing
    FROM transcripts t JOIN last USING (thread_id) LEFT JOIN blocks USING (thread_id))"""


def _prompts(spark, sf, system=None):
    rows = _thread_rows(spark, sf)
    blocks = prompts.reference_blocks(thread_hits(spark, sf, rows))
    return prompts.prompt_table(rows, blocks, _POOL, system)


# The prompts written out, with the whole example block in each that shows examples.
_SQL_WHOLE = f"""{_SQL_PROMPTS},
    block AS (SELECT string_agg(part, chr(10) || chr(10) ORDER BY part_no) || chr(10) || chr(10)
              AS text FROM parts),
    whole AS (SELECT thread_id, opening
               || CASE WHEN examples IS NULL THEN '' ELSE (SELECT text FROM block) END
               || closing AS prompt FROM prompts)"""


def _whole_prompts(spark, sf, system=None):
    parts = materialize(prompts.example_parts(_pool(spark, sf)), "example-parts")
    return prompts.whole_prompts(_prompts(spark, sf, system), parts)


@query("a9_prompt_table", f"{_SQL_WHOLE} SELECT * FROM whole")
def a9(spark, sf):
    return _whole_prompts(spark, sf)


@query(
    "prompts_from_threads",
    f"{_SQL_WHOLE} SELECT *, {_sql_text(_SYSTEM)} AS system FROM whole",
)
def prompts_from_threads(spark, sf):
    """From mail threads to model input: transcript, search text, vector, hits, prompt."""
    return _whole_prompts(spark, sf, _SYSTEM)


@query(
    "a9_sent_prompts",
    f"""{_SQL_PROMPTS},
    block AS (SELECT string_agg(part, chr(10) || chr(10) ORDER BY part_no) || chr(10) || chr(10)
              AS text FROM parts),
    sent AS (SELECT thread_id, opening
               || CASE WHEN examples IS NULL THEN '' ELSE (SELECT text FROM block) END
               || closing AS prompt FROM prompts)
    SELECT thread_id, length(prompt) || ' ' || sha256(prompt) AS reply,
           CAST(NULL AS VARCHAR) AS error FROM sent""",
)
def a9_sent(spark, sf):
    """What a model receives: every prompt with its examples, as length and digest."""

    def digest(prompt: str) -> str:
        return f"{len(prompt)} {hashlib.sha256(prompt.encode()).hexdigest()}"

    parts = materialize(prompts.example_parts(_pool(spark, sf)), "example-parts")
    return prompts.send_prompts(_prompts(spark, sf), digest, parts)


@query(
    "j6_examples_need_reference",
    """WITH ids AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS thread_id FROM conversations
                WHERE role <> 'system')
    SELECT thread_id, true AS indexed, true AS shows_examples FROM ids
    UNION ALL SELECT thread_id, false, false FROM ids""",
)
def j6(spark, sf):
    """Prompts over the index of all documents and over an empty one, as a model receives them."""
    rows = _thread_rows(spark, sf)
    hits = thread_hits(spark, sf, rows)
    parts = materialize(prompts.example_parts(_pool(spark, sf)), "example-parts")
    opening = fixed.EXAMPLES_OPEN

    def table(found, indexed):
        made = prompts.prompt_table(rows, prompts.reference_blocks(found), _POOL)
        sent = prompts.send_prompts(made, lambda prompt: str(opening in prompt), parts)
        shown = F.col("reply").cast("boolean").alias("shows_examples")
        return sent.select("thread_id", F.lit(indexed).alias("indexed"), shown)

    return table(hits, True).unionByName(table(hits.limit(0), False))


@query(
    "u3_batch_classifier",
    """SELECT doc_id, CASE WHEN length(text) > 4000 THEN NULL
         WHEN contains(text, ' de ') THEN 'es' ELSE 'en' END AS language,
       CASE WHEN length(text) > 4000 THEN 'ValueError: text too long' END AS error
       FROM documents""",
)
def u3(spark, sf):
    """A Python model behind the classifier plug-in; long texts make it fail."""

    def model(body: str) -> str:
        if len(body) > 4000:
            raise ValueError("text too long")
        return "es" if " de " in body else "en"

    d = inputs.table(spark, sf, "documents")
    return classify.detect_language(d, "text", classify.batch_classifier(model)).select(
        "doc_id", "language", "error"
    )

