"""Queries for listing, extraction, chunking and the index."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.functions import text as tx
from mailweave.operators import chunking, exemplars, health
from mailweave.plans import inputs
from mailweave.plans.registry import query
from mailweave.session import scratch_path
from mailweave.sources import extract, index_store, listing
from mailweave.sources.files import write_files
from mailweave.sources.html import HTML_MIME, html_text

_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _roots(spark, ids=("root",)):
    return spark.createDataFrame([(i,) for i in ids], "folder_id string")


_LISTING = f"""
WITH RECURSIVE {inputs.SQL_NODES},
tree AS (
  SELECT 'root' AS folder_id, 'root' AS path
  UNION ALL
  SELECT n.id, t.path || ' / ' || n.name
  FROM tree t JOIN nodes n ON n.parent_id = t.folder_id
  WHERE n.mime_type = '{fixed.FOLDER_MIME}'
),
listed AS (
  SELECT n.id AS file_id, n.name, n.mime_type, t.path || ' / ' || n.name AS path,
         '2026-01-01' AS modified_time
  FROM nodes n JOIN tree t ON n.parent_id = t.folder_id
  WHERE n.mime_type <> '{fixed.FOLDER_MIME}'
)
"""


@query("s1_corpus_listing", _LISTING + "SELECT * FROM listed")
def s1(spark, sf):
    return listing.list_files(inputs.nodes(spark, sf), _roots(spark))


@query(
    "s1_one_level_listing",
    f"""WITH {inputs.SQL_NODES}
    SELECT c.id AS file_id, c.name, c.mime_type, p.name || ' / ' || c.name AS path,
           '2026-01-01' AS modified_time
    FROM nodes c JOIN nodes p ON c.parent_id = p.id
    WHERE p.id LIKE 'n%' AND c.mime_type <> '{fixed.FOLDER_MIME}'""",
)
def s1_flat(spark, sf):
    nodes = inputs.nodes(spark, sf)
    roots = nodes.where(F.col("id").startswith("n")).select(F.col("id").alias("folder_id"))
    return listing.list_files(nodes, roots, recursive=False)


@query(
    "s2_root_name",
    f"""WITH {inputs.SQL_NODES}
    SELECT p.parent_id AS folder_id, coalesce(n.name, p.parent_id) AS path
    FROM (SELECT DISTINCT parent_id FROM nodes) p LEFT JOIN nodes n ON n.id = p.parent_id""",
)
def s2(spark, sf):
    nodes = inputs.nodes(spark, sf)
    roots = nodes.select(F.col("parent_id").alias("folder_id")).distinct()
    return listing.root_paths(roots, nodes)


@query(
    "s3_mime_filter",
    _LISTING + "SELECT * FROM listed WHERE mime_type IN ('text/plain', 'application/pdf')",
)
def s3(spark, sf):
    return listing.list_files(
        inputs.nodes(spark, sf), _roots(spark), include_mime_types=fixed.INCLUDE_MIME_TYPES
    )


@query(
    "s4_read_content",
    f"""WITH {inputs.SQL_FILES}
    SELECT 'corpus / ' || replace(path, '/', ' / ') AS path, name, 'text/plain' AS mime_type,
           body AS content_text, strlen(body) AS n_bytes FROM files""",
)
def s4(spark, sf):
    """The documents as files on storage, read back as bytes."""
    folder = f"{scratch_path(spark, 's4')}/corpus"
    write_files(inputs.files(spark, sf), folder, "path")
    return listing.read_folder(spark, folder).select(
        "path", "name", "mime_type", F.decode("content", "UTF-8").alias("content_text"),
        F.octet_length("content").cast("bigint").alias("n_bytes"),
    )


# Every fiftieth page is a broken file.
_PAGE_TEXT = """
WITH bare AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
      '(?i)</?(a|b|i|em|strong|span)( [^>]*)?>', '', 'g') AS t
  FROM pages WHERE html IS NOT NULL),
lines AS (
  SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', chr(10), 'g'),
      '&copy;', '©'), '&quot;', chr(34)), '&#x27;', chr(39)), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t
  FROM bare)
SELECT 'page-' || page_id || '.html' AS name,
  CASE WHEN page_id % 50 <> 7 THEN array_to_string(list_filter(list_transform(
    string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\\s]+', ' ', 'g'))), lambda x: x <> ''), chr(10))
  END AS text,
  CASE WHEN page_id % 50 = 7 THEN 'ValueError: not a text file' END AS extract_error
FROM lines"""


@query("u2_extract_html", _PAGE_TEXT)
def u2(spark, sf):
    """The pages as HTML files on storage, read back and extracted by a plug-in."""
    pages = inputs.table(spark, sf, "pages").where("html is not null")
    html = F.when(F.col("page_id") % 50 == 7, F.concat(F.lit("\0"), "html")).otherwise(F.col("html"))
    folder = f"{scratch_path(spark, 'u2')}/pages"
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html"))
    write_files(pages.select(name.alias("name"), html.alias("content")), folder)
    files = listing.read_folder(spark, folder)
    return extract.extract_text(files, {HTML_MIME: html_text}).select("name", "text", "extract_error")


@query(
    "s5_extract_text",
    f"""WITH {inputs.SQL_FILES}
    SELECT file_id, mime_type, text, extract_error FROM extracted""",
)
def s5(spark, sf):
    extracted = extract.extract_text(inputs.files(spark, sf))
    return extracted.select("file_id", "mime_type", "text", "extract_error")


@query(
    "s6_skip_and_continue",
    f"""WITH {inputs.SQL_FILES}
    SELECT file_id, coalesce(extract_error, 'empty text') AS reason
    FROM extracted WHERE extract_error IS NOT NULL OR text = ''""",
)
def s6(spark, sf):
    return extract.skipped(extract.extract_text(inputs.files(spark, sf))).select(
        "file_id", "reason"
    )


@query(
    "s6_ingest_counts",
    f"""WITH {inputs.SQL_FILES}
    SELECT count(*) AS listed_files,
           count(*) FILTER (WHERE extract_error IS NULL AND text <> '') AS source_file_count,
           count(*) FILTER (WHERE extract_error IS NOT NULL OR text = '') AS skipped_files
    FROM extracted""",
)
def s6_counts(spark, sf):
    return extract.ingest_counts(extract.extract_text(inputs.files(spark, sf)))


@query(
    "s7_union_of_folders",
    _LISTING
    + """SELECT file_id, path FROM listed UNION ALL
    SELECT n.id, p.name || ' / ' || n.name FROM nodes n JOIN nodes p ON n.parent_id = p.id
    WHERE p.id LIKE 'n%'""",
)
def s7(spark, sf):
    return listing.union_listings(s1(spark, sf), s1_flat(spark, sf)).select("file_id", "path")


def _write(spark, sf):
    base = scratch_path(spark, "index")
    chunks = inputs.vectors(spark, sf).drop("unit_embedding")
    count = chunks.select("source_id").distinct().count()
    index_store.write_index(chunks, base, embedding_model="m/1", source_file_count=count)
    return base


@query(
    "s8_index_write",
    """SELECT CAST(vec_id AS VARCHAR) AS source_id, label AS chunk_index,
       'text of ' || vec_id AS text, CAST(len(embedding) AS INTEGER) AS dimension
       FROM embeddings""",
)
def s8(spark, sf):
    _, chunks = index_store.load_index(spark, _write(spark, sf))
    return chunks.select(
        "source_id", "chunk_index", "text", F.size("embedding").alias("dimension")
    )


@query(
    "s9_publish_gate",
    """SELECT count(*) AS chunk_count, count(embedding) AS vector_count,
       CAST(min(len(embedding)) AS INTEGER) AS min_dimension,
       CAST(max(len(embedding)) AS INTEGER) AS max_dimension,
       CAST(1 AS BIGINT) AS source_file_count,
       count(*) > 0 AND count(*) = count(embedding)
         AND min(len(embedding)) = max(len(embedding)) AS publishable
       FROM embeddings""",
)
def s9(spark, sf):
    return index_store.gate(inputs.vectors(spark, sf), 1)


@query(
    "s10_current_version",
    """SELECT 'm/1' AS embedding_model, CAST(max(len(embedding)) AS INTEGER) AS dimension,
       count(DISTINCT vec_id) AS source_file_count, count(*) AS chunk_count
       FROM embeddings""",
)
def s10(spark, sf):
    row = index_store.current_version(spark, _write(spark, sf))
    return spark.createDataFrame([row], index_store.META_SCHEMA).drop("version", "ingested_at")


_UNITS = f"""WITH {inputs.SQL_VECTORS}
SELECT source_id, chunk_index,
       round(sqrt(list_sum(list_transform(unit, lambda x: x * x))), 5) AS unit_norm,
       round(unit[1], 5) AS first_value
FROM vecs"""


def _unit_facts(chunks):
    from mailweave.functions.vectors import norm

    return chunks.select(
        "source_id",
        "chunk_index",
        F.round(norm(F.col("unit_embedding")), 5).alias("unit_norm"),
        F.round(F.get("unit_embedding", F.lit(0)).cast("double"), 5).alias("first_value"),
    )


@query("s11_load_index", _UNITS)
def s11(spark, sf):
    return _unit_facts(index_store.load_index(spark, _write(spark, sf))[1])


@query("e3_unit_vectors", _UNITS)
def e3(spark, sf):
    return _unit_facts(inputs.vectors(spark, sf))


@query(
    "s13_name_lines",
    f"""SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, phrase FROM (
      SELECT doc_id, unnest(list_transform(string_split(text, chr(10)),
                            lambda x: trim(x, {_WS}))) AS phrase,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos
      FROM documents)
    WHERE phrase <> '' AND phrase NOT LIKE '#%'""",
)
def s13(spark, sf):
    d = inputs.table(spark, sf, "documents").select("doc_id", "text")
    return listing.name_lines(d)


# --- chunking ---------------------------------------------------------------


@query(
    "c1_token_count",
    "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents",
)
def c1(spark, sf):
    d = inputs.table(spark, sf, "documents")
    return d.select("doc_id", tx.approximate_tokens(F.col("text")).alias("tokens"))


_PIECES = f"""
paragraphs AS (
  SELECT source_id, pos, trim(par, {_WS}) AS par FROM (
    SELECT source_id, unnest(regexp_split_to_array(body, '\\n\\s*\\n+')) AS par,
           generate_subscripts(regexp_split_to_array(body, '\\n\\s*\\n+'), 1) AS pos
    FROM bodies)
  WHERE trim(par, {_WS}) <> ''
),
tokens AS (
  SELECT *, list_filter(regexp_split_to_array(par, '\\s+'), lambda w: w <> '') AS words
  FROM paragraphs
),
runs AS (
  SELECT source_id, pos, CASE WHEN length(par) <= 3200 THEN [par] ELSE list_append(r.done, r.cur)
         END AS pieces
  FROM (SELECT *, list_reduce(
          list_transform(words, lambda w: {{'done': CAST([] AS VARCHAR[]), 'cur': w}}),
          lambda a, b: CASE WHEN length(a.cur) + 1 + length(b.cur) > 3200
            THEN {{'done': list_append(a.done, a.cur), 'cur': b.cur}}
            ELSE {{'done': a.done, 'cur': a.cur || ' ' || b.cur}} END) AS r
        FROM tokens)
)"""


@query(
    "c2_paragraphs",
    f"""WITH {inputs.SQL_DOCUMENTS},
    bodies AS (SELECT source_id, replace(text, chr(10), chr(10) || chr(10)) AS body FROM sources)
    SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY pos) - 1 AS INTEGER)
           AS pos, par AS paragraph
    FROM (SELECT source_id, pos, trim(par, {_WS}) AS par FROM (
            SELECT source_id, unnest(regexp_split_to_array(body, '\\n\\s*\\n+')) AS par,
                   generate_subscripts(regexp_split_to_array(body, '\\n\\s*\\n+'), 1) AS pos
            FROM bodies))
    WHERE par <> ''""",
)
def c2(spark, sf):
    docs = inputs.paragraphed(inputs.documents(spark, sf))
    return docs.select(
        "source_id", F.posexplode(tx.paragraphs(F.col("text"))).alias("pos", "paragraph")
    )


@query(
    "c3_split_oversized",
    f"""WITH {inputs.SQL_DOCUMENTS},
    bodies AS (SELECT source_id, text AS body FROM sources), {_PIECES},
    flat AS (SELECT source_id, unnest(pieces) AS piece,
                    generate_subscripts(pieces, 1) - 1 AS pos FROM runs)
    SELECT source_id, CAST(pos AS INTEGER) AS pos, piece FROM flat""",
)
def c3(spark, sf):
    docs = inputs.documents(spark, sf)
    limit, _ = chunking.chunk_sizes(fixed.CHUNK_TOKENS, 0)
    whole = F.posexplode(chunking.split_oversized(tx.strip(F.col("text")), limit))
    return docs.where(~tx.is_blank(F.col("text"))).select("source_id", whole.alias("pos", "piece"))


_CHUNKS = f"""{_PIECES},
lists AS (SELECT source_id, flatten(list(pieces ORDER BY pos)) AS pieces FROM runs
          GROUP BY source_id),
folded AS (
  SELECT source_id, list_reduce(
      list_transform(pieces, lambda p: {{'done': CAST([] AS VARCHAR[]), 'cur': p}}),
      lambda a, b: CASE WHEN length(a.cur) + 2 + length(b.cur) <= 3200
        THEN {{'done': a.done, 'cur': a.cur || chr(10) || chr(10) || b.cur}}
        ELSE {{'done': list_append(a.done, trim(a.cur, {_WS})),
              'cur': right(a.cur, 400) || chr(10) || chr(10) || b.cur}} END) AS r
  FROM lists
),
chunk_lists AS (
  SELECT source_id, list_append(r.done, trim(r.cur, {_WS})) AS texts FROM folded
),
chunks AS (
  SELECT source_id, CAST(generate_subscripts(texts, 1) - 1 AS INTEGER) AS chunk_index,
         unnest(texts) AS text
  FROM chunk_lists
)"""
SQL_CHUNKS = f"""{inputs.SQL_DOCUMENTS},
bodies AS (SELECT source_id, text AS body FROM sources), {_CHUNKS}"""


@query(
    "c4_chunk_packing",
    f"""WITH {inputs.SQL_DOCUMENTS},
    bodies AS (SELECT source_id, replace(text, chr(10), chr(10) || chr(10)) AS body FROM sources),
    {_CHUNKS}
    SELECT c.source_id, s.source_name, s.source_path, c.chunk_index, c.text
    FROM chunks c JOIN sources s USING (source_id)""",
)
def c4(spark, sf):
    return chunking.chunk_documents(inputs.paragraphed(inputs.documents(spark, sf)))


@query(
    "c4_chunk_documents",
    f"""WITH {SQL_CHUNKS}
    SELECT source_id, chunk_index, text FROM chunks""",
)
def c4_plain(spark, sf):
    chunks = chunking.chunk_documents(inputs.documents(spark, sf))
    return chunks.select("source_id", "chunk_index", "text")


# --- statistics -------------------------------------------------------------


def _by_source(spark, sf):
    """Chunks grouped under their document's source."""
    docs = inputs.documents(spark, sf)
    source = F.substring_index("source_path", " / ", 1)
    return chunking.chunk_documents(docs.withColumn("source_path", source))


_SQL_BY_SOURCE = f"""WITH {SQL_CHUNKS},
by_source AS (
  SELECT c.source_id, string_split(s.source_path, ' / ')[1] AS source_path, c.text
  FROM chunks c JOIN sources s USING (source_id)
),
stats AS (SELECT source_path, count(*) AS chunk_count FROM by_source GROUP BY source_path)
"""


@query("a1_chunks_per_source", _SQL_BY_SOURCE + "SELECT * FROM stats")
def a1(spark, sf):
    return health.source_stats(_by_source(spark, sf))


@query(
    "k3_top_sources",
    _SQL_BY_SOURCE
    + """SELECT source_path, chunk_count,
         greatest(0, (SELECT count(*) FROM stats) - 5) AS more_sources
         FROM stats ORDER BY chunk_count DESC, source_path LIMIT 5""",
)
def k3(spark, sf):
    return health.top_sources(_by_source(spark, sf), 5)


@query(
    "a2_index_stats",
    """SELECT count(*) AS chunk_count, count(DISTINCT vec_id) AS source_file_count,
       CAST(max(len(embedding)) AS INTEGER) AS dimension FROM embeddings""",
)
def a2(spark, sf):
    return health.index_stats(inputs.vectors(spark, sf))


@query(
    "a3_health_report",
    f"""WITH {inputs.SQL_FILES},
    pool AS (SELECT name, file_id FROM extracted WHERE extract_error IS NULL AND text <> '')
    SELECT true AS available, true AS loaded, count(*) AS chunk_count,
       count(DISTINCT vec_id) AS source_file_count,
       CAST(max(len(embedding)) AS INTEGER) AS dimension, false AS model_matches,
       false AS healthy, (SELECT count(*) FROM pool) AS exemplar_count,
       'index was built with ''m/1'', not ''m/2''' AS issues FROM embeddings""",
)
def a3(spark, sf):
    pool = exemplars.exemplar_pool(inputs.files(spark, sf))
    report = health.health_report(
        spark, inputs.vectors(spark, sf), "m/1", "m/2", exemplars=pool
    )
    return report.withColumn("issues", F.array_join("issues", "; "))


@query(
    "a3_pool_titles",
    f"""WITH {inputs.SQL_FILES}
    SELECT row_number() OVER (ORDER BY lower(name), file_id) AS place, name AS title,
           file_id AS source_id FROM extracted WHERE extract_error IS NULL AND text <> ''""",
)
def a3_titles(spark, sf):
    return health.pool_titles(exemplars.exemplar_pool(inputs.files(spark, sf)))


@query(
    "a4_ingest_age",
    """SELECT o_orderkey, CASE WHEN h < 1 THEN '<1h ago'
         WHEN h >= 24 THEN (h // 24) || 'd ' || (h % 24) || 'h ago'
         ELSE h || 'h ago' END AS age
       FROM (SELECT o_orderkey, epoch(TIMESTAMP '2026-01-01 05:30:00' - o_orderdate)::BIGINT
             // 3600 AS h FROM orders)""",
)
def a4(spark, sf):
    orders = inputs.table(spark, sf, "orders")
    now = datetime(2026, 1, 1, 5, 30)
    at = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return orders.select("o_orderkey", health.ingest_age(at, now).alias("age"))


@query(
    "a5_ingest_summary",
    f"""WITH {inputs.SQL_FILES},
    bodies AS (SELECT file_id AS source_id, text AS body FROM extracted
               WHERE extract_error IS NULL AND text <> ''), {_CHUNKS}
    SELECT (SELECT count(*) FROM bodies) AS source_file_count, count(*) AS chunk_count
    FROM chunks""",
)
def a5(spark, sf):
    extracted = extract.extract_text(inputs.files(spark, sf))
    # Every usable file has one first chunk.
    return extract.chunk_files(extracted).agg(
        F.count_if(F.col("chunk_index") == 0).alias("source_file_count"),
        F.count(F.lit(1)).alias("chunk_count"),
    )
