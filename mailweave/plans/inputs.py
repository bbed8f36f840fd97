"""Views of the test tables in the library's own shapes, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions import fixed

STAFF_DOMAINS = ("@Agency.example",)
BASE_MS = 1_767_225_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, read as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as chunkable sources."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("source_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_name"),
        F.concat("source", F.lit(" / "), F.col("doc_id").cast("string")).alias("source_path"),
        "text",
    )


SQL_DOCUMENTS = """
sources AS (
  SELECT CAST(doc_id AS VARCHAR) AS source_id, 'doc-' || doc_id AS source_name,
         source || ' / ' || doc_id AS source_path, text
  FROM documents
)"""


def paragraphed(docs: DataFrame) -> DataFrame:
    """The same documents with every line as a paragraph of its own."""
    return docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files with bytes; the language stands for the MIME type."""
    d = table(spark, sf_dir, "documents")
    mime = (
        F.when(F.col("lang") == "en", F.lit("text/plain"))
        .when(F.col("lang") == "es", F.lit("text/markdown"))
        .when(F.col("lang") == "fr", F.lit(fixed.DOCUMENT_MIME))
        .otherwise(F.lit("image/png"))
    )
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    body = F.when(F.col("n_chars") < 100, F.lit(" \n")).otherwise(
        F.concat(F.lit(" \n"), "text", F.lit("\t\n"))
    )
    return d.select(
        F.col("doc_id").cast("string").alias("file_id"),
        name.alias("name"),
        mime.alias("mime_type"),
        F.concat("source", F.lit("/"), name).alias("path"),
        F.lit("").alias("modified_time"),
        F.encode(body, "UTF-8").alias("content"),
    )


SQL_FILES = f"""
files AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_id, 'doc-' || doc_id || '.txt' AS name,
         CASE lang WHEN 'en' THEN 'text/plain' WHEN 'es' THEN 'text/markdown'
                   WHEN 'fr' THEN '{fixed.DOCUMENT_MIME}' ELSE 'image/png' END AS mime_type,
         source || '/doc-' || doc_id || '.txt' AS path,
         CASE WHEN n_chars < 100 THEN ' ' || chr(10)
              ELSE ' ' || chr(10) || text || chr(9) || chr(10) END AS body
  FROM documents
),
extracted AS (
  SELECT file_id, name, mime_type, path,
         CASE WHEN mime_type <> 'image/png'
              THEN trim(body, ' ' || chr(9) || chr(10) || chr(13)) END AS text,
         CASE WHEN mime_type = 'image/png'
              THEN 'Unsupported MIME type: image/png' END AS extract_error
  FROM files
)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as folders, customers as files below them."""

    def row(source: DataFrame, key: str, parent, name: str, mime) -> DataFrame:
        return source.select(
            key_id(key[0], F.col(key)).alias("id"),
            parent.alias("parent_id"),
            F.col(name).alias("name"),
            mime.alias("mime_type"),
            F.lit("2026-01-01").alias("modified_time"),
        )

    def key_id(prefix: str, c):
        return F.concat(F.lit(prefix), c.cast("string"))

    folder = F.lit(fixed.FOLDER_MIME)
    mime = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("text/plain"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("application/pdf"))
        .otherwise(F.lit("image/png"))
    )
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    return (
        row(region, "r_regionkey", F.lit("root"), "r_name", folder)
        .unionByName(
            row(nation, "n_nationkey", key_id("r", F.col("n_regionkey")), "n_name", folder)
        )
        .unionByName(
            row(customer, "c_custkey", key_id("n", F.col("c_nationkey")), "c_name", mime)
        )
    )


SQL_NODES = f"""
nodes AS (
  SELECT 'r' || r_regionkey AS id, 'root' AS parent_id, r_name AS name,
         '{fixed.FOLDER_MIME}' AS mime_type FROM region
  UNION ALL
  SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, '{fixed.FOLDER_MIME}' FROM nation
  UNION ALL
  SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'text/plain'
              WHEN 'MACHINERY' THEN 'application/pdf' ELSE 'image/png' END
  FROM customer
)"""


def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as raw mail messages.

    System turns become drafts without a plain body; some threads have missing
    or broken dates, repeated headers, or no labels.
    """
    coded = "translate(base64(encode({}, 'UTF-8')), '+/', '-_')"
    plain = f"trim(TRAILING '=' FROM {coded.format('text')})"
    html = coded.format("concat('<p>', text, '</p>')")
    other = coded.format("'second plain part'")

    def struct(path: str, mime: str, data: str) -> str:
        return f"struct('{path}' AS path, '{mime}' AS mime_type, {data} AS data)"

    html_part = struct("0.0", "text/html", html)
    no_data = "cast(NULL AS string)"
    c = table(spark, sf_dir, "conversations")
    return c.selectExpr(
        "cast(conv_id AS string) AS thread_id",
        "cast(turn AS int) AS api_pos",
        "concat(conv_id, ':', turn) AS message_id",
        f"""CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN 'n/a'
            WHEN conv_id % 10 = 7 AND turn = 0 THEN NULL
            ELSE cast({BASE_MS} + ((turn * 7) % 5) * 3600000 AS string) END AS internal_date""",
        """CASE WHEN role = 'system' THEN array('DRAFT')
            WHEN role = 'user' THEN array('INBOX', 'UNREAD')
            WHEN conv_id % 13 <> 0 THEN array('SENT') END AS label_ids""",
        """filter(transform(array(
              array('SUBJECT', if(conv_id % 8 = 0, 'old subject', NULL)),
              array('Subject', CASE conv_id % 4 WHEN 0 THEN concat('Trip ', conv_id)
                    WHEN 1 THEN concat('  re: Trip ', conv_id) WHEN 3 THEN 'RE: tour' END),
              array('From', CASE role WHEN 'user'
                    THEN concat('Guest <guest', conv_id, '@example.com>')
                    WHEN 'system' THEN 'desk@agency.example'
                    ELSE 'Desk <desk@AGENCY.example>' END),
              array('To', 'desk@agency.example'),
              array('Message-ID', concat('<', conv_id, '.', turn, '@mail.example>')),
              array('References', if(turn > 0, concat('<', conv_id, '.0@mail.example>   <',
                    conv_id, '.', turn - 1, '@mail.example>'), NULL))),
            h -> struct(h[0] AS name, h[1] AS value)), h -> h.value IS NOT NULL) AS headers""",
        f"""CASE WHEN role = 'system'
            THEN array({struct('0', 'multipart/mixed', no_data)}, {html_part})
            ELSE array({struct('0.2', 'text/plain', other)}, {html_part},
                       {struct('0.1', 'text/plain', plain)},
                       {struct('0', 'multipart/alternative', no_data)}) END AS parts""",
    )


SQL_MAILBOX = f"""
raw AS (
  SELECT conv_id, turn, role, CAST(conv_id AS VARCHAR) AS thread_id,
         CAST(turn AS INTEGER) AS api_pos, conv_id || ':' || turn AS message_id,
         CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN 'n/a'
              WHEN conv_id % 10 = 7 AND turn = 0 THEN NULL
              ELSE CAST({BASE_MS} + ((turn * 7) % 5) * 3600000 AS VARCHAR)
         END AS internal_date,
         CASE WHEN conv_id % 4 = 0 THEN 'Trip ' || conv_id
              WHEN conv_id % 4 = 1 THEN '  re: Trip ' || conv_id
              WHEN conv_id % 4 = 3 THEN 'RE: tour'
              ELSE '(no subject)' END AS subject,
         CASE role WHEN 'user' THEN 'Guest <guest' || conv_id || '@example.com>'
                   WHEN 'system' THEN 'desk@agency.example'
                   ELSE 'Desk <desk@AGENCY.example>' END AS sender,
         CASE WHEN role = 'system' THEN '' ELSE text END AS body,
         '<' || conv_id || '.' || turn || '@mail.example>' AS message_id_header,
         CASE WHEN turn > 0 THEN '<' || conv_id || '.0@mail.example>   <' || conv_id || '.'
                                 || (turn - 1) || '@mail.example>' ELSE '' END AS refs,
         role = 'system' AS is_draft
  FROM conversations
),
m AS (
  SELECT *, TRY_CAST(internal_date AS BIGINT) AS date_ms,
         coalesce(strftime(make_timestamp(TRY_CAST(internal_date AS BIGINT) * 1000),
                           '%Y-%m-%d %H:%M') || ' UTC', '') AS received_at
  FROM raw
),
live AS (
  SELECT *, bool_or(date_ms IS NULL) OVER (PARTITION BY thread_id) AS undated
  FROM m WHERE NOT is_draft
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY thread_id
           ORDER BY CASE WHEN undated THEN 0 ELSE date_ms END, api_pos) AS ordinal
  FROM live
),
segments AS (
  SELECT *, '--- MESSAGE ' || ordinal || ' ---' || chr(10)
         || 'Received: ' || CASE received_at WHEN '' THEN '(unknown time)' ELSE received_at END
         || chr(10) || 'From: ' || sender || chr(10) || 'Subject: ' || subject || chr(10)
         || 'Body:' || chr(10) || CASE body WHEN '' THEN '(no plain-text body)' ELSE body END
         AS segment
  FROM placed
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as an index: one chunk per vector."""
    from mailweave.functions.vectors import unit

    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("source_id"),
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("source_name"),
        F.concat(F.lit("label "), F.col("label").cast("string"), F.lit(" / "),
                 F.col("vec_id").cast("string")).alias("source_path"),
        F.col("label").alias("chunk_index"),
        F.concat(F.lit("text of "), F.col("vec_id").cast("string")).alias("text"),
        "embedding",
        unit(F.col("embedding")).alias("unit_embedding"),
    )


SQL_VECTORS = """
units AS (
  SELECT CAST(vec_id AS VARCHAR) AS source_id, 'vec-' || vec_id AS source_name,
         'label ' || label || ' / ' || vec_id AS source_path,
         label AS chunk_index, 'text of ' || vec_id AS text, label, embedding,
         sqrt(list_sum(list_transform(embedding,
              lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm
  FROM embeddings
),
vecs AS (
  SELECT *, list_transform(embedding, lambda x: CAST(CAST(CAST(x AS DOUBLE) / norm AS FLOAT)
                                                    AS DOUBLE)) AS unit
  FROM units
),
means AS (
  SELECT label, i, avg(CAST(x AS DOUBLE)) AS mean
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
        FROM embeddings)
  GROUP BY label, i
),
label_queries AS (
  SELECT CAST(label AS VARCHAR) AS query_id, list(mean ORDER BY i) AS vector
  FROM means GROUP BY label
)"""


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label as query vectors."""
    e = table(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "mean")))
    return means.groupBy("label").agg(ordered.alias("means")).select(
        F.col("label").cast("string").alias("query_id"),
        F.col("means.mean").alias("vector"),
    )


def mean_query(spark: SparkSession, sf_dir: str) -> list[float]:
    """Mean of all vectors, as one query."""
    e = table(spark, sf_dir, "embeddings")
    parts = e.select(F.posexplode("embedding").alias("i", "x"))
    rows = parts.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("mean")).orderBy("i")
    return [r["mean"] for r in rows.collect()]


SQL_MEAN_QUERY = """
mean_query AS (
  SELECT list(mean ORDER BY i) AS vector
  FROM (SELECT i, avg(CAST(x AS DOUBLE)) AS mean
        FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
              FROM embeddings)
        GROUP BY i)
)"""


# Lines of mail exports: a print title, a header, and a header broken over two lines.
TITLE = "Correo de Ferrocarril Norte - Horarios 11/02/31, 7:05 AM"
HEADER = "Irene Vidal <irene.vidal@posta.example> 7 de octubre de 2031 a las 11:46 a.m. Para: mesa"
BROKEN_HEADER = ("Bruno Sala <bsala@correo.example>", "19 de febrero de 2030 a las 6:15 p.m. Para: mesa")


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as thread exports: lines parted by message headers."""
    wrapped = "\n".join(BROKEN_HEADER)
    d = table(spark, sf_dir, "documents")
    body = F.replace("text", F.lit(".\n"), F.lit(f".\n{TITLE} \n{TITLE}\n{HEADER}\n"))
    body = F.replace(body, F.lit(",\n"), F.lit(f",\r\n{wrapped}\n\n\n\n"))
    return d.select("doc_id", body.alias("text"))


SQL_EXPORT_TEXT = f"""
replace(replace(text, '.' || chr(10),
  '.' || chr(10) || '{TITLE} ' || chr(10) || '{TITLE}' || chr(10) || '{HEADER}' || chr(10)),
  ',' || chr(10),
  ',' || chr(13) || chr(10) || '{BROKEN_HEADER[0]}' || chr(10)
  || '{BROKEN_HEADER[1]}' || chr(10) || chr(10) || chr(10) || chr(10))
"""
