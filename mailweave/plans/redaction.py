"""Queries for redaction and export tidying."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailweave.functions import fixed, redact, tidy
from mailweave.operators import exports, phrases
from mailweave.plans import inputs
from mailweave.plans.registry import query
from mailweave.session import scratch_path
from mailweave.sources import listing


def _leaky(spark, sf):
    """Documents and the links, addresses and account numbers made from them."""
    d = inputs.table(spark, sf, "documents")
    number = F.col("doc_id").cast("string")
    extra = F.concat(
        F.lit("\nhttps://pay.example/receipts/abcDEF"), F.lpad(number, 8, F.lit("0")),
        F.lit(" or https://agency.example/tours/hike, Ana.B+"), number,
        F.lit("@mail.example.org; IBAN DE89"), F.lpad(number, 18, F.lit("3")),
        F.lit(" code MACHU2026FOUR"),
    )
    return d.select("doc_id", F.concat("text", extra).alias("text"))


_LEAKY = """
leaky AS (
  SELECT doc_id, text || chr(10) || 'https://pay.example/receipts/abcDEF'
    || lpad(CAST(doc_id AS VARCHAR), 8, '0')
    || ' or https://agency.example/tours/hike, Ana.B+' || doc_id
    || '@mail.example.org; IBAN DE89' || lpad(CAST(doc_id AS VARCHAR), 18, '3')
    || ' code MACHU2026FOUR' AS text
  FROM documents
)"""
# The patterns in RE2 syntax; the generated texts have no case where ASCII and
# Unicode word borders differ.
_RE2_URL = fixed.BOOKING_URL_PATTERN.replace("(?iU)", "(?i)").replace("'", "''")
_RE2_EMAIL = fixed.EMAIL_PATTERN.replace("(?U)", "")
_RE2_IBAN = fixed.IBAN_PATTERN.replace("(?U)", "")
# A digit is a word character, so a border test replaces the look-arounds: ``\\b``
# next to a digit, ``\\B`` before a plus sign or bracket.
_PHONE_BODY = r"(?:\d[\s.\-]?){6,14}\d\b"
_RE2_PHONE = (
    r"(?:\b(?:\d{1,4}\)?[\s.\-]?)?|\B\+(?:\(?\d{1,4}\)?[\s.\-]?)?|\B\(\d{1,4}\)?[\s.\-]?)"
    + _PHONE_BODY
)
# Digits with single separators; inside such a run digits are the only word
# characters, so border tests again replace the look-arounds.
_RUN = r"\d(?:[ \-]?\d)*"
_CARD = r"\b(?:\d[ \-]?){12,18}\d\b"
_DIGITS = "list_reverse(string_split(regexp_replace(p[2], '[ -]', '', 'g'), ''))"
_LUHN = f"""list_sum(list_transform({_DIGITS}, lambda x, i:
  CASE WHEN i % 2 = 1 THEN CAST(x AS INTEGER)
       WHEN CAST(x AS INTEGER) > 4 THEN CAST(x AS INTEGER) * 2 - 9
       ELSE CAST(x AS INTEGER) * 2 END)) % 10 = 0"""


def _sql_cards(source: str, target: str, keys: str) -> str:
    return f"""
{target}_runs AS (
  SELECT {keys}, unnest(list_zip(gaps, found)) AS p, generate_subscripts(gaps, 1) AS i
  FROM (SELECT {keys}, string_split_regex(text, '{_RUN}') AS gaps,
               regexp_extract_all(text, '{_RUN}') AS found FROM {source})
),
{target}_parts AS (
  SELECT {keys}, i, p[1] AS gap, list_zip(string_split_regex(coalesce(p[2], ''), '{_CARD}'),
         regexp_extract_all(coalesce(p[2], ''), '{_CARD}')) AS parts
  FROM {target}_runs
),
{target} AS (
  SELECT {keys}, string_agg(gap || array_to_string(list_transform(parts, lambda p: p[1]
           || CASE WHEN p[2] IS NULL THEN '' WHEN {_LUHN} THEN '<CARD>' ELSE p[2] END), ''),
         '' ORDER BY i) AS text
  FROM {target}_parts GROUP BY {keys}
)"""


def sql_sanitize(source: str, keys: str) -> str:
    """CTEs that turn ``source(keys, text)`` into ``<source>_clean(keys, text)``."""
    return f"""
{source}_early AS (
  SELECT {keys}, regexp_replace(regexp_replace(regexp_replace(text, '{_RE2_URL}',
         '<BOOKING_URL>', 'g'), '{_RE2_EMAIL}', '<EMAIL>', 'g'), '{_RE2_IBAN}', '<IBAN>', 'g')
         AS text
  FROM {source}
),
{_sql_cards(source + '_early', source + '_cards', keys)},
{source}_clean AS (
  SELECT {keys}, regexp_replace(text, '{_RE2_PHONE}', '<PHONE>', 'g') AS text
  FROM {source}_cards
)"""


def _sql(pattern: str, marker: str) -> str:
    return (
        f"WITH {_LEAKY} SELECT doc_id, regexp_replace(text, '{pattern}', '{marker}', 'g') AS text"
        " FROM leaky"
    )


def _with(spark, sf, column):
    return _leaky(spark, sf).select("doc_id", column(F.col("text")).alias("text"))


@query("r1_booking_urls", _sql(_RE2_URL, "<BOOKING_URL>"))
def r1(spark, sf):
    return _with(spark, sf, redact.redact_booking_urls)


@query("r2_emails", _sql(_RE2_EMAIL, "<EMAIL>"))
def r2(spark, sf):
    return _with(spark, sf, redact.redact_emails)


@query("r3_ibans", _sql(_RE2_IBAN, "<IBAN>"))
def r3(spark, sf):
    return _with(spark, sf, redact.redact_ibans)


@query(
    "r4_cards",
    f"WITH {_LEAKY}, {_sql_cards('leaky', 'cards', 'doc_id')} SELECT doc_id, text FROM cards",
)
def r4(spark, sf):
    return _with(spark, sf, redact.redact_cards)


@query("r5_phones", _sql(_RE2_PHONE, "<PHONE>"))
def r5(spark, sf):
    return _with(spark, sf, redact.redact_phones)


@query(
    "r6_sanitize",
    f"WITH {_LEAKY}, {sql_sanitize('leaky', 'doc_id')} SELECT doc_id, text FROM leaky_clean",
)
def r6(spark, sf):
    return _with(spark, sf, redact.sanitize)


_MARKER_SUMS = ", ".join(
    f"CAST(sum(len(regexp_extract_all(text, '{m}'))) AS BIGINT) AS n_{m.strip('<>').lower()}"
    for m in fixed.MARKERS
)
_CLEAN = f"WITH {_LEAKY}, {sql_sanitize('leaky', 'doc_id')}"


@query(
    "r7_marker_counts",
    f"""{_CLEAN} SELECT source, {_MARKER_SUMS}
    FROM leaky_clean c JOIN (SELECT doc_id, source FROM documents) d USING (doc_id)
    GROUP BY source""",
)
def r7(spark, sf):
    sources = inputs.table(spark, sf, "documents").select("doc_id", "source")
    clean = _with(spark, sf, redact.sanitize)
    counted = clean.select("doc_id", *redact.marker_counts(F.col("text")))
    return (
        counted.join(sources, "doc_id")
        .groupBy("source")
        .agg(*[F.sum(c).alias(c) for c in counted.columns if c != "doc_id"])
    )


@query("r7_findings_per_type", f"{_CLEAN} SELECT {_MARKER_SUMS} FROM leaky_clean")
def r7_all(spark, sf):
    clean = _with(spark, sf, redact.sanitize)
    counted = clean.select(*redact.marker_counts(F.col("text")))
    return counted.agg(*[F.sum(c).alias(c) for c in counted.columns])


# --- SQL for exports --------------------------------------------------


def _is_title(c: str) -> str:
    return (
        f"(length(trim({c})) > 12 AND lower(trim({c})) LIKE 'correo de %'"
        f" AND regexp_matches(trim({c}), '(?i)\\b(PM|AM|p\\.m\\.|a\\.m\\.)\\.?\\s*$')"
        f" AND regexp_matches(trim({c}), '[\\d/]+'))"
    )


def _is_header(c: str) -> str:
    def has(pattern: str) -> str:
        return f"regexp_matches(trim({c}), '(?i){pattern}')"

    return (
        f"(length(trim({c})) >= 30 AND contains({c}, '<') AND contains({c}, '>') AND ("
        f"(length(trim({c})) < 2000 AND {has(fixed.HEADER_ENGLISH_PATTERN)})"
        f" OR {has(fixed.HEADER_ORIGINAL_PATTERN)}"
        f" OR (len(regexp_extract_all(trim({c}), ' de ')) >= 2"
        f" AND {has(fixed.HEADER_SPANISH_DATE_PATTERN)}"
        f" AND ({has(fixed.HEADER_SPANISH_MARK_PATTERN)} OR "
        f"regexp_matches(trim({c}), '{fixed.HEADER_SPANISH_AFTER_PATTERN_CASED}')))))"
    )


def _sql_lines(source: str, target: str, key: str) -> str:
    """Right-trimmed lines of ``source(key, text)``."""
    split = "string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))"
    return f"""
{target} AS (
  SELECT {key}, rtrim(unnest({split}), ' ' || chr(9)) AS line,
         generate_subscripts({split}, 1) AS pos FROM {source}
)"""


def _sql_elided(source: str, target: str, key: str) -> str:
    return f"""
{target}_flags AS (SELECT *, {_is_title('line')} AS title FROM {source}),
{target} AS (
  SELECT {key}, pos, CASE WHEN title THEN '{fixed.PRINT_TITLE_NOTE}' ELSE line END AS line
  FROM (SELECT *, coalesce(lag(title) OVER (PARTITION BY {key} ORDER BY pos), false) AS follows
        FROM {target}_flags)
  WHERE NOT (title AND follows)
)"""


def _sql_joined(source: str, target: str, key: str) -> str:
    """One pass is enough: headers of the test texts are split in two at most."""
    both = "line || ' ' || coalesce(following, '')"
    return f"""
{target}_next AS (
  SELECT *, lead(line) OVER (PARTITION BY {key} ORDER BY pos) AS following FROM {source}
),
{target}_open AS (
  SELECT *, following IS NOT NULL AND contains(line, '<') AND NOT {_is_header('line')}
            AND {_is_header('(' + both + ')')} AS opens
  FROM {target}_next
),
{target} AS (
  SELECT {key}, pos, CASE WHEN opens THEN trim({both}) ELSE line END AS line
  FROM (SELECT *, coalesce(lag(opens) OVER (PARTITION BY {key} ORDER BY pos), false) AS swallowed
        FROM {target}_open)
  WHERE NOT swallowed
)"""


def _sql_text(source: str, target: str, key: str) -> str:
    return f"""
{target} AS (
  SELECT {key}, string_agg(line, chr(10) ORDER BY pos) AS text FROM {source} GROUP BY {key}
)"""


def _sql_counted(source: str, target: str, key: str) -> str:
    return f"""
{target}_heads AS (SELECT *, {_is_header('line')} AS head FROM {source}),
{target} AS (
  SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY {key} ORDER BY pos
            ROWS UNBOUNDED PRECEDING) AS msg
  FROM {target}_heads
)"""


_BANNER_LINE = f"""CASE WHEN head AND msg > 1
  THEN chr(10) || '{fixed.MESSAGE_RULE}' || chr(10) || '  Message ' || msg || chr(10)
       || '{fixed.MESSAGE_RULE}' || chr(10) || chr(10) || line ELSE line END"""


def sql_tidy(source: str, key: str) -> str:
    """CTEs that turn ``source(key, text)`` into ``tidied(key, text)``."""
    squeeze = "regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')"
    return f"""
{_sql_lines(source, 'y_lines', key)}, {_sql_elided('y_lines', 'y_elided', key)},
{_sql_joined('y_elided', 'y_joined', key)}, {_sql_text('y_joined', 'y_text', key)},
y_squeezed AS (SELECT {key}, {squeeze} AS text FROM y_text),
{_sql_lines('y_squeezed', 'y_again', key)}, {_sql_counted('y_again', 'y_counted', key)},
y_marked AS (
  SELECT {key}, string_agg({_BANNER_LINE}, chr(10) ORDER BY pos) AS text
  FROM y_counted GROUP BY {key}
),
tidied AS (
  SELECT {key}, CASE WHEN s.text = '' THEN '' ELSE
    trim({squeeze.replace('(text', '(m.text')}, ' ' || chr(9) || chr(10)) || chr(10) END AS text
  FROM y_marked m JOIN {source} s USING ({key})
)"""


_EXPORTS = f"exports AS (SELECT doc_id, {inputs.SQL_EXPORT_TEXT} AS text FROM documents)"
_LINES = f"{_EXPORTS}, {_sql_lines('exports', 'numbered', 'doc_id')}"


# --- listed phrases ---------------------------------------------------------------


def _phrases(spark, sf):
    """Part brands and types as a phrase list with repeats and blanks."""
    p = inputs.table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("pos"),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("  "), "p_brand", F.lit(" ")))
        .when(F.col("p_partkey") % 7 == 0, F.lit("  "))
        .otherwise(F.col("p_type"))
        .alias("phrase"),
    )


_PHRASES = """
listed AS (
  SELECT p_partkey AS pos, trim(CASE WHEN p_partkey % 5 = 0 THEN '  ' || p_brand || ' '
         WHEN p_partkey % 7 = 0 THEN '  ' ELSE p_type END) AS phrase FROM part
),
firsts AS (SELECT phrase, min(pos) AS pos FROM listed WHERE phrase <> '' GROUP BY phrase),
places AS (SELECT *, row_number() OVER (ORDER BY pos, phrase) AS place FROM firsts)
"""


@query("r8_distinct_phrases", f"WITH {_PHRASES} SELECT * FROM firsts")
def r8(spark, sf):
    return phrases.distinct_phrases(_phrases(spark, sf))


_POOL = "[" + ", ".join(f"'{n}'" for n in fixed.STAND_IN_POOL) + "]"


@query(
    "r10_stand_ins",
    f"""WITH {_PHRASES} SELECT phrase, {_POOL}[(place - 1) % 16 + 1] AS pool,
        'Cliente ' || place AS numbered, '<NAME>' AS marker FROM places""",
)
def r10(spark, sf):
    listed = _phrases(spark, sf)
    out = None
    for style in ("pool", "numbered", "marker"):
        named = phrases.stand_ins(listed, style).select(
            "phrase", F.col("replacement").alias(style)
        )
        out = named if out is None else out.join(named, "phrase")
    return out


def _customer_notes(spark, sf):
    """Texts that name regions and nations in several ways."""
    c = inputs.table(spark, sf, "customer")
    n = inputs.table(spark, sf, "nation")
    r = inputs.table(spark, sf, "region")
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(
        r, F.col("n_regionkey") == F.col("r_regionkey")
    )
    text = F.concat(
        "c_name", F.lit(" of "), F.initcap(F.lower("n_name")), F.lit(", "),
        F.lower("r_name"), F.lit(" ("), "n_name", F.lit(")"),
    )
    return joined.select("c_custkey", text.alias("text"))


def _place_names(spark, sf):
    n = inputs.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("pos"), F.col("n_name").alias("phrase")
    )
    r = inputs.table(spark, sf, "region").select(
        (F.col("r_regionkey") + 100).alias("pos"), F.col("r_name").alias("phrase")
    )
    return n.unionByName(r)


_REPLACED = """
WITH RECURSIVE names AS (
  SELECT n_name AS phrase, n_nationkey AS pos FROM nation
  UNION ALL SELECT r_name, r_regionkey + 100 FROM region
),
firsts AS (SELECT phrase, min(pos) AS pos FROM names GROUP BY phrase),
turns AS (
  SELECT phrase, row_number() OVER (ORDER BY length(phrase) DESC, pos) AS turn FROM firsts
),
steps(c_custkey, text, turn) AS (
  SELECT c_custkey, c_name || ' of ' || upper(left(n_name, 1)) || lower(n_name[2:])
         || ', ' || lower(r_name) || ' (' || n_name || ')', CAST(0 AS BIGINT)
  FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT s.c_custkey, regexp_replace(s.text, regexp_escape(t.phrase), '<NAME>', 'gi'), t.turn
  FROM steps s JOIN turns t ON t.turn = s.turn + 1
)
SELECT c_custkey, text FROM steps WHERE turn = (SELECT max(turn) FROM turns)"""


@query("r9_replace_phrases", _REPLACED)
def r9(spark, sf):
    notes = _customer_notes(spark, sf)
    return phrases.redact_phrases(notes, _place_names(spark, sf), style="marker")


@query(
    "r9_replace_many_phrases",
    """WITH named AS (
      SELECT c_custkey, c_name,
             row_number() OVER (ORDER BY length(c_name) DESC, c_custkey) AS place FROM customer)
    SELECT o_orderkey, 'order ' || o_orderkey || ' of Cliente ' || a.place
           || CASE WHEN b.place IS NULL THEN '' ELSE ', sent to Cliente ' || b.place END AS text
    FROM (SELECT *, (o_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS other FROM orders)
    JOIN named a ON a.c_custkey = o_custkey LEFT JOIN named b ON b.c_custkey = other""",
)
def r9_many(spark, sf):
    """As many phrases as there are customers, each order naming two of them in other letters."""
    c = inputs.table(spark, sf, "customer").select("c_custkey", "c_name")
    o = inputs.table(spark, sf, "orders").withColumn(
        "other", (F.col("o_custkey") * 7 + 3) % F.lit(c.count())
    )
    second = c.select(F.col("c_custkey").alias("other"), F.lower("c_name").alias("second"))
    texts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(second, "other", "left").select(
        "o_orderkey",
        F.concat(
            F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.upper("c_name"),
            F.coalesce(F.concat(F.lit(", sent to "), "second"), F.lit("")),
        ).alias("text"),
    )
    listed = c.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("phrase"))
    return phrases.redact_phrases(texts, listed, style="numbered")


@query(
    "r11_redact_documents",
    f"""{_CLEAN}, {_PHRASES.strip()},
    rules AS (SELECT list({{'text': phrase, 'other': 'Cliente ' || place}}
                          ORDER BY length(phrase) DESC, place) AS rules FROM places),
    named AS (
      SELECT doc_id, list_reduce(list_prepend({{'text': text, 'other': ''}}, rules),
        lambda a, b: {{'text': regexp_replace(a.text, regexp_escape(b.text), b.other, 'gi'),
                       'other': ''}}).text AS text
      FROM leaky_clean, rules
    ),
    {sql_tidy('named', 'doc_id')} SELECT * FROM tidied""",
)
def r11(spark, sf):
    listed = _phrases(spark, sf)
    return phrases.redact_documents(_leaky(spark, sf), listed, style="numbered")


@query(
    "s14_redact_files",
    f"""WITH {inputs.SQL_FILES}, raw AS (SELECT path, body AS text FROM files),
    {sql_sanitize('raw', 'path')}, {sql_tidy('raw_clean', 'path')}
    SELECT 'redacted / ' || replace(replace(path, '.txt', '.redacted.txt'), '/', ' / ') AS output_path, text
    FROM tidied""",
)
def s14(spark, sf):
    """Files are written, listed and read back."""
    files = inputs.files(spark, sf).select("path", F.decode("content", "UTF-8").alias("text"))
    folder = f"{scratch_path(spark, 's14')}/redacted"
    phrases.redact_files(files, folder)
    return listing.read_folder(spark, folder).select(
        F.col("path").alias("output_path"), F.decode("content", "UTF-8").alias("text")
    )


# --- exports -----------------------------------------------------------------------

@query(
    "t1_normalize_export",
    f"""WITH {_LINES}
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM numbered GROUP BY doc_id""",
)
def t1(spark, sf):
    text = tidy.normalize_export(F.col("text"))
    return inputs.exports(spark, sf).select("doc_id", text.alias("text"))


@query(
    "t2_elide_print_titles",
    f"""WITH {_LINES}, {_sql_elided('numbered', 'elided', 'doc_id')},
    {_sql_text('elided', 'out', 'doc_id')} SELECT * FROM out""",
)
def t2(spark, sf):
    lines = tidy.elide_print_titles(tidy.export_lines(tidy.normalize_characters(F.col("text"))))
    return inputs.exports(spark, sf).select("doc_id", F.array_join(lines, "\n").alias("text"))


@query(
    "t3_join_wrapped_headers",
    f"""WITH {_LINES}, {_sql_joined('numbered', 'joined', 'doc_id')},
    {_sql_text('joined', 'out', 'doc_id')} SELECT * FROM out""",
)
def t3(spark, sf):
    rows = inputs.exports(spark, sf).select(
        "doc_id", tidy.export_lines(tidy.normalize_characters(F.col("text"))).alias("lines")
    )
    joined = exports.join_wrapped_headers(rows, "lines")
    return joined.select("doc_id", F.array_join("lines", "\n").alias("text"))


@query(
    "t4_header_lines",
    f"""WITH {_LINES}
    SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, line FROM numbered WHERE {_is_header('line')}""",
)
def t4(spark, sf):
    rows = inputs.exports(spark, sf).select(
        "doc_id", F.posexplode(tidy.export_lines(tidy.normalize_characters(F.col("text")))).alias("pos", "line")
    )
    return rows.where(tidy.is_message_header(F.col("line")))


_MARKED = f"WITH {_LINES}, {_sql_counted('numbered', 'counted', 'doc_id')}\n"


@query(
    "t5_mark_messages",
    _MARKED
    + f"""SELECT doc_id, string_agg({_BANNER_LINE}, chr(10) ORDER BY pos) AS text
    FROM counted GROUP BY doc_id""",
)
def t5(spark, sf):
    rows = inputs.exports(spark, sf).select(
        "doc_id", tidy.normalize_export(F.col("text")).alias("text")
    )
    return rows.select("doc_id", tidy.mark_messages(F.col("text")).alias("text"))


@query(
    "t5_split_messages",
    _MARKED
    + """SELECT doc_id, CAST(msg AS INTEGER) AS message_no,
         string_agg(line, chr(10) ORDER BY pos) AS text FROM counted GROUP BY doc_id, msg""",
)
def t5_split(spark, sf):
    rows = inputs.exports(spark, sf).select(
        "doc_id", tidy.normalize_export(F.col("text")).alias("text")
    )
    return rows.select("doc_id", F.inline(tidy.export_messages(F.col("text"))))


@query("t6_tidy_export", f"WITH {_EXPORTS}, {sql_tidy('exports', 'doc_id')} SELECT * FROM tidied")
def t6(spark, sf):
    return exports.tidy_export(inputs.exports(spark, sf))


@query(
    "t6_tidy_plain",
    f"""WITH {_LINES},
    joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t
               FROM numbered GROUP BY doc_id)
    SELECT doc_id, CASE WHEN t = '' THEN '' ELSE trim(regexp_replace(t, '\\n{{3,}}',
           chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) || chr(10) END AS text
    FROM joined""",
)
def t6_plain(spark, sf):
    rows = inputs.exports(spark, sf)
    return exports.tidy_export(rows, print_titles=False, messages=False)
