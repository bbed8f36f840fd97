"""Limits, markers, patterns and wording that results depend on.

Everything here is data. Patterns are in Java regex syntax; the ``U`` flag
gives ``\\w \\d \\s \\b`` their Unicode meaning.
"""

from __future__ import annotations

# --- characters -----------------------------------------------------------
# Unicode white space, including the four ASCII separators U+001C..U+001F.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a character class.
WHITESPACE_CLASS = (
    "\\t-\\r\\x1c-\\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_END_PATTERN = "\\r\\n|[\\n-\\r\\x1c-\\x1e\x85\u2028\u2029]"
PARAGRAPH_BREAK_PATTERN = f"\\n[{WHITESPACE_CLASS}]*\\n+"

# --- chunking -------------------------------------------------------------
CHARS_PER_TOKEN = 4
CHUNK_TOKENS = 800
OVERLAP_TOKENS = 100

# --- retrieval text -------------------------------------------------------
DEFAULT_TOP_K = 4
QUERY_TAIL_CHARS = 4_000
LANGUAGE_HEAD_CHARS = 2_000
LANGUAGE_TAIL_CHARS = 2_000
CLASSIFIER_BODY_CHARS = 8_000
LANGUAGE_SAMPLE_BANNER = (
    "\n\n[... earlier thread content omitted for language detection ...]\n\n"
)
FOLDER_ID_PATTERNS = (r"/folders/([a-zA-Z0-9_-]+)", r"[?&]id=([a-zA-Z0-9_-]+)")
DOCUMENT_ID_PATTERNS = (r"/document/d/([a-zA-Z0-9_-]+)", r"[?&]id=([a-zA-Z0-9_-]+)")

# --- mail threads ---------------------------------------------------------
DEFAULT_SUBJECT = "(no subject)"
UNKNOWN_TIME = "(unknown time)"
UNKNOWN_SENDER = "(unknown sender)"
NO_BODY = "(no plain-text body)"
OMISSION_BANNER_HEAD = "[Earlier thread messages omitted — showing the most recent "
OMISSION_BANNER_TAIL = " message(s).]"
THREAD_MAX_CHARS = 48_000
MIN_THREAD_MAX_CHARS = 1_000
INBOX_BATCH = 50
SCAN_INTERVAL_SECONDS = 1_800

# --- redaction ------------------------------------------------------------
BOOKING_URL_PATTERN = (
    r"(?iU)https?://[^\s<>\"']*?"
    r"(?:[A-Za-z][A-Za-z0-9_-]{9,}|[0-9][A-Za-z0-9_-]{9,})[^\s<>\"']*"
)
EMAIL_PATTERN = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IBAN_PATTERN = r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
CARD_PATTERN = r"(?U)(?<!\d)(?:\d[ \-]?){12,18}\d(?!\d)"
PHONE_PATTERN = (
    r"(?U)(?<!\w)\+?(?:\(?\d{1,4}\)?[\s.\-]?)?(?:\d[\s.\-]?){6,14}\d(?!\w)"
)
MARKERS = ("<BOOKING_URL>", "<EMAIL>", "<IBAN>", "<CARD>", "<PHONE>")
NAME_MARKER = "<NAME>"
NUMBERED_STAND_IN = "Cliente "
STAND_IN_POOL = (
    "Elena Fabbri",
    "Mauro Neri",
    "Carmen Delgado",
    "Luis Fuentes",
    "Giulia Pellegrini",
    "Tommaso Serra",
    "Ana Ortega",
    "Diego Cuesta",
    "Francesca Motta",
    "Andrea Moretti",
    "Sofía Renedo",
    "Javier Mira",
    "Lucia Brambilla",
    "Pietro Cattaneo",
    "Marta Sánchez",
    "Hugo Paredes",
)

# --- thread exports -------------------------------------------------------
WIDE_SPACES = "\xa0\u202f\u2009\u2002\u2003"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
PRINT_TITLE_PREFIX = "correo de "
PRINT_TITLE_MIN_CHARS = 12
PRINT_TITLE_END_PATTERN = r"(?iU)\b(PM|AM|p\.m\.|a\.m\.)\.?\s*$"
PRINT_TITLE_DIGIT_PATTERN = r"(?U)[\d/]+"
PRINT_TITLE_NOTE = "--- (PDF/print page header, duplicate removed) ---"
HEADER_MIN_CHARS = 30
HEADER_MAX_CHARS_ENGLISH = 2_000
# Without flags; all of them but the one named so ignore case.
HEADER_ENGLISH_PATTERN = r"^On [^\n]+wrote:?\s*$"
HEADER_ORIGINAL_PATTERN = r"^----+\s*Original Message\s*----"
HEADER_SPANISH_DATE_PATTERN = r"\d{1,2} de [a-záéíóúüñA-ZÁÉÍÓÚÜÑ\.\- ]+ de 20\d{2}"
HEADER_SPANISH_MARK_PATTERN = r"(a las|a\.\s*m\.|p\.\s*m\.|Para:)"
HEADER_SPANISH_AFTER_PATTERN_CASED = r">\s+\d{1,2} de"
MESSAGE_RULE = "-" * 76
WRAPPED_HEADER_PASSES = 8

# --- model answers --------------------------------------------------------
LANGUAGE_NAMES = {"it": "Italian", "es": "Spanish", "en": "English"}
DEFAULT_LANGUAGE = "en"
ANSWER_STRIP_CHARS = " \t.:;,!?\"'"

# --- sources --------------------------------------------------------------
FOLDER_MIME = "application/vnd.google-apps.folder"
DOCUMENT_MIME = "application/vnd.google-apps.document"
PDF_MIME = "application/pdf"
TEXT_MIMES = ("text/plain", "text/markdown")
INCLUDE_MIME_TYPES = (PDF_MIME, DOCUMENT_MIME, "text/plain", "text/markdown")
PATH_SEPARATOR = " / "

# --- outcomes -------------------------------------------------------------
OUTCOME_DRAFTED = "drafted"
OUTCOME_OFF_TOPIC = "non_travel"
OUTCOME_HAS_DRAFT = "thread_has_draft"

# --- prompt wording -------------------------------------------------------
REFERENCE_OPEN = "--- REFERENCE MATERIAL ---"
REFERENCE_CLOSE = "--- END REFERENCE MATERIAL ---"
EXAMPLES_HEADER = (
    "EXAMPLE RESPONSES (style and tone only): The replies below are "
    "examples of how our team writes. Mirror their voice and structure. "
    "The REFERENCE MATERIAL above is authoritative for facts (prices, "
    "durations, inclusions); if an example contradicts it, follow the "
    "REFERENCE MATERIAL. Do not copy example wording verbatim."
)
EXAMPLES_OPEN = "--- EXAMPLE RESPONSES ---"
EXAMPLES_CLOSE = "--- END EXAMPLE RESPONSES ---"
PROMPT_LANGUAGE = (
    "LANGUAGE REQUIREMENT: Write your entire reply in {lang}. "
    "Do not use Spanish, English, or any language other than {lang} "
    "(unless that language is the one requested). "
    "Even if the original email is in a different language, your reply "
    "must be in {lang}.\n\n"
)
PROMPT_TASK = (
    "TASK: Write a professional, concise reply from our Cusco travel agency "
    "to the client email thread below. "
    "Do not add a subject line. Do not include "
    "any meta commentary or translations — output only the reply body.\n\n"
    "RESPONSE SCOPE:\n"
    "- Answer the latest customer turn below as the primary task.\n"
    "- Use earlier thread messages only as background context.\n"
    "- Do NOT re-answer questions that were already resolved earlier in the "
    "thread unless the latest customer turn explicitly asks to revisit them.\n\n"
    "LATEST CUSTOMER TURN (primary task):\n"
)
PROMPT_REFERENCE_USE = (
    "USE OF REFERENCE MATERIAL: When the client asks about specific "
    "facts — prices, inclusions, durations, policies — only use facts "
    "that appear in the reference material below. If a fact is not in "
    "the reference material, do not invent it; ask the client for "
    "clarification or offer to follow up.\n\n"
)
PROMPT_THREAD = "CLIENT EMAIL THREAD (chronological, oldest first):\n"
PROMPT_REPLY = "YOUR REPLY (in {lang}):"
LANGUAGE_QUESTION = (
    "Detect the language of the following text. "
    "Reply with ONLY one of these codes: it, es, en. "
    "No explanation.\n\n"
    "Text:\n"
)
TOPIC_QUESTION = (
    "Is the following email related to travel, tours, or trips to Peru or Cusco? "
    "Reply with exactly two tokens separated by a space: "
    "first 'yes' or 'no', then the language code ('it', 'es', or 'en'). "
    "Example: 'yes it'  or  'no en'\n\n"
    "Subject: {subject}\n\n"
    "Body:\n"
)
