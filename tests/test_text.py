import pytest
from pyspark.sql import functions as F

from mailweave.functions import answers, fixed, text


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "t string")
    row = df.select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


T = None


@pytest.fixture(autouse=True)
def column(spark):
    global T
    T = F.col("t")


def test_strip_is_unicode(spark):
    assert one(spark, " \x1c a b 　\n", text.strip(T)) == "a b"


def test_words_and_lines(spark):
    assert one(spark, " a b\n\tc ", text.words(T)) == ["a", "b", "c"]
    sample = "a\r\nb\x0bc\x85d e\n"
    assert one(spark, sample, text.lines(T)) == sample.splitlines() + [""]


def test_token_count(spark):
    assert [one(spark, s, text.approximate_tokens(T)) for s in ("", "abc", "a" * 9)] == [1, 1, 2]


def test_paragraphs(spark):
    assert one(spark, "a\r\n \r\n b \n\n\n\n\nc\nd\n\n ", text.paragraphs(T)) == ["a", "b", "c\nd"]


def test_language_sample(spark):
    assert one(spark, "x" * 4000, text.language_sample(T)) == "x" * 4000
    long = "a" * 3000 + "b" * 3000
    assert one(spark, long, text.language_sample(T)) == (
        "a" * 2000 + fixed.LANGUAGE_SAMPLE_BANNER + "b" * 2000
    )


def test_retrieval_query(spark):
    q = text.retrieval_query(T, F.lit("Trip"), F.lit("  when? "))
    assert one(spark, "thread", q) == (
        "Subject: Trip\n\nLatest customer turn:\nwhen?\n\nRecent thread context:\nthread"
    )
    q = text.retrieval_query(T, F.lit("Trip"), F.lit("  \n"))
    assert "Latest customer turn:\nthread" in one(spark, "thread", q)


def test_preview(spark):
    assert one(spark, "a\nb", text.preview(T)) == "a b"
    cut = one(spark, "x" * 241, text.preview(T))
    assert cut == "x" * 237 + "..."


def test_link_id(spark):
    cases = {
        "https://d.example/drive/folders/AB_c-1?usp=sharing": "AB_c-1",
        "https://d.example/open?x=1&id=ZZ9": "ZZ9",
        "  rawid ": "rawid",
        "": "",
    }
    for link, want in cases.items():
        assert one(spark, link, text.link_id(T)) == want
    doc = "https://d.example/document/d/D_1/edit"
    assert one(spark, doc, text.link_id(T, fixed.DOCUMENT_ID_PATTERNS)) == "D_1"


def test_language_code(spark):
    cases = {
        "it": "it",
        " ES ": "es",
        "fr": "en",
        "The language is: it": "it",
        "This is limited context.": "en",
        "it.": "it",
        "en\nbecause it is": "en",
        "It is English": "it",
        "": "en",
        "\n\n": "en",
    }
    for raw, want in cases.items():
        assert one(spark, raw, answers.language_code(T)) == want, raw


def test_topic_answer(spark):
    cases = {
        "yes it": (True, "it"),
        "No en": (False, "en"),
        "YES": (True, "en"),
        "yes es it": (True, "it"),
        "yes, it.": (True, "en"),
        "": (False, "en"),
    }
    for raw, want in cases.items():
        got = one(spark, raw, answers.topic_answer(T))
        assert (got.related, got.language) == want, raw


def test_language_name_and_empty_reply(spark):
    assert one(spark, "es", answers.language_name(T)) == "Spanish"
    assert one(spark, "fr", answers.language_name(T)) == "English"
    assert one(spark, " \n", answers.reply_error(T)) == "empty reply"
    assert one(spark, "hi", answers.reply_error(T)) is None
