import random
import re

import pytest
from pyspark.sql import functions as F

from mailweave.functions import fixed, redact
from mailweave.operators import phrases


def clean(spark, *texts, column=redact.sanitize):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", column(F.col("t")).alias("t")).orderBy("i").collect()
    return [r.t for r in rows]


MARKED = {
    "answer to rita_s.44@posta.example please": "<EMAIL>",
    "my number is +44 7700 900 321": "<PHONE>",
    "hut line +43 512 555 0199": "<PHONE>",
    "or 0041-44-6681800": "<PHONE>",
    "text 677900411": "<PHONE>",
    "https://stay.example/booking/ZX98YW76VU54 is yours": "<BOOKING_URL>",
    "Paid: https://pay.example/receipts/qrsTUV778899": "<BOOKING_URL>",
    "send to FR7630006000011234567890189 today": "<IBAN>",
    "NL91ABNA0417164300 is the club's": "<IBAN>",
    "card 4000 0566 5566 5556 was used": "<CARD>",
    "second card 5200-8282-8282-8210": "<CARD>",
    "third card 371449635398431 failed": "<CARD>",
    "seen on 2025-11-02 from 172.16.40.21": "<PHONE>",
}
UNCHANGED = [
    "ask @lakehut",
    "Two nights in 2025 are 90 euros each.",
    "Map: https://lake.example/paths/north",
    "Room code LAKE2025NORTH is free.",
    "Ticket NORTH-2025-C3D4 (returned).",
    "",
    " ",
    "\t\n\n",
]


def test_markers(spark):
    got = clean(spark, *MARKED)
    for text, result, marker in zip(MARKED, got, MARKED.values()):
        assert marker in result, (text, result)


def test_unchanged(spark):
    assert clean(spark, *UNCHANGED) == UNCHANGED


def test_failed_luhn_is_no_card(spark):
    assert "<CARD>" not in clean(spark, "slip 4000056655665557 y")[0]


def test_booking_url_swallows_address(spark):
    got = clean(spark, "see https://x.example/b?ref=AB12CD34EF56&mail=a@b.com end")[0]
    assert got == "see <BOOKING_URL> end"


def python_sanitize(text):
    """The same passes with Python's own regular expressions."""

    def rule(pattern):
        flags = re.IGNORECASE if pattern.startswith("(?iU)") else 0
        return re.compile(re.sub(r"^\(\?i?U\)", "", pattern), flags)

    def luhn(match):
        digits = re.sub("[ -]", "", match.group())
        total = 0
        for i, d in enumerate(reversed(digits)):
            total += int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10))
        return "<CARD>" if total % 10 == 0 else match.group()

    if not text.strip():
        return text
    text = rule(fixed.BOOKING_URL_PATTERN).sub("<BOOKING_URL>", text)
    text = rule(fixed.EMAIL_PATTERN).sub("<EMAIL>", text)
    text = rule(fixed.IBAN_PATTERN).sub("<IBAN>", text)
    text = rule(fixed.CARD_PATTERN).sub(luhn, text)
    return rule(fixed.PHONE_PATTERN).sub("<PHONE>", text)


def test_random_texts_match_python(spark):
    rng = random.Random(3)
    bits = [
        "4242424242424242", "4242 4242 4242 4242", "1234-5678", "(771) 555-1655", "+51 ",
        "10.0.0.1", "a@b.co", "é", "x", " ", "\n", " ", "-", ".", "IT60X0542811101000000123456",
        "https://x.y/", "AB12CD34EF56", "/", "http://a", "DE89", "<", "_", "7", "99", "0", ",",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for text, got in zip(texts, clean(spark, *texts)):
        assert got == python_sanitize(text), repr(text)


def test_documents_match_python(spark, sf_dir):
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert clean(spark, *docs) == [python_sanitize(t) for t in docs]


def listed(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "pos int, phrase string")


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "i int, text string")


def redacted(spark, values, names, **kw):
    out = phrases.redact_phrases(texts(spark, *values), listed(spark, names), **kw)
    return [r.text for r in out.orderBy("i").collect()]


def test_longer_phrase_first(spark):
    got = redacted(spark, ["Dear Noa Prats, greet NOA."], ["Noa", "Noa Prats"], style="marker")
    assert got == ["Dear <NAME>, greet <NAME>."]


def test_special_characters_are_literal(spark):
    got = redacted(spark, [r"a.b c$d x\Ey a+b"], ["a.b", "c$d", r"x\Ey"], style="numbered")
    assert got == ["Cliente 1 Cliente 2 Cliente 3 a+b"]


def test_replacement_is_literal(spark):
    got = phrases.replace_phrases(texts(spark, "say X", None), [("x", r"$1 \2"), (" ", "-")])
    assert [r.text for r in got.orderBy("i").collect()] == [r"say $1 \2", None]


def test_stand_ins(spark):
    names = [" Ann ", "Bob", "", None, "Ann", "Cid"]
    rows = phrases.stand_ins(listed(spark, names)).orderBy("place").collect()
    assert [(r.phrase, r.replacement) for r in rows] == list(
        zip(["Ann", "Bob", "Cid"], fixed.STAND_IN_POOL)
    )
    many = phrases.stand_ins(listed(spark, [f"n{i:02d}" for i in range(20)])).orderBy("place")
    assert many.collect()[16].replacement == fixed.STAND_IN_POOL[0]


def one_after_the_other(text, pairs):
    """The rule itself: the whole list, in order, on folded copies of the text."""
    def fold(t):
        return "".join(c.upper().lower() if len(c.upper().lower()) == 1 else c for c in t)

    for phrase, other in pairs:
        low, key, out, at = fold(text), fold(phrase), "", 0
        while (found := low.find(key, at)) >= 0:
            out += text[at:found] + other
            at = found + len(key)
        text = out + text[at:]
    return text


def test_automaton_is_the_sequential_rule():
    rng = random.Random(5)
    for _ in range(400):
        letters = rng.choice(["ab", "abC", "aAé ", "ab\u212ak"])
        size = rng.choice([1, 2, 3, 4])
        made = [
            ("".join(rng.choices(letters, k=rng.randint(1, size))),
             "".join(rng.choices(letters, k=rng.randint(0, 4)))) for _ in range(rng.randint(1, 12))
        ]
        pairs = sorted(((p, r) for p, r in made if p.strip()), key=lambda pair: -len(pair[0]))
        if not pairs:
            continue
        rules = phrases.PhraseRules(pairs)
        for _ in range(5):
            text = "".join(rng.choices(letters, k=rng.randint(0, 30)))
            assert rules.replace(text) == one_after_the_other(text, pairs), (text, pairs)


def test_texts_are_searched_once_however_long_the_list():
    class Counting(phrases.PhraseRules):
        scanned = 0

        def folded(self, text):
            Counting.scanned += len(text)
            return super().folded(text)

    text = "nothing of it " * 500
    for n in (10, 20_000):
        rules = Counting([(f"name{i:05d}", f"other {i}") for i in range(n)])
        Counting.scanned = 0
        assert rules.replace(text) == text and Counting.scanned == len(text)


@pytest.mark.parametrize("block", [1, 3, 5_000])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, block):
    names = ["Ana Maria", "ana", "Rosa", "o'brien", "maria", "José Ñu", "Kim", "Cliente", "iente"]
    values = ["ANA MARIA met Ana and O'Brien, Rosa; maria", "none", "", "JOSÉ ñU, \u212aim", "roſa KIM"]
    pairs = sorted(
        ((n, f"Cliente {i}") for i, n in enumerate(names, 1)), key=lambda pair: -len(pair[0])
    )
    monkeypatch.setattr(phrases, "PHRASE_BLOCK", block)
    got = redacted(spark, values, names, style="numbered")
    assert got == [one_after_the_other(v, pairs) for v in values]


def test_whole_redaction(spark):
    df = texts(spark, "Ask rita@posta.example,\u00a0thanks Ines Koch.\r\n\r\n\r\n\r\nEnd")
    out = phrases.redact_documents(df, listed(spark, ["Ines Koch"]), style="marker")
    assert out.first().text == "Ask <EMAIL>, thanks <NAME>.\n\nEnd\n"


def test_output_names(spark):
    df = spark.createDataFrame([("/a/b/thread.txt",), ("x",), (".hidden",), ("a.tar.gz",)], "p string")
    got = [r[0] for r in df.select(phrases.redacted_name(F.col("p"))).collect()]
    assert got == ["/a/b/thread.redacted.txt", "x.redacted", ".hidden.redacted", "a.tar.redacted.gz"]


def test_phrase_list_is_numbered_once(spark, monkeypatch):
    """Blocks are read from one stored list, and names by the hundred thousand are one block."""
    assert phrases.PHRASE_BLOCK >= 150_000
    monkeypatch.setattr(phrases, "PHRASE_BLOCK", 3)
    listed = spark.createDataFrame([(i, f"Name{i:02d}") for i in range(8)], "pos long, phrase string")
    made = []
    keep = phrases.materialize
    monkeypatch.setattr(phrases, "materialize", lambda df, label, *a: made.append(label) or keep(df, label, *a))
    texts = spark.createDataFrame([("name07 and NAME00",)], "text string")
    got = phrases.redact_phrases(texts, listed, style="numbered").first().text
    assert got == f"{phrases.fixed.NUMBERED_STAND_IN}8 and {phrases.fixed.NUMBERED_STAND_IN}1"
    assert made == ["phrases", "redacted", "redacted"]
