import random

from pyspark.sql import functions as F

from mailweave.operators.chunking import chunk_documents, chunk_sizes, chunk_texts


def chunks(spark, text, size=800, overlap=100):
    df = spark.createDataFrame([("s", "n", "p", text)], "source_id string, source_name string, source_path string, text string")
    rows = chunk_documents(df, size, overlap).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    return [r.text for r in rows]


def spec(text, size, overlap):
    """Plain statement of the packing rules."""
    import re

    limit, tail = chunk_sizes(size, overlap)
    pieces = []
    for p in re.split(r"\n\s*\n+", re.sub(r"\r\n?", "\n", text)):
        p = p.strip()
        if len(p) <= limit:
            pieces += [p] if p else []
            continue
        row = ""
        for w in p.split():
            if row and len(row) + 1 + len(w) > limit:
                pieces.append(row)
                row = w
            else:
                row = f"{row} {w}" if row else w
        pieces.append(row)
    out, buf = [], None
    for p in pieces:
        if buf is None:
            buf = p
        elif len(buf) + 2 + len(p) <= limit:
            buf += "\n\n" + p
        else:
            out.append(buf.strip())
            keep = buf[len(buf) - min(tail, len(buf)):] if tail else ""
            buf = keep + "\n\n" + p if keep else p
    return out + ([buf.strip()] if buf is not None else [])


def test_blank_gives_nothing(spark):
    assert chunks(spark, "") == [] and chunks(spark, "   \n\n   ") == []


def test_short_text_is_one_chunk(spark):
    assert chunks(spark, "Hello from Cusco.\n\nBook with us.") == [
        "Hello from Cusco.\n\nBook with us."
    ]


def test_paragraph_borders(spark):
    got = chunks(spark, "\n\n".join(["A" * 400] * 4), 200, 0)
    assert len(got) >= 2 and max(map(len, got)) <= 800


def test_overlap_repeats_tail(spark):
    body = "\n\n".join(f"paragraph {i} " + "x" * 300 for i in range(6))
    got = chunks(spark, body, 200, 40)
    assert len(got) > 1
    for before, after in zip(got, got[1:]):
        assert after.startswith(before[-160:].strip()[:50])


def test_oversized_paragraph(spark):
    got = chunks(spark, "word " * 2000, 200, 0)
    assert len(got) >= 3 and max(map(len, got)) <= 800


def test_long_word_stays_whole_and_overlap_may_exceed(spark):
    assert chunks(spark, "w" * 5000) == ["w" * 5000]
    got = chunks(spark, "a" * 3000 + "\n\n" + "b" * 3000)
    assert len(got[1]) == 400 + 2 + 3000


def test_random_texts_match_spec(spark):
    rng = random.Random(7)

    def text():
        bits = []
        for _ in range(rng.randint(0, 60)):
            bits.append("é" * rng.randint(1, rng.choice([3, 9, 60])))
            bits.append(rng.choice([" ", " ", "\n", "\n\n", "\r\n \r\n", " ", "\n\n\n"]))
        return "".join(bits)

    texts = [(i, text()) for i in range(300)]
    df = spark.createDataFrame(texts, "i int, t string")
    for size, overlap in ((10, 0), (10, 3), (25, 40), (1, 1)):
        got = df.select("i", chunk_texts(F.col("t"), size, overlap).alias("c")).collect()
        by_id = {r.i: r.c for r in got}
        for i, t in texts:
            assert by_id[i] == spec(t, size, overlap), (t, size, overlap)


def test_python_sees_few_rows_at_a_time(spark):
    """A long batch is cut up before Python objects are made of it, and comes out whole and in order."""
    import pyarrow as pa
    from mailweave.functions import batches
    from mailweave.operators import embedding

    array = pa.array([str(i) if i % 7 else None for i in range(1000)])
    parts = list(batches.slices([array, array.slice(0, 0)]))
    assert max(map(len, parts)) == batches.SLICE_ROWS and pa.concat_arrays(parts) == array
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "if(id % 7 = 0, null, repeat(concat('w', id, ' '), 40)) AS text")
    got = rows.select("id", chunk_texts(F.col("text"), 10, 0).alias("c")).collect()
    assert all((r.c is None) if r.id % 7 == 0 else set(" ".join(r.c).split()) == {f"w{r.id}"} for r in got)

    class Counting:
        name, batch_size = "counting", 5

        def embed(self, texts):
            return [[float(len(texts)), float(t[1:].split()[0])] for t in texts]

    made = embedding.embed_texts(rows.where("text is not null"), Counting()).collect()
    assert all(r.embedding[1] == r.id and r.embedding[0] <= 5 for r in made)
