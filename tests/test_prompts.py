import pytest
from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.operators import classify, prompts

HITS = "query_id string, rank int, source_path string, text string"
POOL = "title string, text string, source_id string"


def test_reference_block(spark):
    hits = spark.createDataFrame([("q", 2, "p2", "two"), ("q", 1, "p1", "one")], HITS)
    assert prompts.reference_blocks(hits).first().reference_block == (
        "--- REFERENCE MATERIAL ---\n\nSource: p1\none\n\nSource: p2\ntwo\n\n"
        "--- END REFERENCE MATERIAL ---"
    )
    assert prompts.reference_blocks(hits.limit(0)).count() == 0


def pool(spark):
    return spark.createDataFrame([("beta", "B", "2"), ("Alpha", "A", "1")], POOL)


def test_example_block(spark):
    parts = prompts.example_parts(pool(spark))
    assert [r.part_no for r in parts.orderBy("part_no").collect()] == [0, 1, 2, 3]
    block = prompts.block_text(parts)
    assert block.startswith(fixed.EXAMPLES_HEADER + "\n\n--- EXAMPLE RESPONSES ---\n\n")
    assert "Example 1 — Alpha\nA\n\nExample 2 — beta\nB\n\n--- END" in block
    empty = prompts.example_parts(pool(spark).limit(0))
    assert empty.count() == 0 and prompts.block_text(empty) == ""
    with pytest.raises(prompts.PoolTooLargeError):
        prompts.block_text(parts, max_chars=5)


def prompt(spark, turn, hits, parts, named="pool"):
    rows = spark.createDataFrame([("t", "es", turn, "THREAD")], "thread_id string, language string, turn string, transcript string")
    table = prompts.prompt_table(rows, prompts.reference_blocks(hits), named)
    return prompts.send_prompts(table, lambda text: text, parts).first().reply


def test_prompt(spark):
    hits = spark.createDataFrame([("t", 1, "p", "facts")], HITS)
    parts = prompts.example_parts(pool(spark))
    full = prompt(spark, " when? ", hits, parts)
    assert full.startswith("LANGUAGE REQUIREMENT: Write your entire reply in Spanish. ")
    assert full.endswith(":\nTHREAD\n\nYOUR REPLY (in Spanish):")
    assert "(primary task):\nwhen?\n\nUSE OF REFERENCE MATERIAL" in full
    assert full.index("REFERENCE MATERIAL ---") < full.index("--- EXAMPLE") < full.index("CLIENT EMAIL")
    assert "--- END EXAMPLE RESPONSES ---\n\nCLIENT EMAIL" in full
    # Without a reference block there are no examples either.
    bare = prompt(spark, "  ", hits.limit(0), parts)
    assert "REFERENCE MATERIAL" not in bare and "EXAMPLE" not in bare
    assert "(primary task):\nTHREAD\n\nCLIENT" in bare
    without = prompt(spark, "x", hits, parts, None)
    assert "EXAMPLE" not in without
    assert prompt(spark, "x", hits, None) == without
    assert prompt(spark, "x", hits, prompts.example_parts(pool(spark).limit(0))) == without


def test_prompts_hold_no_pool(spark):
    """The table names the pool; its plan reads nothing of it."""
    hits = spark.createDataFrame([("t", 1, "p", "facts"), ("u", 1, "p", "facts")], HITS)
    rows = spark.createDataFrame([(i, "it", "x", "y") for i in "tuv"], "thread_id string, language string, turn string, transcript string")
    table = prompts.prompt_table(rows, prompts.reference_blocks(hits), "pool", "sys")
    got = {r.thread_id: r for r in table.collect()}
    assert [got[i].examples for i in "tuv"] == ["pool", "pool", None]
    assert all(r.system == "sys" and "EXAMPLE" not in r.opening + r.closing for r in got.values())


def test_failed_sends_are_rows(spark):
    rows = spark.createDataFrame([(1, "en", "boom", "y"), (2, "en", "fine", "y"), (3, "en", "none", "y")], "thread_id long, language string, turn string, transcript string")
    table = prompts.prompt_table(rows, prompts.reference_blocks(spark.createDataFrame([], HITS).withColumn("query_id", F.lit(0))))

    def answer(text):
        if "boom" in text:
            raise RuntimeError("busy")
        return None if "none" in text else "ok"

    got = {r.thread_id: (r.reply, r.error) for r in prompts.send_prompts(table, answer).collect()}
    assert got == {1: (None, "RuntimeError: busy"), 2: ("ok", None), 3: (None, "TypeError: answer is NoneType, not str")}


def test_classifiers(spark):
    df = spark.createDataFrame([(0, "vorrei una guida, grazie"), (1, "los viajes para el norte"), (2, "?")], "i int, t string")
    got = classify.detect_language(df, "t").orderBy("i").collect()
    assert [r.language for r in got] == ["it", "es", "en"]
    topic = classify.classify_topic(df.withColumn("s", F.lit("Cusco")), "s", "t").collect()
    assert all(r.related for r in topic)

    def fail_on_one(body):
        if "viajes" in body:
            raise RuntimeError("busy")
        return "it."

    rows = classify.detect_language(df, "t", classify.batch_classifier(fail_on_one)).orderBy("i").collect()
    assert [(r.language, r.error) for r in rows] == [("it", None), (None, "RuntimeError: busy"), ("it", None)]


def test_model_questions(spark):
    df = spark.createDataFrame([("Hi {subject}", "x" * 9000)], "s string, b string")
    row = df.select(classify.topic_prompt(F.col("s"), F.col("b")), classify.language_prompt(F.col("b"))).first()
    assert "Subject: Hi {subject}\n\nBody:\n" + "x" * 8000 == row[0][row[0].index("Subject"):]
    assert row[1].startswith("Detect the language") and fixed.LANGUAGE_SAMPLE_BANNER in row[1]


def test_whole_prompts_hold_the_pool(spark):
    """Each prompt below a reference block has all examples, none is left as a name; as sent."""
    hits = spark.createDataFrame([("t", 1, "p", "facts"), ("u", 1, "p", "facts")], HITS)
    rows = spark.createDataFrame([(i, "it", "x", "y") for i in "tuv"], "thread_id string, language string, turn string, transcript string")
    parts = prompts.example_parts(pool(spark))
    table = prompts.prompt_table(rows, prompts.reference_blocks(hits), "pool", "sys")
    whole = prompts.whole_prompts(table, parts)
    assert whole.columns == ["thread_id", "system", "prompt"]
    got = {r.thread_id: r.prompt for r in whole.collect()}
    assert got == {r.thread_id: r.reply for r in prompts.send_prompts(table, lambda text: text, parts).collect()}
    assert ["Example 1 — Alpha\nA\n\nExample 2 — beta\nB" in got[i] for i in "tuv"] == [True, True, False]
    bare = {r.thread_id: r.prompt for r in prompts.whole_prompts(table).collect()}
    assert not any("EXAMPLE" in p for p in bare.values()) and bare["v"] == got["v"]


def test_prompt_queries_return_whole_prompts(spark, sf_dir):
    from mailweave.plans import retrieval

    asked = retrieval.prompts_from_threads(spark, sf_dir).collect()
    titles = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    assert asked and all(f"Example {titles} — " in r.prompt for r in asked)
