"""Cases that earlier versions got wrong."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mailweave import session
from mailweave.functions import mail, tidy
from mailweave.operators import retrieval
from mailweave.plans import conversations
from mailweave.sources import listing, state


def test_quoted_names_and_comments_are_no_address(spark):
    headers = ['"<fake@agency.example>" <guest@other.example>', "desk@agency.example (Desk)", "Desk <desk@agency.example>"]
    df = spark.createDataFrame([(h,) for h in headers], "h string")
    assert [r[0] for r in df.select(mail.is_staff(F.col("h"), ["agency.example"])).collect()] == [False, True, True]


def test_parts_are_in_numeric_order(spark):
    part = "struct<path:string,mime_type:string,data:string>"
    parts = [("0.10", "text/plain", "bGF0ZXI="), ("0.2", "text/plain", "Zmlyc3Q=")]
    df = spark.createDataFrame([(parts,)], f"parts array<{part}>")
    assert df.select(mail.plain_body(F.col("parts"))).first()[0] == "first"


def test_spanish_mark_after_an_address_keeps_its_case(spark):
    lines = [f"Ana Ruiz <ana@mail.example> 23 {de} marzo de 2026 de Lima" for de in ("DE", "de")]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r[0] for r in df.select(tidy.is_message_header(F.col("line"))).collect()] == [False, True]


def test_paths_below_a_folder_of_the_same_name(spark, tmp_path):
    for sub in ("x", "y"):
        (tmp_path / "docs" / sub / "docs").mkdir(parents=True)
        (tmp_path / "docs" / sub / "docs" / "a.txt").write_text("text")
    found = listing.read_folder(spark, str(tmp_path / "docs"))
    assert sorted(r.path for r in found.collect()) == ["docs / x / docs / a.txt", "docs / y / docs / a.txt"]


def test_only_a_missing_log_is_empty(spark, tmp_path):
    assert state.read_state(spark, str(tmp_path / "none")).count() == 0
    batch = tmp_path / "log" / "batch=0"
    batch.mkdir(parents=True)
    (batch / "_SUCCESS").write_text("")
    (batch / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="not a Parquet file"):
        state.read_state(spark, str(tmp_path)).count()


def test_wrong_query_length_is_refused(spark):
    chunks = spark.createDataFrame(
        [("s", 0, [1.0, 0.0]), ("t", 0, [])], "source_id string, chunk_index int, unit_embedding array<double>"
    )
    assert retrieval.top_k(chunks, [1.0, 0.0], 1).first().score == 1.0
    with pytest.raises(PySparkException):
        retrieval.top_k(chunks, [1.0, 0.0, 0.0], 1).collect()


def test_shared_folder_is_the_configured_one(spark):
    folder = session.shared_dir(spark)
    assert folder == session.shared_dir(spark) and spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("as_folder", [False, True])
def test_conversations_stream_from_a_file_or_a_folder(spark, sf_dir, tmp_path, as_folder):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    if as_folder:
        table.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    else:
        (tmp_path / "conversations.parquet").symlink_to(f"{sf_dir}/conversations.parquet")
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    writer = conversations.arrivals(spark, str(tmp_path)).writeStream.option("checkpointLocation", progress)
    writer.trigger(availableNow=True).start(out).awaitTermination()
    asked = table.where("role = 'user'").count()
    assert spark.read.schema("message_id string").parquet(out).count() == asked > 0
