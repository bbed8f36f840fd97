"""Files written one per row and read back; pages as text."""

import os

import pytest
from pyspark.sql import functions as F

from mailweave.operators import phrases
from mailweave.sources import extract, files, listing
from mailweave.sources.html import HTML_MIME, html_text


def below(folder):
    found = {}
    for top, _, names in os.walk(folder):
        for name in names:
            if not name.endswith(".crc"):
                path = os.path.join(top, name)
                found[os.path.relpath(path, folder)] = open(path, "rb").read()
    return found


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, "name string, content string")


def test_one_file_per_row(spark, tmp_path):
    df = rows(spark, ("a/x.txt", "one\n"), ("b/x.txt", "é"), ("c.txt", ""), ("d.txt", None)).repartition(3)
    done = files.write_files(df, str(tmp_path))
    assert {(r.name, r.n_bytes) for r in done.collect()} == {("a/x.txt", 4), ("b/x.txt", 2), ("c.txt", 0), ("d.txt", 0)}
    assert below(tmp_path) == {"a/x.txt": b"one\n", "b/x.txt": "é".encode(), "c.txt": b"", "d.txt": b""}
    files.write_files(rows(spark, ("c.txt", "new")), str(tmp_path))
    assert below(tmp_path)["c.txt"] == b"new" and len(below(tmp_path)) == 4


@pytest.mark.parametrize("name", [None, "", "../x", "a//b", "/x", "a/./b"])
def test_names_stay_below_the_folder(spark, tmp_path, name):
    with pytest.raises(ValueError, match="below the folder"):
        files.write_files(rows(spark, (name, "x")), str(tmp_path))


def test_two_rows_for_one_file_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="several rows"):
        files.write_files(rows(spark, ("x", "1"), ("x", "2")), str(tmp_path))
    assert below(tmp_path) == {}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = F.when(F.col("name") == "x7", F.raise_error(F.lit("no"))).otherwise(F.col("content"))
    df = rows(spark, *[(f"x{i}", "text") for i in range(20)]).repartition(4)
    with pytest.raises(Exception, match="no"):
        files.write_files(df.withColumn("content", bad.cast("string")), str(tmp_path))
    assert below(tmp_path) == {} and os.listdir(tmp_path) == []


def test_attempts_that_run_again_add_nothing(spark, tmp_path):
    """Staged twice, as by a lost executor, and published twice: each file is there once."""
    df = rows(spark, ("a", "1"), ("b", "2"))
    keep, files.materialize = files.materialize, lambda d, label: (d.count(), keep(d, label))[1]
    try:
        files.write_files(df, str(tmp_path))
    finally:
        files.materialize = keep
    assert below(tmp_path) == {"a": b"1", "b": b"2"} and sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_redacted_files_of_one_name_survive(spark, tmp_path):
    df = spark.createDataFrame(
        [("in/a/mail.txt", "Ask rita@posta.example"), ("in/b/mail.txt", "Ask Ines Koch"), ("in/b/note", "")],
        "path string, text string",
    )
    names = spark.createDataFrame([(0, "Ines Koch")], "pos int, phrase string")
    phrases.redact_files(df, str(tmp_path), names, style="marker")
    assert below(tmp_path) == {
        "in/a/mail.redacted.txt": b"Ask <EMAIL>\n", "in/b/mail.redacted.txt": b"Ask <NAME>\n",
        "in/b/note.redacted": b"",
    }


def test_relative_folders_are_listed_like_absolute_ones(spark, tmp_path, monkeypatch):
    (tmp_path / "x" / "y" / "x").mkdir(parents=True)
    (tmp_path / "x" / "y" / "x" / "f.html").write_text("<p>hi")
    got = listing.read_folder(spark, f"file:{tmp_path}/x/y/x").first()
    assert (got.path, got.mime_type) == ("x / f.html", HTML_MIME)


def test_pages_become_text(spark):
    page = (
        "<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x:1}</style>"
        "<script>var t='</p>';</script></head><body><!-- no --><p>one <b>two</b>\n three<br>four&nbsp;five"
        "<ul><li>x<li>y</ul><noscript>hidden</noscript><p>caf&eacute; &#x263A; a &lt; b</body>"
    )
    want = "A & B\none two\nthree\nfour five\nx\ny\ncafé ☺ a < b"
    assert html_text(page.encode()) == want
    assert html_text(b"") == "" and html_text("<p>\xff".encode("latin-1")) == "�"
    df = spark.createDataFrame(
        [("a", HTML_MIME, bytearray(page.encode())), ("b", HTML_MIME, bytearray(b"\0<p>x")),
         ("c", HTML_MIME, None), ("d", "image/png", bytearray(b"x"))],
        "name string, mime_type string, content binary",
    )
    got = {r.name: (r.text, r.extract_error) for r in extract.extract_text(df, {HTML_MIME: html_text}).collect()}
    assert got["a"] == (want, None) and got["b"] == (None, "ValueError: not a text file")
    assert got["c"] == (None, None) and got["d"][1] == "Unsupported MIME type: image/png"


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    """A folder of many small files is not one task for every few of them."""
    for i in range(1200):
        (tmp_path / f"{i}.txt").write_text(str(i))
    put = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = listing.read_folder(spark, str(tmp_path))
        most = listing.READ_WAVES * spark.sparkContext.defaultParallelism
        assert 1 < found.rdd.getNumPartitions() <= most < 1200
        assert {int(r.content) for r in found.select("content").collect()} == set(range(1200))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", put)


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver holds a table of the files, not the files, and the rows are those of Spark's reader."""
    top = tmp_path / "my docs"
    kinds = ["a.txt", "b%20.md", "é #1.HTML", "_hidden.txt", ".hidden", "_k=v.txt", "x._COPYING_", "noend", "_metadata"]
    for below in ["", "deep/er", "_metadata_x/m", "_skipped/x", ".git", "k=1", "empty"]:
        (top / below).mkdir(parents=True, exist_ok=True)
        for kind in kinds if below != "empty" else []:
            (top / below / kind).write_bytes(f"{below} {kind}\xff".encode("latin-1", "replace"))
    (top / "deep" / "none.pdf").write_bytes(b"")
    (top / "deep" / "large.bin").write_bytes(bytes(300_000))
    assert not [p for p in listing.read_folder(spark, str(top)).inputFiles() if "my" in p]
    monkeypatch.setattr(listing, "_READ_BYTES", 100_000)
    found = listing.read_folder(spark, str(top))
    assert found.select("file_id").where("file_id like '%large.bin'").count() == 1
    flat = listing.read_folder(spark, str(top / "deep"), recursive=False)
    assert [r.name for r in flat.collect()] == ["large.bin"]
    keyed = listing.read_folder(spark, f"file:{top}/k=1/")
    given = [sorted(map(tuple, df.collect())) for df in (found, flat, keyed)]
    monkeypatch.setattr(listing, "_opener", lambda uri: None)
    known = [listing.read_folder(spark, str(top)), listing.read_folder(spark, str(top / "deep"), recursive=False)]
    known.append(listing.read_folder(spark, f"file:{top}/k=1/"))
    assert [df.schema for df in known] == [df.schema for df in (found, flat, keyed)]
    assert given == [sorted(map(tuple, df.collect())) for df in known] and len(given[0]) == 21
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        listing.read_folder(spark, str(tmp_path / "missing"))
