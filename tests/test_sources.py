import pytest
from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.operators import health
from mailweave.operators.exemplars import exemplar_pool, in_title_order
from mailweave.sources import extract, index_store, listing, state

NODE = "id string, parent_id string, name string, mime_type string, modified_time string"
FOLDER = fixed.FOLDER_MIME
FILES = "file_id string, name string, mime_type string, path string, modified_time string, content binary"


def nodes(spark):
    return spark.createDataFrame(
        [
            ("root", None, "RootFolder", FOLDER, None),
            ("sub", "root", "Subfolder", FOLDER, None),
            ("deep", "sub", "Deep", FOLDER, None),
            ("f1", "root", "a.pdf", "application/pdf", "2026"),
            ("f2", "sub", "notes.md", "text/markdown", None),
            ("f3", "sub", "pic.png", "image/png", None),
            ("f4", "deep", "x.txt", "text/plain", None),
            ("f5", "elsewhere", "y.txt", "text/plain", None),
        ],
        NODE,
    )


def roots(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "folder_id string")


def paths(df):
    return sorted(r.path for r in df.collect())


def test_listing(spark):
    got = listing.list_files(nodes(spark), roots(spark, "root"), include_mime_types=fixed.INCLUDE_MIME_TYPES)
    assert paths(got) == [
        "RootFolder / Subfolder / Deep / x.txt",
        "RootFolder / Subfolder / notes.md",
        "RootFolder / a.pdf",
    ]
    assert {r.modified_time for r in got.collect()} == {"2026", ""}
    assert len(paths(listing.list_files(nodes(spark), roots(spark, "root")))) == 4
    flat = listing.list_files(nodes(spark), roots(spark, "root"), recursive=False)
    assert paths(flat) == ["RootFolder / a.pdf"]


def test_unknown_root_keeps_its_id_and_overlap_lists_twice(spark):
    assert paths(listing.list_files(nodes(spark), roots(spark, "elsewhere"))) == ["elsewhere / y.txt"]
    got = listing.list_files(nodes(spark), roots(spark, "root", "sub"))
    assert paths(got).count("Subfolder / notes.md") == 1
    assert sum(p.endswith("notes.md") for p in paths(got)) == 2


def test_folder_loop_is_an_error(spark):
    loop = spark.createDataFrame([("a", "b", "A", FOLDER, None), ("b", "a", "B", FOLDER, None)], NODE)
    with pytest.raises(Exception, match="below itself"):
        listing.folder_paths(roots(spark, "a"), loop)


def test_deep_folders(spark):
    chain = [(f"n{i}", f"n{i + 1}", f"f{i}", FOLDER, None) for i in range(12)]
    tree = spark.createDataFrame(chain, NODE)
    got = listing.folder_paths(roots(spark, "n12"), tree).collect()
    assert {r.folder_id for r in got} == {f"n{i}" for i in range(13)}


def test_read_folder(spark, tmp_path):
    (tmp_path / "corpus" / "sub").mkdir(parents=True)
    (tmp_path / "corpus" / "a.txt").write_bytes(b"  hi \xff there\n")
    (tmp_path / "corpus" / "sub" / "b.md").write_text("# b")
    (tmp_path / "corpus" / "sub" / "c.bin").write_bytes(b"\x00")
    files = listing.read_folder(spark, str(tmp_path / "corpus"))
    got = {r.name: r for r in extract.extract_text(files).collect()}
    assert got["a.txt"].text == "hi � there" and got["a.txt"].path == "corpus / a.txt"
    assert got["b.md"].path == "corpus / sub / b.md"
    assert got["c.bin"].extract_error == "Unsupported MIME type: application/octet-stream"
    counts = extract.ingest_counts(extract.extract_text(files)).first()
    assert tuple(counts) == (3, 2, 1)


def test_name_list(spark, tmp_path):
    path = tmp_path / "names.txt"
    path.write_bytes("﻿Ana Ruiz\n\n # note\n#x\n  Bob \r\nCid".encode())
    rows = listing.read_name_list(spark, str(path)).orderBy("pos").collect()
    assert [r.phrase for r in rows] == ["Ana Ruiz", "Bob", "Cid"]


def files(spark, *rows):
    full = [(str(i), f"{n}", m, f"root / {n}", "", c) for i, (n, m, c) in enumerate(rows)]
    return spark.createDataFrame(full, FILES)


def test_extractor_plug_in(spark):
    def upper(data: bytes) -> str:
        if not data:
            raise ValueError("no data")
        return data.decode().upper()

    df = files(spark, ("a", "x/up", b"abc "), ("b", "x/up", b""), ("c", "text/plain", b"t"), ("d", "x/no", b"z"))
    got = {r.name: (r.text, r.extract_error) for r in extract.extract_text(df, {"x/up": upper}).collect()}
    assert got == {
        "a": ("ABC", None),
        "b": (None, "ValueError: no data"),
        "c": ("t", None),
        "d": (None, "Unsupported MIME type: x/no"),
    }


def test_ingest_skips_and_continues(spark):
    df = files(spark, ("a", "text/plain", b"one\n\ntwo"), ("b", "image/png", b"x"), ("c", "text/plain", b" \n"))
    extracted = extract.extract_text(df)
    assert sorted(r.reason for r in extract.skipped(extracted).collect()) == [
        "Unsupported MIME type: image/png", "empty text",
    ]
    chunks = extract.chunk_files(extracted).collect()
    assert [(r.source_name, r.source_path, r.text) for r in chunks] == [("a", "root / a", "one\n\ntwo")]


def test_exemplar_pool(spark):
    df = files(spark, ("beta", "text/plain", b"mail a@b.com"), ("Alpha", "text/plain", b"hi"), ("x", "text/plain", b" "), ("y", "image/png", b"p"))
    rows = in_title_order(exemplar_pool(df)).collect()
    assert [(r.title, r.text) for r in rows] == [("Alpha", "hi"), ("beta", "mail <EMAIL>")]
    assert exemplar_pool(df.limit(0)).count() == 0


CHUNKS = "source_id string, source_name string, source_path string, chunk_index int, text string, embedding array<float>"


def chunk_rows(spark, n, vector=(3.0, 4.0)):
    rows = [(f"s{i}", f"n{i}", f"p{i % 2}", 0, f"t{i}", None if vector is None else list(vector)) for i in range(n)]
    return spark.createDataFrame(rows, CHUNKS)


def test_index_round_trip_and_replace(spark, tmp_path):
    base = str(tmp_path / "kb")
    assert index_store.current_version(spark, base) is None
    with pytest.raises(index_store.IndexUnusableError):
        index_store.load_index(spark, base)
    index_store.write_index(chunk_rows(spark, 3), base, embedding_model="m/1", source_file_count=3)
    index_store.write_index(chunk_rows(spark, 2), base, embedding_model="m/2", source_file_count=2)
    meta, chunks = index_store.load_index(spark, base)
    assert (meta.embedding_model, meta.dimension, meta.chunk_count, meta.source_file_count) == ("m/2", 2, 2, 2)
    rows = chunks.orderBy("source_id").collect()
    assert [r.source_id for r in rows] == ["s0", "s1"]
    assert rows[0].unit_embedding == pytest.approx([0.6, 0.8])


def test_gate_keeps_the_old_version(spark, tmp_path):
    base = str(tmp_path / "kb")
    index_store.write_index(chunk_rows(spark, 3), base, embedding_model="m", source_file_count=3)
    bad = [
        (chunk_rows(spark, 0), 3),
        (chunk_rows(spark, 3), 0),
        (chunk_rows(spark, 3, None), 3),
        (chunk_rows(spark, 3, ()), 3),
        (chunk_rows(spark, 2).union(chunk_rows(spark, 1, None)), 3),
        (chunk_rows(spark, 2).union(chunk_rows(spark, 1, (1.0,))), 3),
    ]
    for chunks, sources in bad:
        with pytest.raises(index_store.IndexUnusableError):
            index_store.write_index(chunks, base, embedding_model="m", source_file_count=sources)
    assert index_store.load_index(spark, base)[1].count() == 3


def test_model_guard(spark, tmp_path):
    base = str(tmp_path / "kb")
    index_store.write_index(chunk_rows(spark, 1), base, embedding_model="m/1", source_file_count=1)
    assert index_store.open_index(spark, base, "m/1").count() == 1
    with pytest.raises(index_store.IndexUnusableError, match="built with"):
        index_store.open_index(spark, base, "m/2")
    index_store.write_index(chunk_rows(spark, 1), base, embedding_model="", source_file_count=1)
    assert index_store.open_index(spark, base, "m/2").count() == 1


def test_health(spark):
    chunks = chunk_rows(spark, 3)
    ok = health.health_report(spark, chunks, "m", "m").first()
    assert ok.healthy and ok.issues == [] and ok.chunk_count == 3 and ok.dimension == 2
    cases = [
        health.health_report(spark, None, None, "m", available=False),
        health.health_report(spark, None, None, "m"),
        health.health_report(spark, chunks, "m", "other"),
        health.health_report(spark, chunks.limit(0), "m", "m"),
    ]
    for report in cases:
        row = report.first()
        assert not row.healthy and len(row.issues) == 1
    # A version without a model name is not healthy, but not reported either.
    row = health.health_report(spark, chunks, "", "m").first()
    assert not row.healthy and row.issues == []


def test_top_sources(spark):
    rows = [(r.source_path, r.chunk_count) for r in health.source_stats(chunk_rows(spark, 5)).collect()]
    assert rows == [("p0", 3), ("p1", 2)]
    top = health.top_sources(chunk_rows(spark, 5), 1).collect()
    assert [tuple(r) for r in top] == [("p0", 3, 1)]
    assert health.top_sources(chunk_rows(spark, 5)).first().more_sources == 0


def test_ingest_age(spark):
    from datetime import datetime

    now = datetime(2026, 3, 5, 12, 0)
    cases = {
        "2026-03-05T11:30:00+00:00": "<1h ago",
        "2026-03-05T07:00:00": "5h ago",
        "2026-03-03T09:00:00+00:00": "2d 3h ago",
        "2026-03-05T13:00:00": "<1h ago",
        "": "",
        "nonsense": "",
        None: "",
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(health.ingest_age(F.col("t"), now)).collect()]
    assert got == list(cases.values())


def test_state_log(spark, tmp_path):
    from datetime import datetime

    path = str(tmp_path / "state")
    assert state.read_state(spark, path).count() == 0

    def batch(batch_id, *rows):
        df = spark.createDataFrame(list(rows), state.STATE_SCHEMA)
        state.append_outcomes(df, path, batch_id)

    batch(0, ("a", "non_travel", datetime(2026, 1, 1)), ("b", None, datetime(2026, 1, 1)))
    batch(1, ("a", "drafted", datetime(2026, 1, 2)))
    batch(1, ("a", "drafted", datetime(2026, 1, 2)))
    # A file from before outcomes were stored.
    spark.createDataFrame([("old", datetime(2025, 1, 1))], "message_id string, processed_at timestamp").write.parquet(f"{path}/log/batch=old")
    got = {r.message_id: r.outcome for r in state.read_state(spark, path).collect()}
    assert got == {"a": "drafted", "b": "drafted", "old": "drafted"}
    for waiting in (True, False):
        assert state.compact(spark, path) is waiting
        assert {r.message_id: r.outcome for r in state.read_state(spark, path).collect()} == got
