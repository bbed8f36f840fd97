import numpy as np
import pytest
from pyspark.sql import functions as F

from mailweave.functions.vectors import unit
from mailweave.operators import embedding, retrieval
from mailweave.operators.chunking import chunk_documents


def index(spark, rows):
    df = spark.createDataFrame(rows, "source_id string, chunk_index int, text string, embedding array<float>")
    return df.withColumn("unit_embedding", unit(F.col("embedding"))).withColumns(
        {"source_name": F.lit("n"), "source_path": F.lit("p")}
    )


SMALL = [
    ("a", 0, "hello", [1.0, 0.0, 0.0]),
    ("b", 0, "world", [0.0, 1.0, 0.0]),
    ("c", 0, "cusco", [0.9, 0.1, 0.0]),
]


def test_top_k(spark):
    chunks = index(spark, SMALL)
    assert [r.text for r in retrieval.top_k(chunks, [1, 0, 0], 2).collect()] == ["hello", "cusco"]
    assert len(retrieval.top_k(chunks, [1, 0, 0], 9).collect()) == 3
    assert retrieval.top_k(chunks, [0, 0, 0], 2).collect() == []
    assert retrieval.top_k(chunks, [1, 0, 0], 0).collect() == []
    assert retrieval.top_k(index(spark, SMALL).limit(0), [1, 0, 0], 2).collect() == []


def test_zero_vector_scores_zero_and_ties_go_by_key(spark):
    rows = [("b", 1, "x", [0.0, 0.0]), ("a", 2, "y", [0.0, 1.0]), ("a", 1, "z", [0.0, 2.0])]
    got = retrieval.top_k(index(spark, rows), [1, 0], 3).collect()
    assert [(r.source_id, r.chunk_index, r.score) for r in got] == [("a", 1, 0), ("a", 2, 0), ("b", 1, 0)]


def brute(rows, queries, k):
    """All scores of all queries, sorted."""
    vecs = np.array([r[3] for r in rows], dtype=np.float64)
    norms = np.linalg.norm(vecs, axis=1)
    vecs = (vecs / np.where(norms == 0, 1, norms)[:, None]).astype(np.float32).astype(np.float64)
    out = {}
    for qid, q in queries:
        q = np.array(q, dtype=np.float64)
        size = np.linalg.norm(q)
        if size == 0:
            continue
        q = (q / size).astype(np.float32).astype(np.float64)
        scores = np.round(vecs @ q, retrieval.SCORE_PLACES)
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i][0], rows[i][1]))[:k]
        out[qid] = [(rows[i][0], rows[i][1]) for i in order]
    return out


@pytest.mark.parametrize("blocks", [{}, {"query_bytes": 8 * 8 * 6}])
@pytest.mark.parametrize("k", [1, 4, 1000])
def test_retrieve_matches_brute_force(spark, blocks, k):
    rng = np.random.default_rng(2)
    # A third of the rows are copies of one vector.
    vectors = [rng.integers(-3, 4, 6).tolist() if i % 3 else [1, 2, 0, 0, 1, 0] for i in range(300)]
    rows = [(f"s{i % 40:02d}", i, f"text {i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    queries = [(f"q{i}", [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(30)]
    queries += [("zero", [0.0] * 6), ("copy", [1.0, 2.0, 0.0, 0.0, 1.0, 0.0])]
    q = spark.createDataFrame(queries, "query_id string, vector array<float>")
    hits = retrieval.retrieve(index(spark, rows).repartition(5), q, k, **blocks).collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.query_id, h["rank"])):
        got.setdefault(h.query_id, []).append((h.source_id, h.chunk_index))
        assert h.text == f"text {h.chunk_index}" and h.source_path == "p"
    assert got == brute(rows, queries, k)


def test_small_steps_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"s{i}", 0, "", rng.normal(size=5).tolist()) for i in range(200)]
    queries = [(i, rng.normal(size=5).tolist()) for i in range(7)]
    q = spark.createDataFrame(queries, "query_id int, vector array<float>")
    best = retrieval._Best(np.array([v for _, v in queries]), 3)
    monkeypatch.setattr(retrieval, "_SCORE_CELLS", 70)
    assert best.step() == 10
    chunks = index(spark, rows)
    one = retrieval.retrieve(chunks, q, 3).orderBy("query_id", "rank").collect()
    two = retrieval.retrieve(chunks, q, 3, query_bytes=2 * 8 * 5).orderBy("query_id", "rank").collect()
    assert one == two and len(one) == 21


def test_wrong_vectors_and_repeated_ids_are_refused(spark):
    chunks = index(spark, SMALL)
    q = lambda rows: spark.createDataFrame(rows, "query_id string, vector array<float>")
    with pytest.raises(ValueError, match="distinct"):
        retrieval.retrieve(chunks, q([("q", [1.0, 0.0, 0.0]), ("q", [0.0, 1.0, 0.0])]))
    with pytest.raises(ValueError, match="dimensions"):
        retrieval.retrieve(chunks, q([("q", [1.0, 0.0, 0.0]), ("r", [0.0, 1.0])]))
    with pytest.raises(Exception, match="dimensions"):
        retrieval.retrieve(chunks, q([("q", [1.0, 0.0])]))


def test_listed_twice_is_found_twice(spark):
    chunks = index(spark, [SMALL[0], *SMALL])
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, vector array<float>")
    hits = retrieval.retrieve(chunks, q, 3).orderBy("rank").collect()
    assert [(h["rank"], h.text) for h in hits] == [(1, "hello"), (2, "hello"), (3, "cusco")]


def test_no_k_no_queries(spark):
    chunks = index(spark, SMALL)
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, vector array<float>")
    assert retrieval.retrieve(chunks, q, 0).count() == 0
    assert retrieval.retrieve(chunks, q.limit(0)).count() == 0
    assert retrieval.retrieve(chunks.limit(0), q).count() == 0


def test_embedding_is_deterministic_and_checked(spark):
    e = embedding.HashEmbedder(dim=32)
    assert (e.embed(["a b a"]) == e.embed(["A  b\na"])).all()
    assert not e.embed([""]).any()
    docs = spark.createDataFrame([("s", "n", "p", "x " * 5000)], "source_id string, source_name string, source_path string, text string")
    got = embedding.embed_texts(chunk_documents(docs), embedding.HashEmbedder(batch_size=2)).collect()
    assert len(got) > 3 and {len(r.embedding) for r in got} == {256}

    class Short(embedding.HashEmbedder):
        def embed(self, texts):
            return super().embed(texts)[:-1]

    class Empty(embedding.HashEmbedder):
        def embed(self, texts):
            return np.zeros((len(texts), 0))

    for broken in (Short(), Empty()):
        with pytest.raises(RuntimeError):
            embedding.checked_vectors(broken, ["a", "b"])
        with pytest.raises(Exception, match="vector"):
            embedding.embed_texts(docs, broken).collect()


def test_near_ties_are_decided_in_double_precision():
    """Scores that single precision cannot tell apart, copies, and rows before and after the floor is set."""
    rng = np.random.default_rng(7)
    queries = rng.normal(size=(9, 16))
    queries /= np.linalg.norm(queries, axis=1)[:, None]
    base = queries[rng.integers(0, 9, 300)] + rng.normal(size=(300, 16)) * 10.0 ** -rng.integers(3, 11, 300)[:, None]
    rows = np.concatenate([base, base[:40]])
    ids = np.array([f"s{i % 97:02d}" for i in range(340)], object)
    index = np.array([i // 97 for i in range(340)], object)
    best = retrieval._Best(queries, 4)
    assert best.rough_t.dtype == np.float32
    scored = 0
    for start in range(0, 340, 20):
        part = slice(start, start + 20)
        query, row, score = best.candidates(rows[part])
        scored += len(row)
        best.merge(query, score, [ids[part][row], index[part][row]])
    exact = np.round(np.einsum("ij,kj->ik", queries, rows), retrieval.SCORE_PLACES)
    want = [
        sorted((-exact[q, i], ids[i], index[i]) for i in range(340))[:4] for q in range(9)
    ]
    got = [(-s, *k) for s, *k in zip(best.score, *best.keys)]
    assert [got[4 * q : 4 * q + 4] for q in range(9)] == want
    assert scored < 9 * 340 // 4


def test_many_queries_are_scored_in_tiles(monkeypatch):
    """Blocks of chunks stay large however many queries there are, and tiles find what the whole finds."""
    assert retrieval._Best(np.ones((20_000, 2)), 4).step() >= 2_048
    rng = np.random.default_rng(9)
    queries, rows = rng.normal(size=(17, 6)), rng.integers(-2, 3, (240, 6)).astype(float)
    queries[3:6] = rows[:3] + 1e-9
    ids = np.array([f"s{i % 60:02d}" for i in range(240)], object)
    index = np.array([i // 60 for i in range(240)], object)

    def found():
        best = retrieval._Best(queries, 4)
        for start in range(0, 240, 50):
            part = slice(start, start + 50)
            query, row, score = best.candidates(rows[part])
            best.merge(query, score, [ids[part][row], index[part][row]])
        return sorted(zip(best.query, -best.score, *best.keys))

    whole = found()
    monkeypatch.setattr(retrieval, "_TILE_QUERIES", 5)
    assert found() == whole
    exact = np.round(np.einsum("ij,kj->ik", queries, rows), retrieval.SCORE_PLACES)
    assert whole == [
        (q, *hit) for q in range(17) for hit in sorted((-exact[q, i], ids[i], index[i]) for i in range(240))[:4]
    ]
