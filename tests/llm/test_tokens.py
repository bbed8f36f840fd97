import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mailweave.llm import bpe, common, packing, queries, token_counts


@pytest.fixture(scope="module", params=[queries.BYTE_BPE, queries.WORD_BPE])
def name(request):
    return request.param


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_encode_is_the_librarys(odd, name):
    tok = library(name)
    rows = odd.select("doc_id", "text").collect()
    want = Counter(
        (r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in rows
    )
    got = bpe.encode(odd, queries.vocabulary(name)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want


def test_round_trip(odd):
    v = queries.vocabulary(queries.BYTE_BPE)
    got = bpe.decode(bpe.encode(odd.where("doc_id is not null"), v), v).collect()
    want = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.decoded == want[r.doc_id] for r in got)


def test_decode_of_broken_bytes_and_nulls(spark):
    v, tok = queries.vocabulary(queries.BYTE_BPE), library(queries.BYTE_BPE)
    lists = [[50256, 15496], [447], [447, 15496, 223], []]
    df = spark.createDataFrame([*enumerate(lists), (9, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, v).collect()}
    assert got == {i: tok.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)} | {9: ""}


def test_small_tables_start_anew(monkeypatch):
    tok = library(queries.BYTE_BPE)
    units = bpe.Units(queries.vocabulary(queries.BYTE_BPE), limit=3)
    for text in ["the red fox", "a blue fox ran", "the red fox", "fox"]:
        assert units.encode([text])[0].tolist() == tok.encode(text).ids


def test_counts(odd):
    tok = library(queries.WORD_BPE)
    got = token_counts.token_counts(odd, queries.vocabulary(queries.WORD_BPE)).collect()
    want = Counter(
        (r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids))
        for r in odd.collect()
    )
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_small_tables_count_the_same(odd, monkeypatch):
    v, tok = queries.vocabulary(queries.BYTE_BPE), library(queries.BYTE_BPE)
    monkeypatch.setattr(token_counts, "KEPT", 3)
    monkeypatch.setattr(token_counts, "CACHED", 3)
    monkeypatch.setattr(token_counts, "FREQUENT", 5)
    want = Counter(
        (r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()
    )
    got = token_counts.token_counts(odd, v).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want


def test_first_tier_has_the_exact_top_and_its_lengths(odd, monkeypatch):
    v, tok = queries.vocabulary(queries.WORD_BPE), library(queries.WORD_BPE)
    monkeypatch.setattr(token_counts, "KEPT", 2)
    monkeypatch.setattr(token_counts, "FREQUENT", 9)
    split = bpe.Units(v).split
    want = Counter(u for r in odd.collect() for u in split(r.text or "") if isinstance(u, str))
    top = sorted(want.items(), key=lambda x: (-x[1], x[0].encode()))[:9]
    units = token_counts.frequent_units(odd, v)
    assert [(r.unit, r.n) for r in units.collect()] == top
    lengths = {bytes(r.key): r.length for r in token_counts.unit_lengths(units, v).collect()}
    assert lengths == {
        token_counts.key_of(u): len(tok.encode(u, add_special_tokens=False).ids) for u, _ in top
    }


def test_pack_keeps_every_id_once(odd):
    tok = library(queries.WORD_BPE)
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {
        r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()
    }
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, queries.vocabulary(queries.WORD_BPE)).collect():
        part = np.frombuffer(r.token_bytes, "<u4").tolist()
        assert part == ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for parts in [*by_doc.values(), *by_sequence.values()]:
        place = 0
        for start, length in sorted(parts):
            assert start == place
            place += length
    sizes = [sum(n for _, n in s) for s in by_sequence.values()]
    assert max(sizes) <= 2048
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes) < 0.05 * sum(sizes)


def test_best_cuts_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(30):
        at = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 9, 25))]))
        price = rng.integers(0, 4, len(at)).astype(float)

        def cost(cuts):
            total, last = 0.0, 0
            for c in cuts:
                n = c - last
                total += (0 if n & (n - 1) == 0 else 16 - n) + packing.WINDOW + price[np.searchsorted(at, c)]
                last = c
            return total

        best = [0.0] + [np.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                n = at[j] - at[i]
                if n <= 16:
                    pad = 0 if n & (n - 1) == 0 else 16 - n
                    best[j] = min(best[j], best[i] + pad + packing.WINDOW + price[j])
        assert cost(packing.best_cuts(at, price, 16)) == pytest.approx(best[-1])


def test_empty_tables(empty):
    v = queries.vocabulary(queries.WORD_BPE)
    assert bpe.encode(empty, v).count() == token_counts.token_counts(empty, v).count() == 0
    assert packing.pack(empty, v).count() == 0


def test_crc_is_of_the_ids(spark, sf_dir):
    tok = library(queries.WORD_BPE)
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, sf_dir, "documents").collect()}
    for r in queries.op4_pack_sequences(spark, sf_dir).limit(50).collect():
        ids = [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_cuts_are_the_cheapest():
    """The choice of cuts against a search over all pairs of places."""
    import numpy as np
    from mailweave.llm import bpe, packing

    rng = np.random.default_rng(5)
    assert bpe._ascending([np.array([3, 1, 3]), np.array([1, 2])]).tolist() == [1, 2, 3]
    for limit in (3, 8, 64):
        ends = np.cumsum(rng.integers(1, 30, 12))
        at, price = packing.allowed_cuts(ends, ends[:6] - 0, limit)
        assert set(ends.tolist()) <= set(at.tolist()) and (price[np.isin(at, ends)] == 0).all()
        at, price = np.arange(int(ends[-1]) + 1), np.where(np.isin(np.arange(int(ends[-1]) + 1), ends), 0.0, 12.0)
        cost = [0.0]
        for j in range(1, len(at)):
            pads = [(0 if (n := j - i) & (n - 1) == 0 else limit - n) + cost[i] for i in range(max(0, j - limit), j)]
            cost.append(min(pads) + price[j] + packing.WINDOW)
        cuts = [0, *packing.best_cuts(at, price, limit)]
        sizes = np.diff(cuts)
        spent = sum((0 if n & (n - 1) == 0 else limit - n) + packing.WINDOW for n in sizes.tolist()) + price[cuts[1:]].sum()
        assert sizes.max() <= limit and spent == cost[-1]


def test_units_of_several_blocks_are_encoded_at_once(spark, monkeypatch):
    """Blocks are packed alone, but a task does not run through all merges for each of them."""
    from mailweave.llm import bpe

    calls = []
    resolve = bpe.Units.resolve
    monkeypatch.setattr(bpe.Units, "resolve", lambda self: calls.append(len(self.new)) or resolve(self))
    monkeypatch.setattr(packing, "slices", lambda part: common.slices(part, limit=200))
    handles = []
    monkeypatch.setattr(packing, "map_slices", lambda df, work, *a, **k: handles.append((work, k)) or df)
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    vocabulary = queries.vocabulary(queries.WORD_BPE)
    texts = [f"The cat sat on mat {i}. It left. " * 3 for i in range(9)] + [None, ""]
    packing.pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary, limit=16)
    work, options = handles[0]
    handle = work()
    calls.clear()
    got = handle(pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array(texts)], names=["doc_id", "text"]))
    assert len(calls) == 1 and options["limit"] > common.SLICE_BYTES
    doc, start, length, blobs, tokens, sequence, offset = (c.to_pylist() for c in got)
    ids, bounds = bpe.Units(vocabulary).encode([t or "" for t in texts])
    for i in range(11):
        mine = [b for d, b in zip(doc, blobs) if d == i]
        want = [*ids[bounds[i] : bounds[i + 1]].tolist(), 1]
        assert np.frombuffer(b"".join(mine), "<u4").tolist() == want
    fill = {}
    for s, o, n in zip(sequence, offset, length):
        assert fill.get(s, 0) == o
        fill[s] = o + n
    assert max(fill.values()) <= 16


def test_encoding_takes_little_memory_beside_its_bytes():
    """Two tasks of the packing stage have to fit an executor beside its heap (4 bytes for most positions)."""
    draw = random.Random(1)
    words = list({"".join(draw.choices("etaoinshrdlu", k=draw.randint(4, 10))).encode() for _ in range(200_000)})
    pairs = bpe.PairIndex(queries.vocabulary(queries.WORD_BPE))
    tracemalloc.start()
    try:
        pairs.encode(words)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 55 * sum(map(len, words))


def test_a_full_table_of_pre_tokens_goes_before_the_blocks_are_packed():
    units = bpe.Units(queries.vocabulary(queries.WORD_BPE), limit=3)
    units.numbers(["one two three four five"])
    assert len(units) == 5 and not units.known
    assert units.encode(["six one two"])[0].tolist() == library(queries.WORD_BPE).encode(
        "six one two", add_special_tokens=False
    ).ids


def test_pieces_go_out_block_by_block(spark, monkeypatch):
    """A batch for the JVM is a block, not all that was encoded at a time."""
    texts = [f"The cat sat on mat {i}. It left. " * 3 for i in range(9)]
    monkeypatch.setattr(packing, "slices", lambda part: common.slices(part, limit=200))
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))

    class Rows:
        dtypes = [("doc_id", "bigint"), ("text", "string")]

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = packing.pack(Rows(), queries.vocabulary(queries.WORD_BPE), limit=16)
    batches = list(run([pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["doc_id", "text"])]))
    # Two texts fit 200 bytes.
    assert [sorted(set(b["doc_id"].to_pylist())) for b in batches] == [[0, 1], [2, 3], [4, 5], [6, 7], [8]]
