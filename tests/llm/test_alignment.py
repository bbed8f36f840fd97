"""Alignment of two tokenizers against the libraries and direct counting."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from mailweave.llm import alignment, queries

A = Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_BPE))
SYMBOL = {c: b for b, c in enumerate(alignment.bpe.byte_symbols())}


@pytest.fixture(scope="module")
def sides():
    return alignment.load_sides(
        public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.path(queries.PIECE_BPE)
    )


def piece(i):
    p = B.id_to_piece(i)
    return bytes([int(p[1:-1], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def aligned(text):
    """Ids of both sides and their groups; empty where there are no tokens."""
    if not text:
        return [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes = [bytes(SYMBOL[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = [piece(i) for i in b]
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], [], []
    a_ends = dict(zip(np.cumsum([len(x) for x in a_bytes]).tolist(), range(len(a))))
    groups, i, j, place = [], 0, 0, 0
    for k, x in enumerate(b_bytes):
        place += len(x)
        if place in a_ends:
            groups.append((a[i : a_ends[place] + 1], b[j : k + 1]))
            i, j = a_ends[place] + 1, k + 1
    return a, b, groups


def expected(texts):
    found = [aligned(t) for t in texts]
    counts = Counter((g[0][-1], g[1][-1]) for f in found for g in f[2])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for a, b, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((
            len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if a else "",
        ))
    return rows


def digest(rows):
    return Counter(
        (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        for r in rows
    )


def test_against_the_libraries(odd, sides):
    rows = odd.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, expected([r.text for r in rows])))
    assert digest(alignment.align(odd, sides).collect()) == want


def test_white_space_controls_and_marks(spark, sides):
    rng = np.random.default_rng(2)
    bits = ["the", "Ünd", " ", "  ", "\n", "\t ", "　", "\x1c", "\x85", "▁", "<s>", "<|endoftext|>",
            "don't", "12ab", "\x00", "é", "é", "日本", "🙂", "<0x41>", ".", " a", "a ", " "]
    texts = ["".join(rng.choice(bits, int(n))) for n in rng.integers(1, 12, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = Counter((i, *w) for i, w in enumerate(expected(texts)))
    assert digest(alignment.align(df, sides, fan_in=2).collect()) == want


def test_whole_table(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, expected([r.text for r in rows])))
    assert digest(queries.op11_token_alignment(spark, sf_dir).collect()) == want


def test_small_tables_start_anew(sides):
    table = alignment.Aligned(sides, limit=2)
    for text in ["one two three", "two four", "one five"]:
        units, _ = table.numbers([text])
        assert b"".join(table.shown[u] for u in units).count(b";") == len(aligned(text)[2])


def test_merge_counts_pairs():
    rng = np.random.default_rng(1)
    runs, want = [], Counter()
    for _ in range(9):
        keys = np.unique(rng.integers(0, 50, 20))
        counts = rng.integers(1, 9, len(keys))
        want.update(dict(zip(keys.tolist(), counts.tolist())))
        runs.append(alignment.pack_run(keys.astype("<i8"), counts.astype("<i8")))
    keys, counts = alignment.open_run(alignment.merge_runs(runs))
    assert keys.tolist() == sorted(want) and dict(zip(keys.tolist(), counts.tolist())) == want


def test_no_rows_and_no_tokens(spark, empty, sides):
    assert alignment.align(empty, sides).count() == 0
    df = spark.createDataFrame([(1, None), (1, ""), (None, "▁")], "doc_id long, text string")
    for r in alignment.align(df, sides).collect():
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (0,) * 6 + ("",)
