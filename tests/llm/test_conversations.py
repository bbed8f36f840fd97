"""Prefix trie and chat formatting against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mailweave.llm import chat_format, prefix_trie, queries

TYPES = "conv_id long, turn long, role string, text string"


def trie_of(rows):
    """Nodes by direct nesting: ``{(conv_id, depth): rest}``."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    built, members, below = {}, defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].add(c)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    out, sums = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in below[path]) or 1
        saved = sum(sums[k][1] for k in below[path])
        if path:
            saved += (len(members[path]) - 1) * len(path[-1][1].encode())
        sums[path] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[path]) if len(built[c]) == len(path))
        out[min(members[path]), len(path)] = (
            min(members[path[:-1]]) if path else None, len(members[path]), len(below[path]), leaves,
            saved, hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def found(df, **options):
    rows = prefix_trie.prefix_trie(df, **options).collect()
    got = {
        (r.conv_id, r.depth): (
            r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256
        ) for r in rows
    }
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def conversations():
    rng, rows = random.Random(1), []
    for c in [*range(50), 101, 103, 207]:
        for t in range(37 if c == 10 else rng.choice([1, 2, 3, 5, 8, 20])):
            rows.append((c, t, rng.choice("ua"), rng.choice(["x", "yé", "z" * 300])))
    # Null turn, role and text, no conversation, repeated rows and turn numbers.
    rows += [(7, None, None, None), (None, 1, "u", "z"), (7, 3, "u", "x"), (8, 0, "u", "x"), (8, 0, "u", "x")]
    return [*rows, *((300 + c, t, r, x) for c, t, r, x in rows if c in (20, 21))]


@pytest.mark.parametrize("piece", [4096, 4, 1])
def test_trie_against_nesting(spark, conversations, piece):
    df = spark.createDataFrame([(*r, "a", 1) for r in conversations], TYPES + ", name string, n long")
    assert found(df.repartition(3), piece=piece) == trie_of(conversations)


def test_trie_of_copies_and_lists_in_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST_BYTES", 50)
    rows = [(5 * c, t, "u", f"t{t}") for c in range(200) for t in range(3)]
    assert found(spark.createDataFrame(rows, TYPES).repartition(6)) == trie_of(rows)


def test_trie_of_a_split_hot_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie.skew, "HOT_ROWS", 50)
    monkeypatch.setattr(prefix_trie.skew.hot_keys, "__defaults__", (50,))
    rows = [(0, t, "u", f"t{t % 7}") for t in range(300)] + [(1, 0, "u", "t0")]
    assert found(spark.createDataFrame(rows, TYPES), piece=16) == trie_of(rows)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TYPES)
    assert prefix_trie.prefix_trie(empty).count() == chat_format.format_chats(empty).count() == 0


def read_back(df):
    done = chat_format.format_chats(df)
    return done.select(
        "*", chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_spans(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()


def test_chats_are_read_back(spark, conversations):
    rng = random.Random(3)
    bits = ["\\", "### ", "###", "</turn>", "\n", ":\n", "<next>", "</turn>\n", "a", "é", "\\0", " ", "<", "日"]
    rows = [*conversations]
    for c in range(400, 460):
        for t in range(rng.randint(1, 9)):
            rows.append((
                c, t, rng.choice(["user", "assistant", "assistant", "\n:x", "### a:\n"]),
                "".join(rng.choices(bits, k=rng.randint(0, 8))),
            ))
    rows += [(500, t, "assistant" if t % 3 else "user", f"t{t}") for t in range(700)]
    rows += [(None, 1, "assistant", "no id"), (501, 1, "assistant", None), (501, 0, None, "x" * 100_000)]
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    got = read_back(spark.createDataFrame(rows, TYPES).repartition(4))
    assert len(got) == len(want)
    for r in got:
        turns = [(role, text) for *_, role, text in sorted(want[r.conv_id])]
        assert [tuple(t) for t in r.turns] == turns
        assert r.loss == [text for role, text in turns if role == "assistant"]
        raw, spans = r.formatted.encode(), [(s.start, s.end) for s in r.loss_spans]
        assert all(b"</turn>" not in raw[a:b] and b"### " not in raw[a:b] for a, b in spans)
        assert spans == sorted(spans)
        # One block for each run of a role.
        runs = sum(i == 0 or turns[i - 1][0] != turns[i][0] for i in range(len(turns)))
        assert r.formatted.count(chat_format.CLOSE) == runs


def test_format_runs_no_python(spark, sf_dir):
    plan = queries.op13_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_chat_format"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    from compare import compare, connect

    con = connect(sf_dir)
    assert compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], sf_dir) is None
