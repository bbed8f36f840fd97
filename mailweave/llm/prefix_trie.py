"""Prefix trie of conversations by van Emde Boas recursion.

A conversation is a sequence of tokens, one per turn: the MD5 of role and text and the text's
length. Sequences of up to h turns are cut at half depth; each distinct first half is named
and is one sequence of the upper trie, with the number of conversations behind it; second halves
are sequences of the lower tries, which the names of their cuts tell apart. Upper and lower tries
are cut again, all in one table, until every sequence is one turn, which is one node. A name is
the MD5 of the name of its trie's root and the tokens below it.

Totals are grafted upward in the opposite order: tries of one turn have the sums of their
nodes; a lower trie's total is added to the nodes on the path of its cut in the upper trie, and
to the total of that trie.

Long conversations are cut into pieces of ``piece`` turns before, so no row holds more than that many
tokens. A piece's trie hangs at the name of what comes before; totals reach it over the chain of
pieces by doubling.

A null role or text counts as empty; rows without a conversation id belong to no conversation
and are left out. Turns are ordered by number (null first), ties by token; repeated rows are turns
of their own. Other columns are not read. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.operators import skew
from mailweave.session import scratch_path

TOKEN = 20  # bytes of a token: 16 of the hash, 4 of the text's length
PIECE = 4096  # turns, a power of two
ROOT = bytes(16)
LIST_BYTES = 1 << 20  # part of a list of ids that is one row


def tokens(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, ordinal, token)``: the turns of every conversation, from 1, token as hex."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    size = F.octet_length(text)
    hashed = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.concat(hashed, F.lpad(F.hex(size), 8, "0")).alias("token"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("token")]
    hot = skew.hot_keys(rows, "conv_id")
    usual, large = skew.split_by_keys(rows, "conv_id", hot)
    placed = skew.window_positions(usual, "conv_id", order).select("conv_id", "ordinal", "token")
    if large is not None:
        split = skew.ranged_positions(large, "conv_id", order)
        placed = placed.unionByName(split.select("conv_id", "ordinal", "token"))
    return placed


def share_openings(turns: DataFrame, every: int = 5, longest: int = 9) -> DataFrame:
    """Conversations rebuilt on the opening of the first of each ``every`` ids.

    Conversation c starts with the first h turns of conversation c - c % every, where
    h = crc32(c) % longest, and goes on with its own turns after its first h. Gives
    ``(conv_id, length, depth, token)``, depth from 0; a conversation without turns has one row
    with nulls.
    """
    opening = turns.where(F.col("ordinal") < longest).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "token"))).alias("opening")
    )
    plan = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).select(
        "conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % longest).cast("int").alias("h"),
    ).join(opening, "base", "left").select(
        "conv_id", "turns", "h",
        F.coalesce(F.slice("opening.token", F.lit(1), F.col("h")), F.expr("cast(array() as array<string>)"))
        .alias("opening"),
    ).withColumn(
        "length", F.size("opening") + F.greatest(F.col("turns") - F.col("h"), F.lit(0).cast("long"))
    )
    taken = plan.where((F.size("opening") > 0) | (F.col("length") == 0)).select(
        "conv_id", "length", F.posexplode_outer("opening").alias("depth", "token")
    ).withColumn("depth", F.col("depth").cast("long"))
    after = plan.select("conv_id", "length", "h", F.size("opening").alias("k"))
    own = turns.join(after, "conv_id").where(F.col("ordinal") > F.col("h")).select(
        "conv_id", "length", (F.col("k") + F.col("ordinal") - F.col("h") - 1).alias("depth"), "token"
    )
    return taken.unionByName(own)


def name_of(tree: Column, seq: Column) -> Column:
    return _below(tree, F.unhex(F.md5(seq)))


def _below(tree: Column, hashed: Column) -> Column:
    return F.unhex(F.md5(F.concat(tree, hashed)))


def _name(tree: bytes, seq: bytes) -> bytes:
    return hashlib.md5(tree + hashlib.md5(seq).digest()).digest()


def block_names(tree: bytes, seq: bytes) -> list[bytes]:
    """Names after 1, 2, ... tokens of ``seq`` below ``tree``: as recursion cuts them, a place j
    is named by its last block, as long as the largest power of two in j."""
    names = [tree]
    for j in range(1, len(seq) // TOKEN + 1):
        k = j & -j
        names.append(_name(names[j - k], seq[(j - k) * TOKEN : j * TOKEN]))
    return names[1:]


class Tables:
    """Intermediate tables below one folder, each written once."""

    def __init__(self, spark) -> None:
        self.spark, self.folder, self.count = spark, scratch_path(spark, "trie"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/t{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def pieces_of(turns: DataFrame, piece: int, tables: Tables) -> DataFrame:
    """``(conv_id, length, tree, base, seq)``: the pieces of every sequence and the name each
    hangs at."""
    found = tables.keep(
        turns.where("token is not null")
        .groupBy("conv_id", "length", F.floor(F.col("depth") / piece).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("depth", "token"))).alias("turns"))
        .select("conv_id", "length", "part", F.unhex(F.array_join("turns.token", "")).alias("seq"))
    )
    # Names of later pieces: a chain over the hashes of the pieces before.
    hashed = F.struct("part", F.unhex(F.md5("seq")).alias("hash"))
    chains = found.where(
        (F.col("length") > piece) & (F.length("seq") == piece * TOKEN)
    ).groupBy("conv_id").agg(F.array_sort(F.collect_list(hashed)).alias("parts"))
    root = F.lit(ROOT)
    named = F.aggregate(
        "parts", F.array(root),
        lambda done, p: F.array_append(done, _below(F.element_at(done, -1), p["hash"])),
    )
    chains = chains.select("conv_id", F.posexplode(named).alias("part", "tree")).withColumn(
        "part", F.col("part").cast("long")
    )
    return found.join(chains, ["conv_id", "part"], "left").select(
        "conv_id", "length", F.coalesce("tree", root).alias("tree"),
        (F.col("part") * piece).alias("base"), "seq",
    )


def cut(rows: DataFrame, half: int) -> DataFrame:
    """One step of the recursion: sequences of up to ``2 * half`` turns become ones of up to
    ``half``. ``open`` marks those of upper tries with a lower trie below."""
    size, at = F.length("seq"), half * TOKEN
    short = rows.where(size < at).select(
        "tree", "base", "seq", "end", "n", "first", F.lit(False).alias("open")
    )
    first = F.substring("seq", 1, at)
    long = rows.where(size >= at).withColumn("cut", name_of(F.col("tree"), first))
    upper = long.groupBy("cut").agg(
        F.first("tree").alias("tree"), F.first("base").alias("base"), F.first(first).alias("seq"),
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max(size > at).alias("open"),
    ).select("tree", "base", "seq", F.col("cut").alias("end"), "n", "first", "open")
    lower = long.where(size > at).select(
        F.col("cut").alias("tree"), (F.col("base") + half).alias("base"),
        F.substring("seq", at + 1, at).alias("seq"), "end", "n", "first", F.lit(False).alias("open"),
    )
    return short.union(upper).union(lower)


def path_totals(grafts: DataFrame) -> DataFrame:
    """``(name, leaves, saved)``: what each graft adds to every node of its path."""

    def run(batches):
        for batch in batches:
            tree, seq, leaves, saved = (batch.column(i).to_pylist() for i in range(4))
            names, more, sums = [], [], []
            for i, s in enumerate(seq):
                path = block_names(tree[i], s)
                names += path
                more += [leaves[i]] * len(path)
                sums += [saved[i]] * len(path)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(more, pa.int64()), pa.array(sums, pa.int64())],
                names=["name", "leaves", "saved"],
            )

    return grafts.select("tree", "seq", "leaves", "saved").mapInArrow(
        run, "name binary, leaves long, saved long"
    )


def list_hashes(rows: DataFrame, tables: Tables) -> DataFrame:
    """``(name, ends_sha256)``: hash of the ids of each name, ascending and joined by commas.

    Ids are range-sorted and joined to parts of LIST_BYTES where they lie; only parts are
    brought together, and hashed one after the other without holding a list.
    """
    rows = tables.keep(rows)
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join_ids(batches):
        name, ids, size, first = None, [], 0, None

        def part():
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.binary()), pa.array([first], pa.int64()),
                 pa.array([",".join(ids)], pa.string())], names=["name", "first", "part"],
            )

        for batch in batches:
            for this, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (this != name or size >= limit):
                    yield part()
                    ids, size = [], 0
                if not ids:
                    name, first = this, i
                ids.append(str(i))
                size += len(ids[-1]) + 1
        if ids:
            yield part()

    def hash_parts(batches):
        name, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for this, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is not None and this == name:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = this, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                names=["name", "ends_sha256"],
            )
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.binary()), pa.array([state.hexdigest()])],
                names=["name", "ends_sha256"],
            )

    limit = LIST_BYTES
    parts = rows.repartitionByRange(slices, "name", "conv_id").sortWithinPartitions(
        "name", "conv_id"
    ).select("name", "conv_id").mapInArrow(join_ids, "name binary, first long, part string")
    return parts.repartition(slices, "name").sortWithinPartitions("name", "first").mapInArrow(
        hash_parts, "name binary, ends_sha256 string"
    )


def end_names(pieces: DataFrame) -> DataFrame:
    """``(name, conv_id)``: the node at which each piece ends."""

    def run(batches):
        for batch in batches:
            names = []
            for tree, seq in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                j, n = 0, len(seq) // TOKEN
                while j < n:  # the blocks of n, longest first
                    k = 1 << ((n - j).bit_length() - 1)
                    tree = _name(tree, seq[j * TOKEN : (j + k) * TOKEN])
                    j += k
                names.append(tree)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), batch.column(0)], names=["name", "conv_id"]
            )

    return pieces.select("conv_id", "tree", "seq").mapInArrow(run, "name binary, conv_id long")


def _sums(parts: list[DataFrame]) -> DataFrame:
    """``(tree, depth, leaves, saved)`` of several tables, added up."""
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    return both.groupBy("tree").agg(
        F.first("depth").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )


def _over_pieces(below: DataFrame, rows: DataFrame, steps: int, tables: Tables) -> DataFrame:
    """Totals of piece tries with those of all later pieces, ``(tree, leaves, saved)``.

    ``below`` has the total of each piece's trie; after step k a total holds those of the
    2 ** k pieces from there on.
    """
    total = tables.keep(below.select("tree", "leaves", "saved"))
    jump = tables.keep(rows.where(F.col("base") > 0).select("tree", "end").distinct())
    for _ in range(steps):
        moved = total.join(jump, total["tree"] == jump["end"]).select(jump["tree"], "leaves", "saved")
        total = tables.keep(total.union(moved).groupBy("tree").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        ))
        far = jump.select(F.col("tree").alias("above"), F.col("end").alias("tree"))
        jump = tables.keep(far.join(jump, "tree").select(F.col("above").alias("tree"), "end"))
    return total


def trie_nodes(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per node of the trie of ``turns (conv_id, length, depth, token)``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (bytes of last texts that a shared prefix saves, summed over
    the subtree), ``ends_sha256`` (hash of the ids of conversations that end here).
    """
    if piece & (piece - 1):
        raise ValueError("piece must be a power of two")
    tables = Tables(turns.sparkSession)
    turns = tables.keep(turns)
    pieces = tables.keep(pieces_of(turns, piece, tables))
    longest = turns.agg(F.max("length")).first()[0] or 0
    height = 1
    while height < min(longest, piece):
        height *= 2
    # Equal pieces below one name are one sequence.
    whole = F.length("seq") == height * TOKEN
    rows = tables.keep(
        pieces.groupBy(name_of(F.col("tree"), F.col("seq")).alias("key")).agg(
            F.first("tree").alias("tree"), F.first("base").alias("base"), F.first("seq").alias("seq"),
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"),
        ).select("tree", "base", "seq", F.when(whole, F.col("key")).alias("end"), "n", "first")
    )
    full, cuts, half = rows, {}, height // 2
    while half:
        rows = tables.keep(cut(rows, half))
        cuts[half] = rows.where("open").select("tree", "base", "seq", "end")
        half //= 2

    size = F.conv(F.hex(F.substring("seq", 17, 4)), 16, 10).cast("long")
    single = rows.select(
        F.coalesce("end", name_of(F.col("tree"), F.col("seq"))).alias("name"),
        F.col("tree").alias("parent"), (F.col("base") + 1).alias("depth"), "n", "first",
        ((F.col("n") - 1) * size).alias("saved"),
    )
    root = turns.agg(
        F.count_distinct("conv_id").alias("n"), F.min("conv_id").alias("first")
    ).where("n > 0").select(
        F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("depth"), "n", "first", F.lit(0).cast("long").alias("saved"),
    )
    single = tables.keep(single.union(root))
    below = single.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(
        F.count(F.lit(1)).alias("children")
    )
    nodes = tables.keep(single.join(below, "name", "left").select(
        "name", "parent", "depth", "n", "first", "saved",
        F.coalesce("children", F.lit(0).cast("long")).alias("children"),
        F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaf"),
    ))

    # Totals by the trie's root, small tries first.
    sums = [tables.keep(nodes.where("parent is not null").groupBy(F.col("parent").alias("tree")).agg(
        (F.first("depth") - 1).alias("depth"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")
    ))]
    grafts = []

    def graft(at: DataFrame, totals: DataFrame) -> None:
        lower = totals.select(F.col("tree").alias("end"), "leaves", "saved")
        held = tables.keep(at.join(lower, "end").select("tree", "base", "seq", "leaves", "saved"))
        grafts.append(held)
        sums.append(held.select("tree", F.col("base").alias("depth"), "leaves", "saved"))

    half = 1
    while half < height:
        due = [s.where(F.col("depth") % (2 * half) == half) for s in sums]
        graft(cuts[half], _sums(due))
        half *= 2
    if longest > piece:
        tops = _sums([s.where(F.col("depth") % piece == 0) for s in sums]).where("depth > 0")
        closed = full.where(F.length("seq") == piece * TOKEN)
        steps = ((longest - 1) // piece).bit_length()
        graft(closed, _over_pieces(tops, closed, steps, tables))

    onto = _sums([s.where(F.col("tree") == F.lit(ROOT)) for s in sums]).select(
        F.col("tree").alias("name"), "leaves", "saved"
    )
    for held in grafts:
        onto = onto.union(path_totals(held))
    onto = onto.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("more"))

    last = F.floor((F.col("length") - 1) / piece) * piece
    bare = turns.where("length = 0").select(F.lit(ROOT).alias("name"), "conv_id")
    ends = list_hashes(end_names(pieces.where(F.col("base") == last)).union(bare), tables)
    above = nodes.select(F.col("name").alias("parent"), F.col("first").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    return (
        nodes.join(onto, "name", "left").join(ends, "name", "left").join(above, "parent", "left").select(
            F.col("first").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
            F.col("children").alias("n_children"),
            (F.col("leaf") + F.coalesce("leaves", zero)).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more", zero)).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def prefix_trie(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", every: int = 5, longest: int = 9, piece: int = PIECE,
) -> DataFrame:
    """The trie of the conversations of ``df``, rebuilt by :func:`share_openings`."""
    turns = tokens(df, id_col, turn_col, role_col, text_col)
    return trie_nodes(share_openings(turns, every, longest), piece)
