"""Exact set-similarity join of documents on word shingles, and the groups it links.

Words are the runs of bytes other than ASCII white space, after A-Z became lower case; a
document's set are its distinct shingles of ``width`` words (with fewer words the whole
sequence as one; without words the set is empty and linked with nothing). Two sets link
when ``100 * |A & B| >= percent * |A | B|``.

Candidates come from a partition of the universe: every shingle falls into one of m
segments by its hash, m depending on the band of the larger set's size. Two sets that
link differ in at most D places, so

* with m = D + 1 segments at least one is equal on both sides, and
* with m = ceil((D + 1) / 2) at least one differs in at most one shingle, and is found
  through the segments with one shingle deleted.

The allocation follows the cost in index rows: a band of small sets takes the second form
(few long segments, one row per shingle), a band of large sets the first. There, segments
of at most one shingle would be equal by chance among many documents. They are left out;
in exchange a set that has such segments also gets the one-deletion rows of those of its first Q
segments that are not small. If only h left-out segments are equal, at most h - 1 others differ by
two or more, so among any h segments that are small on neither side one differs by one; where
both sides have at most Q / 3 small segments, the first Q hold that many. A set with more small
segments indexes all of them, and is met through them by anyone.

Below PREFIX_PERCENT segments would hold few shingles and be many, so single shingles are signatures:
in any order of the universe, sets that link share one of the first ``|A| - o + 1`` of the smaller set,
where o is the least overlap with a set of its size or more, and of the first ``|B| - p + 1`` of the
larger one, where p is its least overlap with any. The order puts the FREQUENT shingles that most
sets have last, by their number; the rest follows the hash. It decides only how many sets meet.

Sets that are equal are one node. Inside each group of equal signatures pairs of nodes are first
tested by their sizes and parity bits, a lower bound of their difference that rejects nearly all that
do not link. Of the pairs that pass, only a spanning forest is compared at first (groups of up to
FEW nodes: all pairs), so a group of copies costs its size. Later rounds look at what the links found
so far leave apart: at most SOME pairs of two groups of linked nodes, then all pairs that are left.
Rows grow with nodes and links; only the bit tests inside a signature's group grow with its square.
Every comparison reads the two sets and is exact (shingles as 64-bit hashes).

Nulls and empty texts are documents of their own group. Rows with the same id are one
document per distinct set; all get the smallest id of their group. A null id stays null; a group is
named by its other members, and has a null name if it has none. Other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.llm.common import map_slices, mark, marked, marks, mix64, offsets, release, slices
from mailweave.session import remove, scratch_path

SMALL_SET = 64  # sets up to this size take the one-deletion form
FIRST_SEGMENTS, FIRST_PART = 12, 16  # Q: so many segments, or one in so many if that is more
# Parity bits of a set: so many 64-bit words up to so many shingles, twice as many for twice the size.
PARITY_WORDS, PARITY_SIZE = 8, 1024
FEW = 16  # nodes of a signature of which all pairs are compared
MATRIX_NODES, MATRIX_BYTES = 4096, 16 << 20  # up to so many nodes are tested in one matrix
SOME = 8  # pairs of two groups compared in the middle round
WORD_LIMIT = 200_000  # word hashes a task remembers
PREFIX_PERCENT = 85
FREQUENT = 16_384  # shingles put last in the order of prefixes
COUNTED = 1 << 20  # shingles a task counts at a time, and half as many counts it keeps


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, width: int) -> None:
        self.width, self.words = width, _WordHashes()

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All sets one after the other, and the bounds of each."""
        if len(self.words) > WORD_LIMIT:
            self.words.clear()
        out, sizes = [], []
        for text in texts:
            words = text.lower().split()
            n = len(words)
            if not n:
                out.append(np.zeros(0, np.uint64))
                sizes.append(0)
                continue
            h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
            span = min(n, self.width)
            total = np.zeros(n - span + 1, np.uint64)
            for j in range(span):
                total = mix64(total + h[j : n - span + 1 + j])
            total.sort()
            if len(total) > 1:
                keep = np.ones(len(total), bool)
                keep[1:] = total[1:] != total[:-1]
                total = total[keep]
            out.append(total)
            sizes.append(len(total))
        return (np.concatenate(out) if out else np.zeros(0, np.uint64)), offsets(sizes)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def band_tables(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each band, and the segments of each and whether it deletes one.

    Band k compares sets of which the larger one has its size in it.
    """
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] * 100 / percent)))
    bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] * 100 / percent)))
    tops = np.array(bounds[1:] + [bounds[-1] * 2]) - 1
    # |A ^ B| <= (100 - p) / (100 + p) * (|A| + |B|), and both have at most the top size
    differ = (2 * tops * (100 - percent)) // (100 + percent)
    delete = tops <= SMALL_SET
    return np.array(bounds), np.where(delete, (differ + 2) // 2, differ + 1), delete


def _node(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set; equal sets have equal names."""
    sums = np.zeros(len(bounds) - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        sums[full] = np.add.reduceat(mix64(values), bounds[full])
    return mix64(sums + mix64(np.diff(bounds).astype(np.uint64)))


def frequent_shingles(df: DataFrame, text_col: str, width: int) -> DataFrame:
    """``(shingle, n)`` of the most frequent shingles, n being about the number of sets that have it.

    A task forgets shingles that are rare among the COUNTED ones it sees at a time.
    """

    def run(batches):
        shingles, seen = Shingles(width), set()
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def count() -> None:
            nonlocal keys, counts
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
            waiting.clear()
            both, at = np.unique(np.concatenate([keys, found[n > 1]]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n[n > 1]]), len(both)).astype(np.int64)
            keys = both
            if len(keys) > COUNTED // 2:
                most = np.argsort(-counts, kind="stable")[: COUNTED // 4]
                keys, counts = keys[most], counts[most]

        held = 0
        for batch in batches:
            for part in slices(batch, 0):
                values, bounds = shingles.sets(part.column(0).cast(pa.binary()).to_pylist())
                for i, name in enumerate(_node(values, bounds).tolist()):
                    if name not in seen:
                        seen.add(name)
                        waiting.append(values[bounds[i] : bounds[i + 1]])
                        held += len(waiting[-1])
                if len(seen) > 4 * WORD_LIMIT:
                    seen.clear()
                if held > COUNTED:
                    count()
                    held = 0
        count()
        most = np.argsort(-counts, kind="stable")[:FREQUENT]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[most].view(np.int64)), pa.array(counts[most])], names=["shingle", "n"]
        )
        release()

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    found = df.select(text).mapInArrow(run, "shingle long, n long")
    return found.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT)


def signatures(
    df: DataFrame, id_col: str, text_col: str, width: int, percent: int,
    frequent: np.ndarray | None = None,
) -> DataFrame:
    """``(id, n, node, sigs, weak, parity)``: set size, name of the set and its signatures.

    ``sigs`` is null where this task already gave the signatures of an equal set.
    The last ``weak`` signatures are those of left-out segments, of use only to sets that
    index all their segments, or those a set needs only as the larger one of a pair. ``parity`` has
    a bit for each hash bucket: whether it holds an odd number of the set's shingles; null without
    signatures. With ``frequent``, the most frequent shingles in falling order, signatures are prefixes.
    """
    shared = None if frequent is None else df.sparkSession.sparkContext.broadcast(frequent)

    def work():
        shingles, seen = Shingles(width), set()

        def handle(part: pa.RecordBatch) -> list:
            values, bounds = shingles.sets(part.column(1).cast(pa.binary()).to_pylist())
            sizes = np.diff(bounds)
            names = _node(values, bounds)
            first = []
            for i, (name, n) in enumerate(zip(names.tolist(), sizes.tolist(), strict=True)):
                if n and name not in seen:
                    seen.add(name)
                    first.append(i)
            if len(seen) > 4 * WORD_LIMIT:
                seen.clear()
            if shared is None:
                sigs, counts, weak = segment_signatures(values, bounds, np.array(first, int), percent)
            else:
                sigs, counts, weak = prefix_signatures(values, bounds, first, percent, shared.value)
            per_row = np.zeros(len(sizes), np.int64)
            per_row[first] = counts
            weak_row = np.zeros(len(sizes), np.int32)
            weak_row[first] = weak
            lists = pa.ListArray.from_arrays(
                pa.array(offsets(per_row).astype(np.int32)), pa.array(sigs.view(np.int64))
            )
            bits: list = [None] * len(sizes)
            for i in first:
                bits[i] = parity(values[bounds[i] : bounds[i + 1]])
            return [
                part.column(0), pa.array(sizes), pa.array(names.view(np.int64)), lists,
                pa.array(weak_row), pa.array(bits, pa.binary()),
            ]

        return handle

    kind = dict(df.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return map_slices(
        df.select(F.col(id_col).alias("id"), text), work,
        f"id {kind}, n long, node long, sigs array<long>, weak int, parity binary",
    )


def parity(values: np.ndarray) -> bytes:
    """Parity bits of a set; a set of twice the size has up to twice as many, and folding these by
    XOR gives the shorter form."""
    words = PARITY_WORDS
    while len(values) * PARITY_WORDS > PARITY_SIZE * words:
        words *= 2
    size = 64 * words
    bucket = (mix64(values + np.uint64(5)) % np.uint64(size)).astype(np.int64)
    odd = (np.bincount(bucket, minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


class Nodes:
    """Sizes and parity bits of the nodes of one signature."""

    def __init__(self, n: np.ndarray, bits: list[bytes], percent: int) -> None:
        self.n, self.percent = n, percent
        self.words = np.array([len(b) // 8 for b in bits])
        self.rows: dict[int, np.ndarray] = {}  # by width, folded to the narrowest of a pair
        for width in np.unique(self.words).tolist():
            rows = np.zeros((len(bits), width), np.uint64)
            for i, b in enumerate(bits):
                if len(b) >= 8 * width:
                    rows[i] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width))
            self.rows[width] = rows

    def near(self, x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
        """Whether sizes and bits let the nodes ``x`` link with ``y``."""
        nx, ny = self.n[x], self.n[y]
        ok = 100 * np.minimum(nx, ny) >= self.percent * np.maximum(nx, ny)
        narrow = np.minimum(self.words[x], self.words[y])
        differ = np.zeros(len(y), np.int64)
        for width, rows in self.rows.items():
            at = np.flatnonzero(ok & (narrow == width))
            left = rows[x[at]] if isinstance(x, np.ndarray) else rows[x]
            differ[at] = np.bitwise_count(left ^ rows[y[at]]).sum(1, dtype=np.int64)
        return ok & ((100 + self.percent) * differ <= (100 - self.percent) * (nx + ny))


    def matrix(self) -> np.ndarray | None:
        """:meth:`near` for all pairs at once; None where there is none."""
        size, rows = len(self.n), self.rows[int(self.words.min())]
        found = np.zeros((size, size), bool)
        step = max(1, MATRIX_BYTES // (size * rows.shape[1] * 8))
        for at in range(0, size, step):
            part = slice(at, at + step)
            differ = np.bitwise_count(rows[part, None] ^ rows[None]).sum(2, dtype=np.int64)
            found[part] = (100 + self.percent) * differ <= (100 - self.percent) * (
                self.n[part, None] + self.n[None]
            )
        np.fill_diagonal(found, False)
        if not found.any():
            return None
        x, y = np.nonzero(found)
        found[x, y] = self.near(x, y)
        return found


def spanning_pairs(nodes: Nodes, root: np.ndarray, some: int) -> list[tuple[int, int]]:
    """Pairs that hold together all of a signature's groups of linked nodes (``root``) that the
    test of :meth:`Nodes.near` does; at most ``some`` of any two groups."""
    members: dict[int, list[int]] = {}
    for i, r in enumerate(root.tolist()):
        members.setdefault(r, []).append(i)
    out, left = [], np.ones(len(root), bool)
    matrix = None
    if len(root) <= MATRIX_NODES:
        matrix = nodes.matrix()
        if matrix is None:
            return []
    for first in members:
        if not left[members[first][0]]:
            continue
        waiting = [first]
        left[members[first]] = False
        while waiting:
            used: dict[int, int] = {}
            for i in members[waiting.pop()]:
                if matrix is not None:
                    others = np.flatnonzero(matrix[i] & left)
                else:
                    others = np.flatnonzero(left)
                    others = others[nodes.near(i, others)]
                for j in others.tolist():
                    met = used.get(int(root[j]), 0)
                    if met < some:
                        out.append((i, j))
                        used[int(root[j])] = met + 1
            for r in used:
                waiting.append(r)
                left[members[r]] = False
    return out


def pairs_within(shared: DataFrame, percent: int, some: int | None) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of one signature and of different roots that may link.

    ``shared`` has ``(sig, node, root, n, parity)``. Signatures of more than FEW nodes give
    :func:`spanning_pairs`, or all such pairs where ``some`` is None.
    """

    def of_group(node, root, n, bits) -> tuple[np.ndarray, np.ndarray]:
        nodes = Nodes(n, bits, percent)
        if len(node) > FEW and some is not None:
            found = np.array(spanning_pairs(nodes, root, some), np.int64).reshape(-1, 2)
            return node[found[:, 0]], node[found[:, 1]]
        a, b = [], []
        for i in range(len(node) - 1):
            later = np.arange(i + 1, len(node))
            later = later[root[later] != root[i]]
            later = later[nodes.near(i, later)]
            a.append(np.full(len(later), node[i]))
            b.append(node[later])
        return np.concatenate(a), np.concatenate(b)

    def small_groups(node, root, n, bits, starts, sizes) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of many groups of up to FEW nodes at once."""
        nodes = Nodes(n, bits, percent)
        xs, ys = [], []
        for gap in range(1, int(sizes.max(initial=1))):
            x = np.arange(len(node) - gap)
            group = np.repeat(np.arange(len(sizes)), sizes)
            same = (group[x] == group[x + gap]) & (root[x] != root[x + gap])
            xs.append(x[same])
            ys.append(x[same] + gap)
        if not xs:
            return node[:0], node[:0]
        x, y = np.concatenate(xs), np.concatenate(ys)
        ok = nodes.near(x, y)
        return node[x[ok]], node[y[ok]]

    def run(batches):
        kept: list[pa.RecordBatch] = []  # rows of the signature that the last batch ended in
        for batch in batches:
            kept.append(batch)
            last = batch.column(0)[batch.num_rows - 1].as_py() if batch.num_rows else None
            if last is None or (batch.column(0)[0].as_py() == last and batch.num_rows):
                continue  # the signature may go on
            table = pa.Table.from_batches(kept).combine_chunks()
            sig = table.column(0).to_numpy()
            whole = int(np.searchsorted(sig == last, True))
            yield from done(table.slice(0, whole))
            kept = table.slice(whole).to_batches()
        if kept:
            yield from done(pa.Table.from_batches(kept).combine_chunks())
        del kept
        release()

    def done(table: pa.Table):
        if not table.num_rows:
            return
        sig, node, root, n = (table.column(i).to_numpy() for i in range(4))
        bits = table.column(4).to_pylist()
        starts = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(sig)))
        small = np.repeat(sizes <= FEW, sizes)
        at = np.flatnonzero(small)
        parts = []
        if len(at):
            few = sizes[sizes <= FEW]
            parts.append(small_groups(
                node[at], root[at], n[at], [bits[i] for i in at.tolist()], offsets(few)[:-1], few
            ))
        for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            if size > FEW:
                part = slice(start, start + size)
                parts.append(of_group(node[part], root[part], n[part], bits[part]))
        a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    found = shared.repartition("sig").sortWithinPartitions("sig").select(
        "sig", "node", "root", "n", "parity"
    ).mapInArrow(run, "a long, b long")
    return found.distinct()


def segment_signatures(values, bounds, rows, percent):
    """Signatures of the sets ``rows``: all in one array, how many each has, and how many
    of these, at the end, are weak."""
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.diff(bounds)[rows]
    starts, segments, deletes = band_tables(int(sizes.max()), percent)
    band = np.searchsorted(starts, sizes, "right") - 1
    token_row = np.repeat(np.arange(len(rows)), sizes)
    where = np.repeat(bounds[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    token = values[where]
    spread, weight = mix64(token ^ np.uint64(0x9E3779B97F4A7C15)), mix64(token + np.uint64(77))
    low = (weight & np.uint64(0xFFFFFFFF)).astype(np.float64)
    high = (weight >> np.uint64(32)).astype(np.float64)
    owners, found, is_weak = [], [], []
    for step in (0, 1):  # as the larger set, and as the smaller one of a pair
        k = band + step
        m = segments[k]
        base = np.cumsum(m) - m
        cell = base[token_row] + (spread % m.astype(np.uint64)[token_row]).astype(np.int64)
        cells = int(m.sum())
        count = np.bincount(cell, minlength=cells)
        # Sums of up to 2**21 numbers below 2**32 are exact in double precision.
        sums = _join_halves(
            np.bincount(cell, low, minlength=cells), np.bincount(cell, high, minlength=cells)
        )
        owner = np.repeat(np.arange(len(rows)), m)
        place = mix64(
            ((np.arange(cells) - base[owner]).astype(np.uint64) << np.uint64(20))
            + k[owner].astype(np.uint64)
        )
        exact = mix64(mix64(sums + place) + count.astype(np.uint64))
        long_form = ~deletes[k]
        small = (count <= 1) & long_form[owner]
        n_small = np.bincount(owner[small], minlength=len(rows))
        near = np.maximum(FIRST_SEGMENTS, m // FIRST_PART)
        wild = n_small * 3 > np.minimum(near, m)
        weak = small & ~wild[owner]
        owners += [owner[~weak], owner[weak]]
        found += [exact[~weak], exact[weak]]
        is_weak += [np.zeros(int((~weak).sum()), bool), np.ones(int(weak.sum()), bool)]
        use = (deletes[k] | (n_small > 0))[token_row]
        # In the long form a deletion leaves at least two shingles.
        in_first = (cell - base[token_row]) < near[token_row]
        use &= deletes[k][token_row] | ((count[cell] > 2) & in_first)
        c = cell[use]
        rest = mix64(mix64(sums[c] - weight[use] + place[c]) + (count[c] - 1).astype(np.uint64))
        owners.append(token_row[use])
        found.append(rest)
        is_weak.append(np.zeros(len(rest), bool))
    owner, sig, weak = np.concatenate(owners), np.concatenate(found), np.concatenate(is_weak)
    order = np.lexsort((weak, owner))
    per = np.bincount(owner, minlength=len(rows))
    return sig[order], per, np.bincount(owner[weak], minlength=len(rows))


def prefix_signatures(values, bounds, rows, percent, frequent):
    """As :func:`segment_signatures`: the first shingles of each set, those of ``frequent`` last."""
    spread = mix64(values ^ np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(frequent)
    known = frequent[order]
    turn = np.zeros(len(values), np.int64)  # 0: not frequent; the most frequent one comes last
    if len(known):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        turn = np.where(known[at] == values, len(known) - order[at], 0)
    found, per, weak = [np.zeros(0, np.uint64)], [], []
    for i in rows:
        here = slice(bounds[i], bounds[i + 1])
        n = int(bounds[i + 1] - bounds[i])
        as_larger = n - -(-percent * n // 100) + 1
        as_smaller = n - -(-2 * percent * n // (100 + percent)) + 1
        often = turn[here] > 0
        rare = spread[here][~often]
        if as_larger < len(rare):
            rare = np.partition(rare, as_larger - 1)[:as_larger]
        rare.sort()
        late = np.argsort(turn[here][often])[: as_larger - len(rare)]
        found += [rare, spread[here][often][late]]
        per.append(as_larger)
        weak.append(as_larger - as_smaller)
    return np.concatenate(found), np.array(per, np.int64), np.array(weak, np.int64)


def _join_halves(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets link; ``sets`` has ``(node, members)``."""

    def work():
        def handle(part: pa.RecordBatch) -> list:
            good = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            return [part.column(0).filter(keep), part.column(1).filter(keep)]

        return handle

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("of_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b")
    return map_slices(both, work, "a long, b long", column=3)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root is the least node reached.

    Alternates the large-star and small-star steps, each written below ``folder``, until
    nothing changes.
    """
    spark = edges.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if large:
            least = both.groupBy("a").agg(F.min("b").alias("m"))
            linked = both.join(least, "a").where(F.col("b") > F.col("a"))
            return linked.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        down = both.where(F.col("b") < F.col("a"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        near = down.join(least, "a")
        kept = near.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return kept.union(least.select("a", F.col("m").alias("b")))

    def state(e: DataFrame) -> tuple:
        row = e.agg(
            F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1000003)
        ).first()
        return tuple(row)

    edges = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct(), "edges",
    )
    before, turn = state(edges), 0
    while before[0]:
        larger = star(edges, True).where("a <> b").distinct()
        edges = written(star(larger, False).where("a <> b").distinct(), f"turn{turn}")
        now = state(edges)
        turn += 1
        if now == before:
            break
        before = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    tops = edges.select(F.col("b").alias("node")).distinct().join(
        roots.select(F.col("a").alias("node")), "node", "left_anti"
    )
    return roots.withColumnRenamed("a", "node").union(tops.select("node", F.col("node").alias("root")))


def linked_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
    percent: int = 90,
) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` for every row of ``df``."""
    spark = df.sparkSession
    folder = scratch_path(spark, "jaccard")

    def written(part: DataFrame, name: str) -> DataFrame:
        part.write.parquet(f"{folder}/{name}")
        return spark.read.schema(part.schema).parquet(f"{folder}/{name}")

    frequent = None
    if percent < PREFIX_PERCENT:
        most = frequent_shingles(df, text_col, width).collect()
        frequent = np.array([r.shingle for r in most], np.int64).view(np.uint64)
    signed = written(signatures(df, id_col, text_col, width, percent, frequent), "signed")
    rows = signed.where("sigs is not null and n > 0").select(
        "node", F.posexplode("sigs").alias("place", "sig"), "weak", F.size("sigs").alias("total")
    ).select("sig", "node", (F.col("place") >= F.col("total") - F.col("weak")).alias("weak"))
    # Groups of equal signatures with at least two nodes, not all of them weak.
    group = Window.partitionBy("sig")
    shared = written(
        rows.select(
            "sig", "node", F.min("node").over(group).alias("least"),
            F.max("node").over(group).alias("most"), F.min("weak").over(group).alias("all_weak"),
        ).where("least <> most and not all_weak").select("sig", "node").distinct(), "shared",
    )
    # Tables that later steps do not read would only take up the disk.
    index = written(signed.drop("sigs", "weak"), "index")
    remove(spark, f"{folder}/signed")
    traits = index.where("parity is not null").groupBy("node").agg(
        F.first("n").alias("n"), F.first("parity").alias("parity")
    )
    # A node goes by its least id, so that the least node of a group names it.
    least = written(
        index.where("n > 0").groupBy("node").agg(F.min("id").alias("id")).select(
            "node", F.struct(F.col("id").isNull().alias("bare"), "id", "node").alias("key")
        ), "least",
    )
    links = sets = tested = final = None
    for turn, some in enumerate((1, SOME, None)):
        if turn:
            now = shared.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
            apart = now.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"))
            now = now.join(apart.where("x <> y").select("sig"), "sig", "left_semi")
        else:
            now = shared.join(traits, "node").withColumn("root", F.col("node"))
        pairs = pairs_within(now, percent, some)
        if turn:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, f"pairs{turn}")
        if not turn:
            # Every node that may link with another one is in a pair of the first turn.
            wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            few = traits.join(wanted, "node", "left_semi")
            shared = written(shared.join(few, "node"), "near")
            remove(spark, f"{folder}/shared")
            sets = written(_sets(df, id_col, text_col, least, wanted, width), "sets")
        found = verified(pairs, sets, percent)
        for side in ("a", "b"):
            named = least.select(F.col("node").alias(side), F.col("key").alias(f"{side}_key"))
            found = found.join(named, side)
        found = written(
            found.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")), f"links{turn}"
        )
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        if turn == 0 or not found.isEmpty():
            final = written(
                components(links, f"{folder}/groups{turn}").select(
                    "node.node", F.col("root.node").alias("root"), F.col("root.id").alias("name")
                ), f"final{turn}",
            )
    for name in ("near", "sets", *(f"{part}{turn}" for part in ("pairs", "links", "groups") for turn in range(3))):
        remove(spark, f"{folder}/{name}")
    named = least.join(final, "node", "left").select(
        "node", F.when(F.col("root").isNull(), F.col("key.id")).otherwise(F.col("name")).alias("component_id")
    )
    full = index.where("n > 0").join(named, "node").select("id", "n", "component_id")
    empty = index.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.union(empty).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"
    )


def _sets(
    df: DataFrame, id_col: str, text_col: str, least: DataFrame, wanted: DataFrame, width: int
) -> DataFrame:
    """``(node, members)`` of the wanted nodes: the sorted shingle hashes, packed.

    A node's text is read by the least id that has it. Other texts are passed over by a test of their
    ids where they lie, so that no exchange carries them; texts of rows without an id are all
    hashed again to find the nodes among them.
    """
    holders = least.join(wanted, "node", "left_semi").where("not key.bare").select("key.id")
    asked = marks(holders, "id")

    def work():
        shingles = Shingles(width)

        def handle(part: pa.RecordBatch) -> list:
            at = part.column(0)  # null: no id
            part = part.filter(pc.or_(marked(asked.value, at.fill_null(0)), at.is_null()))
            values, bounds = shingles.sets(part.column(1).cast(pa.binary()).to_pylist())
            names = _node(values, bounds).view(np.int64)
            members = [
                values[a:b].astype("<u8").tobytes()
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
            ]
            return [pa.array(names), pa.array(members, pa.binary())]

        return handle

    source = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    at = F.when(F.col("id").isNotNull(), mark(F.col("id")))
    hashed = map_slices(source.select(at.alias("at"), "text"), work, "node long, members binary")
    return hashed.join(wanted, "node", "left_semi").dropDuplicates(["node"])
