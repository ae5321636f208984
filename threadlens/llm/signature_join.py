"""N-gram Jaccard self-join with signature trees, exact to the pair.

Texts with equal shingle sets are one class. Classes meet in buckets: two sets
similar enough share one of their first shingles, in an order that all sets
agree on (rare ones first, so that a passage of many texts makes no bucket).
Buckets with the same members are one.

In each bucket the classes are the leaves' rows of signature trees, one for
each bitmap width. A row's bitmap has a bit for each shingle's hash; a node
holds its rows' bitmaps combined by OR, their range of sizes and the most
shingles that share bits. Both bound the overlap of any two rows below a pair
of nodes, and a dual traversal leaves out pairs of nodes whose bound is too
low, or whose rows are all connected already. Three traversals:

1. propose: row pairs that pass become proposals, unless earlier ones connect
   them, most overlap first; proposals are verified on the full texts. A bucket
   whose proposals all hold is done, as its tree was searched whole. The other
   buckets follow with the rows that still have somebody to meet in them.
2. Buckets above BLOCK rows are cut into random blocks for that, anew in each
   of ROUNDS rounds.
3. rest: of the buckets left, rows that could link with another component are
   marked, and only these bring their texts to a last traversal that checks
   every pair of different components on the full sets. Of buckets above BLOCK
   rows, all blocks outside the largest component meet all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm import textnum
from threadlens.llm.components import connected_components, joined_components
from threadlens.llm.near_dedup import shingle_sets
from threadlens.llm.staging import bound_batches, stage, thinned, unstage

#: Counters of a task, what it sends of them, and frequent shingles that are told apart.
COUNTERS = 1 << 18
SENT = 1 << 14
FREQUENT = 1 << 17
LEAST_FREQUENT = 16
#: Rows of a bucket that one task holds, and about the bytes of a group of small buckets.
BLOCK = 512
GROUP_BYTES = 1 << 20
ROUNDS = 2
#: Up to so many rows of a bucket are asked whom they have yet to meet; of larger ones all rows stay.
ASKED = 4096
LEAF = 16
FANOUT = 8
LEAST_BITS = 64
MOST_BITS = 1 << 20


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t1, t2, text): t1 and t2 name the text; null is empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return bound_batches(docs).select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), text.alias("text"))


def _heaviest(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` counters: the next largest count is taken from all, what is left stays."""
    if len(keys) <= most:
        return keys, counts
    counts = counts - np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
    return keys[counts > 0], counts[counts > 0]


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, sorted, and their ranks from 1 by frequency.

    Tasks count with COUNTERS decrementing counters (a count is at most
    1 / COUNTERS of the task's shingles too low) and send the SENT largest.
    The result only orders shingles: a miss costs time, never a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting, held = [], 0

        def merge() -> None:
            nonlocal keys, counts, waiting, held
            every = np.concatenate([keys, *waiting])
            more = np.concatenate([counts, np.ones(held, np.int64)])
            order = np.argsort(every, kind="stable")
            every, more = every[order], more[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            sums = np.add.reduceat(more, first) if len(first) else more
            keys, counts = _heaviest(every[first], sums, COUNTERS)
            waiting, held = [], 0

        for batch in batches:
            for chunk in textnum.chunks(batch.column(0)):
                waiting += shingle_sets(chunk)
                held += sum(len(s) for s in waiting[-(chunk.last - chunk.first) :])
                if held > 4 * COUNTERS:
                    merge()
        merge()
        most = np.argsort(-counts, kind="stable")[:SENT]
        most = most[counts[most] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(keys[most].view(np.int64)), pa.array(counts[most])], ["shingle", "n"])

    sent = texts.select("text").mapInArrow(run, "shingle long, n long")
    top = sent.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_FREQUENT).orderBy(F.desc("n"), "shingle").limit(FREQUENT)
    found = top.toArrow()
    keys, counts = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, counts))] = np.arange(1, len(keys) + 1)
    order = np.argsort(keys)
    return keys[order], rank[order]


def prefixes(sets: list[np.ndarray], percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The first shingles of each set, rare ones first, as many as two linked sets can't both miss."""
    keys, ranks = frequent
    out = []
    for s in sets:
        p = len(s) + (len(s) * percent) // -100 + 1 if len(s) else 0
        if len(keys) and len(s):
            at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
            rank = np.where(keys[at] == s, ranks[at], 0)
            if rank.any():
                out.append(s[np.lexsort((s, rank))[:p]])
                continue
        out.append(s[:p])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of two bits a shingle or more, a power of two, as 64-bit words."""
    bits = LEAST_BITS
    while bits < min(2 * len(shingles), MOST_BITS):
        bits *= 2
    at = textnum.mix(shingles) & np.uint64(bits - 1)
    words = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words


def _described(percent: int, frequent: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in textnum.chunks(batch.column(3)):
            sets = shingle_sets(chunk)
            none = np.array([len(s) == 0 for s in sets])
            digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            first = prefixes(sets, percent, frequent)
            part = batch.slice(chunk.first, len(sets))
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(i) for i in range(3)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary(), mask=none),
                    pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64(), mask=none),
                    pa.array([signature(s).tobytes() for s in sets], pa.binary(), mask=none),
                    pa.array([p.view(np.int64) for p in first], pa.list_(pa.int64())),
                ],
                ["doc_id", "t1", "t2", "n", "class", "c", "sig", "keys"],
            )


# --- signature trees ---------------------------------------------------------------

@dataclass
class Node:
    """Rows [first, last) of its tree, and what bounds their overlap with others."""

    first: int
    last: int
    bits: np.ndarray
    least: int
    most: int
    spare: int  # most shingles of a row beyond its bits
    children: list[Node] = field(default_factory=list)


class Tree:
    """Rows of one bitmap width, in order of component and size."""

    def __init__(self, rows: np.ndarray, bits: np.ndarray, n: np.ndarray):
        self.rows, self.bits, self.n = rows, bits, n
        self.spare = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        level = [self._leaf(a, min(a + LEAF, len(rows))) for a in range(0, len(rows), LEAF)]
        while len(level) > 1:
            level = [self._above(level[a : a + FANOUT]) for a in range(0, len(level), FANOUT)]
        self.root = level[0]

    def _leaf(self, a: int, b: int) -> Node:
        n = self.n[a:b]
        return Node(a, b, np.bitwise_or.reduce(self.bits[a:b], axis=0), int(n.min()), int(n.max()), int(self.spare[a:b].max()))

    def _above(self, below: list[Node]) -> Node:
        bits = np.bitwise_or.reduce([c.bits for c in below], axis=0)
        return Node(below[0].first, below[-1].last, bits, min(c.least for c in below), max(c.most for c in below), max(c.spare for c in below), below)

    def folded(self) -> Tree:
        """The same rows with bitmaps of half the width."""
        half = self.bits.shape[1] // 2
        return Tree(self.rows, self.bits[:, :half] | self.bits[:, half:], self.n)


class Traversal:
    """Row pairs of a bucket that could be linked, handed to ``meet`` leaf by leaf.

    ``label`` names the rows' components; ``meet`` may merge labels. Rows of
    sides 1 and 2 meet the other side alone, rows of side 0 meet all. Rows that
    share a bucket in ``before`` (rows x buckets) have met there.
    """

    def __init__(self, percent: int, n: np.ndarray, label: np.ndarray, side: np.ndarray, before: np.ndarray, meet: Callable[[np.ndarray, np.ndarray], None]):
        self.percent, self.n, self.label, self.side, self.before, self.meet = percent, n, label, side, before, meet

    def run(self, rows: np.ndarray, signatures: list[bytes]) -> None:
        rows = rows[np.lexsort((self.n[rows], self.label[rows]))]
        width = np.array([len(signatures[i]) for i in rows])
        trees: dict[int, Tree] = {}
        for w in np.unique(width).tolist():
            own = rows[width == w]
            bits = np.frombuffer(b"".join(signatures[i] for i in own), np.uint64).reshape(len(own), -1)
            trees[w] = Tree(own, bits, self.n[own])
        for w, tree in trees.items():
            self._within(tree, tree.root)
            if 2 * w in trees:  # linked sizes differ by less than a factor of two
                self._between(tree, tree.root, (wide := trees[2 * w].folded()), wide.root)

    def _connected(self, s: Tree, a: Node, t: Tree, b: Node) -> bool:
        x = self.label[s.rows[a.first]]
        return bool((self.label[s.rows[a.first : a.last]] == x).all() and (self.label[t.rows[b.first : b.last]] == x).all())

    def _apart(self, a: Node, b: Node) -> bool:
        p = self.percent
        if a.most * 100 < b.least * p or b.most * 100 < a.least * p:
            return True
        overlap = min(int(np.bitwise_count(a.bits & b.bits).sum(dtype=np.int64)) + min(a.spare, b.spare), a.most, b.most)
        return overlap * (100 + p) < (a.least + b.least) * p

    def _within(self, tree: Tree, a: Node) -> None:
        if self._connected(tree, a, tree, a):
            return
        if not a.children:
            self._rows(tree, a, tree, a)
        for k, c in enumerate(a.children):
            self._within(tree, c)
            for d in a.children[:k]:
                self._between(tree, c, tree, d)

    def _between(self, s: Tree, a: Node, t: Tree, b: Node) -> None:
        if self._apart(a, b) or self._connected(s, a, t, b):
            return
        if a.children and (not b.children or a.last - a.first >= b.last - b.first):
            for c in a.children:
                self._between(s, c, t, b)
        elif b.children:
            for c in b.children:
                self._between(s, a, t, c)
        else:
            self._rows(s, a, t, b)

    def _rows(self, s: Tree, a: Node, t: Tree, b: Node) -> None:
        p = self.percent
        x, y = slice(a.first, a.last), slice(b.first, b.last)
        i, j = s.rows[x], t.rows[y]
        overlap = np.bitwise_count(s.bits[x][:, None, :] & t.bits[y][None, :, :]).sum(axis=2, dtype=np.int64)
        overlap += np.minimum(s.spare[x][:, None], t.spare[y][None, :])
        n, m = self.n[i][:, None], self.n[j][None, :]
        could = (overlap * (100 + p) >= (n + m) * p) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * p)
        could &= self.label[i][:, None] != self.label[j][None, :]
        side, other = self.side[i][:, None], self.side[j][None, :]
        could &= (side == 0) | (side != other)
        if self.before.shape[1] and could.any():
            could &= self.before[i] @ self.before[j].T == 0
        if a is b:
            could = np.triu(could, 1)
        u, v = np.nonzero(could)
        if len(u):
            order = np.argsort(-overlap[u, v] / (n[u, 0] + m[0, v]), kind="stable")
            self.meet(i[u][order], j[v][order])


def _buckets(table: pa.Table) -> Iterator[tuple[int, int]]:
    """Runs of equal keys of a table sorted by key."""
    key = table.column("key").to_numpy()
    edges = np.flatnonzero(np.diff(key)) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(key)] if len(key) else [])


def _before(table: pa.Table, first: int, last: int) -> np.ndarray:
    """Which earlier buckets the rows of a bucket are in, as 0 or 1."""
    column = table.column("own").slice(first, last - first).combine_chunks()
    flat = column.flatten().to_numpy()
    keys, at = np.unique(flat, return_inverse=True)
    out = np.zeros((last - first, len(keys)), np.float32)
    out[np.repeat(np.arange(last - first), np.diff(column.offsets.to_numpy())), at] = 1
    return out


def _unmet(percent: int, table: pa.Table) -> pa.Table:
    """(key, c): the rows that could be linked, by their sizes, with one they haven't met."""
    table = table.sort_by("key")
    n = table.column("n").to_numpy()
    label = np.unique(np.array(table.column("root").to_pylist(), dtype=object), return_inverse=True)[1] if len(n) else n
    stays = np.zeros(len(n), bool)
    for first, last in _buckets(table):
        if last - first > ASKED:
            stays[first:last] = True
            continue
        before, size, own = _before(table, first, last), n[first:last], label[first:last]
        for a in range(0, last - first, 512):
            x = slice(a, a + 512)
            some = (before[x] @ before.T == 0) & (own[x][:, None] != own[None, :])
            some &= np.minimum(size[x][:, None], size[None, :]) * 100 >= np.maximum(size[x][:, None], size[None, :]) * percent
            stays[first:last][x] = some.any(axis=1)
    return table.filter(pa.array(stays)).select(["key", "m", "c"])


def _arrays(table: pa.Table) -> tuple:
    table = table.sort_by("key")
    roots = {r: k for k, r in enumerate(sorted(set(table.column("root").to_pylist())))}
    label = np.array([roots[r] for r in table.column("root").to_pylist()], np.int64)
    return table, table.column("n").to_numpy(), label, table.column("side").to_numpy(), table.column("sig").to_pylist()


def _walk(percent: int, table: pa.Table, n: np.ndarray, label: np.ndarray, side: np.ndarray, signatures: list, first: int, last: int, meet) -> None:
    """Traverse rows [first, last), a bucket; ``meet`` gets row numbers of the table."""
    own = slice(first, last)
    walk = Traversal(percent, n[own], label[own], side[own], _before(table, first, last), lambda i, j: meet(i + first, j + first))
    walk.run(np.arange(last - first), signatures[own])


def _proposals(percent: int, table: pa.Table) -> pa.Table:
    """(key, a, b): pairs that would connect the classes that could be linked."""
    table, n, label, side, signatures = _arrays(table)
    classes, keys = table.column("class").to_pylist(), table.column("key").to_numpy()
    out: list[tuple] = []
    for first, last in _buckets(table):

        def meet(i: np.ndarray, j: np.ndarray) -> None:
            part = label[first:last]
            for x, y in zip(i.tolist(), j.tolist()):
                if label[x] != label[y]:
                    out.append((int(keys[x]), min(classes[x], classes[y]), max(classes[x], classes[y])))
                    part[part == label[y]] = label[x]

        _walk(percent, table, n, label, side, signatures, first, last, meet)
    return pa.table({"key": pa.array([o[0] for o in out], pa.int64()), "a": pa.array([o[1] for o in out], pa.binary()), "b": pa.array([o[2] for o in out], pa.binary())})


def _marked(percent: int, table: pa.Table) -> pa.Table:
    """The rows that could be linked with a row of another component."""
    table, n, label, side, signatures = _arrays(table)
    live = np.zeros(len(n), bool)

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        live[i] = live[j] = True

    for first, last in _buckets(table):
        _walk(percent, table, n, label, side, signatures, first, last, meet)
    return table.filter(pa.array(live)).select(["key", "i", "j", "side", "class", "root", "n", "sig", "own"])


def _checked(percent: int, table: pa.Table) -> pa.Table:
    """(a, b): links between different components, found on the full sets."""
    table, n, label, side, signatures = _arrays(table)
    classes = table.column("class").to_pylist()
    sets = [s for chunk in textnum.chunks(table.column("text")) for s in shingle_sets(chunk)]
    out: list[tuple] = []
    for first, last in _buckets(table):

        def meet(i: np.ndarray, j: np.ndarray) -> None:
            part = label[first:last]
            for x, y in zip(i.tolist(), j.tolist()):
                if label[x] != label[y] and _linked(percent, sets[x], sets[y]):
                    out.append((min(classes[x], classes[y]), max(classes[x], classes[y])))
                    part[part == label[y]] = label[x]

        _walk(percent, table, n, label, side, signatures, first, last, meet)
    return pa.table({"a": pa.array([o[0] for o in out], pa.binary()), "b": pa.array([o[1] for o in out], pa.binary())})


def _linked(percent: int, x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


# --- the join ----------------------------------------------------------------------

def _group(rows: DataFrame, weight, function, schema: str) -> DataFrame:
    """``function`` of groups: each block of a large bucket (i >= 0), and small buckets together up to about GROUP_BYTES."""
    total = rows.filter("i < 0").agg(F.sum(weight + 256)).first()[0] or 0
    groups = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // GROUP_BYTES))))
    dealt = rows.withColumn("x", F.when(F.col("i") < 0, groups).otherwise(F.col("key")))
    return dealt.groupBy("x", "i", "j").applyInArrow(function, schema)


def _propose(percent: int, rows: DataFrame, turn: int) -> DataFrame:
    """(key, a, b) from whole small buckets and from random blocks of large ones (key, m, class, root, n, sig, own)."""
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    block = F.when(F.col("m") <= BLOCK, -1).otherwise(F.pmod(F.xxhash64("class", "key", F.lit(turn)), blocks).cast("int"))
    rows = rows.select("key", "class", "root", "n", "sig", "own", block.alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"))
    return stage(_group(rows, F.octet_length("sig"), lambda t: _proposals(percent, t), "key long, a binary, b binary"), "proposals")


def _verify_rows(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last_text, last_set = None, None
    for batch in batches:
        for part in (batch.slice(at, 64) for at in range(0, len(batch), 64)):
            keep = []
            other = [s for chunk in textnum.chunks(part.column(3)) for s in shingle_sets(chunk)]
            for text, y in zip(part.column(2).to_pylist(), other):
                if text != last_text:
                    last_text = text
                    (chunk,) = textnum.chunks(pa.array([text]))
                    (last_set,) = shingle_sets(chunk)
                keep.append(_linked(percent, last_set, y))
            yield part.filter(pa.array(keep, pa.bool_())).select([0, 1])


def _fetch(wanted: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(class, text) of the ``wanted`` classes."""
    names = stage(classes.select("class", "t1", "t2").join(wanted.distinct(), "class"), "wanted-classes")
    # Copies of a text are one before the join, and meet by the columns that it deals by.
    near = thinned(texts.select("t1", "t2", "text"), names, "t1").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    return stage(near.join(names, ["t1", "t2"]).select("class", "text"), "wanted-texts")


def _verify(percent: int, pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links on the full sets of their texts."""
    pairs = stage(pairs.select("a", "b").distinct(), "pairs")
    found = _fetch(pairs.select(F.explode(F.array("a", "b")).alias("class")), classes, texts)
    a, b = (found.select(F.col("class").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
    links = stage(joined.mapInArrow(partial(_verify_rows, percent), "a binary, b binary"), "verified")
    unstage(found)
    return links


def _rest(percent: int, rows: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """All links between components that the buckets (key, m, class, root, n, sig, own) still hold."""
    base = ["key", "class", "root", "n", "sig", "own"]
    small = rows.filter(F.col("m") <= BLOCK).select(*base, F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"))
    large = rows.filter(F.col("m") > BLOCK)
    sizes = large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("r")).groupBy("key").agg(F.max(F.struct("r", "root")).alias("main"))
    large = large.join(sizes, "key").withColumn("is_main", F.col("root") == F.col("main.root")).withColumn("others", F.col("m") - F.col("main.r"))
    half = F.lit(BLOCK // 2)
    parts = F.greatest(F.ceil(F.col("others") / half), F.lit(1)).cast("int")
    mains = F.greatest(F.ceil(F.col("main.r") / half), F.lit(1)).cast("int")
    part, block = F.pmod(F.xxhash64("class"), parts).cast("int"), F.pmod(F.xxhash64("class"), mains).cast("int")
    # Blocks of other components meet each other, and each block of the main one (j beyond any part).
    apart = large.filter("not is_main").withColumn("mine", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    apart = apart.select(*base, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"))
    beyond = F.lit(1 << 30)
    outer = large.filter("not is_main").select(*base, part.alias("i"), F.explode(F.sequence(beyond, beyond + mains - 1)).alias("j"), F.lit(1).alias("side"))
    inner = large.filter("is_main").select(*base, F.explode(F.sequence(F.lit(0), parts - 1)).alias("i"), (block + beyond).alias("j"), F.lit(2).alias("side"))
    blocks = small.unionByName(apart).unionByName(outer).unionByName(inner)
    live = _group(blocks, F.octet_length("sig"), lambda t: _marked(percent, t), "key long, i int, j int, side int, class binary, root binary, n long, sig binary, own array<long>")
    live = stage(live, "live-rows")
    found = _fetch(live.select("class"), classes, texts)
    links = stage(_group(live.join(found, "class"), F.octet_length("text"), lambda t: _checked(percent, t), "a binary, b binary").distinct(), "rest-links")
    unstage(found)
    return links


def signature_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two rows are linked if the Jaccard similarity of their sets of five-word
    shingles is ``percent`` or more; every link is found or implied by others.
    A null or empty text, or one of white space only, has no shingles and is
    linked with nothing: its component is its own id. A row with a null id can
    be linked, but a component's id is null only if all its ids are. Rows that
    repeat an id are judged by their own texts. An empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50: linked sets differ in size by less than a factor of two")
    texts = _texts(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    frequent = frequent_shingles(texts)
    rows = stage(
        texts.mapInArrow(partial(_described, percent, frequent), f"doc_id {kind}, t1 long, t2 long, n long, class binary, c long, sig binary, keys array<long>"),
        "described",
    )
    classes = rows.filter("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("c").alias("c"), F.min(F.struct("t1", "t2")).alias("t"), F.first("sig").alias("sig"), F.first("keys").alias("keys")
    )
    classes = stage(classes.select("class", "rep", "n", "c", "t.t1", "t.t2", "sig", "keys"), "classes")
    described, rows = rows, stage(rows.select("doc_id", "n", "class"), "row-classes")
    unstage(described)
    # Buckets name classes by half their digest; where two share it, both come.
    exploded = classes.select("c", F.explode("keys").alias("key"))
    shared = stage(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared-keys")
    members = stage(thinned(exploded, shared, "key").join(shared, "key"), "members")
    keyed, classes = classes, stage(classes.drop("keys"), "classes-without-keys")
    unstage(keyed)
    same = members.groupBy("key", "m").agg(F.bit_xor(F.xxhash64("c")).alias("f1"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("f2"))
    kept = stage(same.groupBy("m", "f1", "f2").agg(F.min("key").alias("key")).select("key"), "kept-keys")
    buckets = stage(members.join(kept, "key"), "buckets")
    unstage(members)
    least = buckets.groupBy("c").agg(F.min("key").alias("key")).select("key").distinct()
    buckets = stage(buckets.join(least.withColumn("chosen", F.lit(True)), "key", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False))), "chosen-keys")
    met = buckets.filter("chosen").groupBy("c").agg(F.collect_set("key").alias("met"))
    described = stage(classes.select("class", "c", "n", "sig").join(met, "c"), "members-described")

    def rows_of(some: DataFrame, chosen: bool) -> DataFrame:
        own = F.filter("met", lambda k: k < F.col("key")) if chosen else F.col("met")
        return some.join(described, "c").select("key", "m", "class", "n", "sig", own.alias("own"))

    first = rows_of(buckets.filter("chosen"), True)
    links, open_first = _linked_buckets(percent, first.withColumn("root", F.col("class")), classes, texts)
    roots = connected_components(links)
    # Whoever has somebody to meet beyond the chosen buckets.
    narrow = _labelled(buckets.filter("not chosen").join(described.drop("sig"), "c").select("key", "m", "c", "class", "n", F.col("met").alias("own")), roots)
    asked = narrow.select("key", "m", "c", "root", "n", "own", F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    unmet = _group(asked, F.size("own") * 8, lambda t: _unmet(percent, t), "key long, m long, c long").distinct()
    second = stage(_labelled(rows_of(unmet, False), roots), "second-rows")
    more, open_second = _linked_buckets(percent, second, classes, texts)
    roots = joined_components(roots, more)
    # Signatures join the open buckets' rows alone.
    left = rows_of(buckets.filter("chosen").join(open_first, "key"), True)
    left = stage(left.unionByName(second.drop("root").join(open_second, "key")), "buckets-left")
    for turn in range(1, ROUNDS + 1):
        mixed = _mixed(left, roots)
        large = mixed.filter(F.col("m") > BLOCK)
        if turn == ROUNDS or large.isEmpty():
            break
        roots = joined_components(roots, _verify(percent, _propose(percent, large, turn), classes, texts))
    if not mixed.isEmpty():
        roots = joined_components(roots, _rest(percent, mixed, classes, texts))
    named = classes.select("class", "rep").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = stage(named.groupBy("root").agg(F.min("rep").alias("component_id")), "component-ids")
    by_class = stage(named.join(least, "root").select("class", "component_id"), "class-components")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n", "class").join(by_class, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with their class's component as ``root``."""
    return rows.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def _linked_buckets(percent: int, rows: DataFrame, classes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links of the buckets' proposals, and the keys of buckets that may hold more."""
    proposals = _propose(percent, rows, 0)
    links = _verify(percent, proposals, classes, texts)
    failed = proposals.join(links, ["a", "b"], "left_anti").select("key")
    return links, stage(failed.unionByName(rows.filter(F.col("m") > BLOCK).select("key")).distinct(), "open-keys")


def _mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, m, class, root, n, sig, own) of the buckets that hold several components."""
    labelled = stage(_labelled(rows, roots), "labelled")
    several = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    return stage(labelled.join(several, "key"), "mixed")
