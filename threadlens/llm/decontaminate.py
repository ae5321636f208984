"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item's windows are its runs of 13 words (or the whole item if it
is shorter). A window's tokens are its shingles of three words (fewer if the
window is shorter); a document contains a window only if it contains all its
shingles. So with shingles ordered by rarity, counted over all documents, the
necessary prefix of a window is its one rarest shingle, and a document joins a
window only through that. A hit at word p of a document, for a prefix at word
j of the window, fixes the window's place: the positional bound is p - j >= 0
and the length bound p - j + |window| <= document words. What passes is
verified word by word over the item-sized window.

The documents never move. A benchmark of at most ``block_words`` words (about
15 bytes each) goes to the tasks as it is. Of a larger one, equal items are
taken once and long ones cut into parts that overlap by a window less a word;
the parts are dealt by a running sum of their words into blocks of less than
9/8 of ``block_words`` (or one window more), so what the driver and a task hold
has a fixed bound whatever repeats. Each block is joined with all documents;
the hits are united, and the items' ids joined with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm import textnum
from threadlens.llm.staging import bound_batches, free_name, stage

WINDOW = 13
SHINGLE = 3
BLOCK_WORDS = 1 << 20
FILTER_BITS = 22
RESULT = "decon"
RESULT_TYPE = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean>"


@dataclass
class Block:
    """Items as one array of word hashes, their distinct windows, and, once
    ``keys`` are known, the windows by prefix shingle."""

    words: np.ndarray
    names: list
    at: np.ndarray  # first word of each distinct window
    size: np.ndarray  # its words
    owner_ends: np.ndarray  # offsets into owners
    owners: np.ndarray  # items with that window

    prefix: np.ndarray | None = None  # word of the window at which its prefix shingle starts
    keys: np.ndarray | None = None  # sorted distinct prefix shingles
    key_ends: np.ndarray | None = None
    key_windows: np.ndarray | None = None


def _width(size: int) -> int:
    return min(SHINGLE, size)


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    return textnum.shingle_hashes(hashes, width) if len(hashes) >= width else np.zeros(0, np.uint64)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, values = [], []
        for chunk in textnum.chunks(batch.column(1)):
            starts, ends, offsets = textnum.words(chunk, textnum.ALNUM)
            hashes = textnum.word_hashes(chunk, starts, ends)
            values += [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(values, pa.binary()), pa.array([len(v) // 8 for v in values], pa.int64())],
            ["item_id", "words", "n"],
        )


def make_block(items: list[tuple], window: int) -> Block:
    """A block from (item_id, bytes of word hashes)."""
    names, parts = [x[0] for x in items], [np.frombuffer(x[1], np.uint64) for x in items]
    ends = np.cumsum([len(p) for p in parts])
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    at, size, owner = [], [], []
    for i, (end, part) in enumerate(zip(ends, parts)):
        n = min(window, len(part))
        starts = np.arange(end - len(part), end - n + 1)
        at.append(starts)
        size.append(np.full(len(starts), n))
        owner.append(np.full(len(starts), i))
    at, size, owner = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, size, owner))
    identity = np.zeros(len(at), np.uint64)
    for n in np.unique(size):
        mine = size == n
        identity[mine] = textnum.shingle_hashes(words, int(n))[at[mine]]
    _, first, group = np.unique(identity, return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    return Block(words, names, at[first], size[first], np.searchsorted(group[order], np.arange(len(first) + 1)), owner[order])


def block_shingles(block: Block) -> np.ndarray:
    """Sorted distinct shingles of all windows."""
    found = [np.zeros(0, np.uint64)]
    for width in range(1, SHINGLE + 1):
        mine = np.minimum(block.size, SHINGLE) == width
        if mine.any():
            hashes = textnum.shingle_hashes(block.words, width)
            for n in np.unique(block.size[mine]):
                at = block.at[block.size == n]
                found += [hashes[at + k] for k in range(int(n) - width + 1)]
    return np.unique(np.concatenate(found))


def choose_prefixes(block: Block, shingles: np.ndarray, frequency: np.ndarray) -> None:
    """Give each window its rarest shingle (ties: the smaller hash, then the first) and index the windows by it."""
    block.prefix = np.zeros(len(block.at), np.int64)
    chosen = np.zeros(len(block.at), np.uint64)
    for n in np.unique(block.size):
        mine = np.flatnonzero(block.size == n)
        width = _width(int(n))
        hashes = textnum.shingle_hashes(block.words, width)
        own = np.stack([hashes[block.at[mine] + k] for k in range(int(n) - width + 1)])
        rank = np.searchsorted(shingles, own)
        best = np.argmin(frequency[rank] * (len(shingles) + 1) + rank, axis=0)
        block.prefix[mine] = best
        chosen[mine] = own[best, np.arange(len(mine))]
    block.keys, group = np.unique(chosen, return_inverse=True)
    order = np.argsort(group, kind="stable")
    block.key_windows = order
    block.key_ends = np.searchsorted(group[order], np.arange(len(block.keys) + 1))


class _Lookup:
    """Positions of a chunk's shingles in a sorted array: a bit table first, then a search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[keys >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - FILTER_BITS)])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at] if len(self.keys) else np.zeros(0, bool)
        return at[same], key[same]


def _doc_shingles(hashes: np.ndarray, offsets: np.ndarray, widths: list[int], lookup: _Lookup) -> Iterator[tuple]:
    """(word, key, document) of each found shingle that lies within one document."""
    for width in widths:
        at, key = lookup.find(_shingles(hashes, width))
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + width <= offsets[doc + 1]
        yield at[inside], key[inside], doc[inside]


def shingle_frequencies(docs: DataFrame, text_col: str, shingles: np.ndarray, widths: list[int]) -> np.ndarray:
    """In how many documents each of the given shingles occurs; each task sends its sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = _Lookup(shingles), np.zeros(len(shingles), np.int64)
        for batch in batches:
            for chunk in textnum.chunks(batch.column(0)):
                starts, ends, offsets = textnum.words(chunk, textnum.ALNUM)
                hashes = textnum.word_hashes(chunk, starts, ends)
                pairs = [doc * len(shingles) + key for _, key, doc in _doc_shingles(hashes, offsets, widths, lookup)]
                total += np.bincount(np.unique(np.concatenate(pairs)) % len(shingles), minlength=len(shingles))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["shingle", "n"])

    out = np.zeros(len(shingles), np.int64)
    if len(shingles):
        sums = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "shingle long, n long")
        for r in sums.groupBy("shingle").agg(F.sum("n").alias("n")).collect():  # at most block_words rows
            out[r["shingle"]] = r["n"]
    return out


def find_windows(block: Block, lookup: _Lookup, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, window, document) of every occurrence of a window."""
    out = []
    for at, key, doc in _doc_shingles(hashes, offsets, _widths(block), lookup):
        n = block.key_ends[key + 1] - block.key_ends[key]
        each = np.repeat(np.arange(len(at)), n)
        window = block.key_windows[np.arange(len(each)) + np.repeat(block.key_ends[key] - (np.cumsum(n) - n), n)]
        start, doc = at[each] - block.prefix[window], doc[each]
        size = block.size[window]
        ok = (start >= offsets[doc]) & (start + size <= offsets[doc + 1])
        start, window, doc, size = start[ok], window[ok], doc[ok], size[ok]
        for k in range(int(size.max()) if len(size) else 0):
            same = (k >= size) | (hashes[np.minimum(start + k, len(hashes) - 1)] == block.words[np.minimum(block.at[window] + k, len(block.words) - 1)])
            start, window, doc, size = start[same], window[same], doc[same], size[same]
        out.append((start, window, doc))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out))


def _widths(block: Block) -> list[int]:
    return [int(w) for w in np.unique(np.minimum(block.size, SHINGLE))]


def _summary(n_words: int, n_hit: int, items: set) -> dict:
    names = sorted(items)
    return {
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": len(names),
        "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
        "contaminated": n_hit > 0 and 20 * n_hit >= n_words,
    }


def _judge(block: Block, text: pa.Array) -> Iterator[tuple[int, np.ndarray, set]]:
    """Per document: its words, the runs [start, end) of hit words, and the items found."""
    lookup = _Lookup(block.keys)
    for chunk in textnum.chunks(text):
        starts, ends, offsets = textnum.words(chunk, textnum.ALNUM)
        hashes = textnum.word_hashes(chunk, starts, ends)
        start, window, doc = find_windows(block, lookup, hashes, offsets)
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + block.size[window], -1)
        hit = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
        found: dict[int, set] = {}
        for d, w in set(zip(doc.tolist(), window.tolist())):
            for i in block.owners[block.owner_ends[w] : block.owner_ends[w + 1]]:
                if block.names[i] is not None:
                    found.setdefault(d, set()).add(block.names[i])
        hit_docs = set(doc.tolist())
        for d in range(len(offsets) - 1):
            a, b = int(offsets[d]), int(offsets[d + 1])
            runs = np.zeros((0, 2), np.int64)
            if d in hit_docs:
                own = np.concatenate([[False], hit[a + 1 : b + 1], [False]]).astype(np.int8)
                edge = np.diff(own)
                runs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
            yield b - a, runs, found.get(d, set())


def _covered(runs: np.ndarray) -> int:
    """Words in the union of runs."""
    total, done = 0, 0
    for a, b in sorted(map(tuple, runs)):
        total += max(0, b - max(a, done))
        done = max(done, b)
    return int(total)


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep_text: bool = True,
    out_col: str = RESULT,
) -> DataFrame:
    """``docs`` with a struct ``out_col``: n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and is clean. Null or empty items have no
    windows; a null item_id's windows count as hits but it isn't listed. Items
    that share windows or an id are each found, an id is listed once. Any
    column of ``docs`` called ``out_col`` (in any case) is replaced. Empty tables are fine.
    """
    bound_batches(docs)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    items = stage(items.mapInArrow(_item_words, "item_id string, words binary, n long").filter("n > 0"), "benchmark-items")
    total = items.agg(F.sum("n")).first()[0] or 0
    names = [c for c in docs.columns if c.lower() != out_col.lower()]
    own = docs.select(*[F.col(f"`{c}`") for c in names])
    if total <= block_words:
        rows = [(r["item_id"], bytes(r["words"])) for r in items.collect()]
        return _annotate_rows(own, text_col, _prepared(docs, text_col, rows, window), keep_text, out_col)
    parts = _dealt(stage(_parts(items, window, block_words), "benchmark-parts"), block_words)
    parts = stage(parts, "benchmark-blocks")
    hits = []
    for bucket, block in sorted(map(tuple, parts.select("bucket", "block").distinct().collect())):
        rows = parts.filter((F.col("bucket") == bucket) & (F.col("block") == block)).select("item", "words").collect()
        hits.append(stage(_block_hits(docs, text_col, _prepared(docs, text_col, [(r["item"], bytes(r["words"])) for r in rows], window)), "window-hits"))
    ids = items.filter("item_id is not null").groupBy(_item_key().alias("item")).agg(F.collect_set("item_id").alias("ids"))
    return _unite(own, text_col, hits, ids, keep_text, out_col)


def _item_key() -> Column:
    return F.sha2("words", 256)


def _prepared(docs: DataFrame, text_col: str, items: list[tuple], window: int) -> Block:
    block = make_block(items, window)
    shingles = block_shingles(block)
    choose_prefixes(block, shingles, shingle_frequencies(docs, text_col, shingles, _widths(block)))
    return block


def _parts(items: DataFrame, window: int, block_words: int) -> DataFrame:
    """``(item, part, words, n)``: the distinct items in parts of at most ``block_words // 8`` words
    (or one window) that overlap by ``window - 1``, so each window is in one part."""
    step = max(1, block_words // 8 - window + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words.as_py()
                own = [words[8 * a : 8 * (a + step + window - 1)] for a in range(0, max(len(words) // 8 - window + 1, 1), step)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(own)), pa.array(range(len(own)), pa.int64()), pa.array(own, pa.binary()), pa.array([len(p) // 8 for p in own], pa.int64())],
                    ["item", "part", "words", "n"],
                )

    distinct = items.select(_item_key().alias("item"), "words").dropDuplicates(["item"])
    return distinct.mapInArrow(cut, "item string, part long, words binary, n long")


def _dealt(parts: DataFrame, block_words: int) -> DataFrame:
    """``parts`` with ``bucket`` and ``block``: dealt to buckets by hash; in each, a running
    sum of words starts the next block, so a block has less than ``block_words`` and a part."""
    buckets = -(-parts.agg(F.sum("n")).first()[0] // block_words)
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("item", "part"), F.lit(buckets)))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("item", "part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / block_words))


def _annotate_rows(docs: DataFrame, text_col: str, block: Block, keep_text: bool, out_col: str) -> DataFrame:
    names = [c for c in docs.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(names))
            rows = [_summary(n, _covered(runs), items) for n, runs, items in _judge(block, text)]
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(rows, kind)], names + [out_col])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out_col, T.StructType.fromDDL(RESULT_TYPE[7:-1]))])
    columns = [F.col(f"`{c}`") for c in names]
    return docs.select(*columns, F.col(f"`{text_col}`").cast("string").alias(free_name(names, "text"))).mapInArrow(run, schema)


def _block_hits(docs: DataFrame, text_col: str, block: Block) -> DataFrame:
    """(a, b, runs, items) of the distinct texts in which this block's windows occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, runs, sorted(items)) for i, (_, runs, items) in enumerate(_judge(block, batch.column(2))) if len(runs)]
            rows = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array([x[1].ravel().tolist() for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.list_(pa.string()))],
                ["a", "b", "runs", "items"],
            )

    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"), text.alias("text")).mapInArrow(
        run, "a long, b long, runs array<long>, items array<string>"
    ).dropDuplicates(["a", "b"])


def _unite(docs: DataFrame, text_col: str, parts: list[DataFrame], ids: DataFrame, keep_text: bool, out_col: str) -> DataFrame:
    """Several blocks: their hits are united by text, get the ``ids`` of their items, and are joined with the documents."""
    own = [*docs.columns]
    a, b, hash_a, hash_b, runs_col, items_col = (free_name(own, c) for c in ("hits_a", "hits_b", "hash_a", "hash_b", "runs", "items"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    runs = hits.groupBy("a", "b").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    named = hits.select("a", "b", F.explode("items").alias("item")).distinct().join(ids, "item")
    named = named.groupBy("a", "b").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    hits = runs.join(named, ["a", "b"], "left").toDF(a, b, runs_col, items_col)
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.withColumns({hash_a: F.xxhash64(text), hash_b: F.xxhash64(text, F.lit(1))})
    joined = keyed.join(hits, (F.col(hash_a) == F.col(a)) & (F.col(hash_b) == F.col(b)), "left")
    names = [c for c in docs.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, runs, items = (batch.column(len(names) + i) for i in range(3))
            sizes = []
            for chunk in textnum.chunks(text):
                sizes += np.diff(textnum.words(chunk, textnum.ALNUM)[2]).tolist()
            rows = [
                _summary(n, _covered(np.array(r or [], np.int64).reshape(-1, 2)), set(i or []))
                for n, r, i in zip(sizes, runs.to_pylist(), items.to_pylist())
            ]
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(rows, kind)], names + [out_col])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out_col, T.StructType.fromDDL(RESULT_TYPE[7:-1]))])
    return joined.select(*[F.col(f"`{c}`") for c in names], text.alias(free_name([*names, runs_col, items_col], "text")), runs_col, items_col).mapInArrow(run, schema)
