"""SentencePiece encoding by sampling, and decoding.

A text (with a space put before it) spans a lattice: its nodes are byte
positions, its arcs the vocabulary's pieces that match there, and single bytes
where a character has no piece of its own. An arc's weight is its piece's Zipf
weight ``(rank + 2) ** -theta``, as the vocabulary is one of merges whose
scores are ranks. Forward filtering sums the weights of all paths into each
node; backward sampling then draws the last arc of a node in proportion, and
so on to the start. The draw at a node is a hash of the row's key and the
node's position, so a segmentation depends on its row alone, not on
partitions, batches or retries.

No piece spans two bytes that are neighbours in no piece, so the lattice
falls apart there into short units. Units repeat: each task filters a unit
once, and draws for all of a chunk's units side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm import textnum
from threadlens.llm.staging import bound_batches, free_name

THETA = 1.0
SEED = 9
#: Arcs that a Python worker keeps; beyond it the cache starts anew.
CACHE_ARCS = 2_000_000
SPACE = "▁"


class Vocabulary:
    """Pieces as bytes (the space mark as a space), their weights, and what the lattice needs."""

    def __init__(self, path: str, theta: float = THETA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_id = np.full(256, -1, np.int64)
        normal = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:-1], 16)])
                self.byte_id[self.bytes[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace(SPACE, " ").encode()
                normal.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so decoding can't be lossless")
        rank = np.full(size, size, float)
        rank[normal] = [-model.get_score(i) for i in normal]
        self.log_weight = -theta * np.log(rank + 2)
        self.joined = np.zeros((256, 256), bool)  # neighbours in some piece
        for i in normal:
            b = np.frombuffer(self.bytes[i], np.uint8)
            self.joined[b[:-1], b[1:]] = True
        # By length in bytes: hashes of all prefixes, with the piece's id or -1.
        flat = np.frombuffer(b"".join(self.bytes[i] for i in normal), np.uint8)
        sizes = np.array([len(self.bytes[i]) for i in normal])
        starts = np.cumsum(sizes) - sizes
        spans = textnum.Spans(flat, textnum.CASED)
        self.prefixes = []
        for n in range(1, int(sizes.max()) + 1):
            mine = np.flatnonzero(sizes >= n)
            own = np.where(sizes[mine] == n, np.array(normal)[mine], -1)
            hashes = spans.hashes(starts[mine], starts[mine] + n)
            order = np.lexsort((-own, hashes))
            hashes, first = np.unique(hashes[order], return_index=True)
            self.prefixes.append((hashes, own[order][first]))
        self.piece_ends = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])])
        self.piece_flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def arcs(self, data: np.ndarray, unit_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of all arcs in units that lie side by side in ``data``."""
        spans = textnum.Spans(data, textnum.CASED)
        limit = np.repeat(unit_ends, np.diff(unit_ends, prepend=0))
        active = np.arange(len(data))
        out = []
        covered = np.zeros(len(data), bool)  # the character here has a piece
        size = np.where(data < 0x80, 1, np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, np.where(data >= 0xC0, 2, 1))))
        for n, (hashes, ids) in enumerate(self.prefixes, 1):
            active = active[active + n <= limit[active]]
            own = spans.hashes(active, active + n)
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            active, at = active[hashes[at] == own], at[hashes[at] == own]
            hit = ids[at] >= 0
            starts = active[hit]
            out.append((starts, starts + n, ids[at[hit]]))
            covered[starts[size[starts] == n]] = True
            if not len(active):
                break
        # A byte belongs to the character of the last leading byte before it.
        lead = (data & 0xC0) != 0x80
        first = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))
        inside = covered[first] & (np.arange(len(data)) < first + size[first])
        alone = np.flatnonzero(~inside)
        out.append((alone, alone + 1, self.byte_id[data[alone]]))
        return tuple(np.concatenate(x) for x in zip(*out))


def filter_forward(vocabulary: Vocabulary, data: np.ndarray, unit_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each byte's first arc, and the arcs by their last byte: (share, length, id).
    A share is that of the paths into the arc's end, up to and with this arc."""
    starts, ends, ids = vocabulary.arcs(data, unit_ends)
    unit_starts = np.concatenate([[0], unit_ends[:-1]])
    unit = np.searchsorted(unit_ends, starts, "right")
    depth = ends - unit_starts[unit]
    order = np.lexsort((starts, ends, depth))
    starts, ends, ids, depth = starts[order], ends[order], ids[order], depth[order]
    # Node p + u of unit u: each unit has a node before its first byte.
    source, target = starts + unit[order], ends + unit[order]
    total = np.full(len(data) + len(unit_ends), -np.inf)
    total[unit_starts + np.arange(len(unit_ends))] = 0.0
    weight = vocabulary.log_weight[ids]
    share = np.empty(len(ids))
    steps = np.flatnonzero(np.diff(depth, prepend=0))
    for a, b in zip(steps, np.append(steps[1:], len(depth))):
        log = total[source[a:b]] + weight[a:b]
        first = np.flatnonzero(np.diff(target[a:b], prepend=-1))
        size = np.diff(np.append(first, b - a))
        most = np.maximum.reduceat(log, first)
        most[np.isneginf(most)] = 0.0
        part = np.exp(log - np.repeat(most, size))
        sums = np.add.reduceat(part, first)
        with np.errstate(divide="ignore", invalid="ignore"):
            total[target[a:b][first]] = most + np.log(sums)
            before = np.cumsum(part) - part
            share[a:b] = (np.cumsum(part) - np.repeat(before[first], size)) / np.repeat(sums, size)
        share[a:b][first + size - 1] = 1.0
    order = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[order], np.arange(1, len(data) + 1))
    return first, np.nan_to_num(share)[order], (ends - starts)[order], ids[order]


class _Lattices:
    """The filtered lattices of the units seen, by the units' 64-bit hashes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.keys, self.bases = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size = 0  # bytes of all units so far
        self.first = np.zeros(0, np.int32)
        self.share, self.arc_size, self.arc_id = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where in the cache's bytes each unit begins."""
        hashes, first, group = np.unique(textnum.Spans(data, textnum.CASED).hashes(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != hashes
        if new.any():
            a, n = starts[first[new]], (ends - starts)[first[new]]
            stops = np.cumsum(n)
            own = data[np.arange(int(stops[-1])) + np.repeat(a - (stops - n), n)]
            begin, share, size, ids = filter_forward(self.vocabulary, own, stops)
            self.first = np.concatenate([self.first, (begin + len(self.share)).astype(np.int32)])
            self.share = np.concatenate([self.share, share])
            self.arc_size = np.concatenate([self.arc_size, size.astype(np.int32)])
            self.arc_id = np.concatenate([self.arc_id, ids.astype(np.int32)])
            self.keys = np.insert(self.keys, at[new], hashes[new])
            self.bases = np.insert(self.bases, at[new], self.size + stops - n)
            self.size += int(stops[-1])
            at = np.searchsorted(self.keys, hashes)
        return self.bases[at][group]


def sample(lattices: _Lattices, data: np.ndarray, docs: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Per byte of ``data`` the id of the piece that ends there, or -1."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[docs] = True
    cut[0] = cut[n] = True
    cut[1:-1] |= ~lattices.vocabulary.joined[data[:-1], data[1:]]
    edges = np.flatnonzero(cut)
    base = lattices.find(data, edges[:-1], edges[1:])
    out = np.full(n, -1, np.int64)
    doc = np.searchsorted(docs, edges[:-1], "right") - 1
    at, start, shift = edges[1:], edges[:-1], base - edges[:-1]
    key, origin = seeds[doc], docs[doc]
    while len(at):
        draw = textnum.mix(key + (at - origin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        u = (draw >> np.uint64(24)).astype(np.float64) / float(1 << 40)
        arc = lattices.first[at + shift - 1]
        on = np.flatnonzero(lattices.share[arc] <= u)
        while len(on):
            arc[on] += 1
            on = on[lattices.share[arc[on]] <= u[on]]
        out[at - 1] = lattices.arc_id[arc]
        at = at - lattices.arc_size[arc]
        live = at > start
        at, start, shift, key, origin = at[live], start[live], shift[live], key[live], origin[live]
    return out


_caches: dict[tuple, _Lattices] = {}


def _worker_cache(path: str, theta: float) -> _Lattices:
    """The cache outlives a task, as Spark reuses its Python workers."""
    cache = _caches.get((path, theta))
    if cache is None:
        cache = _caches[path, theta] = _Lattices(Vocabulary(path, theta))
    elif len(cache.share) > CACHE_ARCS:
        cache = _caches[path, theta] = _Lattices(cache.vocabulary)
    return cache


def _struct(docs: DataFrame, names: list[str], extra: list[T.StructField]) -> T.StructType:
    return T.StructType([docs.schema[c] for c in names] + extra)


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", out_col: str = "piece_ids",
    theta: float = THETA, seed: int = SEED, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``out_col``: a sampled segmentation of ``text_col`` as array<int>.

    The same id, text and ``seed`` always give the same ids. A null text gives
    null, an empty one no ids. A null id is a key like any other; repeated rows
    get equal segmentations. A column called ``out_col`` is replaced.
    """
    names = [c for c in docs.columns if c.lower() != out_col.lower() and (keep_text or c != text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, seeds = batch.column(len(names)), batch.column(len(names) + 1).to_numpy().view(np.uint64)
            for chunk in textnum.chunks(text):
                # A space before each text that isn't empty.
                sizes = np.diff(chunk.docs)
                data = np.insert(chunk.data, chunk.docs[:-1][sizes > 0], 0x20)
                docs_at = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
                ids = np.zeros(0, np.int32)
                cuts = np.zeros(len(docs_at), np.int64)
                if len(data):
                    found = sample(_worker_cache(model_path, theta), data, docs_at, seeds[chunk.first : chunk.last])
                    ends = np.flatnonzero(found >= 0)
                    ids, cuts = found[ends].astype(np.int32), np.searchsorted(ends, docs_at)
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                null = np.append(part.column(len(names)).is_null().to_numpy(zero_copy_only=False), False)
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32), mask=null), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + [lists], names + [out_col])

    schema = _struct(docs, names, [T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    return bound_batches(docs).select(
        *[F.col(f"`{c}`") for c in names],
        F.col(f"`{text_col}`").cast("string").alias(free_name(names, "text")),
        F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)).alias(free_name([*names, free_name(names, "text")], "seed")),
    ).mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``out_col``: the text of ``ids_col``; null for null, empty for no ids.

    Undoes ``encode`` exactly. Null ids inside a list are skipped.
    """
    names = [c for c in rows.columns if c.lower() != out_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _worker_cache(model_path, THETA).vocabulary
        for whole in batches:
            for first in range(0, len(whole), 256):
                batch = whole.slice(first, 256)
                lists = batch.column(names.index(ids_col))
                null = lists.is_null().to_numpy(zero_copy_only=False)
                ids = lists.flatten()
                offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))]).astype(np.int64)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                size = np.where(known, np.diff(vocabulary.piece_ends)[ids], 0)
                total = np.concatenate([[0], np.cumsum(size)])
                data = vocabulary.piece_flat[np.arange(int(total[-1])) + np.repeat(vocabulary.piece_ends[ids] - total[:-1], size)].tobytes()
                ends = total[offsets]
                texts = [None if skip else data[a + 1 : b].decode("utf-8", "replace") for a, b, skip in zip(ends[:-1].tolist(), ends[1:].tolist(), null)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(texts, pa.string())], names + [out_col])

    return bound_batches(rows).select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, _struct(rows, names, [T.StructField(out_col, T.StringType())]))
