"""Removal of repeated passages by suffix sorting.

Every byte covered by a WINDOW-byte string that also starts in a document with
a smaller id is removed. All suffixes of a corpus can't be sorted in one
place, and most have no partner, so Spark deals them out by content first:

1. Anchors. A window's anchor is its leftmost GRAM-byte string of least hash.
   Equal windows have equal anchors at the same place, and about one byte in
   17 is an anchor. Tasks send anchor keys (5 bytes) with text tags (5 bytes),
   packed by bucket, of each key and Arrow batch only the least and greatest
   tag and the number of occurrences; a bucket folds them as they arrive and
   finds the keys that more than one text has. They
   come back as a bit table of at most 2 ** MAX_BITS bits, whatever the
   corpus: a fuller table lets more snippets pass, and changes no result.
2. Snippets. Each run of windows that share a repeated anchor is sent, as one
   piece of text, to the bucket of its anchor. So the suffixes of all equal
   windows meet. A bucket sorts the suffixes of its distinct snippets deep-
   shallow: multikey by eight-byte characters to SHALLOW bytes, then the
   groups with longer common prefixes by blind tries, which look only at the
   bytes where a group branches. Suffixes equal over a window give the least
   document that has it.
3. Hot anchors, those with more occurrences than ``hot_count``, would make one
   bucket too large. A second bit table, of 2 ** HOT_BITS bits, marks them;
   a key that only shares a hot key's bit goes the same way. Their runs of
   windows go as 128-bit hashes of their contents; the windows of each distinct
   content go one by one, as such hashes, through an aggregation with map-side
   combine, and come back to the occurrences in a join that Spark can split.

Copies of a whole text are settled by its hash before all this. Two bit tables
of a fixed size keep most of the later copies out of the steps above, at any
size of the corpus: one of the copies' names, one of the names that hit it by
chance. A copy that gets through costs time and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm import textnum
from threadlens.llm.staging import bound_batches, flagged, stage, thinned

WINDOW = 50
GRAM = 16
SHALLOW = 24
PLACE_BITS = 31  # a column of texts has at most 2 GB
#: Small enough for a processor's cache.
CHUNK = 1 << 18
KEYS_PER_BUCKET = 1 << 19
#: A snippet needs up to 2 KB while a bucket is sorted.
SNIPPETS_PER_BUCKET = 1 << 15
HOT_COUNT = 1 << 16
MAX_BITS = 29
HOT_BITS = 24
#: A bucket folds so many keys, or as many as it holds, at a time.
FOLD_KEYS = 1 << 18

_KEY_SEED = np.uint64(0x632BE59BD9B4E019)
_FORTY = np.uint64((1 << 40) - 1)


# --- anchors -------------------------------------------------------------------------

def anchors(chunk: textnum.Chunk) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: (first window, windows, anchor, key, document)."""
    n = len(chunk.data)
    if n < WINDOW:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    eight = _eight(chunk.data)
    hashes = eight[:-8] * np.uint64(0x9FB21C651E98DF25) + (eight[8:] ^ (eight[8:] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    # Hash above place: a least value is the leftmost of the least hashes. The
    # same bits of the hash count in any chunk.
    bits = np.uint64(PLACE_BITS)
    least = hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64)
    width, span = WINDOW - GRAM + 1, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    owner = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # No window spans the end of a document.
    for end in chunk.docs[1:].tolist():
        owner[max(0, end - WINDOW + 1) : end] = -1
    first = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    first = np.insert(first, 0, 0)
    count = np.diff(np.append(first, len(owner)))
    mine = owner[first] >= 0
    first, count = first[mine], count[mine]
    own = owner[first]
    return first, count, own, textnum.mix(hashes[own] ^ _KEY_SEED), np.searchsorted(chunk.docs, first, "right") - 1


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def _buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last index of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(sorted_values))


def _send_keys(bits: int):
    """(bucket, keys, tags, places, more): 40 bits of each anchor key below its bucket's, 40 bits of its text's hash.

    Of a key's tags in a batch the least and the greatest are sent; ``more``
    has the number of the others by the place of the least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(1).to_numpy().view(np.uint64)
            keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for chunk in textnum.chunks(batch.column(3), CHUNK):
                _, _, _, own, doc = anchors(chunk)
                keys.append(own)
                at.append(tags[chunk.first + doc])
            keys, at = np.concatenate(keys), np.concatenate(at)
            order = np.argsort(keys, kind="stable")
            keys, low, high, n = _fold(keys[order] >> np.uint64(24 - bits), at[order] & _FORTY, at[order] & _FORTY)
            sent = 1 + (low != high)
            start = np.cumsum(sent) - sent
            keys, at, more = np.repeat(keys, sent), np.repeat(high, sent), np.zeros(int(sent.sum()), np.uint32)
            at[start], more[start] = low, n - sent
            bucket = (keys >> np.uint64(40)).astype(np.int64)
            first, last = _runs(bucket)
            places = [np.flatnonzero(more[a:b]) for a, b in zip(first, last)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[first]),
                    pa.array([_five(keys[a:b]) for a, b in zip(first, last)], pa.binary()),
                    pa.array([_five(at[a:b]) for a, b in zip(first, last)], pa.binary()),
                    pa.array([x.astype("<u4").tobytes() for x in places], pa.binary()),
                    pa.array([more[a + x].astype("<u4").tobytes() for a, x in zip(first, places)], pa.binary()),
                ],
                ["bucket", "keys", "tags", "places", "more"],
            )

    return run


def _fold(keys: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sorted keys once each, with the least ``low``, the greatest ``high`` and the sum of ``n`` (1 each by default)."""
    first, last = _runs(keys)
    if not len(first):
        return keys, low, high, np.zeros(0, np.int64)
    n = last - first if n is None else np.add.reduceat(n, first)
    return keys[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), n


def _five(values: np.ndarray) -> bytes:
    """The low five bytes of each value, byte plane by byte plane."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _unfive(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(5, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :5] = planes.T
    return out.view("<u8").ravel()


def _repeated_keys(bits: int, table_bits: int, hot_count: int):
    """Per bucket: its part of the bit table of repeated keys, and its hot keys (bucket and 40 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, parts, waiting = 0, [_none()], [], 0

        def fold() -> tuple[np.ndarray, ...]:
            columns = [np.concatenate(x) for x in zip(*held, *parts)]
            order = np.argsort(columns[0], kind="stable")
            return _fold(*(x[order] for x in columns))

        for batch in batches:
            for row in batch.to_pylist():
                bucket, keys, tags = row["bucket"], _unfive(row["keys"]), _unfive(row["tags"])
                n = np.ones(len(keys), np.int64)
                n[np.frombuffer(row["places"], "<u4")] += np.frombuffer(row["more"], "<u4")
                parts.append((keys, tags, tags, n))
                waiting += len(keys)
                if waiting > max(FOLD_KEYS, len(held[0][0])):
                    held, parts, waiting = [fold()], [], 0
        keys, low, high, n = fold()
        several = low != high
        part = np.zeros(1 << (table_bits - bits), bool)
        part[keys[several] >> np.uint64(40 - (table_bits - bits))] = True
        whole = (np.uint64(bucket) << np.uint64(40)) | keys[several & (n > hot_count)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket]), pa.array([np.packbits(part).tobytes()], pa.binary()), pa.array([whole.view(np.int64)], pa.list_(pa.int64()))], ["bucket", "part", "hot"]
        )

    return run


def _none() -> tuple[np.ndarray, ...]:
    return tuple(np.zeros(0, kind) for kind in (np.uint64, np.uint64, np.uint64, np.int64))


class _Filter:
    """The bit tables of repeated keys and of hot keys; a key's place is its highest bits."""

    def __init__(self, bits: int, table_bits: int, parts: dict[int, bytes], hot: np.ndarray):
        self.table_bits = table_bits
        size = max(1, (1 << (table_bits - bits)) // 8)
        self.table = np.zeros(size << bits, np.uint8)
        for bucket, part in parts.items():
            self.table[bucket * size : (bucket + 1) * size] = np.frombuffer(part, np.uint8)
        marks = np.zeros(1 << HOT_BITS, bool)
        marks[hot] = True
        self.hot = np.packbits(marks)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        return self._bit(self.table, keys, self.table_bits)

    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        return self._bit(self.hot, keys, HOT_BITS)

    @staticmethod
    def _bit(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
        at = (keys >> np.uint64(64 - bits)).astype(np.int64)
        return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0


# --- snippets and their suffixes --------------------------------------------------------

def _send_snippets(held, bits: int):
    """(bucket, ids, texts, places, counts, anchors, data) of the snippets that aren't hot; data is compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = held.value
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts, data = [], []
            for chunk in textnum.chunks(batch.column(3), CHUNK):
                first, count, own, keys, doc = anchors(chunk)
                mine = keep.repeated(keys)
                mine &= ~keep.is_hot(keys)
                first, count, own, doc = first[mine], count[mine], own[mine], doc[mine]
                size = count + WINDOW - 1
                ends = np.cumsum(size)
                data.append(chunk.data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)])
                parts.append((_buckets(keys[mine], bits), ids[chunk.first + doc], texts[chunk.first + doc], first - chunk.docs[doc], count, own - first))
            if not parts:
                continue
            bucket, *columns = (np.concatenate(x) for x in zip(*parts))
            data = np.concatenate(data)
            size = columns[3] + WINDOW - 1
            start = np.cumsum(size) - size
            order = np.argsort(bucket, kind="stable")
            bucket, size, start = bucket[order], size[order], start[order]
            columns = [c[order].astype(kind) for c, kind in zip(columns, ("<i8", "<u4", "<u4", np.uint8, np.uint8))]
            rows = [[] for _ in range(7)]
            for a, b in zip(*_runs(bucket)):
                n = size[a:b]
                text = data[np.arange(int(n.sum())) + np.repeat(start[a:b] - (np.cumsum(n) - n), n)]
                for row, value in zip(rows, (int(bucket[a]), *(c[a:b].tobytes() for c in columns), _pack(text))):
                    row.append(value)
            kinds = [pa.int64()] + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], ["bucket", "ids", "texts", "places", "counts", "anchors", "data"])

    return run


def _pack(text: np.ndarray) -> bytes:
    return len(text).to_bytes(8, "little") + pa.compress(text.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)


def equal_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Class of each suffix ``at``: those of one ``group`` that agree over WINDOW bytes.

    Deep-shallow sorting; suffixes that have lost all partners leave early.
    """
    out = np.arange(len(at))
    live = np.arange(len(at))
    eight = _eight(data)
    depth = 0
    while depth < SHALLOW and len(live):  # multikey: one eight-byte character at a time
        word = eight[at[live] + depth]
        order = np.lexsort((word, group[live]))
        live, word = live[order], word[order]
        own = group[live]
        new = np.ones(len(live), bool)
        new[1:] = (own[1:] != own[:-1]) | (word[1:] != word[:-1])
        live = _relabel(group, live, new)
        depth += 8
    offsets = np.append(np.arange(SHALLOW, WINDOW - 8, 8), WINDOW - 8)
    while len(live):  # blind tries: each group branches at its first differing byte
        own = group[live]
        first, last = _runs(own)
        head = np.repeat(live[first], last - first)
        branch = np.full(len(live), WINDOW)
        for offset in offsets[::-1]:
            differ = eight[at[live] + offset] ^ eight[at[head] + offset]
            some = differ != 0
            if some.any():
                branch[some] = np.minimum(branch[some], offset + _first_byte(differ[some]))
        least = np.minimum.reduceat(branch, first)
        done = np.repeat(least >= WINDOW, last - first)
        out[live[done]] = head[done]
        live, where = live[~done], np.repeat(least, last - first)[~done]
        if not len(live):
            break
        byte = data[at[live] + where]
        order = np.lexsort((byte, group[live]))
        live, byte = live[order], byte[order]
        own = group[live]
        new = np.ones(len(live), bool)
        new[1:] = (own[1:] != own[:-1]) | (byte[1:] != byte[:-1])
        live = _relabel(group, live, new)
    return out


def _first_byte(differ: np.ndarray) -> np.ndarray:
    """Number of leading zero bytes of non-zero big-endian words."""
    lead = np.zeros(len(differ), np.int64)
    for k in range(1, 8):
        lead += (differ >> np.uint64(64 - 8 * k)) == 0
    return lead


def _relabel(group: np.ndarray, live: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Give each run of the sorted ``live`` a group of its own; lone members leave."""
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(live)))
    group[live] = np.repeat(live[first], size)
    live = live[np.repeat(size > 1, size)]
    return live[np.argsort(group[live], kind="stable")] if len(live) else live


def _resolve(table: pa.Table) -> pa.Table:
    """(doc_id, text, start, stop): runs of bytes to remove that one bucket finds."""
    column = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
    ids, texts, place = column("ids", "<i8"), column("texts", "<u4").astype(np.int64), column("places", "<u4").astype(np.int64)
    count, anchor, data = column("counts", np.uint8).astype(np.int64), column("anchors", np.uint8).astype(np.int64), np.concatenate([_unpack(x) for x in table.column("data").to_pylist()])
    size = count + WINDOW - 1
    start = np.cumsum(size) - size
    spans = textnum.Spans(data, textnum.CASED)
    key = spans.hashes(start + anchor, start + anchor + GRAM)
    content = spans.hashes(start, start + size) ^ textnum.mix(key + anchor.astype(np.uint64))
    # Keys that only one document has are false hits of the bit table.
    order = np.argsort(key, kind="stable")
    first, last = _runs(key[order])
    alone = np.minimum.reduceat(ids[order], first) == np.maximum.reduceat(ids[order], first)
    order = order[np.repeat(~alone, last - first)]
    order = order[np.lexsort((ids[order], content[order]))]
    first, last = _runs(content[order])
    # One snippet of each content, that of the least document, stands for all.
    stands = order[first]
    n = count[stands]
    total = np.cumsum(n)
    windows = int(total[-1]) if len(total) else 0
    snippet = np.repeat(np.arange(len(stands)), n)
    inner = np.arange(windows) - np.repeat(total - n, n)
    at = start[stands][snippet] + inner
    _, group = np.unique(key[stands], return_inverse=True)
    doc = ids[stands][snippet]
    least = doc.copy()
    several = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    pick = np.flatnonzero(several[snippet])
    if len(pick):
        same = equal_windows(data, at[pick], group[snippet[pick]])
        sums = np.full(len(pick), np.iinfo(np.int64).max)
        np.minimum.at(sums, same, doc[pick])
        least[pick] = sums[same]
    # Each occurrence of a content loses its windows that a smaller document has.
    content_of = np.repeat(np.arange(len(first)), last - first)
    n = count[order]
    base = np.repeat((total - count[stands])[content_of], n)
    ends = np.cumsum(n)
    inner = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
    lost = np.repeat(ids[order], n) > least[base + inner]
    # Runs of lost windows within one occurrence.
    begin = lost.copy()
    begin[1:] &= ~lost[:-1] | (inner[1:] == 0)
    finish = lost.copy()
    finish[:-1] &= ~lost[1:] | (inner[1:] == 0)
    of = np.repeat(np.arange(len(order)), n)
    a, b = np.flatnonzero(begin), np.flatnonzero(finish)
    from_, owner = place[order][of[a]] + inner[a], order[of[a]]
    return pa.table([pa.array(ids[owner]), pa.array(texts[owner]), pa.array(from_), pa.array(from_ + (b - a) + WINDOW)], ["doc_id", "text", "start", "stop"])


def _send_hot_runs(held):
    """(c1, c2, doc_id, text, start, windows) of every run of windows with a hot anchor; the hashes of its windows
    come once in a batch for each content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = held.value
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            known = set()
            for chunk in textnum.chunks(batch.column(3), CHUNK):
                first, count, own, keys, doc = anchors(chunk)
                mine = np.flatnonzero(keep.is_hot(keys) & keep.repeated(keys))
                first, n, own, doc = first[mine], count[mine], own[mine], doc[mine]
                spans = textnum.Spans(chunk.data, textnum.CASED)
                c1, c2 = _wide_hashes(spans, first, (n + WINDOW - 1) // 2, n + WINDOW - 1)
                new = np.array([not (pair in known or known.add(pair)) for pair in zip(c1.tolist(), c2.tolist())], bool)
                sent = np.where(new, n, 0)
                ends = np.cumsum(sent)
                at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sent), sent)
                w1, w2 = _wide_hashes(spans, at, np.full(len(at), WINDOW // 2), np.full(len(at), WINDOW))
                windows = pa.StructArray.from_arrays([pa.array(w1), pa.array(w2)], ["w1", "w2"])
                windows = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), windows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c1), pa.array(c2), pa.array(ids[chunk.first + doc]), pa.array(texts[chunk.first + doc].astype(np.uint32).astype(np.int64)), pa.array(first - chunk.docs[doc]), windows],
                    ["c1", "c2", "doc_id", "text", "start", "windows"],
                )

    return run


def _wide_hashes(spans: textnum.Spans, at: np.ndarray, half: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the ``size`` bytes from each place on, as two longs."""
    one, two, n = spans.hashes(at, at + half), spans.hashes(at + half, at + size), size.astype(np.uint64)
    w1 = textnum.mix(one * np.uint64(0xD6E8FEB86659FD93) + two + n)
    return w1.view(np.int64), textnum.mix(two * np.uint64(0xA0761D6478BD642F) ^ one).view(np.int64)


def _lost_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, start, stop): the bytes of each run that smaller documents have, of rows (doc_id, text, start, lost);
    ``lost`` is (inner, least) of windows."""
    for batch in batches:
        ids, texts, start = (batch.column(i).to_numpy() for i in range(3))
        lost = batch.column(3)
        row = np.repeat(np.arange(len(lost)), lost.value_lengths().to_numpy())
        inner, least = (lost.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        mine = ids[row] > least
        row, inner = row[mine], inner[mine]
        order = np.lexsort((inner, row))
        row, inner = row[order], inner[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(row))[: len(a)] - 1
        of = row[a]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[of]), pa.array(texts[of]), pa.array(start[of] + inner[a]), pa.array(start[of] + inner[b] + WINDOW)], ["doc_id", "text", "start", "stop"]
        )


def _hot_runs(texts: DataFrame, held) -> DataFrame:
    """(doc_id, text, start, stop) of the bytes to remove at hot anchors.

    Occurrences of one content share its windows: a window is compared once for each
    content, however many documents have that.
    """
    fields = "c1 long, c2 long, doc_id long, text long, start long, windows array<struct<w1: long, w2: long>>"
    runs = stage(texts.mapInArrow(_send_hot_runs(held), fields), "hot-runs")
    ends = runs.groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shown = runs.filter(F.size("windows") > 0).select("c1", "c2", "windows").dropDuplicates(["c1", "c2"])
    windows = stage(ends.join(shown, ["c1", "c2"]).select("c1", "c2", "least", "most", F.posexplode("windows").alias("inner", "w")).select("*", "w.*").drop("w"), "hot-windows")
    least = windows.groupBy("w1", "w2").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most").drop("most")
    lost = windows.drop("least").join(least, ["w1", "w2"]).filter("most > least")
    lost = stage(lost.groupBy("c1", "c2").agg(F.collect_list(F.struct("inner", "least")).alias("lost")), "hot-lost")
    found = runs.drop("windows").join(lost, ["c1", "c2"]).select("doc_id", "text", "start", "lost")
    return found.mapInArrow(_lost_runs, "doc_id long, text long, start long, stop long")


# --- operator -----------------------------------------------------------------------------

def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t1, t2, n_removed, n_spans, kept): texts without the union of their runs."""
    for batch in batches:
        removed, spans, kept = [], [], []
        texts = [chunk.text(i) for chunk in textnum.chunks(batch.column(4)) for i in range(chunk.last - chunk.first)]
        for text, runs in zip(texts, batch.column(3)):
            pair = runs.values
            starts, stops = pair.field(0).to_numpy(), pair.field(1).to_numpy()
            order = np.argsort(starts, kind="stable")
            starts, reach = starts[order], np.maximum.accumulate(stops[order])
            new = np.ones(len(starts), bool)
            new[1:] = starts[1:] > reach[:-1]
            a, b = starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
            edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
            kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])))
            removed.append(int((b - a).sum()))
            spans.append(len(a))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "t1", "t2", "n_removed", "n_spans", "kept"],
        )


def repeated_runs(texts: DataFrame, total_bytes: int, hot_count: int = HOT_COUNT) -> DataFrame:
    """(doc_id, text, start, stop) of the bytes to remove in ``texts`` (doc_id, t1, t2, text), distinct texts with ids; ``text`` is the low half of t1."""
    spark = texts.sparkSession
    expected = max(1, 2 * total_bytes // (WINDOW - GRAM + 2))
    bits = min(24, max(0, (expected // KEYS_PER_BUCKET).bit_length()))
    table_bits = max(bits + 3, min(MAX_BITS, expected.bit_length() + 2, bits + 40))
    found = (
        texts.mapInArrow(_send_keys(bits), "bucket long, keys binary, tags binary, places binary, more binary")
        .groupBy("bucket")
        .applyInArrow(_repeated_keys(bits, table_bits, hot_count), "bucket long, part binary, hot array<long>")
        .withColumn("hot", F.array_distinct(F.transform("hot", lambda key: F.shiftrightunsigned(key, bits + 40 - HOT_BITS))))
        .collect()  # at most 2 ** MAX_BITS bits and 2 ** HOT_BITS places
    )
    hot = np.array([place for r in found for place in r["hot"]], np.int64)
    held = spark.sparkContext.broadcast(_Filter(bits, table_bits, {r["bucket"]: bytes(r["part"]) for r in found}, hot))
    snippet_bits = min(24, max(0, (expected // 4 // SNIPPETS_PER_BUCKET).bit_length()))
    fields = "bucket long, ids binary, texts binary, places binary, counts binary, anchors binary, data binary"
    runs = texts.mapInArrow(_send_snippets(held, snippet_bits), fields).groupBy("bucket").applyInArrow(
        _resolve, "doc_id long, text long, start long, stop long"
    )
    if not len(hot):
        return runs
    return runs.unionByName(_hot_runs(texts, held))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_count: int = HOT_COUNT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (binary, null if nothing was removed).

    Texts are UTF-8 bytes, null is empty. Ids are integers; a row with a null
    id loses nothing and takes nothing from others. Of rows with an equal text
    the smallest id keeps it and the others lose all of it (if it has WINDOW
    bytes); rows that repeat an id and text share one fate, and rows with one
    id take nothing from each other. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = bound_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), text.alias("text"))
    narrow = stage(rows.select("doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "text-names")
    copies = narrow.filter("doc_id is not null").groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = stage(copies.select("t1", "t2", "least"), "copies")
    total = narrow.filter(F.col("n_bytes") >= WINDOW).agg(F.sum("n_bytes")).first()[0] or 0
    full = ["doc_id", "t1", "t2"]
    named = narrow.filter(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= WINDOW)).select(*full, F.xxhash64(*full).alias("name"))
    later = stage(named.join(copies, ["t1", "t2"]).filter("doc_id > least").select(*full, "name"), "later-copies")
    chance = stage(thinned(named, later, "name").join(later, full, "left_anti").select("name"), "chance-hits")
    texts = rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW)).withColumn("name", F.xxhash64(*full))
    texts = flagged(texts, later, "name", "going", unless=chance).filter("not going").select(*full, "text")
    runs = repeated_runs(texts, total, hot_count).groupBy("doc_id", F.col("text").alias("half")).agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    runs = stage(runs, "runs")
    place = F.xxhash64("doc_id", "half").alias("place")
    parts = texts.withColumn("half", F.col("t1").bitwiseAND(F.lit(0xFFFFFFFF))).select("*", place)
    parts = thinned(parts, runs.select(place), "place").drop("place")  # the other texts needn't move
    parts = parts.join(runs, ["doc_id", "half"]).dropDuplicates([*full, "half"])  # dealt as the join left them
    cut = parts.select(*full, "runs", "text").mapInArrow(_remove, "doc_id long, t1 long, t2 long, n_removed long, n_spans long, kept binary")
    cut = stage(cut.withColumn("kept_sha", F.unhex(F.sha2("kept", 256))), "cut-texts")  # who wants no texts needn't move them
    whole = F.col("least").isNotNull() & (F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= WINDOW)
    joined = narrow.join(copies, ["t1", "t2"], "left").join(cut, full, "left")  # a copy that got through was cut too
    touched = F.col("doc_id").isNotNull()
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).when(touched, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(whole, 1).when(touched, F.coalesce("n_spans", F.lit(0))).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.lower(F.hex(F.when(touched, F.coalesce("kept_sha", "sha")).otherwise(F.col("sha"))))).alias("kept_sha256"),
        F.when(whole, F.lit(b"")).when(touched, F.col("kept")).alias("kept_text"),
    )
