"""Token ids of a corpus in entropy-coded files.

Ids are counted over the whole corpus; the counts give canonical Huffman codes
of at most ``MAX_BITS`` bits (package-merge; a few more where there are more
than 2^16 distinct ids). Documents are written in ascending id order. A file is a sequence of independent blocks; a block holds
whole documents and says where every ``LANE``-th id starts in its bit stream,
so any of them can be decoded alone, and a table look-up per id decodes all
lanes of a block side by side.

Files: ``shards`` (one row per block: shard, block, start, doc_ids, lengths,
payload) and ``codebook`` (id, bits). A payload is ``THF1``, the number of ids,
the lane length and the number of lanes as u32, each lane's bit offset as u64,
then the bit stream, all but the stream little-endian.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm import textnum
from threadlens.llm.staging import bound_batches, stage, stage_path, unstage

MAX_BITS = 16
#: The longest codes that a 32-bit window at any bit of a byte holds.
WINDOW_BITS = 25
LANE = 64
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 22
MAGIC = b"THF1"
#: Cached pieces of a Python worker; beyond it the cache starts anew.
CACHE_PIECES = 1_000_000
#: Files are placed in groups of this many (a power of two), so the driver sees a row per group.
FILE_GROUP = 1 << 12


# --- codes -----------------------------------------------------------------

def code_limit(used: int) -> int:
    """The code-length limit for so many distinct ids."""
    return MAX_BITS if used <= 1 << MAX_BITS else min((used - 1).bit_length() + 2, WINDOW_BITS)


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (by default, ``code_limit``) by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    limit = limit or code_limit(len(used))
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit into {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, leaf_flags = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        sort = np.argsort(both, kind="stable")
        level = both[sort]
        leaf_flags.append(sort < len(leaves))
    take = 2 * len(leaves) - 2
    for flags in reversed(leaf_flags):
        k = int(flags[:take].sum())
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            last = int(lengths[i])
            codes[i] = code
            code += 1
    return codes


def decode_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for each value of the next bits, ``MAX_BITS`` of them or the longest code's."""
    codes, longest = canonical_codes(lengths), max(MAX_BITS, int(lengths.max(initial=0)))
    ids, bits = np.zeros(1 << longest, np.uint32), np.zeros(1 << longest, np.uint8)
    for i in np.flatnonzero(lengths):
        spare = longest - int(lengths[i])
        at = int(codes[i]) << spare
        ids[at : at + (1 << spare)] = i
        bits[at : at + (1 << spare)] = lengths[i]
    return ids, bits


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    offsets = ends - bits
    lanes = offsets[::LANE].astype("<u8")
    head = MAGIC + np.array([len(ids), LANE, len(lanes)], "<u4").tobytes() + lanes.tobytes()
    if not len(ids):
        return head
    word = offsets >> 5
    value = codes[ids] << (64 - (offsets & 31) - bits).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))  # a code starts in every 32-bit word
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[:-1] += np.add.reduceat(value >> np.uint64(32), first)
    out[1:] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return head + out.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8]


def decode_block(payload: bytes, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n, lane, lanes = (int(x) for x in np.frombuffer(payload, "<u4", 3, 4))
    if not n:
        return np.zeros(0, np.uint32)
    at = np.frombuffer(payload, "<u8", lanes, 16).astype(np.int64)
    stream = np.frombuffer(payload + b"\0" * 4, np.uint8, offset=16 + 8 * lanes).astype(np.uint32)
    window = stream[:-3] << np.uint32(24) | stream[1:-2] << np.uint32(16) | stream[2:-1] << np.uint32(8) | stream[3:]
    ids, bits = tables
    longest = len(ids).bit_length() - 1
    out = np.zeros((lane, lanes), np.uint32)
    for step in range(min(lane, n)):
        live = lanes if step < (n - 1) % lane + 1 else lanes - 1
        here = at[:live]
        peek = (window[here >> 3] >> (32 - longest - (here & 7)).astype(np.uint32)) & np.uint32(len(ids) - 1)
        out[step, :live] = ids[peek]
        at[:live] += bits[peek]
    return out.T.ravel()[:n]


# --- tokenising --------------------------------------------------------------

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = ~_LETTER & (np.arange(256) < 128)
_APOSTROPHE = 0x27


# The steps before the merges for which ``pieces`` cuts rightly.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def cuts_hold(tokenizer) -> bool:
    """Whether ``pieces``, encoded one by one, give the tokenizer's ids of the whole text."""
    steps = [None if step is None else json.loads(step.__getstate__()) for step in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    plain = tokenizer.truncation is None and tokenizer.padding is None and not getattr(tokenizer.model, "dropout", None)
    return plain and steps == [_NORMALIZER, _PRE_TOKENIZER]


def added_tokens(tokenizer) -> list[bytes] | None:
    """The tokens that the tokenizer finds in the raw text before all else, longest first.

    None if it has added tokens that it finds after normalising or by the
    characters around them.
    """
    tokens = tokenizer.get_added_tokens_decoder().values()
    if any(t.normalized or t.single_word for t in tokens):
        return None
    return sorted({t.content.encode() for t in tokens if t.content}, key=lambda t: (-len(t), t))


def literals(chunk: textnum.Chunk, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the given tokens, leftmost and longest first within each document, and which each is."""
    found, data = [], chunk.data.tobytes() if tokens else b""
    if any(t in data for t in tokens):
        number, pattern = {t: i for i, t in enumerate(tokens)}, re.compile(b"|".join(map(re.escape, tokens)))
        docs = chunk.docs.tolist()
        found = [(*m.span(), number[m.group()]) for a, b in zip(docs[:-1], docs[1:]) for m in pattern.finditer(data, a, b)]
    starts, ends, which = np.array(found, np.int64).reshape(-1, 3).T
    return starts, ends, which


def pieces(chunk: textnum.Chunk, whole: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pieces, and offsets of each document's pieces.

    Texts are cut where no token can span for a tokenizer that drops white
    space, lowers case and splits letters from other characters: at ASCII
    white space and between an ASCII letter and another ASCII character
    (but not after an apostrophe, which may start a contraction). The byte
    ranges from the starts to the ends in ``whole``, the tokenizer's added
    tokens, are a piece each. Encoding the pieces one by one thus gives the
    ids of the whole text.
    """
    data = chunk.data
    inside = textnum.NOT_SPACE[data]
    letter, other = _LETTER[data], _OTHER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[chunk.docs] = True
    if len(data):
        cut[0] = cut[-1] = True
        cut[1:-1] |= (letter[:-1] & other[1:]) | (other[:-1] & letter[1:] & (data[:-1] != _APOSTROPHE))
        cut[1:-1] |= inside[1:] != inside[:-1]
    for a, b in zip(*(x.tolist() for x in whole)) if whole else ():
        inside[a:b], cut[a:b] = True, False
        cut[a] = cut[b] = True
    starts = np.flatnonzero(inside & cut[:-1])
    ends = np.flatnonzero(inside & cut[1:]) + 1
    return starts, ends, np.searchsorted(starts, chunk.docs)


class _Pieces:
    """Ids of the pieces seen, by the 64-bit hash of their lowered bytes, or of an added token's number.

    Texts go to a tokenizer of other steps or tokens whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.tokens = tokenizer, added_tokens(tokenizer) if cuts_hold(tokenizer) else None
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def documents(self, chunk: textnum.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk, and offsets of each document's ids."""
        if self.tokens is None:
            texts = [chunk.text(i).decode("utf-8", "replace") for i in range(len(chunk.docs) - 1)]
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(found), np.cumsum([0, *map(len, found)])
        begin, end, which = literals(chunk, self.tokens)
        starts, ends, offsets = pieces(chunk, (begin, end))
        hashes = textnum.word_hashes(chunk, starts, ends)
        # Apart from the same bytes in capitals, which aren't the token.
        hashes[np.searchsorted(starts, begin)] = textnum.mix(~which.astype(np.uint64))
        ids, total = self.encode(chunk, starts, ends, hashes)
        return ids, np.concatenate([[0], total])[offsets]

    def encode(self, chunk: textnum.Chunk, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the given pieces, and the running number of ids."""
        hashes, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != hashes
        if new.any():
            data = chunk.data.tobytes()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            rows = len(self.ends) - 1 + np.arange(len(found))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.keys, self.rows = np.insert(self.keys, at[new], hashes[new]), np.insert(self.rows, at[new], rows)
            at = np.searchsorted(self.keys, hashes)
        rows = self.rows[at][group]
        sizes = self.ends[rows + 1] - self.ends[rows]
        total = np.cumsum(sizes)
        n = int(total[-1]) if len(total) else 0
        return self.flat[np.arange(n) + np.repeat(self.ends[rows] - (total - sizes), sizes)], total


_caches: dict[str, _Pieces] = {}


def _worker_cache(path: str) -> _Pieces:
    """The cache outlives a task, as Spark reuses its Python workers."""
    cache = _caches.get(path)
    if cache is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        cache = _caches[path] = _Pieces(Tokenizer.from_file(path))
    elif len(cache.keys) > CACHE_PIECES:
        cache = _caches[path] = _Pieces(cache.tokenizer)
    return cache


def _tokenise(path: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textnum.chunks(batch.column(1), 4 * textnum.CHUNK_BYTES):  # pieces repeat more in a longer chunk
                ids, cuts = _worker_cache(path).documents(chunk)
                ids = np.insert(ids, cuts[1:], end_id).astype(kind)
                cuts += np.arange(len(cuts))
                out = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, len(out)), pa.array(out, pa.binary()), pa.array(np.diff(cuts))],
                    ["doc_id", "ids", "n"],
                )

    return run


# --- operator ------------------------------------------------------------------

def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(doc_id, ids, n) of all documents as a staged table, and the kind of ``ids``."""
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    rows = bound_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {_type(rows, 'doc_id')}, ids binary, n long"
    return stage(rows.mapInArrow(_tokenise(tokenizer_path, end_id, kind), schema), "token-ids"), kind


def id_counts(ids: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all documents; each task sends one row per id it has seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column(0):
                found = np.bincount(np.frombuffer(value.as_buffer(), kind), minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(ids: DataFrame, kind: str, path: str) -> None:
    """Write ``ids`` (doc_id, ids, n) in ascending doc_id order in the file format."""
    spark = ids.sparkSession
    counted = id_counts(ids, kind).collect()  # at most one row per vocabulary entry
    counts = np.zeros(max([r["id"] for r in counted], default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        names, parts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays(names)
            row = [
                pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([start], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                pa.array([[len(x) for x in parts]], pa.list_(pa.int64())),
                pa.array([encode_block(np.concatenate(parts), lengths, codes)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(row, ["shard", "block", "start", "doc_ids", "lengths", "payload"])

        for batch in batches:
            doc_ids, values = batch.column(0), batch.column(1)
            for i in range(len(batch)):
                names.append(doc_ids.slice(i, 1))
                parts.append(np.frombuffer(values[i].as_buffer(), kind))
                size += len(parts[-1])
                if size >= BLOCK_IDS:
                    yield flush()
                    block, start = block + 1, start + size
                    names, parts, size = [], [], 0
        if names:
            yield flush()

    total = int(counts.sum())
    schema = f"shard long, block long, start long, doc_ids array<{_type(ids, 'doc_id')}>, lengths array<long>, payload binary"
    (
        ids.select("doc_id", "ids")
        .repartitionByRange(max(1, -(-total // SHARD_IDS)), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
        .mapInArrow(encode, schema)
        .write.option("compression", "none")
        .parquet(f"{path}/shards")
    )


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document, from the files alone."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most one row per vocabulary entry
    lengths = np.zeros(max([r["id"] for r in book], default=0) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["bits"]
    shards = spark.read.parquet(f"{path}/shards")
    n = F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")
    files = shards.groupBy("shard").agg(n).withColumn("group", F.floor(F.col("shard") / FILE_GROUP))
    base, before = [], 0
    for r in files.groupBy("group").agg(F.sum("n").alias("n")).orderBy("group").collect():  # one row per FILE_GROUP files
        base.append((r["group"], before))
        before += r["n"]
    groups = spark.createDataFrame(base, "group long, of_group long")
    ahead = F.sum("n").over(Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = files.withColumn("ahead", F.coalesce(ahead, F.lit(0))).join(groups, "group")
    bases = stage(bases.select("shard", (F.col("of_group") + F.col("ahead")).alias("base")), "file-bases")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = decode_tables(lengths)
        for batch in batches:
            first, doc_ids, sizes, payloads, base = (batch.column(i) for i in range(5))
            for i in range(len(batch)):
                ids = decode_block(payloads[i].as_py(), tables).astype("<u4")
                n = np.array(sizes[i].as_py(), np.int64)
                ends = np.cumsum(n)
                each = [ids[a:b].tobytes() for a, b in zip(ends - n, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids[i].values, pa.array(base[i].as_py() + first[i].as_py() + ends - n), pa.array(n),
                        pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    # Joined before they are decoded: what may move is compressed.
    blocks = shards.join(bases, "shard").select("start", "doc_ids", "lengths", "payload", "base")
    return blocks.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")


def encode_corpus(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Tokenise ``docs``, write them to ``path`` (a new folder in the shared one by default) and return it.

    A null or empty text gives the end id alone. Rows without an id come
    first; rows that share an id are neighbours in any order. An empty table
    gives files without blocks. Other columns are not read.
    """
    path = path or stage_path(docs.sparkSession, "huffman-ids")
    ids, kind = token_ids(docs, tokenizer_path, end_id, id_col, text_col)
    write_ids(ids, kind, path)
    unstage(ids)
    return path
