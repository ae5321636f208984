"""Sampled pieces and Huffman-coded ids."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadlens.llm import huffman_ids, sample_pieces, textnum
from threadlens.llm.queries import QUERIES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "don't we're I'LL x!'s a.b 'tis it’s “q”. é. .́a á̧b 12a3 a1  x\x1cy a b c ＡＢ ﬁ İI ΑΣ σΣ.日本。ok a̸b",
    "", "   ", "\n", "'", "''s", "a''s's", "Å", "x\u0085y", "\x00a\x7fb", "🙂a🙂", " lead", "tail ", "a▁b ▁", "日本語𐍈🙂 ok", "x" * 5000, "a  b   c", None,
]


@pytest.fixture(scope="module")
def odd_docs(spark):
    return spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(ODD)], "doc_id long, text string")


def test_pieces_round_trip(odd_docs):
    got = sample_pieces.decode(sample_pieces.encode(odd_docs, PIECES), PIECES).collect()
    assert all(r["decoded"] == r["text"] for r in got)
    assert [r["piece_ids"] for r in got if r["text"] is None] == [None]
    assert [r["piece_ids"] for r in got if r["text"] == ""] == [[]]


def test_pieces_edges(edge_docs, no_docs):
    got = sample_pieces.decode(sample_pieces.encode(edge_docs, PIECES), PIECES)
    assert got.count() == got.filter("decoded <=> text").count() == edge_docs.count()
    assert sample_pieces.decode(sample_pieces.encode(no_docs, PIECES), PIECES).collect() == []


def test_pieces_depend_on_the_row_alone(spark, odd_docs):
    a = sample_pieces.encode(odd_docs, PIECES, keep_text=False).collect()
    b = sample_pieces.encode(odd_docs.orderBy(F.desc("doc_id")).repartition(7), PIECES, keep_text=False).collect()
    c = sample_pieces.encode(odd_docs, PIECES, seed=10, keep_text=False).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) != sorted(map(str, c))


def test_samples_follow_the_lattice():
    """The shares of drawn segmentations are those of the paths' weights."""
    vocabulary = sample_pieces.Vocabulary(PIECES)
    word = b" there"
    ids = {}
    for i, piece in enumerate(vocabulary.bytes):
        if piece and i not in vocabulary.byte_id:
            ids[piece] = i
    weights = {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(edges[:-1], edges[1:])]
        if all(p in ids for p in parts):
            weights[tuple(ids[p] for p in parts)] = np.exp(sum(vocabulary.log_weight[ids[p]] for p in parts))
    total = sum(weights.values())
    n = 40_000
    data, docs = np.frombuffer(word * n, np.uint8), np.arange(n + 1) * len(word)
    found = sample_pieces.sample(sample_pieces._Lattices(vocabulary), data, docs, textnum.mix(np.arange(n, dtype=np.uint64)))
    drawn = {}
    for row in found.reshape(n, -1):
        key = tuple(row[row >= 0].tolist())
        drawn[key] = drawn.get(key, 0) + 1
    assert set(drawn) <= set(weights) and len(weights) > 4
    for path, w in weights.items():
        p = w / total
        assert abs(drawn.get(path, 0) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_pieces_query(spark, sf_dir):
    got = QUERIES["op9_sample_pieces"](spark, sf_dir)
    assert got.count() == got.filter("lossless").count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


# --- Huffman ------------------------------------------------------------------------------

def _plain_huffman(counts):
    import heapq

    heap = [(c, i, [i]) for i, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            lengths[i] += 1
        heapq.heappush(heap, (a[0] + b[0], len(counts) + len(heap), a[2] + b[2]))
    return lengths


def test_code_lengths():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 1000, 300)
    lengths = huffman_ids.code_lengths(counts)
    assert (lengths * counts).sum() == (np.array(_plain_huffman(counts.tolist())) * counts).sum()
    steep = np.array([2**min(i, 60) for i in range(40)])
    limited = huffman_ids.code_lengths(steep)
    assert limited.max() <= 16 and sum(2.0 ** -int(x) for x in limited) <= 1
    assert huffman_ids.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    assert huffman_ids.code_lengths(np.zeros(0, np.int64)).tolist() == []
    # The best limited code of a small case, by trying all.
    few, limit = [1, 1, 2, 4, 9], 3
    best = min(
        sum(c * x for c, x in zip(few, t)) for t in itertools.product(range(1, limit + 1), repeat=5) if sum(2.0**-x for x in t) <= 1
    )
    assert int((huffman_ids.code_lengths(np.array(few), limit) * np.array(few)).sum()) == best


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 70_000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) * 37 % 49_000, 48_999).astype(np.uint32)
    counts = np.bincount(ids, minlength=10)
    lengths = huffman_ids.code_lengths(counts)
    block = huffman_ids.encode_block(ids, lengths, huffman_ids.canonical_codes(lengths))
    assert (huffman_ids.decode_block(block, huffman_ids.decode_tables(lengths)) == ids).all()
    with pytest.raises(ValueError):
        huffman_ids.decode_block(b"nope" + block[4:], huffman_ids.decode_tables(lengths))


def test_more_ids_than_16_bits_number():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.permutation(90_000), rng.geometric(0.3, 50_000)]).astype(np.uint32)
    lengths = huffman_ids.code_lengths(np.bincount(ids))
    assert 16 < lengths.max() <= huffman_ids.code_limit(90_000) == 19
    tables = huffman_ids.decode_tables(lengths)
    block = huffman_ids.encode_block(ids, lengths, huffman_ids.canonical_codes(lengths))
    assert (huffman_ids.decode_block(block, tables) == ids).all()


def _expected(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    out, start = {}, 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out[i, text] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    return out


def test_ids_from_files(spark, odd_docs, monkeypatch):
    """Several shards and blocks, odd texts, a null id first."""
    monkeypatch.setattr(huffman_ids, "BLOCK_IDS", 50)
    monkeypatch.setattr(huffman_ids, "SHARD_IDS", 200)
    monkeypatch.setattr(huffman_ids, "FILE_GROUP", 2)
    path = huffman_ids.encode_corpus(odd_docs, WORDS)
    assert spark.read.parquet(f"{path}/shards").select("shard").distinct().count() > 1
    expected = {i: v for (i, _), v in _expected([(r["doc_id"], r["text"]) for r in odd_docs.collect()]).items()}
    for r in huffman_ids.read_ids(spark, path).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], ids) == expected[r["doc_id"]]


def test_ids_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = {i: v[:3] for (i, _), v in _expected(rows).items()}
    got = QUERIES["op10_token_ids"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == expected


def test_ids_edges(spark, edge_docs, no_docs):
    got = huffman_ids.read_ids(spark, huffman_ids.encode_corpus(edge_docs, WORDS)).collect()
    assert len(got) == edge_docs.count() and sorted(r["start"] for r in got)[0] == 0
    assert huffman_ids.read_ids(spark, huffman_ids.encode_corpus(no_docs, WORDS)).collect() == []


def test_pieces_of_a_chunk_cover_it():
    text = "a.b don't  x1\né"
    (chunk,) = textnum.chunks(pa.array([text, "", None, "z"]))
    starts, ends, offsets = huffman_ids.pieces(chunk)
    assert b"".join(chunk.data[a:b].tobytes() for a, b in zip(starts, ends)).decode() == text.replace(" ", "").replace("\n", "") + "z"
    assert np.diff(offsets).tolist()[1:] == [0, 0, 1]


#: Texts with the tokenizer's added tokens: bare, glued, repeated, in capitals, cut short and over a border of rows.
ADDED = [
    f"{lead}{token}{tail}"
    for token in ("<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|EndOfText|>", "<|ENDOFTEXT|>", "<|endoftext", "endoftext|>", "<|end oftext|>")
    for lead, tail in (("", ""), ("ab ", " cd"), ("ab", "cd"), ("x!", "!y"), ("x'", "s it"), ("é", "\u0301a"), ("1", "2"), ("<|", "|>"), ("\n", "\n"))
] + ["<|endoftext|><|startoftext|><|endoftext|>a<|endoftext|><|ENDOFTEXT|>", "ab <|endo", "ftext|> cd", "<|", "endoftext|>"]


def test_added_tokens_stay_whole(spark):
    rows = list(enumerate(ADDED))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    expected = {i: v for (i, _), v in _expected(rows).items()}
    assert [3937, 49407, 4480, 2] in [v[3] for v in expected.values()]
    for r in huffman_ids.read_ids(spark, huffman_ids.encode_corpus(docs, WORDS)).collect():
        assert (r["start"], r["n_tokens"], r["ids_crc32"], np.frombuffer(r["ids"], "<u4").tolist()) == expected[r["doc_id"]], ADDED[r["doc_id"]]


@pytest.mark.parametrize("options", [{}, {"lstrip": True, "rstrip": True}, {"normalized": True}, {"single_word": True}])
def test_added_tokens_of_any_kind(options):
    """Overlapping tokens, one with a space, found raw, after normalising, or as words only."""
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.add_tokens([AddedToken(t, **({"normalized": False} | options)) for t in ("<a", "<a b>", "x9y")])
    texts = ["<a b> <a  b> z<a b>z <A B><a", "", "x9y x9yz ax9y X9Y", "<a", " b>", "<|endoftext|>x9y"]
    (chunk,) = textnum.chunks(pa.array(texts))
    cache = huffman_ids._Pieces(tokenizer)
    for _ in range(2):
        ids, cuts = cache.documents(chunk)
        got = [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_get_whole_texts():
    """One that keeps case and white space, and the known one with another step, or cut off."""
    from tokenizers import Tokenizer, normalizers

    cased, stripped, short = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(WORDS), Tokenizer.from_file(WORDS)
    stripped.normalizer = normalizers.NFC()
    short.enable_truncation(3)
    assert huffman_ids.cuts_hold(Tokenizer.from_file(WORDS))
    texts = ["A a x1", "a  A", "", "don't  Do x2 y z"]
    (chunk,) = textnum.chunks(pa.array(texts))
    for tokenizer in (cased, stripped, short):
        assert not huffman_ids.cuts_hold(tokenizer)
        ids, cuts = huffman_ids._Pieces(tokenizer).documents(chunk)
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
