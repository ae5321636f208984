"""Quality classifier: a weak-label model trains a hashed linear scorer.

Two faults are judged, ``junk`` and ``toxic``. For each, overlapping heuristic
labellers (and the reviewers' labels, where there are any) vote fault, fine or
abstain. Expectation-maximisation over the vote patterns of all documents
estimates each labeller's accuracy for each class and so each pattern's
posterior; only the counts by pattern (at most 3 to the number of labellers)
reach the driver. A bounded sample of the documents with the most certain
posteriors then trains a sparse logistic scorer over hashed features: words,
word prefixes and bucketed text statistics. All documents are scored by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm import textnum
from threadlens.llm.staging import bound_batches, free_name, stage

FINE, FAULT, ABSTAIN = 0, 1, 2
FEATURE_BITS = 20
SAMPLE_FAULTY = 3000  # training documents of each class and head, at most
SAMPLE_FINE = 6000
CERTAIN = 0.95
PREFIXES = (4, 5, 6)
MIN_DOCS = 3
SCREENED = 4096
MIN_Z = 4.0
L1 = 0.2
STEPS = 200
THRESHOLD = 0.5

# Plain insults that the toxicity labellers look for.
INSULTS = (
    "idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic",
    "disgusting", "clown", "dumb", "jerk", "fool", "imbecile", "garbage",
)

# English function words; the insult lists say nothing about other languages.
ENGLISH = ("the", "of", "and", "to", "in", "that", "is", "for", "with", "are", "was", "on")
ENGLISH_SHARE = 0.05

HEADS = {
    "junk": ("symbols", "shouting", "repeats", "separators", "vocabulary", "tails", "reviewer"),
    "toxic": ("insult", "insult_rate", "insult_kinds", "reviewer"),
}
STATS = ("symbols", "upper", "repeats", "separators", "distinct", "tails")


# --- text statistics and votes -----------------------------------------------------

def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_UPPER = _class(bytes(range(65, 91)))
_LOWER = _class(bytes(range(97, 123)))
_SYMBOL = _class(b"!#$%&*+<=>@[]^_`{|}~\\")


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    chunk = textnum.Chunk(0, 1, data, np.array([0, len(data)]))
    starts, ends, _ = textnum.words(chunk, textnum.ALNUM)
    return np.sort(textnum.word_hashes(chunk, starts, ends))


@dataclass
class _Text:
    """A chunk's statistics by document and its word hashes."""

    stats: np.ndarray  # documents x STATS
    n: np.ndarray  # white-space words
    insults: np.ndarray
    insult_kinds: np.ndarray
    english: np.ndarray


def _read(chunk: textnum.Chunk, lists: tuple[np.ndarray, np.ndarray]) -> _Text:
    insults, function_words = lists
    data, docs = chunk.data, chunk.docs
    size = np.maximum(np.diff(docs), 1)
    upper, lower = _per_doc(_UPPER[data], docs), _per_doc(_LOWER[data], docs)
    starts, ends, offsets = textnum.words(chunk, textnum.NOT_SPACE)
    hashes = textnum.word_hashes(chunk, starts, ends)
    doc = textnum.doc_numbers(offsets)
    n = np.diff(offsets)
    words = np.maximum(n, 1)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    lone = (ends - starts == 1) & _SYMBOL[data[starts]] if len(starts) else np.zeros(0, bool)
    tail = (ends - starts > 1) & _SYMBOL[data[ends - 1]] if len(starts) else np.zeros(0, bool)
    order = np.lexsort((hashes, doc))
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    stats = np.stack(
        [
            _per_doc(_SYMBOL[data], docs) / size,
            upper / np.maximum(upper + lower, 1),
            _per_doc(again, offsets) / words,
            _per_doc(lone, offsets) / words,
            np.bincount(doc[order][first], minlength=len(n)) / words,
            _per_doc(tail, offsets) / words,
        ],
        axis=1,
    )
    starts, ends, offsets = textnum.words(chunk, textnum.ALNUM)
    hashes = textnum.word_hashes(chunk, starts, ends)
    at = np.flatnonzero(np.isin(hashes, insults))
    doc = np.searchsorted(offsets, at, "right") - 1
    kinds = np.unique(np.stack([doc.astype(np.uint64), hashes[at]]), axis=1)
    english = _per_doc(np.isin(hashes, function_words), offsets) >= ENGLISH_SHARE * np.diff(offsets)
    return _Text(stats, n, np.bincount(doc, minlength=len(n)), np.bincount(kinds[0].astype(np.int64), minlength=len(n)), english)


def _vote(value: np.ndarray, fine_below: float, fault_above: float) -> np.ndarray:
    return np.where(value > fault_above, FAULT, np.where(value < fine_below, FINE, ABSTAIN))


def _votes(t: _Text) -> dict[str, np.ndarray]:
    """Votes of all labellers but the reviewers, by head: documents x labellers."""
    s = {name: t.stats[:, i] for i, name in enumerate(STATS)}
    short = t.n < 20
    junk = [
        _vote(s["symbols"], 0.02, 0.08),
        _vote(s["upper"], 0.2, 0.6),
        _vote(s["repeats"], 0.05, 0.3),
        _vote(s["separators"], 0.05, 0.2),
        np.where(short, ABSTAIN, np.where((s["distinct"] < 0.25) & (t.n < 2000), FAULT, np.where(s["distinct"] > 0.4, FINE, ABSTAIN))),
        _vote(s["tails"], 0.05, 0.4),
    ]
    none = np.where(t.english & (t.insults == 0), FINE, ABSTAIN)
    toxic = [
        np.where(t.insults > 0, FAULT, none),
        np.where(t.insults / np.maximum(t.n, 1) > 0.002, FAULT, ABSTAIN),
        np.where(t.insult_kinds > 1, FAULT, ABSTAIN),
    ]
    return {"junk": np.stack(junk, axis=1), "toxic": np.stack(toxic, axis=1)}


def _code(votes: np.ndarray) -> np.ndarray:
    """A vote row as one number, base 3."""
    return (votes * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def _decode(code: int, labellers: int) -> list[int]:
    return [code // 3**j % 3 for j in range(labellers)]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def heuristic_votes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, junk, toxic): each document's votes as base-3 numbers; t is a hash of the text."""
    rows = _texts(bound_batches(docs), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _hashes(INSULTS), _hashes(ENGLISH)
        for batch in batches:
            for chunk in textnum.chunks(batch.column(2)):
                codes = {head: _code(v) for head, v in _votes(_read(chunk, lists)).items()}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(chunk.first, chunk.last - chunk.first) for i in range(2)] + [pa.array(codes[h], pa.int64()) for h in HEADS],
                    ["id", "t", *HEADS],
                )

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], rows.schema["t"]] + [T.StructField(h, T.LongType()) for h in HEADS]))


# --- weak-label model ------------------------------------------------------------

@dataclass
class LabelModel:
    """Per labeller and class, the share of its votes that name the fault."""

    prior: float
    says_fault: np.ndarray  # labellers x (fine, fault)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log([1 - self.prior, self.prior]) + np.zeros((len(votes), 2))
        for j in range(votes.shape[1]):
            p = self.says_fault[j]
            log += np.where((votes[:, j] == FAULT)[:, None], np.log(p), 0) + np.where((votes[:, j] == FINE)[:, None], np.log(1 - p), 0)
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))


def fit_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns (patterns x labellers) and their counts."""
    labellers = votes.shape[1]
    model = LabelModel(0.1, np.tile([0.05, 0.8], (labellers, 1)))
    for _ in range(rounds):
        q = model.posterior(votes)
        weight = np.stack([(1 - q) * counts, q * counts], axis=1)
        says = np.stack(
            [
                ((votes[:, [j]] == FAULT) * weight).sum(axis=0) + np.array([0.05, 0.8]) * 2
                for j in range(labellers)
            ]
        ) / np.stack([((votes[:, [j]] != ABSTAIN) * weight).sum(axis=0) + 2 for j in range(labellers)])
        # A labeller is better than chance: its votes can't be read the other way round.
        says = np.clip(says, 1e-4, 1 - 1e-4)
        says[:, 1] = np.maximum(says[:, 1], says[:, 0] + 1e-4)
        found = LabelModel(float(np.clip(weight[:, 1].sum() / max(counts.sum(), 1), 1e-4, 0.5)), np.minimum(says, 1 - 1e-4))
        done = np.abs(found.says_fault - model.says_fault).max() < 1e-7
        model = found
        if done:
            break
    return model


# --- hashed linear scorer ----------------------------------------------------------

def _features(chunk: textnum.Chunk, lists: tuple[np.ndarray, np.ndarray], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once, by document; of the ``wanted`` features, if given."""
    t = _read(chunk, lists)
    starts, ends, offsets = textnum.words(chunk, textnum.ALNUM)
    doc = textnum.doc_numbers(offsets)
    spans = textnum.Spans(chunk.data)
    shift = np.uint64(64 - FEATURE_BITS)
    docs, found = [], []

    def add(at: np.ndarray, feature: np.ndarray) -> None:
        keep = slice(None) if wanted is None else wanted[feature]
        docs.append(at[keep])
        found.append(feature[keep])

    add(doc, spans.hashes(starts, ends) >> shift)
    for size in PREFIXES:
        long = ends - starts > size
        add(doc[long], textnum.mix(spans.hashes(starts[long], starts[long] + size) + np.uint64(size)) >> shift)
    n_docs = len(t.n)
    for j in range(len(STATS)):
        bucket = np.minimum(t.stats[:, j] * 20, 19).astype(np.uint64)
        add(np.arange(n_docs), textnum.mix(bucket + np.uint64(1000 * (j + 1))) >> shift)
    pairs = np.unique(np.concatenate(docs).astype(np.uint64) << np.uint64(FEATURE_BITS) | np.concatenate(found))
    return (pairs >> np.uint64(FEATURE_BITS)).astype(np.int64), (pairs & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64)


@dataclass
class Scorer:
    """Weights of the features that have any, in order of the feature."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, doc: np.ndarray, feature: np.ndarray, n_docs: int) -> np.ndarray:
        total = np.full(n_docs, self.bias)
        if len(self.features):
            at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
            mine = self.features[at] == feature
            total += np.bincount(doc[mine], weights=self.weights[at[mine]], minlength=n_docs)
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def screen(counts: DataFrame, n0: float, n1: float) -> np.ndarray:
    """The SCREENED features (feature, with0, with1) that tell the classes apart most, in order."""
    p1, p0 = (F.col("with1") + 0.5) / (n1 + 1), (F.col("with0") + 0.5) / (n0 + 1)
    p = (F.col("with1") + F.col("with0") + 1) / (n1 + n0 + 2)
    z = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    told = counts.filter(F.col("with0") + F.col("with1") >= MIN_DOCS).select("feature", z.alias("z")).filter(F.col("z") > MIN_Z)
    return np.sort(np.array([r.feature for r in told.orderBy(F.desc("z"), "feature").limit(SCREENED).collect()], np.int64))


def fit_scorer(features: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> Scorer:
    """L1-penalised logistic regression; ``rows`` hold positions in ``features``."""
    n1, n0 = target.sum(), (1 - target).sum()
    if not len(features):
        return Scorer(features, np.zeros(0), float(np.log(n1 / n0)))
    col, row = np.concatenate(rows).astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    w, bias, slope = np.zeros(len(features)), float(np.log(n1 / n0)), np.full(len(features) + 1, 1e-8)
    for _ in range(STEPS):  # proximal AdaGrad on the whole sample
        residual = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col], minlength=len(rows)) + bias, -60, 60))) - target
        gradient = np.append(np.bincount(col, weights=residual[row], minlength=len(features)), residual.sum())
        slope += gradient**2
        rate = 0.5 / np.sqrt(slope)
        w = w - rate[:-1] * gradient[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate[:-1] * L1, 0)
        bias -= rate[-1] * gradient[-1]
    used = np.flatnonzero(w)
    return Scorer(features[used], w[used], float(bias))


@dataclass
class Model:
    labels: dict[str, LabelModel]
    scorers: dict[str, Scorer]


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit both heads on ``docs``; ``labels`` (the id, quality 0/1, toxic 0/1) may be empty or None.

    Documents without a review have an abstaining reviewer; of repeated
    reviews the worst counts. Documents with a null id are voted on, but have
    no review.
    """
    votes = heuristic_votes(docs, id_col, text_col)
    if labels is None:
        reviews = votes.select("id").limit(0).withColumns({"bad": F.lit(0), "mean": F.lit(0)})
    else:
        reviews = labels.groupBy(F.col(id_col).alias("id")).agg(
            (F.lit(1) - F.min("quality")).alias("bad"), F.max("toxic").alias("mean")
        )
    review = {"junk": "bad", "toxic": "mean"}
    votes = votes.join(reviews, "id", "left").select(
        "id", "t",
        *[
            (F.col(h) + F.coalesce(F.col(review[h]), F.lit(ABSTAIN)) * 3 ** (len(HEADS[h]) - 1)).cast("long").alias(h)
            for h in HEADS
        ],
    )
    votes = stage(votes, "votes")
    label_models, scorers = {}, {}
    for head, labellers in HEADS.items():
        patterns = votes.groupBy(head).count().collect()  # at most 3 ** labellers rows
        matrix = np.array([_decode(r[head], len(labellers)) for r in patterns]).reshape(-1, len(labellers))
        label_models[head] = fit_labels(matrix, np.array([r["count"] for r in patterns], float))
        posterior = label_models[head].posterior(matrix)
        # Every pattern with a vote and a certain posterior, at one rate for each class:
        # preferring the most certain would favour what the labellers know best.
        voted = (matrix != ABSTAIN).any(axis=1)
        counts = np.array([r["count"] for r in patterns], float)
        rates = {}
        for wanted, most in ((1, SAMPLE_FAULTY), (0, SAMPLE_FINE)):
            certain = voted & ((posterior if wanted else 1 - posterior) > CERTAIN)
            rate = min(1.0, most / max(1.0, float(counts[certain].sum())))
            rates |= {patterns[i][head]: (float(wanted), rate) for i in np.flatnonzero(certain)}
        scorers[head] = _train(docs, votes, head, rates, id_col, text_col)
    return Model(label_models, scorers)


def _train(docs: DataFrame, votes: DataFrame, head: str, rates: dict, id_col: str, text_col: str) -> Scorer:
    """Draws the sample by id and text, each once; counts of its features are
    summed by Spark, and the driver gets the screened features alone."""
    never = Scorer(np.zeros(0, np.int64), np.zeros(0), -10.0)
    if not rates:
        return never
    spark = docs.sparkSession
    drawn = spark.createDataFrame([(k, t, r) for k, (t, r) in rates.items()], "pattern long, target double, rate double")
    draw = F.pmod(F.xxhash64("id", "t", F.lit(8)), F.lit(1 << 20)) / float(1 << 20)
    sample = (
        votes.filter("id is not null").join(F.broadcast(drawn), F.col(head) == F.col("pattern")).filter(draw < F.col("rate"))
        .groupBy("id", "t").agg(F.max("target").alias("target"))
    )
    # About SAMPLE_FAULTY + SAMPLE_FINE ids: a bounded broadcast.
    rows = _texts(docs, id_col, text_col).join(F.broadcast(sample), ["id", "t"])
    rows = stage(rows.groupBy("id", "t").agg(F.first("target").alias("target"), F.first("text").alias("text")).select("target", "text"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _hashes(INSULTS), _hashes(ENGLISH)
        size = 1 << FEATURE_BITS
        found = np.zeros((2, size), np.int32)
        for batch in batches:
            target = batch.column(0).to_numpy()
            for chunk in textnum.chunks(batch.column(1)):
                doc, feature = _features(chunk, lists)
                fault = target[chunk.first : chunk.last][doc] > 0.5
                found[0] += np.bincount(feature[~fault], minlength=size).astype(np.int32)
                found[1] += np.bincount(feature[fault], minlength=size).astype(np.int32)
        at = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[0][at].astype(np.int64)), pa.array(found[1][at].astype(np.int64))], ["feature", "with0", "with1"])

    sizes = dict(map(tuple, rows.groupBy((F.col("target") > 0.5).cast("int")).count().collect()))
    if len(sizes) < 2:
        return never
    counts = rows.mapInArrow(count, "feature long, with0 long, with1 long").groupBy("feature").agg(F.sum("with0").alias("with0"), F.sum("with1").alias("with1"))
    features = screen(counts, float(sizes[0]), float(sizes[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _hashes(INSULTS), _hashes(ENGLISH)
        wanted = np.zeros(1 << FEATURE_BITS, bool)
        wanted[features] = True
        for batch in batches:
            for chunk in textnum.chunks(batch.column(1)):
                doc, feature = _features(chunk, lists, wanted)
                at = np.searchsorted(features, feature).astype(np.uint16)
                ends = np.searchsorted(doc, np.arange(chunk.last - chunk.first + 1))
                values = [at[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, len(values)), pa.array(values, pa.binary())], ["target", "features"]
                )

    found = rows.mapInArrow(run, "target double, features binary").toArrow()
    return fit_scorer(features, [np.frombuffer(r.as_py(), np.uint16) for r in found.column(1)], found.column(0).to_numpy())


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True, out_col: str = "quality_check") -> DataFrame:
    """``docs`` with a struct ``out_col``: junk, toxic (probabilities), score, kept.

    ``score`` is the probability of neither fault, and a document is kept if
    neither reaches THRESHOLD. A null text counts as empty; an empty text has
    no words and is scored by its statistics alone. Long texts count whole. A
    column of ``docs`` called ``out_col`` (in any case) is replaced.
    """
    result = out_col
    names = [c for c in docs.columns if c.lower() != result.lower() and (keep_text or c != text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _hashes(INSULTS), _hashes(ENGLISH)
        wanted = np.zeros(1 << FEATURE_BITS, bool)
        for h in HEADS:
            wanted[model.scorers[h].features] = True
        for batch in batches:
            parts = {h: [np.zeros(0)] for h in HEADS}
            for chunk in textnum.chunks(batch.column(len(names))):
                doc, feature = _features(chunk, lists, wanted)
                for h in HEADS:
                    parts[h].append(model.scorers[h].score(doc, feature, chunk.last - chunk.first))
            p = {h: np.concatenate(parts[h]) for h in HEADS}
            kept = (p["junk"] < THRESHOLD) & (p["toxic"] < THRESHOLD)
            out = pa.StructArray.from_arrays(
                [pa.array(p["junk"]), pa.array(p["toxic"]), pa.array((1 - p["junk"]) * (1 - p["toxic"])), pa.array(kept)],
                ["junk", "toxic", "score", "kept"],
            )
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [out], names + [result])

    kind = T.StructType.fromDDL("junk double, toxic double, score double, kept boolean")
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(result, kind)])
    columns = [F.col(f"`{c}`") for c in names]
    return bound_batches(docs).select(*columns, F.col(f"`{text_col}`").cast("string").alias(free_name(names, "text"))).mapInArrow(run, schema)
