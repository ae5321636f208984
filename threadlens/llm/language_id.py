"""Language identification by nearest centroid.

A text's vector holds its hashed byte n-grams (1 to 4 bytes, A-Z lowered, all
ASCII but letters read as space) by normalised TF-IDF. Each language has
several centroids from spherical k-means; the nearest by cosine gives the
language. A text further from its centroid than nearly all of that centroid's
own members is marked as rejected.

The inverse document frequencies cover every training text. The centroids are
fitted on a bounded sample: ``SAMPLE_TEXTS`` vectors shared evenly by the
languages, but LEAST_TEXTS for each language at least (all it has, if fewer), so
with many languages the bound follows their number. A language's sample has the
least hashes of id and text; rows that repeat both are drawn once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm import textnum
from threadlens.llm.staging import bound_batches, free_name, stage

DIMS = 4096
SAMPLE_TEXTS = 3000
LEAST_TEXTS = 20
CLUSTERS = 4
ROUNDS = 12
#: Rejected below the mean cosine of a centroid's members less so many deviations.
REJECT_DEVIATIONS = 4.0
UNKNOWN = "und"

#: Byte as read by the n-grams.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_SHIFT = np.uint32(32 - 12)


def _counts(chunk: textnum.Chunk) -> np.ndarray:
    """Documents x DIMS counts of the n-grams that lie within one document."""
    n_docs = len(chunk.docs) - 1
    folded = _FOLD[chunk.data].astype(np.uint32)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(chunk.docs))
    # Runs of spaces count once.
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0x20) | (folded[:-1] != 0x20) | (doc[1:] != doc[:-1])
    folded, doc = folded[keep], doc[keep]
    out = np.zeros(n_docs * DIMS, np.float32)
    gram = np.zeros(len(folded), np.uint32)
    for width in range(1, 5):
        if len(folded) < width:
            break
        gram = gram[: len(folded) - width + 1] * np.uint32(257) + folded[width - 1 :] + np.uint32(width << 20)
        same = doc[: len(gram)] == doc[width - 1 :]
        if width == 1:  # a lone space says nothing
            same &= folded != 0x20
        bins = (gram * np.uint32(0x9E3779B1)) >> _SHIFT
        out += np.bincount(doc[: len(gram)][same] * DIMS + bins[same], minlength=len(out))
    return out.reshape(n_docs, DIMS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _vectors(chunk: textnum.Chunk, idf: np.ndarray) -> np.ndarray:
    counts = _counts(chunk)
    return _unit(np.log1p(counts) * idf)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of each centroid
    least: np.ndarray  # the cosine below which a centroid rejects


def in_training(doc_id: Column) -> Column:
    """Whether the remainder of crc32(id as text) by 4 isn't 2; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts; tasks send sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for chunk in textnum.chunks(batch.column(0), textnum.CHUNK_BYTES, 128):
                total += (_counts(chunk) > 0).sum(axis=0)
                n += chunk.last - chunk.first
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(total, n))], ["feature", "n"])

    out = np.zeros(DIMS + 1, np.int64)
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "feature long, n long")
    for r in rows.groupBy("feature").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows
        out[r["feature"]] = r["n"]
    return out[:-1], int(out[-1])


def _spherical_kmeans(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's centroid; seeds are the farthest rows in turn."""
    seeds = [int(np.argmax(x @ _unit(x.mean(axis=0, keepdims=True))[0]))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    centroids = x[seeds]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = _unit(sums)
    return centroids, np.argmax(x @ centroids.T, axis=1)


def _sample(rows: DataFrame) -> tuple[DataFrame, int]:
    """The sample's (lang, h), each language's least distinct hashes, and the number of languages."""
    keys = stage(rows.distinct(), "language-keys")
    sizes = stage(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")  # one row per language
    n_languages = sizes.count()
    share = max(LEAST_TEXTS, SAMPLE_TEXTS // max(1, n_languages))
    # A limit on the hash first, six deviations and more above the share, so that few rows are sorted.
    ample = share + 6 * share**0.5 + LEAST_TEXTS
    draw = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    few = keys.join(F.broadcast(sizes), "lang").filter(draw * F.col("n") < ample)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "h"))
    return few.withColumn("rank", rank).filter(F.col("rank") <= share).select("lang", "h"), n_languages


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the training texts that have a language."""
    train = bound_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        in_training(F.col("id")) & F.col("lang").isNotNull()
    )
    frequency, n = document_frequencies(train, "text")
    idf = (np.log((n + 1) / (frequency + 1)) + 1).astype(np.float32)
    train = train.filter(F.length("text") > 0).withColumn("h", F.xxhash64("id", "text", F.lit(5)))
    chosen, n_languages = _sample(train.select("lang", "h"))
    if not n_languages:
        return Model(idf, np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    sample = train.select("lang", "h", "text").join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textnum.chunks(batch.column(1), textnum.CHUNK_BYTES, 128):
                x = _vectors(chunk, idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, len(x)), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "vector"]
                )

    rows = sample.mapInArrow(vectors, "lang string, vector binary").collect()  # at most `chosen`
    centroids, languages, least = [], [], []
    for lang in sorted({r["lang"] for r in rows}):
        x = _unit(np.stack([np.frombuffer(r["vector"], np.float16) for r in rows if r["lang"] == lang]).astype(np.float32))
        own, member = _spherical_kmeans(x, CLUSTERS)
        for j in range(len(own)):
            cosine = x[member == j] @ own[j]
            least.append(float(cosine.mean() - REJECT_DEVIATIONS * cosine.std()) if len(cosine) else 0.0)
            centroids.append(own[j])
            languages.append(lang)
    return Model(idf, np.stack(centroids).astype(np.float32), languages, np.array(least))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col``, with a struct ``language``: lang, score, rejected.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if no language was learned. The score is the best cosine. Long texts
    count whole. A column of ``docs`` called ``language`` is replaced.
    """
    names = [c for c in docs.columns if c != text_col and c.lower() != "language"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = [], [], []
            for chunk in textnum.chunks(batch.column(len(names)), textnum.CHUNK_BYTES, 128):
                cosine = _vectors(chunk, model.idf) @ model.centroids.T
                for i in range(len(cosine)):
                    if not model.languages or not has_letter(chunk.text(i)):
                        langs.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                        continue
                    best = int(np.argmax(cosine[i]))
                    langs.append(model.languages[best])
                    scores.append(min(1.0, max(0.0, float(cosine[i, best]))))
                    rejected.append(scores[-1] < model.least[best])
            out = pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"]
            )
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [out], names + ["language"])

    schema = T.StructType(
        [docs.schema[c] for c in names] + [T.StructField("language", T.StructType.fromDDL("lang string, score double, rejected boolean"))]
    )
    columns = [F.col(f"`{c}`") for c in names]
    return bound_batches(docs).select(*columns, F.col(f"`{text_col}`").cast("string").alias(free_name(names, "text"))).mapInArrow(run, schema)
