"""Workaround detector: balanced logistic regression over TF-IDF blocks.

* out-of-fold probabilities with the features refit inside every fold (the
  vocabulary and idf of fold i never see fold i's documents);
* a final fit on all labelled rows, its strongest terms, and batch scoring of
  new threads with the saved bundle.

Tokenisation runs once; per-document term counts are checkpointed into the
shared checkpoint folder and re-used by the k + 1 fits.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.cues import BEHAVIOUR8, LIST_SEPARATOR, CueDictionary, augment_text, with_cue_array
from threadlens.functions.scoring import label_name, threshold_label
from threadlens.functions.text import clean_text, is_blank, lower_clean, made_once, primary_label_target, yes_no_target
from threadlens.operators import features as FT
from threadlens.operators.annotate import class_guard
from threadlens.operators.sampling import hash_order, sequence_number, stratified_folds
from threadlens.operators.threads import model_text
from threadlens.session import cut_lineage, drop_staged, staged


TRAIN_ROWS_PER_PARTITION = 5000
#: With more labelled rows than this the folds are trained one after the other.
PARALLEL_ROWS = 100_000
#: Of the slope at zero coefficients, a converged fit has at most this share left.
CERTIFIED_SHARE = 0.1


@dataclass(frozen=True)
class DetectorSpec:
    """Feature and classifier settings of one detector."""

    name: str
    word_max_features: int | None
    word_max_df: float | None
    char_max_features: int | None  # None: no character block
    C: float
    max_iter: int = 2000
    threshold: float = 0.5
    augment: CueDictionary | None = None
    improved_text: bool = False  # title-prefixed model text + primary-label target
    tol: float = 1e-4  # the reference classifiers' default tolerance
    min_rows: int = 0  # fewer labelled rows than this are refused
    extra: dict = field(default_factory=dict)


# --- fixed values: the two published detector configurations --------------------------
BASELINE = DetectorSpec("tfidf_logistic_regression", 5000, 0.95, None, 1.0, min_rows=10)
IMPROVED = DetectorSpec(
    "balanced_word_character_tfidf_logistic_regression", 12000, None, 12000, 1.5,
    augment=BEHAVIOUR8, improved_text=True,
)
# -----------------------------------------------------------------------------------------


def prepare_documents(labelled: DataFrame, spec: DetectorSpec) -> DataFrame:
    """``(doc, text, target, cues)`` for the labelled rows the detector trains on.

    Baseline: has_workaround yes/no, stripped thread text. Improved: any
    primary label, ``TITLE: t`` + thread, cue tokens appended (T10).
    Rows whose text is empty are dropped (F3).
    """
    if spec.improved_text:
        df = labelled.filter(~is_blank("primary_label")).select(
            F.col("annotation_id").alias("doc"),
            made_once(model_text("title", "thread_text")).alias("text"),
            primary_label_target("primary_label").alias("target"),
        )
    else:
        df = labelled.filter(lower_clean("has_workaround").isin("yes", "no")).select(
            F.col("annotation_id").alias("doc"),
            made_once(clean_text("thread_text")).alias("text"),
            yes_no_target("has_workaround").alias("target"),
        )
    df = df.filter(F.length("text") > 0)
    if spec.augment is not None:
        df = with_cue_array(df, "text", spec.augment, "_c")
        df = df.select(
            "doc", augment_text("text", "_c").alias("text"), "target", F.array_join("_c", LIST_SEPARATOR).alias("cues")
        )
    else:
        df = df.withColumn("cues", F.lit(""))
    return df


def training_set_summary(labelled: DataFrame, spec: DetectorSpec) -> DataFrame:
    """F2 + F3 + A7: rows considered, rows dropped for empty text, kept rows per class.

    One aggregation pass; the trainers drop the same rows in ``prepare_documents``.
    """
    if spec.improved_text:
        eligible = ~is_blank("primary_label")
        text = model_text("title", "thread_text")
        target = primary_label_target("primary_label")
    else:
        eligible = lower_clean("has_workaround").isin("yes", "no")
        text = clean_text("thread_text")
        target = yes_no_target("has_workaround")
    kept = eligible & (F.length(text) > 0)
    return labelled.agg(
        F.count_if(eligible).alias("considered_records"),
        F.count_if(eligible & (F.length(text) == 0)).alias("dropped_empty_text"),
        F.count_if(kept).alias("kept_records"),
        F.count_if(kept & (target == 1)).alias("workaround_records"),
        F.count_if(kept & (target == 0)).alias("non_workaround_records"),
    ).select(F.lit(spec.name).alias("model_name"), "*")


@dataclass
class CountTables:
    word: DataFrame
    char: DataFrame | None


def count_terms(docs: DataFrame, spec: DetectorSpec) -> CountTables:
    """Tokenise once; checkpoint ``(doc[, fold], term, tf)`` per block."""
    extra = ["fold"] if "fold" in docs.columns else []
    word = cut_lineage(FT.word_term_counts(docs, "doc", "text", FT.WORD_NGRAM_RANGE[1], extra))
    char = None
    if spec.char_max_features is not None:
        char = cut_lineage(FT.char_wb_term_counts(docs, "doc", "text", *FT.CHAR_NGRAM_RANGE, extra=extra))
    return CountTables(word, char)


@dataclass
class FeatureModel:
    word: FT.Vocabulary
    char: FT.Vocabulary | None

    @property
    def blocks(self) -> list[FT.Vocabulary]:
        return [self.word] if self.char is None else [self.word, self.char]

    @property
    def size(self) -> int:
        return sum(v.size for v in self.blocks)


def fit_features(word: DataFrame, char: DataFrame | None, n_train: int, spec: DetectorSpec) -> FeatureModel:
    """Vocabulary and idf from the term statistics of the training documents."""
    return FeatureModel(
        FT.vocabulary_of(word, n_train, spec.word_max_features, spec.word_max_df),
        None if char is None else FT.vocabulary_of(char, n_train, spec.char_max_features),
    )


def feature_entries(counts: CountTables, fm: FeatureModel) -> DataFrame:
    """``(doc, block, idx, w)`` of both blocks, the character block's indices after the words'."""
    entries = FT.weighted_entries(counts.word, fm.word, 0, 0)
    if fm.char is not None and counts.char is not None:
        entries = entries.unionByName(FT.weighted_entries(counts.char, fm.char, fm.word.size, 1))
    return entries


def featurize(counts: CountTables, docs: DataFrame, fm: FeatureModel) -> DataFrame:
    """``(doc, features)`` for ``docs``, the documents counted, with a fitted feature model (word ⧺ char).

    Both blocks' weights are unioned and grouped once per document.
    """
    return FT.assemble_blocks(feature_entries(counts, fm), fm.size, 2 if fm.char is not None else 1, docs)


def _balanced_weights(df: DataFrame, n: int, pos: int, neg: int) -> DataFrame:
    w1 = n / (2.0 * pos) if pos else 0.0
    w0 = n / (2.0 * neg) if neg else 0.0
    return df.withColumn("weight", F.when(F.col("target") == 1, F.lit(w1)).otherwise(F.lit(w0)))


def _train_partitions(df: DataFrame, n_train: int) -> int:
    """Every L-BFGS iteration is one aggregation job over the training rows: few
    tasks for few rows, but never more than two rounds of the cluster's cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(math.ceil(n_train / TRAIN_ROWS_PER_PARTITION), 2 * cores))


def fit_classifier(train: DataFrame, n_train: int, pos: int, neg: int, spec: DetectorSpec, dealt: bool = False) -> LogisticRegressionModel:
    """Class-balanced L2 logistic regression; ``regParam = 1 / (C * n)`` matches C-scaled loss.

    ``dealt``: the rows lie in ``_train_partitions`` partitions already and are not moved.
    """
    lr = LogisticRegression(
        featuresCol="features",
        labelCol="target",
        weightCol="weight",
        regParam=1.0 / (spec.C * n_train),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=True,
        maxIter=spec.max_iter,
        tol=spec.tol,
    )
    data = _balanced_weights(train, n_train, pos, neg).withColumn("target", F.col("target").cast("double"))
    parts = _train_partitions(train, n_train)
    return lr.setAggregationDepth(2 if parts <= 256 else 3).fit(data if dealt else data.repartition(parts))


def _class_counts(df: DataFrame) -> tuple[int, int]:
    counts = {r[0]: r[1] for r in df.groupBy("target").count().collect()}
    return int(counts.get(1, 0)), int(counts.get(0, 0))


def probability_of_positive(scored: DataFrame) -> DataFrame:
    return scored.withColumn("probability", vector_to_array("probability").getItem(1))


def _unique_ids(docs: DataFrame) -> None:
    """Counts and joins go by id, so an id must name one document."""
    if not docs.groupBy("doc").count().filter("count > 1").isEmpty():
        raise ValueError("ids of labelled rows must be unique; run the validation first")


def _score_fold(i: int, folds: DataFrame, counts: CountTables, fm: FeatureModel, spec: DetectorSpec, train: tuple[int, int]) -> DataFrame:
    """One fold's scores where a vocabulary has no cap: joins with the fold's own vocabulary."""
    tpos, tneg = train
    x = featurize(counts, folds, fm).join(folds, "doc")
    # Deterministic to recompute (sorted per-document entries), so a cached
    # copy is enough for the L-BFGS passes; the small score table is the
    # reliable checkpoint of the fold.
    x = x.persist(StorageLevel.MEMORY_AND_DISK)
    model = fit_classifier(x.filter(F.col("fold") != i), tpos + tneg, tpos, tneg, spec)
    scored = probability_of_positive(model.transform(x.filter(F.col("fold") == i)))
    scored = cut_lineage(scored.select("doc", "fold", "target", "cues", "probability"))
    x.unpersist()
    return scored


def _blocks(spec: DetectorSpec) -> list[int]:
    return [FT.TC.WORD] if spec.char_max_features is None else [FT.TC.WORD, FT.TC.CHAR]


def _caps(spec: DetectorSpec) -> list[int | None]:
    return [spec.word_max_features, spec.char_max_features][: len(_blocks(spec))]


def _max_dfs(spec: DetectorSpec) -> list[float | None]:
    return [spec.word_max_df, None][: len(_blocks(spec))]


def _capped(spec: DetectorSpec) -> bool:
    return spec.word_max_features is not None


def _fold_models(every: list[int], placed: DataFrame, spec: DetectorSpec, rows: dict[int, int], parallel: int) -> list[FeatureModel]:
    """The feature models of all training folds, from one pass over the texts."""
    from concurrent.futures import ThreadPoolExecutor

    blocks = _blocks(spec)
    if _capped(spec):
        stats = FT.capped_statistics(placed, "doc", "text", blocks, _caps(spec), _max_dfs(spec), rows)
    else:
        stats = cut_lineage(FT.nested_statistics(FT.document_statistics(placed, "doc", "text", blocks, ["fold"])))

    def fitted(i: int) -> FeatureModel:
        return fit_features(*[FT.without_nested(FT.block_of(stats, b), i) for b in blocks], *([None] if len(blocks) == 1 else []), rows[i], spec)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(fitted, every))


def _score_folds(every: list[int], placed: DataFrame, spec: DetectorSpec, sizes: dict, parallel: int) -> DataFrame:
    """``(doc, fold, target, cues, probability)``: each fold scored by a model of the others.

    ``placed`` has the documents' texts with their folds. All folds' vocabularies
    (bounded by the caps) are fitted from shared statistics; then the texts are
    coded once over their union, and a fold's features come row by row from the
    codes, without a join or an exchange. The folds run from a small thread pool.
    """
    from concurrent.futures import ThreadPoolExecutor

    def side(i: int) -> tuple[int, int]:
        return tuple(sum(n for (f, t), n in sizes.items() if f != i and t == wanted) for wanted in (1, 0))

    models = _fold_models(every, placed, spec, {i: sum(side(i)) for i in every}, parallel)
    columns = ["fold", "target", "cues"]
    if _capped(spec):
        vocab = FT.union_vocabulary([m.blocks for m in models])
        codes = staged(FT.coded_texts(placed, "doc", "text", vocab, columns))
        coded = codes.coalesce(_train_partitions(placed, sum(sizes.values())))

        def score_fold(at: int) -> DataFrame:
            i = every[at]
            tpos, tneg = side(i)
            # The trainer keeps its own copy of these rows for its passes.
            train = FT.vectors_of(coded.filter(F.col("fold") != i).select("target", "terms"), vocab, at)
            model = fit_classifier(train, tpos + tneg, tpos, tneg, spec, dealt=True)
            scored = model.transform(FT.vectors_of(coded.filter(F.col("fold") == i), vocab, at))
            return cut_lineage(probability_of_positive(scored).select("doc", "fold", "target", "cues", "probability"))

    else:
        folds, counts = placed.select("doc", *columns), count_terms(placed.select("doc", "fold", "text"), spec)

        def score_fold(at: int) -> DataFrame:
            return _score_fold(every[at], folds, counts, models[at], spec, side(every[at]))

    # The copies of the folds in training share the executors' memory.
    several = parallel if sum(sizes.values()) <= PARALLEL_ROWS else 1
    with ThreadPoolExecutor(max_workers=several) as pool:
        parts = list(pool.map(score_fold, range(len(every))))
    if _capped(spec):
        drop_staged(codes)
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    return scores


def out_of_fold(labelled: DataFrame, spec: DetectorSpec = IMPROVED, seed: int = 42, parallel_folds: int | None = None) -> DataFrame:
    """M6: ``(doc, fold, target, cues, probability)`` — every row scored exactly once.

    k = min(5, smallest class); folds are the stratified hash folds (W3). Terms
    are counted once with their document's fold; one aggregation by term then
    holds every training fold's statistics, by subtraction.
    """
    # Prepared once: the text regexes would else run again for each pass below.
    docs = staged(prepare_documents(labelled, spec))
    _unique_ids(docs)
    neg, pos, k = class_guard(docs, "target", spec.min_rows)
    placed = staged(stratified_folds(docs, "target", k, key="doc", seed=seed))
    drop_staged(docs)
    # k x 2 class counts in one small aggregate (bounded: folds x classes rows)
    sizes = {(r[0], r[1]): r[2] for r in placed.groupBy("fold", "target").count().collect()}
    scores = _score_folds(list(range(k)), placed.select("doc", "fold", "target", "cues", "text"), spec, sizes, parallel_folds or k)
    drop_staged(placed)
    return scores


def grouped_folds(docs: DataFrame, group_col: str, max_folds: int, seed: int = 42) -> DataFrame:
    """``docs`` with ``fold``: groups in hash order are dealt round-robin to at most
    ``max_folds`` folds, so a fold is one group as long as there are no more."""
    groups = docs.select(F.col(group_col).alias("_g")).distinct().withColumn("_o", hash_order(["_g"], seed))
    dealt = sequence_number(groups, ["_o", "_g"], out="_r").select("_g", ((F.col("_r") - 1) % max_folds).cast("int").alias("fold"))
    return docs.join(dealt, F.col(group_col) == F.col("_g")).drop("_g")


def leave_one_group_out(
    labelled: DataFrame, spec: DetectorSpec = IMPROVED, group_col: str = "repository", max_folds: int = 50, seed: int = 42, parallel_folds: int = 4
) -> DataFrame:
    """``(doc, group, fold, target, cues, probability)``: every row scored once, by a model
    that saw no row of its group (an extension; the surveyed product plans it).

    Up to ``max_folds`` groups are left out one by one; more groups share folds,
    so a model misses a few groups, never sees its own. A null group is the
    empty one. Statistics are kept by (term, fold), so the number of folds adds
    no columns. Raises ValueError where a training side lacks a class.
    """
    docs = cut_lineage(prepare_documents(labelled, spec))
    _unique_ids(docs)
    class_guard(docs, "target", spec.min_rows)
    groups = labelled.select(F.col("annotation_id").alias("doc"), F.coalesce(F.col(group_col), F.lit("")).alias("group"))
    folds = cut_lineage(grouped_folds(docs.drop("text").join(groups, "doc"), "group", max_folds, seed))
    sizes = {(r[0], r[1]): r[2] for r in folds.groupBy("fold", "target").count().collect()}  # at most 2 x max_folds rows
    every = sorted({f for f, _ in sizes})
    for i in every:
        if any(sum(n for (f, t), n in sizes.items() if f != i and t == wanted) == 0 for wanted in (0, 1)):
            raise ValueError(f"without fold {i} a class has no rows")
    placed = staged(docs.select("doc", "text").join(folds.drop("group"), "doc").select("doc", "fold", "target", "cues", "text"))
    scores = _score_folds(every, placed, spec, sizes, parallel_folds)
    return scores.join(folds.select("doc", "group"), "doc")


def oof_predictions(labelled: DataFrame, spec: DetectorSpec = IMPROVED) -> DataFrame:
    """M9 on the OOF scores: actual / predicted labels, probability, correctness, error type."""
    from threadlens.functions.scoring import error_type

    oof = out_of_fold(labelled, spec)
    meta_cols = [c for c in ["annotation_id", "repository", "issue_number", "title", "primary_label", "heuristic_score", "matched_patterns"] if c in labelled.columns]
    meta = labelled.select(*meta_cols).withColumnRenamed("annotation_id", "doc")
    out = oof.join(meta, "doc", "left").withColumnRenamed("doc", "annotation_id")
    out = out.withColumns(
        {
            "actual_label": label_name("target"),
            "model_prediction": threshold_label("probability", spec.threshold),
            "workaround_probability": F.col("probability") if spec.improved_text else F.round("probability", 4),
            "behavioral_cues": F.col("cues"),
        }
    )
    out = out.withColumn("model_correct", F.col("actual_label") == F.col("model_prediction"))
    return out.withColumn("error_type", error_type("actual_label", "model_prediction"))


@dataclass
class Detector:
    spec: DetectorSpec
    features: FeatureModel
    classifier: LogisticRegressionModel


def fit_detector(labelled: DataFrame, spec: DetectorSpec = IMPROVED) -> Detector:
    """M7: final fit on every labelled row."""
    docs = staged(prepare_documents(labelled, spec))
    _unique_ids(docs)
    neg, pos, _ = class_guard(docs, "target", spec.min_rows)
    fm = fit_text_features(docs, "doc", pos + neg, spec)
    if _capped(spec):
        coded, vocab = coded_for(fm, docs, "doc", ["target"])
        codes = staged(coded)
        drop_staged(docs)
        coded = codes.coalesce(_train_partitions(docs, pos + neg))
        model = fit_classifier(FT.vectors_of(coded, vocab, 0), pos + neg, pos, neg, spec, dealt=True)
        drop_staged(codes)
        return Detector(spec, fm, model)
    x = featurize(count_terms(docs, spec), docs, fm).join(docs.select("doc", "target"), "doc")
    x = x.persist(StorageLevel.MEMORY_AND_DISK)
    model = fit_classifier(x, pos + neg, pos, neg, spec)
    x.unpersist()
    return Detector(spec, fm, model)


def fit_text_features(docs: DataFrame, id_col: str, n_docs: int, spec: DetectorSpec) -> FeatureModel:
    """Vocabularies and idf of all ``docs``, from one pass over their ``text``."""
    blocks = _blocks(spec)
    if _capped(spec):
        stats = FT.capped_statistics(docs, id_col, "text", blocks, _caps(spec), _max_dfs(spec), {None: n_docs})
    else:
        stats = FT.document_statistics(docs, id_col, "text", blocks)
    if len(blocks) > 1 and not _capped(spec):  # each block reads them
        stats = cut_lineage(stats)
    return fit_features(*[FT.block_of(stats, b) for b in blocks], *([None] if len(blocks) == 1 else []), n_docs, spec)


def coded_for(fm: FeatureModel, docs: DataFrame, id_col: str = "doc", extra: list[str] = (), together: bool = False) -> tuple[DataFrame, FT.UnionVocabulary]:
    """``(doc, *extra, terms)`` of ``docs`` in a capped feature model's codes, and the codes."""
    vocab = FT.union_vocabulary([fm.blocks])
    return FT.coded_texts(docs, id_col, "text", vocab, extra, together), vocab


def target_counts(docs: DataFrame) -> DataFrame:
    """``(doc, times, ones, zeros)``: one row per id of ``docs`` (doc, target), with the number of its rows."""
    return docs.filter("doc is not null").groupBy("doc").agg(
        F.count(F.lit(1)).alias("times"), F.count_if(F.col("target") == 1).alias("ones"), F.count_if(F.col("target") == 0).alias("zeros")
    )


def counted_entries(fm: FeatureModel, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc, times, ones, zeros, entries)`` of the ids of ``docs``, with the features of ``texts`` (doc, text).

    The counts join the texts, which are smaller than their features, and few texts of other ids move for it.
    """
    rows = cut_lineage(target_counts(docs))
    wanted = FT.with_marks(texts, cut_lineage(FT.id_marks(rows)), "_wanted").filter("_wanted").drop("_wanted")
    # An id has one row on the left, so its texts lie together.
    coded, vocab = coded_for(fm, rows.join(wanted, "doc", "left"), "doc", ["times", "ones", "zeros"], together=True)
    return FT.vectors_of(coded, vocab, 0, nested=True)


def objective_slopes(entries: DataFrame, docs: DataFrame, coefficients: DataFrame, intercept: float, C: float) -> DataFrame:
    """``(idx, slope)``: the gradient of the fitted objective at given coefficients; -1 is the intercept.

    The objective is the class-balanced mean log loss plus half the L2 penalty
    ``1 / (C * n)`` on the coefficients (not the intercept). ``docs`` holds each
    training row's ``(doc, target)``, ``coefficients`` every feature's
    ``(idx, weight)`` (a table bounded by the vocabulary caps). A row without a
    known term scores the intercept.
    """
    pos, neg = _class_counts(docs)
    n = pos + neg
    if "entries" not in entries.columns:
        entries = entries.groupBy("doc").agg(F.collect_list(F.struct("idx", "value")).alias("entries"))
    # One row per document; ids that ``docs`` repeats count as often as they stand there.
    rows = entries if "times" in entries.columns else target_counts(docs).join(entries, "doc", "left")
    known = FT.weighted_sums(rows, coefficients)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("times") * F.col("dot") + F.lit(float(intercept)))))
    r = F.col("ones") * F.lit(n / (2.0 * max(pos, 1))) * (p - 1) / n + F.col("zeros") * F.lit(n / (2.0 * max(neg, 1))) * p / n
    sums = _entry_sums(known.select("entries", "times", r.alias("r")))
    slopes = coefficients.join(sums.filter("idx >= 0"), "idx", "left").select(
        "idx", (F.coalesce("g", F.lit(0.0)) + F.col("weight") / F.lit(C * n)).alias("slope")
    )
    return slopes.unionByName(sums.filter("idx = -1").select("idx", F.col("g").alias("slope")))


def _entry_sums(rows: DataFrame) -> DataFrame:
    """``(idx, g)``: the sum of times * value * r by index over ``(entries, times, r)``, and that of r at -1; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1)
        for batch in batches:
            lists, times, r = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            pairs = lists.flatten()
            idx, value = (pairs.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            own = np.bincount(idx + 1, value * (times * r)[row], len(sums)) if len(idx) else np.zeros(1)
            own[0] += r.sum()
            sums = np.append(sums, np.zeros(max(0, len(own) - len(sums))))
            sums[: len(own)] += own
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array((at - 1).astype(np.int32)), pa.array(sums[at])], ["idx", "g"])

    none = rows.sparkSession.createDataFrame([(-1, 0.0)], "idx int, g double")  # no rows: a slope of none
    return cut_lineage(rows.mapInArrow(run, "idx int, g double").unionByName(none).groupBy("idx").agg(F.sum("g").alias("g")))


def fit_certificate(det: Detector, labelled: DataFrame) -> DataFrame:
    """One row: ``rows`` trained on, ``zero_slope`` and ``fitted_slope``, the largest absolute
    slope of the objective at zero coefficients and at the fit, and ``converged``.

    The objective's minimum has slope zero, so a fit has converged if it left at
    most CERTIFIED_SHARE of the slope that no model has.
    """
    spark = labelled.sparkSession
    docs = cut_lineage(prepare_documents(labelled, det.spec))
    if _capped(det.spec):
        coded, vocab = coded_for(det.features, docs)
        entries = FT.entries_of(cut_lineage(coded), vocab)
    else:
        entries = FT.normalised_entries(feature_entries(count_terms(docs, det.spec), det.features), 1 if det.features.char is None else 2)
    fitted = det.classifier.coefficients.toArray().tolist()  # bounded by the vocabulary caps

    def largest(weights: list[float], intercept: float, name: str) -> DataFrame:
        table = spark.createDataFrame(list(enumerate(weights)), "idx int, weight double")
        return objective_slopes(entries, docs, table, intercept, det.spec.C).agg(F.max(F.abs("slope")).alias(name))

    both = docs.agg(F.count(F.lit(1)).alias("rows")).join(largest([0.0] * len(fitted), 0.0, "zero_slope")).join(
        largest(fitted, det.classifier.intercept, "fitted_slope")
    )  # one row each
    return both.withColumn("converged", F.col("fitted_slope") <= F.lit(CERTIFIED_SHARE) * F.col("zero_slope"))


def top_terms(det: Detector, n: int = 15) -> DataFrame:
    """M8: the ``n`` most positive and most negative coefficients with their terms.

    The coefficient vector is model state (size bounded by the vocabulary caps).
    """
    if det.features.word.max_features is None:
        raise ValueError("the word vocabulary has no cap, so its coefficients have no bound")
    spark = SparkSession.getActiveSession()
    coef = det.classifier.coefficients.toArray().tolist()
    coefs = spark.createDataFrame(list(enumerate(coef)), "idx int, weight double")
    vocab = det.features.word.table.select("term", "idx")
    if det.features.char is not None:
        vocab = vocab.unionByName(
            det.features.char.table.select("term", (F.col("idx") + F.lit(det.features.word.size)).alias("idx"))
        )
    terms = coefs.join(vocab, "idx")
    pos = terms.orderBy(F.desc("weight"), "term").limit(n).withColumn("direction", F.lit("workaround_associated_terms"))
    neg = terms.orderBy(F.asc("weight"), "term").limit(n).withColumn("direction", F.lit("non_workaround_associated_terms"))
    return pos.unionByName(neg).select("direction", "term", F.round("weight", 4).alias("weight"))


def _scored_text(spec: DetectorSpec, threads: DataFrame, id_col: str) -> DataFrame:
    text = model_text("title", "thread_text") if spec.improved_text else clean_text("thread_text")
    docs = threads.select(F.col(id_col).alias("doc"), text.alias("text"))
    if spec.augment is not None:
        docs = docs.withColumn("_c", spec.augment.cue_array("text")).select("doc", augment_text("text", "_c").alias("text"))
    return docs


def _known_terms(det: Detector) -> list[dict[str, tuple[float, float]]]:
    """Per block, (idf, coefficient) by term: model state, bounded by the vocabulary caps."""
    coef, offset, out = det.classifier.coefficients.toArray(), 0, []
    for vocab in (det.features.word, det.features.char):
        if vocab is None:
            continue
        if vocab.max_features is None:
            raise ValueError("a vocabulary without a cap has no bound; score with joined_scores")
        out.append({r["term"]: (r["idf"], float(coef[offset + r["idx"]])) for r in vocab.table.select("term", "idx", "idf").collect()})
        offset += vocab.size
    return out


def row_probability(det: Detector, text: Column) -> Column:
    """M12 core: a thread text's probability, row by row, without a shuffle.

    The text is lower-cased, folded and split in the JVM; an Arrow-batched
    function counts its terms against the model's and adds up the weights.
    """
    known, intercept = _known_terms(det), float(det.classifier.intercept)
    n_min, n_max = FT.CHAR_NGRAM_RANGE

    def margin(counts: Counter, terms: dict[str, tuple[float, float]]) -> float:
        total = norm = 0.0
        for term, tf in counts.items():
            if term in terms:
                idf, weight = terms[term]
                w = (1.0 + math.log(tf)) * idf
                total, norm = total + w * weight, norm + w * w
        return total / math.sqrt(norm) if norm else 0.0

    def char_counts(words) -> Counter:
        out: Counter = Counter()
        for word, n in Counter(words).items():
            padded = f" {word} "
            for size in range(n_min, n_max + 1):
                if size == n_min or len(padded) >= size:
                    for i in range(max(len(padded) - size + 1, 1)):
                        out[padded[i : i + size]] += n
        return out

    @F.pandas_udf("double")
    def probability(ngrams: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(ngrams, words):
            z = intercept + margin(Counter(a), known[0])
            if len(known) > 1:
                z += margin(char_counts(b), known[1])
            out.append(1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0)
        return pd.Series(out, dtype="float64")

    return probability(FT.word_ngrams(FT.word_tokens(text), FT.WORD_NGRAM_RANGE[1]), FT.char_words(text))


def score(det: Detector, threads: DataFrame, id_col: str = "annotation_id") -> DataFrame:
    """Probabilities and labels for new threads; a stateless projection, so it
    also runs on a stream. Rows that repeat an id are scored each for itself."""
    docs = _scored_text(det.spec, threads, id_col)
    return _with_label(docs.withColumn("probability", row_probability(det, F.col("text"))), det.spec, id_col)


def joined_scores(det: Detector, threads: DataFrame, id_col: str = "annotation_id") -> DataFrame:
    """The same by joins with the vocabularies, for detectors without a vocabulary cap; ids are unique."""
    docs = _scored_text(det.spec, threads, id_col)
    counts = CountTables(
        FT.word_term_counts(docs, "doc", "text", FT.WORD_NGRAM_RANGE[1]),
        FT.char_wb_term_counts(docs, "doc", "text", *FT.CHAR_NGRAM_RANGE) if det.features.char else None,
    )
    return _with_label(probability_of_positive(det.classifier.transform(featurize(counts, docs, det.features))), det.spec, id_col)


def _with_label(scored: DataFrame, spec: DetectorSpec, id_col: str) -> DataFrame:
    return scored.select(
        F.col("doc").alias(id_col),
        "probability",
        threshold_label("probability", spec.threshold).alias("prediction"),
    )


def save_detector(det: Detector, path: str) -> None:
    """Classifier, vocabularies and metadata (threshold, cue dictionary)."""
    det.classifier.write().overwrite().save(f"{path}/classifier")
    det.features.word.table.write.mode("overwrite").parquet(f"{path}/word_vocabulary")
    if det.features.char is not None:
        det.features.char.table.write.mode("overwrite").parquet(f"{path}/char_vocabulary")
    spec = det.spec
    meta = {
        "model_name": spec.name,
        "threshold": spec.threshold,
        "spec": {k: getattr(spec, k) for k in ["word_max_features", "word_max_df", "char_max_features", "C", "max_iter", "improved_text"]},
        "word": {"size": det.features.word.size, "n_docs": det.features.word.n_docs},
        "char": {"size": det.features.char.size, "n_docs": det.features.char.n_docs} if det.features.char else None,
        "behavioral_patterns": [{"name": n, "pattern": p} for n, p in (spec.augment.entries if spec.augment else [])],
    }
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_detector(spark: SparkSession, path: str) -> Detector:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    s = meta["spec"]
    aug = CueDictionary.of("saved", [(c["name"], c["pattern"]) for c in meta["behavioral_patterns"]]) if meta["behavioral_patterns"] else None
    spec = DetectorSpec(meta["model_name"], s["word_max_features"], s["word_max_df"], s["char_max_features"], s["C"], s["max_iter"], meta["threshold"], aug, s["improved_text"])
    word = FT.Vocabulary(spark.read.parquet(f"{path}/word_vocabulary"), meta["word"]["size"], meta["word"]["n_docs"], s["word_max_features"])
    char = None
    if meta["char"]:
        char = FT.Vocabulary(spark.read.parquet(f"{path}/char_vocabulary"), meta["char"]["size"], meta["char"]["n_docs"], s["char_max_features"])
    return Detector(spec, FeatureModel(word, char), LogisticRegressionModel.load(f"{path}/classifier"))
