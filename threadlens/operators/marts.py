"""Dashboard data marts: base table, KPIs, facets and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.scoring import NEGATIVE, POSITIVE, outcome_type
from threadlens.functions.text import lower_clean, normalize_binary_label, strip_ws, try_number
from threadlens.sources.schemas import add_missing, apply_aliases

BINARY_LABELS = [POSITIVE, NEGATIVE]
SEARCH_COLUMNS = ["title", "user_goal", "obstacle", "workaround", "human_cost", "underlying_need"]
PREDICTION_MART_COLUMNS = [
    "annotation_id", "actual", "predicted", "probability", "heuristic_prediction",
    "heuristic_correct", "model_correct",
]
SKETCH_LG_K = 14
#: Three standard errors of merged sketches, relative to the exact count.
SKETCH_BOUND = 3 * 1.04 / 2 ** (SKETCH_LG_K / 2)


def dashboard_base(annotations: DataFrame, predictions: DataFrame) -> DataFrame:
    """Annotations left-joined with normalised predictions + outcome class."""
    p = apply_aliases(predictions, {"actual": ["actual_label"], "predicted": ["model_prediction"], "probability": ["workaround_probability"]})
    p = add_missing(p, {"actual": "", "predicted": ""})
    if "probability" not in p.columns:
        p = p.withColumn("probability", F.lit(None).cast("double"))
    p = p.withColumns(
        {
            "actual": normalize_binary_label("actual"),
            "predicted": normalize_binary_label("predicted"),
            "probability": try_number("probability"),
        }
    )
    p = p.select([c for c in PREDICTION_MART_COLUMNS if c in p.columns])
    a = annotations.drop(*[c for c in p.columns if c != "annotation_id" and c in annotations.columns])
    combined = a.join(p, "annotation_id", "left").withColumns(
        {
            "actual": normalize_binary_label(F.coalesce(F.col("actual"), F.lit(""))),
            "predicted": normalize_binary_label(F.coalesce(F.col("predicted"), F.lit(""))),
        }
    )
    combined = combined.withColumn("error_type", outcome_type("actual", "predicted"))
    return add_missing(combined, {"primary_label": "", "matched_patterns": "", "thread_text": ""})


def evaluated(base: DataFrame) -> DataFrame:
    """rows where both labels are valid binary labels."""
    return base.filter(F.col("actual").isin(BINARY_LABELS) & F.col("predicted").isin(BINARY_LABELS))


def kpis(predictions: DataFrame, record: DataFrame | None = None) -> DataFrame:
    """Evaluated, correct, accuracy, workaround recall, missed — 0 when no denominator.

    ``record`` is a one-row metrics table. Its ``evaluated_records``, if any,
    replaces the count of rows; if the predictions lack a label column, its
    ``correct_predictions`` and ``accuracy`` (else 0) stand for what can't be
    computed, and recall and misses are 0.
    """
    if {"actual", "predicted"} <= set(predictions.columns):
        out = _computed_kpis(predictions)
    else:
        out = predictions.agg(F.count("*").alias("evaluated")).withColumns(
            {
                "correct": F.lit(0).cast("long"), "accuracy": F.lit(0.0), "workaround_recall": F.lit(0.0),
                "missed_workarounds": F.lit(0).cast("long"), "false_positives": F.lit(0).cast("long"),
            }
        )
        fields = {"correct_predictions": "correct", "accuracy": "accuracy"}
        out = _from_record(out, record, fields)
    return _from_record(out, record, {"evaluated_records": "evaluated"})


def _from_record(out: DataFrame, record: DataFrame | None, fields: dict[str, str]) -> DataFrame:
    """Replace columns of a one-row table by those of a one-row record that has them."""
    have = {a: b for a, b in fields.items() if record is not None and a in record.columns}
    if not have:
        return out
    one = record.limit(1).select(*[F.col(a).alias(f"_r_{b}") for a, b in have.items()])
    joined = out.join(one, F.lit(True), "left")
    return joined.withColumns(
        {b: F.coalesce(F.col(f"_r_{b}").cast(out.schema[b].dataType), F.col(b)) for b in have.values()}
    ).select(*out.columns)


def _computed_kpis(predictions: DataFrame) -> DataFrame:
    a, p = F.col("actual"), F.col("predicted")
    agg = predictions.agg(
        F.count("*").alias("evaluated"),
        F.count_if(a == p).alias("correct"),
        F.count_if(a == POSITIVE).alias("_actual_w"),
        F.count_if((a == POSITIVE) & (p == POSITIVE)).alias("_detected"),
        F.count_if((a == POSITIVE) & (p == NEGATIVE)).alias("missed_workarounds"),
        F.count_if((a == NEGATIVE) & (p == POSITIVE)).alias("false_positives"),
    )
    return agg.select(
        "evaluated",
        "correct",
        F.when(F.col("evaluated") == 0, F.lit(0.0)).otherwise(F.col("correct") / F.col("evaluated")).alias("accuracy"),
        F.when(F.col("_actual_w") == 0, F.lit(0.0)).otherwise(F.col("_detected") / F.col("_actual_w")).alias("workaround_recall"),
        "missed_workarounds",
        "false_positives",
    )


def evaluation_summary(k: DataFrame) -> DataFrame:
    """The KPI row unpivoted to (metric, records)."""
    return k.select(
        F.inline(
            F.array(
                F.struct(F.lit("Evaluated records").alias("metric"), F.col("evaluated").cast("long").alias("records")),
                F.struct(F.lit("Correct predictions").alias("metric"), F.col("correct").cast("long").alias("records")),
                F.struct(F.lit("False negatives").alias("metric"), F.col("missed_workarounds").cast("long").alias("records")),
                F.struct(F.lit("False positives").alias("metric"), F.col("false_positives").cast("long").alias("records")),
            )
        )
    )


def opportunity_kpis(opportunities: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """Count, mean score, high-confidence count, distinct repositories.

    ``exact_distinct=False`` switches the repository count to a HyperLogLog
    sketch for very large marts.
    """
    distinct = F.countDistinct("repository") if exact_distinct else F.approx_count_distinct("repository")
    return opportunities.agg(
        F.count("*").alias("confirmed_signals"),
        F.coalesce(F.avg(try_number("opportunity_score")), F.lit(0.0)).alias("average_score"),
        F.count_if(F.lower(F.col("confidence").cast("string")) == "high").alias("high_confidence_signals"),
        distinct.alias("repositories"),
    )


def distinct_sketches(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(*keys, sketch)``: a mergeable HyperLogLog sketch of the distinct values of each group.

    A sketch has at most ``2 ** SKETCH_LG_K`` bytes and is combined before the
    shuffle. Null values count nothing.
    """
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.col(value), SKETCH_LG_K).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, distinct_estimate)`` of stored sketches with finer keys, within SKETCH_BOUND of
    the exact count (three standard errors); the rows behind them aren't read again."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*keys).agg(merged.alias("distinct_estimate"))


def facets(opportunities: DataFrame) -> DataFrame:
    """A10: distinct sorted facet values: title-cased confidence, split cost types."""
    conf = opportunities.select(F.lit("confidence").alias("facet"), F.initcap(strip_ws("confidence")).alias("value"))
    cost = opportunities.select(
        F.lit("cost_type").alias("facet"), F.explode(F.split(F.coalesce(F.col("cost_type"), F.lit("")), r"\|")).alias("value")
    ).select("facet", strip_ws("value").alias("value"))
    return conf.unionByName(cost).filter(F.col("value") != "").distinct().orderBy("facet", "value")


def filter_opportunities(
    opportunities: DataFrame,
    search_query: str = "",
    confidence_filter: str = "All",
    cost_filter: str = "All",
    regex: bool = True,
    search_columns: Sequence[str] = SEARCH_COLUMNS,
) -> DataFrame:
    """confidence equality, cost contains, free-text search (case-insensitive).

    ``regex=True`` keeps the pattern semantics of the dashboard; ``False``
    treats user input literally.
    """
    df = opportunities
    if confidence_filter != "All":
        df = df.filter(F.lower(F.col("confidence").cast("string")) == confidence_filter.lower())
    if cost_filter != "All":
        df = df.filter(_contains(F.coalesce(F.col("cost_type"), F.lit("")), cost_filter, regex))
    if search_query.strip():
        cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in search_columns if c in df.columns]
        df = df.filter(_contains(F.concat_ws(" ", *cols), search_query, regex))
    if "opportunity_score" in df.columns:
        df = df.orderBy(F.desc_nulls_last(try_number("opportunity_score")), "annotation_id")
    return df


def _contains(col, query: str, regex: bool):
    if regex:
        return col.rlike("(?iu)" + query)
    return F.lower(col).contains(query.lower())


def filter_records(
    base: DataFrame,
    actual: Sequence[str] = (),
    predicted: Sequence[str] = (),
    error_types: Sequence[str] = (),
    primary_label: str = "All",
) -> DataFrame:
    """Multi-select filters, an empty selection means no filter."""
    df = base
    if actual:
        df = df.filter(F.col("actual").isin(list(actual)))
    if predicted:
        df = df.filter(F.col("predicted").isin(list(predicted)))
    if error_types:
        df = df.filter(F.col("error_type").isin(list(error_types)))
    if primary_label != "All":
        df = df.filter(lower_clean("primary_label") == primary_label.lower())
    return df
