"""Label quality and label/audit upserts.

The interactive prompts of a single annotator are re-aimed as batch upserts:
decisions arrive as a table ``(annotation_id, decided_at, ...)``, the latest
decision per id wins (``max_by`` — a partial aggregate, skew-safe), and is
left-joined onto the working table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.scoring import (
    POSITIVE,
    VALID_CONFIDENCE,
    VALID_LABELS,
    WORKAROUND_FIELDS,
    audit_outcome,
    audit_status,
    has_workaround_from_label,
)
from threadlens.functions.text import clean_text, is_blank, lower_clean
from threadlens.sources.schemas import AUDIT_COLUMNS, add_missing, require_columns

# --- fixed values: validation messages -------------------------------------------
MSG_DUPLICATE = "Duplicate annotation_id"
MSG_INVALID_LABEL = "Invalid primary label: %s"
MSG_CONFIDENCE = "Confidence must be high, medium, or low. Found: %s"
MSG_WORKAROUND_YES = "Workaround label must have has_workaround=yes"
MSG_MISSING_FIELD = "Workaround record is missing %s"
MSG_NON_WORKAROUND_NO = "Non-workaround label must have has_workaround=no"
# ---------------------------------------------------------------------------------

VALIDATION_REQUIRED = ["annotation_id", "primary_label", "has_workaround", "confidence", *WORKAROUND_FIELDS]


def duplicate_rows(df: DataFrame, key: str = "annotation_id") -> DataFrame:
    """Every member of a duplicate-key group (``keep=False``).

    Counts per key are a partial aggregate; the join back lets AQE split a hot
    key instead of widening a window over it.
    """
    dup_keys = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(key)
    return df.join(dup_keys, df[key].eqNullSafe(dup_keys[key]), "left_semi")


def validation_findings(df: DataFrame) -> DataFrame:
    """V1-V6 + U2: ``(annotation_id, problem)`` for every rule broken.

    Per-row rules build one array of messages in a single projection, then
    ``explode``; duplicate ids are unioned in. Blank labels are skipped and an
    invalid label stops further checks on that row.
    """
    require_columns(df, VALIDATION_REQUIRED, "Dataset")
    aid = clean_text("annotation_id")
    dups = duplicate_rows(df).select(aid.alias("annotation_id"), F.lit(MSG_DUPLICATE).alias("problem"))

    label = lower_clean("primary_label")
    hw = lower_clean("has_workaround")
    conf = lower_clean("confidence")
    valid = label.isin(VALID_LABELS)
    is_w = label == POSITIVE
    msgs = [
        F.when(~valid, F.format_string(MSG_INVALID_LABEL, label)),
        F.when(valid & ~conf.isin(VALID_CONFIDENCE), F.format_string(MSG_CONFIDENCE, F.when(conf == "", F.lit("blank")).otherwise(conf))),
        F.when(valid & is_w & (hw != "yes"), F.lit(MSG_WORKAROUND_YES)),
        *[F.when(valid & is_w & is_blank(f), F.lit(MSG_MISSING_FIELD % f)) for f in WORKAROUND_FIELDS],
        F.when(valid & ~is_w & (hw != "no"), F.lit(MSG_NON_WORKAROUND_NO)),
    ]
    per_row = (
        df.filter(label != "")
        .select(aid.alias("annotation_id"), F.explode(F.array_compact(F.array(*msgs))).alias("problem"))
    )
    return dups.unionByName(per_row)


def validate_or_fail(df: DataFrame, errors_path: str | None = None) -> DataFrame:
    """V7: findings are written (when a path is given) and the job fails; else pass."""
    findings = validation_findings(df)
    if not findings.isEmpty():
        if errors_path:
            findings.write.mode("overwrite").option("header", True).csv(errors_path)
        raise ValueError(f"Validation found problems; see {errors_path or 'validation_findings(df)'}")
    return findings


def labelled_rows(df: DataFrame) -> DataFrame:
    """rows with a non-blank primary label."""
    return df.filter(~is_blank("primary_label"))


def value_counts(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """A5: counts per value, most frequent first (name breaks ties)."""
    out = name or column
    return (
        df.groupBy(F.col(column).alias(out))
        .agg(F.count("*").alias("records"))
        .orderBy(F.desc("records"), F.asc(out))
    )


def dataset_summary(df: DataFrame, target: str | None = None, score: str = "heuristic_score") -> DataFrame:
    """Total / labelled / unlabelled / class counts / likely signals in one pass."""
    from threadlens.functions.text import try_number

    lab = ~is_blank("primary_label")
    aggs = [
        F.count("*").alias("total_records"),
        F.count_if(lab).alias("labelled_records"),
        F.count_if(~lab).alias("unlabelled_records"),
        F.count_if(lab & (lower_clean("primary_label") == POSITIVE)).alias("workaround_records"),
        F.count_if(lab & (lower_clean("primary_label") != POSITIVE)).alias("non_workaround_records"),
    ]
    if score in df.columns:
        aggs.append(F.count_if(F.coalesce(try_number(score), F.lit(0.0)) > 0).alias("likely_signals"))
    return df.agg(*aggs)


def class_guard(df: DataFrame, target: str = "target", min_rows: int = 0, max_folds: int = 5) -> tuple[int, int, int]:
    """Row and class-balance guards; returns (negatives, positives, folds).

    Only the two class counts reach the driver.
    """
    counts = {r[0]: r[1] for r in df.groupBy(target).count().collect()}
    pos, neg = int(counts.get(1, 0)), int(counts.get(0, 0))
    if pos + neg < min_rows:
        raise ValueError(f"{pos + neg} labelled rows are too few to train on; the detector asks for {min_rows}")
    if min(pos, neg) < 2:
        raise ValueError(f"training takes two rows of each class or more; there are {pos} positive and {neg} negative")
    return neg, pos, min(max_folds, pos, neg)


def latest_decisions(decisions: DataFrame, key: str = "annotation_id", at: str = "decided_at") -> DataFrame:
    """Last write wins per id (ties broken by the full decision row)."""
    other = [c for c in decisions.columns if c not in (key, at)]
    latest = decisions.groupBy(key).agg(F.max(F.struct(at, *other)).alias("_d"))
    return latest.select(key, *[F.col(f"_d.{c}").alias(c) for c in [at, *other]])


def apply_label_decisions(
    annotations: DataFrame,
    decisions: DataFrame,
    only_unlabelled: bool = True,
) -> DataFrame:
    """Fill label, has_workaround, six fields (only for workaround), confidence, notes.

    Decisions with an unknown label are ignored (the prompt would not accept
    them); a confidence outside high/medium/low is stored blank (quit at the
    prompt). Already-labelled rows are left alone unless ``only_unlabelled`` is
    False.
    """
    require_columns(annotations, ["annotation_id", "primary_label", "has_workaround", *WORKAROUND_FIELDS, "confidence", "annotator_notes"], "Annotation file")
    d = decisions.withColumn("primary_label", lower_clean("primary_label")).filter(F.col("primary_label").isin(VALID_LABELS))
    d = latest_decisions(d)
    d = d.select(
        "annotation_id",
        F.lit(True).alias("_decided"),
        F.col("primary_label").alias("_label"),
        *[clean_text(f).alias(f"_{f}") for f in WORKAROUND_FIELDS],
        F.when(lower_clean("confidence").isin(VALID_CONFIDENCE), lower_clean("confidence")).otherwise(F.lit("")).alias("_confidence"),
        clean_text("annotator_notes").alias("_notes"),
    )
    joined = annotations.join(d, "annotation_id", "left")
    apply = F.coalesce(F.col("_decided"), F.lit(False))
    if only_unlabelled:
        apply = apply & is_blank("primary_label")
    is_w = F.col("_label") == POSITIVE
    updates = {
        "primary_label": F.when(apply, F.col("_label")).otherwise(F.col("primary_label")),
        "has_workaround": F.when(apply, has_workaround_from_label("_label")).otherwise(F.col("has_workaround")),
        "confidence": F.when(apply, F.col("_confidence")).otherwise(F.col("confidence")),
        "annotator_notes": F.when(apply, F.col("_notes")).otherwise(F.col("annotator_notes")),
    }
    for f in WORKAROUND_FIELDS:
        updates[f] = F.when(apply & is_w, F.col(f"_{f}")).otherwise(F.col(f))
    out = joined.withColumns(updates)
    return out.select(*annotations.columns)


def audit_table(fn_analysis: DataFrame) -> DataFrame:
    """Q4: add blank audit columns when absent."""
    require_columns(fn_analysis, ["annotation_id"], "Input file")
    return add_missing(fn_analysis, {c: "" for c in AUDIT_COLUMNS})


def apply_audit_decisions(audit: DataFrame, decisions: DataFrame) -> DataFrame:
    """Codes e/i/n set evidence status + outcome on unreviewed rows (resume-safe)."""
    audit = audit_table(audit)
    d = decisions.withColumn("code", lower_clean("code")).filter(audit_status("code").isNotNull())
    d = latest_decisions(d).select(
        "annotation_id",
        audit_status("code").alias("_status"),
        audit_outcome("code").alias("_outcome"),
        clean_text("audit_notes").alias("_notes"),
    )
    joined = audit.join(d, "annotation_id", "left")
    apply = F.col("_status").isNotNull() & is_blank("evidence_status")
    out = joined.withColumns(
        {
            "evidence_status": F.when(apply, F.col("_status")).otherwise(F.col("evidence_status")),
            "audit_outcome": F.when(apply, F.col("_outcome")).otherwise(F.col("audit_outcome")),
            "audit_notes": F.when(apply, F.col("_notes")).otherwise(F.col("audit_notes")),
        }
    )
    return out.select(*audit.columns)


def unreviewed_queue(audit: DataFrame, limit: int | None = None, order: str = "annotation_id") -> DataFrame:
    """Rows whose evidence status is still blank, the first ``limit`` in id order."""
    from threadlens.operators.sampling import top_k

    queue = audit_table(audit).filter(is_blank("evidence_status"))
    return queue if limit is None else top_k(queue, [order], limit)


def audit_summary(audit: DataFrame) -> DataFrame:
    """Totals plus counts per evidence status and per outcome, one pass.

    Rows: ``(section, value, records)`` with sections total / reviewed /
    remaining / warning / evidence_status / audit_outcome. Every row emits its
    (section, value) tags, a single grouped count adds them up, and a fixed
    four-row frame of zeros keeps the total / reviewed / remaining / warning
    rows present on an empty input.
    """
    spark = audit.sparkSession
    reviewed = ~is_blank("evidence_status")
    warn = "relabel annotation_error records before retraining"

    def tag(section: str, value) -> F.Column:
        return F.struct(F.lit(section).alias("section"), (value if isinstance(value, F.Column) else F.lit(value)).alias("value"))

    tags = F.array_compact(
        F.array(
            tag("total", ""),
            F.when(reviewed, tag("reviewed", "")),
            F.when(~reviewed, tag("remaining", "")),
            F.when(reviewed & (F.col("audit_outcome") == "annotation_error"), tag("warning", warn)),
            F.when(reviewed, tag("evidence_status", F.col("evidence_status"))),
            F.when(reviewed, tag("audit_outcome", F.col("audit_outcome"))),
        )
    )
    counted = audit.select(F.explode(tags).alias("t")).select("t.section", "t.value", F.lit(1).alias("n"))
    zeros = spark.createDataFrame(
        [("total", "", 0), ("reviewed", "", 0), ("remaining", "", 0), ("warning", warn, 0)], "section string, value string, n int"
    )
    return counted.unionByName(zeros).groupBy("section", "value").agg(F.sum("n").cast("long").alias("records"))
