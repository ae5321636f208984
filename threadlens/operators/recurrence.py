"""Recurrence of cues over calendar weeks, and how long discussions stay open.

An extension: the surveyed product names it as a next step. Rows are counted by
(cue, week) first, with map-side combine, so a cue in a third of all rows is a
few rows per week afterwards; runs and gaps are windows over these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weekly_cues(threads: DataFrame, cues_col: str = "cues", date_col: str = "created_on", state_col: str = "state") -> DataFrame:
    """(cue, week, n_threads, n_open): week is its Monday. Rows without a date or cues count nowhere."""
    rows = threads.select(F.explode(F.array_distinct(cues_col)).alias("cue"), F.date_trunc("week", F.col(date_col)).cast("date").alias("week"), F.col(state_col).alias("state"))
    return rows.filter("cue is not null and week is not null").groupBy("cue", "week").agg(
        F.count(F.lit(1)).alias("n_threads"), F.count_if(F.col("state") == "open").alias("n_open")
    )


def cue_runs(weekly: DataFrame) -> DataFrame:
    """(cue, run_start, run_end, weeks, n_threads, n_open, gap_weeks): maximal runs of
    consecutive weeks; ``gap_weeks`` are the weeks without the cue since its last run."""
    at = F.datediff("week", F.lit("1970-01-05")) / 7
    island = at.cast("long") - F.row_number().over(Window.partitionBy("cue").orderBy("week"))
    runs = weekly.withColumn("island", island).groupBy("cue", "island").agg(
        F.min("week").alias("run_start"), F.max("week").alias("run_end"), F.count(F.lit(1)).alias("weeks"),
        F.sum("n_threads").alias("n_threads"), F.sum("n_open").alias("n_open"),
    )
    before = F.lag("run_end").over(Window.partitionBy("cue").orderBy("run_start"))
    gap = (F.datediff("run_start", before) / 7).cast("long") - 1
    return runs.select("cue", "run_start", "run_end", "weeks", "n_threads", "n_open", gap.alias("gap_weeks"))


def recurrence(weekly: DataFrame) -> DataFrame:
    """One row per cue: spread, runs, gaps, and whether it goes on.

    ``open_spell_weeks`` counts the weeks from the first one with a discussion
    still open to the last week of the table (0 if none is open);
    ``persists`` says that the last run reaches the last week of the table.
    """
    runs = cue_runs(weekly)
    last = weekly.agg(F.max("week").alias("last_week"))  # one row
    spells = weekly.filter("n_open > 0").groupBy("cue").agg(F.min("week").alias("open_since"))
    by_cue = runs.groupBy("cue").agg(
        F.sum("n_threads").alias("n_threads"), F.sum("weeks").alias("n_weeks"), F.count(F.lit(1)).alias("n_runs"), F.max("weeks").alias("longest_run"),
        F.coalesce(F.max("gap_weeks"), F.lit(0)).alias("longest_gap"), F.min("run_start").alias("first_week"), F.max("run_end").alias("latest_week"), F.sum("n_open").alias("n_open"),
    )
    spell = F.coalesce((F.datediff("last_week", "open_since") / 7).cast("long") + 1, F.lit(0))
    return (
        by_cue.join(spells, "cue", "left").join(F.broadcast(last))
        .select(
            "cue", "n_threads", "n_weeks", "n_runs", "longest_run", "longest_gap", F.col("first_week").cast("string").alias("first_week"),
            F.col("latest_week").cast("string").alias("latest_week"), "n_open", spell.alias("open_spell_weeks"), (F.col("latest_week") == F.col("last_week")).alias("persists"),
        )
    )
