"""Agreement of two annotators, corrected for chance.

An extension: the surveyed product names it as a next step. Both tables are
joined by id once; everything after is the label cross-tab, whose size is
bounded by the number of labels squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.text import lower_clean

OVERALL = "(overall)"


def _label(c: str) -> Column:
    v = lower_clean(c)
    return F.when(v != "", v)


def label_pairs(first: DataFrame, second: DataFrame, id_col: str = "annotation_id", label_col: str = "primary_label") -> DataFrame:
    """(id, first_label, second_label) of every id of either table; cleaned, blank is null.

    Rows that repeat an id in a table count once, by their greatest label; rows
    without an id are left out.
    """
    one = lambda df, out: df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(_label(label_col)).alias(out))
    return one(first, "first_label").join(one(second, "second_label"), id_col, "full")


def cross_tab(pairs: DataFrame) -> DataFrame:
    """(first_label, second_label, n), null labels included."""
    return pairs.groupBy("first_label", "second_label").agg(F.count(F.lit(1)).alias("n"))


def agreement(pairs: DataFrame) -> DataFrame:
    """One row overall and one per label: n_both, n_first, n_second, agreed, one_sided, observed, expected, kappa.

    ``n_both`` counts the ids with both labels; ids with a label of one
    annotator alone are ``one_sided`` and enter nothing else. A label's row
    compares its use with its non-use. ``kappa`` is null where chance alone
    agrees always.
    """
    table = cross_tab(pairs)
    both = table.filter("first_label is not null and second_label is not null")
    sides = table.select(
        F.explode(F.array(F.struct(F.col("first_label").alias("label"), F.lit(1).alias("side")), F.struct(F.col("second_label").alias("label"), F.lit(2).alias("side")))).alias("x"),
        "n", F.col("first_label").isNotNull().alias("a"), F.col("second_label").isNotNull().alias("b"),
        (F.col("first_label") == F.col("second_label")).alias("same"),
    ).select("x.*", "n", "a", "b", "same").filter("label is not null")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    shared = F.col("a") & F.col("b")
    labels = sides.groupBy("label").agg(
        count(shared & (F.col("side") == 1)).alias("n_first"), count(shared & (F.col("side") == 2)).alias("n_second"),
        count(shared & F.col("same") & (F.col("side") == 1)).alias("hits"), count(~shared).alias("one_sided"),
    )
    total = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_both"))  # one row
    labels = labels.join(F.broadcast(total))
    n = F.col("n_both")
    agreed = n - F.col("n_first") - F.col("n_second") + 2 * F.col("hits")
    chance = (F.col("n_first") * F.col("n_second") + (n - F.col("n_first")) * (n - F.col("n_second"))) / (n * n)
    per_label = labels.select("label", "n_both", "n_first", "n_second", agreed.alias("agreed"), "one_sided", F.when(n > 0, chance).alias("expected"))
    overall = labels.groupBy("n_both").agg(
        F.sum("n_first").alias("n_first"), F.sum("n_second").alias("n_second"), F.sum("hits").alias("agreed"), F.sum("one_sided").alias("one_sided"),
        F.sum(F.col("n_first") * F.col("n_second")).alias("chance"),
    ).select(F.lit(OVERALL).alias("label"), "n_both", "n_first", "n_second", "agreed", "one_sided", F.when(n > 0, F.col("chance") / (n * n)).alias("expected"))
    rows = per_label.unionByName(overall).withColumn("observed", F.when(n > 0, F.col("agreed") / n))
    return rows.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))
