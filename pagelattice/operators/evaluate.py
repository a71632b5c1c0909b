"""Statistics that compare distance functions and judge them on labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.session import cut, unused

# Limits of the same and of the different.
SAME, DIFFERENT = 0.33, 0.66


def agreement(rows: DataFrame, name: str, old: str, new: str, limit: float = 0.25) -> DataFrame:
    """corr, mean of the covariance matrix, and 1 - share of differences above the limit, by function."""
    x, y = F.col(old), F.col(new)
    return rows.groupBy(name).agg(
        F.round(F.corr(x, y), 6).alias("corr"),
        F.round((F.var_samp(x) + F.var_samp(y) + F.lit(2.0) * F.covar_samp(x, y)) / 4, 6).alias("cov"),
        F.round(F.lit(1.0) - F.avg(F.when(F.abs(x - y) > limit, 1.0).otherwise(0.0)), 6).alias("score"),
    )


def discrepancies(rows: DataFrame, name: str, a: str, b: str, limit: float = 0.035) -> DataFrame:
    return rows.groupBy(name).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col(a) - F.col(b)) > limit).alias("n_discrepant"))


def adjusted(distance: Column, same_cluster: Column) -> Column:
    """A learnt distance, drawn in for pairs of one cluster and pushed out for others."""
    return F.least(F.lit(1.0), distance * F.when(same_cluster, 0.85).otherwise(1.08))


def verdict(answer: Column, similarity: Column) -> Column:
    right = ((answer == "s") & (similarity < SAME)) | ((answer == "d") & (similarity > DIFFERENT))
    wrong = ((answer == "s") & (similarity > DIFFERENT)) | ((answer == "d") & (similarity < SAME))
    return F.when(right, "correct").when(wrong, "incorrect").otherwise("unsure")


def confusion(answers: DataFrame) -> DataFrame:
    return answers.groupBy("ans", verdict(F.col("ans"), F.col("sim")).alias("verdict")).agg(F.count("*").alias("n"))


def triage(colour: Column, structure: Column) -> Column:
    """similar, different or ambiguous; a structure of 0 counts as absent."""
    s = F.when(structure != 0, structure)
    return F.when((colour < 0.25) | F.coalesce(s < 0.3, F.lit(False)), "similar").when((colour > 0.33) | F.coalesce(s > 0.33, F.lit(False)), "different").otherwise("ambiguous")


def histogram(rows: DataFrame, value: str, bins: int = 30) -> DataFrame:
    return rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(value) * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def pair_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, colour, structure, triage and place: pairs of each kind by colour, those without a structure first.

    There are three kinds, so no task ranks one as a whole: the rows are sorted
    over ranges and written once, and a row's place is its place in its range
    and what the ranges before it hold of its kind.
    """
    small = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["triage", "colour", F.col("structure").isNotNull(), *keys]
    at, kind, first, n = (unused(c, [*rows.columns, "triage", "place"]) for c in ("at", "range", "first", "n"))
    told = rows.withColumn("triage", triage(F.col("colour"), F.col("structure")))
    # the higher bits of this number are the range, the lower ones the place in it
    ranged = cut(told.repartitionByRange(small, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    ranged = ranged.withColumn(kind, F.shiftright(at, 33))
    held = ranged.groupBy("triage", kind).agg(F.count("*").alias(n), F.min(at).alias(first))
    before = F.coalesce(F.sum(n).over(Window.partitionBy("triage").orderBy(kind).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select("triage", kind, (before - F.col(first) + 1).alias(first))
    return ranged.join(F.broadcast(starts), ["triage", kind]).withColumn("place", F.col(at) + F.col(first)).select(*told.columns, "place")


def renamed(rows: DataFrame, names: dict[str, str], name: str = "name") -> DataFrame:
    """Function names by a table of names, which is small as it's given; a name that isn't there stays."""
    table = rows.sparkSession.createDataFrame(list(names.items()), "old_name string, new_name string")
    return rows.join(table, F.col(name) == F.col("old_name"), "left").withColumn(name, F.coalesce("new_name", name)).drop("old_name", "new_name")
