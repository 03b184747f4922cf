"""Roll-ups over path prefixes and shares of a parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def roll_up(records: DataFrame) -> DataFrame:
    """``path, n, size`` of every directory: number and bytes of all files below."""
    return records.select("size", F.explode(C.ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def children_sorted(tree: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """The tree in order of parent and, within it, of a column."""
    key = F.col(by).desc() if descending else F.col(by).asc()
    return tree.withColumn("parent", C.dirname(F.col("path"))).orderBy("parent", key, "path")


def of_group(rows: DataFrame, checksum: str) -> DataFrame:
    return rows.filter(F.col("checksum") == checksum)


def ratios(parents: DataFrame, children: DataFrame, key: str, value: str, least: float = 1 / 512) -> DataFrame:
    """Children with ``ratio``, their value's share of their parent's; too thin slices and only children's chains go."""
    counts = children.groupBy(key).agg(F.count("*").alias("__n"))
    joined = children.join(parents.select(key, F.col(value).alias("__whole")), key).join(counts, key)
    ratio = F.when(F.col("__whole") != 0, F.col(value) / F.col("__whole"))
    return joined.withColumn("ratio", ratio).filter((F.col("ratio") >= least) & (F.col("__n") > 1)).drop("__whole", "__n")


def toggled(rows: DataFrame, chosen: Column) -> DataFrame:
    """``is_original`` turned over where ``chosen``."""
    return rows.withColumn("is_original", F.when(chosen, ~F.col("is_original")).otherwise(F.col("is_original")))


def allowed(rows: DataFrame, allow: DataFrame) -> DataFrame:
    """Rows on the allow-list (path, is_original), with the list's verdict."""
    return rows.drop("is_original").join(allow.select("path", "is_original"), "path")
