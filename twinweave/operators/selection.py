"""Keep-one strategies: one member of each group stays, all others are selected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Orders by strategy; the first member stays. Member order settles ties.
STRATEGIES = {
    "KeepHighestResolution": (F.desc, "pixels", F.desc, "file_size"),
    "KeepLowestResolution": (F.asc, "pixels", F.asc, "file_size"),
    "KeepNewest": (F.desc, "created_at", F.desc, "modified_at"),
    "KeepOldest": (F.asc, "created_at", F.desc, "modified_at"),
    "KeepLargestFileSize": (F.desc, "file_size", F.desc, "pixels"),
    "KeepSmallestFileSize": (F.asc, "file_size", F.desc, "pixels"),
}


def apply_strategy(members: DataFrame, strategy: str) -> DataFrame:
    """``is_selected`` by a strategy; KeepAll selects nothing, KeepNone everything."""
    if strategy in ("KeepAll", "KeepNone"):
        return members.withColumn("is_selected", F.lit(strategy == "KeepNone"))
    first, a, second, b = STRATEGIES[strategy]
    order = Window.partitionBy("group_id").orderBy(first(a), second(b), "member_pos")
    return members.withColumn("is_selected", F.row_number().over(order) > 1)


def apply_to_groups(members: DataFrame, strategy: str, groups: DataFrame) -> DataFrame:
    """The strategy on some groups only; members of others stay as they are."""
    chosen = members.join(groups.select("group_id").distinct(), "group_id", "left_semi")
    others = members.join(groups.select("group_id").distinct(), "group_id", "left_anti")
    return apply_strategy(chosen, strategy).unionByName(others)


def clear_selection(members: DataFrame) -> DataFrame:
    return members.withColumn("is_selected", F.lit(False))


def toggle_groups(members: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Groups that are all selected become unselected, others all selected."""
    flipped = ~F.bool_and("is_selected").over(Window.partitionBy("group_id"))
    if groups is None:
        return members.withColumn("is_selected", flipped)
    hit = groups.select("group_id", F.lit(True).alias("__hit")).distinct()
    return members.withColumn("__flip", flipped).join(hit, "group_id", "left").withColumn("is_selected", F.when(F.col("__hit"), F.col("__flip")).otherwise(F.col("is_selected"))).drop("__flip", "__hit")
