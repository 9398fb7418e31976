"""Views of groups: headers, filters, orders, selections and upkeep after removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinweave.functions.display import summary_text
from twinweave.functions.paths import renamed
from twinweave.operators.ranking import numbered

EXACT = 0.9999


def header(groups: DataFrame, threshold: float) -> DataFrame:
    """One row about a result; for no groups, zeros with the threshold."""
    dup = F.col("item_count") > 1
    return groups.agg(
        F.lit(threshold).alias("threshold"),
        F.count(F.lit(1)).alias("total_groups"),
        F.count_if(dup).alias("duplicate_groups"),
        F.count_if(~dup).alias("single_groups"),
        F.coalesce(F.sum(F.when(dup, F.col("item_count"))), F.lit(0)).alias("duplicate_items"),
        F.coalesce(F.sum("item_count"), F.lit(0)).alias("total_items"),
    )


def summary(head: DataFrame) -> DataFrame:
    return head.select(summary_text("total_items", "duplicate_groups", "duplicate_items", "single_groups").alias("summary"))


def base_order(groups: DataFrame) -> DataFrame:
    """Duplicate groups with ``group_rank``: by average similarity from the highest, then by id."""
    return numbered(groups.where("item_count > 1"), [F.col("average_similarity").desc(), F.col("group_id")], "group_rank")


def shown(groups: DataFrame, filter_by: str = "All", sort_by: str = "Similarity") -> DataFrame:
    """Duplicate groups of a fresh view: filtered and sorted, equal keys in base order, with ``group_rank`` from one sort."""
    base = [F.col("average_similarity").desc(), F.col("group_id")]
    return numbered(filtered(groups.where("item_count > 1"), filter_by), [_sort_key(sort_by), *base], "group_rank")


def _sort_key(option: str) -> Column:
    return {"Similarity": F.col("average_similarity").desc(), "ImageCount": F.col("item_count").desc(), "Name": F.collate(F.col("name"), "UNICODE").asc()}[option]


def filtered(ranked: DataFrame, option: str = "All") -> DataFrame:
    """All, Exact (copies) or Similar (the others) of the ranked groups."""
    exact = F.col("average_similarity") >= EXACT
    tests = {"All": F.lit(True), "Exact": exact, "Similar": ~exact}
    return ranked.where(tests[option])


def sorted_groups(ranked: DataFrame, option: str = "Similarity") -> DataFrame:
    """New ranks by Similarity, ImageCount or Name; equal keys keep their former order."""
    return numbered(ranked.withColumnRenamed("group_rank", "__former"), [_sort_key(option), F.col("__former")], "group_rank").drop("__former")


def thumbnails(members: DataFrame, paths: DataFrame, count: int = 4) -> DataFrame:
    """(group_id, paths): the paths of the first members; four rows of a group are gathered, not all."""
    first = members.where(F.col("member_pos") < count).join(paths, "item_idx")
    return first.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("member_pos", "file_path"))), lambda x: x["file_path"]).alias("paths"))


def group_states(members: DataFrame) -> DataFrame:
    """Selected members and the three-valued state of each group: false for none, true for all, else null."""
    state = F.when(~F.bool_or("is_selected"), F.lit(False)).when(F.bool_and("is_selected"), F.lit(True))
    return members.groupBy("group_id").agg(F.count_if("is_selected").alias("selected"), F.bool_or("is_selected").alias("any_selected"), state.alias("state"))


def selection_totals(members: DataFrame) -> DataFrame:
    per = group_states(members)
    return per.agg(F.coalesce(F.sum("selected"), F.lit(0)).alias("selected"), F.count_if(F.col("selected") > 0).alias("groups"))


def selected_paths(members: DataFrame, ranked: DataFrame, paths: DataFrame) -> DataFrame:
    """(group_rank, member_pos, file_path) of what is selected, in order of groups and members."""
    return members.where("is_selected").join(ranked.select("group_id", "group_rank"), "group_id").join(paths, "item_idx").select("group_rank", "member_pos", "file_path").orderBy("group_rank", "member_pos")


def selected_by_name(members: DataFrame, ranked: DataFrame, paths: DataFrame, last_wins: bool = True) -> DataFrame:
    """(name, group_id, member_pos, file_path) of what is selected; of groups with one name the last only, unless told otherwise."""
    chosen = members.where("is_selected").join(ranked.select("group_id", "group_rank", "name"), "group_id").join(paths, "item_idx")
    if last_wins:
        chosen = chosen.withColumn("__last", F.max("group_rank").over(Window.partitionBy("name"))).where("group_rank = __last")
    return chosen.select("name", "group_id", "member_pos", "file_path")


def remove_members(members: DataFrame, removed: DataFrame, path: str = "file_path") -> DataFrame:
    """Members whose path (case counts) is not removed, of groups that keep more than one; averages stay as they were."""
    left = members.join(removed.select(path).distinct(), path, "left_anti")
    return left.withColumn("item_count", F.count(F.lit(1)).over(Window.partitionBy("group_id"))).where("item_count > 1")


def live_counts(members: DataFrame, total_analysed: int) -> DataFrame:
    """Counts after removals; the number analysed is carried."""
    per = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.count_if(F.col("n") <= 1).alias("single_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_items"), F.lit(total_analysed).cast("long").alias("total_items"))


def rename_groups(groups: DataFrame, wanted: str = "wanted") -> DataFrame:
    return groups.withColumn("name", renamed("name", wanted))
