"""Clusters kept up to date while items are added: only what new items touch is clustered again.

A new item can only change the component that it joins, so a state keeps, as written tables, the items with their
features, the rows that stand for copies, each item's component, and the members of clusters. An addition makes the
pairs of new rows with each other and with the old ones (never those among old ones), merges the stored labels along
them, and clusters the items of components that hold a new item. All other clusters are taken over as they are. The result is that of a full run
over all items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.operators import clustering, graph
from twinweave.operators.checkpoints import discard, materialise, materialise_with
from twinweave.operators.clustering import Gathered, clusters, gathered, held_features
from twinweave.operators.similarity import check_lengths, new_pairs, similar_pairs


@dataclass
class ClusterState:
    """``items`` (item_idx, source_id, copy_key, features), ``rows`` (those that stand for copies too), ``labels`` (item_idx, component_id), ``members`` (slot, member_pos, item_idx, average_similarity)."""

    threshold: float
    constrained: bool
    items: DataFrame
    rows: DataFrame
    labels: DataFrame
    members: DataFrame
    #: Items that the last step clustered, of all.
    clustered: int = 0

    def groups(self) -> tuple[DataFrame, DataFrame]:
        """(groups, members) with group ids and names, as of now."""
        found = materialise(clustering.group_table(self.members), "groups")
        return found.drop("slot"), self.members.join(found.select("slot", "group_id"), "slot").select("group_id", "member_pos", "item_idx", "average_similarity")


def _labels(drawn: Gathered, edges: DataFrame) -> DataFrame:
    """(item_idx, component_id) of the gathered items by the edges among rows; items that stand alone are their own component."""
    found = graph.components(edges)
    rows = drawn.rows.select("item_idx").join(found, "item_idx", "left").select("item_idx", F.coalesce("component_id", "item_idx").alias("component_id"))
    if drawn.copies is None:
        return rows
    copies = drawn.copies.where("item_idx <> stands_for_it").select("item_idx", "stands_for_it")
    return rows.unionByName(copies.join(rows.withColumnRenamed("item_idx", "stands_for_it"), "stands_for_it").select("item_idx", "component_id"))


def begin(items: DataFrame, threshold: float, constrained: bool = True) -> ClusterState:
    """The state of a full run."""
    held = held_features(items)
    drawn = gathered(held, threshold, constrained)
    pairs = materialise(similar_pairs(drawn.rows, threshold, constrained, rows=drawn.count), "pairs")
    labels = materialise(_labels(drawn, pairs), "labels")
    members, n = materialise_with(clusters(held, threshold, constrained, pairs, drawn), "members", F.count(F.lit(1)))
    discard(pairs)
    rows = materialise(drawn.rows.select("item_idx", "source_id", "features"), "rows")
    return ClusterState(threshold, constrained, held, rows, labels, members, n)


def extend(state: ClusterState, new_items: DataFrame) -> ClusterState:
    """The state with more items; rows whose id is there already are passed over, so a repeated addition changes nothing. The former state's tables are not removed."""
    fresh = held_features(new_items.join(state.items.select("item_idx"), "item_idx", "left_anti"))
    both = materialise(state.items.unionByName(fresh), "features")
    check_lengths(both)
    drawn = gathered(fresh, state.threshold, state.constrained)
    edges = materialise(new_pairs(drawn.rows, state.rows, state.threshold, state.constrained, drawn.count).select("i", "j"), "pairs")

    # edges between labels: old items stand for their component, new ones for themselves
    fresh_labels = drawn.rows.select("item_idx", F.col("item_idx").alias("component_id"))
    known = state.labels.unionByName(fresh_labels)
    end = lambda k: known.select(F.col("item_idx").alias(k), F.col("component_id").alias(f"c{k}"))
    merged = materialise(graph.components(edges.join(end("i"), "i").join(end("j"), "j").select(F.col("ci").alias("i"), F.col("cj").alias("j"))), "merged")
    old = state.labels.join(merged.select(F.col("item_idx").alias("component_id"), F.col("component_id").alias("above")), "component_id", "left")
    old = old.select("item_idx", F.coalesce("above", "component_id").alias("component_id"))
    new = _labels(drawn, edges.limit(0)).join(merged.select(F.col("item_idx").alias("component_id"), F.col("component_id").alias("above")), "component_id", "left")
    new = new.select("item_idx", F.coalesce("above", "component_id").alias("component_id"))
    labels = materialise(old.unionByName(new), "labels")

    touched = new.select("component_id").distinct()
    inside = labels.join(touched, "component_id", "left_semi").select("item_idx")
    again, n = materialise_with(both.join(inside, "item_idx", "left_semi"), "touched", F.count(F.lit(1)))
    made = clusters(again, state.threshold, state.constrained)
    kept = state.members.join(inside, "item_idx", "left_anti")
    members = materialise(kept.unionByName(made), "members")
    rows = materialise(state.rows.unionByName(drawn.rows.select("item_idx", "source_id", "features")), "rows")
    discard(edges, merged, again, fresh)
    return ClusterState(state.threshold, state.constrained, both, rows, labels, members, n)
