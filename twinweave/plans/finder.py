"""The facade: scan, features, groups, selection and actions as one lazily built chain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.config import Settings
from twinweave.operators import actions, clustering, groups, imaging, media, selection
from twinweave.operators.checkpoints import discard, materialise
from twinweave.operators.feature_store import FeatureStore
from twinweave.operators.features import Embedder
from twinweave.operators.progress import Meter
from twinweave.operators.similarity import check_lengths, similar_pairs


@dataclass
class DuplicateFinder:
    """Groups of similar items and what to do with them. Steps run under a tag, so that they can be cancelled."""

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    constrained: bool = True
    progress: Callable[[str, float], None] | None = None
    tag: str = "twinweave"
    sort_by: str = "Similarity"

    def cancel(self) -> None:
        """End what runs under the tag, from any thread."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def reconfigure(self, settings: Settings) -> bool:
        """Take other settings from now on; whether they void features at once (another model or input of it)."""
        before, self.settings = self.settings, settings
        return before.affects_features(settings)

    def use_bundled_model(self) -> bool:
        """Take what the bundled model wants; whether that voids features."""
        return self.reconfigure(self.settings.bundled_defaults())

    def refresh(self, store: FeatureStore, files: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Items with current features: what the table does not hold for these files under the settings is derived first, nothing else is."""
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            store.update(files, derive, self.settings)
            return store.featured(files, self.settings)
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def features(self, images: DataFrame, embedder: Embedder) -> DataFrame:
        """Preprocess and embed images in one narrow chain."""
        return embedder.embed(imaging.preprocess(images, self.settings))

    def analyse(self, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(header, groups, members) at the settings' threshold; an empty header carries the threshold."""
        self.spark.sparkContext.addJobTag(self.tag)
        meter = Meter(self.spark, self.tag, self.progress)
        try:
            with meter.band("similarity", 0.0, 0.7):
                held = clustering.held_features(media.featured_items(items))
                check_lengths(held)
                drawn = clustering.gathered(held, self.settings.threshold, self.constrained)
                pairs = materialise(similar_pairs(drawn.rows, self.settings.threshold, self.constrained, rows=drawn.count), "pairs")
            with meter.band("clustering", 0.7, 0.95):
                found, members = clustering.analyse(held, self.settings.threshold, self.constrained, pairs, drawn)
            meter.show("statistics", 0.95)
            discard(pairs, held, drawn.rows)
            head = groups.header(found, self.settings.threshold)
            meter.show("done", 1.0)
            return head, found, members
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def view(self, found: DataFrame, filter_by: str = "All", sort_by: str | None = None) -> DataFrame:
        """Groups to show, filtered, then sorted. A new result is seen whole again, but the sort option stays until another is given."""
        self.sort_by = sort_by or self.sort_by
        return groups.shown(found, filter_by, self.sort_by)

    def select(self, members: DataFrame, items: DataFrame, strategy: str) -> DataFrame:
        """Members of duplicate groups with ``is_selected`` by a strategy."""
        return selection.apply_strategy(members.join(items.drop("average_similarity"), "item_idx"), strategy)

    def plan(self, selected: DataFrame, view: DataFrame, destination: str, action: str = "Move", grouped: bool = False) -> DataFrame:
        """What would be moved or copied, in order of groups and members."""
        rows = selected.where("is_selected").join(view.select("group_id", "group_rank", "name"), "group_id")
        rows = rows.withColumn("seq", F.col("group_rank").cast("long") * F.lit(1 << 31) + F.col("member_pos"))
        return actions.grouped_plan(rows, destination, action) if grouped else actions.flat_plan(rows, destination, action)
