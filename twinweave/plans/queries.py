"""Registered queries: every operator applied to whole tables, with columns that compare across engines.

No image files are among the tables, so media attributes are arithmetic of ``embeddings``; the same
arithmetic stands in ``oracles``. Half of the planted copies are doubled vectors (cosine 1 up to rounding).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.config import IMAGENET, Settings
from twinweave.functions import display, paths, vectors
from twinweave.operators import actions, clustering, graph, groups, imaging, incremental, media, pair_index, selection, selection_log, similarity
from twinweave.operators.checkpoints import scratch
from twinweave.operators.feature_store import FeatureStore
from twinweave.operators.group_state import GroupState
from twinweave.operators.manifest import Manifest
from twinweave.plans import imaging_queries

THRESHOLD = 0.40
EXTENSIONS = (".jpg", ".PNG", ".jpeg", ".txt", ".gif", ".MP4", ".bmp", ".onnx", ".webp", ".tif")
_EXT_SQL = "element_at(array(" + ",".join(f"'{e}'" for e in EXTENSIONS) + "), cast(vec_id % 10 + 1 as int))"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media_view(spark: SparkSession, sf_dir: str, copies: bool = False, by_label: bool = True) -> DataFrame:
    """Derived media rows; with copies, every fifth vector is there again, doubled."""
    base = read(spark, sf_dir, "embeddings")
    if copies:
        more = base.where("vec_id % 5 = 0").select((F.col("vec_id") + 100000).alias("vec_id"), F.transform("embedding", lambda x: x + x).alias("embedding"), (F.col("label") + 100).alias("label"))
        base = base.select("vec_id", "embedding", "label").unionByName(more)
    return base.selectExpr(
        "vec_id as item_idx",
        ("label" if by_label else "vec_id") + " as source_id",
        "label",
        f"concat('/lib/s', label, '/img_', vec_id, {_EXT_SQL}) as file_path",
        "(vec_id * 7919) % 100003 * 131 + 512 as file_size",
        "cast(320 + (vec_id * 37) % 40 * 40 as int) as width",
        "cast(240 + (vec_id * 53) % 40 * 30 as int) as height",
        "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast((vec_id * 613) % 997 as int), 0) as created_at",
        "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast((vec_id * 401) % 491 as int), 0) as modified_at",
        "embedding as features",
    )


def member_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of 97 groups in item order, with selection marks by arithmetic."""
    rows = media_view(spark, sf_dir).withColumn("group_id", F.col("item_idx") % 97)
    rows = rows.withColumn("member_pos", F.floor(F.col("item_idx") / 97).cast("int"))
    return rows.withColumn("pixels", display.pixel_count("width", "height")).withColumn("is_selected", (F.col("item_idx") * 7 % 11 < 4) | (F.col("group_id") % 9 == 0) & (F.col("group_id") % 2 == 0)).withColumn("is_selected", F.col("is_selected") & (F.col("group_id") % 13 != 5))


def view_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group rows by arithmetic: sizes from 1, averages with ties and exact ones, names with repeats."""
    sizes = member_view(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("group_id", F.concat(F.lit("Group "), F.col("group_id") % 40).alias("name"), F.when(F.col("group_id") % 6 == 0, F.lit(1)).otherwise(F.col("n")).cast("long").alias("item_count"), F.when(F.col("group_id") % 7 == 0, F.lit(1.0)).otherwise(0.5 + (F.col("group_id") * 31 % 50) / 128).alias("average_similarity"))


def cosine_pairs(spark, sf_dir):
    return similarity.similar_pairs(media_view(spark, sf_dir, by_label=False), THRESHOLD, constrained=False).select("i", "j", F.round("sim", 12).alias("sim"))


def cosine_pairs_source_constrained(spark, sf_dir):
    return similarity.similar_pairs(media_view(spark, sf_dir, copies=True), THRESHOLD, constrained=True).select("i", "j", F.round("sim", 12).alias("sim"))


def cosine_pairs_indexed(spark, sf_dir):
    """The same by the metric index, with blocks small enough that it decides about many pairs of them."""
    items = media_view(spark, sf_dir, by_label=False).select("item_idx", F.col("source_id").cast("string").alias("source_id"), "features")
    return pair_index.indexed_pairs(items, THRESHOLD, False, items.count(), block_rows=128).select("i", "j", F.round("sim", 12).alias("sim"))


def cosine_to_anchor(spark, sf_dir):
    """The expression itself: every vector against the vectors of the ten lowest ids."""
    items = media_view(spark, sf_dir)
    anchors = items.where("item_idx < 10").groupBy().agg(F.collect_list(F.struct(F.col("item_idx").alias("anchor"), F.col("features").alias("other"))).alias("anchors"))
    paired = items.join(F.broadcast(anchors)).withColumn("a", F.explode("anchors"))  # ten vectors in one row
    return paired.select("item_idx", "a.anchor", F.round(vectors.cosine("features", "a.other"), 12).alias("sim"))


def similar_components(spark, sf_dir):
    return graph.components(similarity.similar_pairs(media_view(spark, sf_dir, copies=True, by_label=False), THRESHOLD, constrained=False))


def _clusters(spark, sf_dir, constrained):
    members = clustering.clusters(media_view(spark, sf_dir, copies=True, by_label=constrained), THRESHOLD, constrained)
    return members.select("slot", "member_pos", "item_idx", F.round("average_similarity", 6).alias("average_similarity"))


def hac_groups(spark, sf_dir):
    return _clusters(spark, sf_dir, False)


def hac_groups_source_constrained(spark, sf_dir):
    return _clusters(spark, sf_dir, True)


def hac_groups_incremental(spark, sf_dir):
    """Clusters after an addition to a state: those of a full run."""
    rows = media_view(spark, sf_dir, copies=True)
    state = incremental.begin(rows.where("item_idx % 4 <> 1"), THRESHOLD)
    members = incremental.extend(state, rows.where("item_idx % 4 = 1")).members
    return members.select("slot", "member_pos", "item_idx", F.round("average_similarity", 6).alias("average_similarity"))


def feature_table_updates(spark, sf_dir):
    """Which update computed each item's features: all at first, then what changed or came, nothing for another threshold."""
    store, rows = FeatureStore(spark, scratch(spark, "store")), media_view(spark, sf_dir)
    derive = lambda fresh: fresh.withColumn("features", F.slice("features", 1, 8))
    store.update(rows.where("item_idx % 5 <> 2"), derive, Settings())
    changed = rows.withColumn("file_size", F.col("file_size") + F.when(F.col("item_idx") % 7 == 3, 1).otherwise(0))
    store.update(changed, derive, Settings())
    store.update(changed, derive, Settings(threshold=0.9))
    other = store.stale(changed, Settings(layout="NHWC")).select(F.col("item_idx").alias("k"))
    held = store.featured(changed, Settings())
    return held.join(other, F.col("item_idx") == F.col("k"), "left").select("item_idx", F.size("features").alias("dims"), F.col("batch").alias("computed_by"), F.col("k").isNotNull().alias("stale_in_another_layout"))


def _scans(spark, sf_dir):
    """A manifest of two overlapping roots, of which the first was scanned again after some files went, came and changed."""
    rows = media_view(spark, sf_dir).select("item_idx", "file_path", "file_size", "modified_at")
    manifest = Manifest(spark, scratch(spark, "manifest"))
    manifest.rescan("/lib", rows.where("item_idx % 10 <> 4"))
    manifest.rescan("/other", rows.where("item_idx % 2 = 0").withColumn("file_path", F.upper("file_path")))
    again = rows.where("item_idx % 10 <> 6").withColumn("file_size", F.col("file_size") + F.when(F.col("item_idx") % 9 == 5, 1).otherwise(0))
    return manifest, manifest.rescan("/LIB", again)


def rescan_changes(spark, sf_dir):
    manifest, version = _scans(spark, sf_dir)
    return manifest.changes(version)


def rescan_media(spark, sf_dir):
    """Files after the re-scan: those of both roots, written as the root says that held them first."""
    return _scans(spark, sf_dir)[0].media().select("file_path", "file_size", "root", "scan_seq")


def _analysed(spark, sf_dir):
    return clustering.analyse(media_view(spark, sf_dir, copies=True), THRESHOLD)


def group_table(spark, sf_dir):
    return _analysed(spark, sf_dir)[0].select("group_id", "name", "item_count", F.round("average_similarity", 6).alias("average_similarity"), "is_duplicate")


def result_header(spark, sf_dir):
    return groups.header(_analysed(spark, sf_dir)[0], THRESHOLD)


def result_summary(spark, sf_dir):
    return groups.summary(result_header(spark, sf_dir))


def groups_base_order(spark, sf_dir):
    return groups.base_order(view_of_groups(spark, sf_dir))


def _filtered(option):
    return lambda spark, sf_dir: groups.filtered(groups_base_order(spark, sf_dir), option)


def _sorted(option):
    return lambda spark, sf_dir: groups.shown(view_of_groups(spark, sf_dir), sort_by=option)


def thumbnails_first4(spark, sf_dir):
    rows = member_view(spark, sf_dir)
    return groups.thumbnails(rows.select("group_id", "member_pos", "item_idx"), rows.select("item_idx", "file_path")).select("group_id", F.array_join("paths", "|").alias("paths"))


def _selected(strategy):
    return lambda spark, sf_dir: selection.apply_strategy(member_view(spark, sf_dir), strategy).select("group_id", "item_idx", "is_selected")


def select_visible_groups(spark, sf_dir):
    rows = member_view(spark, sf_dir)
    return selection.apply_to_groups(rows, "KeepNewest", rows.where("group_id % 3 = 0")).select("group_id", "item_idx", "is_selected")


def select_clear(spark, sf_dir):
    return selection.clear_selection(member_view(spark, sf_dir)).select("group_id", "item_idx", "is_selected")


def group_toggle(spark, sf_dir):
    return selection.toggle_groups(member_view(spark, sf_dir)).select("group_id", "item_idx", "is_selected")


#: Events on groups, in order: which groups were shown (group_id modulo, remainder), what was done, by which strategy.
SELECTION_EVENTS = (
    (3, 0, "apply", "KeepNewest"), (2, 0, "toggle", None), (5, 0, "clear", None), (7, 1, "apply", "KeepLowestResolution"), (4, 0, "toggle", None), (8, 0, "toggle", None), (11, 3, "apply", "KeepNone"), (22, 3, "toggle", None),
)


def selection_log_fold(spark, sf_dir):
    """Selections after a log of events, folded at once."""
    rows, log = member_view(spark, sf_dir), None
    for seq, (n, k, kind, strategy) in enumerate(SELECTION_EVENTS):
        one = selection_log.event(seq, rows.where(F.col("group_id") % n == k), kind, strategy)
        log = one if log is None else log.unionByName(one)
    return selection_log.folded(rows, log).select("group_id", "item_idx", "is_selected")


def group_state_removals(spark, sf_dir):
    """Members after three removals that were merged to a written state, the second one twice."""
    rows, state = member_view(spark, sf_dir), GroupState(spark, scratch(spark, "groups"))
    state.begin(rows.select("group_id", "member_pos", "item_idx", "file_path"))
    for k in (1, 4, 4, 7):
        state.remove(rows.where(F.col("item_idx") % 9 == k).select("file_path"))
    return state.members().select("group_id", "item_idx", "item_count")


def group_tristate(spark, sf_dir):
    return groups.group_states(member_view(spark, sf_dir))


def selection_summary(spark, sf_dir):
    return groups.selection_totals(member_view(spark, sf_dir)).select(F.col("selected").alias("selected_items"), F.col("groups").alias("selected_groups"))


def selected_paths(spark, sf_dir):
    rows = member_view(spark, sf_dir)
    return groups.selected_paths(rows.drop("file_path"), groups_base_order(spark, sf_dir), rows.select("item_idx", "file_path"))


def selected_paths_by_group(spark, sf_dir):
    rows = member_view(spark, sf_dir)
    return groups.selected_by_name(rows.drop("file_path"), groups_base_order(spark, sf_dir), rows.select("item_idx", "file_path"))


def _removed(spark, sf_dir):
    return media_view(spark, sf_dir).where("item_idx % 3 = 1").select("file_path")


def remove_paths_dissolve(spark, sf_dir):
    return groups.remove_members(member_view(spark, sf_dir), _removed(spark, sf_dir)).select("group_id", "item_idx", "item_count")


def live_counts(spark, sf_dir):
    left = member_view(spark, sf_dir).join(_removed(spark, sf_dir), "file_path", "left_anti")
    return groups.live_counts(left, 500)


def rename_groups(spark, sf_dir):
    wanted = F.when(F.col("group_id") % 5 == 0, "  ").when(F.col("group_id") % 5 == 1, F.concat(F.lit(" New "), F.col("group_id"))).when(F.col("group_id") % 5 == 2, "a/b:c").when(F.col("group_id") % 5 == 3, "...").otherwise(F.col("name"))
    return groups.rename_groups(view_of_groups(spark, sf_dir).withColumn("wanted", wanted)).select("group_id", "name")


def classify_extension(spark, sf_dir):
    p = "file_path"
    return media_view(spark, sf_dir).select("item_idx", paths.is_image(p).alias("is_image"), paths.is_video(p).alias("is_video"), paths.is_model(p).alias("is_model"), paths.is_media(p).alias("is_media"), paths.media_type(p).alias("media_type"))


def _listing(spark, sf_dir):
    """Each path found under two roots and in two cases."""
    rows = media_view(spark, sf_dir).select("file_path", "item_idx")
    first = rows.select("file_path", F.col("item_idx").alias("scan_seq"), F.lit("/lib").alias("root"))
    second = rows.where("item_idx % 2 = 0").select(F.upper("file_path").alias("file_path"), (F.col("item_idx") - 250).alias("scan_seq"), F.lit("/Other").alias("root"))
    return first.unionByName(second)


def path_dedup_first_wins(spark, sf_dir):
    return media.dedup_paths(_listing(spark, sf_dir)).select("file_path", "scan_seq")


def provenance_remove_root(spark, sf_dir):
    listed = _listing(spark, sf_dir)
    bridge = media.remove_root(media.provenance(listed), "/LIB")
    return media.with_provenance(media.dedup_paths(listed), bridge).select("file_path", "scan_seq")


def add_files_unlisted(spark, sf_dir):
    rows = media_view(spark, sf_dir)
    listed = rows.where("item_idx % 4 = 0").select(F.upper("file_path").alias("file_path"))
    return media.add_files(listed, rows.select("item_idx", "file_path")).select("item_idx")


def media_items(spark, sf_dir):
    return media.media_to_items(media_view(spark, sf_dir)).select("item_idx", "frame_index", "processed", F.col("features").isNull().alias("no_features"))


def _with_gaps(spark, sf_dir):
    none = F.when(F.col("item_idx") % 6 == 0, F.lit(None)).when(F.col("item_idx") % 6 == 1, F.array().cast("array<float>")).otherwise(F.col("features"))
    path = F.when(F.col("item_idx") % 8 == 0, F.lit(None)).when(F.col("item_idx") % 8 == 1, F.lit("")).otherwise(F.col("file_path"))
    return media_view(spark, sf_dir).withColumn("features", none).withColumn("processed_path", path)


def featured_items(spark, sf_dir):
    return media.featured_items(_with_gaps(spark, sf_dir)).select("item_idx", F.size("features").alias("dims"))


def processed_items(spark, sf_dir):
    return media.processed_items(_with_gaps(spark, sf_dir)).select("item_idx", "processed_path")


def item_counters(spark, sf_dir):
    return media.counters(_with_gaps(spark, sf_dir))


def remove_items_by_path(spark, sf_dir):
    return media.remove_by_path(media_view(spark, sf_dir), _removed(spark, sf_dir)).select("item_idx")


def sources_with_items(spark, sf_dir):
    rows = media_view(spark, sf_dir)
    items = rows.where("item_idx % 50 = 3").withColumn("source_id", F.col("label"))
    sources = rows.select(F.col("label").alias("source_id")).distinct()
    return media.sources_with_items(sources, items)


def video_frames(spark, sf_dir):
    videos = media_view(spark, sf_dir).where(paths.is_video("file_path")).select("item_idx", (F.col("item_idx") % 4).alias("n"), F.lit(25.0).alias("frame_rate"))
    return media.video_frames(videos, "n").select("item_idx", "frame_index", "frame_seconds")


def path_parts(spark, sf_dir):
    u = "url"
    return read(spark, sf_dir, "pages").select("page_id", paths.file_name(u).alias("file_name"), paths.stem(u).alias("stem"), paths.extension(u).alias("extension"), paths.shown_extension(u).alias("shown"), paths.directory(u).alias("directory"))


def _names(spark, sf_dir):
    """Names of parts, made unfit in several ways."""
    k = F.col("p_partkey") % 8
    name = F.col("p_name")
    odd = F.when(k == 1, F.concat(F.lit(" "), name, F.lit(".. "))).when(k == 2, F.regexp_replace(name, " ", "/")).when(k == 3, F.element_at(F.array(*map(F.lit, ("con", "COM10", "lpt1", "nul.txt"))), (F.floor(F.col("p_partkey") / 8) % 4 + 1).cast("int"))).when(k == 4, F.concat(name, F.lit("\t"), name)).when(k == 5, F.repeat(name, 20)).when(k == 6, F.lit("...")).when(k == 7, F.concat(name, F.lit('?"<x>|'))).otherwise(name)
    return read(spark, sf_dir, "part").select("p_partkey", odd.alias("raw"))


def sanitize_name(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", paths.sanitised_name("raw").alias("name"))


def validate_name(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", paths.is_valid_name("raw").alias("is_valid"))


def format_file_size(spark, sf_dir):
    n = F.col("n_chars") * F.element_at(F.array(F.lit(1), F.lit(1024), F.lit(1048576), F.lit(37)), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", display.file_size_text(n).alias("size_text"))


def resolution_orientation(spark, sf_dir):
    w, h = "width", "height"
    return media_view(spark, sf_dir).select("item_idx", display.resolution_text(w, h).alias("resolution"), display.pixel_count(w, h).alias("pixels"), F.round(display.megapixels(w, h), 6).alias("megapixels"), F.round(display.aspect_ratio(w, h), 6).alias("aspect"), display.orientation(w, h).alias("orientation"))


def camera_texts(spark, sf_dir):
    i = F.col("item_idx")
    seconds = F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, (i % 7 + 1).cast("double")).otherwise(1 / (i % 997 + 1.5))
    return media_view(spark, sf_dir).select("item_idx", display.exposure_text(seconds).alias("exposure"), display.iso_text(F.when(i % 3 > 0, i % 64 * 100)).alias("iso"), display.focal_length_text(F.when(i % 4 > 0, i % 200)).alias("focal"), display.aperture_text(F.when(i % 6 > 0, i % 16 + 0.5)).alias("aperture"), display.gps_text(F.when(i % 9 > 0, i / 8), F.lit(-7.25)).alias("gps"), display.white_balance_text(i % 2).alias("white_balance"))


def flash_mode(spark, sf_dir):
    return media_view(spark, sf_dir).select("item_idx", display.flash_text(F.col("item_idx") % 100).alias("flash"), display.flash_fired(F.col("item_idx") % 100).alias("fired"))


def format_bitrate(spark, sf_dir):
    bits = F.col("item_idx") * 12500 * (F.col("item_idx") % 3)
    return media_view(spark, sf_dir).select("item_idx", display.bitrate_text(bits).alias("bitrate"))


def duration_text(spark, sf_dir):
    seconds = F.col("item_idx") * 331
    return media_view(spark, sf_dir).select("item_idx", display.duration_text(seconds).alias("duration"), display.total_frames(seconds, F.lit(23.976)).alias("frames"))


def audio_channels(spark, sf_dir):
    return media_view(spark, sf_dir).select("item_idx", display.channels_text(F.col("item_idx") % 15).alias("channels"))


def progress_texts(spark, sf_dir):
    i = F.col("item_idx")
    return media_view(spark, sf_dir).select("item_idx", F.round(display.progress_percent(i, F.lit(512)), 6).alias("percent"), display.percent_text(F.floor(i % 101) / 128).alias("similarity"))


def tolerance_label(spark, sf_dir):
    return media_view(spark, sf_dir).select("item_idx", display.tolerance_label(F.col("item_idx") % 256).alias("label_text"))


def settings_clamp(spark, sf_dir):
    """What ``Settings`` makes of wanted values."""

    def settle(batches):
        for rows in batches:
            made = [Settings(threshold=t, batch_size=b) for t, b in zip(rows["t"], rows["b"], strict=True)]
            yield pd.DataFrame({"item_idx": rows["item_idx"], "threshold": [m.threshold for m in made], "batch_size": [m.batch_size for m in made]})

    i = F.col("item_idx")
    return media_view(spark, sf_dir).select("item_idx", (i / 256).alias("t"), (i % 130).alias("b")).mapInPandas(settle, "item_idx long, threshold double, batch_size long")


def model_name(spark, sf_dir):
    path = F.when(F.col("item_idx") % 3 == 0, "").otherwise(F.col("file_path"))
    return media_view(spark, sf_dir).select("item_idx", display.model_name(F.col("item_idx") % 5 == 0, path).alias("model"))


def pixel_formats(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("Gray8", "Gray16", "Rgba8", "Bgra8", "Rgba16", "Nv12"))), (F.col("item_idx") % 6 + 1).cast("int"))
    outs = F.element_at(F.array(*map(F.lit, ("PNG", "JPEG", "BMP", "TIFF", "WebP", "RAW"))), (F.col("item_idx") % 6 + 1).cast("int"))
    return media_view(spark, sf_dir).select("item_idx", display.bits_per_pixel(kinds).alias("bits"), actions.output_extension(outs).alias("extension"))


def sampling_choice(spark, sf_dir):
    rows = media_view(spark, sf_dir)
    return rows.select("item_idx", *[imaging.sampling_expr("width", "height", 640, m, "Bilinear", "Lanczos").alias(m.lower()) for m in ("Stretch", "Crop")])


def pixel_normalise(spark, sf_dir):
    c = F.col("item_idx") % 256
    return media_view(spark, sf_dir).select("item_idx", *[F.round(vectors.scale_channel(c, m, s).cast("double"), 4).alias(n) for n, m, s in zip(("r", "g", "b"), IMAGENET.mean, IMAGENET.std, strict=True)])


def colour_pack(spark, sf_dir):
    i = F.col("item_idx")
    packed = vectors.pack_argb(i % 256, i * 3 % 256, i * 5 % 256, i * 7 % 256)
    rows = media_view(spark, sf_dir).select("item_idx", packed.alias("packed"))
    return rows.select("item_idx", "packed", vectors.unpack_argb("packed")[1].alias("red"), vectors.colours_match((i % 256, i * 3 % 256, F.lit(9)), (F.lit(40), F.lit(50), F.lit(60)), 80).alias("matches"))


def _plan(spark, sf_dir):
    rows = member_view(spark, sf_dir).where("is_selected").withColumn("file_path", F.concat(F.lit("/lib/img_"), F.col("item_idx") % 12, F.lit(".jpg"))).withColumn("seq", F.col("item_idx"))
    return rows.withColumn("name", F.concat(F.lit("Group/"), F.col("group_id") % 4))


def move_plan(spark, sf_dir):
    return actions.flat_plan(_plan(spark, sf_dir), "/out", "Move")


def move_plan_grouped(spark, sf_dir):
    return actions.grouped_plan(_plan(spark, sf_dir), "/out/", "Copy")


def unique_targets(spark, sf_dir):
    there = spark.createDataFrame([("/out", "img_1.jpg"), ("/out", "img_1 (2).jpg")], "dest_dir string, name string")
    return actions.unique_targets(move_plan(spark, sf_dir), there).select("seq", "target")


def _results(spark, sf_dir):
    return member_view(spark, sf_dir).select("file_path", (F.col("item_idx") % 7 != 0).alias("ok"))


def op_result_fold(spark, sf_dir):
    return actions.fold(_results(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        cosine_pairs, cosine_pairs_source_constrained, cosine_pairs_indexed, cosine_to_anchor, similar_components, hac_groups, hac_groups_source_constrained, hac_groups_incremental,
        group_table, result_header, result_summary, feature_table_updates, rescan_changes, rescan_media,
        groups_base_order, thumbnails_first4, select_visible_groups, select_clear, group_toggle, group_tristate, selection_summary, selected_paths, selected_paths_by_group,
        selection_log_fold, group_state_removals, remove_paths_dissolve, live_counts, rename_groups, classify_extension, path_dedup_first_wins, provenance_remove_root, add_files_unlisted, media_items, featured_items, processed_items,
        item_counters, remove_items_by_path, sources_with_items, video_frames, path_parts, sanitize_name, validate_name, format_file_size, resolution_orientation, camera_texts, flash_mode,
        format_bitrate, duration_text, audio_channels, progress_texts, tolerance_label, settings_clamp, model_name, pixel_formats, sampling_choice, pixel_normalise, colour_pack,
        move_plan, move_plan_grouped, unique_targets, op_result_fold,
    )
}
QUERIES |= {f"groups_filter_{o.lower()}": _filtered(o) for o in ("All", "Exact", "Similar")}
QUERIES |= {f"groups_sort_{k}": _sorted(o) for k, o in (("similarity", "Similarity"), ("count", "ImageCount"), ("name", "Name"))}
QUERIES |= {
    f"select_keep_{k}": _selected(s)
    for k, s in (("highest_res", "KeepHighestResolution"), ("lowest_res", "KeepLowestResolution"), ("newest", "KeepNewest"), ("oldest", "KeepOldest"), ("largest", "KeepLargestFileSize"), ("smallest", "KeepSmallestFileSize"), ("all", "KeepAll"), ("none", "KeepNone"))
}
QUERIES |= imaging_queries.QUERIES
