"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from twinweave.functions.display import CHANNEL_NAMES, FLASH_MODES
from twinweave.functions.paths import IMAGE_EXTENSIONS, RESERVED_NAMES, VIDEO_EXTENSIONS
from twinweave.plans import imaging_queries
from twinweave.plans.queries import EXTENSIONS, SELECTION_EVENTS

_list = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_array = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_MEDIA = f"""SELECT vec_id AS item_idx, {{source}} AS source_id, label, '/lib/s' || label || '/img_' || vec_id || list_extract({_array(EXTENSIONS)}, vec_id % 10 + 1) AS file_path,
  (vec_id * 7919) % 100003 * 131 + 512 AS file_size, CAST(320 + (vec_id * 37) % 40 * 40 AS INTEGER) AS width, CAST(240 + (vec_id * 53) % 40 * 30 AS INTEGER) AS height,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * ((vec_id * 613) % 997) AS created_at, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * ((vec_id * 401) % 491) AS modified_at,
  embedding AS features FROM {{base}}"""
_COPIES = "(SELECT vec_id, embedding, label FROM embeddings UNION ALL SELECT vec_id + 100000, list_transform(embedding, lambda x: x + x), label + 100 FROM embeddings WHERE vec_id % 5 = 0)"


def _media(copies: bool = False, by_label: bool = True) -> str:
    return "media AS (" + _MEDIA.format(source="label" if by_label else "vec_id", base=_COPIES if copies else "embeddings") + ")"


_MEMBERS = (
    _media()
    + """, members AS (SELECT *, item_idx % 97 AS group_id, CAST(floor(item_idx / 97) AS INTEGER) AS member_pos, width::BIGINT * height AS pixels,
  ((item_idx * 7 % 11 < 4) OR ((item_idx % 97) % 9 = 0 AND (item_idx % 97) % 2 = 0)) AND (item_idx % 97) % 13 <> 5 AS is_selected FROM media)"""
)
_GROUPS = (
    _MEMBERS
    + """, groups_ AS (SELECT group_id, 'Group ' || (group_id % 40) AS name, CASE WHEN group_id % 6 = 0 THEN 1 ELSE n END::BIGINT AS item_count,
  CASE WHEN group_id % 7 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE + (group_id * 31 % 50) / 128::DOUBLE END AS average_similarity FROM (SELECT group_id, count(*) AS n FROM members GROUP BY group_id)),
base AS (SELECT *, row_number() OVER (ORDER BY average_similarity DESC, group_id)::INTEGER AS group_rank FROM groups_ WHERE item_count > 1)"""
)
_RULES = {"KeepNewest": "row_number() OVER (PARTITION BY group_id ORDER BY created_at DESC, modified_at DESC, member_pos) > 1", "KeepLowestResolution": "row_number() OVER (PARTITION BY group_id ORDER BY pixels, file_size, member_pos) > 1", "KeepNone": "TRUE"}


def _replayed() -> str:
    """The events one after another."""
    steps = ["s0 AS (SELECT * FROM members)"]
    for i, (n, k, kind, strategy) in enumerate(SELECTION_EVENTS):
        made = {"apply": _RULES.get(strategy), "clear": "FALSE", "toggle": "NOT bool_and(is_selected) OVER (PARTITION BY group_id)"}[kind]
        steps.append(f"s{i + 1} AS (SELECT * REPLACE (CASE WHEN group_id % {n} = {k} THEN {made} ELSE is_selected END AS is_selected) FROM s{i})")
    return f"WITH {_MEMBERS}, {', '.join(steps)} SELECT group_id, item_idx, is_selected FROM s{len(SELECTION_EVENTS)}"


_DOT = "list_reduce(list_transform(list_zip({a}, {b}), lambda z: (z[1] * z[2])::DOUBLE), lambda p, q: p + q)"
_COS = "CASE WHEN x.m * y.m = 0 THEN 0 ELSE " + _DOT.format(a="x.v", b="y.v") + " / (x.m * y.m) END"


def _sims(where: str = "TRUE") -> str:
    return f"""vecs AS (SELECT item_idx AS id, source_id AS src, features AS v, sqrt({_DOT.format(a='features', b='features')}) AS m FROM media),
sims AS (SELECT x.id AS i, y.id AS j, {_COS} AS s FROM vecs x JOIN vecs y ON x.id < y.id AND ({where}))"""


_HAC = """live AS (SELECT DISTINCT unnest([i, j]) AS id FROM sims WHERE s >= 0.40),
st AS (SELECT 0 AS step, v.id AS item, v.src AS src, v.id AS cl, 0 AS pos FROM live JOIN vecs v USING (id) UNION ALL
  SELECT st.step + 1, st.item, st.src, CASE WHEN st.cl = b.cj THEN b.ci ELSE st.cl END, CASE WHEN st.cl = b.cj THEN st.pos + b.ni ELSE st.pos END
  FROM st, (SELECT x.cl AS ci, y.cl AS cj, avg(z.s) AS s, count(DISTINCT x.item) AS ni FROM st x JOIN st y ON x.cl < y.cl JOIN sims z ON z.i = least(x.item, y.item) AND z.j = greatest(x.item, y.item)
    GROUP BY x.cl, y.cl HAVING NOT bool_or(x.src = y.src) AND avg(z.s) >= 0.40 ORDER BY s DESC, ci, cj LIMIT 1) b),
fin AS (SELECT item, cl, pos FROM st WHERE step = (SELECT max(step) FROM st)),
mem AS (SELECT cl AS slot, pos AS member_pos, item AS item_idx FROM fin UNION ALL SELECT id, 0, id FROM vecs WHERE id NOT IN (SELECT id FROM live)),
avgs AS (SELECT a.slot, avg(z.s) AS av FROM mem a JOIN mem b ON a.slot = b.slot AND a.item_idx < b.item_idx JOIN sims z ON z.i = a.item_idx AND z.j = b.item_idx GROUP BY a.slot)"""


def _hac(by_label: bool) -> str:
    return f"WITH RECURSIVE {_media(True, by_label)}, {_sims()}, {_HAC}"


_TABLE = _hac(True) + """, g AS (SELECT m.slot, count(*) AS item_count, coalesce(max(av), 1.0) AS av FROM mem m LEFT JOIN avgs USING (slot) GROUP BY m.slot),
tab AS (SELECT row_number() OVER (ORDER BY slot) - 1 AS group_id, CASE WHEN item_count > 1 THEN sum(CASE WHEN item_count > 1 THEN 1 ELSE 0 END) OVER (ORDER BY slot) ELSE row_number() OVER (ORDER BY slot) END AS num, item_count, av FROM g)"""
_HEADER = """SELECT 0.40::DOUBLE AS threshold, count(*) AS total_groups, count(*) FILTER (WHERE item_count > 1) AS duplicate_groups, count(*) FILTER (WHERE item_count <= 1) AS single_groups,
coalesce(sum(item_count) FILTER (WHERE item_count > 1), 0)::BIGINT AS duplicate_items, coalesce(sum(item_count), 0)::BIGINT AS total_items FROM tab"""
_KEEP = "SELECT group_id, item_idx, row_number() OVER (PARTITION BY group_id ORDER BY {order}, member_pos) > 1 AS is_selected FROM members"
_REMOVED = "(SELECT file_path FROM media WHERE item_idx % 3 = 1)"
_EXT = "lower(regexp_extract({p}, '(\\.[^./\\\\]+)$', 1))"
_NAME = "regexp_extract({p}, '([^/\\\\]*)$', 1)"
_TRIMMED = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"
_RAW = """names AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN ' ' || p_name || '.. ' WHEN 2 THEN replace(p_name, ' ', '/') WHEN 3 THEN list_extract(['con', 'COM10', 'lpt1', 'nul.txt'], (floor(p_partkey / 8)::BIGINT % 4 + 1))
  WHEN 4 THEN p_name || chr(9) || p_name WHEN 5 THEN repeat(p_name, 20) WHEN 6 THEN '...' WHEN 7 THEN p_name || '?"<x>|' ELSE p_name END AS raw FROM part), t AS (SELECT p_partkey, raw, """ + _TRIMMED + """ AS t FROM names)"""
_SANE = """regexp_replace(regexp_replace(regexp_replace({t}, '[\\\\/:*?"<>|]', '_', 'g'), '[\\x00-\\x1f]', '', 'g'), '[. ]+$', '')"""


def _case(table: dict, key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def _cut(text: str) -> str:
    return f"CASE WHEN length({text}) > 255 THEN regexp_replace(substr({text}, 1, 255), '[. ]+$', '') ELSE {text} END"


_LISTING = _media() + """, listing AS (SELECT file_path, item_idx AS scan_seq, '/lib' AS root FROM media UNION ALL SELECT upper(file_path), item_idx - 250, '/Other' FROM media WHERE item_idx % 2 = 0),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(file_path) ORDER BY scan_seq, file_path) AS n FROM listing) WHERE n = 1)"""
_GAPS = _media() + """, gaps AS (SELECT item_idx, file_path, CASE WHEN item_idx % 6 IN (0, 1) THEN NULL ELSE features END AS features, CASE WHEN item_idx % 8 = 0 THEN NULL WHEN item_idx % 8 = 1 THEN '' ELSE file_path END AS processed_path FROM media)"""
_IMAGE = _EXT.format(p="file_path") + " IN " + _list(IMAGE_EXTENSIONS)
_VIDEO = _EXT.format(p="file_path") + " IN " + _list(VIDEO_EXTENSIONS)
_PLAN = _MEMBERS + """, plan AS (SELECT '/lib/img_' || (item_idx % 12) || '.jpg' AS file_path, item_idx AS seq, 'Group/' || (group_id % 4) AS name FROM members WHERE is_selected)"""
_SIZE_N = "(n_chars * list_extract([1, 1024, 1048576, 37], doc_id % 4 + 1))::HUGEINT"


def _size_text() -> str:
    out = f"WHEN {_SIZE_N} < 1024 THEN format('{{:,}} B', ({_SIZE_N})::BIGINT) "
    for power, unit in ((5, "PB"), (4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        tenths = f"(({_SIZE_N} * 20 + {1024**power}) // {2 * 1024**power})"
        out += f"WHEN {_SIZE_N} >= {1024**power} THEN format('{{:,}}', ({tenths} // 10)::BIGINT) || '.' || ({tenths} % 10) || ' {unit}' "
    return "CASE " + out + "END"


def _half_up(x: str, digits: int = 0) -> str:
    """Text of a number rounded half up to 0 or 1 decimals, by whole numbers."""
    if not digits:
        return f"floor({x} + 0.5)::BIGINT::VARCHAR"
    return f"((floor({x} * 10 + 0.5)::BIGINT // 10)::VARCHAR || '.' || (floor({x} * 10 + 0.5)::BIGINT % 10)::VARCHAR)"


ORACLE_SQL: dict[str, str] = {
    "cosine_pairs": f"WITH {_media(by_label=False)}, {_sims()} SELECT i, j, round(s, 12) AS sim FROM sims WHERE s >= 0.40",
    "cosine_pairs_source_constrained": f"WITH {_media(True)}, {_sims('x.src <> y.src')} SELECT i, j, round(s, 12) AS sim FROM sims WHERE s >= 0.40",
    "cosine_to_anchor": f"WITH {_media()}, vecs AS (SELECT item_idx AS id, features AS v, sqrt({_DOT.format(a='features', b='features')}) AS m FROM media) SELECT x.id AS item_idx, y.id AS anchor, round({_COS}, 12) AS sim FROM vecs x JOIN vecs y ON y.id < 10",
    "similar_components": f"""WITH RECURSIVE {_media(True, False)}, {_sims()}, e AS (SELECT i AS a, j AS b FROM sims WHERE s >= 0.40 UNION ALL SELECT j, i FROM sims WHERE s >= 0.40),
reach AS (SELECT a AS item, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.item) SELECT item AS item_idx, min(r) AS component_id FROM reach GROUP BY item""",
    "hac_groups_incremental": _hac(True) + " SELECT slot, member_pos::INTEGER AS member_pos, item_idx, round(coalesce(av, 1.0), 6) AS average_similarity FROM mem LEFT JOIN avgs USING (slot)",
    "feature_table_updates": f"WITH {_media()} SELECT item_idx, least(8, len(features))::INTEGER AS dims, CASE WHEN item_idx % 5 = 2 OR item_idx % 7 = 3 THEN 1 ELSE 0 END::BIGINT AS computed_by, TRUE AS stale_in_another_layout FROM media",
    "rescan_changes": f"""WITH {_media()}, before AS (SELECT lower(file_path) AS path_key, file_size AS size_before FROM media WHERE item_idx % 10 <> 4),
after AS (SELECT lower(file_path) AS path_key, file_size + CASE WHEN item_idx % 9 = 5 THEN 1 ELSE 0 END AS size_after FROM media WHERE item_idx % 10 <> 6)
SELECT path_key, CASE WHEN size_before IS NULL THEN 'added' WHEN size_after IS NULL THEN 'gone' ELSE 'changed' END AS change, size_before, size_after FROM before FULL JOIN after USING (path_key) WHERE size_before IS DISTINCT FROM size_after""",
    "rescan_media": f"""WITH {_media()} SELECT upper(file_path) AS file_path, file_size, '/other' AS root, 2::BIGINT AS scan_seq FROM media WHERE item_idx % 2 = 0
UNION ALL SELECT file_path, file_size + CASE WHEN item_idx % 9 = 5 THEN 1 ELSE 0 END, '/lib', 3 FROM media WHERE item_idx % 2 <> 0""",
    "cosine_pairs_indexed": f"WITH {_media(by_label=False)}, {_sims()} SELECT i, j, round(s, 12) AS sim FROM sims WHERE s >= 0.40",
    "hac_groups": _hac(False) + " SELECT slot, member_pos::INTEGER AS member_pos, item_idx, round(coalesce(av, 1.0), 6) AS average_similarity FROM mem LEFT JOIN avgs USING (slot)",
    "hac_groups_source_constrained": _hac(True) + " SELECT slot, member_pos::INTEGER AS member_pos, item_idx, round(coalesce(av, 1.0), 6) AS average_similarity FROM mem LEFT JOIN avgs USING (slot)",
    "group_table": _TABLE + " SELECT group_id, 'Group ' || num::BIGINT AS name, item_count, round(av, 6) AS average_similarity, item_count > 1 AS is_duplicate FROM tab",
    "result_header": _TABLE + " " + _HEADER,
    "result_summary": _TABLE + f", h AS ({_HEADER}) SELECT 'Found ' || duplicate_groups || ' duplicate group(s) containing ' || duplicate_items || ' item(s). ' || single_groups || ' item(s) unique.' AS summary FROM h",
    "groups_base_order": f"WITH {_GROUPS} SELECT * FROM base",
    "groups_filter_all": f"WITH {_GROUPS} SELECT * FROM base",
    "groups_filter_exact": f"WITH {_GROUPS} SELECT * FROM base WHERE average_similarity >= 0.9999",
    "groups_filter_similar": f"WITH {_GROUPS} SELECT * FROM base WHERE average_similarity < 0.9999",
    "groups_sort_similarity": f"WITH {_GROUPS} SELECT * REPLACE (row_number() OVER (ORDER BY average_similarity DESC, group_rank)::INTEGER AS group_rank) FROM base",
    "groups_sort_count": f"WITH {_GROUPS} SELECT * REPLACE (row_number() OVER (ORDER BY item_count DESC, group_rank)::INTEGER AS group_rank) FROM base",
    "groups_sort_name": f"WITH {_GROUPS} SELECT * REPLACE (row_number() OVER (ORDER BY name, group_rank)::INTEGER AS group_rank) FROM base",
    "thumbnails_first4": f"WITH {_MEMBERS} SELECT group_id, string_agg(file_path, '|' ORDER BY member_pos) AS paths FROM members WHERE member_pos < 4 GROUP BY group_id",
    "select_visible_groups": f"WITH {_MEMBERS} SELECT group_id, item_idx, CASE WHEN group_id % 3 = 0 THEN row_number() OVER (PARTITION BY group_id ORDER BY created_at DESC, modified_at DESC, member_pos) > 1 ELSE is_selected END AS is_selected FROM members",
    "select_clear": f"WITH {_MEMBERS} SELECT group_id, item_idx, FALSE AS is_selected FROM members",
    "group_toggle": f"WITH {_MEMBERS} SELECT group_id, item_idx, NOT bool_and(is_selected) OVER (PARTITION BY group_id) AS is_selected FROM members",
    "group_tristate": f"WITH {_MEMBERS} SELECT group_id, count(*) FILTER (WHERE is_selected) AS selected, bool_or(is_selected) AS any_selected, CASE WHEN NOT bool_or(is_selected) THEN FALSE WHEN bool_and(is_selected) THEN TRUE END AS state FROM members GROUP BY group_id",
    "selection_summary": f"WITH {_MEMBERS}, per AS (SELECT group_id, count(*) FILTER (WHERE is_selected) AS n FROM members GROUP BY group_id) SELECT sum(n)::BIGINT AS selected_items, count(*) FILTER (WHERE n > 0) AS selected_groups FROM per",
    "selected_paths": f"WITH {_GROUPS} SELECT group_rank, member_pos, file_path FROM members JOIN base USING (group_id) WHERE is_selected",
    "selected_paths_by_group": f"WITH {_GROUPS}, s AS (SELECT name, group_id, member_pos, file_path, group_rank FROM members JOIN base USING (group_id) WHERE is_selected) SELECT name, group_id, member_pos, file_path FROM s QUALIFY group_rank = max(group_rank) OVER (PARTITION BY name)",
    "selection_log_fold": _replayed(),
    "group_state_removals": f"WITH {_MEMBERS}, l AS (SELECT group_id, item_idx, count(*) OVER (PARTITION BY group_id) AS item_count FROM members WHERE item_idx % 9 NOT IN (1, 4, 7)) SELECT * FROM l WHERE item_count > 1",
    "remove_paths_dissolve": f"WITH {_MEMBERS}, l AS (SELECT group_id, item_idx, count(*) OVER (PARTITION BY group_id) AS item_count FROM members WHERE file_path NOT IN {_REMOVED}) SELECT * FROM l WHERE item_count > 1",
    "live_counts": f"WITH {_MEMBERS}, per AS (SELECT group_id, count(*) AS n FROM members WHERE file_path NOT IN {_REMOVED} GROUP BY group_id) SELECT count(*) FILTER (WHERE n > 1) AS duplicate_groups, count(*) FILTER (WHERE n <= 1) AS single_groups, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS duplicate_items, 500::BIGINT AS total_items FROM per",
    "rename_groups": f"WITH {_GROUPS} SELECT group_id, CASE group_id % 5 WHEN 1 THEN 'New ' || group_id WHEN 2 THEN 'a_b_c' ELSE name END AS name FROM groups_",
    "classify_extension": f"WITH {_media()} SELECT item_idx, {_IMAGE} AS is_image, {_VIDEO} AS is_video, {_EXT.format(p='file_path')} = '.onnx' AS is_model, {_IMAGE} OR {_VIDEO} AS is_media, CASE WHEN {_IMAGE} THEN 'Image' WHEN {_VIDEO} THEN 'Video' END AS media_type FROM media",
    "path_dedup_first_wins": f"WITH {_LISTING} SELECT file_path, scan_seq FROM firsts",
    "provenance_remove_root": f"WITH {_LISTING} SELECT file_path, scan_seq FROM firsts WHERE lower(file_path) IN (SELECT lower(file_path) FROM listing WHERE lower(root) <> '/lib')",
    "add_files_unlisted": f"WITH {_media()} SELECT item_idx FROM media WHERE {_IMAGE} AND item_idx % 4 <> 0",
    "media_items": f"WITH {_media()} SELECT item_idx, NULL::INTEGER AS frame_index, FALSE AS processed, TRUE AS no_features FROM media WHERE {_IMAGE}",
    "featured_items": f"WITH {_GAPS} SELECT item_idx, len(features)::INTEGER AS dims FROM gaps WHERE features IS NOT NULL",
    "processed_items": f"WITH {_GAPS} SELECT item_idx, processed_path FROM gaps WHERE processed_path <> ''",
    "item_counters": f"WITH {_GAPS} SELECT (SELECT count(DISTINCT source_id) FROM media) AS n_sources, count(*) FILTER (WHERE processed_path <> '') AS n_processed, count(*) AS n_items, count(*) FILTER (WHERE {_IMAGE}) AS n_images, count(*) FILTER (WHERE {_VIDEO}) AS n_videos, count(features) AS n_featured FROM gaps",
    "remove_items_by_path": f"WITH {_media()} SELECT item_idx FROM media WHERE file_path NOT IN {_REMOVED}",
    "sources_with_items": "SELECT DISTINCT label AS source_id FROM embeddings WHERE label IN (SELECT label FROM embeddings WHERE vec_id % 50 = 3)",
    "video_frames": f"WITH {_media()} SELECT item_idx, f::INTEGER AS frame_index, f / 25.0::DOUBLE AS frame_seconds FROM media, range(4) r(f) WHERE {_VIDEO} AND f < item_idx % 4",
    "path_parts": f"""SELECT page_id, {_NAME.format(p='url')} AS file_name, regexp_replace({_NAME.format(p='url')}, '\\.[^.]*$', '') AS stem, {_EXT.format(p='url')} AS extension, upper(ltrim({_EXT.format(p='url')}, '.')) AS shown, regexp_replace(url, '[/\\\\][^/\\\\]*$', '') AS directory FROM pages""",
    "sanitize_name": f"""WITH {_RAW}, s AS (SELECT p_partkey, {_SANE.format(t='t')} AS s FROM t), r AS (SELECT p_partkey, CASE WHEN upper(s) IN {_list(RESERVED_NAMES)} THEN s || '_' ELSE s END AS s FROM s) SELECT p_partkey, nullif({_cut('s')}, '') AS name FROM r""",
    "validate_name": f"""WITH {_RAW} SELECT p_partkey, length(t) <= 255 AND NOT regexp_matches(t, '[\\\\/:*?"<>|]') AND NOT regexp_matches(t, '[\\x00-\\x1f]') AND NOT regexp_matches(t, '[. ]$') AND upper(t) NOT IN {_list(RESERVED_NAMES)} AS is_valid FROM t""",
    "format_file_size": f"SELECT doc_id, {_size_text()} AS size_text FROM documents",
    "resolution_orientation": f"WITH {_media()} SELECT item_idx, width || ' × ' || height AS resolution, width::BIGINT * height AS pixels, round(width::BIGINT * height / 1e6, 6) AS megapixels, round(width::DOUBLE / height, 6) AS aspect, CASE WHEN width > height THEN 'Landscape' WHEN width < height THEN 'Portrait' ELSE 'Square' END AS orientation FROM media",
    "camera_texts": f"""WITH {_media()} SELECT item_idx, CASE item_idx % 5 WHEN 0 THEN '' WHEN 1 THEN (item_idx % 7 + 1) || '.0s' ELSE '1/' || floor(1 / (1 / (item_idx % 997 + 1.5::DOUBLE)))::BIGINT || 's' END AS exposure, CASE WHEN item_idx % 3 > 0 THEN 'ISO ' || item_idx % 64 * 100 ELSE '' END AS iso, CASE WHEN item_idx % 4 > 0 THEN (item_idx % 200) || 'mm' ELSE '' END AS focal, CASE WHEN item_idx % 6 > 0 THEN 'f/' || (item_idx % 16) || '.5' ELSE '' END AS aperture, CASE WHEN item_idx % 9 > 0 THEN format('{{:.6f}}, {{:.6f}}', item_idx / 8::DOUBLE, -7.25::DOUBLE) ELSE '' END AS gps, CASE WHEN item_idx % 2 = 0 THEN 'Auto' ELSE 'Manual' END AS white_balance FROM media""",
    "flash_mode": "SELECT vec_id AS item_idx, " + _case(FLASH_MODES, "vec_id % 100", "'Unknown (' || vec_id % 100 || ')'") + " AS flash, (vec_id % 100) % 2 = 1 AS fired FROM embeddings",
    "format_bitrate": f"WITH b AS (SELECT vec_id, (vec_id * 12500 * (vec_id % 3))::BIGINT AS b FROM embeddings) SELECT vec_id AS item_idx, CASE WHEN b <= 0 THEN '' WHEN b < 1000000 THEN {_half_up('(b / 1000::DOUBLE)')} || ' kbps' ELSE {_half_up('(b / 1000000::DOUBLE)', 1)} || ' Mbps' END AS bitrate FROM b",
    "duration_text": "WITH d AS (SELECT vec_id, vec_id * 331 AS s FROM embeddings) SELECT vec_id AS item_idx, CASE WHEN s >= 3600 THEN (s // 3600 % 24) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE (s % 3600 // 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS duration, trunc(s::DOUBLE * 23.976::DOUBLE)::BIGINT AS frames FROM d",
    "audio_channels": "SELECT vec_id AS item_idx, " + _case(CHANNEL_NAMES, "vec_id % 15", "vec_id % 15 || ' channels'") + " AS channels FROM embeddings",
    "progress_texts": f"SELECT vec_id AS item_idx, round(vec_id::DOUBLE / 512 * 100, 6) AS percent, {_half_up('(vec_id % 101 / 128::DOUBLE * 100)', 1)} || '%' AS similarity FROM embeddings",
    "tolerance_label": "SELECT vec_id AS item_idx, CASE WHEN vec_id % 256 < 20 THEN 'Very Conservative' WHEN vec_id % 256 < 50 THEN 'Conservative' WHEN vec_id % 256 < 100 THEN 'Balanced' WHEN vec_id % 256 < 150 THEN 'Aggressive' ELSE 'Very Aggressive' END AS label_text FROM embeddings",
    "settings_clamp": "SELECT vec_id AS item_idx, greatest(0.3::DOUBLE, least(1.0::DOUBLE, vec_id / 256::DOUBLE)) AS threshold, greatest(1, least(64, vec_id % 130))::BIGINT AS batch_size FROM embeddings",
    "model_name": f"WITH {_media()} SELECT item_idx, CASE WHEN item_idx % 5 = 0 THEN 'bundled model' WHEN item_idx % 3 = 0 THEN 'no model selected' ELSE 'img_' || item_idx END AS model FROM media",
    "pixel_formats": "SELECT vec_id AS item_idx, list_extract([8, 16, 32, 32, 64, 24], vec_id % 6 + 1)::INTEGER AS bits, list_extract(['.png', '.jpg', '.bmp', '.tiff', '.webp', '.png'], vec_id % 6 + 1) AS extension FROM embeddings",
    "sampling_choice": f"WITH {_media()} SELECT item_idx, CASE WHEN greatest(width, height) > 640 THEN 'Bilinear' ELSE 'Lanczos' END AS stretch, CASE WHEN least(width, height) > 640 THEN 'Bilinear' ELSE 'Lanczos' END AS crop FROM media",
    "pixel_normalise": "SELECT vec_id AS item_idx, " + ", ".join(f"round((((vec_id % 256)::FLOAT / 255.0::FLOAT - {m}::FLOAT) * (1.0::FLOAT / {s}::FLOAT))::DOUBLE, 4) AS {n}" for n, m, s in (("r", 0.485, 0.229), ("g", 0.456, 0.224), ("b", 0.406, 0.225))) + " FROM embeddings",
    "colour_pack": "SELECT vec_id AS item_idx, (vec_id % 256) * 16777216 + (vec_id * 3 % 256) * 65536 + (vec_id * 5 % 256) * 256 + vec_id * 7 % 256 AS packed, (vec_id * 3 % 256)::INTEGER AS red, abs(vec_id % 256 - 40) <= 80 AND abs(vec_id * 3 % 256 - 50) <= 80 AS matches FROM embeddings",
    "move_plan": f"WITH {_PLAN} SELECT 'Move' AS action, '/out' AS dest_dir, file_path, seq FROM plan",
    "move_plan_grouped": f"WITH {_PLAN} SELECT 'Copy' AS action, '/out/' || replace(name, '/', '_') AS dest_dir, file_path, seq, NULL::VARCHAR AS error FROM plan",
    "unique_targets": f"""WITH {_PLAN}, n AS (SELECT seq, regexp_extract(file_path, '([^/]*)\\.jpg$', 1) AS stem, row_number() OVER (PARTITION BY file_path ORDER BY seq) AS k FROM plan)
SELECT seq, '/out/' || stem || CASE WHEN stem = 'img_1' THEN ' (' || (CASE WHEN k = 1 THEN 1 ELSE k + 1 END) || ')' WHEN k = 1 THEN '' ELSE ' (' || (k - 1) || ')' END || '.jpg' AS target FROM n""",
    "op_result_fold": f"WITH {_MEMBERS}, r AS (SELECT item_idx % 7 <> 0 AS ok FROM members) SELECT count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, count(*) AS total, bool_or(NOT ok) AS has_failures, bool_and(ok) AS all_succeeded FROM r",
}

_ORDERS = {
    "highest_res": "pixels DESC, file_size DESC",
    "lowest_res": "pixels, file_size",
    "newest": "created_at DESC, modified_at DESC",
    "oldest": "created_at, modified_at DESC",
    "largest": "file_size DESC, pixels DESC",
    "smallest": "file_size, pixels DESC",
}
ORACLE_SQL |= {f"select_keep_{k}": f"WITH {_MEMBERS} " + _KEEP.format(order=v) for k, v in _ORDERS.items()}
ORACLE_SQL |= {f"select_keep_{k}": f"WITH {_MEMBERS} SELECT group_id, item_idx, {v} AS is_selected FROM members" for k, v in (("all", "FALSE"), ("none", "TRUE"))}
ORACLE_SQL |= imaging_queries.ORACLE_SQL
