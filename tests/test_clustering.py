"""Clusters: golden traces, a literal restatement on ties, and invariants."""

import numpy as np
import pytest

from twinweave.operators import clustering, graph, merging, similarity
from twinweave.operators.clustering import cluster_matrix, mean_similarity


def matrix(n, **pairs):
    out = np.eye(n)
    for k, v in pairs.items():
        i, j = int(k[1]), int(k[2])
        out[i, j] = out[j, i] = v
    return out


CASES = {
    "average, not single, linkage": (matrix(3, s01=0.9, s02=0.8, s12=0.5), None, 0.7, [[0, 1], [2]]),
    "chain accepted": (matrix(3, s01=0.9, s02=0.8, s12=0.5), None, 0.6, [[0, 1, 2]]),
    "ties go to the smallest pair": (matrix(4, s01=0.9, s12=0.9, s23=0.9), None, 0.5, [[0, 1], [2, 3]]),
    "member order is merge order": (matrix(3, s02=0.95, s01=0.9, s12=0.9), None, 0.7, [[0, 2, 1]]),
    "merge into the lower slot": (matrix(3, s12=0.95, s01=0.8, s02=0.8), None, 0.7, [[0, 1, 2]]),
    "one source stays apart": (matrix(3, s02=0.9, s12=0.95), ["a", "a", "b"], 0.7, [[0], [1, 2]]),
    "equality merges": (matrix(2, s01=0.5), None, 0.5, [[0, 1]]),
    "minus one never merges": (matrix(2, s01=-1.0), None, -1.0, [[0], [1]]),
    "NaN never merges": (matrix(2, s01=np.nan), None, 0.3, [[0], [1]]),
    "single": (matrix(1), None, 0.5, [[0]]),
    "empty": (np.zeros((0, 0)), None, 0.5, []),
}


@pytest.mark.parametrize("name", CASES)
def test_trace(name):
    sims, sources, t, want = CASES[name]
    assert cluster_matrix(sims, sources or list(range(len(sims))), t) == want


def literal(sims, sources, t):
    """The rules as they are told, with every mean made anew in every round."""
    slots = [[i] for i in range(len(sims))]
    while True:
        best, at = -1.0, None
        for i in range(len(slots)):
            for j in range(i + 1, len(slots)):
                if not slots[i] or not slots[j] or {sources[a] for a in slots[i]} & {sources[b] for b in slots[j]}:
                    continue
                total = 0.0
                for a in slots[i]:
                    for b in slots[j]:
                        total += sims[a, b]
                mean = total / (len(slots[i]) * len(slots[j]))
                if mean > best:
                    best, at = mean, (i, j)
        if at is None or best < t:
            return [s for s in slots if s]
        slots[at[0]] += slots[at[1]]
        slots[at[1]] = []


def test_literal_restatement_on_ties():
    rng = np.random.default_rng(3)
    for k in range(60):
        n = int(rng.integers(2, 14))
        sims = rng.integers(0, 5, (n, n)) / 4
        sims = np.triu(sims, 1) + np.triu(sims, 1).T + np.eye(n)
        sources = rng.integers(0, n if k % 2 else 3, n).tolist()
        t = float(rng.choice([0.25, 0.5, 0.75]))
        assert cluster_matrix(sims, sources, t) == literal(sims, sources, t)


def test_mean_similarity():
    assert mean_similarity(np.ones((1, 2), np.float32)) == 1.0
    assert mean_similarity(np.array([[1, 0], [0, 1], [1, 1]], np.float32)) == pytest.approx(2 * 0.5**0.5 / 3)


def cosines(vectors):
    """The exact matrix, pair by pair."""
    n = len(vectors)
    return np.array([[1.0 if i == j else similarity.exact_cosines(vectors[[min(i, j)]], vectors[[max(i, j)]])[0] for j in range(n)] for i in range(n)])


@pytest.mark.parametrize("constrained", [False, True])
def test_clusters_of_vectors_follow_the_literal_rules(constrained):
    rng = np.random.default_rng(8)
    for k in range(40):
        n = int(rng.integers(2, 30))
        vectors = rng.normal(size=(n, 3)).astype(np.float32)
        vectors[rng.integers(0, n, n // 3)] = vectors[0] * np.float32(2)  # copies
        sources = rng.integers(0, 5, n).tolist()
        t = float(rng.choice([0.3, 0.6, 0.9, 0.999]))
        got = clustering.cluster_vectors(vectors, sources if constrained else None, t)
        assert got == literal(cosines(vectors), sources if constrained else list(range(n)), t), (k, n, t)


def test_many_copies_and_a_large_component():
    rng = np.random.default_rng(9)
    vectors = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 1500, axis=0), rng.normal(size=(500, 16))]).astype(np.float32)
    found = clustering.cluster_vectors(vectors, None, 0.9)
    assert found[0][:1500] == list(range(1500)) and sorted(i for m in found for i in m) == list(range(2000))


def _items(spark, vectors, sources=None):
    return spark.createDataFrame([(i, str((sources or range(len(vectors)))[i]), list(map(float, v)) if v is not None else None) for i, v in enumerate(vectors)], "item_idx long, source_id string, features array<float>")


def test_blocks_do_not_matter(spark):
    rng = np.random.default_rng(5)
    items = _items(spark, rng.normal(size=(60, 8)).tolist(), (np.arange(60) % 9).tolist())
    want = sorted(map(tuple, similarity.pairs_native(items, 0.5, True).collect()))
    for rows in (7, 25, 1000):
        assert sorted(map(tuple, similarity.similar_pairs(items, 0.5, True, rows).collect())) == want


def test_clusters_cover_every_item_once_and_respect_sources(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(50, 4)).tolist()
    sources = (np.arange(50) % 6).tolist()
    items = _items(spark, vectors, sources)
    rows = clustering.clusters(items, 0.6).collect()
    assert sorted(r["item_idx"] for r in rows) == list(range(50))
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r["slot"], []).append(r)
    for slot, members in by_slot.items():
        assert len({sources[m["item_idx"]] for m in members}) == len(members)
        assert min(m["item_idx"] for m in members) == slot
        assert sorted(m["member_pos"] for m in members) == list(range(len(members)))
    sims = cosines(np.array(vectors, np.float32))
    same = np.array(sources)
    sims[(same[:, None] == same[None, :]) & ~np.eye(50, dtype=bool)] = 0
    whole = literal(sims, sources, 0.6)
    got = [[m["item_idx"] for m in sorted(v, key=lambda m: m["member_pos"])] for _, v in sorted(by_slot.items())]
    assert got == sorted(whole)


def test_items_without_features_and_empty_tables(spark):
    items = _items(spark, [[1, 0], None, [], [1, 0]])
    assert sorted((r["slot"], r["item_idx"]) for r in clustering.clusters(items, 0.5).collect()) == [(0, 0), (0, 3)]
    found, members = clustering.analyse(items.limit(0), 0.5)
    assert found.count() == 0 and members.count() == 0


def test_group_names_and_ids(spark):
    members = spark.createDataFrame([(0, 0, 0, 1.0), (20000, 0, 20000, 0.9), (20000, 1, 20001, 0.9), (40000, 0, 40000, 1.0), (50000, 0, 50000, 0.8), (50000, 1, 50001, 0.8)], "slot long, member_pos int, item_idx long, average_similarity double")
    rows = {r["slot"]: (r["group_id"], r["name"]) for r in clustering.group_table(members).collect()}
    assert rows == {0: (0, "Group 1"), 20000: (1, "Group 1"), 40000: (2, "Group 3"), 50000: (3, "Group 2")}


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "i long, j long")
    rows = dict(graph.components(pairs).collect())
    assert rows == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("few", [0, 7, 1 << 16])
def test_components_of_random_graphs(spark, monkeypatch, few):
    """Contracted in rounds, ended in one task, or both."""
    monkeypatch.setattr(graph, "FEW_ARCS", few)
    rng = np.random.default_rng(few)
    for n, m in ((60, 40), (200, 260), (30, 1)):
        ends = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] + [(n + 5, n + 5), (n + 9, n + 8), (n + 8, n + 9)]
        label = {x: x for p in ends for x in p}
        for _ in range(n):
            for a, b in ends:
                label[a] = label[b] = min(label[a], label[b])
        assert dict(graph.components(spark.createDataFrame(ends, "i long, j int")).collect()) == label
    assert graph.components(spark.createDataFrame([], "i long, j long")).count() == 0


def test_vectors_of_unequal_length_are_an_error(spark):
    with pytest.raises(ValueError, match="differ"):
        similarity.check_lengths(_items(spark, [[1, 0], [1, 0, 0]]))


def test_copies_are_gathered_before_pairs(spark, monkeypatch):
    """Very many copies of one vector end in seconds, and the bound counts distinct vectors."""
    monkeypatch.setattr(clustering, "LARGEST_COMPONENT", 5)
    n = 20_000
    vectors = spark.range(n).selectExpr("id as item_idx", "cast(id as string) as source_id", "transform(array(0.3f, -0.7f, 0.1f), x -> cast(x * pow(2, id % 5) as float)) as features")
    near = _items(spark, [[0.3, -0.7, 0.2], [0, 0, 1], [0, 0, 0], [0, 0, 0]]).selectExpr("item_idx + 100000 as item_idx", "source_id || 'x' as source_id", "features")
    items = vectors.unionByName(near)
    asked = []
    kept = similarity.similar_pairs
    monkeypatch.setattr(clustering, "similar_pairs", lambda held, *a, **k: asked.append(held.count()) or kept(held, *a, **k))
    rows = {r["item_idx"]: r for r in clustering.clusters(items, 0.9).collect()}
    assert asked == [5] and len(rows) == n + 4
    assert all(rows[i]["slot"] == 0 and rows[i]["member_pos"] == i for i in range(n))
    assert (rows[100_000]["slot"], rows[100_000]["member_pos"]) == (0, n)
    a, b = np.array([[0.3, -0.7, 0.1]], np.float32), np.array([[0.3, -0.7, 0.2]], np.float32)
    cross = similarity.exact_cosines(a, b)[0]
    assert rows[0]["average_similarity"] == pytest.approx((n * (n - 1) / 2 + n * cross) / ((n + 1) * n / 2), abs=1e-9)
    assert [rows[100_000 + k]["slot"] for k in (1, 2, 3)] == [100_001, 100_002, 100_003]


@pytest.mark.parametrize("constrained", [False, True])
def test_clusters_with_copies_follow_the_literal_rules(spark, constrained):
    """Copies, some of one source, some of sources that near vectors have too."""
    rng = np.random.default_rng(12)
    for k in range(4):
        base = rng.normal(size=(8, 3)).astype(np.float32)
        vectors = [base[i] * np.float32(2.0 ** rng.integers(0, 3)) if rng.random() < 0.6 else rng.normal(size=3).astype(np.float32) for i in rng.integers(0, 8, 36)]
        sources = rng.integers(0, 12 if k % 2 else 36, 36).tolist()
        t = (0.5, 0.8, 0.95, 1.0)[k]
        want = literal(cosines(np.array(vectors)), sources if constrained else list(range(36)), t)
        found = clustering.clusters(_items(spark, vectors, sources), t, constrained).collect()
        got = {}
        for r in sorted(found, key=lambda r: r["member_pos"]):
            got.setdefault(r["slot"], []).append(r["item_idx"])
        assert sorted(got.values()) == sorted(want), (k, t)
        for r in found:
            assert r["average_similarity"] == pytest.approx(mean_similarity(np.array(vectors)[got[r["slot"]]]), abs=1e-9)


def test_ranks_within_groups(spark):
    rows = spark.range(50_000).selectExpr("id * 3 as item_idx", "id % 2 as g")
    got = {r["item_idx"]: r["place"] for r in clustering.ranked(rows, "item_idx", "place", within="g").collect()}
    assert all(got[3 * i] == i // 2 + 1 for i in range(50_000))


@pytest.mark.parametrize("constrained", [False, True])
def test_large_components_go_through_rounds(spark, monkeypatch, constrained):
    """Components beyond the bound of one task are merged over tables first; the clusters are those of the literal rules."""
    monkeypatch.setattr(clustering, "LARGEST_COMPONENT", 4)
    rng = np.random.default_rng(21)
    for t, dims in ((0.4, 6), (0.7, 4)):
        vectors = rng.normal(size=(48, dims)).astype(np.float32)
        vectors[40:44] = vectors[:4] * np.float32(2)  # copies
        sources = rng.integers(0, 14, 48).tolist()
        want = literal(cosines(vectors), sources if constrained else list(range(48)), t)
        got = {}
        for r in sorted(clustering.clusters(_items(spark, vectors.tolist(), sources), t, constrained).collect(), key=lambda r: r["member_pos"]):
            got.setdefault(r["slot"], []).append(r["item_idx"])
        assert sorted(got.values()) == sorted(want)
        assert {m[0]: m for m in want} == got


def test_rounds_on_ties(spark, monkeypatch):
    """Vectors of small whole numbers: many means are equal, or at the threshold."""
    monkeypatch.setattr(clustering, "LARGEST_COMPONENT", 3)
    vectors = np.random.default_rng(22).integers(-1, 2, (36, 5)).astype(np.float32)
    vectors = np.unique(vectors[np.abs(vectors).sum(axis=1) > 0], axis=0)
    for t in (0.5, 0.8):
        want = literal(cosines(vectors), list(range(len(vectors))), t)
        got = {}
        for r in sorted(clustering.clusters(_items(spark, vectors.tolist()), t, False).collect(), key=lambda r: r["member_pos"]):
            got.setdefault(r["slot"], []).append(r["item_idx"])
        assert sorted(got.values()) == sorted(want)


@pytest.mark.parametrize("constrained", [False, True])
def test_rounds_go_down_levels_and_take_the_strongest_edges(spark, monkeypatch, constrained):
    """Only the first level takes pairs; later ones compare clusters, and where rounds merge few, tasks merge the strongest edges."""
    monkeypatch.setattr(clustering, "LARGEST_COMPONENT", 8)
    monkeypatch.setattr(merging, "PAIRS_EACH", 0.5)
    monkeypatch.setattr(merging, "SLOW", 0)
    levels, taken = [], []
    compared, strongest = merging._compared, merging._strongest
    monkeypatch.setattr(merging, "_compared", lambda nodes, n, level: levels.append(level) or compared(nodes, n, level))
    monkeypatch.setattr(merging, "_strongest", lambda *a: taken.append(strongest(*a)) or taken[-1])
    rng = np.random.default_rng(23)
    vectors = rng.normal(size=(64, 5)).astype(np.float32)
    vectors[56:60] = vectors[:4] * np.float32(2)  # copies
    sources = rng.integers(0, 16, 64).tolist()
    want = literal(cosines(vectors), sources if constrained else list(range(64)), 0.4)
    got = {}
    for r in sorted(clustering.clusters(_items(spark, vectors.tolist(), sources), 0.4, constrained).collect(), key=lambda r: r["member_pos"]):
        got.setdefault(r["slot"], []).append(r["item_idx"])
    assert {m[0]: m for m in want} == got
    assert levels and levels[-1] == 0.4 and any(taken)


def test_first_edges_follow_the_rows_not_the_pairs(spark):
    """However many pairs there are, the first level has PAIRS_EACH for each row at most (and one part of the similarities)."""
    pairs = spark.range(100_000).selectExpr("id as i", "id + 1 as j", "0.4 + 0.5 * id / 100000 as sim")
    levels = merging._levels(pairs, 200, 0.4)
    assert levels == sorted(levels, reverse=True) and levels[-1] == 0.4
    assert pairs.where(f"sim >= {levels[0]}").count() <= merging.PAIRS_EACH * 200
    assert merging._levels(pairs, 100_000, 0.4) == [0.4] and merging._levels(pairs.limit(0), 5, 0.4) == [0.4]


def test_pairs_are_thinned_before_they_are_written(spark, monkeypatch):
    """A task hands on a link for each node at most, not its pairs."""
    n = 300
    pairs = spark.range(n).selectExpr("id as i").crossJoin(spark.range(n).selectExpr("id as j")).where("i < j").coalesce(2)
    assert graph._thinned(pairs).count() < 2 * n and pairs.count() == n * (n - 1) // 2
    assert dict(graph.components(pairs).collect()) == {i: 0 for i in range(n)}
    monkeypatch.setattr(graph, "TAKEN", 8)
    u, v = np.random.default_rng(1).integers(0, 400, (2, 300))
    label = dict(zip(*(x.tolist() for x in graph._linked(u, v)), strict=True))
    want = dict(graph._ended(spark.createDataFrame([(int(min(p)), int(max(p))) for p in zip(u, v, strict=True)], "u long, v long")).collect())
    assert {x: label.get(x, x) for x in want} == want
