import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import hdbscan_brute, mst_brute
from topicloom.session import cut_lineage
from topicloom.operators import cluster as cl
from topicloom.operators import encode as en
from topicloom.operators import reduce as rd
from topicloom.operators import topics as tp
from topicloom.operators import vectorjoin as vj
from topicloom.operators.spanning import mst_edges


def frame(spark, v):
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(v)], "id long, e array<double>")


def blobs(seed=1, copies=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 3)) * 4
    v = np.vstack([rng.normal(size=(45, 3)) * (0.3 + 0.2 * i) + c for i, c in enumerate(centres)] + [rng.uniform(-8, 8, size=(20, 3))])
    if copies:
        v[100:140] = v[100]
        v[10:13] = v[10]
    return v


@pytest.mark.parametrize("block_rows", [4096, 30])
@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn_is_exact(spark, metric, block_rows):
    """A fifth of the rows are copies of one vector; small blocks force the cell join."""
    v = blobs()
    unit = v if metric == "euclidean" else v / np.linalg.norm(v, axis=1)[:, None]
    d = ((unit[:, None] - unit[None]) ** 2).sum(2)
    d = np.sqrt(d) if metric == "euclidean" else d / 2
    got = vj.knn_join(frame(spark, v), 6, "id", "e", metric, block_rows).collect()
    assert len(got) == 6 * len(v)
    near = {(r.id, r["rank"]): (r.neighbor, r.distance) for r in got}
    for i in range(len(v)):
        want = [j for j in np.lexsort((np.arange(len(v)), np.round(d[i], 9))) if j != i][:6]
        assert [round(near[i, k + 1][1], 7) for k in range(6)] == [round(d[i, j], 7) for j in want]
        if metric == "euclidean":
            assert [near[i, k + 1][0] for k in range(6)] == want


def test_knn_with_few_cells_finds_most(spark):
    v = blobs(copies=False)
    exact = {(r.id, r.neighbor) for r in vj.knn_join(frame(spark, v), 5, "id", "e").collect()}
    some = {(r.id, r.neighbor) for r in vj.knn_join(frame(spark, v), 5, "id", "e", block_rows=30, n_probe=3).collect()}
    assert len(exact & some) / len(exact) > 0.8


def test_scores_in_blocks(spark):
    v = blobs()
    df, targets = frame(spark, v), frame(spark, v[:50]).withColumnRenamed("id", "t")
    for shares in (False, True):
        a = vj.score_all(df, targets, "id", "e", "t", "e", shares=shares).collect()
        b = vj.score_all(df, targets, "id", "e", "t", "e", block_rows=20, shares=shares).collect()
        key = lambda r: (r.id, r.t, round(r.similarity, 9))
        assert sorted(map(key, a)) == sorted(map(key, b))
        if shares:
            assert sum(r.similarity for r in a) == pytest.approx(len(v))


@pytest.mark.parametrize("block_rows", [4096, 40])
def test_spanning_tree_is_exact(spark, block_rows):
    v = blobs()
    got = mst_edges(frame(spark, v), 4, "id", "e", block_rows).collect()
    assert np.sort([r.weight for r in got]) == pytest.approx(np.sort([w for w, _, _ in mst_brute(v, 4)]))


def same_clusters(a, b):
    pairs = set(zip(a, b))
    return len(pairs) == len(set(a)) == len(set(b)) and all((x == -1) == (y == -1) for x, y in pairs)


@pytest.mark.parametrize("args", [{}, {"merge_edges": 60, "block_rows": 40}])
def test_hdbscan_matches_brute_force(spark, args):
    """With one set of edges and one block of points; with several of both."""
    v = blobs(2)
    rows = sorted(cl.cluster_hdbscan(frame(spark, v), 5, 3, "id", "e", **args).collect())
    assert same_clusters([r.topic for r in rows], hdbscan_brute(v, 5, 3).tolist())
    assert all((r.topic == -1) == (r.prob == 0) and 0 <= r.prob <= 1 for r in rows)
    sizes = np.bincount([r.topic for r in rows if r.topic >= 0])
    assert (np.diff(sizes) <= 0).all()


def test_hdbscan_edges(spark):
    assert [r.topic for r in cl.cluster_hdbscan(frame(spark, [[1.0, 2.0]]), 2, 1, "id", "e").collect()] == [-1]
    with pytest.raises(ValueError):
        cl.cluster(frame(spark, [[1.0]]), "DBSCAN")


def test_bandwidth(spark):
    df = spark.createDataFrame([([0.0, 0.1, 0.3, 0.6, 0.8],)], "gap array<double>")
    assert df.select(rd.bandwidth("gap", float(np.log2(5))).alias("s")).first().s == pytest.approx(0.309318, abs=1e-6)


def test_curve():
    assert rd.curve(0.1) == pytest.approx((1.577, 0.895), abs=1e-3)


def test_pca(spark):
    v = blobs() @ np.diag([3.0, 1.0, 0.5]) + 7
    got = np.array([r.reduced for r in rd.reduce_pca(frame(spark, v), 2, "id", "e").orderBy("id").collect()])
    centred = v - v.mean(0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert np.abs(got) == pytest.approx(np.abs(want))


def test_rescale(spark):
    df = frame(spark, [[1.0, 5.0], [3.0, 7.0]])
    assert [r.e for r in rd.rescale_init(df, "e").orderBy("id").collect()] == [pytest.approx([1e-4, 5e-4]), pytest.approx([3e-4, 7e-4])]


def test_layout(spark):
    """Groups stay apart, neighbours stay near, and positions do not depend on blocks or partitions."""
    rng = np.random.default_rng(3)
    v = np.vstack([rng.normal(size=(50, 10)) + c for c in rng.normal(size=(4, 10)) * 8])
    label = np.repeat(range(4), 50)
    df = frame(spark, v)
    graph = cut_lineage(rd.fuzzy_graph(vj.knn_join(df, 9, "id", "e", "cosine"), 10, "id"))
    init = cut_lineage(rd.reduce_pca(df, 2, "id", "e"))
    runs = []
    for rows, parts in ((256, 2), (30, 7)):
        found = rd.layout(graph.repartition(parts), init.repartition(parts), "id", layout_rows=rows, rounds=6).orderBy("id").collect()
        runs.append(np.array([r.reduced for r in found]))
    assert (runs[0] == runs[1]).all()

    def nearest(x, k):
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, 1)[:, :k]

    assert (label[nearest(runs[0], 5)] == label[:, None]).mean() > 0.99
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    start = np.array([r.reduced for r in init.orderBy("id").collect()])
    kept = [np.mean([len(set(a) & set(b)) for a, b in zip(nearest(unit, 10), nearest(x, 10))]) for x in (start, runs[0])]
    assert kept[1] > 4 and kept[1] > 1.3 * kept[0]


def test_pyramid_pushes_like_all_pairs(spark):
    rng = np.random.default_rng(8)
    pos = np.vstack([rng.normal(size=(150, 2)) + c for c in ([0, 0], [6, 1], [3, 8])])
    rows = spark.createDataFrame([(i * 7919, [float(x) for x in p]) for i, p in enumerate(pos)], "h long, pos array<double>").repartition(5)
    pyramid = rd.Pyramid(pos.min(0), pos.max(0)).fill(rows, 2, 1)
    got, row, place, part = pyramid.around(pos, 1.9, 0.8)
    np.add.at(got, row, rd.repel(pos[row] - place, 1.9, 0.8) * part[:, None])
    want = rd.repel(pos[:, None] - pos[None], 1.9, 0.8).mean(1)
    assert pyramid.n.sum() == len(pos)
    assert np.corrcoef(got.ravel(), want.ravel())[0, 1] > 0.97


def test_layout_of_odd_rows(spark):
    """Copies at one place, a point without neighbours, one point, none."""
    init = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 2.0])], "id long, reduced array<double>")
    graph = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "a long, b long, weight double")
    got = rd.layout(graph, init, "id", rounds=2, epochs=3).collect()
    assert sorted(r.id for r in got) == [1, 2, 3] and all(np.isfinite(r.reduced).all() for r in got)
    assert rd.layout(graph, init.where("id = 3"), "id", rounds=1).count() == 1
    assert rd.layout(graph, init.limit(0), "id").count() == 0


def test_graph_is_symmetric(spark):
    graph = rd.fuzzy_graph(vj.knn_join(frame(spark, blobs()), 9, "id", "e"), 10, "id").collect()
    weights = {(r.a, r.b): r.weight for r in graph}
    assert len(weights) == len(graph)
    assert all(weights[b, a] == w and 0 <= w <= 1 for (a, b), w in weights.items())


def test_static_encoder(spark):
    df = spark.createDataFrame([("a", "løn ferie"), ("b", "ferie  LØN"), ("c", ""), ("d", "-")], "seg_key string, text string")
    got = {r.seg_key: r.embedding for r in en.embed_static(df.repartition(3), dims=40).collect()}
    assert got["a"] == got["b"] and np.linalg.norm(got["a"]) == pytest.approx(1)
    assert got["c"] == got["d"] == [0.0] * 40
    with pytest.raises(ValueError):
        en.embed_static(df, dims=500)


def test_token_table(spark):
    df = spark.createDataFrame([("a", "løn løn ferie x"), ("b", "intet kendt")], "seg_key string, text string")
    vectors = spark.createDataFrame([("løn", [1.0, 0.0]), ("ferie", [0.0, 3.0])], "token string, vector array<double>")
    got = {r.seg_key: r.embedding for r in en.embed_token_table(df, vectors, dims=2).collect()}
    assert got == {"a": pytest.approx([2 / 3, 1.0]), "b": [0.0, 0.0]}


def test_rank_weights(spark):
    df = spark.createDataFrame([("aa bb",), ("aa aa",)], "text string")
    assert {r.token: r.weight for r in en.rank_weights(df).collect()} == {"aa": 0.0, "bb": pytest.approx(np.log(2))}
    assert {r.token: r.weight for r in en.rank_weights(df, scheme="zipf").collect()} == {"aa": pytest.approx(np.log(2)), "bb": pytest.approx(np.log(3))}


def test_hierarchy_in_rounds_equals_one_at_a_time(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(9, 4))
    c = frame(spark, v).select(F.col("id").cast("int").alias("topic"), F.col("e").alias("centroid"))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    d, size, want = 1 - unit @ unit.T, np.ones(9), []
    np.fill_diagonal(d, np.inf)
    for step in range(1, 9):
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        want.append((step, i, j, round(float(d[i, j]), 9), int(size[i] + size[j])))
        both = (size[i] + size) * d[i] ** 2 + (size[j] + size) * d[j] ** 2 - size * d[i, j] ** 2
        row = np.sqrt(both / (size[i] + size[j] + size))
        d[i], d[:, i], size[i] = row, row, size[i] + size[j]
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
    got = tp.topic_hierarchy(c).collect()
    assert sorted((r.step, r.topic_a, r.topic_b, round(r.distance, 9), r.size) for r in got) == want


def test_clusters_do_not_depend_on_blocks(spark):
    """Grid points with ties and copies: the same labels for any block size and partitioning."""
    rng = np.random.default_rng(11)
    df = frame(spark, rng.integers(0, 5, size=(60, 2)).astype(float))
    runs = [
        sorted((r.id, r.topic, round(r.prob, 9)) for r in cl.cluster_hdbscan(df.repartition(p), 4, 2, "id", "e", block_rows=b).collect())
        for p, b in ((1, 4096), (5, 20))
    ]
    assert runs[0] == runs[1]


def tree_of(draw, n, shape):
    """(head, above, stability) of a binary tree of ``n`` clusters under a root -1."""
    rows, ends, number = [], [-1], 0
    while number < n:
        above = ends.pop(-1 if shape == "chain" else draw.integers(len(ends)))
        for _ in range(2):
            rows.append((number, above, float(draw.integers(1, 40))))
            ends.append(number)
            number += 1
    return rows


def selected(rows):
    """The highest kept cluster at or above each one, bottom up and top down."""
    kids, below, label = {}, {}, {}
    for head, above, _ in rows:
        kids.setdefault(above, []).append(head)
    value = {}
    for head, _, stability in reversed(rows):
        below[head] = sum(value[k] for k in kids.get(head, []))
        value[head] = max(stability, below[head])
    for head, above, stability in rows:
        label[head] = label.get(above, None) if label.get(above, None) is not None else (head if stability >= below[head] else None)
    return {h: x for h, x in label.items() if x is not None}


@pytest.mark.parametrize("n,shape", [(2, "chain"), (40, "bush"), (300, "bush"), (301, "chain")])
def test_excess_of_mass_equals_brute_force(spark, n, shape):
    rows = tree_of(np.random.default_rng(n), n, shape)
    stable = spark.createDataFrame(rows, "head long, above long, stability double").repartition(4)
    assert {r.head: r.label for r in cl.excess_of_mass(stable).collect()} == selected(rows)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark):
    rows, steps = tree_of(np.random.default_rng(1), 20_000, "chain"), []  # 10,000 levels
    stable = spark.createDataFrame(rows, "head long, above long, stability double")
    assert {r.head: r.label for r in cl.excess_of_mass(stable, steps).collect()} == selected(rows)
    assert steps[0] <= 2 * 16


def test_clusters_do_not_depend_on_the_parts_of_the_tree(spark):
    rng = np.random.default_rng(12)
    df = frame(spark, np.vstack([rng.normal(size=(25, 2)) + c for c in ([0, 0], [9, 0], [0, 9])]))
    runs = [
        sorted((r.id, r.topic, round(r.prob, 9)) for r in cl.cluster_hdbscan(df, 5, 3, "id", "e", merge_edges=m).collect())
        for m in (50_000, 20)
    ]
    assert runs[0] == runs[1] and len({t for _, t, _ in runs[0]}) >= 3


def test_vectors_that_must_see_most_cells_meet_large_blocks(spark, monkeypatch):
    """In 16 dimensions without structure no cell can be skipped; a vector may then not be sent to every small block."""
    v = np.random.default_rng(5).normal(size=(900, 16))
    v[40:50] = v[40]
    monkeypatch.setattr(vj, "WIDE_ROWS", 150)
    monkeypatch.setattr(vj, "VISIT_BYTES", 700)
    sent = []
    real = vj.visit_blocks
    monkeypatch.setattr(vj, "visit_blocks", lambda cells, asked, *rest: sent.append(asked.count()) or real(cells, asked, *rest))
    rows = cut_lineage(vj.knn_join(frame(spark, v), 4, "id", "e", block_rows=30)).collect()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    assert max(sent) < 4 * len(v)
    assert len(rows) == 4 * len(v)
    for r in rows:
        want = [j for j in np.lexsort((np.arange(len(v)), np.round(d[r.id], 9))) if j != r.id][:4]
        assert r.neighbor == want[r["rank"] - 1]
    between = vj.knn_between(frame(spark, v[:300] + 0.1).toDF("key", "vec"), frame(spark, v).toDF("key", "vec"), 3, 30).collect()
    d = np.sqrt(((v[:300, None] + 0.1 - v[None]) ** 2).sum(2))
    assert len(between) == 900
    assert all(r.neighbor == np.lexsort((np.arange(len(v)), np.round(d[r.key], 9)))[r["rank"] - 1] for r in between)


def test_tree_of_vectors_that_must_see_most_cells(spark, monkeypatch):
    from topicloom.operators import spanning

    v = np.random.default_rng(6).normal(size=(400, 16))
    monkeypatch.setattr(vj, "VISIT_BYTES", 700)
    monkeypatch.setattr(spanning, "WIDE_ROWS", 90)
    met = []
    real = vj.meet_all
    monkeypatch.setattr(spanning, "meet_all", lambda *args: met.append(1) or real(*args))
    got = mst_edges(frame(spark, v), 4, "id", "e", block_rows=30).collect()
    assert met
    assert len(got) == 399
    assert sum(r.weight for r in got) == pytest.approx(sum(e[0] for e in mst_brute(v, 4)))


def test_large_components_of_the_tree_do_not_search(spark, monkeypatch):
    """A dense group grows to one component early; the groups around it come to it."""
    from topicloom.operators import spanning

    rng = np.random.default_rng(8)
    around = [rng.normal(size=3) * 3 + rng.normal(size=(6, 3)) * 0.1 for _ in range(10)]
    v = np.vstack([rng.normal(size=(120, 3)) * 0.3, *around])
    asked = []
    real = spanning._search

    def spy(cells, state, queries, block_rows):
        sizes = {r.comp: r["count"] for r in state.groupBy("comp").count().collect()}
        comps = {r.comp for r in queries.select("comp").distinct().collect()}
        asked.append(max((sizes[c] for c in comps), default=0) * len(sizes) / len(v))
        return real(cells, state, queries, block_rows)

    monkeypatch.setattr(spanning, "_search", spy)
    got = mst_edges(frame(spark, v), 4, "id", "e", block_rows=40).collect()
    assert sorted(r.weight for r in got) == pytest.approx(sorted(e[0] for e in mst_brute(v, 4)))
    assert asked and max(asked) <= 4


def test_documents_are_encoded_once_for_clusters(spark, tmp_path, monkeypatch):
    from topicloom.plans import catalog

    texts = [(i, f"{['red apple', 'blue stone', 'green leaf'][i % 3]} number{i} word{i % 7}", "src1") for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    given = []

    def spy(df, *args):
        given.append(df)
        raise InterruptedError

    monkeypatch.setattr(rd, "reduce_pca", spy)
    with pytest.raises(InterruptedError):
        catalog.cluster_hdbscan(spark, str(tmp_path))
    assert given[0].count() == 60
    # the vectors are read, not made from the texts in every pass
    assert "Generate" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
