import numpy as np
import pytest

from brute import hdbscan_brute
from topicloom.operators import predict as pdn
from topicloom.operators import vectorjoin as vj
from topicloom.sources.posts import load_model, save_model


def frame(spark, v, first=0, name="id"):
    return spark.createDataFrame([(int(i) + first, [float(x) for x in r]) for i, r in enumerate(v)], f"{name} long, e array<double>")


def groups(seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 3)) * 4
    v = np.vstack([rng.normal(size=(40, 3)) * (0.3 + 0.2 * i) + c for i, c in enumerate(centres)] + [rng.uniform(-8, 8, size=(20, 3))])
    v[100:115] = v[100]
    return v


def by_hand(points, clusters, queries, min_samples):
    """Topic and strength of each query, one level of the tree at a time."""
    v, out = np.array([p.vec for p in points]), []
    tree = {c.head: c for c in clusters}
    for q in queries:
        d = np.sqrt(((v - q) ** 2).sum(1))
        near = np.lexsort(([p.key for p in points], d))[: 2 * min_samples]
        if d[near[0]] == 0:
            out.append((points[near[0]].topic, points[near[0]].prob))
            continue
        own = d[near[:min_samples]].max()
        reach, _, _, i = min((max(d[i], own, points[i].core), d[i], points[i].key, i) for i in near)
        lam, head = 1 / reach, points[i].head
        while head in tree and tree[head].birth > lam:
            head = tree[head].above
        topic = tree[head].topic if head in tree else -1
        out.append((topic, min(1.0, lam / tree[head].peak) if topic >= 0 else 0.0))
    return out


def test_prediction(spark, tmp_path):
    """The stored tree has the labels of the clustering; points keep theirs; new rows are as by hand."""
    v, rng = groups(), np.random.default_rng(7)
    new = np.vstack([v[rng.integers(0, len(v), 40)] + rng.normal(size=(40, 3)) * s for s in (0.1, 0.6, 3)] + [[[90.0, 0, 0]]])
    model = pdn.fit_density(frame(spark, v), 5, 3, "id", "e", block_rows=60)
    save_model(model, str(tmp_path / "m"))
    model = load_model(spark, str(tmp_path / "m"), pdn.TABLES)
    points = sorted(model["points"].collect())
    pairs = set(zip([p.topic for p in points], hdbscan_brute(v, 5, 3).tolist()))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 3 and (-1, -1) in pairs

    again = sorted(pdn.predict_density(model, frame(spark, v, 5000), "id", "e", block_rows=50).collect())
    assert [(r.topic, r.prob) for r in again] == [(p.topic, p.prob) for p in points]

    got = sorted(pdn.predict_density(model, frame(spark, new).repartition(3), "id", "e", block_rows=50).collect())
    want = by_hand(points, model["clusters"].collect(), new, 3)
    assert [r.topic for r in got] == [t for t, _ in want]
    assert [r.prob for r in got] == pytest.approx([p for _, p in want])
    assert len({t for t, _ in want}) > 3


def test_prediction_of_odd_rows(spark):
    model = pdn.fit_density(frame(spark, groups()[:60]), 5, 3, "id", "e")
    odd = spark.createDataFrame([(1, None), (2, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])], "id long, e array<double>")
    got = sorted(pdn.predict_density(model, odd, "id", "e").collect())
    assert (got[0].topic, got[0].prob) == (-1, 0.0) and {r.id for r in got} == {1, 2}
    assert pdn.predict_density(model, odd.limit(0), "id", "e").count() == 0
    empty = {"points": model["points"].limit(0), "clusters": model["clusters"].limit(0), "settings": model["settings"]}
    assert {(r.topic, r.prob) for r in pdn.predict_density(empty, odd, "id", "e").collect()} == {(-1, 0.0)}
    with pytest.raises(ValueError):
        pdn.fit_density(odd, 1, 1, "id", "e")


def test_a_long_chain_takes_few_rounds(spark):
    """5,000 clusters, each inside the one before."""
    clusters = spark.range(5000).selectExpr("id AS head", "if(id = 0, 99999, id - 1) AS above", "id + 0.5D AS birth")
    rows = spark.range(6000).selectExpr("id AS key", "4999L - id % 7 AS head", "double(id) AS lam")
    steps = []
    got = {r.key: r.head for r in pdn.cluster_at(clusters, rows, steps).collect()}
    assert got == {k: (99999 if k == 0 else min(k - 1, 4999 - k % 7)) for k in range(6000)}
    assert steps[0] <= 13


@pytest.mark.parametrize("block_rows", [2000, 30])
def test_neighbours_in_another_table(spark, block_rows):
    points, rng = groups(), np.random.default_rng(1)
    queries = np.vstack([points[:30], rng.normal(size=(50, 3)) * 4, np.zeros((9, 3))])
    got = vj.knn_between(frame(spark, queries, 50).selectExpr("id AS key", "e AS vec"), frame(spark, points).selectExpr("id AS key", "e AS vec"), 6, block_rows).collect()
    near = {(r.key - 50, r["rank"]): (r.neighbor, round(r.distance, 9)) for r in got}
    d = np.sqrt(((queries[:, None] - points[None]) ** 2).sum(2))
    assert len(got) == len(near) == 6 * len(queries)
    for i in range(len(queries)):
        want = np.lexsort((np.arange(len(points)), d[i]))[:6]
        assert [near[i, k + 1] for k in range(6)] == [(j, round(d[i, j], 9)) for j in want.tolist()]


def test_neighbours_are_searched_once(spark, monkeypatch):
    """The tree and the core distances share them."""
    from topicloom.operators import spanning

    searched = []
    real = vj.knn_join
    for module in (pdn, spanning):
        monkeypatch.setattr(module, "knn_join", lambda *args: searched.append(1) or real(*args))
    model = pdn.fit_density(frame(spark, groups()), 5, 3, "id", "e")
    assert model["points"].count() == 180 and len(searched) == 1
