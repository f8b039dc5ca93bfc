"""Models against brute force, closed forms and planted structure."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.errors import ModelError
from flowlens.evaluation import metrics, validation
from flowlens.ml import anomaly, classify, clustering, dbscan, exact_tree, iforest, knn, lof, neighbors, storage
from flowlens.operators.preparation import pca


def frame(spark, matrix, keys=None, names="xyzuvw"):
    keys = range(len(matrix)) if keys is None else keys
    rows = [(int(k), *map(float, r)) for k, r in zip(keys, matrix)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names[: len(matrix[0])]))


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows are copies of one vector; coordinates are whole, so ties abound."""
    random = np.random.RandomState(1)
    return np.vstack([random.randint(0, 40, (800, 2)), np.full((400, 2), 7)]).astype(float)


def brute_neighbors(matrix, k, exclude_self):
    keys = np.arange(len(matrix))
    out = {}
    for i, row in enumerate(matrix):
        distance = np.sqrt(((matrix - row) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((keys, distance)) if not (exclude_self and j == i)][:k]
        out[i] = [(int(j), float(distance[j])) for j in order]
    return out


@pytest.mark.parametrize("chunk_rows,exclude_self", [(4096, True), (60, True), (60, False)])
def test_neighbors_are_exact(spark, skewed, monkeypatch, chunk_rows, exclude_self):
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 100)
    df = frame(spark, skewed)
    got = {}
    joined = neighbors.knn_join(df, df, ["x", "y"], 5, "id", exclude_self, chunk_rows)
    for r in joined.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbor"], r["distance"]))
    assert got == brute_neighbors(skewed, 5, exclude_self)


@pytest.mark.parametrize("metric", ["manhattan", "chebyshev", "cosine"])
@pytest.mark.parametrize("dims,chunk_rows", [(2, 40), (20, 4096), (20, 60)])
def test_neighbors_by_other_metrics(spark, monkeypatch, metric, dims, chunk_rows):
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 100)
    random = np.random.RandomState(9)
    matrix = np.vstack([random.randint(1, 9, (200, dims)), np.full((60, dims), 4)]).astype(float)
    gaps = matrix[:, None] - matrix[None]
    size = np.sqrt((matrix**2).sum(axis=1))
    want = {"manhattan": np.abs(gaps).sum(-1), "chebyshev": np.abs(gaps).max(-1), "cosine": 1 - matrix @ matrix.T / np.outer(size, size)}[metric]
    rows = [(i, r.tolist()) for i, r in enumerate(matrix)] + ([(900, [0.0] * dims)] if metric == "cosine" else [])
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    found = neighbors.knn_join(df, df, "vec", 6, "id", True, chunk_rows, metric).orderBy("id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r["id"], []).append((r["neighbor"], r["distance"]))
    assert set(got) == set(range(len(matrix)))
    for i, near in got.items():
        others = np.delete(np.arange(len(matrix)), i)
        best = others[np.lexsort((others, want[i, others]))][:6]
        assert np.allclose([d for _, d in near], want[i, best], atol=1e-12)
        assert np.allclose([d for _, d in near], want[i, [j for j, _ in near]], atol=1e-12)
        if metric != "cosine":  # whole numbers: ties are exact
            assert [j for j, _ in near] == best.tolist()


def test_unknown_metric(spark, planted):
    with pytest.raises(ModelError):
        neighbors.knn_join(planted, planted, ["x"], 2, "id", metric="other")


def test_copies_are_searched_once(spark, skewed):
    distinct = neighbors.distinct_points(neighbors.points(frame(spark, skewed), ["x", "y"], "id"), 6)
    rows = distinct.collect()
    assert len(rows) == len(np.unique(skewed, axis=0))
    assert max(len(r["keys"]) for r in rows) == 6 and sum(r["weight"] for r in rows) == len(skewed)


def test_knn_weights(spark):
    train = spark.createDataFrame([(0, 0.0, "a"), (1, 3.0, "b"), (2, 4.0, "b")], "id long, x double, label string")
    query = spark.createDataFrame([(10, 1.0), (11, 0.0)], "id long, x double")
    by_count = knn.KNNModel(train, ["x"], "label", "id", 3).predict(query, "a").orderBy("id").collect()
    assert [r["prediction"] for r in by_count] == ["b", "b"]
    assert by_count[0]["probability"] == pytest.approx(1 / 3)
    by_distance = knn.KNNModel(train, ["x"], "label", "id", 3, "distance").predict(query, "a").orderBy("id").collect()
    assert [r["prediction"] for r in by_distance] == ["a", "a"]
    assert by_distance[0]["probability"] == pytest.approx(1 / (1 + 1 / 2 + 1 / 3))
    assert by_distance[1]["probability"] == 1.0


def brute_dbscan(matrix, keys, eps, least):
    near = np.sqrt(((matrix[:, None] - matrix[None]) ** 2).sum(-1)) <= eps
    core, label, number = near.sum(axis=1) >= least, np.full(len(matrix), -1), 0
    for start in np.argsort(keys):
        if label[start] != -1 or not core[start]:
            continue
        label[start], pending = number, [start]
        while pending:
            at = pending.pop()
            for other in np.flatnonzero(near[at]) if core[at] else ():
                if label[other] == -1:
                    label[other] = number
                    pending.append(other)
        number += 1
    return {int(k): int(x) for k, x in zip(keys, label)}


@pytest.mark.parametrize("eps,least,chunk_rows", [(0.4, 5, 4096), (0.4, 5, 60), (0.9, 8, 60)])
def test_dbscan_matches_sequential(spark, eps, least, chunk_rows):
    random = np.random.RandomState(2)
    matrix = np.vstack([random.randn(150, 2), random.randn(150, 2) * 0.7 + [6, 0], random.uniform(-10, 16, (150, 2)), np.full((200, 2), 3.0)])
    keys = random.permutation(len(matrix))
    got = dbscan.dbscan(frame(spark, matrix, keys), ["x", "y"], "id", eps, least, scale=False, chunk_rows=chunk_rows)
    assert dict(map(tuple, got.collect())) == brute_dbscan(matrix, keys, eps, least)


def test_dbscan_without_clusters(spark):
    got = dbscan.dbscan(frame(spark, [[0.0, 0.0], [50.0, 1.0], [9.0, 90.0]]), ["x", "y"], "id", 0.1, 2)
    assert {r["cluster"] for r in got.collect()} == {-1}


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a % 50 <> 49")
    roots = dict(map(tuple, dbscan.connected_components(chain).collect()))
    assert len(roots) == 200
    assert all(root == node // 50 * 50 for node, root in roots.items())


@pytest.fixture(scope="module")
def planted(spark):
    """400 ordinary rows, five far away."""
    random = np.random.RandomState(5)
    far = np.array([[12, 12, 0], [-14, 9, 1], [0, -15, 10], [13, 0, -12], [-11, -11, -11]])
    return frame(spark, np.vstack([random.randn(400, 3), far])).persist()


@pytest.mark.parametrize("key,params", [("isolation_forest", {}), ("local_outlier_factor", {"k": 20}), ("one_class_svm", {"nu": 0.1})])
def test_detectors_rank_planted_rows_first(spark, planted, tmp_path, key, params):
    found, model = anomaly.detect_anomalies(planted, ["x", "y", "z"], "id", model_key=key, **params)
    rows = found.orderBy(F.desc("anomaly_score")).collect()
    assert {r["id"] for r in rows[:5]} == {400, 401, 402, 403, 404}
    assert sum(r["is_anomaly"] for r in rows) in (40, 41)
    assert (rows[0]["anomaly_score"], rows[-1]["anomaly_score"]) == (1.0, 0.0)
    storage.save_model(model, str(tmp_path), key)
    loaded = storage.load_model(spark, str(tmp_path), key)
    again = anomaly.apply_anomaly_detector(loaded, planted)
    same = again.join(found.select("id", F.col("anomaly_score").alias("s"), F.col("is_anomaly").alias("a")), "id")
    assert same.filter((F.abs(F.col("s") - F.col("anomaly_score")) > 1e-9) | (F.col("a") != F.col("is_anomaly"))).count() == 0


def test_equal_scores_give_zero(spark):
    df = frame(spark, [[1.0]] * 5)
    found, _ = anomaly.detect_anomalies(df, ["x"], "id", trees=5)
    assert {r["anomaly_score"] for r in found.collect()} == {0.0}


def test_lof_formula(spark):
    random = np.random.RandomState(4)
    matrix = random.randn(80, 2)
    k = 6
    near = brute_neighbors(matrix, k, True)
    reach_to = {i: near[i][-1][1] for i in near}
    density = {i: 1 / (np.mean([max(d, reach_to[j]) for j, d in near[i]]) + 1e-10) for i in near}
    want = {i: -np.mean([density[j] for j, _ in near[i]]) / density[i] for i in near}
    model = lof.fit_lof(frame(spark, matrix), ["x", "y"], "id", k, chunk_rows=30)
    got = dict(map(tuple, model.training_scores.collect()))
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert model.threshold == pytest.approx(np.quantile(list(want.values()), 0.1))


def test_attribution_adds_up(planted):
    model = iforest.fit_isolation_forest(planted, ["x", "y", "z"], "id", trees=30)
    parts = iforest.anomaly_attribution(model, planted, permutations=4)
    assert parts.count() == 405 * 3
    sums = {r["id"]: r["s"] for r in parts.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    raw = {r["id"]: r["raw"] for r in model.score(planted).collect()}
    # Every row is compared with the same background rows, so the difference is constant.
    gaps = [raw[i] - sums[i] for i in raw]
    assert max(gaps) - min(gaps) < 1e-9
    assert iforest.attribution_summary(parts).count() == 3


def test_forest_does_not_depend_on_partitions(planted):
    one = iforest.fit_isolation_forest(planted, ["x", "y", "z"], "id", trees=10)
    two = iforest.fit_isolation_forest(planted.repartition(11), ["x", "y", "z"], "id", trees=10)
    assert sorted(one.nodes) == sorted(two.nodes)
    assert iforest.path_adjustment(2) == 1.0 and iforest.path_adjustment(1) == 0.0


@pytest.fixture(scope="module")
def rings(spark):
    """Positive inside a circle, negative around it: not separable by a line."""
    random = np.random.RandomState(6)
    angle, radius = random.uniform(0, 2 * np.pi, 300), np.where(np.arange(300) % 2, 1.0, 4.0) + random.randn(300) * 0.3
    df = frame(spark, np.column_stack([radius * np.cos(angle), radius * np.sin(angle)]))
    return df.withColumn("risk", F.when(F.col("id") % 2 == 1, "positive").otherwise("negative")).persist()


@pytest.mark.parametrize(
    "key,params",
    [("decision_tree", {"max_depth": 6}), ("random_forest", {"n_estimators": 10}), ("gradient_boosting", {"n_estimators": 10}), ("svm", {}), ("knn", {"n_neighbors": 3})],
)
def test_classifiers_learn_rings_and_reload(spark, rings, tmp_path, key, params):
    model = classify.train(rings, key, ["x", "y"], key="id", scale=True, **params)
    predicted = classify.predict(model, rings)
    assert predicted.filter("prediction = risk").count() >= 285
    first = predicted.first()
    assert first["prediction"] == "positive" and 0.5 < first["probability"] <= 1.0
    storage.save_model(model, str(tmp_path), key)
    again = storage.load_model(spark, str(tmp_path), key).predict(rings)
    columns = ["id", "prediction", F.round("probability", 9)]
    assert again.select(*columns).exceptAll(predicted.select(*columns)).count() == 0


@pytest.mark.parametrize(
    "key,params",
    [
        ("decision_tree", {"max_depth": 5}), ("decision_tree", {"exact": True}), ("random_forest", {"n_estimators": 3}),
        ("gradient_boosting", {"n_estimators": 3}), ("logistic_regression", {}), ("svm", {}), ("svm", {"kernel": "linear"}),
    ],
)
@pytest.mark.parametrize("only", ["negative", "positive"])
def test_training_rows_of_one_label(spark, tmp_path, key, params, only):
    """Many flows bring every address's share of denies close to the mean: no row is positive."""
    df = frame(spark, np.random.RandomState(8).randn(20, 2)).withColumn("risk", F.lit(only))
    model = classify.train(df, key, ["x", "y"], key="id", scale=True, **params)
    storage.save_model(model, str(tmp_path), key)
    gaps = df.withColumn("x", F.when(F.col("id") > 0, F.col("x")))
    for fitted in (model, storage.load_model(spark, str(tmp_path), key)):
        rows = classify.predict(fitted, gaps).select("id", "prediction", "probability").collect()
        assert len(rows) == 19 and {r["prediction"] for r in rows} == {only}
        assert all(r["probability"] == 0 for r in rows) if only == "negative" else all(r["probability"] > 0.5 for r in rows)


@pytest.mark.parametrize("positives", [0, 1])
def test_folds_without_a_positive_training_row(spark, positives):
    risk = F.when(F.col("id") < positives, "positive").otherwise("negative")
    df = frame(spark, np.random.RandomState(9).randn(20, 2)).withColumn("risk", risk)
    scores = validation.cross_validate(df, "logistic_regression", ["x", "y"], key="id", k=5, scoring=("accuracy", "roc_auc"), scale=True)
    found = {(r["fold"], r["metric"]): r["score"] for r in scores.collect()}
    assert len(found) == 10
    # Scores that are all equal order nothing; without a positive there is nothing to order.
    assert [found[i, "roc_auc"] for i in range(5)] == ([0.5] if positives else [None]) + [None] * 4
    assert found[0, "accuracy"] == (0.8 if positives else 1.0)


def test_logistic_regression_penalty(spark):
    random = np.random.RandomState(7)
    x = random.randn(200)
    y = x + random.randn(200) > 0
    df = frame(spark, x[:, None]).withColumn("risk", F.when(F.col("id").isin(*[int(i) for i in np.flatnonzero(y)]), "positive").otherwise("negative"))
    model = classify.train(df, "logistic_regression", ["x"], key="id", C=0.5)
    w, b = float(model.model.coefficients[0]), float(model.model.intercept)
    # Stationary point of C * loss + w^2 / 2 with a free intercept.
    p = 1 / (1 + np.exp(-(w * x + b)))
    assert abs(0.5 * np.sum((p - y) * x) + w) < 1e-3 and abs(np.sum(p - y)) < 1e-3
    assert model.feature_importance().first()["importance"] == pytest.approx(abs(w))


def test_tree_rules_and_importance(rings):
    model = classify.train(rings, "decision_tree", ["x", "y"], key="id", max_depth=3)
    assert "x <= " in model.rules() and model.leaf_count() >= 2
    assert sum(r["importance"] for r in model.feature_importance().collect()) == pytest.approx(1.0)
    with pytest.raises(ModelError):
        classify.train(rings, "knn", ["x", "y"], key="id").feature_importance()
    with pytest.raises(ModelError):
        classify.train(rings, "nope", ["x"], key="id")


def test_folds_are_balanced(rings):
    folds = validation.stratified_folds(rings, "id", "risk", 5)
    sizes = [r["count"] for r in folds.groupBy("risk", "fold").count().collect()]
    assert len(sizes) == 10 and set(sizes) == {30}


def test_cross_validation_and_comparison(rings):
    scores = validation.cross_validate(rings, "decision_tree", ["x", "y"], key="id", k=3, scoring=validation.SCORERS)
    assert scores.count() == 15
    summary = {r["metric"]: r["mean"] for r in validation.cross_validation_summary(scores).collect()}
    assert summary["accuracy"] > 0.85 and summary["roc_auc"] > 0.85
    table = validation.compare_models(rings, ["logistic_regression", "decision_tree"], ["x", "y"], key="id", k=2)
    assert [r["model"] for r in table.collect()] == ["decision_tree", "logistic_regression"]
    whole = validation.evaluate_model(rings, "decision_tree", ["x", "y"], key="id", k=2)
    assert whole["resubstitution"].first()["accuracy"] > 0.95 and whole["confusion_matrix"].count() == 4


def brute_gaps(left, right, metric):
    return np.array([neighbors._length(right - row, metric) for row in left])


BY_STEPS = ["manhattan", "chebyshev"]


@pytest.mark.parametrize("metric", BY_STEPS)
@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e5, 1.0), (0.0, 1e-25), (3.0, 1e-7), (0.0, 1e25), (1e9, 1e-6)])
@pytest.mark.parametrize("shape", ["spread", "whole", "tails", "uneven"])
def test_steps_in_bytes_lose_no_neighbour(monkeypatch, metric, shift, scale, shape):
    """Bounds in whole steps keep every pair within the limit, one way and both ways, on odd coordinates too."""
    for name, value in {"SLICE": 48, "BLOCK": 40, "BYTE_ROWS": 16}.items():
        monkeypatch.setattr(neighbors, name, value)
    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 23))
    x = {"spread": x, "whole": np.rint(x), "tails": x**7, "uneven": x * np.r_[1e4, np.ones(21), 0.0]}[shape] * scale + shift
    x[270:] = x[:30]
    queries, gaps = x[:130], brute_gaps(x[:130], x, metric)
    radius = np.where(np.arange(130) % 3 == 0, np.inf, np.median(gaps))
    kept = {(int(start + i), int(j)) for start, own, refs, _ in neighbors._near_by_levels(queries, x, metric, radius, 6) for i, j in zip(own, refs)}
    for i, row in enumerate(gaps):
        assert all((i, int(j)) in kept for j in np.argsort(row, kind="stable")[:6] if row[j] <= radius[i])
    for share in (0.02, 0.5):
        # A distance that occurs, so that a pair lies on the limit.
        most = np.sort(gaps, axis=1)[:, int(share * 300)]
        near = np.resize(most, 300)[::-1].copy()
        own, refs = neighbors._near_both_by_levels(queries, x, most, near, metric)
        want = zip(*np.nonzero(gaps <= np.maximum(most[:, None], near)))
        assert sorted(zip(own.tolist(), refs.tolist())) == sorted((int(i), int(j)) for i, j in want)


@pytest.mark.parametrize("metric", BY_STEPS)
def test_steps_in_bytes_leave_few_pairs(metric):
    x = np.random.default_rng(22).normal(size=(3000, 64))
    near = neighbors._near_by_levels(x[:200], x, metric, np.full(200, np.inf), 6)
    assert sum(summed for *_, summed in near) < 0.1 * 200 * 3000


@pytest.mark.parametrize("value", [1e3, 1e12, 1e300])
@pytest.mark.parametrize("metric", BY_STEPS)
def test_steps_beside_a_far_vector(metric, value):
    x = np.random.default_rng(23).normal(size=(200, 20))
    x[7, 3] = value
    near = list(neighbors._near_by_levels(x, x, metric, np.full(200, np.inf), 4))
    kept = {(int(start + i), int(j)) for start, own, refs, _ in near for i, j in zip(own, refs)}
    for i, row in enumerate(brute_gaps(x, x, metric)):
        assert all((i, int(j)) in kept for j in np.argsort(row, kind="stable")[:4])


@pytest.mark.parametrize("metric", BY_STEPS)
def test_two_chunks_meet_once_by_other_metrics(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 100)
    pairs = spark.sparkContext.accumulator(0)
    compare = neighbors._both_kernel

    def counted(keep, by):
        kernel = compare(keep, by)

        def run(left, right):
            pairs.add(len(left) * len(right))
            return kernel(left, right)

        return run

    monkeypatch.setattr(neighbors, "_both_kernel", counted)
    x = np.random.default_rng(24).normal(size=(500, 32))
    x[440:470], x[470:] = x[:30], x[:30] * (1 + 1e-9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    found = neighbors.knn_join(df, df, "vec", 5, "id", True, 40, metric).collect()
    assert 0 < pairs.value < 470 * 470 / 2
    gaps = brute_gaps(x, x, metric)
    np.fill_diagonal(gaps, np.inf)
    want = {(i, n + 1): (int(j), row[j]) for i, row in enumerate(gaps) for n, j in enumerate(np.argsort(row, kind="stable")[:5])}
    assert {(r.id, r["rank"]): (r.neighbor, r.distance) for r in found} == want


def test_models_are_compared_side_by_side(spark, rings, monkeypatch):
    """Folds are dealt out once, fits overlap, one report counts all; scores are those of each model's own cross-validation."""
    calls, together, lock = [], threading.Barrier(2, timeout=60), threading.Lock()
    train, folds, report = validation.train, validation.stratified_folds, validation.classification_report

    def waiting(*args, **params):
        together.wait()
        return train(*args, **params)

    def counted(name, run):
        def call(*args):
            with lock:
                calls.append(name)
            return run(*args)

        return call

    names = ["decision_tree", "knn"]
    want = {}
    for name in names:
        for r in validation.cross_validate(rings, name, ["x", "y"], key="id", k=2, scoring=("accuracy", "precision", "recall", "f1")).collect():
            want.setdefault((name, r["metric"]), []).append(r["score"])
    monkeypatch.setattr(validation, "train", waiting)
    monkeypatch.setattr(validation, "stratified_folds", counted("folds", folds))
    monkeypatch.setattr(validation, "classification_report", counted("report", report))
    got = {r["model"]: r for r in validation.compare_models(rings, iter(names), ["x", "y"], key="id", k=2).collect()}
    assert sorted(calls) == ["folds", "report"]
    for (name, metric), scores in want.items():
        assert got[name][metric] == pytest.approx(np.mean(scores))
    for name in names:
        assert got[name]["accuracy_std"] == pytest.approx(np.std(want[name, "accuracy"]))


def test_report_of_each_group(spark):
    rows = [(1, "a", "a"), (1, "a", "b"), (1, None, "b"), (2, "b", "b"), (2, "a", None)]
    df = spark.createDataFrame(rows, "run int, y_true string, y_pred string")
    got = metrics.classification_report(df, "y_true", "y_pred", "run")
    for run in (1, 2):
        alone = metrics.classification_report(df.filter(F.col("run") == run))
        assert sorted(map(str, got.filter(F.col("run") == run).drop("run").collect())) == sorted(map(str, alone.collect()))


def test_kmeans_elbow_and_pca(spark, tmp_path):
    random = np.random.RandomState(8)
    centers = np.array([[0, 0], [50, 0], [100, 900]])
    matrix = np.vstack([random.randn(60, 2) + c for c in centers])
    df = frame(spark, matrix)
    found, model = clustering.cluster(df, ["x", "y"], "id", n_clusters=3)
    assert sorted(r["count"] for r in found.groupBy("cluster").count().collect()) == [60, 60, 60]
    got = np.array(sorted(model.centers()))
    assert np.abs(got - np.array(sorted(centers.tolist()))).max() < 1
    storage.save_model(model, str(tmp_path), "k3", spark)
    again = storage.load_model(spark, str(tmp_path), "k3").predict(df)
    assert again.select("id", "cluster").exceptAll(found.select("id", "cluster")).count() == 0
    inertia = [r["inertia"] for r in clustering.elbow(df, ["x", "y"], (1, 4)).collect()]
    assert inertia[0] == pytest.approx(((matrix - matrix.mean(axis=0)) ** 2).sum())
    assert inertia[0] > inertia[1] > inertia[2]
    projected, shares = pca(df, ["x", "y"], 2)
    assert sum(shares) == pytest.approx(1.0) and projected.columns[:2] == ["Dim1", "Dim2"]
    with pytest.raises(ModelError):
        clustering.apply_clusterer(None, df)


def test_a_task_sends_a_forest_not_its_pairs():
    import pandas as pd

    from flowlens.ml.dbscan import _edge_kernel

    rng = np.random.default_rng(8)
    for spread, groups in ((0.05, 400), (2.0, 400), (1.0, 40)):
        vec = rng.normal(scale=spread, size=(400, 3))
        frame = pd.DataFrame({"rep": range(400), "vec": list(vec), "group": rng.permutation(400) % groups})
        left, right = frame.iloc[:250], frame.iloc[150:]
        edges = _edge_kernel(0.4)(left, right)
        assert len(edges) < len(set(left["group"]) | set(right["group"]))
        near = np.linalg.norm(vec[:250, None] - vec[None, 150:], axis=2) <= 0.4
        pairs = {(left["group"].iloc[i], right["group"].iloc[j]) for i, j in zip(*np.nonzero(near))}

        def parts(links):
            parent = {g: g for g in frame["group"]}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in links:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
            return {g: find(g) for g in parent}

        assert parts(pairs) == parts(edges.itertuples(index=False))
    assert len(_edge_kernel(1.0)(frame.head(0), frame)) == 0


def plain_neighbors(vectors, k):
    gaps = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2))
    return {(i, r + 1): (int(j), gaps[i, j]) for i in range(len(vectors)) for r, j in enumerate(sorted(range(len(vectors)), key=lambda j: (gaps[i, j], j))[:k])}


@pytest.mark.parametrize("dims, chunk_rows", [(40, 4096), (40, 50), (17, 30), (16, 4096), (3, 40)])
def test_partial_distances_lose_no_neighbor(spark, dims, chunk_rows):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(220, dims)) * np.geomspace(5, 0.1, dims) @ np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    x[200:210] = x[:10]
    x[210:215] = x[:5] + 1e-9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = neighbors.knn_join(df, df, "vec", 7, "id", chunk_rows=chunk_rows).collect()
    want = plain_neighbors(x, 7)
    assert {(r.id, r.rank): r.neighbor for r in got} == {k: v[0] for k, v in want.items()}
    assert all(abs(r.distance - want[r.id, r.rank][1]) < 1e-12 for r in got)


@pytest.mark.parametrize("metric", neighbors.METRICS)
@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e5, 1.0), (0.0, 1e-25), (3.0, 1e-7), (0.0, 1e25)])
def test_single_precision_loses_no_neighbor(monkeypatch, metric, shift, scale):
    monkeypatch.setattr(neighbors, "SLICE", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 24)) * scale + shift
    x[200:230] = x[:30] * (1 + 1e-9)
    queries = np.vstack([x[:150], x[:150] + scale])
    radius = np.where(np.arange(300) % 3 == 0, np.inf, scale * 4)
    near = neighbors._near_by_parts(queries, x, metric, radius, 6) if metric in ("manhattan", "chebyshev") else neighbors._near_by_product(queries, x, radius, 6)
    kept = {(int(start + i), int(j)) for start, own, refs, _ in near for i, j in zip(own, refs)}
    gaps = np.array([neighbors._length(x - q, metric) for q in queries])
    for i, row in enumerate(gaps):
        wanted = [j for j in np.argsort(row, kind="stable")[:6] if row[j] <= radius[i]]
        assert all((i, int(j)) in kept for j in wanted)
    if shift == 0:
        assert len(kept) < 300 * 200


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e5, 1.0), (0.0, 1e-25), (3.0, 1e-7), (0.0, 1e25)])
def test_single_precision_counts_exactly(monkeypatch, shift, scale):
    monkeypatch.setattr(dbscan, "SLICE", 50)
    x = np.random.default_rng(5).integers(-3, 4, size=(300, 6)) * scale + shift
    frame = pd.DataFrame({"vec": list(x)})
    # The radius is a distance of many pairs.
    eps = neighbors._length(x[1] - x[0])
    for i, inside in dbscan._near_blocks(frame, frame, eps):
        assert inside.tolist() == np.flatnonzero(neighbors._length(x - x[i]) <= eps).tolist()


def test_products_leave_few_more_than_the_nearest(monkeypatch):
    """Limits are renewed from slice to slice, so that later ones add hardly any pairs."""
    monkeypatch.setattr(neighbors, "SLICE", 48)
    x = np.random.default_rng(6).normal(size=(480, 24))
    near = neighbors._near_by_product(x, x, np.full(480, np.inf), 6)
    assert sum(len(own) for _, own, _, _ in near) < 480 * 7


@pytest.mark.parametrize("names", [str, int])
def test_best_of_a_chunk_with_copies(names):
    """Keys of copies are told apart by their order, as in a plain sort."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, size=(90, 4)).astype(float)
    keys = [sorted(names(100 * j + i) for i in range(1 + j % 3)) for j in range(90)]
    left = pd.DataFrame({"rep": [names(i) for i in range(300)], "vec": list(rng.integers(0, 3, size=(300, 4)).astype(float))})
    right = pd.DataFrame({"rep": [k[0] for k in keys], "vec": list(x), "keys": keys})
    got = neighbors._top_kernel(5)(left, right)
    want = []
    for rep, vec in zip(left["rep"], left["vec"]):
        gaps = neighbors._length(x - vec)
        want += [(rep, k, d) for d, k in sorted((d, k) for d, some in zip(gaps.tolist(), keys) for k in some)[:5]]
    assert list(got.itertuples(index=False, name=None)) == want


def test_few_wide_chunks():
    assert neighbors._wide(600_000, 64) <= 10
    mask = np.random.default_rng(1).random((7, 64)) < 0.05
    for some in (mask, mask[:, :30], mask[:, ::2], np.zeros((0, 8), bool)):
        assert all((a == b).all() for a, b in zip(neighbors._set_places(some), np.nonzero(some)))


def test_rows_are_not_sent_to_every_cell(spark):
    """Queries that visit all cells go to a few wide chunks instead."""
    x = np.random.default_rng(4).normal(size=(400, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rep long, vec array<double>")
    index = neighbors.build_index(df, chunk_rows=20)
    assert len(index.pivots) == 40

    def sizes(left, right):
        return pd.DataFrame({"queries": [len(left)], "refs": [len(right)], "pairs": [len(left) * len(right)]})

    sent = neighbors.within_radius(index, df, 100.0, sizes, "queries long, refs long, pairs long")
    sums = sent.selectExpr("sum(queries)", "sum(refs)", "sum(pairs)").first()
    assert tuple(sums) == (8 * 400, 8 * 400, 400 * 400)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_two_chunks_meet_once(spark, monkeypatch, metric):
    """Rows searched among themselves: no pair of different chunks is compared twice, and no neighbour is lost."""
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 100)
    pairs = spark.sparkContext.accumulator(0)
    compare = neighbors._both_kernel

    def counted(keep):
        kernel = compare(keep)

        def run(left, right):
            pairs.add(len(left) * len(right))
            return kernel(left, right)

        return run

    monkeypatch.setattr(neighbors, "_both_kernel", counted)
    x = np.random.default_rng(12).normal(size=(500, 32))
    x[440:470], x[470:] = x[:30], x[:30] * (1 + 1e-9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = neighbors.knn_join(df, df, "vec", 5, "id", chunk_rows=40, metric=metric).collect()
    # 470 distinct vectors or fewer, all pairs of seven eighths of them, once.
    assert 0 < pairs.value < 470 * 470 / 2
    if metric == "euclidean":
        want = plain_neighbors(x, 5)
        assert {(r.id, r.rank): r.neighbor for r in got} == {k: v[0] for k, v in want.items()}
    else:
        size = np.sqrt((x**2).sum(axis=1))
        gaps = np.sort(1 - x @ x.T / np.outer(size, size), axis=1)
        assert len(got) == 5 * len(x) and all(abs(r.distance - gaps[r.id, r["rank"] - 1]) < 1e-12 for r in got)


def test_dense_points_are_not_compared_with_all(spark, monkeypatch):
    """One chunk each shows that points are core and joins them; only points outside the largest cluster go on."""
    sent = []
    whole = dbscan.within_radius

    def counted(index, queries, *args):
        sent.append(queries.count())
        return whole(index, queries, *args)

    monkeypatch.setattr(dbscan, "within_radius", counted)
    rng = np.random.default_rng(13)
    x = np.vstack([rng.normal(size=(400, 20)), rng.normal(size=(60, 20)) + 40, rng.normal(size=(3, 20)) - 90])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = dbscan.dbscan(df, "vec", "id", 6.5, 4, scale=False, chunk_rows=50).collect()
    want = brute_dbscan(x, np.arange(len(x)), 6.5, 4)
    assert {r["id"]: r["cluster"] for r in got} == want
    assert sum(sent) < 200


def test_few_distances_are_summed_to_the_end(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    work = neighbors.knn_work(vectors, vectors, "embedding", 5, "vec_id").first()
    assert work.pairs > 0 and work.share < 0.5
    assert neighbors.knn_work(vectors.limit(0), vectors, "embedding", 5, "vec_id").first().share is None


def test_axes_fall_in_variance(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 20)) * np.linspace(1, 9, 20)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(4)
    axes = neighbors.variance_axes(df)
    np.testing.assert_allclose(axes @ axes.T, np.eye(20), atol=1e-9)
    spread = (x @ axes).var(axis=0)
    assert (np.diff(spread) < 1e-6).all()
    assert neighbors.variance_axes(df.select(F.slice("vec", 1, 5).alias("vec"))) is None
    assert neighbors.variance_axes(df.limit(0)) is None


def exact_kernel(x, gamma):
    return np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))


def test_landmarks_give_the_exact_kernel_and_their_error(spark):
    from flowlens.ml.kernels import fit_landmarks

    rng = np.random.default_rng(11)
    x = rng.normal(size=(1000, 4)) @ np.diag([2, 1, 0.3, 0.1])
    x[500:520] = x[:20]
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(3)
    exact = exact_kernel(x, 0.2)
    errors = []
    for components in (20, 60, 256):
        found = fit_landmarks(rows, 0.2, components)
        y = found.transform(x)
        lack = exact - y @ y.T
        assert found.components <= components and np.linalg.eigvalsh(lack).min() > -1e-6  # never more than the kernel
        assert abs(np.trace(lack) / len(x) - found.residual) < 1e-8 and abs(np.diag(lack).max() - found.worst) < 1e-8
        assert np.abs(lack).max() <= found.worst + 1e-8
        errors.append(found.residual)
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-5
    # As good as choosing every pivot with all rows in view, up to a factor.
    left, images = np.ones(len(x)), np.zeros((len(x), 0))
    for _ in range(20):
        k = left.argmax()
        column = (exact[k] - images @ images[k]) / np.sqrt(left[k])
        images, left = np.column_stack([images, column]), np.maximum(left - column**2, 0)
    assert errors[0] < 2 * left.mean()


def test_few_different_rows_need_few_landmarks(spark):
    from flowlens.ml.kernels import fit_landmarks

    rows = spark.createDataFrame([([float(i % 5)],) for i in range(100)], "vec array<double>")
    found = fit_landmarks(rows, 1.0)
    assert found.components == 5 and found.worst < 1e-9
    none = fit_landmarks(rows.limit(0), 1.0)
    assert (none.components, none.residual) == (0, 0.0)


def test_svm_by_landmarks_is_as_right_as_the_exact_kernel(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1000, 2))
    inside = (x**2).sum(axis=1) < 1.2
    df = spark.createDataFrame(
        [(i, float(a), float(b), "positive" if t else "negative") for i, ((a, b), t) in enumerate(zip(x, inside))],
        "ipsrc long, a double, b double, risk string",
    )
    model = classify.train(df, "svm", ["a", "b"])
    got = {r.ipsrc: r.prediction for r in model.predict(df).collect()}
    right = np.mean([(got[i] == "positive") == t for i, t in enumerate(inside)])
    # Ridge classification with the whole exact kernel as the measure.
    kernel = exact_kernel(x, model.landmarks.gamma)
    plain = np.linalg.solve(kernel + 1e-2 * np.eye(1000), np.where(inside, 1.0, -1.0))
    exact = np.mean((kernel @ plain > 0) == inside)
    assert right > exact - 0.02 and model.landmarks.residual < 1e-3


def brute_tree(matrix, label, classes, max_depth, least_split, least_leaf):
    """Nodes of the exact tree in the order of levels: (feature, threshold, label counts)."""
    nodes, level = [], [(np.arange(len(matrix)), 0)]
    purity = lambda rows: float((np.bincount(label[rows], minlength=classes).astype(float) ** 2).sum()) / len(rows)
    while level:
        following = []
        for rows, depth in level:
            counts, best = np.bincount(label[rows], minlength=classes), None
            if (max_depth is None or depth < max_depth) and len(rows) >= least_split and counts.max() < len(rows):
                for f in range(matrix.shape[1]):
                    values = np.unique(matrix[rows, f])
                    for a, b in zip(values[:-1], values[1:]):
                        low, high = rows[matrix[rows, f] <= a], rows[matrix[rows, f] > a]
                        if min(len(low), len(high)) >= least_leaf:
                            gain = purity(low) + purity(high)
                            if best is None or gain > best[0]:
                                best = (gain, f, a / 2 + b / 2, low, high)
            nodes.append((best[1] if best else -1, best[2] if best else 0.0, counts.tolist()))
            following += [(best[3], depth + 1), (best[4], depth + 1)] if best else []
        level = following
    return nodes


@pytest.mark.parametrize("ranges,depth,split,leaf", [(256, None, 2, 1), (3, 4, 30, 1), (8, 5, 2, 9)])
def test_exact_tree_finds_the_best_splits(spark, ranges, depth, split, leaf):
    random = np.random.RandomState(8)
    matrix = np.column_stack([random.randint(0, 6, 240), random.randn(240), np.where(random.rand(240) < 0.7, 3.0, random.randn(240)), np.ones(240)])
    label = (matrix[:, 0] + matrix[:, 1] * 2 + random.randn(240) > 3).astype(int) + (matrix[:, 2] > 3)
    rows = [(x.tolist(), int(y)) for x, y in zip(matrix, label)] + [([None, 1.0, 2.0, 1.0], 0), ([0.0, float("nan"), 2.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec array<double>, label int").repartition(5)
    tree = exact_tree.fit_exact_tree(df, list("abcd"), 3, depth, split, leaf, ranges)
    got = list(zip(tree.feature, tree.threshold, tree.counts))
    assert got == brute_tree(matrix, label, 3, depth, split, leaf)
    assert len(got) > 5 and "d" not in [tree.names[f] for f in tree.feature if f >= 0]


def test_exact_tree_splits_without_gain(spark):
    rows = [([float(a), float(b)], a ^ b) for a in (0, 1) for b in (0, 1)] * 3
    tree = exact_tree.fit_exact_tree(spark.createDataFrame(rows, "vec array<double>, label int"), ["a", "b"], 2)
    assert tree.numNodes == 7 and [tree.names[f] for f in tree.feature[:3]] == ["a", "b", "b"]
    assert tree.featureImportances.toArray().tolist() == [0.0, 1.0]


def test_exact_tree_of_one_label_or_no_rows(spark):
    one = exact_tree.fit_exact_tree(spark.createDataFrame([([1.0], 0), ([2.0], 0)], "vec array<double>, label int"), ["a"], 1)
    assert one.feature == [-1] and one.counts == [[2]]
    with pytest.raises(ModelError):
        exact_tree.fit_exact_tree(spark.createDataFrame([([None], 0)], "vec array<double>, label int"), ["a"], 1)


def test_exact_tree_bounds_its_nodes(spark, monkeypatch):
    monkeypatch.setattr(exact_tree, "MAX_NODES", 5)
    rows = [([float(i)], i % 2) for i in range(20)]
    with pytest.raises(ModelError):
        exact_tree.fit_exact_tree(spark.createDataFrame(rows, "vec array<double>, label int"), ["a"], 2)


def test_decision_tree_with_a_minimum_split_size(spark, rings, tmp_path):
    model = classify.train(rings, "decision_tree", ["x", "y"], key="id", min_samples_split=20, scale=True)
    assert all(sum(c) >= 20 for f, c in zip(model.model.feature, model.model.counts) if f >= 0)
    found = {r["id"]: (r["risk"], r["prediction"], r["probability"]) for r in model.predict(rings).collect()}
    assert sum(a == b for a, b, _ in found.values()) > 285 and all(0 <= p <= 1 for _, _, p in found.values())
    assert model.leaf_count() == sum(f < 0 for f in model.model.feature)
    assert {r["feature"] for r in model.feature_importance().collect()} == {"x", "y"} and "x <=" in model.rules()
    storage.save_model(model, str(tmp_path), "tree")
    again = storage.load_model(spark, str(tmp_path), "tree").predict(rings).collect()
    assert {r["id"]: (r["risk"], r["prediction"], r["probability"]) for r in again} == found
    missing = model.predict(rings.limit(3).withColumn("x", F.lit(None).cast("double")))
    assert missing.columns == [*rings.columns, "prediction", "probability"] and missing.count() == 0
