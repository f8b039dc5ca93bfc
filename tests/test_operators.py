"""Operators on small tables with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.errors import FeatureError
from flowlens.evaluation import metrics
from flowlens.fixtures import flows, flows_large
from flowlens.operators import columns, features, joins, ordering, preparation, quality
from flowlens.plans import addresses, tables, traffic


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_are_exact(spark, monkeypatch):
    random = np.random.RandomState(0)
    values = np.concatenate([random.exponential(5, 3000), np.full(1500, 2.0)])
    df = spark.createDataFrame([(float(v), None if i % 5 else float(-v)) for i, v in enumerate(values)], "a double, b double")
    wanted = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for accuracy in (10000, 200):  # small accuracy: brackets are used
        monkeypatch.setattr(ordering, "SKETCH_ACCURACY", accuracy)
        found = ordering.exact_quantiles(df, ["a", "b"], wanted)
        assert np.allclose(found["a"], np.quantile(values, wanted))
        assert np.allclose(found["b"], np.quantile(-values[::5], wanted))
    monkeypatch.setattr(ordering, "BRACKET_ROWS", 20)  # brackets are narrowed
    assert np.allclose(ordering.exact_quantiles(df, ["a"], wanted)["a"], np.quantile(values, wanted))
    empty = df.filter("a < -1")
    assert ordering.exact_quantiles(empty, ["a"], [0.5]) == {"a": [None]}


@pytest.mark.parametrize("ranges", [2, 7, 50])
def test_running_sums(spark, ranges):
    df = spark.range(500).select(((F.col("id") * 37) % 500).cast("double").alias("x"), (F.col("id") % 3).alias("w"))
    got = ordering.running_sums(df, "x", {"s": "w"}, True, ranges).orderBy("x").toPandas()
    assert (got["w"][::-1].cumsum()[::-1] == got["s"]).all()


def test_auc_with_one_dominant_score(spark):
    rows = [(int(i % 3 == 0), 0.5) for i in range(300)] + [(1, 0.9), (0, 0.1), (1, 0.2)]
    df = spark.createDataFrame(rows, "y_true int, score double")
    y, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    p, n = s[y == 1], s[y == 0]
    want = np.mean((p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None]))
    assert abs(metrics.roc_auc(df, positive=1).first()["auc"] - want) < 1e-12
    assert metrics.roc_auc(df.filter("y_true = 1"), positive=1).first()["auc"] is None
    curve = metrics.roc_curve(df, positive=1)
    assert curve.count() == 5 and curve.filter("threshold = double('infinity')").first()["tpr"] == 0.0


def test_metrics_of_one_label(spark):
    df = spark.createDataFrame([("positive", "positive")] * 3, "y_true string, y_pred string")
    row = metrics.classification_metrics(df).first()
    assert (row["accuracy"], row["f1"], row["specificity"], row["auc"]) == (1.0, 1.0, None, None)
    with pytest.raises(ValueError):
        metrics.best_model(metrics.comparison_table({"a": metrics.classification_metrics(df)}), "nope")


def test_hash_rank_is_a_permutation_per_group(spark):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") % 10 == 0, "a").otherwise("b"))
    ranked = ordering.hash_rank(df, "id", "g", 42)
    got = ranked.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] for r in got)
    again = ordering.hash_rank(df.repartition(13), "id", "g", 42)
    assert ranked.select("id", "rank").exceptAll(again.select("id", "rank")).count() == 0


def test_features_missing_columns(spark):
    df = spark.createDataFrame([("a", "PERMIT"), ("a", "drop"), (None, "DENY")], "ipsrc string, action string")
    row = features.ip_features(df).collect()
    assert len(row) == 1 and row[0].asDict() == {
        "ipsrc": "a", "total_flows": 2, "permit": 1, "permit_low_port": 0, "permit_high_port": 0,
        "permit_admin": 0, "deny": 1, "deny_low_port": 0, "deny_high_port": 0, "deny_admin": 0,
    }
    assert features.course_table(df).columns[2:4] == ["unique_dst_ips", "unique_dst_ports"]
    with pytest.raises(FeatureError):
        features.ip_features(df, ip_col="nope")
    with pytest.raises(FeatureError):
        features.time_features(df)
    # One row: variance undefined, nothing is dropped.
    assert len(features.course_features(df).feature_names) == 11


def test_null_port_counts_as_low(spark):
    df = spark.createDataFrame([("a", "d", None, "PERMIT"), ("a", "d", 1024, "PERMIT"), ("a", "d", 1025, "PERMIT")], "ipsrc string, ipdst string, portdst int, action string")
    row = features.ip_features(df).first()
    assert (row["permit_low_port"], row["permit_high_port"], row["unique_dst_ports"]) == (2, 1, 2)


def test_full_features_use_one_pass(spark, sf_dir):
    plan = plan_of(features.full_table(flows_large(spark, sf_dir)))
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_correlated_features(spark):
    random = np.random.RandomState(3)
    x = random.randn(300)
    data = np.column_stack([x, 2 * x + 0.001 * random.randn(300), random.randn(300), -3 * x])
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{n} double" for n in names))
    assert preparation.correlated_features(df, names) == ["a", "b"]
    assert preparation.drop_correlated(df, names).columns == ["c", "d"]
    found = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in preparation.correlation_matrix(df).collect()}
    want = np.corrcoef(data.T)
    assert all(abs(found[(p, q)] - want[i, j]) < 1e-9 for i, p in enumerate(names) for j, q in enumerate(names))


def test_scaler_of_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    for method in ("standard", "minmax", "robust"):
        scaler = preparation.fit_scaler(df, ["a", "b"], method)
        scaled = scaler.transform(df)
        assert [r["b"] for r in scaled.collect()] == [0.0, 0.0]
        assert sorted(scaler.inverse_transform(scaled).collect()) == sorted(df.collect())


def test_selection_and_presets(spark, sf_dir):
    table = features.ip_features(flows(spark, sf_dir))
    assert columns.select_features(table, ["deny", "nope"]).columns == ["ipsrc", "deny"]
    with pytest.raises(FeatureError):
        columns.select_features(table, ["nope"])
    with pytest.raises(FeatureError):
        columns.select_features(table, preset="nope")
    assert columns.feature_preset(table, "simple") == ["total_flows", "unique_dst_ips", "unique_dst_ports"]
    assert columns.feature_preset(table, "custom", ["deny", "x"]) == ["deny"]
    assert len(columns.feature_preset(table, "all")) == 11


def test_filters_reach_the_scan(spark, sf_dir):
    from flowlens.operators import filters

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = plan_of(filters.filter_dates(events, "2024-01-05", "2024-01-06", "ts").select("event_id"))
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_compare_ips_limit(spark, sf_dir):
    with pytest.raises(ValueError):
        joins.compare_ips(addresses.ip_stats(flows(spark, sf_dir)), list("abcdef"))


def test_port_ranges_and_zero(spark):
    df = spark.createDataFrame([(0,), (1,), (1023,), (1024,), (49151,), (49152,), (65535,), (70000,), (None,)], "portdst int")
    got = {r["port_category"]: r["count"] for r in traffic.port_range_counts(df).collect()}
    assert got == {"Well-known (0-1023)": 2, "Registered (1024-49151)": 2, "Dynamic/Private (49152-65535)": 2}
    labels = [r["port_category"] for r in traffic.with_port_category(df).collect()]
    assert labels[0] == "Well-known (0-1023)" and labels[7:] == ["Unknown", "Unknown"]


def test_validation_levels(spark):
    df = spark.createDataFrame([(None, "x", 1, "Permit")], "ipsrc string, ipdst string, portdst int, action string")
    checks = {r["check_name"]: r["ok"] for r in quality.validate_flows(df, "firewall").collect()}
    assert checks == {"missing_columns": True, "unexpected_actions": True, "null_source_ips": True}
    assert quality.require_valid(df, "firewall") is df


def test_histogram_and_box_of_constant(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    row = tables.feature_histogram(df, "x").collect()
    assert len(row) == 1 and (row[0]["bin"], row[0]["count"]) == (0, 4)
    box = tables.feature_box(df, ["x"]).first()
    assert (box["whisker_low"], box["median"], box["whisker_high"]) == (5.0, 5.0, 5.0)


def test_paging_walk(spark, sf_dir):
    df = flows(spark, sf_dir).select("event_id", "portdst")
    second = tables.browse_page(df, "portdst", "event_id", page=2, rows_per_page=30).collect()
    last = tables.browse_page(df, "portdst", "event_id", page=1, rows_per_page=30).collect()[-1]
    assert tables.browse_after(df, "portdst", "event_id", last["portdst"], last["event_id"], 30).collect() == second


@pytest.mark.parametrize("ascending", [True, False])
def test_page_directory(spark, sf_dir, ascending):
    df = flows(spark, sf_dir).select("event_id", "portdst", F.lit(1).alias("_range"))
    book = tables.page_directory(df, "portdst", "event_id", 30, ascending, ranges=9)
    total = df.count()
    assert sum(book.rows) == total and max(book.rows) < total / 3 and book.pages == -(-total // 30)
    order = F.asc_nulls_last("portdst") if ascending else F.desc_nulls_last("portdst")
    whole = df.orderBy(order, "event_id").collect()
    border = sum(book.rows[:4]) // 30 + 1
    for page in (1, 2, border, book.pages):
        assert book.page(page).collect() == whole[(page - 1) * 30 : page * 30]
        assert len(book.ranges_of(page)[0]) <= 2
    assert book.page(0).count() == book.page(book.pages + 1).count() == 0
    empty = tables.page_directory(df.filter("event_id < 0"), "portdst", "event_id")
    assert empty.pages == 1 and empty.page(1).columns == df.columns and empty.page(1).count() == 0


def test_approximate_options(spark, sf_dir):
    df = flows(spark, sf_dir)
    exact, near = traffic.summary_metrics(df).first(), traffic.summary_metrics(df, approximate=True).first()
    assert abs(exact["unique_src_ips"] - near["unique_src_ips"]) <= 0.2 * exact["unique_src_ips"]
    assert tables.describe(df, ["portdst"], approximate=True).first()["count"] == tables.describe(df, ["portdst"]).first()["count"]


def test_places_of_doubles_keep_their_order():
    values = [float("-inf"), -1e308, -1.5, -5e-324, 0.0, 5e-324, 1e-9, 1.5, 1e308, float("inf")]
    places = [ordering._place(v) for v in values]
    assert places == sorted(places) and [ordering._double(p) for p in places] == values
    assert ordering._place(5e-324) == 1 and ordering._place(-5e-324) == -1 and ordering._place(-0.0) == 0


def test_brackets_shrink_on_adversarial_columns(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BRACKET_ROWS", 40)
    monkeypatch.setattr(ordering, "SKETCH_ACCURACY", 20)  # brackets of the sketch hold far more rows than allowed
    rng = np.random.RandomState(5)
    wide = np.concatenate([10.0 ** rng.uniform(-300, 300, 1500), -(10.0 ** rng.uniform(-300, 300, 1500))])
    near = 1.0 + rng.randint(0, 3000, 3000) * 2.0**-52  # neighbours among the doubles
    hot = np.where(rng.rand(3000) < 0.6, 7.0, rng.normal(size=3000))
    table = pd.DataFrame({"wide": wide, "near": near, "hot": hot})
    df = spark.createDataFrame(table).repartition(5)
    chances = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    held = []
    ranked = ordering._ranked_values

    def counting(values, targets):
        for i, _, first, second, _, low, high in targets:
            inside = table.iloc[:, i][table.iloc[:, i].between(low, high)]
            held.append(0 if inside.nunique() == 1 else len(inside))
        return ranked(values, targets)

    monkeypatch.setattr(ordering, "_ranked_values", counting)
    got = ordering.exact_quantiles(df, table.columns, chances)
    for c in table.columns:
        ordered = np.sort(table[c].to_numpy())
        for p, value in zip(chances, got[c]):
            place = (len(ordered) - 1) * p
            low, high = ordered[int(place)], ordered[min(int(place) + 1, len(ordered) - 1)]
            assert value == low + (high - low) * (place - int(place))
    assert max(held) <= 40


def test_brackets_that_miss_their_rank_start_again(spark, monkeypatch):
    df = spark.range(0, 5000).select((F.col("id") % 977).cast("double").alias("v"))
    monkeypatch.setattr(ordering, "BRACKET_ROWS", 30)
    values = df.select(F.col("v").alias("c0"))
    missed = ordering._halved(values, [(0, 0, 10, 11, 0.5, 900.0, 950.0)])
    assert missed == [(0, 0, 10, 11, 0.5, 900.0, 950.0)]
    found = ordering._ranked_values(values, ordering._halved(values, [(0, 0, 10, 2499, 0.5, 0.0, 976.0)]))
    expected = np.sort(np.arange(5000) % 977)
    assert found == {(0, 0): {10: expected[10], 2499: expected[2499]}}
