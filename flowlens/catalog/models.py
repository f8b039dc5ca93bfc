"""Models over per-address features and over the embedding vectors."""

from pyspark.sql import functions as F

from flowlens.catalog.base import FLOWS_CTE, Query, rounded
from flowlens.catalog.feature_sets import labelled
from flowlens.evaluation import validation
from flowlens.fixtures import flows, table
from flowlens.ml.anomaly import apply_anomaly_detector, detect_anomalies
from flowlens.ml.classify import predict, train
from flowlens.ml.clustering import apply_clusterer, cluster, elbow
from flowlens.ml.dbscan import dbscan, eps_neighbors
from flowlens.ml.exact_tree import fit_exact_tree
from flowlens.ml.iforest import anomaly_attribution, attribution_summary, fit_isolation_forest
from flowlens.ml.knn import KNNModel, knn_leave_one_out
from flowlens.ml.neighbors import knn_join
from flowlens.ml.storage import list_models, load_model, save_model
from flowlens.operators.preparation import pca
from flowlens.schemas import FEATURES_11, FEATURES_STAT, FEATURES_TIME
from flowlens.session import materialize, scratch_path

QUERIES: dict[str, Query] = {}
# The label follows from deny_ratio, so that one is left out of the inputs.
INPUTS = FEATURES_11 + FEATURES_TIME + FEATURES_STAT
FEW = ["total_flows", "unique_dst_ports", "deny", "night_ratio", "avg_dst_port"]
EPS, MIN_SAMPLES = 1.2, 5


def add(name, run, sql=None):
    QUERIES[name] = Query(run, sql)


def labelled_table(spark, sf):
    """Labelled feature table over the flows, written once per query."""
    return materialize(labelled(flows(spark, sf)).na.fill(0.0), "labelled")


def over_labelled(name, build):
    add(name, lambda spark, sf: build(labelled_table(spark, sf)))


def over_vectors(name, build, sql=None):
    add(name, lambda spark, sf: build(table(spark, sf, "embeddings")), sql)


# --- neighbours (DuckDB compares all pairs) --------------------------------------------

PAIRS_CTE = """v as (select vec_id, label, embedding::double[] as e from embeddings),
pairs as (
  select a.vec_id as vec_id, a.label as own, b.vec_id as neighbor, b.label as label,
    list_distance(a.e, b.e) as distance from v a, v b
)"""


def _ranked(condition, k):
    return f"""near as (select * from (select *, row_number() over (partition by vec_id order by distance, neighbor)
      as rank from pairs where {condition}) where rank <= {k})"""


over_vectors(
    "knn_join",
    lambda df: rounded(knn_join(df, df, "embedding", 5, "vec_id", exclude_self=True)).withColumn(
        "rank", F.col("rank").cast("bigint")
    ),
    f"""with {PAIRS_CTE}, {_ranked('vec_id <> neighbor', 5)}
      select vec_id, neighbor, round(distance, 6) as distance, rank from near""",
)
over_vectors(
    "knn",
    lambda df: rounded(
        KNNModel(df, "embedding", "label", "vec_id").predict(df, positive=3)
    ).select("vec_id", "prediction", "probability"),
    f"""with {PAIRS_CTE}, {_ranked('true', 5)},
      votes as (select vec_id, label, count(*) as n from near group by vec_id, label)
      select vec_id, first(label order by n desc, label) as prediction,
        round(coalesce(sum(n) filter (where label = 3), 0) / 5, 6) as probability from votes group by vec_id""",
)
over_vectors(
    "knn_leave_one_out",
    lambda df: rounded(knn_leave_one_out(df, "embedding", "label", "vec_id")),
    f"""with {PAIRS_CTE}, {_ranked('vec_id <> neighbor', 5)},
      votes as (select vec_id, own, label, count(*) as n from near group by vec_id, own, label),
      hits as (select vec_id, (own = first(label order by n desc, label))::int::double as hit from votes group by vec_id, own)
      select round(avg(hit), 6) as accuracy_mean, round(stddev_pop(hit), 6) as accuracy_std,
        count(*) as n_samples from hits""",
)
over_vectors(
    "eps_neighbors",
    lambda df: eps_neighbors(df, "embedding", "vec_id", EPS),
    f"""with {PAIRS_CTE} select vec_id, count(*) as n_neighbors from pairs where distance <= {EPS} group by vec_id""",
)
LOF_CTES = f"""{PAIRS_CTE}, {_ranked('vec_id <> neighbor', 20)},
  kd as (select vec_id, max(distance) as k_distance from near group by vec_id),
  lrd as (select near.vec_id, 1.0 / (avg(greatest(distance, k_distance)) + 1e-10) as density
    from near join kd on near.neighbor = kd.vec_id group by near.vec_id),
  lof as (select near.vec_id, -(avg(b.density) / any_value(a.density)) as raw from near
    join lrd a on near.vec_id = a.vec_id join lrd b on near.neighbor = b.vec_id group by near.vec_id)"""


def _lof(df):
    found, _ = detect_anomalies(df, "embedding", "vec_id", model_key="local_outlier_factor")
    return rounded(found.select("vec_id", "is_anomaly", "anomaly_score"))


over_vectors(
    "local_outlier_factor",
    _lof,
    f"""with {LOF_CTES} select vec_id, raw < (select quantile_cont(raw, 0.1) from lof) as is_anomaly,
      round((max(raw) over () - raw) / (max(raw) over () - min(raw) over ()), 6) as anomaly_score from lof""",
)


def _lof_by(metric):
    def run(df):
        found, _ = detect_anomalies(df, "embedding", "vec_id", model_key="local_outlier_factor", metric=metric)
        return rounded(found.select("vec_id", "is_anomaly", "anomaly_score"))

    return run


# The metrics' distances in SQL.
SQL_DISTANCES = {
    "manhattan": "list_sum([abs(x[1] - x[2]) for x in list_zip(a.e, b.e)])",
    "chebyshev": "list_max([abs(x[1] - x[2]) for x in list_zip(a.e, b.e)])",
    "cosine": "list_cosine_distance(a.e, b.e)",
}
for _metric, _distance in SQL_DISTANCES.items():
    over_vectors(
        f"local_outlier_factor_{_metric}",
        _lof_by(_metric),
        f"""with {LOF_CTES.replace("list_distance(a.e, b.e)", _distance)} select vec_id,
          raw < (select quantile_cont(raw, 0.1) from lof) as is_anomaly,
          round((max(raw) over () - raw) / (max(raw) over () - min(raw) over ()), 6) as anomaly_score from lof""",
    )
DBSCAN_SQL = f"""with recursive {PAIRS_CTE},
  core as (select vec_id from pairs where distance <= {EPS} group by vec_id having count(*) >= {MIN_SAMPLES}),
  edges as (select vec_id as a, neighbor as b from pairs where distance <= {EPS}
    and vec_id in (from core) and neighbor in (from core)),
  reach(node, root) as (select vec_id, vec_id from core
    union select e.b, r.root from reach r join edges e on e.a = r.node and r.root < e.b),
  roots as (select node, min(root) as root from reach group by node),
  numbered as (select root, cast(dense_rank() over (order by root) - 1 as int) as cluster from (select distinct root from roots)),
  reached as (select p.vec_id, min(r.root) as root from pairs p join roots r on p.neighbor = r.node
    where distance <= {EPS} and (p.vec_id = r.node or p.vec_id not in (from core)) group by p.vec_id)
  select v.vec_id, coalesce(n.cluster, -1) as cluster from v
    left join reached r on v.vec_id = r.vec_id left join numbered n on r.root = n.root"""
over_vectors(
    "dbscan",
    lambda df: dbscan(df, "embedding", "vec_id", EPS, MIN_SAMPLES, scale=False),
    DBSCAN_SQL,
)

# --- classifiers -----------------------------------------------------------------------


def _predicted(model_key, **params):
    def build(df):
        fitted = train(df, model_key, INPUTS, **params)
        return predict(fitted, df).select("ipsrc", "risk", "prediction", "probability")

    return build


over_labelled("decision_tree", _predicted("decision_tree", max_depth=5))
over_labelled("logistic_regression", _predicted("logistic_regression", scale=True))
over_labelled("random_forest", _predicted("random_forest", n_estimators=100, max_depth=5))
over_labelled("gradient_boosting", _predicted("gradient_boosting", n_estimators=100))
over_labelled("svm", _predicted("svm", scale=True))
over_labelled("svm_linear", _predicted("svm", scale=True, kernel="linear"))
over_labelled("predict", _predicted("knn", scale=True, n_neighbors=3))

# Two levels of a tree over the flows themselves; SQL looks for the splits of the root, then of its children.
TREE_INPUTS = ["portdst", "portsrc", "hour", "regle_group"]


def _tree_splits(spark, sf):
    rows = flows(spark, sf).withColumns({"hour": F.hour("date"), "regle_group": F.col("regle") % 7})
    rows = rows.select(F.array(*[F.col(c).cast("double") for c in TREE_INPUTS]).alias("vec"), (F.col("action") == "PERMIT").cast("int").alias("label"))
    rows = rows.filter("label is not null")
    return rounded(fit_exact_tree(rows, TREE_INPUTS, 2, max_depth=2, min_samples_split=20, min_samples_leaf=5).table(spark))


def _splits_sql(rows, name):
    """Best split of each node of ``rows``."""
    return f"""{name}_counts as (select node, f, value, sum(1 - label) as a, sum(label) as b from (
      unpivot {rows} on portdst, portsrc, hour, regle_group into name f value value) group by node, f, value),
    {name}_sums as (select node, f, value, lead(value) over w as following, sum(a) over w as a, sum(b) over w as b,
      sum(a) over (partition by node, f) as all_a, sum(b) over (partition by node, f) as all_b
      from {name}_counts window w as (partition by node, f order by value)),
    {name} as (select node, f, case when value / 2 + following / 2 < following then value / 2 + following / 2 else value end as threshold,
      all_a + all_b as rows, a + b as lower_rows,
      (a::double * a + b::double * b) / (a + b)
        + ((all_a - a)::double * (all_a - a) + (all_b - b)::double * (all_b - b)) / (all_a + all_b - a - b) as gain,
      (all_a::double * all_a + all_b::double * all_b) / (all_a + all_b) as base
      from {name}_sums where following is not null and a + b >= 5 and all_a + all_b - a - b >= 5
        and all_a + all_b >= 20 and all_a > 0 and all_b > 0
      qualify row_number() over (partition by node order by gain desc, list_position({TREE_INPUTS}, f), value) = 1)"""


add(
    "exact_tree",
    _tree_splits,
    f"""with {FLOWS_CTE}, rows0 as (select 0 as node, portdst::double as portdst, portsrc::double as portsrc,
      hour(date)::double as hour, (regle % 7)::double as regle_group, (action = 'PERMIT')::int as label from flows
      where portdst is not null and portsrc is not null and date is not null and regle is not null and action is not null),
    {_splits_sql('rows0', 'top')},
    rows1 as (select case when (case top.f when 'portdst' then portdst when 'portsrc' then portsrc when 'hour' then hour
      else regle_group end) <= top.threshold then 1 else 2 end as node, portdst, portsrc, hour, regle_group, label from rows0, top),
    {_splits_sql('rows1', 'below')}
    select node, f as feature, round(threshold, 6) as threshold, rows::bigint as rows, lower_rows::bigint as lower_rows,
      round(gain - base, 6) as decrease from (from top union all from below)""",
)
over_labelled(
    "feature_importance",
    lambda df: train(df, "decision_tree", INPUTS, max_depth=5).feature_importance(10),
)


def _saved(df):
    spark = df.sparkSession
    folder = scratch_path(spark, "models")
    save_model(train(df, "logistic_regression", FEW, scale=True), folder, "risk")
    return load_model(spark, folder, list_models(spark, folder)[0]).predict(df).select("ipsrc", "prediction", "probability")


over_labelled("saved_model", _saved)

# --- anomalies -------------------------------------------------------------------------


def _anomalies(model_key, **params):
    def build(df):
        found, _ = detect_anomalies(df, FEW, model_key=model_key, **params)
        return found.select("ipsrc", "is_anomaly", "anomaly_score")

    return build


over_labelled("isolation_forest", _anomalies("isolation_forest"))
over_labelled("one_class_svm", _anomalies("one_class_svm"))


def _applied(df):
    model = fit_isolation_forest(df, FEW, "ipsrc")
    return apply_anomaly_detector(model, df).select("ipsrc", "is_anomaly", "anomaly_score")


over_labelled("apply_anomaly_detector", _applied)
over_labelled(
    "anomaly_attribution",
    lambda df: attribution_summary(
        anomaly_attribution(fit_isolation_forest(df, FEW, "ipsrc"), df)
    ),
)

# --- clusters and projections ----------------------------------------------------------


def _clusters(df):
    found, model = cluster(df, FEW, n_clusters=3)
    return apply_clusterer(model, df).select("ipsrc", "cluster")


over_labelled("kmeans", _clusters)
over_labelled("elbow", lambda df: elbow(df, FEW, (1, 11)))
over_labelled("pca", lambda df: pca(df, FEW, 2)[0].select("ipsrc", "Dim1", "Dim2"))

# --- validation ------------------------------------------------------------------------

over_labelled(
    "cross_validate",
    lambda df: validation.cross_validation_summary(
        validation.cross_validate(
            df, "logistic_regression", FEW, k=5, scoring=("accuracy", "f1", "roc_auc"), scale=True
        )
    ),
)

def evaluated(parts):
    """All three parts in long form: metrics of the training rows, confusion table, cross-validation."""
    metrics = parts["resubstitution"]
    whole = metrics.select(F.explode(F.array(*[
        F.struct(F.lit("resubstitution").alias("part"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
        for c in metrics.columns
    ])).alias("r")).select("r.*")
    cells = parts["confusion_matrix"].select(
        F.lit("confusion_matrix").alias("part"), F.concat_ws("/", "y_true", "y_pred").alias("name"), F.col("count").cast("double").alias("value")
    )
    folds = parts["cross_validation"].select(F.lit("cross_validation").alias("part"), F.col("metric").alias("name"), F.col("mean").alias("value"))
    return whole.unionByName(cells).unionByName(folds)


over_labelled(
    "evaluate_model",
    lambda df: evaluated(validation.evaluate_model(df, "decision_tree", FEW, k=5, max_depth=4)),
)
over_labelled(
    "compare_models",
    lambda df: validation.compare_models(df, ["decision_tree", "logistic_regression", "knn"], FEW, k=5),
)
