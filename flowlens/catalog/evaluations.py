"""Evaluation of predictions: quality labels as truth, ``1 - toxic`` as prediction, text length as score."""

from pyspark.sql import functions as F

from flowlens.catalog.base import Query, rounded
from flowlens.evaluation import metrics, validation
from flowlens.fixtures import table

QUERIES: dict[str, Query] = {}
SCORED_CTE = """scored as (
  select l.doc_id, l.quality as y_true, 1 - l.toxic as y_pred, d.n_chars::double as score
  from labels l join documents d on l.doc_id = d.doc_id
),
grouped as (
  select score, count(*) filter (where y_true = 1) as pos, count(*) filter (where y_true <> 1) as neg
  from scored group by score
),
curve as (
  select score, pos, neg, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
    sum(pos) over () as p, sum(neg) over () as n from grouped
)"""
METRICS_SQL = """(select count(*) filter (where y_true = {pred}) / count(*) as accuracy,
    coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, tn / nullif(tn + fp, 0) as specificity
  from scored, (select count(*) filter (where y_true = 1 and {pred} = 1) as tp,
    count(*) filter (where y_true <> 1 and {pred} = 1) as fp, count(*) filter (where y_true = 1 and {pred} <> 1) as fn,
    count(*) filter (where y_true <> 1 and {pred} <> 1) as tn from scored)
  group by tp, fp, fn, tn)"""


def scored(spark, sf):
    labels, documents = table(spark, sf, "labels"), table(spark, sf, "documents")
    return labels.join(documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id",
        F.col("quality").alias("y_true"),
        (1 - F.col("toxic")).alias("y_pred"),
        F.col("n_chars").cast("double").alias("score"),
    )


def over_scored(name, build, sql=None):
    QUERIES[name] = Query(
        lambda spark, sf: rounded(build(scored(spark, sf))), sql and f"with {SCORED_CTE} {sql}"
    )


AUC_SQL = "(select sum(neg * (tp - pos / 2)) / max(p * n) from curve)"
over_scored(
    "classification_metrics",
    lambda df: metrics.classification_metrics(df, score="score", positive=1),
    f"""select round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall,
      round(f1, 6) as f1, round(specificity, 6) as specificity, round({AUC_SQL}, 6) as auc
      from {METRICS_SQL.format(pred='y_pred')}""",
)
over_scored(
    "confusion_matrix",
    lambda df: metrics.confusion_matrix(df, normalize=True),
    """select t.l as y_true, p.l as y_pred, count(doc_id) as count,
      round(count(doc_id) / nullif(sum(count(doc_id)) over (partition by t.l), 0), 6) as share
      from (select y_true as l from scored union select y_pred from scored) t
      cross join (select y_true as l from scored union select y_pred from scored) p
      left join scored s on s.y_true = t.l and s.y_pred = p.l group by t.l, p.l""",
)
over_scored(
    "classification_report",
    metrics.classification_report,
    """, per as (
        select l::varchar as label, coalesce(tp / nullif(pr, 0), 0) as precision, coalesce(tp / nullif(s, 0), 0) as recall,
          coalesce(2 * tp / nullif(pr + s, 0), 0) as f1, s as support, tp
        from (select l, count(*) filter (where y_true = l and y_pred = l) as tp,
            count(*) filter (where y_true = l) as s, count(*) filter (where y_pred = l) as pr
          from scored, (select y_true as l from scored union select y_pred from scored) group by l))
      select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from per
      union all select 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
        round(sum(tp) / sum(support), 6), sum(support)::bigint from per
      union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from per
      union all select 'weighted avg', round(sum(precision * support) / sum(support), 6),
        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from per""",
)
over_scored("roc_auc", lambda df: metrics.roc_auc(df, positive=1), f"select round({AUC_SQL}, 6) as auc")
over_scored(
    "roc_curve",
    lambda df: metrics.roc_curve(df, positive=1).filter(F.col("threshold") < float("inf")),
    "select score as threshold, round(fp / n, 6) as fpr, round(tp / p, 6) as tpr from curve",
)
over_scored(
    "pr_curve",
    lambda df: metrics.pr_curve(df, positive=1),
    """select score as threshold, round(tp / (tp + fp), 6) as precision, round(tp / p, 6) as recall from curve
      union all select null, 1.0, 0.0""",
)
over_scored(
    "average_precision",
    lambda df: metrics.average_precision(df, positive=1),
    "select round(sum(pos / p * tp / (tp + fp)), 6) as average_precision from curve",
)
over_scored(
    "stratified_folds",
    lambda df: validation.stratified_folds(df, "doc_id", "y_true").select("doc_id", "y_true", "fold"),
    """select doc_id, y_true, cast((row_number() over (partition by y_true
        order by md5(concat(doc_id, ':42')), doc_id) - 1) % 5 as int) as fold from scored""",
)


def _models(df):
    """Two predictors of the same truth: the given one, and 'long texts are good'."""
    long_text = df.withColumn("y_pred", (F.col("score") > 1000).cast("int"))
    return metrics.comparison_table(
        {
            "given": metrics.classification_metrics(df, positive=1),
            "length": metrics.classification_metrics(long_text, positive=1),
        }
    )


LENGTH = METRICS_SQL.format(pred="(score > 1000)::int")
over_scored(
    "comparison_table",
    lambda df: _models(df).select("model", "accuracy", "precision", "recall", "f1", "specificity"),
    " union all ".join(
        f"""select '{name}' as model, round(accuracy, 6) as accuracy, round(precision, 6) as precision,
          round(recall, 6) as recall, round(f1, 6) as f1, round(specificity, 6) as specificity from {source}"""
        for name, source in (("given", METRICS_SQL.format(pred="y_pred")), ("length", LENGTH))
    ),
)
over_scored(
    "best_model",
    lambda df: metrics.best_model(_models(df)),
    f"""select model, round(accuracy, 6) as accuracy from (
      select 'given' as model, accuracy, 0 as i from {METRICS_SQL.format(pred='y_pred')}
      union all select 'length', accuracy, 1 from {LENGTH}) order by accuracy desc, i limit 1""",
)
