"""Confusion, ROC and comparison metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonloom.catalog.registry import STEPS, query
from codonloom.learn import evaluate

_COUNTS = """count(*) filter (where obs = 'driver' and pred = 'driver') as tp,
      count(*) filter (where obs <> 'driver' and pred = 'driver') as fp,
      count(*) filter (where obs = 'driver' and pred <> 'driver') as fn,
      count(*) filter (where obs <> 'driver' and pred <> 'driver') as tn"""
_RATES = {
    "accuracy": "(tp + tn) / n", "kappa": "((tp + tn) / n - e) / (1 - e)",
    "no_information_rate": "greatest(tp + fn, fp + tn) / n", "sensitivity": "tp / (tp + fn)",
    "specificity": "tn / (tn + fp)", "ppv": "tp / (tp + fp)", "npv": "tn / (tn + fn)",
    "precision": "tp / (tp + fp)", "recall": "tp / (tp + fn)", "f1": "2 * tp / (2 * tp + fp + fn)",
    "prevalence": "(tp + fn) / n", "detection_rate": "tp / n", "detection_prevalence": "(tp + fp) / n",
    "balanced_accuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2",
    "mcnemar_chi2": "power(greatest(abs(fp - fn) - 1, 0), 2) / (fp + fn)",
}
STEPS["roc_counts"] = """
    select score, count(*) filter (where obs = 'driver') as n_pos, count(*) filter (where obs <> 'driver') as n_neg
    from predictions group by score"""
STEPS["roc_rows"] = """
    select *, cast(sum(n_pos) over (order by score desc) as bigint) as tp, cast(sum(n_neg) over (order by score desc) as bigint) as fp,
      sum(n_pos) over () as p, sum(n_neg) over () as n from roc_counts"""
STEPS["stacked_predictions"] = """
    select 'own' as classifier, fold, obs, score, case when score >= 0.5 then 'driver' else 'passenger' end as pred from predictions
    union all
    select 'rival', fold, obs, rival, case when rival >= 0.5 then 'driver' else 'passenger' end from predictions"""
_AREA = """(select {by}, sum(n_neg * (tp - n_pos) + n_neg * n_pos / 2) / (sum(n_pos) * sum(n_neg)) as auc from (
      select *, sum(n_pos) over (partition by {by} order by score desc) as tp from (
        select {by}, score, count(*) filter (where obs = 'driver') as n_pos, count(*) filter (where obs <> 'driver') as n_neg
        from {source} group by {by}, score)) group by {by})"""


@query("confusion_counts", f"select {_COUNTS} from predictions")
def _(t):
    return evaluate.confusion(t("predictions"), "obs", "pred")


@query("confusion_metrics", f"""
    with c as (select {_COUNTS} from predictions),
    d as (select tp::double as tp, fp::double as fp, fn::double as fn, tn::double as tn, (tp + fp + fn + tn)::double as n from c),
    g as (select *, ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / (n * n) as e from d)
    select {', '.join(f'round({sql}, 9) as {name}' for name, sql in _RATES.items())} from g""")
def _(t):
    metrics = evaluate.confusion_metrics(evaluate.confusion(t("predictions"), "obs", "pred"))
    return metrics.select(*[F.round(c, 9).alias(c) for c in _RATES])


@query("roc_points", """
    select score as threshold, tp, fp, round(tp / p, 9) as tpr, round(fp / n, 9) as fpr from roc_rows""")
def _(t):
    curve = evaluate.roc_curve(evaluate.roc_points(t("predictions"), "obs", "score"))
    return curve.withColumns({c: F.round(c, 9) for c in ("tpr", "fpr")})


@query("roc_area", """
    select round(sum(n_neg * (tp - n_pos) + n_neg * n_pos / 2) / (sum(n_pos) * sum(n_neg)), 9) as auc from roc_rows""")
def _(t):
    return evaluate.auc(t("predictions"), "obs", "score").select(F.round("auc", 9).alias("auc"))


@query("roc_area_documents", """
    with c as (select score, count(*) filter (where class = 'driver') as n_pos, count(*) filter (where class <> 'driver') as n_neg
      from labelled_docs group by score),
    r as (select *, sum(n_pos) over (order by score desc) as tp from c)
    select round(sum(n_neg * (tp - n_pos) + n_neg * n_pos / 2) / (sum(n_pos) * sum(n_neg)), 9) as auc from r""")
def _(t):
    return evaluate.auc(t("labelled_docs"), "class", "score").select(F.round("auc", 9).alias("auc"))


@query("fold_summary", f"""
    with a as {_AREA.format(by='fold', source='predictions')},
    c as (select fold, {_COUNTS} from predictions group by fold)
    select a.fold, round(a.auc, 9) as roc, round(tp / (tp + fn), 9) as sens, round(tn / (tn + fp), 9) as spec
    from a join c on a.fold = c.fold""")
def _(t):
    summary = evaluate.fold_summary(t("predictions"), "obs", "pred", "score")
    return summary.withColumns({c: F.round(c, 9) for c in ("roc", "sens", "spec")})


@query("fold_means", f"""
    with a as {_AREA.format(by='fold', source='predictions')},
    c as (select fold, {_COUNTS} from predictions group by fold)
    select round(avg(a.auc), 9) as roc, round(avg(tp / (tp + fn)), 9) as sens, round(avg(tn / (tn + fp)), 9) as spec
    from a join c on a.fold = c.fold""")
def _(t):
    means = evaluate.mean_over_folds(evaluate.fold_summary(t("predictions"), "obs", "pred", "score"))
    return means.select(*[F.round(c, 9).alias(c) for c in ("roc", "sens", "spec")])


@query("threshold_metrics", """
    with s as (select max(p) as p, max(n) as n,
      sum(n_neg * (tp - n_pos) + n_neg * n_pos / 2) / (sum(n_pos) * sum(n_neg)) as auc,
      max(tp / p - fp / n) as ks, min((fp + p - tp) / (p + n)) as mer,
      max(case when fp / n <= 0.05 then tp / p end) as sens95, max(case when tp / p >= 0.95 then 1 - fp / n end) as spec95,
      coalesce(sum(n_pos) filter (where score >= 0.5), 0) as tp, coalesce(sum(n_neg) filter (where score >= 0.5), 0) as fp
      from roc_rows)
    select round(auc, 9) as auc, round(2 * auc - 1, 9) as gini, round(greatest(ks, 0), 9) as ks,
      round(least(mer, p / (p + n)), 9) as min_error_rate, round(coalesce(sens95, 0), 9) as sens_at_95_spec,
      round(coalesce(spec95, 0), 9) as spec_at_95_sens, round((fp + p - tp) / (p + n), 9) as error_rate,
      round(tp / p, 9) as tpr, round(fp / n, 9) as fpr, round(2 * tp / (tp + fp + p), 9) as f1,
      round(tp / p - fp / n, 9) as youden from s""")
def _(t):
    metrics = evaluate.threshold_metrics(t("predictions"), "obs", "score")
    return metrics.select(*[F.round(c, 9).alias(c) for c in metrics.columns])


_COMPARED = f"""
    with a as {_AREA.format(by='classifier', source='stacked_predictions')},
    c as (select classifier, {_COUNTS} from stacked_predictions group by classifier),
    w as (select c.classifier, (tp + tn) / (tp + fp + fn + tn) as accuracy, tp / (tp + fp) as precision,
      tp / (tp + fn) as recall, 2 * tp / (2 * tp + fp + fn) as f1, a.auc from c join a on c.classifier = a.classifier)
    select classifier, measure, round(score, 9) as score from (unpivot w on accuracy, precision, recall, f1, auc
      into name measure value score)"""


@query("model_comparison", _COMPARED)
def _(t):
    stacked = evaluate.predictions_long(t("predictions"), "obs", {"own": "score", "rival": "rival"})
    return evaluate.comparison(stacked, "obs", "pred", "score").withColumn("score", F.round("score", 9))


@query("competitor_comparison", """
    with s as (select classifier, score, count(*) filter (where obs = 'driver') as n_pos,
        count(*) filter (where obs <> 'driver') as n_neg from stacked_predictions group by classifier, score),
    r as (select *, sum(n_pos) over w as tp, sum(n_neg) over w as fp, sum(n_pos) over (partition by classifier) as p,
        sum(n_neg) over (partition by classifier) as n from s window w as (partition by classifier order by score desc))
    select classifier, round(sum(n_neg * (tp - n_pos) + n_neg * n_pos / 2) / (sum(n_pos) * sum(n_neg)), 9) as auc,
      round(greatest(max(tp / p - fp / n), 0), 9) as ks, round(least(min((fp + p - tp) / (p + n)), max(p) / max(p + n)), 9) as min_error_rate
    from r group by classifier""")
def _(t):
    stacked = evaluate.predictions_long(t("predictions"), "obs", {"own": "score", "rival": "rival"})
    metrics = evaluate.threshold_metrics(stacked, "obs", "score", by=["classifier"])
    return metrics.select("classifier", *[F.round(c, 9).alias(c) for c in ("auc", "ks", "min_error_rate")])
