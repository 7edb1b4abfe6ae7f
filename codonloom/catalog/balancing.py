"""Undersampling, stratified samples and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from codonloom.catalog.registry import query
from codonloom.operators import sampling

_RANKED = """
    select row_id, obs, score, row_number() over (partition by obs
      order by md5('{seed}|' || cast(row_id as varchar)), row_id) as nth, count(*) over (partition by obs) as n from predictions"""


@query("undersample_classes", f"""
    with ranked as ({_RANKED.format(seed=467)})
    select row_id, obs, score from ranked where nth <= (select min(n) from ranked)""")
def _(t):
    return sampling.undersample(t("predictions").select("row_id", "obs", "score"), "obs", ["row_id"], seed=467)


@query("undersample_documents", """
    with ranked as (select doc_id, class, row_number() over (partition by class
      order by md5('467|' || cast(doc_id as varchar)), doc_id) as nth, count(*) over (partition by class) as n from labelled_docs)
    select doc_id, class from ranked where nth <= (select min(n) from ranked)""")
def _(t):
    return sampling.undersample(t("labelled_docs").select("doc_id", "class"), "class", ["doc_id"], seed=467)


@query("stratified_fraction", f"""
    with ranked as ({_RANKED.format(seed=7)})
    select row_id, obs, score from ranked where nth <= round_even(n * cast(0.25 as double), 0)""")
def _(t):
    return sampling.stratified_fraction(
        t("predictions").select("row_id", "obs", "score"), "obs", ["row_id"], 0.25, seed=7)


@query("stratified_folds", f"""
    with ranked as ({_RANKED.format(seed=467)}) select row_id, obs, cast((nth - 1) % 10 as int) as fold from ranked""")
def _(t):
    return sampling.assign_folds(t("predictions").select("row_id", "obs"), "obs", ["row_id"], 10, seed=467)


@query("fold_sizes", f"""
    with ranked as ({_RANKED.format(seed=467)})
    select cast((nth - 1) % 10 as int) as fold, obs, count(*) as n from ranked group by all""")
def _(t):
    folds = sampling.assign_folds(t("predictions").select("row_id", "obs"), "obs", ["row_id"], 10, seed=467)
    return folds.groupBy("fold", "obs").agg(F.count("*").alias("n"))
