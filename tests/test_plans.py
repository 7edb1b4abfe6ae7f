"""Physical plans: pushed filters, pruned columns, split hot keys, bounded broadcasts."""

import contextlib
import os

import pytest
from pyspark.sql import functions as F

from codonloom.catalog import assembling
from codonloom.catalog.views import Tables
from codonloom.operators import graph, sampling
from codonloom.operators.ordering import hash_rank
from codonloom.operators.relate import map_both_ends, spread_join
from codonloom.plans import assemble
from codonloom.session import stage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def mutations(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mutations") / "table")
    # Nine of ten rows belong to one gene.
    spark.range(200_000).select(
        F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 1000).cast("bigint").alias("Entrez_Gene_Id"),
        F.lit("Missense_Mutation").alias("Variant_Classification"), F.lit("SNP").alias("Variant_Type"),
        F.concat(F.lit("p.V"), F.col("id") % 500, F.lit("E")).alias("HGVSp_Short"), F.lit("P15056").alias("SWISSPROT"),
        F.col("id").alias("Start_Position"), F.col("id").alias("unused"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(spark, mutations):
    with settings(spark, spark__sql__maxMetadataStringLength="2000"):
        text = plan(assemble.clean_missense(mutations, distinct=False).select("Entrez_Gene_Id"))
    scan = text[text.index("FileScan"):]
    assert "StringContains(Variant_Classification,Missense_Mutation)" in scan
    assert "Not(In(Variant_Type" in scan or "In(Variant_Type" in scan
    assert "unused" not in scan and "Start_Position" not in scan


def test_hot_gene_is_spread(spark, mutations):
    """Spark splits the hot gene's rows, as the written right side is shuffled for the join alone."""
    degrees = spark.range(1000).select(F.col("id").alias("gene"), F.lit(1).alias("times"))
    narrow = mutations.select("Entrez_Gene_Id", "Start_Position")
    with settings(
        spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="128k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
    ):
        joined = spread_join(narrow, degrees, "Entrez_Gene_Id", "gene")
        assert len(joined.collect()) == 200_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_hot_edge_end_is_split(spark):
    edges = spark.range(200_000).select(
        F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).cast("string").alias("P1"),
        F.col("id").cast("string").alias("P2"))
    ids = spark.range(200_000).select(F.col("id").cast("string").alias("From"), F.col("id").alias("To"))
    with settings(
        spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
    ):
        mapped = map_both_ends(edges, ids)
        assert len(mapped.collect()) == 200_000
        assert "skew=true" in plan(mapped)


def test_rank_moves_rows_once(spark, mutations):
    rows = mutations.select("Start_Position", "Variant_Type")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(hash_rank(rows, ["Start_Position"], by=["Variant_Type"]))
    # The numbering window uses the partitioning of the join below it.
    window = text[text.index("Window [row_number()"):]
    assert "Exchange" not in window[:window.index("SortMergeJoin")]


def test_undersampling_does_not_shuffle_rows(spark, mutations):
    rows = mutations.select("Start_Position", "HGVSp_Short").withColumn(
        "y", F.when(F.col("Start_Position") % 10 == 0, "driver").otherwise("passenger"))
    kept = sampling.undersample(rows, "y", ["Start_Position"])
    text = plan(kept)
    for line in text.split("\n"):
        assert not ("Exchange hashpartitioning" in line and "HGVSp_Short" in line)
    assert kept.groupBy("y").count().filter("count <> 20000").count() == 0


def test_degree_carries_no_lists(spark):
    edges = spark.range(100).select(F.col("id").cast("string").alias("P1"), (F.col("id") % 3).cast("string").alias("P2"))
    ids = spark.range(100).select(F.col("id").cast("string").alias("From"), F.col("id").alias("To"))
    text = plan(graph.degree(graph.interaction_pairs(edges, ids)))
    assert "collect_" not in text and "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_study_tables_share_their_interaction_pairs(spark):
    """Training, test and benchmark table read one set of gene columns, and their rows stay as they are alone."""
    t = Tables(spark, "/root/testdata/sf0.001")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/codonloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    shared = assembling.study_tables(t, lambda table, name: stage(table, name))
    made = [n.split("-")[0] for n in set(os.listdir(folder)) - before]
    assert made.count("pairs") == 1 and made.count("genes") == 1
    alone = (assembling.training_table(t), assembling.test_table(t), assembling.benchmark_features(t))
    for one, two in zip(shared, alone, strict=True):
        assert one.columns == two.columns and one.count() == two.count() and one.exceptAll(two).isEmpty()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_gene_columns_come_in_one_join(spark):
    """Mutation rows meet their scores, their label or competitor and all 47 gene columns once each."""
    t = Tables(spark, "/root/testdata/sf0.001")
    for build, joins in ((assembling.training_table, 3), (assembling.test_table, 2), (assembling.benchmark_features, 4)):
        text = plan(build(t))
        assert text.count("Join ") + text.count("Join(") == joins, text
