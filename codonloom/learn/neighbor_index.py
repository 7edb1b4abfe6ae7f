"""A saved nearest-neighbour index: random-projection buckets, exact distances inside them.

Vectors are scaled as they were when the index was fitted. Each table of the index cuts the
space by random projections at their medians, so its buckets hold about `BUCKET_ROWS` rows
whatever the size of the data. A search looks into the bucket of a row and those behind its
nearest cuts, and ranks what it finds by exact distance. Recall against exact neighbours is
measured while the index is fitted and decides how many tables it gets.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonloom.learn.neighbors import closest, nearest, neighbor_scores_by_k
from codonloom.session import scratch_path, stage

BUCKET_ROWS = 4096  # rows a bucket is meant to hold, and the most a task compares at a time
SAMPLE_ROWS = 20_000  # bound of the sample the cuts come from
PROBES = 4  # nearest cuts of each table behind which a search looks as well
MOST_TABLES = 32
RECALL_ROWS = 200  # rows the recall is measured on
NEIGHBORS = tuple(range(5, 24, 2))  # settings of k


@dataclass
class NeighborIndex:
    """A fitted index: where its rows are, how vectors are scaled and cut, and the recall it was measured at."""

    path: str
    width: int
    scale: list[float]
    k: int
    bits: int
    tables: int = 0
    recall: float = 0.0
    directions: list[list[list[float]]] = field(default_factory=list)  # table, bit, component
    cuts: list[list[float]] = field(default_factory=list)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_ROWS).parquet(f"{self.path}/rows")

    def save(self, spark: SparkSession) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").write.mode("overwrite").text(f"{self.path}/index")


_ROWS = "table int, bucket bigint, row_id bigint, label int, x array<double>"


def load(spark: SparkSession, path: str) -> NeighborIndex:
    """The index saved under `path`, which may have been moved."""
    held = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/index").collect()))
    return NeighborIndex(**held | {"path": path})


def _scaled(df: DataFrame, index: NeighborIndex, features: str, *columns) -> DataFrame:
    scale = F.array(*[F.lit(s) for s in index.scale])
    return df.select(*columns, F.zip_with(F.col(features), scale, lambda v, s: v / s).alias("x"))


def deviations(train: DataFrame, features: str) -> list[float]:
    """Sample standard deviation of each component; 1 where it is constant."""
    found = train.select(F.posexplode(features).alias("i", "v")).groupBy("i").agg(F.stddev_samp("v").alias("d")).orderBy("i").collect()
    return [r["d"] if r["d"] and math.isfinite(r["d"]) else 1.0 for r in found]


def _slim(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 lowest ids: no other can be among k neighbours, a row itself not counted."""
    same = Window.partitionBy("x").orderBy("row_id")
    return rows.withColumn("_nth", F.row_number().over(same)).filter(F.col("_nth") <= k + 1).drop("_nth")


def _bucketed(df: DataFrame, index: NeighborIndex, tables: range, probes: int, columns: list[str]) -> DataFrame:
    """`columns`, `x`, `table` and `bucket`: each row once per table and bucket to look into."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns, "x").schema.fields)
    directions = np.array([index.directions[t] for t in tables]).reshape(len(tables), index.bits, index.width)
    cuts = np.array([index.cuts[t] for t in tables]).reshape(len(tables), index.bits)
    powers = 1 << np.arange(index.bits, dtype=np.int64)

    def batches(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(len(columns)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            at, table, bucket = [], [], []
            for t, name in enumerate(tables):
                gap = x @ directions[t].T - cuts[t] if index.bits else np.zeros((n, 0))
                own = (gap > 0) @ powers if index.bits else np.zeros(n, np.int64)
                flips = np.argsort(np.abs(gap), axis=1)[:, :probes]
                held = np.concatenate([own[:, None], own[:, None] ^ powers[flips]], 1) if index.bits else own[:, None]
                at.append(np.repeat(np.arange(n), held.shape[1]))
                table.append(np.full(held.size, name, np.int32))
                bucket.append(held.ravel())
            taken = batch.take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(np.concatenate(table)), pa.array(np.concatenate(bucket))], [*columns, "x", "table", "bucket"])

    return df.select(*columns, "x").mapInArrow(batches, f"{fields}, table int, bucket bigint")


def _draw(index: NeighborIndex, sample: np.ndarray, until: int, seed: int) -> None:
    """Directions and cuts of further tables, each with its own seed."""
    for t in range(index.tables, until):
        directions = np.random.default_rng([seed, t]).normal(size=(index.bits, index.width))
        index.directions.append(directions.tolist())
        index.cuts.append(np.median(sample @ directions.T, axis=0).tolist() if index.bits and len(sample) else [0.0] * index.bits)
    index.tables = until


def fit(train: DataFrame, path: str, features: str = "features", row_id: str = "row_id", label: str = "label", k: int = max(NEIGHBORS),
        recall: float = 0.95, bucket_rows: int = BUCKET_ROWS, seed: int = 467) -> NeighborIndex:
    """An index of all rows of `train` (id, 0/1 label, array of doubles), written under `path`.

    Tables are doubled until `RECALL_ROWS` rows, the same in every run, find the share
    `recall` of their exact k neighbours other than themselves, or `MOST_TABLES` are there; `recall` of the result
    is what was reached. Tables of up to `bucket_rows` rows are one bucket and exact.
    """
    spark = train.sparkSession
    scale = deviations(train, features)
    index = NeighborIndex(path, len(scale), scale, k, 0)
    rows = stage(_slim(_scaled(train, index, features, F.col(row_id).cast("long").alias("row_id"), F.col(label).cast("int").alias("label")), k), "vectors")
    n = rows.count()
    index.bits = max(0, math.ceil(math.log2(max(1, n / bucket_rows))))
    part = max(1, n // SAMPLE_ROWS)
    some = rows.filter(F.pmod(F.xxhash64("row_id"), F.lit(part)) == 0).orderBy(F.xxhash64("row_id"), "row_id")
    held = [r["x"] for r in some.limit(SAMPLE_ROWS).select("x").collect()]
    sample = np.array(held, float).reshape(len(held), index.width)
    probes_from = stage(some.limit(RECALL_ROWS).select("row_id", "label", F.col("x").alias("features")), "recall_rows")
    exact = None
    while True:
        before, until = index.tables, 1 if not index.bits else max(2, 2 * index.tables)
        _draw(index, sample, until, seed)
        _bucketed(rows, index, range(before, until), 0, ["row_id", "label"]).select(
            "table", "bucket", "row_id", "label", "x").write.mode("append").parquet(f"{path}/rows")
        if not index.bits:
            index.recall = 1.0
            break
        if exact is None:
            exact = stage(nearest(rows.select("row_id", "label", F.col("x").alias("features")), probes_from, k, skip_same_id=True).select(
                F.col("row_id").alias("_q"), F.col("neighbor").alias("_n")), "exact")
        found = _search(index, probes_from.select("row_id", F.col("features").alias("x")), k, skip_same_id=True)
        hits = exact.join(found, (F.col("_q") == F.col("row_id")) & (F.col("_n") == F.col("neighbor")), "left_semi").count()
        index.recall = hits / max(1, exact.count())
        if index.recall >= recall or until >= MOST_TABLES:
            break
    index.save(spark)
    return index


def _search(index: NeighborIndex, queries: DataFrame, k: int, skip_same_id: bool = False) -> DataFrame:
    """Neighbours of scaled queries (row_id, x), as `search` gives them."""
    spark = queries.sparkSession
    asked = stage(_bucketed(queries, index, range(index.tables), PROBES, ["row_id"]), "asked")
    stored = index.rows(spark)
    # Only buckets of over BUCKET_ROWS rows are listed: they are compared in several pieces.
    q = asked.groupBy("table", "bucket").agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("q_parts"))
    r = stored.groupBy("table", "bucket").agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("r_parts"))
    full = stage(q.join(r, ["table", "bucket"]).filter("q_parts > 1 or r_parts > 1"), "full_buckets")
    used = asked.select("table", "bucket").distinct()

    def pieces(df: DataFrame, own: str, other: str) -> DataFrame:
        joined = df.join(full, ["table", "bucket"], "left")
        one = F.coalesce(F.col(f"{own}_parts"), F.lit(1))
        rest = F.coalesce(F.col(f"{other}_parts"), F.lit(1))
        return joined.withColumn(f"{own}_part", F.pmod(F.xxhash64("row_id"), one)).withColumn(
            f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), rest - 1))).drop("q_parts", "r_parts")

    left = pieces(stored.join(used, ["table", "bucket"], "left_semi"), "r", "q")
    right = pieces(asked, "q", "r")
    keys = ["table", "bucket", "r_part", "q_part"]

    def compared(block: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        if block.empty or probes.empty:
            return pd.DataFrame(columns=["row_id", "distance", "neighbor", "neighbor_label"])
        x, y = np.stack(probes["x"].to_numpy()), np.stack(block["x"].to_numpy())
        ids, asked_ids = block["row_id"].to_numpy(), probes["row_id"].to_numpy()
        at, to, distance = closest(x, asked_ids if skip_same_id else None, y, ids, k)
        return pd.DataFrame({"row_id": asked_ids[at], "distance": distance, "neighbor": ids[to], "neighbor_label": block["label"].to_numpy()[to]})

    short = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        compared, "row_id bigint, distance double, neighbor bigint, neighbor_label int")
    # The same neighbour may come from several tables.
    once = short.groupBy("row_id", "neighbor").agg(F.min("distance").alias("distance"), F.min("neighbor_label").alias("neighbor_label"))
    order = Window.partitionBy("row_id").orderBy("distance", "neighbor")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "row_id", "distance", "neighbor", "neighbor_label", "rank")


def search(index: NeighborIndex, queries: DataFrame, k: int | None = None, features: str = "features", row_id: str = "row_id",
           skip_same_id: bool = False) -> DataFrame:
    """(row_id, distance, neighbor, neighbor_label, rank) of the k closest indexed rows of each query, ties by id.

    Every query is compared with the rows of `tables` * (1 + `PROBES`) buckets, so the work
    grows with the queries and not with queries times rows. k cannot exceed that of the index.
    """
    k = k or index.k
    if k > index.k:
        raise ValueError(f"the index was built for up to {index.k} neighbours")
    width = queries.select(F.max(F.size(features)).alias("m")).first()["m"]
    if width is not None and width != index.width:
        raise ValueError(f"the index has vectors of {index.width} components, the queries of {width}")
    return _search(index, _scaled(queries, index, features, F.col(row_id).cast("long").alias("row_id")), k, skip_same_id)


def fold_predictions(data: DataFrame, features: str = "features", row_id: str = "row_id", label: str = "label", ks=NEIGHBORS,
                     k: int = 10, fold: str = "fold", positive=1, path: str | None = None) -> DataFrame:
    """(setting, fold, row_id, obs, score) for every k in `ks`, as `search.fold_predictions` has it.

    Each fold is searched once, for the largest k, among all rows of the other folds, which
    also give the scale of the features. The search is exact: an index of each fold's rows
    would have to be built for a tenth of them as queries, and costs more than it saves.
    """
    spark = data.sparkSession
    path = path or scratch_path(spark, "neighbor_folds")
    marked = data.select(F.col(row_id).cast("long").alias("row_id"), (F.col(label) == F.lit(positive)).cast("int").alias("label"),
                         F.col(fold).alias("fold"), F.col(features).alias("features"))
    for i in range(k):
        train = marked.filter(F.col("fold") != i)
        scale = F.array(*[F.lit(s) for s in deviations(train, "features")])
        train, held = (df.withColumn("features", F.zip_with("features", scale, lambda v, s: v / s))
                       for df in (train, marked.filter(F.col("fold") == i)))
        neighbor_scores_by_k(nearest(train, held, max(ks)), ks).write.parquet(f"{path}/scores/held={i}")
    scores = spark.read.schema("row_id bigint, k int, score double").parquet(*[f"{path}/scores/held={i}" for i in range(k)])
    number = F.array_position(F.array(*[F.lit(int(x)) for x in ks]), F.col("k")) - 1
    seen = data.select(F.col(row_id).cast("long").alias("row_id"), F.col(label).alias("obs"), F.col(fold).cast("int").alias("fold"))
    return scores.join(seen, "row_id").select(number.cast("int").alias("setting"), "fold", "row_id", "obs", "score")
