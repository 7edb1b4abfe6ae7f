"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

A row number x below N is written as (x div b, x mod b) with a * b >= N just barely; each
round adds a keyed hash of one half to the other, modulo a or b in turn. Results of N or
more are permuted again (cycle walking), which ends below N because the rounds are a
bijection of a * b numbers. Shard and slot of a row are then plain arithmetic.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
_SLICE_ROWS = 50_000


def _domain(n: int) -> tuple[int, int, int]:
    """Sides of the rectangle and the number of walks after which none can be left.

    A cycle meets at most a * b - N numbers of N or more in a row. Where that is over 64,
    N is in the thousands, a walk stays outside with probability below 1 / sqrt(N), and 64
    of them in a row do not happen.
    """
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    return a, b, min(a * b - n + 1, 64)


def permuted(number: str, n: int, seed: int) -> Column:
    """Place in the shuffle `seed` of the row whose number (from 0, below n) is in column `number`."""
    a, b, walks = _domain(n)

    def step(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        noise = F.xxhash64(F.concat_ws("|", F.lit(seed), i % ROUNDS, F.when(i % 2 == 0, right).otherwise(left)))
        l2 = F.when(i % 2 == 0, F.pmod(left + F.pmod(noise, F.lit(a)), F.lit(a))).otherwise(left)
        r2 = F.when(i % 2 == 1, F.pmod(right + F.pmod(noise, F.lit(b)), F.lit(b))).otherwise(right)
        moved = F.struct(l2.cast("long").alias("l"), r2.cast("long").alias("r"),
                         ((i % ROUNDS == ROUNDS - 1) & (l2 * b + r2 < n)).alias("done"))
        return F.when(state["done"], state).otherwise(moved)

    start = F.struct(F.expr(f"`{number}` div {b}").alias("l"), (F.col(number) % b).cast("long").alias("r"),
                     F.lit(False).alias("done"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(walks * ROUNDS - 1)), start, step)
    return end["l"] * b + end["r"]


def locate(number: int, n: int, n_shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of one row number, without any table."""
    a, b, _ = _domain(n)
    left, right = divmod(number, b)
    while True:
        for i in range(ROUNDS):
            word = xxhash.xxh64_intdigest(f"{seed}|{i}|{right if i % 2 == 0 else left}", 42)
            word -= (word >> 63) << 64
            if i % 2 == 0:
                left = (left + word % a) % a
            else:
                right = (right + word % b) % b
        if left * b + right < n:
            return (left * b + right) % n_shards, (left * b + right) // n_shards


def number_rows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """A gapless `row_number_` from 0 that depends on the key values alone.

    Rows are ordered by a hash of the keys. The leading hash digits cut the table into
    slices of some 50,000 rows; slice counts give each slice its first number. Rows that
    agree in all keys are interchangeable.
    """
    digits = max(1, math.ceil(math.log(max(1, n / _SLICE_ROWS), 16)))
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])))
    sliced = hashed.withColumn("_slice", F.substring("_hash", 1, digits))
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))
    # One row per slice, so the running sum handles N / 50,000 * 16 slim rows at most.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_slice").orderBy("_hash", *keys)
    ranked = sliced.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, "_slice").withColumn("row_number_", F.col("_start") + F.col("_rank")).drop(
        "_slice", "_hash", "_start", "_rank")


def shard(df: DataFrame, keys: list[str], n_shards: int, seed: int = 11) -> DataFrame:
    """Rows with `shard` and `slot`; shard sizes differ by one at most, slots are gapless.

    An empty table stays empty; null keys are values like any other.
    """
    n = df.count()
    numbered = number_rows(df, keys, n)
    place = permuted("row_number_", n, seed)
    return numbered.withColumn("_place", place).select(
        *df.columns, (F.col("_place") % n_shards).cast("int").alias("shard"),
        F.expr(f"cast(_place div {n_shards} as bigint)").alias("slot"))
