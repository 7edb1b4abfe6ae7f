"""Vector codes and whitening against plain numpy, on whole tables and on awkward rows."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonloom.llm import codes, entries, vectors, whitening

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
NAN, INF = float("nan"), float("inf")


def plain_codes(ids, grid, labels, parts=8, entries_=16, rounds=6):
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, grid[i].tolist()))
    cuts = codes.cuts(grid.shape[1], parts)
    books = [grid[order[:entries_], a:b].copy() for a, b in cuts]

    def assign():
        gaps = [((grid[:, None, a:b] - book[None]) ** 2).sum(2) for (a, b), book in zip(cuts, books, strict=True)]
        return [g.argmin(1) for g in gaps], sum(g.min(1) for g in gaps)

    for _ in range(rounds):
        for book, (a, b), number in zip(books, cuts, assign()[0], strict=True):
            for e in range(len(book)):
                if (number == e).any():
                    book[e] = grid[number == e, a:b].sum(0) // (number == e).sum()
    numbers, error = assign()
    text = ["".join(f"{n[i]:02x}" for n in numbers) for i in range(len(ids))]
    sums = {y: sum(int(e) for e, z in zip(error, labels, strict=True) if z == y) for y in set(labels)}
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return [(ids[i], text[i], int(error[i]), sums[labels[i]]) for i in range(len(ids))], digest


def plain_whitened(grid, k=16):
    distinct = np.unique(grid, axis=0)
    n, s = len(distinct), distinct.sum(0)
    z = distinct - s / n
    values, vecs = np.linalg.eigh(z.T @ z / n)
    keep = np.argsort(-values)[:k]
    return n, ((n * grid - s) ** 2).sum(1), (grid - s / n) @ vecs[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()


def awkward(spark, d=16):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=d) * 3).tolist(), i % 3 if i % 5 else None) for i in range(60)]
    rows += [(100 + i, rows[7][1], 1) for i in range(40)]  # a hot vector
    rows += [rows[3], rows[3], (None, rows[4][1], None), (None, (rng.normal(size=d)).tolist(), 2)]
    bad = [(200, None, 1), (201, [], 1), (202, [NAN] + [0.0] * (d - 1), 1), (203, [INF] + [0.0] * (d - 1), 1),
           (204, [None] + [0.0] * (d - 1), 1), (205, [1.0] * (d - 2), 1), (206, [-INF] * d, None), (207, [1e6] * d, None)]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, label int")
    clash = {c: F.lit("x") for c in ("key", "x", "code", "error", "_label", "_place", "block", "deviation", "component")}
    return rows, table.withColumns(clash).repartition(5)


def test_usable_vectors(spark):
    rows, table = awkward(spark)
    good, length = vectors.usable(table, "embedding")
    assert length == 16 and good.count() == len(rows)
    assert vectors.usable(table.limit(0), "embedding")[1] == 0


@pytest.mark.parametrize("memory", [codes.MEMORY, 3])
def test_memoised_boxes_find_the_nearest_entry(memory):
    rng = np.random.default_rng(memory)
    entries_ = rng.integers(-3000, 3000, (16, 4))
    entries_[9] = entries_[2]  # a tie goes to the lower number
    memo = codes.Memo(entries_, 512, memory)
    for _ in range(4):
        parts = rng.integers(-3500, 3500, (500, 4))
        gaps = ((parts[:, None] - entries_[None]) ** 2).sum(2)
        number, best = memo.nearest(parts)
        assert (number == gaps.argmin(1)).all() and (best == gaps.min(1)).all() and len(memo.held) <= memory
    cells = np.unique(parts // 512, axis=0)
    assert memo.undominated(cells).sum(1).mean() < 8  # over half of the entries are never compared


@needs_tables
def test_vector_codes_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    grid = np.floor(np.array([r.embedding for r in rows], np.float64) * 4096).astype(np.int64)
    want, digest = plain_codes([r.vec_id for r in rows], grid, [r.label for r in rows])
    got = entries.op11_vector_codes(spark, FOLDER).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == want and {r.codebooks_sha256 for r in got} == {digest}


@pytest.mark.parametrize("parts", [8, 5])
def test_vector_codes_of_awkward_rows(spark, parts):
    rows, table = awkward(spark)
    grid = np.floor(np.array([r[1] for r in rows]) * 4096).astype(np.int64)
    want, digest = plain_codes([r[0] for r in rows], grid, [r[2] for r in rows], parts)
    coded, books = codes.compress(table, parts=parts)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()), key=str) == sorted(want, key=str)
    assert books.sha256() == digest
    few, books = codes.compress(table.filter("vec_id < 3"))
    assert few.count() == 3 and {len(b) for b in books.entries} == {3} and few.agg(F.sum("error")).first()[0] == 0
    assert codes.compress(table.limit(0))[0].count() == 0


def check_whitened(got, ids, grid, k):
    n, gaps, values, shares = plain_whitened(grid, k)
    assert len(got) == len(ids) * values.shape[1]
    rows = {}
    for r in got:
        rows.setdefault(r.component, []).append((r.vec_id, r.deviation, r.whitened))
        assert r.n == n and abs(r.explained - shares[r.component - 1]) < 1e-9 and r.identity_error < 1e-8
    for c, held in rows.items():
        want = list(zip(ids, gaps.tolist(), values[:, c - 1], strict=True))
        order = lambda r: (str(r[0]), r[1])
        held, want = sorted(held, key=order), sorted(want, key=order)
        assert [h[:2] for h in held] == [w[:2] for w in want]
        a, b = np.array([h[2] for h in held]), np.array([w[2] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


@needs_tables
def test_whitening_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    grid = np.floor(np.array([r.embedding for r in rows], np.float64) * 64).astype(np.int64) + 1_000_000
    check_whitened(entries.op13_embedding_whitening(spark, FOLDER).collect(), [r.vec_id for r in rows], grid, 16)


def test_whitening_of_awkward_rows(spark):
    rows, table = awkward(spark)
    grid = np.floor(np.array([r[1] for r in rows]) * 64).astype(np.int64) + 1_000_000
    check_whitened(whitening.whiten(table, components=5).collect(), [r[0] for r in rows], grid, 5)
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.filter("vec_id >= 100 and vec_id < 140")).count() == 0  # one distinct vector
    flat = spark.createDataFrame([(i, [i / 4.0, 1.0, -i / 4.0]) for i in range(50)], "vec_id int, embedding array<float>")
    got = whitening.whiten(flat).collect()
    assert {r.component for r in got} == {1} and len(got) == 50 and max(r.identity_error for r in got) < 1e-8


def test_blocks_keep_every_row_once(spark):
    rows = spark.range(1000).select("id", F.array(F.col("id"), F.col("id") * 2).alias("x")).repartition(7)
    laid = whitening.blocks(rows, 2, 64, ("id",))
    held = [(r.block, list(r.id), np.frombuffer(r.x, np.int64).reshape(-1, 2)) for r in laid.table.collect()]
    assert len({b for b, _, _ in held}) == len(held) and max(b for b, _, _ in held) < laid.count
    assert sorted(i for _, ids, _ in held for i in ids) == list(range(1000))
    assert all((x == np.array([[i, 2 * i] for i in ids])).all() and len(ids) <= 64 for _, ids, x in held)
