"""Stages inside a scope go with it."""

import os

import pytest

from codonloom.session import scratch_scope, stage


def files(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/codonloom"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_only_what_is_kept_remains(spark):
    before = files(spark)
    with scratch_scope(spark) as scope:
        first = stage(spark.range(10), "first")
        with scratch_scope(spark) as inner:
            second = stage(first.filter("id > 3"), "second")
            kept = inner.keep(second.filter("id > 5"), "inner")
        assert {n.rsplit("-", 1)[0] for n in files(spark) - before} == {"first", "inner"}
        result = scope.keep(kept, "result")
    assert {n.rsplit("-", 1)[0] for n in files(spark) - before} == {"result"}
    assert sorted(r.id for r in result.collect()) == [6, 7, 8, 9]


def test_a_failed_scope_leaves_nothing(spark):
    before = files(spark)
    with pytest.raises(ZeroDivisionError):
        with scratch_scope(spark):
            stage(spark.range(3), "lost")
            raise ZeroDivisionError
    assert files(spark) == before
    stage(spark.range(3), "outside")
    assert len(files(spark) - before) == 1
