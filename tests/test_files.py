"""Readers and writers."""

from types import SimpleNamespace

import pytest

from codonloom.session import scratch_path, stage
from codonloom.sources import readers, schemas, sinks

SCHEMA = schemas.fields(a="string", b="bigint", c="double")


def table(spark):
    return spark.createDataFrame([("x", 1, 0.5), ("y z", None, None), (None, 3, 1.5)], SCHEMA)


def test_tsv_keeps_missing(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_tsv(table(spark).coalesce(1), path)
    lines = "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert "y z\tNA\tNA" in lines and '"' not in lines
    assert readers.read_tsv(spark, path, SCHEMA).exceptAll(table(spark)).count() == 0


def test_bad_number_is_reported(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\tc\nx\tnot-a-number\t1\n")
    with pytest.raises(Exception):
        readers.read_tsv(spark, str(tmp_path / "t.tsv"), SCHEMA).collect()


def test_short_header(spark, tmp_path):
    (tmp_path / "h.txt").write_text(
        "Hallmark_name\tProcess_category\tDescription\tNumber_of_founder_sets\tNumber_of_genes\n"
        "1\tAPICAL\tcellular component\tApical's junction\t37\t200\n2\tHYPOXIA\tpathway\tlow oxygen; HIF1A\t87\t44\n")
    got = readers.read_hallmark_categories(spark, str(tmp_path / "h.txt")).orderBy("row_no").collect()
    assert [(r.Hallmark_name, r.Number_of_genes) for r in got] == [("APICAL", 200), ("HYPOXIA", 44)]


def test_whitespace_fields(spark, tmp_path):
    (tmp_path / "w.txt").write_text("a b   c\nx  1\t0.5\n  y NA NaN\n")
    got = readers.read_whitespace(spark, str(tmp_path / "w.txt"), SCHEMA).orderBy("a").collect()
    assert [tuple(r) for r in got] == [("x", 1, 0.5), ("y", None, None)]


def test_whitespace_skips_one_header_a_file(spark, tmp_path):
    texts = schemas.fields(a="string", b="string")
    for name in ("one", "two"):
        (tmp_path / f"{name}.txt").write_text(f"a b\n{name} 2\na b\n")
    got = readers.read_whitespace(spark, str(tmp_path / "*.txt"), texts).collect()
    assert sorted(tuple(r) for r in got) == [("a", "b"), ("a", "b"), ("one", "2"), ("two", "2")]


@pytest.mark.parametrize("line", ["3 4 5", "7"])
def test_whitespace_reports_other_field_counts(spark, tmp_path, line):
    (tmp_path / "w.txt").write_text(f"a b\n1 2\n{line}\n")
    with pytest.raises(Exception, match="not 2 fields"):
        readers.read_whitespace(spark, str(tmp_path / "w.txt"), schemas.fields(a="string", b="string")).collect()


def test_many_files(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.tsv").write_text(f"a\tb\tc\n{name}\t1\t2\n")
    got = readers.read_many(spark, str(tmp_path / "*.tsv"), SCHEMA).orderBy("a").collect()
    assert [(r.a, r.file_name) for r in got] == [("one", "one.tsv"), ("two", "two.tsv")]


def test_batches_hold_at_most_the_size(spark, tmp_path):
    ids = spark.range(1000).selectExpr("concat('P', id) as acc")
    sinks.write_batches(ids.union(ids), "acc", str(tmp_path / "b"), 300)
    batches = sorted((tmp_path / "b").glob("batch_id=*"))
    sizes = [sum(len(f.read_text().split()) for f in b.glob("*.csv")) for b in batches]
    assert sizes == [300, 300, 300, 100]


def test_gene_sets_and_symbols(spark):
    library = spark.createDataFrame([("H", "T", 1), ("C2", "U", 2)], schemas.GENE_SETS)
    assert [tuple(r) for r in readers.gene_sets(library).collect()] == [("T", 1)]
    symbols = spark.createDataFrame([("A", 1, "P1, P2"), ("B", 2, None), ("C", 3, "")], schemas.SYMBOL_MAP)
    assert [r.uniprot for r in readers.symbol_map(symbols).orderBy("query").collect()] == [["P1", "P2"], None, []]


def test_stage_uses_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(base)
    staged = stage(table(spark))
    assert staged.inputFiles()[0].removeprefix("file://").startswith(base) and staged.count() == 3


def test_folder_when_none_is_named():
    session = SimpleNamespace(conf={"spark.sql.warehouse.dir": "/shared/warehouse"})
    first, second = scratch_path(session, "x"), scratch_path(session, "x")
    assert first != second and first.startswith("/shared/warehouse/codonloom/")


def test_final_table_shape():
    assert len(schemas.ALL_FEATURES) == 51 and len(schemas.GENE_FEATURES) == 47
    assert len(schemas.NUMERIC_FEATURES) == 29 and len(schemas.BINARY_FEATURES) == 22
    assert len(schemas.MUTATION_COLUMNS) == 45


def test_values_with_separators_are_escaped_or_refused(spark, tmp_path):
    rows = [(1, "a\tb"), (2, "line\nbreak\r"), (3, "back\\\\slash\\t"), (4, None), (5, "plain \\")]
    df = spark.createDataFrame(rows, "id int, text string")
    with pytest.raises(Exception, match="column text holds a separator"):
        sinks.write_tsv(df, str(tmp_path / "refused"))
    sinks.write_tsv(df, str(tmp_path / "escaped"), escape=True)
    back = readers.unescaped(readers.read_tsv(spark, str(tmp_path / "escaped"), df.schema))
    assert sorted((r.id, r.text) for r in back.collect()) == rows
    spaced = spark.createDataFrame([("a b",)], "v string")
    with pytest.raises(Exception, match="separator"):
        sinks.write_spaced(spaced, str(tmp_path / "spaced"))


def test_malformed_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "one.tsv").write_text("id\tname\n1\ta\nx\tb\n3\n4\td\te\n5\tNA\n")
    (tmp_path / "two.tsv").write_text("id\tname\n6\tf\n\n7.5\tg\n")
    schema = schemas.fields(id="int", name="string")
    good, bad = readers.read_with_rejects(spark, [str(tmp_path / "one.tsv"), str(tmp_path / "two.tsv")], schema)
    assert sorted((r.id, r.name) for r in good.collect()) == [(1, "a"), (5, None), (6, "f")]
    assert sorted((r.file_name, r.line) for r in bad.collect()) == [
        ("one.tsv", "3"), ("one.tsv", "4\td\te"), ("one.tsv", "x\tb"), ("two.tsv", "7.5\tg")]


def test_short_header_files_are_read_strictly(spark, tmp_path):
    (tmp_path / "named.txt").write_text("name\tn\n1\ta\t2\n2\tb\tx\n")
    frame = readers.read_row_named(spark, str(tmp_path / "named.txt"), schemas.fields(row="string", name="string", n="int"))
    with pytest.raises(Exception, match="MALFORMED"):
        frame.collect()
