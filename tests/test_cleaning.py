"""Hand-made cases for parsing, filters, joins and reshaping."""

from pyspark.sql import functions as F

from codonloom.functions import text
from codonloom.functions.numeric import finite, row_mean, to_number
from codonloom.operators import clean, graph, labels, relate, reshape, scores, summarize
from codonloom.plans import assemble


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression).first()[0]


def test_protein_change(spark):
    df = spark.createDataFrame([("p.V600E",), ("p.V600fs*3",)], "HGVSp_Short string")
    parsed = clean.split_protein_change(df)
    assert ("V600E", "600", "V", "E") in [
        (r.HGVSp_Short, r.Position, r.First_amino_acid, r.Second_amino_acid) for r in parsed.collect()]
    kept = clean.all_digits(parsed, "Position").collect()
    assert [r.HGVSp_Short for r in kept] == ["V600E"]


def test_accession_length(spark):
    df = spark.createDataFrame([("P15056",), ("P15056,Q9Y243",), ("A0A024R1R8",), (None,)], "a string")
    assert rows(clean.of_length(df, "a", 6)) == [("P15056",)]


def test_variant_types(spark):
    df = spark.createDataFrame([(x,) for x in ("SNP", "DNP", "DEL", "ONP", "TNP", "INS", None)], "t string")
    assert rows(clean.excluding(df, "t", clean.MULTI_BASE_TYPES), "t") == [("INS",), ("SNP",)]


def test_class_contains(spark):
    df = spark.createDataFrame([("Missense_Mutation",), ("xMissense_Mutationx",), ("Silent",)], "c string")
    assert clean.contains(df, "c", "Missense_Mutation").count() == 2


def test_self_pairs(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("A", None)], "P1 string, P2 string")
    assert rows(clean.without_self_pairs(df), F.col("P2").asc_nulls_last()) == [("A", "B"), ("A", None)]
    none = spark.createDataFrame([("A", "B")], "P1 string, P2 string")
    assert clean.without_self_pairs(none).count() == 1


def test_degree_counts_one_end(spark):
    edges = spark.createDataFrame([("A", "C"), ("B", "C"), ("B", "C"), ("C", "C")], "P1 string, P2 string")
    ids = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "From string, To bigint")
    pairs = graph.interaction_pairs(edges, ids)
    assert rows(graph.degree(pairs)) == [(3, 2)]
    assert [tuple(r) for r in graph.partner_strings(pairs).select("gene", "members", "times").collect()] == [(3, "1,2", 2)]
    assert rows(graph.degree(graph.interaction_pairs(edges, ids, "p1")), "gene") == [(1, 1), (2, 1)]
    assert rows(graph.degree(graph.interaction_pairs(edges, ids, "both")), "gene") == [(1, 1), (2, 1), (3, 2)]
    assert rows(graph.query_groups(pairs), "gene") == [(3, 1), (3, 2), (3, 3)]


def test_duplicate_map_fans_out(spark):
    edges = spark.createDataFrame([("A", "B")], "P1 string, P2 string")
    ids = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "From string, To bigint")
    assert rows(graph.degree(graph.interaction_pairs(edges, ids))) == [(3, 2)]


def test_genomic_change(spark):
    df = spark.createDataFrame(
        [("chr7:g.140453136A>T/c.1799T>A/p.V600E",), ("chrUn:x",), (None,)], "c string")
    got = [tuple(r) for r in df.select(*text.genomic_change("c")).collect()]
    assert got[0] == ("7", "140453136", "A", "T")
    assert got[1][1:] == (None, None, None) and got[2] == (None,) * 4


def test_coordinate_filter(spark):
    bench = spark.createDataFrame(
        [("G", "V1E", "Non-neutral"), ("G", "V2E", "neutral"), ("G", "V3E", None)], "gene string, mutation string, label string")
    places = spark.createDataFrame([
        ("G:p.V1E", "chr7:g.5A>T/c.1/p.V1E", "+"), ("G:p.V2E", "chr7:g.12345678_12345680delinsAA/c.1/p.x", "+"),
        ("G:p.V3E", "chrUn_1:g.5A>T/c.1/p.V3E", "+")], "input string, coordinates string, strand string")
    got = assemble.benchmark_positions(bench, places).collect()
    assert [(r.Mutation, r.Start_Position, r.End_Position) for r in got] == [("V1E", "5", "5")]
    recoded = assemble.recode_benchmark_label(bench).orderBy("mutation").collect()
    assert [r.label for r in recoded] == ["driver", "passenger", None]


def test_parentheses_and_numbers(spark):
    df = spark.createDataFrame([("benign(0.05)",), ("0.3",), ("-",), ("abc",), ("NaN",), (None,)], "s string")
    got = [r[0] for r in df.select(to_number(text.in_parentheses("s"))).collect()]
    assert got == [0.05, 0.3, None, None, None, None]


def test_scalar_text(spark):
    assert one(spark, "HALLMARK_HYPOXIA", text.drop_prefix("x", 9)) == "HYPOXIA"
    assert one(spark, "ab", text.drop_suffix("x", 3)) == "ab"
    assert one(spark, None, text.paste("x", F.lit("a"), sep="_")) == "NA_a"
    assert one(spark, "BRAF_V600_x", text.split_pair("x", "_")[1]) == "V600_x"
    assert one(spark, "BRAF", text.split_pair("x", "_")[1]) == ""
    assert one(spark, "1 bad name", text.safe_name("x")) == "X1.bad.name"
    assert one(spark, "if", text.safe_name("x")) == "if."
    assert one(spark, float("inf"), finite("x"), "double") is None


def test_row_mean(spark):
    df = spark.createDataFrame([(0.2, None, 0.4), (None, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(row_mean(["a", "b", "c"])).collect()]
    assert abs(got[0] - 0.3) < 1e-12 and got[1] is None


def test_max_collapse_and_average(spark):
    df = spark.createDataFrame(
        [("v", "0.1", "-", "x(0.2)", "0.4", "-"), ("v", "0.7", "-", "-", "-", "-")],
        "Uploaded_variation string, SIFT string, Condel string, PolyPhen string, a_rankscore string, b_rankscore string")
    got = scores.variant_scores(df).first()
    assert (got.sift, got.polyphen, got.condel, got.average_rank) == (0.7, 0.2, None, 0.4)
    assert scores.rank_columns(df, df.drop("b_rankscore")) == ["a_rankscore"]


def test_list_to_flags(spark):
    sheet = spark.createDataFrame([("P1", "a,b, a"), ("P2", "z"), ("P3", None)], "ACC string, m string")
    key = spark.createDataFrame([("a", "X", "S"), ("b", "Y", "T"), ("a", "X", "T")], "PTM string, d string, r string")
    got = reshape.list_to_flags(sheet, "ACC", "m", key, "PTM", "d", {"X": "x", "Y": "y"})
    assert rows(got) == [("P1", 1, 1)]
    names = {f"{d}_{r}": f"{d}_{r}".lower() for d in "XY" for r in "ST"}
    specific = reshape.list_to_flags(sheet, "ACC", "m", key, "PTM", reshape.composite("d", "r"), names)
    assert rows(specific) == [("P1", 1, 1, 0, 1)]


def test_pivot_with_missing_category(spark):
    df = spark.createDataFrame([("g", None), ("h", "a"), ("h", "a")], "k string, c string")
    assert rows(reshape.category_flags(df, "k", "c", {"a": "a"}, "na_hallmarks"), "k") == [("g", 0, 1), ("h", 1, 0)]
    assert rows(reshape.category_counts(df, "k", "c", {"a": "a"}, "na"), "k") == [("g", 0, 1), ("h", 2, 0)]


def test_codon_labels(spark):
    muts = spark.createDataFrame(
        [("BRAF", "p.V600E"), ("BRAF", "p.V600K"), ("BRAF", "p.V601E")], "Hugo_Symbol string, HGVSp_Short string")
    hot = labels.codon_labels(spark.createDataFrame([("BRAF_V600",), ("BRAF_V600",)], "codon_id string"))
    keyed = labels.with_codon_key(clean.split_protein_change(muts))
    got = labels.label_by_codon(keyed, hot).orderBy("HGVSp_Short").collect()
    assert [r.labels_driver_mutation for r in got] == [1, 1, 0]
    assert labels.label_by_codon(keyed, hot, dedup=False).count() == 5


def test_missing_keys_match(spark):
    x = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    y = spark.createDataFrame([(1, "c"), (None, "d")], "k int, w string")
    assert relate.natural_join(x, y).count() == 2
    assert relate.merge(x, y, "k", match_missing=False).count() == 1
    same = relate.merge(x, x, "k")
    assert same.columns == ["k", "v_x", "v_y"]


def test_first_accession(spark):
    df = spark.createDataFrame(
        [("MET", "Q2", 36), ("MET", "P1", 35), ("SMO", "Q9", 53)], "symbol string, Entry string, row_no int")
    assert rows(assemble.first_accession(df), "symbol") == [("MET", "P1"), ("SMO", "Q9")]


def test_symbol_mapping_keeps_single_accessions(spark):
    muts = spark.createDataFrame([("A", 1), ("A", 1), ("B", 2), ("C", 3), ("D", 4)], "Hugo_Symbol string, n int")
    symbols = spark.createDataFrame(
        [("A", 10, ["P"]), ("B", 11, ["P", "Q"]), ("C", None, ["R"]), ("D", 12, None)],
        "query string, entrezgene bigint, uniprot array<string>")
    assert rows(assemble.map_symbols(muts, symbols)) == [("A", 1, 10, "P")]


def test_summaries(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    assert rows(summarize.frequencies(df, "x"), "x") == [("a", 2), ("b", 1)]
    assert rows(summarize.frequency_total(summarize.frequencies(df, "x"))) == [(3,)]
    assert rows(summarize.duplicate_check(df)) == [(4, 3, 1)]
    assert rows(relate.with_membership(df, "x", df.limit(2), "x", "hit"), F.col("x").asc_nulls_last()) == [
        ("a", 1), ("a", 1), ("b", 0), (None, 0)]


def test_unique_names(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id bigint, n string")
    got = clean.with_unique_names(df, "n", ["id"], "u")
    assert sorted(r.u for r in got.collect()) == ["a.b", "a.b.1", "c"]


def test_row_steps_run_on_a_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("p.V600E", "P15056"), ("p.V600fs*3", "P15056")], "HGVSp_Short string, SWISSPROT string")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    cleaned = clean.all_digits(clean.split_protein_change(stream), "Position")
    run = cleaned.writeStream.format("parquet").option("path", sink).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.read.parquet(sink).count() == 1


def test_numeric_summary(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    got = summarize.numeric_summary(df, ["x"]).first()
    assert (got.n, got.n_missing, got.minimum, got.median, got["mean"], got.maximum) == (4, 1, 1.0, 2.0, 2.5, 4.0)
