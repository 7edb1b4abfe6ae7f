"""Feature tables from raw inputs: the steps users call."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonloom.functions.text import genomic_change, paste, variant_key
from codonloom.operators import clean
from codonloom.operators.enrich import best_terms, enrichment, term_categories
from codonloom.operators.graph import degree, interaction_pairs, query_groups
from codonloom.operators.labels import codon_labels, label_by_codon, with_codon_key
from codonloom.operators.ordering import first_per_key, sort_genomic
from codonloom.operators.relate import lookup, spread_join
from codonloom.operators.reshape import category_flags, composite, list_to_flags
from codonloom.operators.scores import variant_scores
from codonloom.session import side_by_side, stage
from codonloom.sources import schemas


def clean_missense(mutations: DataFrame, distinct: bool = True) -> DataFrame:
    """Distinct missense substitutions with a single accession and a numeric position.

    The filters come first, so that only surviving rows are shuffled; a caller that
    removes repeats later on fewer columns turns `distinct` off.
    """
    missense = clean.contains(mutations, "Variant_Classification", "Missense_Mutation")
    parsed = clean.split_protein_change(missense)
    single = clean.of_length(parsed, "SWISSPROT", 6)
    numbered = clean.all_digits(single, "Position")
    single_base = clean.excluding(numbered, "Variant_Type", clean.MULTI_BASE_TYPES)
    return single_base.distinct() if distinct else single_base


def with_degree(mutations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Interaction degree of each mutation's gene; genes without partners drop out."""
    counts = stage(degree(pairs).withColumnRenamed("times", schemas.DEGREE), "degree")
    return spread_join(mutations, counts, "Entrez_Gene_Id", "gene")


def process_flags(pairs: DataFrame, sets: DataFrame, categories: DataFrame) -> DataFrame:
    """One 0/1 column per process category for each gene, from its group's best term.

    `pairs` is read by three branches: stage it first when it is costly to compute.
    """
    groups = query_groups(pairs)
    best = best_terms(groups, enrichment(groups, sets, adjusted=False))
    named = term_categories(best, categories)
    names = {c: schemas.snake(c) for c in schemas.PROCESS_CATEGORIES}
    return category_flags(named, "group", "Process_category", names, schemas.NO_CATEGORY)


def modification_flags(sheet: DataFrame, key: DataFrame, organism: str = "human") -> DataFrame:
    """One 0/1 column per modification for each protein."""
    names = {m: schemas.snake(m) for m in schemas.MODIFICATIONS}
    rows = clean.equal_to(sheet, "ORGANISM", organism)
    return list_to_flags(rows, "ACC", "MODIFICATION_SUMMARY", key, "PTM", "Description", names)


def residue_flags(sheet: DataFrame, key: DataFrame, residues, organism: str = "human") -> DataFrame:
    """One 0/1 column per modification and residue for each protein."""
    names = {f"{m}_{r}": f"{schemas.snake(m)}_{r.lower()}" for m in schemas.MODIFICATIONS for r in residues}
    rows = clean.equal_to(sheet, "ORGANISM", organism)
    category = composite("Description", "Amino_acid_by_code")
    return list_to_flags(rows, "ACC", "MODIFICATION_SUMMARY", key, "PTM", category, names)


def ratio_features(table: DataFrame) -> DataFrame:
    return table.select("gene", *schemas.RATIO_FEATURES)


def with_variant_key(df: DataFrame, reference: str = "Reference_Allele",
                     alternative: str = "Tumor_Seq_Allele2") -> DataFrame:
    key = variant_key("Chromosome", "Start_Position", reference, alternative)
    return df.withColumn("variant_key", key)


def annotation_request(df: DataFrame, reference: str = "Reference_Allele",
                       alternative: str = "Tumor_Seq_Allele2") -> DataFrame:
    """Distinct variants in genomic order, in the column order annotation tools read."""
    request = df.select(
        "Chromosome", "Start_Position", "End_Position",
        paste(reference, alternative, sep="/").alias("allele"), "Strand",
    ).distinct()
    return sort_genomic(request)


@dataclass
class GeneInputs:
    """Inputs of the gene features, which all feature tables share."""

    edges: DataFrame
    id_map: DataFrame
    sets: DataFrame
    categories: DataFrame
    sheet: DataFrame
    key: DataFrame
    ratios: DataFrame
    genes: DataFrame | None = None  # what `gene_columns` returns, where it is there already
    proteins: DataFrame | None = None  # what `modification_flags` returns, likewise


def gene_columns(inputs: GeneInputs) -> DataFrame:
    """Interaction degree and process flags of every gene with partners.

    The interaction pairs feed four branches and are staged once.
    """
    pairs = stage(interaction_pairs(inputs.edges, inputs.id_map), "pairs")
    return degree(pairs).withColumnRenamed("times", schemas.DEGREE).join(
        process_flags(pairs, inputs.sets, inputs.categories), F.col("gene") == F.col("group")).drop("group")


def with_written_features(inputs: GeneInputs) -> GeneInputs:
    """The same inputs with their gene and protein columns written, for several tables to read."""
    genes, proteins = side_by_side(
        inputs.edges.sparkSession, lambda: stage(gene_columns(inputs), "genes"),
        lambda: stage(modification_flags(inputs.sheet, inputs.key), "proteins"))
    return replace(inputs, genes=genes, proteins=proteins)


def gene_features(keys: DataFrame, inputs: GeneInputs) -> DataFrame:
    """The 47 gene and protein columns of every (gene_id, accession, symbol) in `keys`, complete rows only.

    As small as the list of genes. Keys whose gene has no partners, whose protein is not
    listed or whose symbol lacks a ratio drop out.
    """
    genes = inputs.genes if inputs.genes is not None else gene_columns(inputs)
    proteins = inputs.proteins if inputs.proteins is not None else modification_flags(inputs.sheet, inputs.key)
    table = spread_join(keys, genes, "gene_id", "gene")
    table = spread_join(table, proteins, "accession", "ACC")
    return clean.complete_rows(spread_join(table, ratio_features(inputs.ratios), "symbol", "gene"))


def with_gene_features(base: DataFrame, keys: DataFrame, inputs: GeneInputs, by: dict[str, str]) -> DataFrame:
    """Add the 47 gene and protein columns to rows, `by` maps their columns to those of `keys`.

    These are the wide columns: join them last, after everything that only needs keys. They
    come together for every key first (see `gene_features`), so that rows move and widen once.
    """
    features = gene_features(keys, inputs).select(*by.values(), *schemas.GENE_FEATURES)
    return spread_join(base, features, list(by), list(by.values()))


def complete_table(table: DataFrame, *extra: str) -> DataFrame:
    """Columns of a feature table, complete rows only; its gene columns have no missing values by now."""
    rows = table.select("mutation", "variant_key", *schemas.ALL_FEATURES, schemas.LABEL, *extra)
    return clean.complete_rows(rows, ["mutation", "variant_key", *schemas.VARIANT_SCORES, schemas.LABEL, *extra])


def training_table(mutations: DataFrame, edges: DataFrame, id_map: DataFrame, sets: DataFrame,
                   categories: DataFrame, sheet: DataFrame, key: DataFrame, ratios: DataFrame,
                   raw_scores: DataFrame, hotspots: DataFrame, dedup: bool = True, ranks=None,
                   shared: GeneInputs | None = None) -> DataFrame:
    """Mutations with all features and the codon label, complete rows only.

    Repeats of a variant collapse before anything is joined, on the few columns the joins
    need. Scores and label come next, while rows are narrow, and the gene columns last, where
    only genes and proteins can be hot keys and the joins are spread. `ranks` are the rank
    columns to average (all there are, if not given). `shared` stands for the gene inputs
    where other tables read them too (see `with_written_features`).
    """
    base = with_variant_key(clean_missense(mutations, distinct=False), "Tumor_Seq_Allele1")
    base = with_codon_key(base).select(
        "Hugo_Symbol", "Entrez_Gene_Id", "SWISSPROT", "variant_key",
        F.col("codon_id").alias("mutation")).distinct()
    table = lookup(base, clean.complete_rows(variant_scores(raw_scores, ranks)), "variant_key", "Uploaded_variation", "inner")
    table = label_by_codon(table, codon_labels(hotspots), dedup, key="mutation")
    inputs = shared or GeneInputs(edges, id_map, sets, categories, sheet, key, ratios)
    by = {"Entrez_Gene_Id": "gene_id", "SWISSPROT": "accession", "Hugo_Symbol": "symbol"}
    keys = mutations.filter(F.length("SWISSPROT") == 6).select(*by).distinct().withColumnsRenamed(by)
    return complete_table(with_gene_features(table, keys, inputs, by))


def test_table(mutations: DataFrame, symbols: DataFrame, inputs: GeneInputs, raw_scores: DataFrame, ranks=None,
               label: str = "class") -> DataFrame:
    """Labelled mutations of another study with the features of the training table, complete rows only.

    Gene id and accession come from the symbol. `ranks` should be the rank columns that the
    training scores have as well (see `scores.rank_columns`), so that averages compare.
    """
    keyed = with_variant_key(mutations, "Reference_Allele").select("Hugo_Symbol", "HGVSp_Short", "variant_key", F.col(label).alias(schemas.LABEL))
    ids = symbols.filter(F.col("entrezgene").isNotNull() & (F.size("uniprot") == 1)).select(
        F.col("entrezgene").alias("gene_id"), F.get("uniprot", F.lit(0)).alias("accession"), F.col("query").alias("symbol")).filter(
            F.length("accession") == 6).distinct()
    named = keyed.withColumn("mutation", F.concat_ws("_", "Hugo_Symbol", F.substr("HGVSp_Short", F.lit(3)))).drop("HGVSp_Short").distinct()
    table = lookup(named, clean.complete_rows(variant_scores(raw_scores, ranks)), "variant_key", "Uploaded_variation", "inner")
    return complete_table(with_gene_features(table, ids, inputs, {"Hugo_Symbol": "symbol"}))


def benchmark_features(benchmark: DataFrame, coordinates: DataFrame, protein_map: DataFrame, ids: DataFrame, inputs: GeneInputs,
                       raw_scores: DataFrame, competitor: DataFrame, ranks=None) -> DataFrame:
    """Benchmark mutations with all features, their label and the competitor's score, complete rows only.

    `ids` maps accessions to gene ids; `ranks` as in `test_table`.
    """
    placed = with_variant_key(benchmark_positions(benchmark, coordinates), "Reference_Allele", "Alternative_Allele")
    scored = with_competitor_score(placed, competitor).select(
        "Hugo_Symbol", "Mutation", "variant_key", F.col("label").alias(schemas.LABEL), "competitor_score")
    table = lookup(scored, clean.complete_rows(variant_scores(raw_scores, ranks)), "variant_key", "Uploaded_variation", "inner")
    keys = gene_ids(protein_map, ids).withColumnsRenamed({"Entrez_Gene_ID": "gene_id", "UniProt_ID": "accession"})
    table = with_gene_features(table, keys, inputs, {"Hugo_Symbol": "symbol"})
    table = recode_benchmark_label(table, schemas.LABEL).withColumn("mutation", F.concat_ws("_", "Hugo_Symbol", F.col("Mutation")))
    return complete_table(table, "competitor_score")


def map_symbols(mutations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Gene id and single protein accession for each symbol; the rest drops out."""
    ids = symbols.filter(F.col("entrezgene").isNotNull()).select("query", "entrezgene", "uniprot")
    mapped = mutations.join(ids, F.col("Hugo_Symbol") == F.col("query")).drop("query")
    one = mapped.filter(F.size("uniprot") == 1)
    return one.withColumn("uniprot", F.get("uniprot", F.lit(0))).distinct()


def first_accession(protein_map: DataFrame) -> DataFrame:
    """One accession per symbol: the first by order."""
    return first_per_key(protein_map, ["symbol"], "row_no").drop("row_no")


def benchmark_positions(benchmark: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Benchmark mutations placed on the genome, single substitutions only."""
    chromosome, position, reference, alternative = genomic_change("coordinates")
    placed = coordinates.select(
        "input", "strand", chromosome.alias("Chromosome"), position.alias("Start_Position"),
        reference.alias("Reference_Allele"), alternative.alias("Alternative_Allele"),
    )
    keyed = benchmark.withColumn("merge_col", paste("gene", paste(F.lit(":p."), "mutation")))
    joined = keyed.join(placed, F.col("merge_col") == F.col("input")).select(
        F.col("gene").alias("Hugo_Symbol"), F.col("mutation").alias("Mutation"),
        F.col("strand").alias("Strand"), "Chromosome", "Start_Position",
        F.col("Start_Position").alias("End_Position"), "Reference_Allele", "Alternative_Allele",
        "label",
    ).distinct()
    short = clean.length_within(joined, "Chromosome", 2)
    return clean.length_within(clean.length_within(short, "Start_Position", 11), "End_Position", 11)


def gene_ids(protein_map: DataFrame, id_map: DataFrame) -> DataFrame:
    """Accession and gene id of each symbol; the id is missing where unknown."""
    return first_accession(protein_map).join(id_map, F.col("Entry") == F.col("From"), "left").select(
        "symbol", F.col("Entry").alias("UniProt_ID"), F.col("To").alias("Entrez_Gene_ID"))


def with_gene_ids(positions: DataFrame, protein_map: DataFrame, id_map: DataFrame) -> DataFrame:
    """Accession and gene id of each symbol, kept missing where unknown."""
    return spread_join(positions, gene_ids(protein_map, id_map), "Hugo_Symbol", "symbol", "left")


def competitor_request(df: DataFrame) -> DataFrame:
    """Columns and chromosome spelling the competing predictor reads."""
    return df.select(
        paste(F.lit("chr"), "Chromosome").alias("Chromosome"), "Start_Position", "Strand",
        "Reference_Allele", "Alternative_Allele",
    )


def with_competitor_score(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Competitor score of the same variant; rows with anything missing drop out."""
    by_site = scores.select(
        F.substr("Chrom", F.lit(4)).alias("_chromosome"), F.col("Position").alias("_position"),
        F.col("Ref_Base").alias("_reference"), F.col("Alt_Base").alias("_alternative"),
        F.col("score").alias("competitor_score"),
    )
    same = (
        (F.col("Chromosome") == F.col("_chromosome"))
        & (F.col("Start_Position").cast("string") == F.col("_position").cast("string"))
        & (F.col("Reference_Allele") == F.col("_reference"))
        & (F.col("Alternative_Allele") == F.col("_alternative"))
    )
    joined = df.join(by_site, same).drop("_chromosome", "_position", "_reference", "_alternative")
    return clean.complete_rows(joined)


def recode_benchmark_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn(label, clean.two_way(F.col(label) == "Non-neutral", "driver", "passenger"))
