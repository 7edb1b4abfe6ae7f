"""Declared schemas and fixed column lists of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType()}


def fields(**columns: str) -> T.StructType:
    """Schema from `name="type"` pairs, in order."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in columns.items()])


# The process categories of the hallmark lookup, plus the missing one.
PROCESS_CATEGORIES = (
    "cellular component", "development", "DNA damage", "immune", "metabolic",
    "pathway", "proliferation", "signaling",
)
NO_CATEGORY = "na_hallmarks"

# The modifications that become flags.
MODIFICATIONS = (
    "acetylation", "caspase cleavage", "di-methylation", "methylation", "mono-methylation",
    "N-Glycosylation", "O-GalNAc", "O-GlcNAc", "phosphorylation", "succinylation",
    "sumoylation", "tri-methylation", "ubiquitylation",
)

# The ratio-metric gene features.
RATIO_FEATURES = (
    "gene_length", "silent", "nonsense", "splice_site", "missense", "recurrent_missense",
    "normalized_missense_position_entropy", "frameshift_indel", "inframe_indel",
    "normalized_mutation_entropy", "mean_missense_mga_entropy", "mean_vest_score",
    "lost_start_and_stop", "missense_to_silent", "non_silent_to_silent", "expression_ccle",
    "replication_time", "hic_compartment", "gene_betweeness", "gene_degree",
    "oncogene_score", "tsg_score", "other_score", "driver_score",
)

# The variant-level scores of the final table.
VARIANT_SCORES = ("sift", "polyphen", "condel", "average_rank")

DEGREE = "max_no_interactions"
LABEL = "labels_driver_mutation"


def snake(name: str) -> str:
    """`DNA damage` -> `dna_damage`"""
    return name.lower().replace(" ", "_").replace("-", "_")


PROCESS_FLAGS = tuple(snake(c) for c in PROCESS_CATEGORIES) + (NO_CATEGORY,)
MODIFICATION_FLAGS = tuple(snake(m) for m in MODIFICATIONS)
GENE_FEATURES = (DEGREE,) + PROCESS_FLAGS + MODIFICATION_FLAGS + RATIO_FEATURES
BINARY_FEATURES = PROCESS_FLAGS + MODIFICATION_FLAGS
NUMERIC_FEATURES = (DEGREE,) + RATIO_FEATURES + VARIANT_SCORES
ALL_FEATURES = GENE_FEATURES + VARIANT_SCORES

# The 45 input columns of a mutation table. Fixed names, in file order.
MUTATION_COLUMNS = (
    "Hugo_Symbol", "Entrez_Gene_Id", "Center", "NCBI_Build", "Chromosome", "Start_Position",
    "End_Position", "Strand", "Variant_Classification", "Variant_Type", "Reference_Allele",
    "Tumor_Seq_Allele1", "Tumor_Seq_Allele2", "dbSNP_RS", "dbSNP_Val_Status",
    "Tumor_Sample_Barcode", "Matched_Norm_Sample_Barcode", "Match_Norm_Seq_Allele1",
    "Match_Norm_Seq_Allele2", "Tumor_Validation_Allele1", "Tumor_Validation_Allele2",
    "Match_Norm_Validation_Allele1", "Match_Norm_Validation_Allele2", "Verification_Status",
    "Validation_Status", "Mutation_Status", "Sequencing_Phase", "Sequence_Source",
    "Validation_Method", "Score", "BAM_File", "Sequencer", "HGVSp_Short", "t_ref_count",
    "t_alt_count", "n_ref_count", "n_alt_count", "Protein_position", "Codons", "SWISSPROT",
    "RefSeq", "t_depth", "n_depth", "FILTER", "mutationInCis_Flag",
)
_WHOLE_NUMBERS = {"Entrez_Gene_Id", "Start_Position", "End_Position"}

MUTATIONS = fields(**{c: "bigint" if c in _WHOLE_NUMBERS else "string" for c in MUTATION_COLUMNS})
LABELLED_MUTATIONS = fields(
    Hugo_Symbol="string", Chromosome="string", Start_Position="bigint", End_Position="bigint",
    Strand="string", Reference_Allele="string", Tumor_Seq_Allele2="string", HGVSp_Short="string",
    **{"class": "string"},
)
BENCHMARK_MUTATIONS = fields(gene="string", mutation="string", label="string")
COORDINATES = fields(input="string", coordinates="string", strand="string")
INTERACTIONS = fields(P1="string", P2="string")
ID_MAP = fields(From="string", To="bigint")
SYMBOL_MAP = fields(query="string", entrezgene="bigint", uniprot="string")
PROTEIN_MAP = fields(symbol="string", Entry="string", cross_reference="string")
GENE_SETS = fields(gs_cat="string", gs_name="string", entrez_gene="bigint")
HALLMARK_CATEGORIES = fields(
    row_no="int", Hallmark_name="string", Process_category="string", Description="string",
    Number_of_founder_sets="int", Number_of_genes="int",
)
MODIFICATION_SHEET = fields(ACC="string", ORGANISM="string", MODIFICATION_SUMMARY="string")
MODIFICATION_KEY = fields(PTM="string", Description="string", Amino_acid_by_code="string")
RATIO_TABLE = fields(gene="string", **{f: "double" for f in RATIO_FEATURES})
HOTSPOTS = fields(codon_id="string")
COMPETITOR_SCORES = fields(
    Chrom="string", Position="bigint", Ref_Base="string", Alt_Base="string", score="double",
)


def variant_score_schema(rank_columns) -> T.StructType:
    """Score columns arrive as text: `-` marks a missing score."""
    text = ("Uploaded_variation", "SIFT", "PolyPhen", "Condel", *rank_columns)
    return fields(**{c: "string" for c in text})
