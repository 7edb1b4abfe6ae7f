"""Secret scans over a ledger of content-addressed texts.

Every version of a text is a blob named by its SHA-256. The ledger holds which blobs were
scanned by which version of which rule, and what was found. A scan looks at unseen pairs of
blob and rule version alone, once for all copies of a text, and joins the findings back to
every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOUND = "blob string, rule string, version int, start int, stop int"
SCANNED = "blob string, rule string, version int"


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose `group` has under `least` characters are dropped."""

    name: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1


# The first three are fixed by the contract of the query, in this order.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("bearer", r"gh[a-z]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # Header, body and END line; without an END line all that follows, as the body cannot be told from text.
    Rule("pem", r"-----BEGIN [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----END)[^-]*+)*+(?:-----END [A-Z0-9 ]{0,40}-----)?", version=2),
)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _table(spark: SparkSession, ledger: str, name: str, schema: str) -> DataFrame:
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{ledger}/{name}")
    return spark.read.schema(schema).parquet(f"{ledger}/{name}").distinct()


def spans(blobs: DataFrame, rule: Rule) -> DataFrame:
    """`blob`, `start` and `stop` in code points of the rule's leftmost non-overlapping matches.

    Splitting at the pattern gives what stands between the matches, so a match starts after
    the texts and matches before it.
    """
    pattern = F.lit(rule.pattern)
    hit = blobs.filter(F.col("text").rlike(rule.pattern)).select(
        "blob", F.split("text", rule.pattern, -1).alias("outside"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("found"),
        F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("value"))
    each = hit.select("blob", F.posexplode(F.arrays_zip(
        F.transform("found", F.length).alias("size"), F.transform("outside", F.length).alias("gap"),
        F.transform("value", F.length).alias("value"))).alias("at", "m"))
    before = Window.partitionBy("blob").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = each.select("blob", "m", F.sum(F.col("m.gap")).over(before).alias("gaps"), F.sum(F.coalesce("m.size", F.lit(0))).over(before).alias("sizes"))
    return run.filter(f"m.size is not null and m.value >= {rule.least}").select(
        "blob", (F.col("gaps") + F.col("sizes") - F.col("m.size")).cast("int").alias("start"), (F.col("gaps") + F.col("sizes")).cast("int").alias("stop"))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """Bring the ledger up to date with all rows of `versions` and return its findings.

    The result has `blob`, `rule`, `start` and `stop` for the current rule versions. A null
    text is empty and has a blob too. Findings are written before the note that a blob was
    scanned: a broken run is repeated, never skipped. Rows that are equal in path and text
    count once.
    """
    spark = versions.sparkSession
    found, scanned = _table(spark, ledger, "found", FOUND), _table(spark, ledger, "scanned", SCANNED)
    wanted = [f"{r.name}:{r.version}" for r in rules]
    seen = scanned.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", F.col("version").cast("string"))).alias("seen"))
    rows = versions.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one = rows.groupBy("blob").agg(F.min("path").alias("first"))
    todo = one.join(seen, "blob", "left").select("blob", "first", F.array_except(
        F.array(*map(F.lit, wanted)), F.coalesce("seen", F.array().cast("array<string>"))).alias("missing")).filter("size(missing) > 0")
    todo = todo.withColumnRenamed("blob", "_blob")
    fresh = rows.join(todo, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("first"))).select("blob", "text", "missing")
    new = f"{ledger}/pending"
    # Only texts with a hit are kept beyond the scan; which rules hit is decided in one pass.
    hits = F.filter(F.array(*[F.when(F.array_contains("missing", w) & F.col("text").rlike(r.pattern), F.lit(r.name))
                              for w, r in zip(wanted, rules, strict=True)]), lambda x: x.isNotNull())
    marked = fresh.select("blob", "missing", hits.alias("hits"), F.when(F.size(hits) > 0, F.col("text")).alias("text"))
    # Several rows can hold the blob under its first path; places are summed up per blob, so one row of it stays.
    marked.dropDuplicates(["blob"]).write.mode("overwrite").parquet(new)
    pending = spark.read.parquet(new)
    made = None
    for rule in rules:
        part = spans(pending.filter(F.array_contains("hits", rule.name)), rule).select(
            "blob", F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), "start", "stop")
        made = part if made is None else made.unionByName(part)
    made.distinct().write.mode("append").parquet(f"{ledger}/found")
    pairs = pending.select("blob", F.explode("missing").alias("pair")).select("blob", F.split("pair", ":").alias("p"))
    pairs.select("blob", F.col("p")[0].alias("rule"), F.col("p")[1].cast("int").alias("version")).write.mode("append").parquet(f"{ledger}/scanned")
    now = spark.read.schema(FOUND).parquet(f"{ledger}/found").distinct()
    return now.filter(F.concat_ws(":", "rule", F.col("version").cast("string")).isin(*wanted)).select("blob", "rule", "start", "stop")


def spans_by_path(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """`path`, `blob` and `spans` (start, order, stop, rule), sorted, for every row of `versions`."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    each = F.struct("start", order[F.col("rule")].alias("order"), "stop", "rule")
    per_blob = findings.groupBy("blob").agg(F.array_sort(F.collect_list(each)).alias("spans")).withColumnRenamed("blob", "_blob")
    rows = versions.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob"))
    none = F.array().cast("array<struct<start:int,order:int,stop:int,rule:string>>")
    return rows.join(per_blob, F.col("blob") == F.col("_blob"), "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))
