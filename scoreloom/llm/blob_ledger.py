"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed by the SHA-256 of its text. A ledger in a
shared folder holds which blob was scanned under which version of which rule, and the spans
found. A run scans only pairs of blob and rule version that the ledger lacks, each blob
once, appends what it finds, and joins the findings to all paths of a blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import drop, exists, saved


@dataclass(frozen=True)
class Rule:
    """A regular expression whose leftmost, non-overlapping matches are found; those whose group (0: the match) has fewer than `least` code points are dropped. hint: an expression that finds something in every text with a match."""

    name: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 0
    version: int = 1


# Kinds, in the order in which spans of one start are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:passw|secret|token|api_?key)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),
    # the whole key, or all that follows its first line where the last one is missing
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)(?:-----END [A-Z ]*PRIVATE KEY-----|\z)", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"\.eyJ"),
)
BASE = ("assign", "access", "hex")


def _pieces(text: Column, rule: Rule) -> Column:
    """An array of (rule, at, gap, size, good): for each match its number, the code points between the one before and it, its own, and whether it counts.

    \\G holds each attempt to the end of the last match, so a text is read once, and the lazy
    gap stops at the leftmost match.
    """
    held = F.lit(r"\G(?s:(.*?))(" + rule.pattern + ")")
    gaps, found = F.regexp_extract_all(text, held, F.lit(1)), F.regexp_extract_all(text, held, F.lit(2))
    value = F.regexp_extract_all(text, held, F.lit(2 + rule.group)) if rule.group else found
    made = F.transform(
        F.arrays_zip(gaps.alias("g"), found.alias("m"), value.alias("v")),
        lambda x, i: F.struct(F.lit(rule.name).alias("rule"), i.alias("at"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["v"]) >= rule.least).alias("good")),
    )
    none = F.array().cast("array<struct<rule:string,at:int,gap:int,size:int,good:boolean>>")
    return F.when(text.rlike(rule.hint), made).otherwise(none)


def _scanned(versions: DataFrame, todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, start, end) of the blobs in todo (path, blob, rules), each under its rules."""
    named = todo.select(F.col("path").alias("__path"), F.col("blob").alias("__blob"), "rules")
    own = versions.join(named, (F.col("blob") == F.col("__blob")) & F.col("path").eqNullSafe(F.col("__path")))
    none = F.array().cast("array<struct<rule:string,at:int,gap:int,size:int,good:boolean>>")
    pieces = F.concat(*[F.when(F.array_contains("rules", r.name), _pieces(F.col("text"), r)).otherwise(none) for r in rules])
    each = own.select("blob", F.explode(pieces).alias("x")).select("blob", "x.*")
    # a row may stand twice in the input
    each = each.dropDuplicates(["blob", "rule", "at"])
    order = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(order))
    return each.where("good").select("blob", "rule", (F.col("end") - F.col("size")).alias("start"), "end")


def _part(spark: SparkSession, ledger: str, name: str, schema: str) -> DataFrame:
    path = f"{ledger}/{name}"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


_SCANS = "blob string, rule string, version int, run string"
_FINDINGS = "blob string, rule string, version int, run string, start long, end long"


def update(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger lacks of versions (path, text), appends it, and returns (path, blob) of every row, saved.

    Findings are written before the list of scans and carry its run; findings of a run that
    broke off are never read, and of runs that scan the same pair at one time only one
    counts. A null text is the empty blob. Rows of equal text are one blob. An empty table
    leaves an empty ledger; columns but path and text are not read.
    """
    spark = versions.sparkSession
    own = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = saved(own.select("path", "blob"), "ledger-paths")
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    wanted = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if exists(spark, f"{ledger}/scans"):
        pairs = blobs.select("blob", "path", F.explode(wanted).alias("r")).select("blob", "path", "r.*")
        pairs = pairs.join(_part(spark, ledger, "scans", _SCANS).select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
        todo = pairs.groupBy("blob", "path").agg(F.collect_set("rule").alias("rules"))
    else:
        todo = blobs.select("path", "blob", F.array(*[F.lit(r.name) for r in rules]).alias("rules"))
    todo = saved(todo, "ledger-todo")
    run = uuid.uuid4().hex
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
    found = _scanned(own, todo, rules).select("blob", "rule", version[F.col("rule")].alias("version"), F.lit(run).alias("run"), "start", "end")
    found.write.mode("append").parquet(f"{ledger}/findings")
    scans = todo.select("blob", F.explode("rules").alias("rule"))
    scans.select("blob", "rule", version[F.col("rule")].alias("version"), F.lit(run).alias("run")).write.mode("append").parquet(f"{ledger}/scans")
    drop(todo)
    return paths


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, start, end) that the ledger holds under these versions of the rules."""
    # runs at one time may both have scanned a pair: the one of the smallest name counts
    scans = _part(spark, ledger, "scans", _SCANS).groupBy("blob", "rule", "version").agg(F.min("run").alias("run"))
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("rule") == r.name) & (F.col("version") == r.version))
    found = _part(spark, ledger, "findings", _FINDINGS).where(now)
    return found.join(scans, ["blob", "rule", "version", "run"], "left_semi").select("blob", "rule", "start", "end")


def by_blob(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, and spans: an array of (start, kind, rule, end) by start, then by the rule's place; one row for each blob with a finding, saved."""
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    one = F.struct("start", place[F.col("rule")].alias("kind"), "rule", "end")
    return saved(found.groupBy("blob").agg(F.sort_array(F.collect_list(one)).alias("spans")), "ledger-spans")


def by_path(paths: DataFrame, spans: DataFrame) -> DataFrame:
    """paths (path, blob) with the spans of their blobs, an empty array for none."""
    none = F.array().cast(spans.schema["spans"].dataType)
    return paths.join(spans, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, spans: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs (text and any other columns) with the spans of their blobs replaced by mark, overlapping ones by one.

    A null text stays null, an empty one empty; rows without a finding, repeated ones
    included, stay as they are. spans: from by_blob; several spans of one start may differ
    in length.
    """
    spans = spans.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    start = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("kept"))

    def cut(s: Column, x: Column) -> Column:
        begin = x["start"] + 1
        piece = F.substring(F.col("text"), s["at"].cast("int"), F.greatest(begin - s["at"], F.lit(0)).cast("int"))
        fresh = begin >= s["at"]
        return F.struct(F.greatest(s["at"], x["end"] + 1).alias("at"), F.when(fresh, F.concat(s["kept"], F.array(piece, F.lit(mark)))).otherwise(s["kept"]).alias("kept"))

    def whole(s: Column) -> Column:
        return F.concat(F.array_join(s["kept"], ""), F.substring(F.col("text"), s["at"].cast("int"), F.length("text")))

    text = F.when(F.size("__spans") > 0, F.aggregate("__spans", start, cut, whole)).otherwise(F.col("text"))
    return docs.join(spans, F.sha2("text", 256) == F.col("__blob"), "left").withColumn("text", text).select(*docs.columns)
