"""Unified diffs as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed patterns.
_NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
DECLARED = {
    "function": r"^\s*(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?fn\s+" + _NAME,
    "struct": r"^\s*(?:pub\s+)?struct\s+" + _NAME,
    "enum": r"^\s*(?:pub\s+)?enum\s+" + _NAME,
    "trait": r"^\s*(?:pub\s+)?trait\s+" + _NAME,
}
SIGNATURE = r"^\s*(?:pub\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:<[^>]*>)?\s*\([^)]*\)"
FIELD = r"^\s*(?:pub\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*:\s*([A-Za-z_][A-Za-z0-9_<>&\s,]*)"
TRAIT_IMPL = r"^\s*impl(?:<[^>]+>)?\s+([A-Za-z_][A-Za-z0-9_<>\s,]*)\s+for\s+([A-Za-z_][A-Za-z0-9_<>\s,]*)"
#: So many first letters of a name must stand at a place of an id before the whole name is tried there.
HEAD = 3


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diffs(diff_id, text) -> (diff_id, pos, file, change '+' or '-', line) of changed lines in hunks of Rust files."""
    rows = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    w = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    file = F.last(F.when(F.col("raw").rlike(r"^\+\+\+ b/"), F.expr("substring(raw, 7)")), True).over(w)
    hunk = F.last(F.when(F.col("raw").rlike(r"^(diff --git|--- |\+\+\+ )"), False).when(F.col("raw").startswith("@@"), True), True).over(w)
    rows = rows.withColumn("file", file).withColumn("hunk", hunk).where(F.col("hunk") & F.col("file").endswith(".rs"))
    change = F.when(F.col("raw").rlike(r"^\+([^+]|$)"), "+").when(F.col("raw").rlike(r"^-([^-]|$)"), "-")
    return rows.withColumn("change", change).where("change is not null").select("diff_id", "pos", "file", "change", F.expr("substring(raw, 2)").alias("line"))


def changed_files(diffs: DataFrame) -> DataFrame:
    return diffs.select("diff_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\+\+\+ b/(.+)$"), F.lit(1))).alias("file"))


def _any(cond: Column) -> Column:
    return F.coalesce(F.bool_or(cond), F.lit(False))


def changed_symbols(lines: DataFrame) -> DataFrame:
    """(diff_id, name, status, symbol_type, change_type) of each declared name on changed lines.

    status: modified if declared on added and deleted lines, else added or deleted. change_type, first that holds:
    trait_impl if the diff has any, new, deleted, signature_change, struct_field, body_only; deleted names are deleted.
    """
    decl = F.array_compact(F.array(*(F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in DECLARED.values())))
    names = lines.select("diff_id", "change", F.explode(decl).alias("name")).groupBy("diff_id", "name").agg(_any(F.col("change") == "+").alias("plus"), _any(F.col("change") == "-").alias("minus"))
    l = lines.select("diff_id", "pos", "change", "line", F.when(F.col("line").rlike(DECLARED["struct"]), "struct").when(F.col("line").rlike(DECLARED["enum"]), "enum").when(F.col("line").rlike(DECLARED["trait"]), "trait").alias("kind"), F.col("line").rlike(DECLARED["function"]).alias("is_fn"), F.nullif(F.regexp_extract("line", SIGNATURE, 0), F.lit("")).alias("sig"), F.col("line").rlike(FIELD).alias("field"), F.col("line").rlike(TRAIT_IMPL).alias("impl"))
    j = names.join(l, "diff_id").withColumn("mine", F.contains("line", "name"))
    mine, plus, minus = F.col("mine"), F.col("change") == "+", F.col("change") == "-"
    declared = mine & (F.col("is_fn") | F.col("kind").isNotNull())
    sigs = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(mine & side & F.col("sig").isNotNull(), F.struct("pos", "sig")))), lambda x: x["sig"]), "\n")
    order = F.struct((~plus).cast("int"), "pos")
    a = j.groupBy("diff_id", "name", "plus", "minus").agg(F.min_by(F.when(mine, F.col("kind")), F.when(mine & F.col("kind").isNotNull(), order)).alias("kind"), _any(declared & plus).alias("d_plus"), _any(declared & minus).alias("d_minus"), sigs(plus).alias("s_plus"), sigs(minus).alias("s_minus"), _any(F.col("field") & ~mine).alias("fields"), _any(F.col("impl")).alias("impls"))
    kind = F.coalesce("kind", F.lit("function"))
    gone = F.col("minus") & ~F.col("plus")
    change = F.when(gone, "deleted").when(F.col("impls"), "trait_impl").when(F.col("d_plus") & ~F.col("d_minus"), "new").when(F.col("d_minus") & ~F.col("d_plus"), "deleted")
    change = change.when((F.col("s_plus") != "") & (F.col("s_minus") != "") & (F.col("s_plus") != F.col("s_minus")), "signature_change").when((kind == "struct") & F.col("fields"), "struct_field").otherwise("body_only")
    status = F.when(gone, "deleted").when(F.col("plus") & F.col("minus"), "modified").otherwise("added")
    return a.select("diff_id", "name", status.alias("status"), F.when(gone, "unknown").when(F.col("impls"), "impl").otherwise(kind).alias("symbol_type"), change.alias("change_type"))


def _holders(symbols: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """symbols(symbol_id) and distinct names(low) -> (low, symbol_id, r): the first `limit` ids that hold the name, case aside.

    A place of an id where some name's first letters stand gives a candidate for each length of such names, and candidates
    meet the names by equality: rows grow with the ids' letters, not with ids times names. An id counts once (dense rank).
    """
    head = F.substring("low", 1, HEAD)
    heads = names.groupBy(head.alias("head")).agg(F.collect_set(F.length("low")).alias("sizes"))
    widths = names.agg(F.collect_set(F.length(head)).alias("widths"))
    text = F.lower("symbol_id")
    places = symbols.join(F.broadcast(widths)).select("symbol_id", text.alias("text"), F.explode("widths").alias("width"))
    places = places.select("symbol_id", "text", "width", F.explode(F.when(F.col("width") == 0, F.array(F.lit(1))).when(F.length("text") >= F.col("width"), F.sequence(F.lit(1), F.length("text") - F.col("width") + 1))).alias("at"))
    places = places.withColumn("head", F.substring("text", F.col("at"), F.col("width"))).join(F.broadcast(heads), "head")
    each = places.select("symbol_id", "text", "at", F.explode("sizes").alias("size")).where(F.col("at") + F.col("size") <= F.length("text") + 1)
    hit = each.select("symbol_id", F.substring("text", F.col("at"), F.col("size")).alias("low")).join(names, "low")
    w = Window.partitionBy("low").orderBy("symbol_id")
    return hit.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= limit).distinct()


def resolve(changes: DataFrame, symbols: DataFrame, limit: int = 5, deleted_limit: int = 3) -> DataFrame:
    """Changes with the symbols whose id holds the name (case aside), the first few of each; symbol_id null: not in the index."""
    changes = changes.withColumn("low", F.lower("name"))
    hit = _holders(symbols.select("symbol_id"), changes.select("low").where("low is not null").distinct(), limit)
    j = changes.join(hit, "low", "left").where((F.col("status") != "deleted") | F.coalesce(F.col("r") <= deleted_limit, F.lit(False)))
    return j.drop("r", "low")


def breakdown(changes: DataFrame) -> DataFrame:
    return changes.groupBy("diff_id", "change_type").agg(F.count("*").alias("n"))
