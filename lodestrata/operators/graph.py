"""Graph operators over edges(src, dst, relation, usage_modes)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 50


def degrees(edges: DataFrame) -> DataFrame:
    """Per node: upstream, downstream (calls), used_by, uses. Each edge counts once at either end, in one shuffle."""
    one = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("way")))).alias("x"), "relation").select("x.id", "x.way", "relation")
    n = lambda way, rel: F.count_if((F.col("way") == way) & (F.col("relation") == rel))
    return one.groupBy(F.col("id").alias("symbol_id")).agg(n("in", "calls").alias("upstream"), n("out", "calls").alias("downstream"), n("in", "uses").alias("used_by"), n("out", "uses").alias("uses"))


def risk(total: Column, callers: Column) -> Column:
    return F.when((total > 100) | (callers > 20), "critical").when((total > 40) | (callers > 10), "high").when((total > 10) | (callers > 3), "medium").otherwise("low")


def blast_radius(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    total = F.col("upstream") + F.col("downstream") + F.col("used_by") + F.col("uses")
    d = d.withColumn("total", total).withColumn("callers", F.col("upstream") + F.col("used_by")).withColumn("callees", F.col("downstream") + F.col("uses"))
    return d.withColumn("risk", risk(F.col("total"), F.col("callers")))


def risk_reasons(blast: DataFrame) -> DataFrame:
    """Adds reasons, in fixed order; a node that no rule names gets the fallback text."""
    callers, total, score = F.col("callers"), F.col("total"), F.col("risk")
    text = lambda n, what, least: F.concat(n.cast("string"), F.lit(f" {what} (threshold: {least})"))
    up, all_ = "upstream callers", "total connections"
    rules = [F.when(callers > 20, text(callers, up, 20)), F.when(total > 100, text(total, all_, 100)), F.when((callers > 10) & (score != "critical"), text(callers, up, 10)), F.when((total > 40) & (score != "critical"), text(total, all_, 40)), F.when((callers > 3) & (score == "medium"), text(callers, up, 3)), F.when((total > 10) & (score == "medium"), text(total, all_, 10))]
    joined = F.array_join(F.array_compact(F.array(*rules)), "; ")
    return blast.withColumn("reasons", F.when(joined == "", F.concat(F.lit("Low connectivity: "), total, F.lit(" connections, "), callers, F.lit(" callers"))).otherwise(joined))


def neighbours(edges: DataFrame, cap: int = CAP) -> DataFrame:
    """Per node: the four neighbour lists, sorted, the first `cap` of each, joined by commas."""
    one = edges.select("src", "dst", "relation").select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.when(F.col("relation") == "calls", "downstream").otherwise("uses").alias("way")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.when(F.col("relation") == "calls", "upstream").otherwise("used_by").alias("way")))).alias("x")).select("x.*")
    lists = [F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("way") == w, F.col("other")))), 1, cap), ",").alias(w) for w in ("upstream", "downstream", "used_by", "uses")]
    return one.groupBy(F.col("id").alias("symbol_id")).agg(*lists)


def with_modes(edges: DataFrame, requested: list[str]) -> DataFrame:
    """Edges any of whose modes is requested; an edge without modes has the mode `reference`."""
    modes = F.when(F.size("usage_modes") > 0, F.col("usage_modes")).otherwise(F.array(F.lit("reference")))
    return edges.where(F.arrays_overlap(modes, F.array(*map(F.lit, requested))))


def mode_histogram(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("symbol_id"), F.explode("usage_modes").alias("mode")).groupBy("symbol_id", "mode").agg(F.count("*").alias("n"))


def edge_confidence(edges: DataFrame) -> DataFrame:
    """Calls count as high, type references as medium confidence."""
    d = degrees(edges).select("symbol_id", (F.col("upstream") + F.col("downstream")).alias("high_edges"), (F.col("used_by") + F.col("uses")).alias("medium_edges"))
    return d.withColumn("overall", F.when(F.col("high_edges") > F.col("medium_edges"), "high").when(F.col("medium_edges") > 0, "medium").otherwise("low"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x")).select("x.a", "x.b").distinct()


def batch_impact(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Neighbours of all roots(symbol_id) that aren't roots, and how many roots reach each."""
    r = roots.select(F.col("symbol_id").alias("a")).distinct()
    near = undirected(edges).join(r, "a", "left_semi")
    return near.join(r.withColumnRenamed("a", "b"), "b", "left_anti").groupBy(F.col("b").alias("symbol_id")).agg(F.count("*").alias("roots"))


def stage(df: DataFrame) -> DataFrame:
    """A table written to the folder that driver and executors share, so that its lineage ends there."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp()}"
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/frontier-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps_from(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, relation) of the edges at nodes(a, ...), from either end: two filtered scans, nothing rewritten."""
    n = nodes.select("a").distinct()
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation").join(n, "a", "left_semi")
    return out.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "relation").join(n, "a", "left_semi"))


def reach(edges: DataFrame, roots: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(symbol_id, hop) within depth steps of roots(symbol_id) in either direction, the nearest `most` if given.

    Each hop filters the edges by the newest nodes alone; the undirected graph is never built.
    """
    seen = new = stage(roots.select("symbol_id", F.lit(0).alias("hop")).distinct())
    for hop in range(1, depth + 1):
        step = steps_from(edges, new.select(F.col("symbol_id").alias("a"))).select(F.col("b").alias("symbol_id")).distinct()
        new = stage(step.join(seen, "symbol_id", "left_anti").withColumn("hop", F.lit(hop)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen if most is None else seen.orderBy("hop", "symbol_id").limit(most)


#: Ends of ids that a path over type uses leaves out, and of ids that count as configuration.
GLOBAL_STATE = ("GlobalState", "FastagGlobalState", "AppState")
CONFIG_TYPES = ("GlobalState", "FastagGlobalState", "AppState", "Config", "Settings", "State", "Arc")
#: Weight of a usage mode.
MODE_WEIGHTS = {"pattern_match": 3, "construction": 2, "field_declaration": 2, "trait_impl": 2, "type_reference": 1, "type_param": 1, "import": 0, "reference": 0}


def is_config_type(symbol_id: Column) -> Column:
    return F.element_at(F.split(symbol_id, "::"), -1).rlike(f"({'|'.join(CONFIG_TYPES)})$")


def dependency_path(edges: DataFrame, start: str, end: str, depth: int, left_out: tuple[str, ...] = ()) -> DataFrame:
    """(path, edge_types, length): a shortest path in either direction, the first in order, without ids of these ends."""
    spark = edges.sparkSession
    new = seen = stage(spark.createDataFrame([(start, start, "", 0)], "symbol_id string, path string, edge_types string, hop int"))
    usable = lambda c: ~F.coalesce(F.col(c).rlike(f"({'|'.join(left_out)})$"), F.lit(False)) if left_out else F.lit(True)
    for hop in range(1, depth + 1):
        if not new.where(F.col("symbol_id") == end).isEmpty():
            break
        step = steps_from(edges, new.select(F.col("symbol_id").alias("a"))).where(usable("a") & usable("b"))
        best = F.min(F.struct(F.concat_ws(">", "path", "b").alias("path"), F.concat(F.col("edge_types"), F.when(F.col("edge_types") != "", ">").otherwise(""), F.upper("relation")).alias("edge_types")))
        found = new.join(step, new.symbol_id == step.a).groupBy(F.col("b").alias("symbol_id")).agg(best.alias("x")).select("symbol_id", "x.path", "x.edge_types")
        new = stage(found.join(seen, "symbol_id", "left_anti").withColumn("hop", F.lit(hop)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen.where(F.col("symbol_id") == end).select("path", "edge_types", F.col("hop").alias("length"))


def deep_neighbours(edges: DataFrame, symbol_id: str, depth: int) -> DataFrame:
    """(way, other, hop, usage_modes): all that a symbol reaches within depth steps in each of the four directions.

    Calls are distinct by node; uses count each node with the modes of the edge next to the symbol, sorted, distinct.
    """
    spark, out = edges.sparkSession, None
    for way, relation, a, b in (("upstream", "calls", "dst", "src"), ("downstream", "calls", "src", "dst"), ("used_by", "uses", "dst", "src"), ("uses", "uses", "src", "dst")):
        e = edges.where(F.col("relation") == relation).select(F.col(a).alias("a"), F.col(b).alias("b"), "usage_modes")
        new = spark.createDataFrame([(symbol_id, [])], "other string, usage_modes array<string>")
        for hop in range(1, depth + 1):
            n = new.select(F.col("other").alias("a"), F.col("usage_modes").alias("first"))
            step = e.join(n, "a").select(F.col("b").alias("other"), (F.col("usage_modes") if hop == 1 else F.col("first")).alias("usage_modes"), F.lit(hop).alias("hop"))
            if relation == "calls":
                step = step.groupBy("other", "hop").agg(F.first("usage_modes").alias("usage_modes"))
            else:
                step = step.distinct()
            new = stage(step)
            found = new.select(F.lit(way).alias("way"), "other", "hop", F.when(F.size("usage_modes") > 0, F.array_sort("usage_modes")).otherwise(F.array().cast("array<string>")).alias("usage_modes"))
            out = found if out is None else out.unionByName(found)
    return out.groupBy("way", "other", "usage_modes").agg(F.min("hop").alias("hop"))


def tree_lines(files: DataFrame, depth: int = 3, most: int = 60) -> DataFrame:
    """(line_no, line): the directory lines of files(file_path) at most depth folders deep, in order, and no more than `most`."""
    short = files.where(F.size(F.split("file_path", "/")) - 1 <= depth)
    lines = directory_lines(short).orderBy("dir").limit(most)
    return lines.select((F.row_number().over(Window.orderBy("dir"))).alias("line_no"), F.concat(F.col("dir"), F.lit(": "), F.col("line")).alias("line"))


def frontier(pairs: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, symbol_id, hop) with the smallest number of hops up to depth; pairs(a, b) are the steps, roots have hop 0.

    Each hop joins only the newest nodes, takes the distinct ones not seen before and is written to the shared folder;
    the loop ends when a hop finds nothing.
    """
    seen = new = stage(roots.select(F.col("symbol_id").alias("root"), "symbol_id", F.lit(0).alias("hop")).distinct())
    for hop in range(1, depth + 1):
        step = new.join(pairs, new.symbol_id == pairs.a).select("root", F.col("b").alias("symbol_id")).distinct()
        new = stage(step.join(seen, ["root", "symbol_id"], "left_anti").withColumn("hop", F.lit(hop)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def shortest_path(pairs: DataFrame, start: str, end: str, depth: int = 10) -> DataFrame:
    """(path, length) of a shortest path, the first in order among equals; no row if there is none within depth.

    One path per node is carried, the smallest, so the frontier never grows beyond the nodes.
    """
    spark = pairs.sparkSession
    new = seen = stage(spark.createDataFrame([(start, start, 0)], "symbol_id string, path string, hop int"))
    for hop in range(1, depth + 1):
        if not new.where(F.col("symbol_id") == end).isEmpty():
            break
        step = new.join(pairs, new.symbol_id == pairs.a).groupBy(F.col("b").alias("symbol_id")).agg(F.min(F.concat_ws(">", "path", "b")).alias("path"))
        new = stage(step.join(seen, "symbol_id", "left_anti").withColumn("hop", F.lit(hop)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen.where(F.col("symbol_id") == end).select("path", F.col("hop").alias("length"))


def dependents(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """changed(symbol_id) and all that call or use them: (symbol_id, is_changed)."""
    c = changed.select("symbol_id").distinct()
    dep = edges.join(c, edges.dst == c.symbol_id, "left_semi").select(F.col("src").alias("symbol_id")).distinct().join(c, "symbol_id", "left_anti")
    return c.withColumn("is_changed", F.lit(True)).unionByName(dep.withColumn("is_changed", F.lit(False)))


def neighbour_files(edges: DataFrame, symbols: DataFrame, symbol_id: str, k: int = 20) -> DataFrame:
    """(file_path, neighbours): the k files with the most distinct neighbours of a symbol."""
    near = edges.where((F.col("src") == symbol_id) | (F.col("dst") == symbol_id)).select(F.when(F.col("src") == symbol_id, F.col("dst")).otherwise(F.col("src")).alias("symbol_id")).distinct()
    found = symbols.select("symbol_id", "file_path").join(near, "symbol_id").groupBy("file_path").agg(F.countDistinct("symbol_id").alias("neighbours"))
    return found.orderBy(F.desc("neighbours"), "file_path").limit(k)


def directory_lines(files: DataFrame, shown: int = 8, shortened: int = 6) -> DataFrame:
    """(dir, line) of files(file_path): the sorted names of a folder, or the first of them and how many more there are."""
    dir_, name = F.regexp_extract("file_path", "^(.*)/", 1), F.regexp_extract("file_path", "([^/]*)$", 1)
    one = files.select(dir_.alias("dir"), name.alias("name")).distinct()
    rank = F.row_number().over(Window.partitionBy("dir").orderBy("name"))
    top = one.withColumn("rank", rank).where(F.col("rank") <= shown).groupBy("dir").agg(F.array_sort(F.collect_list("name")).alias("names"))
    j = top.join(one.groupBy("dir").agg(F.count("*").alias("n")), "dir")
    cut = F.concat(F.array_join(F.slice("names", 1, shortened), ", "), F.lit(" ... +"), (F.col("n") - shortened).cast("string"), F.lit(" more"))
    return j.select("dir", F.when(F.col("n") > shown, cut).otherwise(F.array_join("names", ", ")).alias("line"))
