"""The index as jobs: build from sources, ingest changes, replay, and embed."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rust
from . import graph, retrieve
from .snapshots import SnapshotStore, last_wins, merge

Embedder = Callable[[Column], Column]


def allowed_root(target: str, roots: list[str]) -> bool:
    """Whether target is one of the roots or below one; the file system's root never is."""
    t = PurePosixPath(target)
    return ".." not in t.parts and str(t) != "/" and any(t == PurePosixPath(r) or PurePosixPath(r) in t.parents for r in roots if r != "/")


def git_changes(spark: SparkSession, listing: str) -> DataFrame:
    """(path, status) of the Rust files in the output of `git diff --name-status`; a renamed file is deleted and added."""
    rows = spark.createDataFrame([(x,) for x in listing.splitlines() if x.strip()], "line string").select(F.split("line", r"\t").alias("f"))
    status, last = F.substring(F.col("f")[0], 1, 1), F.element_at("f", -1)
    pairs = F.when(status == "R", F.array(F.struct(F.col("f")[1].alias("path"), F.lit("deleted").alias("status")), F.struct(last.alias("path"), F.lit("changed").alias("status"))))
    pairs = pairs.otherwise(F.array(F.struct(last.alias("path"), F.when(status == "D", "deleted").otherwise("changed").alias("status"))))
    return rows.select(F.explode(pairs).alias("x")).select("x.*").where(F.col("path").endswith(".rs")).distinct()


def edges_of(chunks: DataFrame) -> DataFrame:
    return rust.call_edges(chunks).unionByName(rust.use_edges(chunks))


def symbols_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("symbol_id", rust.short_name(F.col("symbol_id")).alias("short_name"), "file_path", "kind")


def node_rows(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per symbol of the graph: kind and file of the first chunk where known, and its out-edges by relation."""
    out = edges.groupBy(F.col("src").alias("symbol_id")).agg(F.array_sort(F.collect_set(F.when(F.col("relation") == "calls", F.col("dst")))).alias("calls"), F.array_sort(F.collect_set(F.when(F.col("relation") == "uses", F.col("dst")))).alias("uses"))
    meta = rust.graph_chunks(chunks).groupBy("symbol_id").agg(F.min_by("kind", F.struct("file_path", "start_line")).alias("kind"), F.min("file_path").alias("file_path"))
    none = F.array().cast("array<string>")
    return meta.join(out, "symbol_id", "full").select("symbol_id", "kind", "file_path", F.coalesce("calls", none).alias("calls"), F.coalesce("uses", none).alias("uses"))


def embedded(chunks: DataFrame, embed: Embedder = retrieve.hash_embedding) -> DataFrame:
    """A vector per symbol, of its last chunk; embed is any column function, a pandas or Arrow one too."""
    last = last_wins(chunks.select("symbol_id", "file_path", "start_line", "content"), ["symbol_id"], ["file_path", "start_line"])
    return last.select("symbol_id", "file_path", "content", embed(rust.enriched(F.col("symbol_id"), F.col("content"))).alias("embedding"))


def branch_name(branch: Column) -> Column:
    return F.substring(F.concat(F.lit("CodeChunk_"), F.regexp_replace(branch, "[^A-Za-z0-9_]", "_")), 1, 63)


def write_branch(vectors: DataFrame, branch: str, folder: str) -> None:
    """The vectors of a branch in place of those it had, in a partition of its own."""
    named = vectors.withColumn("collection", branch_name(F.lit(branch)))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(folder)


def rebuild(files: DataFrame, store: SnapshotStore, embed: Embedder = retrieve.hash_embedding, commit: str | None = None) -> str:
    """Parses files(path, source), derives edges and vectors, and swaps the whole in as a new snapshot."""
    chunks = graph.stage(rust.chunk_files(files))
    edges = graph.stage(edges_of(chunks))
    return store.replace({"commit": commit} if commit else None, chunks=chunks, edges=edges, nodes=node_rows(chunks, edges), vectors=embedded(chunks, embed))


def modified_symbols(files: DataFrame) -> DataFrame:
    """(symbol_id, place): the distinct symbols of changed files(path, source), in order of file and line."""
    c = rust.chunk_files(files, summaries=False)
    return c.groupBy("symbol_id").agg(F.min(F.struct("file_path", "start_line")).alias("place")).select("symbol_id", F.concat_ws(":", "place.file_path", F.format_string("%08d", "place.start_line")).alias("place")).orderBy("place")


def ingest(changes: DataFrame, files: DataFrame, store: SnapshotStore, embed: Embedder = retrieve.hash_embedding, commit: str | None = None) -> str:
    """Takes changes(path, status) into the active snapshot: the changed files and those that depend on their symbols are
    parsed anew from files(path, source), chunks of deleted and parsed files are replaced, and edges follow from the chunks
    of those files and the names of all."""
    old, old_edges = store.load("chunks"), store.load("edges")
    touched = old.join(changes.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("symbol_id").distinct()
    dependents = graph.dependents(old_edges, touched).where("not is_changed")
    near = old.join(dependents, "symbol_id", "left_semi").select(F.col("file_path").alias("path")).distinct()
    gone = changes.where("status = 'deleted'").select(F.col("path").alias("file_path")).distinct()
    todo = near.unionByName(changes.where("status = 'changed'").select("path")).distinct().join(gone, F.col("path") == gone.file_path, "left_anti")
    new = graph.stage(rust.chunk_files(files.join(todo, "path", "left_semi")))
    paths = graph.stage(todo.select(F.col("path").alias("file_path")).unionByName(gone))
    chunks = graph.stage(merge(old, new, paths, ["symbol_id", "file_path", "start_line"]))
    stale = old.join(paths, "file_path", "left_semi").select("symbol_id").distinct()
    known = symbols_of(rust.graph_chunks(chunks)).select("symbol_id").distinct()
    kept = old_edges.join(stale, old_edges.src == stale.symbol_id, "left_anti").join(known, F.col("dst") == F.col("symbol_id"), "left_semi")
    ours = new.select(F.col("symbol_id").alias("src")).distinct()
    edges = graph.stage(kept.unionByName(edges_of(chunks).join(ours, "src", "left_semi").select(*kept.columns)).dropDuplicates(["src", "dst", "relation"]))
    return store.replace({"commit": commit} if commit else None, chunks=chunks, edges=edges, nodes=node_rows(chunks, edges), vectors=embedded(chunks, embed))


def replay(store: SnapshotStore) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, edges, vectors) of the active snapshot in their order, as a fresh process takes them up."""
    return store.load("chunks", ["file_path", "start_line", "symbol_id"]), store.load("edges", ["src", "dst"]), store.load("vectors", ["symbol_id"])


def reembed(store: SnapshotStore, embed: Embedder) -> str:
    """A new snapshot that only differs in its vectors; rollback() returns to the old ones."""
    chunks = store.load("chunks")
    return store.replace(chunks=chunks, edges=store.load("edges"), nodes=store.load("nodes"), vectors=embedded(chunks, embed))


def fuller(store: SnapshotStore, table: str = "vectors") -> str:
    """Of the last two snapshots the one with more rows in the table, the newer at a tie."""
    names = store.header()["history"][-2:]
    counts = [(store.spark.read.parquet(f"{store.root}/{x}/{table}").count(), k, x) for k, x in enumerate(names)]
    return max(counts)[2]
