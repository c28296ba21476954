"""Index lifecycle, compilation-unit masks and the change pipeline."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import text as X
from tessera.operators import embeddings, graph, maintenance, retrieval, temporal
from tessera.sources import files as sources
from tessera.sources import rust_relations

TOKENIZER_VERSION = "code-1"


@dataclasses.dataclass(frozen=True)
class IndexStatus:
    """State of the sparse index: uninitialized, building, ready, empty or error."""

    state: str = "uninitialized"
    docs: int = 0
    message: str = ""

    @classmethod
    def of(cls, index: DataFrame | None) -> "IndexStatus":
        if index is None:
            return cls()
        n = index.select("doc").distinct().count()
        return cls("ready", n) if n else cls("empty")


def build_index(nodes: DataFrame, boost: bool = True) -> DataFrame:
    """Postings of nodes(id, name, text); with boost names count twice and snippets are indexed, else names only. Nodes
    without a name are left out."""
    named = nodes.where(F.length("name") > 0)
    text = retrieval.indexed_text(F.col("name"), F.col("text")) if boost else retrieval.indexed_text(F.col("name"))
    return retrieval.postings(named, X.code_tokens(text), "id")


def save_index(index: DataFrame, path: str) -> None:
    """Postings as Parquet, near their terms, so that a search reads few row groups."""
    index.repartitionByRange("term").sortWithinPartitions("term").write.parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def put_doc_meta(log: DataFrame, nodes: DataFrame, ts: int) -> DataFrame:
    """The log of document facts with an assertion for each of nodes(id, tracking_hash, text)."""
    rows = nodes.select("id", "tracking_hash", F.lit(TOKENIZER_VERSION).alias("tokenizer_version"), F.size(X.code_tokens(F.col("text"))).cast("long").alias("token_length"))
    return temporal.assert_rows(log, rows, F.lit(ts).cast("long"))


def tracking_hash_of(relations: dict[str, DataFrame], id: str) -> DataFrame:
    """(relation, tracking_hash) of a node, wherever it is."""
    found = [df.where(F.col("id") == id).select(F.lit(name).alias("relation"), "tracking_hash") for name, df in relations.items() if {"id", "tracking_hash"} <= set(df.columns)]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def canonical_id(places: DataFrame, canon: str) -> DataFrame:
    """Ids of the items of a canonical path."""
    return graph.canonical_paths(places).where(F.col("canon") == canon).select("id").distinct()


# ---- compilation units


@dataclasses.dataclass
class UnitMasks:
    """Which units enable what, a bitmap of units for each node, edge and file (and page of 64 units): units(number,
    cu_id), nodes(id, page, marks), edges(source_id, target_id, relation_kind, page, marks), files(file_path, page, marks)."""

    units: DataFrame
    nodes: DataFrame
    edges: DataFrame
    files: DataFrame

    def names(self, what: str) -> DataFrame:
        """Rows of nodes, edges or files with cu_id, one for each unit that enables them."""
        rows: DataFrame = getattr(self, what)
        bits = F.filter(F.sequence(F.lit(0), F.lit(graph.PAGE - 1)), lambda b: F.getbit("marks", b) == 1)
        numbers = rows.withColumn("number", F.explode(F.transform(bits, lambda b: F.col("page").cast("long") * graph.PAGE + b)))
        return numbers.drop("page", "marks").join(self.units, "number").drop("number")

    def enabled(self, what: str, units: Sequence[str]) -> DataFrame:
        """Rows that any of the units enables, each by one test of its bitmap; all where none are named."""
        rows: DataFrame = getattr(self, what)
        keys = [c for c in rows.columns if c not in ("page", "marks")]
        if not units:
            return rows.select(*keys).distinct()
        named = self.units.where(F.col("cu_id").isin(*units)).select(F.expr(f"cast(number div {graph.PAGE} as int)").alias("page"), F.expr(f"shiftleft(1L, cast(number % {graph.PAGE} as int))").alias("bit"))
        asked = named.groupBy("page").agg(F.bit_or("bit").alias("asked"))  # no more rows than units are named
        return rows.join(F.broadcast(asked), "page").where(F.col("marks").bitwiseAND(F.col("asked")) != 0).select(*keys).distinct()


def unit_masks(units: DataFrame, files: DataFrame, edges: DataFrame, cfgs: DataFrame | None = None, holds: Column | None = None) -> UnitMasks:
    """Masks of units(cu_id, target_root): nodes reached from the module of the unit's root file, edges both of whose
    ends are enabled, and files that keep a module. Nodes of cfgs(id, ...) for which holds is false are out, with what
    lies below them only. A fixpoint over bitmaps: one row a node, however many units enable it."""
    numbered = graph.written(units.select("cu_id", "target_root").distinct().repartitionByRange("cu_id").sortWithinPartitions("cu_id", "target_root").withColumn("__at", F.monotonically_increasing_id()))
    # numbers are gapless: a partition's begin is the rows of those before
    part = F.shiftright("__at", 33)
    before = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    begins = before.withColumn("__begin", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    numbered = numbered.join(begins, part == F.col("__part")).select("cu_id", "target_root", (F.col("__begin") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"))
    numbered = graph.written(numbered)
    roots = numbered.join(files, F.col("target_root") == F.col("file_path")).select(F.col("number").alias("mark"), F.col("owner_id").alias("id"))
    if cfgs is not None:
        out = cfgs.where(~holds).select("id")
        edges = edges.join(out.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        roots = roots.join(out, "id", "left_anti")
    steps = edges.where(F.col("relation_kind").isin(*graph.ITEM_KINDS, *graph.LINK_KINDS))
    nodes = graph.reaching(steps, roots)
    ends = [nodes.select(F.col("id").alias(c), "page", F.col("marks").alias(f"__{c}")) for c in ("source_id", "target_id")]
    kept = edges.select("source_id", "target_id", "relation_kind").distinct().join(ends[0], "source_id").join(ends[1], ["target_id", "page"])
    kept = kept.select("source_id", "target_id", "relation_kind", "page", F.col("__source_id").bitwiseAND(F.col("__target_id")).alias("marks")).where("marks != 0")
    kept_files = nodes.join(files, F.col("id") == F.col("owner_id")).groupBy("file_path", "page").agg(F.bit_or("marks").alias("marks"))
    return UnitMasks(numbered.select("number", "cu_id"), nodes, kept, kept_files)


def unit_counts(masks: UnitMasks) -> DataFrame:
    """(cu_id, nodes, edges, files): how many of each a unit enables. Each task adds up the bits that it reads."""
    counted = [masks.names(name).groupBy("cu_id").agg(F.count("*").alias(name)) for name in ("nodes", "edges", "files")]
    out = masks.units.select("cu_id").distinct()
    for df in counted:
        out = out.join(df, "cu_id", "left")
    return out.fillna(0)


# ---- changes


def apply_changes(stored: DataFrame, current: DataFrame, files: DataFrame, edges: DataFrame, vectors: DataFrame, set_id: int, ts: int, kinds: Sequence[str] = graph.ITEM_KINDS) -> dict[str, DataFrame]:
    """What a scan of file hashes (file_path, hash) leads to: changes; the ids at or below modules of changed files;
    and the log of vectors with theirs retracted, so that they are pending again."""
    changes = graph.written(maintenance.scan_changes(stored, current))
    modules = files.join(changes, "file_path").select(F.col("owner_id").alias("id"))
    touched = graph.reachable(edges, modules, kinds)
    return {"changes": changes, "touched": touched.select("id"), "vectors": embeddings.retract_changed(vectors, set_id, modules, edges, ts, kinds)}


#: The column of a relation that names the node it belongs to.
OWNERS = ("owner_id", "function_id", "source_id", "id")


def refresh(tables: dict[str, DataFrame], stored: DataFrame, contents: DataFrame, vectors: DataFrame, postings: DataFrame, set_id: int, ts: int) -> dict[str, DataFrame]:
    """The whole change pipeline: files(file_path, content) whose hash is no longer the stored one are read again, alone;
    what was known of them is retracted in all versioned relations, as are the vectors of their items, so that these are
    pending; and the postings of their items are replaced. Returns changes, vectors, postings, and the relations."""
    changes = graph.written(maintenance.scan_changes(stored, sources.file_hashes(contents)))
    now = {name: temporal.live(tables[name], schema.RELATIONS[name].keys) for name in ("file_mod", "syntax_edge")}
    roots = now["file_mod"].join(changes.where("change != 'added'"), "file_path", "left_semi").select(F.col("owner_id").alias("id"))
    old = graph.written(graph.reachable(now["syntax_edge"], roots, graph.ITEM_KINDS).select("id"))
    changed = contents.join(changes.where("change != 'removed'"), "file_path", "left_semi")
    fresh = rust_relations.to_tables(graph.written(rust_relations.parse_rows(changed)), ts)
    out = {}
    for name, table in tables.items():
        owner = next((c for c in OWNERS if c in table.columns), None)
        if owner is None or not schema.RELATIONS[name].versioned:
            known = table.columns[0]
            out[name] = table.unionByName(fresh[name].join(table.select(known).distinct(), known, "left_anti"), allowMissingColumns=True)
            continue
        keys = list(schema.RELATIONS[name].keys)
        gone = table.join(old, table[owner] == old["id"], "left_semi").select(*keys)
        out[name] = graph.written(temporal.retract_rows(table, gone, keys, F.lit(ts - 1).cast("long")).unionByName(fresh[name], allowMissingColumns=True))
    ids = old.select(F.col("id").alias("node_id"), F.lit(set_id).cast("long").alias("set_id"))
    items = fresh["function"].select("id", "name", F.col("body").alias("text")).unionByName(fresh["method"].select("id", "name", F.col("body").alias("text")))
    kept = retrieval.remove_docs(postings, old.select(F.col("id").alias("doc")))
    return {
        "changes": changes,
        "vectors": temporal.retract_rows(vectors, ids, ["node_id", "set_id"], F.lit(ts).cast("long")),
        "postings": kept.unionByName(build_index(items)),
    } | out
