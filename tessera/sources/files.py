"""Sources and sinks: source files, snippets, listings, snapshots and prompts."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kinds of targets by precedence.
TARGET_KINDS = ("Lib", "Bin", "Test", "Example", "Bench")
READ_CAP = 32 * 1024


def source_files(spark: SparkSession, root: str, pattern: str = "*.rs") -> DataFrame:
    """(path, modificationTime, length, content) of the files below root."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)


def workspace_members(root: str, members: Sequence[str]) -> list[str]:
    """Members with a * as (or in) their last part replaced by the folders it stands for; others as they are."""
    out = []
    for member in members:
        head, _, last = member.rpartition("/")
        if last.count("*") != 1 or "*" in head:
            out.append(member)
            continue
        before, _, after = last.partition("*")
        folder = os.path.join(root, head)
        names = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
        out += [f"{head}/{n}" if head else n for n in names if n.startswith(before) and n.endswith(after) and os.path.isdir(os.path.join(folder, n))]
    return out


def target_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TARGET_KINDS)), kind)


def one_target_per_root(targets: DataFrame, rank: Column, ties: Sequence[Column] = ()) -> DataFrame:
    """Of the targets of one root the first by rank, then by name."""
    w = Window.partitionBy("root").orderBy(rank, F.col("name"), *ties)
    return targets.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def file_hashes(contents: DataFrame) -> DataFrame:
    """(file_path, hash). SHA-256 stands for hashes that Spark does not have."""
    return contents.select("file_path", F.sha2("content", 256).alias("hash"))


def read_snippets(requests: DataFrame, contents: DataFrame) -> DataFrame:
    """requests(pos, file_path, start_byte, end_byte, file_hash, ...) with status and snippet: bytes [start, end) of the
    file as text. Status is ok, missing, hash_mismatch, out_of_range, or not_text; nothing raises, and pos keeps the
    order of the requests. Each file is read once for all requests."""
    files = contents.select("file_path", "content", F.sha2("content", 256).alias("__hash"))
    rows = requests.join(files, "file_path", "left")
    size = F.length("content")
    part = F.substring(F.col("content"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int"))
    status = (
        F.when(F.col("content").isNull(), "missing")
        .when(F.col("__hash") != F.col("file_hash"), "hash_mismatch")
        .when((F.col("start_byte") < 0) | (F.col("start_byte") >= F.col("end_byte")) | (F.col("end_byte") > size), "out_of_range")
        .when(~F.is_valid_utf8(part.cast("string")), "not_text")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    return rows.withColumn("snippet", F.when(F.col("status") == "ok", part.cast("string"))).drop("content", "__hash")


def read_text(contents: DataFrame, first_line: int | None = None, last_line: int | None = None, max_bytes: int = READ_CAP) -> DataFrame:
    """(file_path, text, truncated): lines first to last (from 1), cut to max_bytes at a character's border."""
    text = F.decode("content", "UTF-8")
    if first_line is not None or last_line is not None:
        lines = F.split(text, "\n")
        lo = first_line or 1
        count = F.size(lines) if last_line is None else F.lit(max(0, last_line - lo + 1))
        text = F.array_join(F.slice(lines, lo, count), "\n")
    rows = contents.select("file_path", text.alias("text"))
    raw = F.encode("text", "UTF-8")
    # step back over at most three bytes in the middle of a character
    inside = lambda n: F.conv(F.hex(F.substring(raw, max_bytes + 1 - n, 1)), 16, 10).cast("int").bitwiseAND(0xC0) == 0x80
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    head = F.decode(F.substring(raw, F.lit(1), F.lit(max_bytes) - back), "UTF-8")
    over = F.length(raw) > max_bytes
    return rows.select("file_path", F.when(over, head).otherwise(F.col("text")).alias("text"), over.alias("truncated"))


def list_folder(entries: DataFrame, hidden: bool, sort: str, most: int) -> tuple[list, bool]:
    """Names of entries(name, mtime, size) in order, and whether there were more. sort: name, mtime, size or none."""
    if not hidden:
        entries = entries.where(~F.col("name").startswith("."))
    order = {"name": [F.col("name")], "mtime": [F.col("mtime").desc(), F.col("name")], "size": [F.col("size").desc(), F.col("name")], "none": []}[sort]
    rows = (entries.orderBy(*order) if order else entries).limit(most + 1).collect()
    return [r["name"] for r in rows[:most]], len(rows) > most


def path_in_roots(path: str, roots: Sequence[str]) -> bool:
    full = os.path.normpath(path)
    return os.path.isabs(full) and any(full == (r := os.path.normpath(x)) or full.startswith(r.rstrip("/") + "/") for x in roots)


def save_snapshot(relations: dict[str, DataFrame], path: str) -> None:
    """A Parquet folder for each relation, and their names."""
    for name, df in relations.items():
        df.write.parquet(f"{path}/{name}")
    spark = next(iter(relations.values())).sparkSession
    spark.createDataFrame([(n,) for n in sorted(relations)], "name string").coalesce(1).write.parquet(f"{path}/_relations")


def load_snapshot(spark: SparkSession, path: str, skip: Sequence[str] = ()) -> dict[str, DataFrame]:
    names = [r["name"] for r in spark.read.parquet(f"{path}/_relations").collect()]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names if n not in skip}


def read_prompts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(prompt, k, ef, max_hits, radius) of a JSON file: a list of prompts, or with lines one a line."""
    return spark.read.schema("prompt string, k long, ef long, max_hits long, radius double").option("multiLine", not lines).json(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.json(path)


def catalog_relations(spark: SparkSession) -> list[tuple[str, list[str]]]:
    """Relations of the session and their columns."""
    return [(t.name, [c.name for c in spark.catalog.listColumns(t.name)]) for t in spark.catalog.listTables()]


def to_json_text(rows: DataFrame, most: int = 10_000) -> str:
    """Rows as one JSON list, for results that a caller reads whole; raises ValueError beyond `most` rows, which
    write_results() is for."""
    found = rows.limit(most + 1).toJSON().collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    return json.dumps([json.loads(x) for x in found], ensure_ascii=False)
