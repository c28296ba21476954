"""A light reader of Rust sources: items of files as nodes and edges.

It recognises items line by line with brace depth (strings, characters and comments are passed over); what a compiler
would need beyond that (macro expansion, types) is left out. Files that cannot be decoded keep their error.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.functions.ids import PROJECT

# Keywords that begin an item, and the kind of node each makes.
KINDS = {
    "fn": "function", "const": "const", "static": "static", "enum": "enum", "struct": "struct", "union": "union",
    "trait": "trait", "type": "type_alias", "mod": "module", "macro_rules!": "macro", "impl": "impl", "use": "import",
}
_SKIP = re.compile(r'//[^\n]*|/\*.*?(?:\*/|$)|b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\.[^\']*|[^\'\\])\'', re.S)
_ITEM = re.compile(
    r"(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|extern(?:\s*\"[^\"]*\")?|const(?=\s+(?:fn|unsafe|extern|async)\b))\s+)*"
    r"(?P<key>macro_rules!|(?:fn|const|static|enum|struct|union|trait|type|mod|impl|use)\b)\s*(?:mut\s+)?(?P<name>[^\W\d]\w*)?"
)

NODES = "file_path string, id string, node_type string, name string, vis_kind string, path array<string>, parent string, span_start long, span_end long, tracking_hash string, error string"


def _blank(match: re.Match) -> str:
    return re.sub(r"[^\n]", " ", match[0])


def module_path(file_path: str) -> list[str]:
    """crate and the modules that a file's place below src stands for."""
    parts = file_path.rpartition("src/")[2].removesuffix(".rs").split("/")
    if parts[-1] in ("mod", "lib", "main"):
        parts = parts[:-1]
    return ["crate", *parts]


def _close(clean: str, at: int) -> int:
    """Place of the brace that closes the one at a place; the last character if none does."""
    depth = 0
    for i in range(at, len(clean)):
        depth += (clean[i] == "{") - (clean[i] == "}")
        if not depth:
            return i
    return len(clean) - 1


def _end(clean: str, at: int, value: bool) -> tuple[int, bool]:
    """Place of an item's semicolon or opening brace, and whether it is a brace; braces of a value are passed over."""
    inside = 0  # round and square brackets
    while at < len(clean):
        c = clean[at]
        inside += (c in "([") - (c in ")]")
        if c == ";" and inside <= 0 or c == "{" and not value:
            break
        at = _close(clean, at) + 1 if c == "{" else at + 1
    return at, at < len(clean) and clean[at] == "{"


def without_comments(source: str) -> str:
    """The source with blanks for comments, strings and characters."""
    return _SKIP.sub(_blank, source)


def parse(file_path: str, source: str, details: bool = False) -> list[dict]:
    """The file's module and its items; spans are byte offsets. With details, also where in the source an item begins
    (lo), its body or semicolon stands (stop), it ends (hi), and what is before it begins (gap), and vis_path."""
    clean = without_comments(source)
    root = module_path(file_path)
    new = lambda kind, name, start, path: str(uuid.uuid5(PROJECT, "\x1f".join([file_path, "::".join(path), name, str(start), kind])))
    top = {"id": new("module", root[-1], 0, root), "node_type": "module", "name": root[-1], "vis_kind": "Public", "path": root, "parent": None, "lo": 0, "hi": len(source), "stop": 0, "gap": 0, "vis_path": None}
    out, stack, depth, at, gap = [top], [(top, 0)], 0, 0, 0
    while at < len(clean):
        c = clean[at]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            while len(stack) > 1 and depth < stack[-1][1]:
                stack.pop()[0]["hi"] = at + 1
        elif (c.isalpha() or c == "_") and (at == 0 or not (clean[at - 1].isalnum() or clean[at - 1] in "_.:!&<'")):
            owner, level = stack[-1]
            found = _ITEM.match(clean, at) if depth == level else None
            if found and (found["name"] or found["key"] in ("impl", "use")):
                kind = KINDS[found["key"]]
                if owner["node_type"] in ("impl", "trait") and kind == "function":
                    kind = "method"
                vis = "Inherited" if not found["vis"] else "Public" if "(" not in found["vis"] else "Crate" if "crate" in found["vis"] else "Restricted"
                stop, body = _end(clean, found.end(), kind in ("const", "static", "import"))
                name = found["name"] or clean[found.end("key") : stop].strip()
                path = [*owner["path"], name] if kind == "module" else owner["path"]
                item = {"id": new(kind, name, at, owner["path"]), "node_type": kind, "name": name, "vis_kind": vis, "path": path, "parent": owner["id"], "lo": at, "hi": stop + 1, "stop": stop, "gap": gap}
                inside = re.search(r"\(\s*(?:in\s+)?([^)]*)\)", found["vis"] or "")
                item["vis_path"] = inside[1].strip().split("::") if inside else None
                out.append(item)
                if body and kind in ("module", "impl", "trait"):
                    depth += 1
                    stack.append((item, depth))
                elif body:  # nothing inside is an item
                    stop = _close(clean, stop)
                    item["hi"] = stop + 1
                at = gap = stop + 1
                continue
            word = re.compile(r"\w+").match(clean, at)
            at = word.end() if word else at + 1
            continue
        at += 1
    ends = [0]  # bytes before each line
    for line in source.split("\n"):
        ends.append(ends[-1] + len(line.encode()) + 1)
    starts = [0]
    for line in source.split("\n"):
        starts.append(starts[-1] + len(line) + 1)

    def to_bytes(n: int) -> int:
        line = bisect.bisect_right(starts, n) - 1
        return ends[line] + len(source[starts[line] : n].encode())

    for item in out:
        body = " ".join(_SKIP.sub(lambda m: m[0] if m[0][:1] not in "/" else " ", source[item["lo"] : item["hi"]]).split())
        item["tracking_hash"] = str(uuid.uuid5(PROJECT, f"{file_path}::CONTENT::{body}"))
        item["span_start"], item["span_end"] = to_bytes(item["lo"]), to_bytes(item["hi"])
        if not details:
            for extra in ("lo", "hi", "stop", "gap", "vis_path"):
                del item[extra]
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """See NODES: items of files(file_path, content); a file that is no text is one row with its error."""
    columns = [x.split()[0] for x in NODES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["file_path"], frame["content"]):
                try:
                    rows += [{"file_path": path, "error": None, **item} for item in parse(path, bytes(content).decode())]
                except UnicodeDecodeError as e:
                    rows.append(dict.fromkeys(columns) | {"file_path": path, "error": str(e)})
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"span_start": "Int64", "span_end": "Int64"})

    return files.select("file_path", "content").mapInPandas(run, NODES)


def to_relations(parsed: DataFrame) -> dict[str, DataFrame]:
    """nodes, modules, files and edges of parsed files."""
    from pyspark.sql import functions as F

    good = parsed.where("error is null")
    inside = F.when(F.col("node_type") == "method", "ImplAssociatedItem").otherwise("Contains")
    root = good.where("parent is null")
    kind = F.when(F.col("parent").isNull(), "file").otherwise("inline")
    return {
        "nodes": good.where("parent is not null").select("id", "node_type", "name", "vis_kind", "tracking_hash", "span_start", "span_end", "file_path"),
        "modules": good.where("node_type = 'module'").select("id", "path", kind.alias("module_kind"), "vis_kind"),
        "files": root.select(F.col("id").alias("owner_id"), "file_path", F.lit("crate").alias("namespace")),
        "edges": good.where("parent is not null").select(F.col("parent").alias("source_id"), F.col("id").alias("target_id"), inside.alias("relation_kind")),
    }
