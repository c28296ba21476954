"""Rows of the code graph's relations, one family of nodes after the other, from the items that rust.parse finds.

Types are read from their text: each distinct type is a row of the relation of its shape, and named by an id that the
text alone decides. What is written in macros or needs a compiler is left out.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions.ids import PROJECT
from tessera.sources import rust

_OPEN, _CLOSE = "([{<", ")]}>"
_ATTRIBUTE = re.compile(r"#!?\[")
_LIFETIME = re.compile(r"'[^\W\d]\w*")
ROWS = "file_path string, relation string, row string"


def split_top(text: str, separator: str) -> list[str]:
    """Parts of a text between separators that no bracket encloses, without blanks around them; empty ones are left out."""
    out, depth, begin, at = [], 0, 0, 0
    while at < len(text):
        c = text[at]
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE and not (c == ">" and at and text[at - 1] in "-="):
            depth -= 1
        elif depth == 0 and text.startswith(separator, at):
            out.append(text[begin:at])
            begin = at = at + len(separator)
            continue
        at += 1
    return [x.strip() for x in [*out, text[begin:]] if x.strip()]


def enclosed(text: str, at: int) -> tuple[str, int]:
    """What the bracket at a place encloses, and the place behind its end."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] in _OPEN:
            depth += 1
        elif text[i] in _CLOSE and not (text[i] == ">" and text[i - 1] in "-="):
            depth -= 1
            if not depth:
                return text[at + 1 : i], i + 1
    return text[at + 1 :], len(text)


def above(gap: str) -> tuple[str, list[dict]]:
    """Docstring and attributes of the text between an item and what stands before it."""
    docs, found, at = [], [], 0
    while at < len(gap):
        if gap.startswith("///", at) and not gap.startswith("////", at):
            end = gap.find("\n", at) % (len(gap) + 1)
            docs.append(gap[at + 3 : end].strip())
            at = end
        elif gap.startswith("//", at):
            at = gap.find("\n", at) % (len(gap) + 1)
        elif gap.startswith("/*", at):
            end = gap.find("*/", at + 2) % (len(gap) + 1)
            if gap.startswith("/**", at) and not gap.startswith("/***", at) and end > at + 3:
                docs += [x.strip().removeprefix("*").strip() for x in gap[at + 3 : end].strip().split("\n")]
            at = end + 2
        elif opened := _ATTRIBUTE.match(gap, at):
            inside, at = enclosed(gap, opened.end() - 1)
            name = re.match(r"[\w:]*", inside.strip())[0]
            rest = inside.strip()[len(name) :].strip()
            args = split_top(enclosed(rest, 0)[0], ",") if rest[:1] == "(" else []
            found.append({"name": name, "args": args, "value": rest[1:].strip().strip('"') if rest[:1] == "=" else None})
        else:
            at += 1
    return "\n".join(docs), found


class Collector:
    """Rows of one file."""

    def __init__(self, file_path: str):
        self.file_path, self.rows, self.types = file_path, [], set()

    def add(self, relation: str, **values) -> None:
        self.rows.append((relation, values))

    def type(self, text: str | None) -> str | None:
        """The id of a type; a row for it, and for the types in it, if it has not occurred yet."""
        text = " ".join((text or "").split())
        if not text:
            return None
        id = str(uuid.uuid5(PROJECT, f"::TYPE::{text}"))
        if id in self.types:
            return id
        self.types.add(id)
        if text[0] == "&":
            rest = text[1:].strip()
            life = _LIFETIME.match(rest)
            rest = rest[life.end() :].strip() if life else rest
            mutable = re.match(r"mut\b", rest) is not None
            self.add("reference_type", type_id=id, lifetime=life and life[0], is_mutable=mutable, references_type=self.type(rest[3 * mutable :]))
        elif text[0] == "*":
            self.add("raw_pointer_type", type_id=id, is_mutable=text.startswith("*mut"), points_to=self.type(re.sub(r"^\*\s*(?:mut|const)\b", "", text)))
        elif text[0] == "[":
            element, *size = split_top(enclosed(text, 0)[0], ";") or [""]
            if size:
                self.add("array_type", type_id=id, element_type=self.type(element), size=int(size[0]) if size[0].isdecimal() else None)
            else:
                self.add("slice_type", type_id=id, element_type=self.type(element))
        elif text[0] == "(" and enclosed(text, 0)[1] == len(text):
            inside = text[1:-1]
            parts = split_top(inside, ",")
            if len(parts) == 1 and not inside.rstrip().endswith(","):
                self.add("paren_type", type_id=id, inner_type=self.type(parts[0]))
            else:
                self.add("tuple_type", type_id=id, element_types=[self.type(x) for x in parts])
        elif found := re.match(r"(unsafe\s+)?(?:extern\s*(?:\"[^\"]*\")?\s*)?fn\s*\(", text):
            parameters, at = enclosed(text, found.end() - 1)
            result = text[at:].strip().removeprefix("->")
            self.add("function_type", type_id=id, is_unsafe=bool(found[1]), parameters=[self.type(x.split(": ", 1)[-1]) for x in split_top(parameters, ",")], return_type=self.type(result))
        elif text in ("!", "_"):
            self.add("never_type" if text == "!" else "inferred_type", type_id=id)
        elif found := re.match(r"(dyn|impl)\b\s*(.*)", text):
            self.add("trait_object_type" if found[1] == "dyn" else "impl_trait_type", type_id=id, trait_bounds=split_top(found[2], "+"))
        elif found := re.match(r"([\w:]+)!\s*[(\[{]", text):
            self.add("macro_type", type_id=id, name=found[1], tokens=enclosed(text, found.end() - 1)[0])
        elif re.match(r"[\w:<]", text):
            plain = re.sub(r"<.*>", "", text) if text[0] != "<" else text
            self.add("named_type", type_id=id, path=split_top(plain, "::"), is_fully_qualified=text.startswith(("::", "<")))
            for argument in split_top(enclosed(text, text.index("<"))[0], ",") if "<" in text[1:] else []:
                if not argument.startswith("'"):
                    self.type(argument.split("=")[-1])
        else:
            self.add("unknown_type", type_id=id, type_str=text)
        return id

    def generics(self, owner: str, text: str) -> None:
        for k, part in enumerate(split_top(text, ",")):
            id = str(uuid.uuid5(PROJECT, f"{owner}::GENERIC::{k}::{part}"))
            head, _, bounds = part.split("=", 1)[0].partition(":")
            kind = "generic_lifetime" if head.startswith("'") else "generic_const" if head.startswith("const ") else "generic_type"
            name = head.strip().removeprefix("const ").strip()
            self.add(kind, id=id, owner_id=owner, name=name, bounds=[bounds.strip()] if kind == "generic_const" else split_top(bounds, "+"))

    def edge(self, source: str, target: str, relation: str, source_kind: str, target_kind: str) -> None:
        self.add("syntax_edge", source_id=source, target_id=target, relation_kind=relation, source_kind=source_kind, target_kind=target_kind)

    def fields(self, owner: str, text: str, named: bool, kind: str) -> list[str]:
        """Fields of a struct, union or variant."""
        out = []
        for k, part in enumerate(split_top(text, ",")):
            docs, attributes = above(part)
            part = re.sub(r"^(?:\s|//[^\n]*(?:\n|$)|/\*.*?\*/|#\[[^\]]*\])*", "", part, flags=re.S)
            if not part:
                continue
            vis = re.match(r"pub\b\s*(\([^)]*\))?\s*", part)
            body = part[vis.end() :] if vis else part
            name, _, of = body.partition(":") if named else (str(k), "", body)
            id = str(uuid.uuid5(PROJECT, f"{owner}::FIELD::{k}::{name.strip()}"))
            seen = "Inherited" if not vis else "Public" if not vis[1] else "Crate" if "crate" in vis[1] else "Restricted"
            self.add("field", id=id, owner_id=owner, index=k, name=name.strip(), type_id=self.type(of), vis_kind=seen)
            self.edge(owner, id, f"{kind.capitalize()}Field", kind, "field")
            self.attributes(id, attributes)
            out.append(id)
        return out

    def attributes(self, owner: str, found: list[dict]) -> None:
        for k, x in enumerate(found):
            self.add("attribute", owner_id=owner, index=k, name=x["name"], args=x["args"], value=x["value"])


def use_paths(tree: str, before: tuple[str, ...] = ()) -> list[tuple[list[str], str, bool]]:
    """(path, name it is visible by, whether it is a glob) of each leaf of a use tree."""
    tree = tree.strip()
    if tree.startswith("{"):
        return [x for part in split_top(enclosed(tree, 0)[0], ",") for x in use_paths(part, before)]
    head, mark, rest = tree.partition("::")
    if mark and not head.startswith("{"):
        return use_paths(rest, (*before, head.strip()) if head.strip() else before)
    path, _, alias = (x.strip() for x in tree.partition(" as "))
    if path == "*":
        return [(list(before), "*", True)]
    if path == "self":
        return [(list(before), alias or (before[-1] if before else "self"), False)]
    return [([*before, path], alias or path, False)]


def rows_of(file_path: str, source: str) -> list[tuple[str, dict]]:
    """(relation, values) of a file."""
    found = rust.parse(file_path, source, details=True)
    clean = rust.without_comments(source)
    made = Collector(file_path)
    by_id = {x["id"]: x for x in found}
    children: dict[str, list[dict]] = {}
    for x in found[1:]:
        children.setdefault(x["parent"], []).append(x)
    for x in found:
        kind, id, lo, stop, hi = x["node_type"], x["id"], x["lo"], x["stop"], x["hi"]
        docs, attributes = above(source[x["gap"] : lo])
        made.attributes(id, attributes)
        cfgs = [", ".join(a["args"]) for a in attributes if a["name"] == "cfg"]
        parent = by_id.get(x["parent"])
        node = {"id": id, "name": x["name"], "tracking_hash": x["tracking_hash"], "span_start": x["span_start"], "span_end": x["span_end"], "cfgs": cfgs}
        shown = {"vis_kind": x["vis_kind"], "vis_path": x["vis_path"], "docstring": docs or None}
        item = node | shown | {"module_id": x["parent"]}
        head, body = clean[lo:stop], source[stop:hi]
        after = head.find(x["name"]) + len(x["name"]) if x["name"] in head else len(head)
        tail = head[after:].lstrip() if kind not in ("impl", "import") else ""
        if tail.startswith("<"):
            parameters, at = enclosed(tail, 0)
            made.generics(id, parameters)
            tail = tail[at:].lstrip()
        if parent is not None:
            edge = "ImplAssociatedItem" if parent["node_type"] == "impl" else "TraitAssociatedItem" if parent["node_type"] == "trait" else "Contains"
            made.edge(parent["id"], id, edge, parent["node_type"], kind)
        if kind == "module":
            made.add("module", **node, **shown, path=x["path"], module_kind="file" if parent is None else "inline" if body.startswith("{") else "declaration")
            if parent is None:
                made.add("file_mod", owner_id=id, file_path=file_path, file_docs=None, items=[c["id"] for c in children.get(id, [])], namespace="crate")
        elif kind in ("function", "method"):
            parameters, at = enclosed(tail, 0) if tail.startswith("(") else ("", 0)
            result = re.split(r"\bwhere\b", tail[at:].strip().removeprefix("->"))[0] if "->" in tail[at:] else ""
            for k, part in enumerate(split_top(parameters, ",")):
                part = re.sub(r"^(?:#\[[^\]]*\]\s*)*", "", part)
                name, _, of = (part, "", part) if re.match(r"(?:&\s*(?:'\w+\s*)?)?(?:mut\s+)?self\b", part) else part.partition(":")
                made.add("param", function_id=id, param_index=k, name=re.sub(r"^\s*mut\s+", "", name).strip(), type_id=made.type(of.replace("self", "Self") if of == part else of), is_mutable=name.strip().startswith("mut "))
            if kind == "function":
                made.add("function", **item, body=body, return_type_id=made.type(result))
            else:
                made.add("method", **node, owner_id=x["parent"], **shown, body=body)
                made.type(result)
        elif kind in ("const", "static"):
            of, _, value = tail.removeprefix(":").partition("=")
            extra = {"is_mutable": re.search(r"\bstatic\s+mut\b", head) is not None} if kind == "static" else {}
            made.add(kind, **item, value=value.strip() or None, type_id=made.type(of), **extra)
        elif kind in ("struct", "union"):
            tuple_body = enclosed(tail, 0)[0] if tail.startswith("(") else None
            inside = clean[stop + 1 : hi - 1] if body.startswith("{") else ""
            ids = made.fields(id, source_like(source, clean, stop + 1, hi - 1) if body.startswith("{") else inside, True, kind) if tuple_body is None else made.fields(id, tuple_body, False, kind)
            made.add(kind, **item, fields=ids)
        elif kind == "enum":
            ids = []
            for k, part in enumerate(split_top(clean[stop + 1 : hi - 1], ",")):
                part = re.sub(r"^(?:\s|#\[[^\]]*\])*", "", part)
                name = re.match(r"\w*", part)[0]
                if not name:
                    continue
                rest = part[len(name) :].strip()
                variant = str(uuid.uuid5(PROJECT, f"{id}::VARIANT::{k}::{name}"))
                if rest[:1] in ("(", "{"):
                    inside, at = enclosed(rest, 0)
                    made.fields(variant, inside, rest[0] == "{", "variant")
                    rest = rest[at:].strip()
                made.add("variant", id=variant, owner_id=id, index=k, name=name, discriminant=rest[1:].strip() if rest[:1] == "=" else None)
                made.edge(id, variant, "EnumVariant", "enum", "variant")
                ids.append(variant)
            made.add("enum", **item, variants=ids)
        elif kind == "trait":
            made.add("trait", **item, methods=[c["id"] for c in children.get(id, []) if c["node_type"] == "method"])
        elif kind == "type_alias":
            made.add("type_alias", **item, type_id=made.type(tail.lstrip().removeprefix("=")))
        elif kind == "macro":
            made.add("macro", **item, body=body)
        elif kind == "impl":
            rest = head[head.index("impl") + 4 :].strip()
            if rest.startswith("<"):
                parameters, at = enclosed(rest, 0)
                made.generics(id, parameters)
                rest = rest[at:].strip()
            parts = split_top(re.split(r"\bwhere\b", rest)[0], " for ")
            made.add("impl", **node, self_type=made.type(parts[-1]), trait_type=made.type(parts[0]) if len(parts) > 1 else None, methods=[c["id"] for c in children.get(id, []) if c["node_type"] == "method"])
        elif kind == "import":
            for k, (path, name, glob) in enumerate(use_paths(head[re.search(r"\buse\b", head).end() :])):
                made.add("import", **(node | {"id": id if k == 0 else str(uuid.uuid5(PROJECT, f"{id}::USE::{k}")), "name": name}), path=path, is_glob=glob, is_reexport=x["vis_kind"] != "Inherited")
    return made.rows


def source_like(source: str, clean: str, lo: int, hi: int) -> str:
    """A stretch without comments, but with its attributes and strings."""
    return "".join(c if c != " " or s in " \n" else s if s not in "/" else " " for c, s in zip(clean[lo:hi], source[lo:hi])) if "#[" in clean[lo:hi] else clean[lo:hi]


#: Files that a task parses at most on average, and rows of a batch that it hands over.
FILES_PER_TASK, BATCH_ROWS = 8192, 20_000


def parse_rows(files: DataFrame) -> DataFrame:
    """See ROWS: the rows of all relations of files(file_path, content), each as JSON; a file that is no text has one row
    of the relation error. Files are dealt to tasks by their number, as many of them may lie in one small Parquet file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = json.JSONEncoder(ensure_ascii=False).encode
        for batch in batches:
            paths, relations, values = [], [], []
            for path, content in zip(batch.column("file_path").to_pylist(), batch.column("content")):
                try:
                    rows = rows_of(path, (content.as_py() or b"").decode())
                except UnicodeDecodeError as e:
                    rows = [("error", {"message": str(e)})]
                paths += [path] * len(rows)
                relations += [r for r, _ in rows]
                values += [encode(v) for _, v in rows]
                if len(paths) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (paths, relations, values)], ["file_path", "relation", "row"])
                    paths, relations, values = [], [], []
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (paths, relations, values)], ["file_path", "relation", "row"])

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // FILES_PER_TASK))
    return files.select("file_path", "content").repartition(tasks, "file_path").mapInArrow(run, ROWS)


def to_tables(rows: DataFrame, ts: int) -> dict[str, DataFrame]:
    """The relations of the schema as of a moment, from written parse_rows(); types that several files name are one row."""
    out = {}
    for name, relation in schema.RELATIONS.items():
        own = rows.where(F.col("relation") == name).select(F.from_json("row", relation.columns).alias("r")).select("r.*")
        own = own.dropDuplicates(["type_id"]) if "type_id" in relation.keys else own
        out[name] = own.withColumn("ts", F.lit(ts).cast("long")).withColumn("is_assert", F.lit(True)) if relation.versioned else own
    return out
