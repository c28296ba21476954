"""The relations of a code graph: columns, keys and empty DataFrames.

A versioned relation also has ts (microseconds) and is_assert. Keys are wide enough that no two facts collide: edges
include their kind, parameters and attributes their index.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns shared by groups of relations, and each relation's own.
_NODE = "id string, name string, tracking_hash string, span_start long, span_end long, cfgs array<string>"
_ITEM = f"{_NODE}, vis_kind string, vis_path array<string>, docstring string, module_id string"
_TYPED = "type_id string"


@dataclasses.dataclass(frozen=True)
class Relation:
    name: str
    columns: str
    keys: tuple[str, ...]
    versioned: bool = True

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns + (", ts long, is_assert boolean" if self.versioned else ""))

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)


def _all() -> dict[str, Relation]:
    out = [
        Relation("function", f"{_ITEM}, body string, return_type_id string", ("id",)),
        Relation("const", f"{_ITEM}, value string, type_id string", ("id",)),
        Relation("static", f"{_ITEM}, value string, type_id string, is_mutable boolean", ("id",)),
        Relation("enum", f"{_ITEM}, variants array<string>", ("id",)),
        Relation("struct", f"{_ITEM}, fields array<string>", ("id",)),
        Relation("union", f"{_ITEM}, fields array<string>", ("id",)),
        Relation("trait", f"{_ITEM}, methods array<string>", ("id",)),
        Relation("type_alias", f"{_ITEM}, type_id string", ("id",)),
        Relation("macro", f"{_ITEM}, body string", ("id",)),
        Relation("module", f"{_NODE}, vis_kind string, vis_path array<string>, docstring string, path array<string>, module_kind string", ("id",)),
        Relation("impl", f"{_NODE}, self_type string, trait_type string, methods array<string>", ("id",)),
        Relation("import", f"{_NODE}, path array<string>, is_glob boolean, is_reexport boolean", ("id",)),
        Relation("method", f"{_NODE}, owner_id string, vis_kind string, vis_path array<string>, docstring string, body string", ("id", "owner_id")),
        Relation("param", "function_id string, param_index long, name string, type_id string, is_mutable boolean", ("function_id", "param_index")),
        Relation("variant", "id string, owner_id string, index long, name string, discriminant string", ("id", "owner_id")),
        Relation("field", "id string, owner_id string, index long, name string, type_id string, vis_kind string", ("id", "owner_id")),
        Relation("attribute", "owner_id string, index long, name string, args array<string>, value string", ("owner_id", "index")),
        Relation("file_mod", "owner_id string, file_path string, file_docs string, items array<string>, namespace string", ("owner_id",)),
        Relation("syntax_edge", "source_id string, target_id string, relation_kind string, source_kind string, target_kind string", ("source_id", "target_id", "relation_kind")),
        Relation("crate_context", "id string, name string, version string, namespace string, root_path string, files array<string>", ("id",)),
        Relation("workspace_metadata", "id string, namespace string, root_path string, resolver string, members array<string>, exclude array<string>, package_version string", ("id",)),
        Relation("compilation_unit", "id string, namespace string, target_kind string, target_name string, target_root string, target_triple string, profile string, features array<string>, features_hash string", ("id",)),
        Relation("compilation_unit_enabled_node", "cu_id string, node_id string", ("cu_id", "node_id")),
        Relation("compilation_unit_enabled_edge", "cu_id string, source_id string, target_id string, relation_kind string", ("cu_id", "source_id", "target_id", "relation_kind")),
        Relation("compilation_unit_enabled_file", "cu_id string, file_path string", ("cu_id", "file_path")),
        Relation("compilation_unit_meta", "cu_id string, nodes long, edges long, files long", ("cu_id",)),
        Relation("bm25_doc_meta", "id string, tracking_hash string, tokenizer_version string, token_length long", ("id",)),
        Relation("embedding_set", "id long, provider string, model string, dims long, embedding_dtype string, rel_name string", ("id",)),
        Relation("vectors", "node_id string, set_id long, vector array<float>", ("node_id", "set_id")),
        Relation("conversation_turn", "id string, parent_id string, message_id string, kind string, content string, thread_id string", ("id",)),
        Relation("tool_call", "request_id string, call_id string, parent_id string, model string, provider_slug string, tool_name string, args_sha256 string, arguments_json string, status string, ended_at_ms long, latency_ms long, outcome_json string, error_kind string, error_msg string", ("request_id", "call_id")),
        Relation("code_edit_proposal", "request_id string, diffs_json string, confidence double, status string, decided_at_ms long, applied_at_ms long, commit_hash string, results_json string", ("request_id",)),
    ]
    for kind in ("generic_type", "generic_lifetime", "generic_const"):
        out.append(Relation(kind, "id string, owner_id string, name string, bounds array<string>", ("id", "owner_id")))
    own = {
        "named": "path array<string>, is_fully_qualified boolean", "reference": "lifetime string, is_mutable boolean, references_type string", "slice": "element_type string",
        "array": "element_type string, size long", "tuple": "element_types array<string>", "function": "is_unsafe boolean, parameters array<string>, return_type string",
        "never": "", "inferred": "", "raw_pointer": "is_mutable boolean, points_to string", "trait_object": "trait_bounds array<string>", "impl_trait": "trait_bounds array<string>",
        "paren": "inner_type string", "macro": "name string, tokens string", "unknown": "type_str string",
    }
    out += [Relation(f"{kind}_type", _TYPED + (f", {columns}" if columns else ""), ("type_id",)) for kind, columns in own.items()]
    return {r.name: r for r in out}


RELATIONS = _all()


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temporary views of all relations; those without a table are empty."""
    for name, relation in RELATIONS.items():
        tables.get(name, relation.empty(spark)).createOrReplaceTempView(name)
