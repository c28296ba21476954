"""Deterministic ids as Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of all ids made here.
PROJECT = uuid.uuid5(uuid.NAMESPACE_DNS, "tessera.example")


def uuid5(namespace: uuid.UUID | Column, name: Column) -> Column:
    """Name-based UUID (version 5) of a binary or string name, equal to Python's uuid.uuid5."""
    if isinstance(namespace, uuid.UUID):
        space = F.lit(namespace.hex)
    else:
        space = F.regexp_replace(namespace, "-", "")
    hashed = F.sha1(F.concat(F.unhex(space), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(hashed, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(hashed, 1, 8),
        F.substring(hashed, 9, 4),
        F.concat(F.lit("5"), F.substring(hashed, 14, 3)),
        F.concat(variant, F.substring(hashed, 18, 3)),
        F.substring(hashed, 21, 12),
    )


def joined(*parts: Column) -> Column:
    """Parts with a separator that does not occur in them, as a name."""
    return F.concat_ws("\x1f", *(p.cast("string") for p in parts))


def node_id(crate: Column, file_path: Column, module_path: Column, name: Column, start: Column, end: Column, kind: Column) -> Column:
    return uuid5(PROJECT, joined(crate, file_path, F.array_join(module_path, "::"), name, start, end, kind))


def tracking_hash(crate: Column, file_path: Column, content: Column) -> Column:
    """Changes whenever the (normalised) content does."""
    return uuid5(PROJECT, F.concat(crate, F.lit("::FILE::"), file_path, F.lit("::CONTENT::"), content))


def crate_namespace(name: Column) -> Column:
    """One for each crate name, whatever the version."""
    return uuid5(PROJECT, name)


def embedding_set_id(provider: Column, model: Column, dims: Column) -> Column:
    """The first 64 bits of the set's UUID, as a signed number."""
    head = F.substring(F.regexp_replace(uuid5(PROJECT, joined(provider, model, dims)), "-", ""), 1, 16)
    high, low = (F.conv(F.substring(head, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def relation_name(model: Column, dims: Column) -> Column:
    safe = F.replace(F.replace(model, F.lit("-"), F.lit("_")), F.lit("/"), F.lit("_slash_"))
    return F.concat(F.lit("emb_"), safe, F.lit("_"), dims.cast("string"))


def compilation_unit_id(namespace: Column, target: Column, triple: Column, profile: Column, features: Column) -> Column:
    """Features count as a set."""
    return uuid5(PROJECT, joined(namespace, target, triple, profile, F.array_join(F.array_sort(F.array_distinct(features)), ",")))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
