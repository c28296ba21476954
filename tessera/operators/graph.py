"""Recursive look-ups over a typed property graph.

nodes(id, node_type, name, ...), edges(source_id, target_id, relation_kind), modules(id, path), files(owner_id,
file_path, namespace). Results are sets: every rule head is distinct. Fixpoints are semi-naive: a round joins only
pairs found in the round before, and rounds are written to the cluster's shared folder, so an executor can be lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import materialize

# Kinds of nodes that can be retrieved, and kinds of edges.
PRIMARY = ("function", "const", "enum", "macro", "module", "static", "struct", "trait", "type_alias", "union")
RETRIEVABLE = (*PRIMARY, "method")
CONTAINS = ("Contains",)
PARENT_KINDS = ("Contains", "ImplAssociatedItem", "TraitAssociatedItem")
ITEM_KINDS = (
    "Contains", "StructField", "UnionField", "VariantField", "EnumVariant",
    "ImplAssociatedItem", "TraitAssociatedItem", "ModuleImports", "ReExports",
)
LINK_KINDS = ("ResolvesToDefinition", "CustomPath")
#: Rounds that go one step each; deeper graphs go on in steps that double.
SINGLE_STEPS = 16


def written(df: DataFrame) -> DataFrame:
    """df by way of files in the shared folder, which ends its lineage."""
    return materialize(df, "round")


def parent_of(edges: DataFrame, kinds: Sequence[str] = CONTAINS) -> DataFrame:
    """(child, parent)."""
    return edges.where(F.col("relation_kind").isin(*kinds)).select(F.col("target_id").alias("child"), F.col("source_id").alias("parent")).distinct()


def _doubled(steps: DataFrame) -> DataFrame:
    """Pairs (from, to) of walks twice as long as those of steps."""
    return written(steps.join(steps.select(F.col("from").alias("to"), F.col("to").alias("__far")), "to").select("from", F.col("__far").alias("to")).distinct())


def closure(pairs: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(child, ancestor): the transitive closure of (child, parent), of the children in seeds(id) only if given, however
    deep. Cycles end by themselves, as pairs that are known do not go on."""
    step = pairs.select(F.col("child").alias("ancestor"), F.col("parent").alias("__next"))
    new = pairs.select("child", F.col("parent").alias("ancestor"))
    if seeds is not None:
        new = new.join(seeds.select(F.col("id").alias("child")).distinct(), "child", "left_semi")
    new = written(new.distinct())
    found, length = [new], 1
    while new.limit(1).count() and length < SINGLE_STEPS:
        known = reduce(DataFrame.unionByName, found)
        new = new.join(step, "ancestor").select("child", F.col("__next").alias("ancestor")).distinct()
        new = written(new.join(known, ["child", "ancestor"], "left_anti"))
        found.append(new)
        length += 1
    if not new.limit(1).count():
        return reduce(DataFrame.unionByName, found)
    if seeds is not None:  # only steps that the seeds can take are put together
        ahead = reachable(step.select(F.col("ancestor").alias("source_id"), F.col("__next").alias("target_id")), seeds.select("id"), None)
        step = step.join(written(ahead.select(F.col("id").alias("ancestor"))), "ancestor", "left_semi")
    # walks of up to `length` steps are found; those of exactly `jump` steps, never more than `length`, go on from all
    steps, jump = written(step.select(F.col("ancestor").alias("from"), F.col("__next").alias("to")).distinct()), 1
    while jump * 2 <= length:
        steps, jump = _doubled(steps), jump * 2
    while True:
        known = reduce(DataFrame.unionByName, found)
        new = known.join(steps, F.col("ancestor") == F.col("from")).select("child", F.col("to").alias("ancestor")).distinct()
        new = written(new.join(known, ["child", "ancestor"], "left_anti"))
        if not new.limit(1).count():
            return known
        found.append(new)
        steps = _doubled(steps)


def ancestors(edges: DataFrame, kinds: Sequence[str] = CONTAINS, reflexive: DataFrame | None = None) -> DataFrame:
    """(child, ancestor); with reflexive(id), these are their own ancestors too."""
    found = closure(parent_of(edges, kinds))
    if reflexive is not None:
        found = found.unionByName(reflexive.select(F.col("id").alias("child"), F.col("id").alias("ancestor"))).distinct()
    return found


def reachable(edges: DataFrame, seeds: DataFrame, kinds: Sequence[str] | None = CONTAINS) -> DataFrame:
    """(id, depth): nodes reached from seeds(id) along edges of these kinds (all if None), seeds at depth 0, however
    deep."""
    step = edges if kinds is None else edges.where(F.col("relation_kind").isin(*kinds))
    step = step.select(F.col("source_id").alias("id"), F.col("target_id").alias("__next")).distinct()
    new = written(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    found = [new]
    for depth in range(1, SINGLE_STEPS + 1):
        known = reduce(DataFrame.unionByName, found).select("id")
        new = new.join(step, "id").select(F.col("__next").alias("id")).distinct().join(known, "id", "left_anti")
        new = written(new.withColumn("depth", F.lit(depth)))
        if not new.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        found.append(new)
    # from the last ones on, only nodes that are not known yet lie on a shortest way
    known = reduce(DataFrame.unionByName, found)
    steps = written(step.select(F.col("id").alias("from"), F.col("__next").alias("to")).join(known.select(F.col("id").alias("to")), "to", "left_anti").select("from", "to"))
    beyond, jump = new, 1
    while True:
        # beyond has the nodes fewer than `jump` steps from the last ones, steps the ends of walks of `jump` steps
        new = beyond.join(steps, F.col("id") == F.col("from")).select(F.col("to").alias("id"), (F.col("depth") + jump).alias("depth"))
        new = new.groupBy("id").agg(F.min("depth").alias("depth"))
        new = written(new.join(beyond.select("id"), "id", "left_anti"))
        if not new.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        found.append(new)
        beyond, steps, jump = beyond.unionByName(new), _doubled(steps), jump * 2


#: Marks of a bitmap: a row's page holds the marks from page * PAGE on.
PAGE = 64


def reaching(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, page, marks): for each node the set of numbers (from 0) whose seeds(mark, id) reach it along edges, as a bitmap
    of PAGE marks. One row a node and page, however many marks reach it.

    A round sends on, from nodes whose bitmap grew, only the bits that are new there; what arrives at one node is or-ed by
    the tasks that send it. Rounds are written.
    """
    step = written(edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("__next")).distinct())
    bit = F.expr(f"shiftleft(1L, cast(mark % {PAGE} as int))")
    known = written(seeds.select("id", F.expr(f"cast(mark div {PAGE} as int)").alias("page"), bit.alias("marks")).groupBy("id", "page").agg(F.bit_or("marks").alias("marks")))
    new = known
    while new.limit(1).count():
        came = new.join(step, "id").groupBy(F.col("__next").alias("id"), "page").agg(F.bit_or("marks").alias("__came"))
        both = came.join(known, ["id", "page"], "full").select("id", "page", F.coalesce("__came", F.lit(0)).alias("__came"), F.coalesce("marks", F.lit(0)).alias("__have"))
        both = written(both.select("id", "page", F.col("__came").bitwiseOR(F.col("__have")).alias("marks"), F.col("__came").bitwiseAND(F.bitwise_not("__have")).alias("__fresh")))
        known, new = both.select("id", "page", "marks"), both.where("__fresh != 0").select("id", "page", F.col("__fresh").alias("marks"))
    return known


def file_owner(modules: DataFrame, files: DataFrame, closed: DataFrame) -> DataFrame:
    """(module_id, file_path, namespace): a module's own file, or that of an ancestor."""
    own = modules.select(F.col("id").alias("module_id")).withColumn("owner_id", F.col("module_id"))
    above = own.select("module_id").join(closed.withColumnRenamed("child", "module_id"), "module_id").select("module_id", F.col("ancestor").alias("owner_id"))
    return own.unionByName(above).distinct().join(files, "owner_id").select("module_id", "file_path", "namespace").distinct()


def item_places(nodes: DataFrame, edges: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """(id, node_type, name, module_id, module_path, file_path, namespace): every primary node with the module that
    directly contains it and that module's file."""
    pairs = written(parent_of(edges))
    parents = pairs.withColumnRenamed("child", "id").withColumnRenamed("parent", "module_id")
    owners = file_owner(modules, files, closure(pairs, modules.select("id")))  # only modules' ancestors are asked for
    items = nodes.where(F.col("node_type").isin(*PRIMARY)).select("id", "node_type", "name")
    where = modules.select(F.col("id").alias("module_id"), F.col("path").alias("module_path"))
    return items.join(parents, "id").join(where, "module_id").join(owners, "module_id").distinct()


def walk_counts(asked: DataFrame, places: DataFrame) -> DataFrame:
    """(query, canon, parts, status, matched, items, first_id) of asked(query, canon), paths as `a::b::c`, against the items
    of places: how far each leads into the tree of their paths, for all at once, a row for each that is asked.

    Every beginning of an item's path is a place in that tree, and a path leads as far as its longest beginning that is one.
    status: resolved (the one item of that path), ambiguous (several items of that path), module (a place above items,
    not an item), partial (matched is the part of it that there is), unknown (not even its first part). Null and empty paths are
    unknown; blanks around parts are not part of them. Items of one path are counted, and the least named, before the paths
    meet them: many queries of a path that many items share are not paired with each."""
    parts = F.transform(F.split("canon", "::"), lambda x: F.trim(x))
    rows = asked.select("query", "canon", F.when(F.length(F.trim("canon")) > 0, parts).alias("parts"))
    ends = _item_paths(places).groupBy("path").agg(F.count("*").alias("items"), F.min("id").alias("first_id"))
    begin = lambda path: F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, 1, n)))
    tree = ends.select(begin("path").alias("at")).distinct()
    led = rows.where("parts is not null").select("parts").distinct().select("parts", begin("parts").alias("at")).join(tree, "at", "left_semi")
    depths = led.groupBy("parts").agg(F.max(F.size("at")).alias("depth"))
    found = rows.join(depths, "parts", "left").join(ends.withColumnRenamed("path", "parts"), "parts", "left")
    found = found.withColumns({"depth": F.coalesce("depth", F.lit(0)), "items": F.coalesce("items", F.lit(0))})
    status = (
        F.when(F.col("items") == 1, "resolved").when(F.col("items") > 1, "ambiguous").when(F.col("depth") == 0, "unknown").when(F.col("depth") == F.size("parts"), "module").otherwise("partial")
    )
    matched = F.when(F.col("depth") > 0, F.array_join(F.slice("parts", 1, F.greatest("depth", F.lit(1))), "::"))
    return found.select("query", "canon", "parts", status.alias("status"), matched.alias("matched"), "items", "first_id")


def _item_paths(places: DataFrame) -> DataFrame:
    return places.select("id", F.concat("module_path", F.array("name")).alias("path")).distinct()


def walk_canonical(asked: DataFrame, places: DataFrame) -> DataFrame:
    """(query, canon, status, matched, id): walk_counts with a row for each item of a path that is ambiguous."""
    found = walk_counts(asked, places).join(_item_paths(places).withColumnRenamed("path", "parts"), "parts", "left")
    return found.select("query", "canon", "status", "matched", "id")


def resolve_exact(places: DataFrame, node_type: str | None, file_path: str | None, module_path: Sequence[str], name: str) -> DataFrame:
    """The items of a kind, file, module and name; any kind or file if None."""
    found = places.where((F.col("name") == name) & (F.col("module_path") == F.array(*map(F.lit, module_path))))
    if node_type is not None:
        found = found.where(F.col("node_type") == node_type)
    return found if file_path is None else found.where(F.col("file_path") == file_path)


def resolve_for_edit(places: DataFrame, file_path: str, canon: str) -> DataFrame:
    """Exact matches of a canonical path in a file; without any, matches by path whose file ends like the given one."""
    module, _, name = canon.rpartition("::")
    parts = module.split("::") if module else []
    if parts[:1] != ["crate"]:
        parts = ["crate", *parts]
    loose = resolve_exact(places, None, None, parts, name)
    exact = loose.where(F.col("file_path") == file_path)
    ends = F.col("file_path").endswith(file_path) | F.lit(file_path).endswith(F.col("file_path"))
    ranked = loose.where(ends).join(F.broadcast(exact.limit(1).select(F.lit(True).alias("__any"))), how="left")
    return ranked.where(F.col("__any").isNull() | (F.col("file_path") == file_path)).drop("__any")


def one_for_edit(places: DataFrame, file_path: str, canon: str) -> str:
    """The id of resolve_for_edit's match; raises ValueError unless there is exactly one."""
    found = [r["id"] for r in resolve_for_edit(places, file_path, canon).select("id").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{canon} in {file_path} is " + ("ambiguous" if found else "not known"))
    return found[0]


def canonical_paths(places: DataFrame) -> DataFrame:
    """(id, file_path, canon)."""
    return places.select("id", "file_path", F.concat_ws("::", F.array_join("module_path", "::"), "name").alias("canon"))


def resolve_edges(places: DataFrame, edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Edges of the items in focus(id) whose other end is a placed item: source is always the focus, direction tells
    which way the edge points."""
    kinds = edges.select("source_id", "target_id", "relation_kind").distinct()
    out = kinds.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "relation_kind", F.lit("outgoing").alias("direction"))
    into = kinds.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "relation_kind", F.lit("incoming").alias("direction"))
    ends = out.unionByName(into).join(focus.select("id").distinct(), "id", "left_semi")
    names = places.select("id", F.col("name").alias("source_name")).distinct()
    others = canonical_paths(places).withColumnRenamed("id", "other").join(places.select(F.col("id").alias("other"), F.col("name").alias("target_name")).distinct(), "other")
    return (
        ends.join(names, "id").join(others, "other")
        .select(F.col("id").alias("source_id"), "source_name", F.col("other").alias("target_id"), "target_name", F.col("canon").alias("canon_path"), "relation_kind", "file_path", "direction")
        .distinct()
    )


def prune_unlinked(modules: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pruned ids and the edges that are left: file modules other than the root (path of one part) that no link
    reaches, and everything reachable from them."""
    linked = edges.where(F.col("relation_kind").isin(*LINK_KINDS)).select(F.col("target_id").alias("id")).distinct()
    loose = modules.where(F.size("path") > 1).join(files.select(F.col("owner_id").alias("id")), "id", "left_semi").join(linked, "id", "left_anti")
    gone = reachable(edges, loose.select("id"), None).select("id")
    kept = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return gone, kept


def link_declarations(modules: DataFrame) -> DataFrame:
    """Edges from module declarations to the definitions of the same path."""
    ends = [modules.where(F.col("module_kind") == k).select(F.col("path"), F.col("id").alias(c)) for k, c in (("declaration", "source_id"), ("file", "target_id"))]
    return ends[0].join(ends[1], "path").select("source_id", "target_id", F.lit("ResolvesToDefinition").alias("relation_kind"))


def module_parent(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent): the module that contains a module, or else the one that contains its declaration."""
    direct = parent_of(edges).select(F.col("child").alias("id"), F.col("parent").alias("direct"))
    declared = edges.where(F.col("relation_kind").isin(*LINK_KINDS)).select(F.col("target_id").alias("id"), F.col("source_id").alias("declaration"))
    through = declared.join(parent_of(edges), declared["declaration"] == F.col("child")).select("id", F.col("parent").alias("through"))
    found = modules.select("id").join(direct, "id", "left").join(through, "id", "left")
    return found.select("id", F.coalesce("direct", "through").alias("parent")).where("parent is not null").distinct()


def follow_chain(links: DataFrame, starts: DataFrame, most: int = 100) -> DataFrame:
    """(id, target, hops, status) of following links(source_id, target_id) from starts(id) to where they end; status
    is ok, cycle, or too_long beyond `most` hops."""
    step = links.select(F.col("source_id").alias("target"), F.col("target_id").alias("__next"))
    now = starts.select("id", F.col("id").alias("target"), F.lit(0).alias("hops"), F.array("id").alias("seen"), F.lit("open").alias("status"))
    for _ in range(most + 1):
        moved = now.where("status = 'open'").join(step, "target", "left")
        again = F.array_contains("seen", F.col("__next"))
        status = F.when(F.col("__next").isNull(), "ok").when(again, "cycle").when(F.col("hops") >= most, "too_long").otherwise("open")
        goes = status == "open"
        moved = moved.select(
            "id", F.when(goes, F.col("__next")).otherwise(F.col("target")).alias("target"), (F.col("hops") + goes.cast("int")).alias("hops"),
            F.when(goes, F.array_append("seen", F.col("__next"))).otherwise(F.col("seen")).alias("seen"), status.alias("status"),
        )
        now = written(now.where("status != 'open'").unionByName(moved))
        if not now.where("status = 'open'").limit(1).count():
            break
    return now.select("id", "target", "hops", "status")


#: Items of a path that meet its imports at once, and links that one task makes or so.
IMPORT_BLOCK, TASK_LINKS = 4096, 20_000_000


def import_links(imports: DataFrame, places: DataFrame, modules: DataFrame) -> DataFrame:
    """ImportedBy edges of imports(id, path, is_glob): to the item of that path, or for a glob to every child of the
    module of that path that is public or visible in the crate (visible(id)).

    Imports meet paths first, which have numbers; a path of one item has that item with it, and its links are made there.
    Items that share a path meet its imports in blocks. Items are distinct before that, so the links of an import that asks
    once are distinct as they are and do not move; only those of imports that ask several times are compared."""
    named = canonical_paths(places).select(F.col("id").alias("source_id"), F.split("canon", "::").alias("path"), F.lit(False).alias("is_glob"))
    inside = places.select(F.col("id").alias("source_id"), "module_id", "vis_kind").where(visible_by_glob(F.col("vis_kind")))
    inside = inside.join(modules.select(F.col("id").alias("module_id"), "path"), "module_id").select("source_id", "path", F.lit(True).alias("is_glob"))
    key = ["hash", "path", "is_glob"]  # by the hash first, as paths take long to compare when they are sorted
    offered = written(named.unionByName(inside).distinct().withColumn("hash", F.xxhash64("path", "is_glob")))
    paths = offered.groupBy(*key).agg(F.count("*").alias("n"), F.min("source_id").alias("only"))
    paths = written(paths.select(*key, F.ceil(F.col("n") / IMPORT_BLOCK).alias("blocks"), F.when(F.col("n") == 1, F.col("only")).alias("only"), F.monotonically_increasing_id().alias("at")))
    shared = offered.join(paths.where("only is null"), key).select("source_id", "at", F.pmod(F.xxhash64("source_id"), "blocks").alias("block"))
    asked = imports.select(F.col("id").alias("target_id"), "path", "is_glob", F.xxhash64("path", "is_glob").alias("hash"))
    asked = written(asked.join(paths, key).select("target_id", "at", "blocks", "only"))
    again = written(asked.groupBy("target_id").agg(F.count("*").alias("n")).where("n > 1").select("target_id"))
    met = asked.where("only is null").agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    tasks = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), met * IMPORT_BLOCK // TASK_LINKS)

    def links(some: DataFrame) -> DataFrame:
        out = some.where("only is not null").select(F.col("only").alias("source_id"), "target_id")
        if met:
            blocks = some.where("only is null").select("target_id", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
            # few bytes make many links, so the number of tasks is given
            out = out.unionByName(blocks.repartition(tasks, "at", "block").join(shared.repartition(tasks, "at", "block"), ["at", "block"]).select("source_id", "target_id"))
        return out.select("source_id", "target_id", F.lit("ImportedBy").alias("relation_kind"))

    if not again.limit(1).count():
        return links(asked)
    return links(asked.join(again, "target_id", "left_anti")).unionByName(links(asked.join(again, "target_id", "left_semi")).distinct())


def accessible(pairs: DataFrame, targets: DataFrame, closed: DataFrame) -> DataFrame:
    """pairs(source_id, target_id) with accessible: public and crate-visible modules (targets: id, vis_kind,
    restricted_to, parent) always; a restricted one from its restriction module and below; an inherited one from its
    parent and below."""
    scope = F.when(F.col("vis_kind") == "Restricted", F.col("restricted_to")).when(F.col("vis_kind") == "Inherited", F.col("parent"))
    joined = pairs.join(targets.select(F.col("id").alias("target_id"), "vis_kind", scope.alias("__scope")), "target_id")
    up = closed.select(F.col("child").alias("source_id"), F.col("ancestor").alias("__scope"), F.lit(True).alias("__under"))
    joined = joined.join(up, ["source_id", "__scope"], "left")
    free = F.col("vis_kind").isin("Public", "Crate")
    return joined.select("source_id", "target_id", (free | F.col("source_id").eqNullSafe(F.col("__scope")) | F.coalesce("__under", F.lit(False))).alias("accessible"))


def shortest_public_paths(places: DataFrame, parents: DataFrame, reexports: DataFrame, root: str, most: int = 1000) -> DataFrame:
    """(id, path): the fewest names by which an item is reached from the root module, through public modules
    (parents(id, parent, name, vis_kind)) and re-exports (reexports(id, module_id, name)). Of equally short paths the
    first by name; items that are not public have none. A way of more than `most` names raises a RuntimeError."""
    modules = parents.select("id", "parent", "name", "vis_kind")
    direct = places.where("vis_kind = 'Public'").select("id", F.col("module_id").alias("at"), F.array("name").alias("path"))
    shown = reexports.select("id", F.col("module_id").alias("at"), F.array("name").alias("path"))
    least = lambda df: df.groupBy("id", "at").agg(F.min("path").alias("path"))
    front = written(least(direct.unionByName(shown)))
    seen, done = front.select("id", "at"), None
    for _ in range(most):
        here = front.where(F.col("at") == root).select("id", "path")
        here = here if done is None else here.join(done, "id", "left_anti")
        done = written(here if done is None else done.unionByName(here))
        front = front.join(done, "id", "left_anti")
        above = front.join(modules.where("vis_kind = 'Public'").withColumnRenamed("id", "at"), "at")
        up = above.select("id", F.col("parent").alias("at"), F.concat(F.array("name"), "path").alias("path"))
        side = front.join(reexports.select(F.col("id").alias("at"), F.col("module_id"), F.col("name")), "at")
        side = side.select("id", F.col("module_id").alias("at"), F.concat(F.array("name"), "path").alias("path"))
        front = written(least(up.unionByName(side)).join(seen, ["id", "at"], "left_anti"))
        if not front.limit(1).count():
            break
        seen = written(seen.unionByName(front.select("id", "at")))
    else:
        raise RuntimeError(f"ways of more than {most} names are left")
    return done.select("id", F.concat(F.array(F.lit("crate")), "path").alias("path"))


def duplicate_edges(edges: DataFrame, keys: Sequence[str] = ("source_id", "target_id", "relation_kind")) -> DataFrame:
    return edges.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def visible_by_glob(vis_kind: Column) -> Column:
    return vis_kind.isin("Public", "Crate")


def root_to_leaf(messages: DataFrame, leaf: DataFrame) -> DataFrame:
    """(leaf, id, path_index): the messages from the root (0) to each leaf(id), along messages(id, parent), by pointer
    doubling. A leaf whose path ends at no root (it is a cycle, or a parent is missing) has none."""
    count = messages.count()
    steps = written(messages.where("parent is not null").select(F.col("id").alias("from"), F.col("parent").alias("to")).distinct())
    path = leaf.select(F.col("id").alias("leaf"), "id", F.lit(0).alias("up")).distinct()
    jump = 1
    while jump < 2 * count and steps.limit(1).count():
        # path has the messages fewer than `jump` steps above a leaf, steps the pairs that are `jump` steps apart
        above = path.join(steps, F.col("id") == F.col("from")).select("leaf", F.col("to").alias("id"), (F.col("up") + jump).alias("up"))
        path = written(path.unionByName(above))
        steps, jump = _doubled(steps), jump * 2
    roots = messages.where("parent is null").select("id").distinct()
    ends = path.join(roots, "id", "left_semi").groupBy("leaf").agg(F.max("up").alias("__length"))
    return path.join(ends, "leaf").select("leaf", "id", (F.col("__length") - F.col("up")).alias("path_index"))


def delete_subtree(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """messages(id, parent, ...) without those of ids(id) and all that answer them."""
    edges = messages.where("parent is not null").select(F.col("parent").alias("source_id"), F.col("id").alias("target_id"), F.lit("reply").alias("relation_kind"))
    return messages.join(reachable(edges, ids, None).select("id"), "id", "left_anti")


def crate_files(modules: DataFrame, files: DataFrame, crates: DataFrame, name: str | None = None) -> DataFrame:
    """(crate_id, crate, module_id, path, file_path) of the modules with a file of their own, by namespace; of the crates
    of this name only, if one is given."""
    some = crates if name is None else crates.where(F.col("name") == name)
    some = some.select(F.col("id").alias("crate_id"), F.col("name").alias("crate"), "namespace")
    own = modules.select(F.col("id").alias("owner_id"), F.col("id").alias("module_id"), "path").join(files, "owner_id")
    return own.join(some, "namespace").select("crate_id", "crate", "module_id", "path", "file_path")


def modules_of_file(modules: DataFrame, files: DataFrame, file_path: str) -> DataFrame:
    """(module_id, path, namespace) of the modules whose own file this is."""
    own = files.where(F.col("file_path") == file_path).select(F.col("owner_id").alias("id"), "namespace")
    return modules.join(own, "id").select(F.col("id").alias("module_id"), "path", "namespace")


def merge_graphs(graphs: Sequence[dict[str, DataFrame]], keys: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """One graph of the graphs of single files: each relation is the union of its parts. Raises ValueError if rows of a
    relation share its key, naming some."""
    out = {name: reduce(DataFrame.unionByName, [g[name] for g in graphs if name in g]) for name in dict.fromkeys(n for g in graphs for n in g)}
    for name, key in keys.items():
        twice = duplicate_edges(out[name], key).limit(5).collect() if name in out else []
        if twice:
            raise ValueError(f"{name} has rows that share a key: {[tuple(r[c] for c in key) for r in twice]}")
    return out


def root_rank(file_path: Column) -> Column:
    """Order of root files: main.rs, then lib.rs, then any other."""
    name = F.element_at(F.split(file_path, "/"), -1)
    return F.when(name == "main.rs", 0).when(name == "lib.rs", 1).otherwise(2)


def select_root(roots: DataFrame, by: Sequence[str] = ("namespace",)) -> DataFrame:
    """roots(file_path, ...) with is_root: the first of each group by root_rank, then by path."""
    first = roots.groupBy(*by).agg(F.min(F.struct(root_rank(F.col("file_path")), F.col("file_path"))).alias("__first"))
    first = first.select(*by, F.col("__first.file_path").alias("__root"))
    return roots.join(first, list(by)).withColumn("is_root", F.col("file_path") == F.col("__root")).drop("__root")
