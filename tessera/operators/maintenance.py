"""Pending work, namespaces, change detection, masks and edit acceptance."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph

# ---- pending work


def pending(nodes: DataFrame, embedded: DataFrame, key: str = "id") -> DataFrame:
    """Nodes without a live vector."""
    return nodes.join(embedded.select(key).distinct(), key, "left_anti")


def complete(nodes: DataFrame, embedded: DataFrame, key: str = "id") -> DataFrame:
    return nodes.join(embedded.select(key).distinct(), key, "left_semi")


def keyset_page(rows: DataFrame, cursor: str, size: int, key: str = "id") -> DataFrame:
    """The next rows behind a cursor, by the key's text."""
    text = F.col(key).cast("string")
    return rows.where(text > cursor).orderBy(text).limit(size)


def fill_by_kind(rows: DataFrame, kinds: Sequence[str], size: int, kind: str = "node_type", key: str = "id") -> DataFrame:
    """A page filled kind by kind, in the order given."""
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    return rows.where(F.col(kind).isin(*kinds)).orderBy(rank, F.col(key)).limit(size)


def ordered_lookup(rows: DataFrame, ids: Sequence, key: str = "id") -> DataFrame:
    """Rows of the ids, with pos: their place in the list. Ids without a row are missing."""
    spark = rows.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, ids))).alias("pos", key))
    return F.broadcast(wanted).join(rows, key)


# ---- namespaces


def inventory(crates: DataFrame, files: DataFrame, edges: DataFrame, namespace: str) -> DataFrame:
    """(id, role): the namespace's crate row, file owners and everything they contain. The crate must be one."""
    own = crates.where(F.col("namespace") == namespace)
    if own.limit(2).count() != 1:
        raise ValueError(f"namespace {namespace} has not exactly one crate")
    owners = files.where(F.col("namespace") == namespace).select(F.col("owner_id").alias("id"))
    down = graph.reachable(edges, owners, graph.PARENT_KINDS)
    role = F.when(F.col("depth") == 0, "file").otherwise("node")
    return own.select("id", F.lit("crate").alias("role")).unionByName(down.select("id", role.alias("role")))


def export(relations: dict[str, tuple[DataFrame, str]], ids: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Rows of each relation (name -> DataFrame, key) whose key is in ids, and edges that touch one."""
    wanted = ids.select("id").distinct()
    out = {name: df.join(wanted, df[key] == wanted["id"], "left_semi") for name, (df, key) in relations.items()}
    return out | {"edges": edges_touching(edges, wanted)}


def edges_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    out = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    into = edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return out.unionByName(into, allowMissingColumns=True).distinct()


def conflicts(existing: DataFrame, incoming: DataFrame, columns: Sequence[str] = ("namespace", "name", "root_path")) -> DataFrame:
    """(field, value): what incoming crates have in common with existing ones; an import needs none."""
    parts = [
        existing.select(F.col(c).alias("value")).intersect(incoming.select(F.col(c).alias("value"))).select(F.lit(c).alias("field"), "value")
        for c in columns
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def import_rows(existing: dict[str, DataFrame], incoming: dict[str, DataFrame], report: DataFrame) -> dict[str, DataFrame]:
    """Existing relations with the incoming rows, if the report of conflicts is empty."""
    if report.limit(1).count():
        raise ValueError("conflicts: " + ", ".join(f"{r.field}={r.value}" for r in report.limit(5).collect()))
    return {name: df.unionByName(incoming[name], allowMissingColumns=True) if name in incoming else df for name, df in existing.items()}


def workspace_conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(field, value): roots of incoming workspaces(namespace, root_path, members) other than the one that is loaded."""
    roots = existing.select(F.col("root_path").alias("__root")).distinct()
    other = incoming.select(F.col("root_path").alias("value")).distinct().join(F.broadcast(roots.agg(F.min("__root").alias("__root"))))
    return other.where("__root is not null and value != __root").select(F.lit("workspace_root").alias("field"), "value")


def merge_workspaces(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """workspaces(root_path, members): one row for each root, with the members of both, sorted."""
    every = existing.select("root_path", "members").unionByName(incoming.select("root_path", "members"))
    return every.groupBy("root_path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))


def import_namespace(existing: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], set[str]]:
    """Relations after an import, and the indexes that it makes stale. crates(namespace, name, root_path) and, if there,
    workspaces(root_path, members) must not conflict; workspaces are merged, other relations appended."""
    report = conflicts(existing["crates"], incoming["crates"])
    if "workspaces" in existing and "workspaces" in incoming:
        report = report.unionByName(workspace_conflicts(existing["workspaces"], incoming["workspaces"]))
    out = import_rows(existing, incoming, report)
    if "workspaces" in existing and "workspaces" in incoming:
        out["workspaces"] = merge_workspaces(existing["workspaces"], incoming["workspaces"])
    return out, {"sparse", "dense"}


def remove_namespace(relations: dict[str, tuple[DataFrame, str]], crates: DataFrame, files: DataFrame, edges: DataFrame, workspaces: DataFrame, namespace: str) -> tuple[dict[str, DataFrame], set[str]]:
    """Relations without a namespace: its inventory's rows, the edges that touch them, its crate and files, and its place
    among the workspaces' members; and the indexes that this makes stale (none if nothing was removed)."""
    ids = graph.written(inventory(crates, files, edges, namespace).select("id"))
    out = remove(relations, ids, edges)
    out["crates"], out["files"] = (df.where(F.col("namespace") != namespace) for df in (crates, files))
    out["workspaces"] = workspaces.withColumn("members", F.array_remove("members", namespace))
    return out, {"sparse", "dense"} if ids.limit(1).count() else set()


def remove(relations: dict[str, tuple[DataFrame, str]], ids: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Relations without the rows of ids, and edges without those that touch one."""
    gone = ids.select("id").distinct()
    out = {name: df.join(gone, df[key] == gone["id"], "left_anti") for name, (df, key) in relations.items()}
    kept = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    return out | {"edges": kept.join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")}


def clear(relations: dict[str, DataFrame], names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Relations with those named (all if None) left without rows; an unknown name raises KeyError."""
    for name in names or ():
        relations[name]
    return {n: df.limit(0) if names is None or n in names else df for n, df in relations.items()}


def count_relations(relations: dict[str, DataFrame]) -> DataFrame:
    """(relation, rows), by one pass over each."""
    counted = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("relation"), "rows") for n, df in sorted(relations.items())]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out


def drift(loaded: DataFrame, current: DataFrame, key: str = "member") -> DataFrame:
    """(member, change): added to or removed from the loaded set."""
    a, b = loaded.select(key).distinct(), current.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


# ---- changes and masks


def scan_changes(stored: DataFrame, current: DataFrame, key: str = "file_path", hash: str = "hash") -> DataFrame:
    """(file_path, change): added, removed or modified, by hash. Being there is one thing and having a hash another: a file
    whose hash was or is unknown (null) is modified where only one of them is, and unchanged where both are."""
    here = lambda name: F.lit(True).alias(name)
    both = stored.select(key, F.col(hash).alias("__old"), here("__was")).join(current.select(key, F.col(hash).alias("__new"), here("__is")), key, "full")
    change = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    return both.withColumn("change", change).where("change is not null").select(key, "change")


def freshness(crates: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """(namespace, files, stale): per crate, how many of its files changed."""
    counted = files.join(changes, "file_path", "left").groupBy("namespace").agg(F.count("*").alias("files"), F.count_if(F.col("change").isNotNull()).alias("stale"))
    return crates.select("namespace").distinct().join(counted, "namespace", "left").fillna(0)


def cross_units(targets: DataFrame, triples: Sequence[str], profiles: Sequence[str], feature_sets: Sequence[Sequence[str]]) -> DataFrame:
    """Every combination of target, triple, profile and (sorted, distinct) feature set."""
    lists = [F.array(*map(F.lit, x)) for x in (triples, profiles)]
    sets = F.array(*(F.array_sort(F.array_distinct(F.array(*map(F.lit, s)).cast("array<string>"))) for s in feature_sets))
    return targets.withColumn("triple", F.explode(lists[0])).withColumn("profile", F.explode(lists[1])).withColumn("features", F.explode(sets))


def mask_nodes(nodes: DataFrame, enabled: DataFrame, units: Sequence, key: str = "id") -> DataFrame:
    """Nodes enabled in any of the units; all nodes if none are named."""
    if not units:
        return nodes
    return nodes.join(enabled.where(F.col("cu_id").isin(*units)).select(F.col("node_id").alias(key)), key, "left_semi")


def mask_edges(edges: DataFrame, enabled: DataFrame) -> DataFrame:
    """(cu_id, edge): edges both of whose ends are enabled in a unit."""
    sources = enabled.select("cu_id", F.col("node_id").alias("source_id"))
    targets = enabled.select("cu_id", F.col("node_id").alias("target_id"))
    return edges.join(sources, "source_id").join(targets, ["cu_id", "target_id"], "left_semi")


def cfg_column(text: str, atoms: dict[str, Column]) -> Column:
    """A cfg predicate as a boolean Column: all(..), any(..), not(..), or an atom such as `unix` or `feature = "x"`, looked
    up in atoms by its normalised text. What cannot be read, and unknown atoms, are false."""
    pos = 0

    def blanks() -> None:
        nonlocal pos
        while pos < len(text) and text[pos].isspace():
            pos += 1

    def one() -> Column:
        nonlocal pos
        blanks()
        start = pos
        while pos < len(text) and (text[pos].isalnum() or text[pos] in "_-"):
            pos += 1
        word = text[start:pos]
        if not word:
            raise ValueError("a word is missing")
        blanks()
        if text[pos : pos + 1] == "(":
            pos += 1
            inner: list[Column] = []
            blanks()
            while text[pos : pos + 1] != ")":
                inner.append(one())
                blanks()
                if text[pos : pos + 1] == ",":
                    pos += 1
                    blanks()
                elif text[pos : pos + 1] != ")":
                    raise ValueError("not closed")
            pos += 1
            if word == "not" and len(inner) == 1:
                return ~inner[0]
            if word not in ("all", "any"):
                raise ValueError(f"unknown {word}")
            out = F.lit(word == "all")
            for c in inner:
                out = out & c if word == "all" else out | c
            return out
        if text[pos : pos + 1] == "=":
            end = text.index('"', text.index('"', pos) + 1) + 1
            word, pos = f"{word}={text[pos + 1 : end].strip()}", end
        return atoms.get(word, F.lit(False))

    try:
        found = one()
        blanks()
        return found if pos == len(text) else F.lit(False)
    except ValueError:
        return F.lit(False)


# ---- edits


def overlaps(edits: DataFrame) -> DataFrame:
    """(a, b): edits(id, file, start, end) of one file whose ranges overlap; reversed ranges are turned round, empty ones
    widened by 1.

    A range of up to 2**n bytes lies in two cells of 2**n at most. Ranges meet in the cells of the longer one, so edits of
    one file that are far apart never do, however many it has.
    """
    r = _ranges(edits).withColumn("level", F.ceil(F.log2((F.col("hi") - F.col("lo")).cast("double"))).cast("int"))
    cells = lambda level: F.explode(F.sequence(F.expr(f"shiftright(lo, {level})"), F.expr(f"shiftright(hi - 1, {level})")))
    own = r.select("file", "id", "lo", "hi", "level", cells("level").alias("cell"))
    levels = r.select("file", F.col("level").alias("__at")).distinct()
    met = r.join(levels, "file").where("__at >= level").select("file", F.col("id").alias("__id"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("level").alias("__level"), F.col("__at").alias("level"), cells("__at").alias("cell"))
    pairs = own.join(met, ["file", "level", "cell"]).where("(__level < level OR id < __id) AND id != __id AND lo < __hi AND __lo < hi")
    return pairs.select(F.least("id", "__id").alias("a"), F.greatest("id", "__id").alias("b")).distinct()


def _ranges(edits: DataFrame) -> DataFrame:
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    return edits.withColumn("lo", lo).withColumn("hi", F.when(lo == hi, hi + 1).otherwise(hi))


class Spans:
    """Disjoint ranges in order: whether another one is free, and taking it, by bisection. Ranges that touch are put
    together, so there are never more than those that were taken."""

    def __init__(self):
        self.lo: list[int] = []
        self.hi: list[int] = []

    def free(self, lo: int, hi: int) -> bool:
        i = bisect.bisect_left(self.hi, lo + 1)  # the first that ends behind lo
        return i == len(self.lo) or self.lo[i] >= hi

    def take(self, lo: int, hi: int) -> None:
        i = bisect.bisect_left(self.hi, lo)
        j = bisect.bisect_right(self.lo, hi)
        if i < j:
            lo, hi = min(lo, self.lo[i]), max(hi, self.hi[j - 1])
        self.lo[i:j], self.hi[i:j] = [lo], [hi]


def accept_greedily(edits: DataFrame) -> DataFrame:
    """(id, status) of proposals with edits(id, proposed_at, file, start, end): the newest first (then the largest id; a
    null proposed_at is the oldest), each is accepted unless it overlaps an accepted one; the others are Stale. Every
    proposal with an id comes back: one whose edits name no file (or no range) overlaps nothing there. Ranges of one
    proposal may overlap each other. A proposal's time is the newest of its edits.

    Only what overlaps matters. A file's ranges, sorted, fall into stretches that no range leaves; proposals that stretches
    connect are decided in one task, in the order of time, by bisection of what is taken in each file; all others are
    accepted where they stand. No pair of ranges is ever listed.
    """
    rows = edits.where("id is not null").select(F.col("id").cast("string").alias("id"), "proposed_at", "file", "start", "end")
    rows = graph.written(rows.withColumn("edit", F.monotonically_increasing_id()))  # edits get names: a proposal has several
    placed = rows.where("file is not null and start is not null and end is not null")
    w = Window.partitionBy("file").orderBy("lo", "hi", "edit")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = _ranges(placed).withColumn("begins", (before.isNull() | (F.col("lo") >= before)).cast("int"))
    stretches = graph.written(begins.select("id", "file", F.sum("begins").over(w).alias("stretch")).distinct())
    shared = stretches.groupBy("file", "stretch").agg(F.count("*").alias("n")).where("n > 1").select("file", "stretch")
    links = stretches.join(shared, ["file", "stretch"]).select(F.concat(F.lit("p:"), "id").alias("source_id"), F.concat_ws(":", F.lit("s"), "stretch", "file").alias("target_id"))
    links = graph.written(links)
    proposals = rows.groupBy("id").agg(F.max("proposed_at").alias("at"))
    if not links.limit(1).count():
        return proposals.select("id", F.lit("Accepted").alias("status"))
    groups = component_labels(links).where(F.col("id").startswith("p:")).select(F.expr("substring(id, 3)").alias("id"), "label")
    groups = graph.written(groups)
    ranges = _ranges(placed).join(groups, "id").join(graph.written(proposals), "id")
    order = [F.col("at").desc_nulls_last(), F.col("id").desc()]
    work = ranges.select("label", "id", "at", "file", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).repartition("label").sortWithinPartitions("label", *order)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken, own = None, {}, []

        def settle() -> str:
            free = all(taken[f].free(lo, hi) for f, lo, hi in own if f in taken)
            for f, lo, hi in own if free else ():
                taken.setdefault(f, Spans()).take(lo, hi)
            return "Accepted" if free else "Stale"

        for batch in batches:
            out = []
            for label, proposal, file, lo, hi in zip(batch["label"], batch["id"], batch["file"], batch["lo"].tolist(), batch["hi"].tolist()):
                if now != (label, proposal):
                    if now is not None:
                        out.append((now[1], settle()))
                    if now is None or now[0] != label:
                        taken = {}
                    now, own = (label, proposal), []
                own.append((file, lo, hi))
            yield pd.DataFrame(out, columns=["id", "status"])
        if now is not None:
            yield pd.DataFrame([(now[1], settle())], columns=["id", "status"])

    decided = work.mapInPandas(decide, "id string, status string")
    return proposals.join(groups, "id", "left_anti").select("id", F.lit("Accepted").alias("status")).unionByName(decided)


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, label): connected components of edges(source_id, target_id), by spreading smallest ids."""
    both = edges.unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct()
    labels = graph.written(both.groupBy(F.col("source_id").alias("id")).agg(F.least(F.min("target_id"), F.first("source_id")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("target_id"), "label"), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.min("label").alias("__near"))
        spread = labels.join(near, "id").select("id", "label", F.least("label", "__near").alias("__new"))
        # and on to the label's own label
        jump = spread.select("id", "label", "__new").join(spread.select(F.col("id").alias("__new"), F.col("__new").alias("__far")), "__new", "left")
        done = graph.written(jump.select("id", F.col("label").alias("__old"), F.least("__new", F.coalesce("__far", "__new")).alias("label")))
        if not done.where("__old != label").limit(1).count():
            return done.select("id", "label")
        labels = done.select("id", "label")


# ---- event logs


def lifecycle(log: DataFrame) -> DataFrame:
    """(request, status, requested_at, ended_at, requests, late): of log(request, ts, event) with requested, completed and
    failed. The first terminal event decides; later ones that differ count as late."""
    first_end = F.min(F.when(F.col("event") != "requested", F.struct("ts", "event")))
    grouped = log.groupBy("request").agg(
        first_end.alias("__end"),
        F.min(F.when(F.col("event") == "requested", F.col("ts"))).alias("requested_at"),
        F.count_if(F.col("event") == "requested").alias("requests"),
        F.collect_set(F.when(F.col("event") != "requested", F.col("event"))).alias("__ends"),
    )
    return grouped.select("request", F.coalesce("__end.event", F.lit("requested")).alias("status"), "requested_at", F.col("__end.ts").alias("ended_at"), "requests", (F.size("__ends") > 1).alias("late"))


def latest_by_parent(log: DataFrame, parent: str, at: str, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(parent).orderBy(F.col(at).desc(), F.col(key).desc())
    return log.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def proposal_state(status: Column) -> Column:
    """approved or denied, whatever the case; anything else is an error."""
    low = F.lower(status)
    return F.when(low.isin("approved", "denied"), low).otherwise(F.raise_error(F.concat(F.lit("unknown decision "), status)))


def failure_clusters(failures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, repositories and first five ids of the failures of each key."""
    w = Window.partitionBy(*keys).orderBy("id")
    first = failures.withColumn("__n", F.row_number().over(w)).where("__n <= 5").groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return failures.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("repo")).alias("repos")).join(first, list(keys))


# ---- usage and build logs


def usage_totals(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests, prompt, completion and all tokens, and cost of log(prompt_tokens, completion_tokens, cost, ...); what a
    provider did not report counts as 0."""
    of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = [of("prompt_tokens").alias("prompt_tokens"), of("completion_tokens").alias("completion_tokens")]
    totals = log.groupBy(*by).agg(F.count("*").alias("requests"), *sums, F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    return totals.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def build_summary(lines: DataFrame, by: str, tail: int = 20, cap: int = 32 * 1024) -> DataFrame:
    """(by, errors, warnings, messages, unreadable, tail) of lines(by, line_no, line), a build's output of one JSON object
    a line: compiler messages are counted by level; a line that is none is unreadable. tail is the last lines of a build
    in order, cut to cap characters from its beginning."""
    reason, level = F.get_json_object("line", "$.reason"), F.get_json_object("line", "$.message.level")
    said = lines.withColumn("__level", F.when(reason == "compiler-message", level)).withColumn("__bad", F.get_json_object("line", "$").isNull())
    counts = said.groupBy(by).agg(
        F.count_if(F.col("__level") == "error").alias("errors"), F.count_if(F.col("__level") == "warning").alias("warnings"), F.count("__level").alias("messages"), F.count_if("__bad").alias("unreadable")
    )
    # Spark limits groups before it shuffles them, so only `tail` lines of a build meet
    last = lines.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.col("line_no").desc()))).where(F.col("__n") <= tail)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    ends = last.groupBy(by).agg(text.alias("__text")).select(by, F.substring("__text", -cap, cap).alias("tail"))
    return counts.join(ends, by)
