"""Token-budgeted context: ordered, greedy admission, and conversations.

Admission depends on all that was admitted before, but little of what is left can matter: a part larger than what the budget
has left is out wherever it stands. So parts are admitted in rounds. A round takes, of each query, the first BLOCK parts
in order that still fit by themselves, and lets only these pass a running state; the budget is soon used up, and parts
that fit become few. Each round admits at least one part, and mostly a round or two do. Texts take no part in this:
positions and admission are found on narrow rows, by all cores, however many parts a query has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.shared import materialize

MAX_TOTAL, PER_FILE, PER_PART = 4096, 2048, 1024
#: Parts of a query that one task looks at in a round.
BLOCK = 4096


def stable_dedup(rows: DataFrame, key: str, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*by, key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def policy_order(policy: str) -> list[Column]:
    by_score = [F.col("score").desc(), F.col("id")]
    return {"score": by_score, "file": [F.col("file_path"), *by_score]}[policy]


def _admit(rows: DataFrame, by: str, order: str, facts: Sequence[str], start: Callable[[], Callable[..., bool]], name: str) -> DataFrame:
    """rows with a boolean column: what start() says of the facts of each row of a group, in order. All groups are sorted
    by one shuffle; a group's rows pass through one task as a stream."""
    columns = rows.columns

    def run(batches):
        now, admit = None, None
        for batch in batches:
            said = []
            for key, *own in zip(*(batch.column(c).to_pylist() for c in (by, *facts))):
                if admit is None or key != now:
                    now, admit = key, start()
                said.append(admit(*own))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.bool_())], [*columns, name])

    schema = rows.withColumn(name, F.lit(True)).schema
    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def assemble(parts: DataFrame, policy: str = "score", max_total: int = MAX_TOTAL, per_file: int = PER_FILE, per_part: int = PER_PART, strict_total: bool = True, kinds: Sequence[str] | None = None) -> DataFrame:
    """parts(query, id, file_path, kind, text, score) -> (query, id, file_path, kind, text, tokens, truncated, position,
    admitted). Parts are deduplicated by id (the highest score stays), cut to per_part tokens, and admitted in order: a
    part without text, and one that would take its file beyond per_file (0: no limit), is passed over. With strict_total
    one that would take the query beyond max_total is passed over too; without, admission ends at a single part beyond max_total."""
    if kinds is not None:
        parts = parts.where(F.col("kind").isin(*kinds))
    once = stable_dedup(parts, "id", [F.col("score").desc(), F.col("file_path")], ["query"])
    cut = once.withColumn("truncated", X.approx_tokens(F.col("text")) > per_part).withColumn("text", X.trim_to_tokens(F.col("text"), per_part))
    cut = cut.withColumn("truncated", F.coalesce("truncated", F.lit(False))).withColumn("tokens", X.approx_tokens(F.col("text")))
    cut = materialize(cut.select("query", "id", "file_path", "kind", "text", "tokens", "truncated", "score"), "parts")
    placed = materialize(positions(cut.select("query", "id", "file_path", "tokens", "score"), "query", policy_order(policy)).drop("score"), "positions")
    work = placed.where("tokens > 0")
    if strict_total:
        chosen = greedy(work, ["query"], max_total, "file_path", per_file)
    else:
        ends = work.where(F.col("tokens") > max_total).groupBy(F.col("query").alias("__query")).agg(F.min("position").alias("__end"))
        before = work.join(materialize(ends, "ends"), F.col("query").eqNullSafe(F.col("__query")), "left").where("__end is null or position < __end").drop("__query", "__end")
        chosen = greedy(before, ["query", "file_path"], per_file) if per_file else before.select("query", "position")
        ended = placed.where("tokens = 0").join(ends, F.col("query").eqNullSafe(F.col("__query")), "left").where("__end is null or position < __end")
    # what takes nothing is admitted wherever admission has not ended
    free = placed.where("tokens = 0") if strict_total else ended
    yes = chosen.select("query", "position").unionByName(free.select("query", "position"))
    flags = placed.select("query", "id", "position").join(yes.select(F.col("query").alias("__q"), F.col("position").alias("__p"), F.lit(True).alias("__yes")), F.col("query").eqNullSafe(F.col("__q")) & (F.col("position") == F.col("__p")), "left")
    flags = flags.select(F.col("query").alias("__query"), F.col("id").alias("__id"), "position", F.coalesce("__yes", F.lit(False)).alias("admitted"))
    out = cut.join(materialize(flags, "admitted"), F.col("query").eqNullSafe(F.col("__query")) & (F.col("id").eqNullSafe(F.col("__id"))))
    return out.select("query", "id", "file_path", "kind", "text", "tokens", "truncated", "position", "admitted")


def positions(rows: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """rows with position: 1, 2, ... within each value of `by`, in order. Rows are sorted by ranges, so a value of most
    rows is numbered by many tasks; each needs only the counts of those before it."""
    at, part = F.monotonically_increasing_id(), F.shiftright("__at", 33)
    dealt = materialize(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("__at", at), "ranges")
    begins = dealt.groupBy(F.col(by).alias("__by"), part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # a row for each task and value that it holds
    earlier = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = materialize(begins.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))), "begins")
    out = dealt.join(begins, F.col(by).eqNullSafe(F.col("__by")) & (part == F.col("__part")))
    return out.withColumn("position", (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("int")).drop("__at", "__by", "__part", "__first", "__n", "__before")


def greedy(rows: DataFrame, keys: Sequence[str], cap: int, within: str | None = None, within_cap: int = 0) -> DataFrame:
    """(keys, position) of rows(keys, position, tokens, ...) that are admitted: in the order of position, each row of a
    key that keeps the key's sum of tokens below cap, and (unless within_cap is 0) the sum of each value of `within`
    below within_cap. tokens are positive. See the module for the rounds."""
    columns = [*keys, *([within] if within else [])]
    rows = rows.where(F.col("tokens") <= (min(cap, within_cap) if within_cap else cap))  # others never fit
    rows = materialize(rows.select(*columns, "position", "tokens"), "work")
    rounds: list[DataFrame] = []
    same = lambda a, b, names: [a[c].eqNullSafe(b[f"__{c}"]) for c in names]
    named = lambda df, names: df.select(*(F.col(c).alias(f"__{c}") for c in names), *(c for c in df.columns if c not in names))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        total, used, yes = int(group["total"].iloc[0]), {}, []
        places = group[within].tolist() if within else [None] * len(group)
        for place, tokens, before in zip(places, group["tokens"].tolist(), group["used"].tolist()):
            place = place if isinstance(place, str) or place == place else None
            own = used.setdefault(place, int(before))
            fits = total + tokens <= cap and (not within_cap or own + tokens <= within_cap)
            yes.append(fits)
            if fits:
                total, used[place] = total + tokens, own + tokens
        return group.assign(admitted=yes, full=len(group) == BLOCK)[[*columns, "position", "tokens", "admitted", "full"]]

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", position int, tokens long, admitted boolean, full boolean"
    while True:
        left = rows.withColumn("total", F.lit(0).cast("long")).withColumn("used", F.lit(0).cast("long"))
        if rounds:
            seen = rounds[0]
            for r in rounds[1:]:
                seen = seen.unionByName(r)
            taken = F.sum(F.when(F.col("admitted"), F.col("tokens")).otherwise(0))
            states = materialize(named(seen.groupBy(*keys).agg(taken.alias("total"), F.max("position").alias("__after")), keys), "states")
            going = materialize(named(rounds[-1].where("full").select(*keys).distinct(), keys), "going")
            left = rows.join(going, same(rows, going, keys), "left_semi").join(states, same(rows, states, keys)).where("position > __after").where(F.col("tokens") <= cap - F.col("total"))
            left = left.select(*columns, "position", "tokens", "total")
            if within_cap:
                own = materialize(named(seen.where("admitted").groupBy(*columns).agg(F.sum("tokens").alias("used")), columns), "used")
                left = left.join(own, same(left, own, columns), "left").select(*columns, "position", "tokens", "total", F.coalesce("used", F.lit(0)).cast("long").alias("used")).where(F.col("tokens") <= within_cap - F.col("used"))
            else:
                left = left.withColumn("used", F.lit(0).cast("long"))
        first = left.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("position"))).where(F.col("__n") <= BLOCK).drop("__n")
        rounds.append(materialize(first.groupBy(*keys).applyInPandas(fold, schema), "round"))
        if not rounds[-1].where("full").limit(1).count():
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.where("admitted").select(*keys, "position")


def stats(assembled: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Admitted tokens, files and parts; truncated counts parts that were passed over too. With the parts that assemble()
    was given, dedup_removed counts those that repeated an id."""
    yes = F.col("admitted")
    found = assembled.groupBy("query").agg(
        F.coalesce(F.sum(F.when(yes, F.col("tokens"))), F.lit(0)).alias("total_tokens"),
        F.countDistinct(F.when(yes, F.col("file_path"))).alias("files"),
        F.count_if(yes).alias("parts"),
        F.count_if("truncated").alias("truncated_parts"),
        F.count("*").alias("__kept"),
    )
    if parts is not None:
        given = parts.groupBy(F.col("query").alias("__query")).agg(F.count("*").alias("__given"))
        found = found.join(given, F.col("query").eqNullSafe(F.col("__query"))).withColumn("dedup_removed", F.col("__given") - F.col("__kept")).drop("__query", "__given")
    return found.drop("__kept")


def plan(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Estimated tokens of included messages and admitted parts, and what was left out, per query."""
    m = messages.groupBy("query").agg(F.sum(F.when(F.col("included"), F.col("tokens")).otherwise(0)).alias("message_tokens"), F.count_if(~F.col("included")).alias("excluded_messages"))
    p = parts.groupBy("query").agg(F.sum(F.when(F.col("admitted"), F.col("tokens")).otherwise(0)).alias("part_tokens"), F.count_if(~F.col("admitted")).alias("excluded_parts"))
    both = m.join(p, "query", "full").fillna(0)
    return both.withColumn("estimated_tokens", F.col("message_tokens") + F.col("part_tokens"))


# ---- conversations


def lease_order() -> list[Column]:
    """Most recently included first (never counts as 0), then most often, then latest on the path, then by id."""
    return [F.coalesce("last_included", F.lit(0)).desc(), F.col("include_count").desc(), F.col("path_index").desc(), F.col("id").asc()]


def select_leased(messages: DataFrame, cap: int, by: str = "conv") -> DataFrame:
    """messages with lease_rank, included and reason (TtlExpired, Budget or null): in lease order each message that
    still fits under the cap is kept; the first always is."""
    expired = F.coalesce(F.col("ttl") <= 0, F.lit(False))
    ranked = messages.withColumn("expired", expired).withColumn("lease_rank", F.row_number().over(Window.partitionBy(by, "expired").orderBy(*lease_order())))

    def start() -> Callable[[bool, int], bool]:
        total, kept = 0, 0

        def admit(expired: bool, tokens: int) -> bool:
            nonlocal total, kept
            if expired or kept and total + tokens > cap:
                return False
            total, kept = total + tokens, kept + 1
            return True

        return admit

    # the expired come last, so that the others are in lease order from the first
    ranked = ranked.withColumn("__place", F.struct("expired", "lease_rank"))
    out = _admit(ranked, by, "__place", ["expired", "tokens"], start, "included")
    kept = F.col("included")
    reason = F.when(F.col("expired"), F.lit("TtlExpired")).when(~kept, F.lit("Budget"))
    return out.withColumn("reason", reason).drop("__place", "expired")


def decrement_ttl(retention: Column, ttl: Column) -> Column:
    """A turn less for what is leased for a limited number; None for what is pinned or has none left."""
    return F.when((retention == "Leased") & (ttl > 0), ttl - 1)


def budget_atoms(messages: DataFrame) -> DataFrame:
    """What counts against a budget: messages that are not empty; tool calls once per call_id (the first on the path),
    each as a call and its result. (conv, path_index, atom, id, tokens)"""
    plain = messages.where((F.col("role") != "tool_call") & (F.length("text") > 0)).select("conv", "path_index", F.col("role").alias("atom"), "id", X.approx_tokens(F.col("text")).alias("tokens"))
    calls = stable_dedup(messages.where("role = 'tool_call'"), "call_id", [F.col("path_index"), F.col("id")], ["conv"])
    pair = F.array(F.struct(F.lit("call").alias("atom"), X.approx_tokens(F.col("text")).alias("tokens")), F.struct(F.lit("result").alias("atom"), X.approx_tokens(F.coalesce("result", F.lit(""))).alias("tokens")))
    pairs = calls.select("conv", "path_index", "id", F.explode(pair).alias("__a")).select("conv", "path_index", "__a.atom", "id", "__a.tokens")
    return plain.unionByName(pairs)
