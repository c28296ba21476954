"""Near duplicates by DartMinHash signatures, banded joins and exact verification.

A text is the weighted set of its shingles (five lower-cased words), weighted by how often each occurs; similarity is
weighted Jaccard: the sum of the smaller weights over the sum of the larger. Every unit of weight of a shingle is a
region into which a hash throws darts, one after the other along the rank axis at unit rate; a text collects the
darts of its regions up to the rank at which K ln K + 2K of them are expected, and for each of K coordinates keeps the
earliest dart. Long texts throw few darts a shingle, so a signature costs little more than reading the text. Texts
agree in a coordinate with the probability of their similarity.

Whether two shingles are the same is decided by numbers with a secret key over 128-bit digests of their words (see
textvec): sets, sums and comparisons hold these. Darts take fixed numbers, so that candidates are the same in every run.

1. Texts with equal sets form a class of exact copies; only one of each class goes on.
2. BANDS bands of ROWS coordinates are joined: at a similarity of 0.8 a pair shares a band with probability
   1 - 8e-5, above that more. Each member of a band's group is tied to the group's first, never to all, and connected
   components of these ties are the clusters: no two texts of different clusters share a band.
3. A cluster's sets move to one task, once. There every pair of the cluster that can reach the similarity and is not
   yet connected is compared exactly: by a prefix filter (two such sets share one of their rarest elements) and by
   size. Only classes leave the task.
4. A cluster of more than BLOCK elements is dealt to blocks. All its members are compared with its hub, the member most
   others are tied to; those that are not similar to it then meet all blocks, a task for each pair of blocks. Links
   leave those tasks, at most one less than members, and their components are the classes.

Defined cases: a null or empty text, or one without words, has no shingles and is near nothing but itself: class_id
is its own doc_id. A text of fewer than five words is one shingle of them all. Rows that repeat a doc_id are one
document: they share a class. A null doc_id gives a null class. Classes take their smallest doc_id. An empty table
gives no rows. Other columns are ignored by classes() and pass through deduplicate() unchanged. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec as tv
from tessera.llm.common import BROADCAST_IDS, discard, keep_or_drop, mapped, materialize

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 7
K = BANDS * ROWS
#: Elements of a cluster that are compared in one task, and of a block of a larger cluster, on average.
BLOCK = 1 << 18
#: Edges that one task reduces to stars.
EDGES = 1 << 21

#: Multipliers of the shingles' numbers that darts are thrown with: the same in every run.
FIXED = tv.run_key(WORDS, fixed=True)

SIGNED = "doc_id long, size long, set_a long, set_b long, bands array<long>"


def elements(shingles: np.ndarray, first: np.ndarray, fixed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit regions of texts: a distinct number for each shingle and time it occurs, sorted by text; their texts; and
    the same with fixed numbers for the shingles, in the same order."""
    fixed = shingles if fixed is None else fixed
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((shingles, owner))
    s, f = shingles[order], fixed[order]
    n = len(s)
    if n:
        new = np.r_[True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])]
        at = np.arange(n)
        again = at - np.maximum.accumulate(np.where(new, at, 0))
        repeated = again > 0
        with np.errstate(over="ignore"):
            more = again[repeated].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
            s[repeated], f[repeated] = tv.mix(s[repeated] + more), tv.mix(f[repeated] + more)
    return s, owner, f


def _uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(regions: np.ndarray, owner: np.ndarray, texts: int, k: int = K) -> np.ndarray:
    """The earliest dart of each coordinate (columns) for each text (rows); 0 for a text without regions."""
    size = np.bincount(owner, minlength=texts)
    out = np.zeros((texts, k), np.uint64)
    todo = np.flatnonzero(size)
    reach = (k * np.log(k) + 2 * k) / np.maximum(size, 1)
    while len(todo):
        best = np.full(texts * k, np.inf)
        value = np.zeros(texts * k, np.uint64)
        # short texts need many darts a region: those are thrown in larger rounds
        for least, most, darts in ((0, 8, 2), (8, 64, 16), (64, np.inf, 256)):
            chosen = np.zeros(texts, bool)
            chosen[todo] = (reach[todo] >= least) & (reach[todo] < most)
            mine = np.flatnonzero(chosen[owner])
            region, text, rank, thrown = regions[mine], owner[mine], np.zeros(len(mine)), 0
            while len(region):
                turn = np.arange(thrown + 1, thrown + darts + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
                with np.errstate(over="ignore"):
                    dart = tv.mix((region[:, None] + turn).reshape(-1))
                # darts of a region come at unit rate along the rank axis
                step = -np.log(_uniform(tv.mix(dart ^ np.uint64(0x5851F42D4C957F2D)))).reshape(-1, darts)
                ranks = rank[:, None] + np.cumsum(step, 1)
                hit = np.flatnonzero((ranks < reach[text][:, None]).reshape(-1))
                dart, at, r = dart[hit], text[hit // darts], ranks.reshape(-1)[hit]
                cell = at * k + (dart % np.uint64(k)).astype(np.int64)
                np.minimum.at(best, cell, r)
                first = r == best[cell]
                value[cell[first]] = dart[first]
                more = ranks[:, -1] < reach[text]
                region, text, rank, thrown = region[more], text[more], ranks[more, -1], thrown + darts
        full = np.isfinite(best.reshape(texts, k)).all(1)
        done = todo[full[todo]]
        out[done] = value.reshape(texts, k)[done]
        todo = todo[~full[todo]]  # a coordinate got no dart: reach further
        reach[todo] *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One number for each band of each text."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i]
    return tv.mix(key.reshape(-1)).reshape(key.shape)


def sets_of(column: pa.Array, key: np.ndarray):
    """Yield (regions, their texts, their fixed numbers, each text's first) over slices of a text column. Regions are
    numbered by the secret key."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    for lo, hi, data, starts in tv.slices(lowered):
        begin, end, first = tv.spans(data, starts, tv.ALNUM)
        index, words = tv.distinct_words(data, begin, end)
        (shingles, fixed), first = tv.shingles(tv.digests(words), index, first, [key, FIXED])
        yield lo, hi, *elements(shingles, first, fixed), first


def signed(docs: DataFrame, key: np.ndarray) -> DataFrame:
    """See SIGNED: two sums that identify the set, and the band keys. One row per row; bands is empty without words."""

    def run(batches):
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for lo, hi, regions, owner, fixed, first in sets_of(batch.column("text"), key):
                some = np.diff(first) > 0
                bands = band_keys(signatures(fixed, owner, hi - lo)[some])
                with np.errstate(over="ignore"):
                    sums = [np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)] for x in (tv.mix(regions), tv.mix(~regions))]
                    a, b = (x[first[1:]] - x[first[:-1]] for x in sums)
                ends = np.r_[0, np.cumsum(some)] * BANDS
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids[lo:hi],
                        pa.array(np.diff(first)),
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands.reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "size", "set_a", "set_b", "bands"],
                )

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SIGNED)


def sets(docs: DataFrame, ids: DataFrame, key: np.ndarray) -> DataFrame:
    """(cluster, blocks, doc_id, elements): the whole sets, as sorted numbers, of documents in ids(id, cluster, blocks).
    The ids are broadcast only if counted to be BROADCAST_IDS at most."""

    def run(batches):
        for batch in batches:
            for lo, hi, regions, _, _, first in sets_of(batch.column("text"), key):
                own = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(regions.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in ("cluster", "blocks", "doc_id")), own], ["cluster", "blocks", "doc_id", "elements"])

    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("id"))
    return mapped(every.select("cluster", "blocks", "doc_id", "text"), run, "cluster long, blocks long, doc_id long, elements array<long>")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id) of the connected components of edges (a, b), for each id that is not its component's smallest."""
    ids, index = np.unique(np.r_[a, b], return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != label[label]).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[own], ids[label[own]]


def components(edges: DataFrame) -> DataFrame:
    """(id, class): connected components of edges(a, b), each with its smallest id. Parts of EDGES edges are reduced to
    stars in one task each. If there are several, a node's larger and its smaller neighbours are linked to their smallest
    in turn, until nothing changes; every round is written out, and again begins with stars."""

    def run(batches):
        held = [(x.column("v").to_numpy(), x.column("u").to_numpy()) for x in batches if x.num_rows]
        if held:
            v, u = forest(*map(np.concatenate, zip(*held)))
            for lo in range(0, len(v), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + (1 << 17)]), pa.array(u[lo : lo + (1 << 17)])], ["v", "u"])

    edges = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "edges")
    mark = None
    while True:
        parts = max(1, -(-edges.count() // EDGES))
        before, stars = edges, materialize(mapped(edges.coalesce(parts), run, "v long, u long"), "stars")
        discard(before)
        if parts == 1:
            labels = stars.select("v", F.col("u").alias("class"))
            break
        both = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select("v", F.col("m").alias("u")).unionByName(small.select(F.col("u").alias("v"), F.col("m").alias("u"))).where("u < v").distinct()
        edges = materialize(small, "edges")
        discard(stars)
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            labels = edges.groupBy("v").agg(F.min("u").alias("class"))
            break
        mark = seen
    return labels.select(F.col("v").alias("id"), "class").unionByName(labels.select(F.col("class").alias("id"), "class").distinct())


def connect(elements: np.ndarray, first: np.ndarray, root: np.ndarray, active: np.ndarray, similarity: float) -> np.ndarray:
    """Component of each set (a number of one of its members) when all pairs of an active set and any other that reach
    the similarity are linked. root holds what is connected beforehand; sets are distinct numbers in elements."""
    size = np.diff(first)
    n = len(size)
    _, element, frequency = np.unique(elements, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    # a set's rarest elements first; its first size - ceil(similarity * size) + 1 hold one of those shared with a similar set
    order = np.lexsort((element, frequency[element], owner))
    element = element[order]
    prefix = np.arange(len(element)) - first[owner] < (size - np.ceil(similarity * size - 1e-9) + 1)[owner]
    prefix &= frequency[element] > 1
    listed, listing = element[prefix], owner[prefix]
    by_element = np.argsort(listed, kind="stable")
    lists = listing[by_element]  # the sets that have an element in their prefix, by element
    begin, end = np.searchsorted(listed[by_element], listed, "left"), np.searchsorted(listed[by_element], listed, "right")
    of_set = np.searchsorted(listing, np.arange(n + 1))
    alone = np.add.reduceat(np.r_[frequency[element] == 1, False], np.minimum(first[:-1], len(element)), dtype=np.int64) * (size > 0)
    mark = np.zeros(len(frequency), bool)
    for i in np.argsort(alone / np.maximum(size, 1), kind="stable").tolist():
        if not active[i] or of_set[i] == of_set[i + 1]:
            continue
        own = [lists[begin[k] : end[k]] for k in range(of_set[i], of_set[i + 1])]
        others = np.concatenate([x[root[x] != root[i]] for x in own])
        if not len(others):
            continue
        others = np.unique(others)
        others = others[np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i]) - 1e-9]
        if not len(others):
            continue
        mark[element[first[i] : first[i + 1]]] = True
        ends = np.cumsum(size[others])
        at = np.arange(ends[-1]) + np.repeat(first[others] - ends + size[others], size[others])
        shared = np.add.reduceat(mark[element[at]].astype(np.int64), ends - size[others])
        mark[element[first[i] : first[i + 1]]] = False
        near = others[shared >= similarity * (size[others] + size[i] - shared) - 1e-9]
        if len(near):
            root[np.isin(root, root[np.r_[near, i]])] = i
    return root


def _tasks(batches, keys: list[str]):
    """Yield the rows of each group of a stream that is sorted by keys: key values, and a list of column values."""
    held: list[list[pa.RecordBatch]] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = np.r_[0, np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1, batch.num_rows]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = tuple(marks[:, lo].tolist())
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, all elements, and each set's first (one entry more)."""
    column = table.column("elements").combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return table.column("doc_id").to_numpy(), column.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)]


def _small_clusters(whole: DataFrame, similarity: float) -> DataFrame:
    """(id, class) of the members of clusters that one task takes."""

    def run(batches):
        for table in _tasks(batches, ["cluster"]):
            ids, elements, first = _arrays(table)
            if len(ids) == 1:
                continue
            _, at, same = np.unique(ids, return_index=True, return_inverse=True)
            root = connect(elements, first, at[same], np.ones(len(ids), bool), similarity)
            order = np.lexsort((ids, root))
            least = ids[order][np.r_[True, root[order][1:] != root[order][:-1]]]
            classes = least[np.cumsum(np.r_[True, root[order][1:] != root[order][:-1]]) - 1]
            yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(classes)], ["id", "class"])

    dealt = whole.select("cluster", "doc_id", "elements").repartition("cluster").sortWithinPartitions("cluster")
    return mapped(dealt, run, "id long, class long")


def _large_clusters(whole: DataFrame, hubs: DataFrame, similarity: float) -> DataFrame:
    """(id, class) of those members of clusters in more than one block that are linked; hubs(cluster, hub)."""
    hub = whole.join(hubs, (whole["cluster"] == hubs["cluster"]) & (whole["doc_id"] == hubs["hub"])).select(whole["cluster"].alias("c"), "hub", F.col("elements").alias("of_hub"))
    hub = materialize(hub.dropDuplicates(["c"]), "hubs")
    shared = F.size(F.array_intersect("elements", "of_hub"))
    near = shared >= similarity * (F.size("elements") + F.size("of_hub") - shared) - 1e-9
    met = materialize(whole.join(hub, F.col("cluster") == F.col("c")).select("cluster", "blocks", "doc_id", "elements", "hub", near.alias("near")), "met")
    links = met.where("near").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    # a side of those that are not near the hub, in blocks of their own, and the side of all
    rest = met.where("not near").groupBy(F.col("cluster").alias("c")).agg(F.ceil(F.sum(F.size("elements")) / BLOCK).alias("rests"))
    both = met.join(materialize(rest, "rests"), F.col("cluster") == F.col("c"))
    side, other = F.pmod(F.xxhash64("doc_id"), "rests").alias("i"), F.pmod(F.xxhash64("doc_id", F.lit(1)), "blocks").alias("j")
    columns = ["cluster", "doc_id", "elements", "near"]
    left = both.where("not near").select(*columns, side, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("active"))
    right = both.select(*columns, other, F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), F.lit(False).alias("active"))

    def run(batches):
        for table in _tasks(batches, ["cluster", "i", "j"]):
            ids, elements, first = _arrays(table)
            _, at, same = np.unique(ids, return_index=True, return_inverse=True)  # a document may stand on both sides
            root, near = at[same], np.flatnonzero(table.column("near").to_numpy(zero_copy_only=False))
            root[np.isin(root, root[near])] = near[0] if len(near) else 0  # all are linked to the hub
            root = connect(elements, first, root, table.column("active").to_numpy(zero_copy_only=False), similarity)
            made = forest(ids[root], ids)
            yield pa.RecordBatch.from_arrays([pa.array(made[0]), pa.array(made[1])], ["a", "b"])

    dealt = left.unionByName(right).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    found = mapped(dealt, run, "a long, b long")
    return components(links.unionByName(found))


def near_links(distinct: DataFrame, docs: DataFrame, key: np.ndarray, similarity: float = SIMILARITY) -> DataFrame | None:
    """(id, class) over the documents of distinct(doc_id, size, bands) that are linked; None if no two share a band.
    The sets of those that do are read from docs again."""
    keys = distinct.select("doc_id", F.explode("bands").alias("band"))
    groups = keys.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("band", "a")
    ties = keys.join(materialize(groups, "groups"), "band").where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct()
    ties = materialize(ties, "ties")
    if not ties.limit(1).count():
        return None
    clusters = materialize(components(ties), "clusters")
    sizes = distinct.groupBy(F.col("doc_id").alias("id")).agg(F.sum("size").alias("size"))
    totals = clusters.join(sizes, "id").groupBy("class").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    members = clusters.join(materialize(totals, "totals"), "class").select("id", F.col("class").alias("cluster"), "blocks")
    members = materialize(members, "members")
    large = members.where("blocks > 1")
    whole = sets(docs, members, key)
    if not large.limit(1).count():
        return materialize(_small_clusters(whole, similarity), "near")
    whole = materialize(whole.distinct(), "sets")
    degrees = ties.join(large, F.col("a") == F.col("id")).groupBy("cluster", "a").agg(F.count("*").alias("n"))
    hubs = degrees.groupBy("cluster").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("hub"))
    small = _small_clusters(whole.where("blocks = 1"), similarity)
    return materialize(small.unionByName(_large_clusters(whole.where("blocks > 1"), materialize(hubs, "hubs"), similarity)), "near")


def _classed(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, class_id): one row per row of docs."""
    key = tv.run_key(WORDS)
    marks = materialize(signed(docs, key), "signatures")
    worded = marks.where("size > 0 and doc_id is not null")
    # equal sets have equal bands
    distinct = worded.groupBy("set_a", "set_b", "size").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    distinct = materialize(distinct, "distinct-sets")
    linked = near_links(distinct, docs, key, similarity)
    own = distinct.select("set_a", "set_b", "size", F.col("doc_id").alias("id"))
    if linked is not None:
        linked = linked.groupBy("id").agg(F.min("class").alias("class"))
        own = own.join(linked, "id", "left").withColumn("id", F.coalesce("class", "id"))
    named = materialize(own.select("set_a", "set_b", "size", F.col("id").alias("class_id")), "named")
    found = worded.select("doc_id", "set_a", "set_b", "size").join(named, ["set_a", "set_b", "size"]).select("doc_id", "class_id")
    found = materialize(found.unionByName(marks.where("size = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))), "classes")
    # rows of one doc_id with different texts
    split = found.groupBy("doc_id").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).where("least < most")
    split = materialize(split.select(F.col("doc_id").alias("__id"), "least"), "split")
    if not split.limit(1).count():
        return found
    return materialize(found.join(split, F.col("doc_id") == F.col("__id"), "left").select("doc_id", F.coalesce("least", "class_id").alias("class_id")), "classes")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest doc_id of its near duplicates), class_size (rows)."""
    rows = _classed(docs, similarity)
    sizes = rows.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return rows.join(materialize(sizes, "class-sizes"), "class_id", "left").select("doc_id", "class_id", "class_size")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the document of the smallest doc_id of each class; rows without words or doc_id all stay."""
    gone = _classed(docs, similarity).where("class_id < doc_id").select("doc_id")
    return keep_or_drop(docs, materialize(gone, "near-copies"), "left_anti")
