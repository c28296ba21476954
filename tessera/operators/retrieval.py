"""Sparse and dense retrieval, batch-first: a DataFrame of queries in, ranked rows out.

Every ranking has a total order: score descending, then id ascending.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.functions import text as X
from tessera.shared import materialize

K1, B = 1.2, 0.75
RRF_K = 60.0
#: Query vectors that are broadcast at most; more meet the vectors in blocks of as many, and these in blocks of VECTOR_BLOCK.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 16_384
# Seconds between the attempts of a lenient search.
RETRY_WAITS = (0.05, 0.1)


# ---- sparse


#: Keys of rows that repeat one, which are named in a filter; if there are more, the postings of all rows meet by their keys.
MOST_REPEATED = 1000


def _postings_of_rows(docs: DataFrame, tokens: Column, key: str) -> DataFrame:
    """(doc, term, tf, len) of each row by itself, counted where the row is read: nothing moves, and a task holds a batch."""
    doc_type = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            coded = pc.list_flatten(terms).dictionary_encode("encode")  # a null token is a term too
            n = max(1, len(coded.dictionary))
            found, tf = np.unique(pc.list_parent_indices(terms).to_numpy().astype(np.int64) * n + coded.indices.to_numpy(), return_counts=True)
            rows = pa.array(found // n)
            columns = [batch.column("doc").take(rows), coded.dictionary.take(pa.array(found % n)), pa.array(tf.astype(np.int64)), batch.column("len").take(rows)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "term", "tf", "len"])

    found = docs.select(F.col(key).alias("doc"), tokens.cast("array<string>").alias("terms")).select("doc", "terms", F.size("terms").alias("len"))
    return found.mapInArrow(count, f"doc {doc_type}, term string, tf long, len int")


def postings(docs: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """(doc, term, tf, len). The task that reads a row counts its terms, and they stay there; only those of rows that repeat
    a key (asked for first) move, to add up where their lengths are equal."""
    if docs.isStreaming:
        return _added(_postings_of_rows(docs, tokens, key))
    again = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1")
    keys = [r[0] for r in again.select(key).limit(MOST_REPEATED + 1).collect()]
    if len(keys) > MOST_REPEATED:
        return _added(_postings_of_rows(docs, tokens, key))
    repeated = F.col(key).isNull() | F.col(key).isin(keys) if keys else F.col(key).isNull()
    return _postings_of_rows(docs.where(~repeated), tokens, key).unionByName(_added(_postings_of_rows(docs.where(repeated), tokens, key)))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", "term", "len").agg(F.sum("tf").alias("tf")).select("doc", "term", "tf", "len")


def doc_stats(docs: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.size(tokens).cast("long").alias("len"))


def average_length(stats: DataFrame) -> DataFrame:
    """Documents and their mean length, 0 if there are none."""
    return stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25(tf: Column, length: Column, avgdl: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    return weight * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / avgdl))


def bm25_scores(docs: DataFrame, tokens: Column, terms: DataFrame, key: str = "doc_id", scope: Column | None = None) -> DataFrame:
    """(query, doc, score) of terms(query, term), for documents within the scope; term statistics are corpus-wide.

    Documents are read once: what goes on, by way of a written table, is the length of each and how often it holds a
    query's terms. Terms and their frequencies are broadcast where Spark finds them small enough.
    """
    wanted = terms.select("term", F.lit(True).alias("__wanted")).distinct()
    rows = docs.select(F.col(key).alias("doc"), (F.lit(True) if scope is None else scope).alias("inside"), F.explode(F.array(tokens)).alias("__t"))
    # a row without a term stands for the document itself
    every = rows.select("doc", "inside", F.size("__t").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "__t")).alias("term"))
    kept = every.join(wanted, "term", "left").where("term is null or __wanted")
    counted = materialize(kept.groupBy("doc", "inside", "len", "term").agg(F.count("*").alias("tf")), "hits")
    corpus, hits = average_length(counted.where("term is null")), counted.where("term is not null")
    frequency = hits.groupBy("term").agg(F.countDistinct("doc").alias("df"))
    found = hits.where("inside").join(frequency, "term").join(F.broadcast(corpus)).join(terms, "term")
    one = bm25(F.col("tf"), F.col("len"), F.col("avgdl"), idf(F.col("n_docs"), F.col("df")))
    return found.groupBy("query", "doc").agg(F.sum(one).alias("score"))


def top_k(scored: DataFrame, k: int, by: Sequence[str], score: str = "score", key: str = "doc", descending: bool = True) -> DataFrame:
    """The k best of each group with rank (from 1). Spark limits groups before it shuffles them."""
    order = [F.col(score).desc() if descending else F.col(score).asc(), F.col(key).asc()]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def remove_docs(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("doc").distinct(), "doc", "left_anti")


def upsert_docs(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings with those of the documents in fresh replaced."""
    return remove_docs(index, fresh.select("doc")).unionByName(fresh)


def indexed_text(name: Column, snippet: Column | None = None) -> Column:
    """What is indexed of a node: its name twice, then its snippet."""
    return F.concat_ws(" ", name, name) if snippet is None else F.concat_ws(" ", name, name, snippet)


# ---- dense


def knn(queries: DataFrame, vectors: DataFrame, k: int, by: Sequence[str] = (), radius: float | None = None, where: Column | None = None, post_filter: Column | None = None) -> DataFrame:
    """(query, id, distance, rank): the k nearest of vectors(id, vector, ...) for each of queries(query, vector), by
    squared distance; with `by`, the k nearest in each group of these columns of vectors.

    where filters vectors before the k nearest are taken, post_filter afterwards (so fewer may be left). Up to QUERY_BLOCK
    queries are broadcast and vectors stay where they are; of more, each block of queries meets each block of vectors in a
    task of its own, and nothing goes through the driver. Only the k best of a query leave a batch or block.
    """
    if where is not None:
        vectors = vectors.where(where)
    near = _nearest_of_partitions(queries, vectors, k, by, radius)
    ranked = top_k(near, k, ["query", *by], "distance", "id", descending=False)
    return ranked if post_filter is None else ranked.where(post_filter)


def _nearest_of_partitions(queries: DataFrame, vectors: DataFrame, k: int, by: Sequence[str], radius: float | None) -> DataFrame:
    """The k best of each query and group in each batch or block of vectors. Queries without a vector find nothing."""
    asked = queries.select("query", F.transform("vector", lambda x: x.cast("double")).alias("vector")).where("vector is not null")
    other = [c for c in vectors.columns if c not in ("id", "vector")]
    columns = ["id", "distance", *other]
    schema = f"query {queries.schema['query'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, distance double" + "".join(f", `{c}` {vectors.schema[c].dataType.simpleString()}" for c in other)

    def meet(names: list, matrix: np.ndarray, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch[batch["vector"].notna()].reset_index(drop=True)
        if not len(batch) or not len(names):
            return pd.DataFrame({c: [] for c in ("query", *columns)})
        own = np.array(batch["vector"].tolist(), float)
        groups = list(batch.groupby(list(by), dropna=False).indices.values()) if by else [np.arange(len(batch))]
        found, distances, owners = [], [], []
        for number, q in enumerate(matrix):
            distance = ((own - q) ** 2).sum(1)
            for at in groups:
                d = distance[at]
                if len(at) > k:
                    at = at[d <= np.partition(d, k - 1)[k - 1]]  # ties go on: the order of ids decides later
                if radius is not None:
                    at = at[distance[at] <= radius]
                found.append(at)
                distances.append(distance[at])
                owners.append(np.full(len(at), number))
        out = batch.iloc[np.concatenate(found)][["id", *other]].reset_index(drop=True)
        out.insert(1, "distance", np.concatenate(distances))
        out.insert(0, "query", [names[i] for i in np.concatenate(owners).tolist()])
        return out

    rows = asked.limit(QUERY_BLOCK + 1).collect()  # as many at most
    if len(rows) <= QUERY_BLOCK:
        few, matrix = [r["query"] for r in rows], np.array([r["vector"] for r in rows], float) if rows else np.zeros((0, 1))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield meet(few, matrix, batch)

        return vectors.mapInPandas(run, schema)
    counts = [max(1, -(-df.count() // size)) for df, size in ((asked, QUERY_BLOCK), (vectors, VECTOR_BLOCK))]
    dealt = lambda key, n: F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query", "vector", dealt("query", counts[0]).alias("__a"), every(counts[1]).alias("__b"))
    right = vectors.select("id", "vector", *other, every(counts[0]).alias("__a"), dealt("id", counts[1]).alias("__b"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return meet(a["query"].tolist(), np.array(a["vector"].tolist(), float), b.drop(columns=["__a", "__b"]))

    return left.groupBy("__a", "__b").cogroup(right.groupBy("__a", "__b")).applyInPandas(pair, schema)


def knn_of_prompts(prompts: DataFrame, vectors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(query, id, distance, rank, ...) of prompts(query, vector, k, radius): for each the k nearest, in each group of
    `by`, no further than its radius (a null radius is no limit)."""
    most = prompts.agg(F.max("k")).first()[0] or 0
    if not most:
        return knn(prompts, vectors, 1, by).limit(0)
    near = knn(prompts, vectors, most, by)
    limits = prompts.select("query", F.col("k").alias("__k"), F.col("radius").alias("__radius"))
    kept = near.join(limits, "query").where((F.col("rank") <= F.col("__k")) & (F.col("__radius").isNull() | (F.col("distance") <= F.col("__radius"))))
    return kept.drop("__k", "__radius")


def knn_graph(vectors: DataFrame, k: int, by: str) -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest others of every vector within its group of `by`.

    A group is cut into blocks of rows; each block meets the others of its group in turn, and only the k best of a row
    leave a pair of blocks.
    """
    rows_per_block = 2048
    sizes = vectors.groupBy(by).agg(F.count("*").alias("__n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("__n") / rows_per_block))
    dealt = vectors.select(by, "id", "vector").join(sizes, by).select(by, "id", "vector", blocks.alias("__blocks"), F.pmod(F.xxhash64("id"), blocks).alias("__block"))
    left = dealt.select(by, "id", "vector", F.col("__block").alias("__a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__b"))
    right = dealt.select(
        F.col(by).alias("__by"), F.col("id").alias("__id"), F.col("vector").alias("__vector"), F.col("__block").alias("__d"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__c"),
    )
    id_type = vectors.schema["id"].dataType.simpleString()
    group_type = vectors.schema[by].dataType.simpleString()

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = [by, "id", "neighbour", "distance"]
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in columns})
        x, y = np.array(a["vector"].tolist(), float), np.array(b["__vector"].tolist(), float)
        ids = b["__id"].to_numpy()
        out = []
        for i, (own, v) in enumerate(zip(a["id"], x)):
            d = ((y - v) ** 2).sum(1)
            at = np.flatnonzero(ids != own)
            if len(at) > k:
                at = at[d[at] <= np.partition(d[at], k - 1)[k - 1]]
            out.append(pd.DataFrame({by: a[by].iloc[0], "id": own, "neighbour": ids[at], "distance": d[at]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in columns})

    met = left.groupBy(by, "__a", "__b").cogroup(right.groupBy("__by", "__c", "__d")).applyInPandas(meet, f"`{by}` {group_type}, id {id_type}, neighbour {id_type}, distance double")
    return top_k(met, k, ["id"], "distance", "neighbour", descending=False)


def dense_scores(near: DataFrame) -> DataFrame:
    """Score: 1 less the distance."""
    return near.withColumn("score", F.lit(1.0) - F.col("distance"))


def valid_vectors(rows: DataFrame, dims: int) -> DataFrame:
    """Rows whose vector has the right length and only finite numbers."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("vector") == dims) & finite)


# ---- fusion


def rrf(lists: Sequence[tuple[DataFrame, float]], k: float = RRF_K, key: str = "doc") -> DataFrame:
    """(query, doc, score): weighted reciprocal ranks, added over lists(query, doc, rank). A list that lacks a document
    adds nothing."""
    parts = [df.select("query", key, (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("__part")) for df, w in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query", key).agg(F.sum("__part").alias("score"))


def mmr_order(ids: Sequence, relevance: Sequence[float], vectors: Sequence, k: int, weight: float = 0.7, pool: int = 50) -> list[tuple]:
    """Greedy choice by maximal marginal relevance: (id, objective) in the order chosen. Candidates are the `pool` most
    relevant, each id once; a missing or zero vector is similar to nothing; vectors of unequal length are compared over
    what both have; ties go to the smaller id."""
    candidates, seen = [], set()
    for i, r, v in sorted(zip(ids, relevance, vectors), key=lambda x: (-x[1], x[0])):
        if i not in seen and len(candidates) < pool:
            seen.add(i)
            v = None if v is None else np.asarray(v, float)
            size = 0.0 if v is None else float(np.sqrt((v * v).sum()))
            candidates.append([i, r, v / size if size else None, 0.0])
    out = []
    while candidates and len(out) < k:
        values = [weight * c[1] - (1 - weight) * c[3] for c in candidates]
        best = min(range(len(candidates)), key=lambda j: (-values[j], candidates[j][0]))
        chosen = candidates.pop(best)
        out.append((chosen[0], values[best]))
        for c in candidates:
            if c[2] is not None and chosen[2] is not None:
                n = min(len(c[2]), len(chosen[2]))
                c[3] = max(c[3], float(c[2][:n] @ chosen[2][:n]))
    return out


def mmr(ranked: DataFrame, k: int, weight: float = 0.7, pool: int = 50, key: str = "doc") -> DataFrame:
    """(query, doc, objective, rank) of ranked(query, doc, score, vector): at most `pool` rows of a query reach Python."""
    top = top_k(ranked, pool, ["query"], key=key)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        found = mmr_order(rows[key].tolist(), rows["score"].tolist(), rows["vector"].tolist(), k, weight, pool)
        return pd.DataFrame({"query": rows["query"].iloc[0], key: [i for i, _ in found], "objective": [o for _, o in found], "rank": range(1, len(found) + 1)})

    schema = f"query {ranked.schema['query'].dataType.simpleString()}, {key} {ranked.schema[key].dataType.simpleString()}, objective double, rank int"
    return top.select("query", key, "score", "vector").groupBy("query").applyInPandas(choose, schema)


def hybrid(sparse: DataFrame, dense: DataFrame, k: int, key: str = "doc") -> DataFrame:
    """The k best by reciprocal ranks of both lists."""
    return top_k(rrf([(sparse, 1.0), (dense, 1.0)], key=key), k, ["query"], key=key)


def rerank(ranked: DataFrame, score: Column, key: str = "doc") -> DataFrame:
    """Ranked rows in the order of another score."""
    return ranked.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col(key))))


def search_with_fallback(sparse: DataFrame, dense: DataFrame, status: Callable[[], tuple[str, int]], strict: bool, waits: Sequence[float] = RETRY_WAITS) -> DataFrame:
    """Sparse results if their index is ready and holds documents. If it is not, strict callers get a RuntimeError at
    once; for others its status() is asked again after each of waits (seconds), then the dense results stand in."""
    for wait in (0.0, *(() if strict else waits)):
        time.sleep(wait)
        state, n_docs = status()
        if state == "ready" and n_docs > 0:
            return sparse
    if strict:
        raise RuntimeError(f"sparse index is {state} with {n_docs} documents")
    return dense


def merge_kinds(lists: Sequence[DataFrame], k: int, key: str = "doc") -> DataFrame:
    """The k best of several lists (query, doc, score)."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return top_k(every, k, ["query"], key=key)


NORMALIZERS = {"minmax": S.minmax, "zscore": S.zscore, "logistic": S.logistic}
TOKENIZERS = {"code": X.code_tokens, "words": X.word_tokens}
