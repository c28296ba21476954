"""Batch-first retrieval: a DataFrame of queries in, ranked rows or assembled context out."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import context as C
from tessera.operators import retrieval as R
from tessera.operators.sparse_index import SparseIndex
from tessera.operators.vector_index import VectorIndexes


@dataclasses.dataclass
class Retriever:
    """nodes(id, node_type, name, file_path, canon, namespace, text) and vectors(id, vector, node_type, namespace).

    With sparse or dense, searches read these stored indexes (see index()) instead of the nodes and vectors; the sparse one
    gives the same rows, the dense one those of the cells that it reads. A sparse index that is not ready is passed over,
    unless the caller is strict."""

    nodes: DataFrame
    vectors: DataFrame
    tokens: Column | None = None
    sparse: SparseIndex | None = None
    dense: VectorIndexes | None = None
    set_id: int = 0

    def index(self, path: str) -> "Retriever":
        """Write both indexes below path, and use them from now on. Written once: what is there is kept."""
        spark = self.nodes.sparkSession
        self.sparse, self.dense = SparseIndex(spark, f"{path}/sparse"), VectorIndexes(spark, f"{path}/dense")
        if self.sparse.status()[0] == "uninitialized":
            self.sparse.upsert(self.nodes, self._tokens(), "id", F.col("namespace"))
        self.dense.create(self.set_id, self.vectors)
        return self

    def _tokens(self) -> Column:
        return X.code_tokens(R.indexed_text(F.col("name"), F.col("text"))) if self.tokens is None else self.tokens

    def _scope(self, namespace: str | None) -> Column | None:
        return None if namespace is None else F.col("namespace") == namespace

    def search_bm25(self, queries: DataFrame, k: int, namespace: str | None = None, strict: bool = False) -> DataFrame:
        """(query, id, score, rank) of queries(query, text). Strict callers get a RuntimeError where there is a stored index
        that is not ready."""
        terms = queries.select("query", F.explode(F.array_distinct(X.code_tokens(F.col("text")))).alias("term"))
        if self.sparse is not None:
            state, docs = self.sparse.status()
            if state == "ready":
                return self.sparse.search(terms, k, namespace).withColumnRenamed("doc", "id")
            if strict:
                raise RuntimeError(f"sparse index is {state} with {docs} documents")
        scored = R.bm25_scores(self.nodes, self._tokens(), terms, key="id", scope=self._scope(namespace))
        return R.top_k(scored.withColumnRenamed("doc", "id"), k, ["query"], key="id")

    def search_dense(self, queries: DataFrame, k: int, namespace: str | None = None, post_filter: bool = False, radius: float | None = None) -> DataFrame:
        """(query, id, score, rank) of queries(query, vector)."""
        scope = self._scope(namespace)
        if self.dense is not None and self.dense.registered(self.set_id) and not post_filter:
            near = self.dense.search(self.set_id, queries, k, where=scope)
            near = near if radius is None else near.where(F.col("distance") <= radius)
            return R.dense_scores(near).select("query", "id", "score", "rank")
        near = R.knn(queries, self.vectors, k, radius=radius, where=None if post_filter else scope, post_filter=scope if post_filter else None)
        return R.dense_scores(near).select("query", "id", "score", "rank")

    def hybrid(self, queries: DataFrame, k: int, namespace: str | None = None) -> DataFrame:
        """Reciprocal ranks of both searches, of queries(query, text, vector)."""
        sparse, dense = self.search_bm25(queries, k, namespace), self.search_dense(queries, k, namespace)
        return R.hybrid(sparse, dense, k, key="id")

    def get_context(self, queries: DataFrame, budget: int, namespace: str | None = None, diversify: bool = False, **options) -> DataFrame:
        """Parts of the best hits that fit into the budget; as many hits are looked at as the budget asks for."""
        k = max(5, min(20, budget // 200))
        ranked = self.hybrid(queries, k, namespace)
        if diversify:
            ranked = R.mmr(ranked.join(self.vectors.select("id", "vector"), "id", "left"), k, key="id").withColumnRenamed("objective", "score")
        facts = self.nodes.select("id", "file_path", F.col("node_type").alias("kind"), "text", "canon")
        parts = ranked.select("query", "id", "score").join(facts, "id")
        assembled = C.assemble(parts.drop("canon"), max_total=budget, **options)
        return assembled.join(facts.select("id", "canon"), "id")
