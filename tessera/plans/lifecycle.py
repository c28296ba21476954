"""Queries of indexes, embeddings, sources, streams and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import schema, shared
from tessera.functions import scores as S
from tessera.functions import text as X
from tessera.operators import embeddings as E
from tessera.operators import graph as G
from tessera.operators import indexing as N
from tessera.operators import lookup as L
from tessera.operators import maintenance as M
from tessera.operators import retrieval as R
from tessera.operators import temporal as T
from tessera.operators import vector_index as V
from tessera.plans import graphs
from tessera.plans.registry import query
from tessera.plans.retrieval import NEAR_SQL, TOKENS_SQL, TOP, _queries, _vectors
from tessera.sources import files, rust_relations
from tessera.streaming import streams

# ---- the sparse index

#: Words of plain names and types: letters and digits only, with an inner capital nowhere.
PART_SQL = "WITH o AS (SELECT p_partkey AS doc, unnest(list_filter(string_split(lower(p_name || ' ' || p_name || ' ' || p_type), ' '), lambda x: x <> '')) AS term FROM part), t AS (SELECT doc, term, count(*) AS tf FROM o GROUP BY ALL), l AS (SELECT doc, count(*) AS len FROM o GROUP BY doc)"


def _nodes(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("text"))


@query(PART_SQL + " SELECT doc, term, tf, len FROM t JOIN l USING (doc)")
def bm25_sidecar(t):
    """Postings built, written, and read back."""
    path = shared.scratch(t.spark, "sidecar")
    N.save_index(N.build_index(_nodes(t)), path)
    return N.load_index(t.spark, path).select("doc", "term", "tf", "len")


@query(PART_SQL + ", n AS (SELECT doc, CASE WHEN doc % 5 = 0 THEN 'fresh' ELSE term END AS term, CASE WHEN doc % 5 = 0 THEN 1 ELSE tf END AS tf FROM t) SELECT term, count(DISTINCT doc) AS df, sum(tf)::BIGINT AS cf FROM (SELECT DISTINCT doc, term, tf FROM n) GROUP BY term")
def bm25_upsert(t):
    """Every fifth part is indexed anew, with another text."""
    index = N.build_index(_nodes(t))
    fresh = R.postings(t.part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("id")), F.array(F.lit("fresh")), "id")
    return R.upsert_docs(index, fresh).groupBy("term").agg(F.countDistinct("doc").alias("df"), F.sum("tf").alias("cf"))


@query("SELECT 'ready' AS state, count(*) AS docs FROM part UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'uninitialized', 0")
def bm25_index_status(t):
    index = N.build_index(_nodes(t))
    found = [N.IndexStatus.of(x) for x in (index, index.limit(0), None)]
    return t.spark.createDataFrame([(x.state, x.docs) for x in found], "state string, docs long")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS versions, len(string_split(p_name, ' '))::BIGINT AS token_length FROM part")
def bm25_doc_meta(t):
    """Facts of all parts, then once more of every third: the newest are live."""
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("tracking_hash"), F.col("p_name").alias("text"))
    log = t.spark.createDataFrame([], "id long, tracking_hash string, tokenizer_version string, token_length long, ts long, is_assert boolean")
    log = N.put_doc_meta(N.put_doc_meta(log, nodes, 1), nodes.where("id % 3 = 0"), 2)
    return T.live(log, ["id"]).select("id", F.col("ts").cast("int").alias("versions"), "token_length")


@query("SELECT n_name AS attempt, CASE WHEN n_nationkey % 3 = 0 THEN 'sparse' WHEN n_nationkey % 3 = 1 THEN 'dense' ELSE 'error' END AS answer FROM nation")
def strict_and_lenient_search(t):
    """A ready index answers; one that is not is an error to strict callers, and the dense list to lenient ones."""
    sparse, dense = (t.spark.createDataFrame([(x,)], "answer string") for x in ("sparse", "dense"))
    out = []
    for r in t.nation.select("n_name", "n_nationkey").orderBy("n_nationkey").collect():
        ready = r.n_nationkey % 3 == 0
        try:
            found = R.search_with_fallback(sparse, dense, lambda ready=ready: ("ready", 10) if ready else ("building", 0), strict=r.n_nationkey % 3 == 2, waits=())
            out.append((r.n_name, found.first()["answer"]))
        except RuntimeError:
            out.append((r.n_name, "error"))
    return t.spark.createDataFrame(out, "attempt string, answer string")


# ---- vectors


@query(NEAR_SQL + " SELECT query, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, id)::INTEGER AS rank FROM n QUALIFY rank <= 20")
def vector_index_all_cells(t):
    """The index read cell by cell, all of them: the exact answer."""
    indexes = V.VectorIndexes(t.spark, shared.scratch(t.spark, "vectors"))
    indexes.create(1, _vectors(t))
    return indexes.search(1, _queries(t), TOP, exact=True).select("query", "id", F.round("distance", 6).alias("distance"), "rank")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def vector_index_lifecycle(t):
    """Created once, not again, replaced with fewer rows, dropped; the rows that a full read of the first one returns."""
    indexes = V.VectorIndexes(t.spark, shared.scratch(t.spark, "vectors"))
    steps = [indexes.registered(1), indexes.create(1, _vectors(t), cells=4), indexes.create(1, _vectors(t)), indexes.registered(1)]
    rows = shared.materialize(t.spark.read.parquet(indexes.sets()[1] + "/cells").groupBy("label").agg(F.count("*").alias("n")), "rows")
    steps += [indexes.create(1, _vectors(t).where("id < 50"), replace=True), indexes.drop(1), indexes.drop(1), indexes.registered(1)]
    if steps != [False, True, False, True, True, True, False, False]:
        raise AssertionError(steps)
    return rows


@query("SELECT doc_id AS id, length(text)::DOUBLE AS size, (ascii(text) % 7)::DOUBLE AS second, NULL AS error FROM documents WHERE text IS NOT NULL AND length(text) > 0 AND text NOT LIKE '%license%' UNION ALL SELECT doc_id, NULL, NULL, 'refused' FROM documents WHERE text LIKE '%license%'")
def embed_batches(t):
    """A provider that answers out of order and refuses texts with a certain word, one text a batch."""

    def provider(texts):
        if any("license" in x for x in texts):
            raise RuntimeError("refused")
        order = list(range(len(texts)))[::-1]
        return order, [[float(len(texts[i])), float(ord(texts[i][0]) % 7)] for i in order]

    rows = t.documents.where("text is not null and length(text) > 0").select(F.col("doc_id").alias("id"), "text")
    found = E.embed(rows, F.col("text"), provider, 2, batch=1, attempts=2, wait=0.0)
    return found.select("id", F.get("vector", F.lit(0)).cast("double").alias("size"), F.get("vector", F.lit(1)).cast("double").alias("second"), "error")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding[1:8], embedding[17:24]), lambda z: ((z[1]::DOUBLE + z[2]::DOUBLE) / 2) ** 2))), 5) AS size, round((embedding[1]::DOUBLE + embedding[17]::DOUBLE) / 2 / sqrt(list_sum(list_transform(list_zip(embedding[1:8], embedding[17:24]), lambda z: ((z[1]::DOUBLE + z[2]::DOUBLE) / 2) ** 2))), 5) AS first FROM embeddings")
def mean_pooling(t):
    """Three tokens of eight numbers each, of which the second is masked out."""
    parts = F.array(*(F.slice("embedding", i, 8) for i in (1, 9, 17)))
    pooled = S.mean_pool(parts, F.array(F.lit(1), F.lit(0), F.lit(1)))
    raw = F.transform(F.arrays_zip(F.slice("embedding", 1, 8).alias("a"), F.slice("embedding", 17, 8).alias("b")), lambda z: (z["a"].cast("double") + z["b"].cast("double")) / 2)
    return t.embeddings.select("vec_id", F.round(S.norm(raw), 5).alias("size"), F.round(F.get(pooled, F.lit(0)), 5).alias("first"))


@query("SELECT n_name AS namespace, CASE WHEN n_nationkey % 2 = 0 THEN 'chosen' ELSE 'first' END AS which FROM nation")
def active_embedding_sets(t):
    """Three sets, of which two hold vectors; crates without a choice of their own take the smallest of those."""
    log = t.spark.createDataFrame([], schema.RELATIONS["embedding_set"].schema)
    for ts, model in enumerate(("a", "b", "c", "b")):
        log = E.register_set(log, "p", model, 64, ts)
    sets = T.live(log, ["id"])
    ids = {r["model"]: r["id"] for r in sets.collect()}
    vectors = t.spark.createDataFrame([("x", ids["a"]), ("y", ids["c"])], "node_id string, set_id long")
    chosen = t.nation.select(F.col("n_name").alias("namespace"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(ids["b"])).alias("set_id"))
    found = E.active_set(chosen, sets, vectors)
    which = F.when(F.col("set_id") == ids["b"], "chosen").when(F.col("set_id") == min(ids["a"], ids["c"]), "first")
    return found.select("namespace", which.alias("which"))


def _vector_log(t):
    return t.customer.select(F.concat(F.lit("c:"), "c_custkey").alias("node_id"), F.lit(1).cast("long").alias("set_id"), F.array(F.col("c_acctbal").cast("float")).alias("vector"), F.lit(1).cast("long").alias("ts"), F.lit(True).alias("is_assert"))


@query("SELECT 'c:' || c_custkey AS node_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3")
def retract_by_file(t):
    """All vectors at or below the module of one file are retracted; the others are live."""
    log = E.retract_changed(_vector_log(t), 1, t.region.where("r_regionkey = 3").select(F.concat(F.lit("r:"), "r_regionkey").alias("id")), graphs.edges(t), 2)
    return T.live(log, ["node_id", "set_id"]).select("node_id")


CHANGED_SQL = f"WITH {graphs.EDGES_SQL}, m AS (SELECT r_regionkey FROM region WHERE r_regionkey IN (0, 2)), n AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 2))"


def _applied(t):
    files_ = graphs.files(t)
    stored = files_.select("file_path", F.lit("old").alias("hash"))
    edited = F.col("owner_id").isin("r:0", "r:2")
    current = files_.select("file_path", F.when(edited, "new").otherwise("old").alias("hash"))
    return N.apply_changes(stored, current, files_, graphs.edges(t), _vector_log(t), 1, 2, G.PARENT_KINDS)


@query(CHANGED_SQL + " SELECT 'r:' || r_regionkey AS id FROM m UNION ALL SELECT 'n:' || n_nationkey FROM n UNION ALL SELECT 'c:' || c_custkey FROM customer JOIN n ON c_nationkey = n_nationkey UNION ALL SELECT 's:' || s_suppkey FROM supplier JOIN n ON s_nationkey = n_nationkey UNION ALL SELECT 'o:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey")
def changed_items(t):
    return _applied(t)["touched"]


@query(CHANGED_SQL + " SELECT 'c:' || c_custkey AS node_id, c_nationkey IN (SELECT n_nationkey FROM n) AS pending FROM customer")
def change_pipeline(t):
    """Vectors of changed files are retracted, which makes their items pending again."""
    log = shared.materialize(_applied(t)["vectors"], "vectors")
    items = graphs.nodes(t).where("id like 'c:%'")
    again = E.pending(items, log, 1).select(F.col("id").alias("node_id"), F.lit(True).alias("pending"))
    return items.select(F.col("id").alias("node_id")).join(again, "node_id", "left").fillna(False)


@query("SELECT p_partkey AS id, 'part_' || p_size % 3 AS relation, p_brand AS tracking_hash FROM part WHERE p_partkey IN (7, 8, 9)")
def tracking_hash_lookup(t):
    relations = {f"part_{k}": t.part.where(F.col("p_size") % 3 == k).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("tracking_hash")) for k in range(3)}
    found = [N.tracking_hash_of(relations, i).select(F.lit(i).cast("long").alias("id"), "relation", "tracking_hash") for i in (7, 8, 9)]
    return found[0].unionByName(found[1]).unionByName(found[2])


# ---- compilation units


def _units(t):
    units = t.region.select(F.concat(F.lit("u"), "r_regionkey").alias("cu_id"), F.concat(F.lit("src/"), "r_name", F.lit(".rs")).alias("target_root"))
    return N.unit_masks(units, graphs.files(t), graphs.edges(t), graphs.nodes(t).where("node_type = 'method'"), F.col("id") != "s:1")


BELOW_SQL = "WITH b AS (SELECT n_regionkey AS r, 'n:' || n_nationkey AS id FROM nation UNION ALL SELECT r_regionkey, 'r:' || r_regionkey FROM region UNION ALL SELECT n_regionkey, 'c:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, 'o:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, 's:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey <> 1)"


@query(BELOW_SQL + " SELECT 'u' || r AS cu_id, id AS node_id FROM b")
def unit_masks(t):
    """Units of a region each; a supplier whose cfg does not hold is in none."""
    return _units(t).names("nodes").select("cu_id", F.col("id").alias("node_id"))


@query(BELOW_SQL + " SELECT 'u' || r AS cu_id, count(*) AS nodes, count(*) - 1 AS edges, 1::BIGINT AS files FROM b GROUP BY r")
def unit_counts(t):
    return N.unit_counts(_units(t))


# ---- sources


@query("SELECT doc_id::VARCHAR AS file_path, list_filter(list_transform([0, 1, 2, 3], lambda k: try(decode(unhex(substr(x, 1, 2 * (200 - k)))))), lambda y: y IS NOT NULL)[1] AS text, length(x) > 400 AS truncated FROM (SELECT doc_id, hex(encode(array_to_string(string_split(text, chr(10))[2:5], chr(10)))) AS x FROM documents WHERE text IS NOT NULL)")
def ranged_read(t):
    """Lines 2 to 5 of each text, cut to 200 bytes where a character ends."""
    contents = t.documents.where("text is not null").select(F.col("doc_id").cast("string").alias("file_path"), F.encode("text", "UTF-8").alias("content"))
    return files.read_text(contents, 2, 5, max_bytes=200)


@query("SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_name || p_partkey) - 1 AS pos, p_name || p_partkey AS name, true AS more FROM part WHERE p_size % 10 <> 0 QUALIFY pos < 25")
def folder_listing(t):
    """Names that do not begin with a dot, the largest first."""
    hidden = F.when(F.col("p_size") % 10 == 0, ".").otherwise("")
    entries = t.part.select(F.concat(hidden, "p_name", "p_partkey").alias("name"), F.col("p_size").alias("mtime"), F.col("p_retailprice").alias("size"))
    names, more = files.list_folder(entries, False, "size", 25)
    return t.spark.createDataFrame([(i, n, more) for i, n in enumerate(names)], "pos long, name string, more boolean")


@query("SELECT 'nation' AS relation, count(*) AS rows FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'region', 0 FROM region WHERE r_regionkey = 0")
def snapshot_and_clear(t):
    """Three relations written and read back without a fourth; one is cleared, and the rows of each are counted."""
    path = shared.scratch(t.spark, "snapshot")
    files.save_snapshot({"nation": t.nation, "part": t.part, "region": t.region, "supplier": t.supplier}, path)
    return M.count_relations(M.clear(files.load_snapshot(t.spark, path, skip=["supplier"]), ["region"]))


@query("SELECT p_name || ' ' || p_partkey AS prompt, p_size::BIGINT AS k, (p_size + 1)::BIGINT AS ef, 20::BIGINT AS max_hits, p_retailprice AS radius FROM part")
def prompts_round_trip(t):
    """Prompts written as JSON lines and read as prompts."""
    path = shared.scratch(t.spark, "prompts")
    rows = t.part.select(F.concat_ws(" ", "p_name", "p_partkey").alias("prompt"), F.col("p_size").cast("long").alias("k"), (F.col("p_size") + 1).cast("long").alias("ef"), F.lit(20).cast("long").alias("max_hits"), F.col("p_retailprice").alias("radius"))
    files.write_results(rows, path)
    return files.read_prompts(t.spark, path, lines=True)


@query("SELECT n_name AS namespace, 'src/' || n_name || CASE n_nationkey % 3 WHEN 0 THEN '/main.rs' WHEN 1 THEN '/lib.rs' ELSE '/a.rs' END AS file_path FROM nation")
def root_selection(t):
    """Of the files a.rs, lib.rs and main.rs that a crate has, the first by rank: which it has goes by its number."""
    names = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("a.rs"), F.lit("main.rs"), F.lit("lib.rs"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("b.rs"), F.lit("lib.rs"))).otherwise(F.array(F.lit("b.rs"), F.lit("a.rs")))
    roots = t.nation.select(F.col("n_name").alias("namespace"), F.explode(names).alias("f")).select("namespace", F.concat_ws("/", F.lit("src"), "namespace", "f").alias("file_path"))
    return G.select_root(roots).where("is_root").select("namespace", "file_path")


@query(f"WITH {graphs.EDGES_SQL} SELECT source_id, target_id, relation_kind FROM e")
def graph_merge(t):
    """Graphs of one region each, put together; an edge that two of them held would be an error."""
    every = graphs.edges(t).withColumn("part", F.pmod(F.xxhash64("source_id"), F.lit(3)))
    parts = [{"edges": every.where(F.col("part") == k).drop("part")} for k in range(3)]
    return G.merge_graphs(parts, {"edges": ["source_id", "target_id", "relation_kind"]})["edges"]


@query("SELECT DISTINCT p_name AS name, p_brand AS tracking_hash FROM part WHERE p_type = 'ECONOMY'")
def query_builder(t):
    """Fields by name from one relation; a field that it does not have is left out with a warning."""
    built = L.Query("struct").field("name", "colour").field("tracking_hash").where(docstring="ECONOMY")
    if built.warnings != ("struct has no field colour",):
        raise AssertionError(built.warnings)
    return built.run({"struct": t.part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("tracking_hash"), F.col("p_type").alias("docstring"))})


@query("SELECT p_partkey, (p_size % 4 = 0)::INT + (p_size % 3 = 0)::INT + (p_size % 5 = 0)::INT AS problems FROM part")
def lookup_validation(t):
    requests = t.part.select(
        "p_partkey", F.when(F.col("p_size") % 4 == 0, "thing").otherwise("struct").alias("node_kind"), F.when(F.col("p_size") % 3 == 0, "a.txt").otherwise("src/a.rs").alias("file_path"),
        F.when(F.col("p_size") % 5 == 0, F.array(F.lit("std"))).otherwise(F.array(F.lit("crate"), F.lit("m"))).alias("module_path"), F.col("p_name").alias("name"),
    )
    return L.valid_lookups(requests).select("p_partkey", F.size("problems").alias("problems"))


@query("SELECT n_nationkey, n_nationkey % 3 <> 2 AS inside FROM nation")
def paths_in_roots(t):
    """Paths below a root, the root itself, and one that leaves it by dots."""
    way = lambda k: ["/a/b/x.rs", "/a/b", "/a/b/../c/x.rs"][k % 3]
    found = [(r.n_nationkey, files.path_in_roots(way(r.n_nationkey), ["/a/b", "/z"])) for r in t.nation.select("n_nationkey").collect()]
    return t.spark.createDataFrame(found, "n_nationkey long, inside boolean")


@query("SELECT table_name AS relation, column_name AS column FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'supplier')")
def system_catalog(t):
    """Relations of the session and their columns, as the session's catalogue has them."""
    for name in ("region", "nation", "supplier"):
        getattr(t, name).createOrReplaceTempView(name)
    rows = [(name, c) for name, columns in files.catalog_relations(t.spark) for c in columns if name in ("region", "nation", "supplier")]
    return t.spark.createDataFrame(rows, "relation string, column string")


# ---- streams


@query(f"SELECT count(*) AS n_docs, round(avg(len({TOKENS_SQL})), 6) AS avgdl, sum(len({TOKENS_SQL}))::BIGINT AS tokens FROM documents WHERE len({TOKENS_SQL}) > 0")
def index_stream(t):
    """Documents indexed as a stream of files, in micro-batches, started twice: what was read is not read again."""
    folder, path, checkpoint = (shared.scratch(t.spark, x) for x in ("docs", "postings", "checkpoint"))
    t.documents.repartition(3).write.option("parquet.block.size", 8 << 20).parquet(folder)  # a batch is a file, and a task reads whole row groups
    source = t.spark.readStream.schema(t.documents.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for _ in range(2):
        streams.index_stream(source, X.word_tokens(F.col("text")), path, checkpoint).awaitTermination()
    found = t.spark.read.parquet(path)
    tokens = found.agg(F.sum("tf").alias("tokens"))
    return streams.finalize(found).withColumn("avgdl", F.round("avgdl", 6)).crossJoin(tokens)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def change_callbacks(t):
    """A handler called for each micro-batch of changed rows, by batch number."""
    folder, path, checkpoint = (shared.scratch(t.spark, x) for x in ("events", "seen", "checkpoint"))
    t.events.select("event_id", "event_type").repartition(2).write.parquet(folder)
    source = t.spark.readStream.schema("event_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(folder)
    streams.on_change(source, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}"), checkpoint).awaitTermination()
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE turn < 2")
def subtree_delete(t):
    """Every conversation without its third message and all that follow it."""
    id_ = F.concat_ws(":", "conv_id", "turn")
    messages = t.conversations.select("conv_id", "turn", id_.alias("id"), F.when(F.col("turn") > 0, F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1)).alias("parent"))
    return G.delete_subtree(messages, messages.where("turn = 2").select("id")).select("conv_id", "turn")


@query("SELECT sum(strlen(n_name) + 1)::BIGINT AS bytes FROM nation")
def source_discovery(t):
    """Files of one pattern found below a folder, whatever else lies there."""
    path = shared.scratch(t.spark, "sources")
    t.nation.select("n_name").repartition(3).write.text(f"{path}/a/b")
    t.region.write.parquet(f"{path}/c")
    return files.source_files(t.spark, path, "*.txt").agg(F.sum("length").alias("bytes"))


def _sources(t):
    text = F.concat(
        F.lit("/// Part.\n#[derive(Debug)]\npub struct P"), "p_partkey", F.lit(" {\n    pub size: Vec<u"), "p_size", F.lit(">, // \"}\n    name: String,\n}\nimpl P"), "p_partkey",
        F.lit(" {\n    fn get(&self, mut k: usize) -> u"), "p_size", F.lit(" { self.size[k] }\n}\n"),
    )
    return t.part.select(F.concat(F.lit("src/p"), "p_partkey", F.lit(".rs")).alias("file_path"), F.encode(text, "UTF-8").alias("content"))


@query("SELECT 'P' || p_partkey AS struct, unnest(['size', 'name']) AS field, unnest(['Public', 'Inherited']) AS visible, unnest(['Vec', 'String']) AS type FROM part")
def rust_fields(t):
    """Fields of structs with the types they name, from a source file for each part."""
    tables = rust_relations.to_tables(shared.materialize(rust_relations.parse_rows(_sources(t)), "rows"), 1)
    types = tables["named_type"].select("type_id", F.element_at("path", -1).alias("type"))
    named = tables["struct"].select(F.col("id").alias("owner_id"), F.col("name").alias("struct"))
    return tables["field"].join(named, "owner_id").join(types, "type_id").select("struct", F.col("name").alias("field"), F.col("vis_kind").alias("visible"), "type")


@query("SELECT 'src/p' || p_partkey || '.rs' AS file_path, 1::BIGINT AS structs, 1::BIGINT AS impls, 1::BIGINT AS methods, 2::BIGINT AS params, 1::BIGINT AS attributes, 2::BIGINT AS fields FROM part")
def rust_relation_counts(t):
    rows = rust_relations.parse_rows(_sources(t))
    of = lambda name: F.count_if(F.col("relation") == name).alias(f"{name}s")
    return rows.groupBy("file_path").agg(*map(of, ("struct", "impl", "method", "param", "attribute", "field")))


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def file_hashes(t):
    contents = t.documents.where("text is not null").select(F.col("doc_id").alias("file_path"), F.encode("text", "UTF-8").alias("content"))
    return files.file_hashes(contents).select(F.col("file_path").alias("doc_id"), "hash")


