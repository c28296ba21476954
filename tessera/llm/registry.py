"""The opN_ queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import decontaminate, exact_dedup, filter_audit, join_view, langid, minhash, ngram, packing, pii, sharding, tokenfile, toxicity, warc
from tessera.llm.common import documents


def tokenizer_path() -> str:
    """The vocabulary of the token queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark, sf_dir):
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_shard(spark, sf_dir):
    placed = sharding.assign(documents(spark, sf_dir), "doc_id", [f"shard-{i}" for i in range(sharding.SHARDS)])
    return placed.select("doc_id", "slot", "shard")


def op3_token_file(spark, sf_dir):
    path = tokenfile.write_documents(documents(spark, sf_dir), tokenizer_path(), end_id=2)
    return tokenfile.digest(spark, path)


def op4_lm_score(spark, sf_dir):
    return ngram.score(documents(spark, sf_dir))


def op5_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.digests(warc.derive(warc.responses(pages)))


def op6_pack(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op7_toxicity(spark, sf_dir):
    return toxicity.predictions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_langid(spark, sf_dir):
    return langid.predictions(documents(spark, sf_dir))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.decisions(documents(spark, sf_dir))


def op10_near_dedup(spark, sf_dir):
    return minhash.classes(documents(spark, sf_dir))


def op11_pii(spark, sf_dir):
    return pii.audit(documents(spark, sf_dir))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_join_view(spark, sf_dir):
    return join_view.maintain(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_shard": op2_shard,
    "op3_token_file": op3_token_file,
    "op4_lm_score": op4_lm_score,
    "op5_warc": op5_warc,
    "op6_pack": op6_pack,
    "op7_toxicity": op7_toxicity,
    "op8_langid": op8_langid,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_pii": op11_pii,
    "op12_filter_audit": op12_filter_audit,
    "op13_join_view": op13_join_view,
}
ORACLES = {"op2_shard": sharding.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_join_view": join_view.ORACLE}
