"""The registered queries of these operators, each over its whole table."""
from __future__ import annotations

from tenurelens.llm import byte_bpe, embedding_dedup, exact_dedup, filter_audit, importance, jaccard_join, lm, mixing, packing, substring_dedup, suffix_dedup, token_counts, toxicity
from tenurelens.llm.tables import read

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_substring_dedup")
def op1(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.substring_dedup(read(spark, sf_dir, "documents"), width=50))


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query("op3_lm_scoring")
def op3(spark, sf_dir):
    return lm.katz_scores(read(spark, sf_dir, "documents"), order=3, least=1)


@query("op4_embedding_near_dedup")
def op4(spark, sf_dir):
    return embedding_dedup.embedding_dedup(read(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op5_exact_dedup", """
with d as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t""")
def op5(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark, sf_dir):
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op7_token_counts")
def op7(spark, sf_dir):
    return token_counts.edited_counts(token_counts.build_trees(read(spark, sf_dir, "documents"), token_counts.redactions()))


@query("op8_ngram_jaccard_join")
def op8(spark, sf_dir):
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


@query("op9_byte_bpe")
def op9(spark, sf_dir):
    return byte_bpe.digest(byte_bpe.decode_documents(byte_bpe.encode_documents(read(spark, sf_dir, "documents"))))


@query("op10_suffix_array_dedup")
def op10(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"), length=200))


@query("op11_importance_resampling", importance.ORACLE_SQL)
def op11(spark, sf_dir):
    return importance.importance_resampling(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op12_source_mixing", mixing.ORACLE_SQL)
def op12(spark, sf_dir):
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


@query("op13_filter_audit", filter_audit.ORACLE_SQL)
def op13(spark, sf_dir):
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
