"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodemand.llm.common import pick, shared_folder
from geodemand.llm.decontaminate import contamination_digest, find_contamination
from geodemand.llm.embed_dedup import embedding_groups
from geodemand.llm.hard_negatives import Mining, mine_hard_negatives
from geodemand.llm.langid import held_out, identify, learn_languages, training_rows
from geodemand.llm.packing import pack_documents
from geodemand.llm.passages import repeated_passages
from geodemand.llm.resample import resample
from geodemand.llm.secrets import find_secrets, secrets_digest
from geodemand.llm.sharding import assign_shards
from geodemand.llm.simhash import simhash_groups
from geodemand.llm.url_filter import Rule, judge_urls
from geodemand.llm.warc import read_warc, write_warc
from geodemand.llm.whitening import whiten, whitening_digest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 24)


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = shared_folder(spark, "warc")
    if not write_warc(pages, folder):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    records = read_warc(spark, folder, with_payload=False)
    return records.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), 2048)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return contamination_digest(found)


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), 3)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(training_rows(docs))
    found = identify(pick(docs, doc_id="doc_id", text="text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: rows labelled good outside the held-out fold; four fifths of the corpus are drawn."""
    good = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", quality="quality").where("quality = 1")
    good = good.where(~held_out(F.col("doc_id"))).select("doc_id")
    return resample(table(spark, sf_dir, "documents"), good, 0.8)


@query
def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(find_secrets(table(spark, sf_dir, "documents")))


@query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), 0.9)


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_digest(whiten(table(spark, sf_dir, "embeddings"), 4))


URL_RULES = [Rule(True, "org", "/"), Rule(False, "example.org", "/es/"), Rule(False, "example.org", "/en/1"),
             Rule(True, "com", "/fr/"), Rule(False, "com", "/de/")]


@query
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = pick(rows, vec_id="vec_id", label="label", embedding="embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), Mining())


ORACLE["op13_hard_negatives"] = """
with rows as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [floor(256 * c::double) for c in embedding] as x
  from embeddings
  where label is not null and embedding is not null
    and len([c for c in embedding if c is null or not isfinite(c::double)]) = 0
), met as (
  select a.r as a, b.r as b, a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
         list_inner_product(a.x, b.x)::bigint as score
  from rows a join rows b on a.r <> b.r and len(a.x) = len(b.x) where a.vec_id % 100 = 0
), positive as (
  select a, anchor_id, b, id as positive_id, score as positive_score from met where same
  qualify row_number() over (partition by a order by score desc, id nulls last) <= 5
), ranked as (
  select p.anchor_id, p.positive_id, m.id as negative_id, p.positive_score, m.score as negative_score,
         row_number() over (partition by p.a, p.b order by m.score desc, m.id nulls last)::int as rank
  from positive p join met m on m.a = p.a and not m.same
   and 30 * p.positive_score <= 100 * m.score and 100 * m.score <= 90 * p.positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""
