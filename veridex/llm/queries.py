"""One query per training-data operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veridex.llm import impact_search, line_dedup, lm_scoring, media, ngram_join, packing, pii, quality, sentencepiece_codec, warc
from veridex.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cross-entropy difference; a text without words has none. Repeated rows are scored each."""
    return lm_scoring.score_against_good(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, deleted lines and what is left; a null text has no lines and counts as empty."""
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as audio and read back; a null text counts as empty. Repeated rows stay repeated."""
    return media.texts_as_audio(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of similar ones and its links; a text without words is alone."""
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every row whose id is divisible by 50; rows with unusable vectors take no part, ties go to the smaller id."""
    return impact_search.search_table(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back; a null html counts as empty."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids in pieces of packed sequences; a null text is its end id alone."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities of being low in quality or toxic; a null text counts as empty."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with offsets and decoded; a null text counts as empty."""
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's personal data; a null text has none."""
    return pii.find(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_line_dedup, op3_media_columns, op4_ngram_jaccard, op5_exact_topk, op6_warc, op7_packing, op8_quality, op9_sentencepiece, op10_pii)}

# DuckDB SQL where SQL can express the rows. Files and floating-point models have none and are tested by brute force.
ORACLE: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op5_exact_topk": """
        with v as (
            select row_number() over () as row_id, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and vec_id is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), pairs as (
            select q.row_id, q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
            from v q join v c on q.vec_id % 50 = 0 and q.row_id <> c.row_id
        ), ranked as (
            select query_id, cast(row_number() over (partition by row_id order by score desc, vec_id) as integer) as rank, vec_id, score from pairs
        )
        select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op6_warc": """
        with p as (
            select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
        ), k as (
            select payload_digest, max(page_id) as last_id from p where payload_bytes >= 1000 group by payload_digest
        )
        select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
               case when k.last_id > p.page_id then 'revisit' else 'response' end as record_type,
               case when k.last_id > p.page_id then k.last_id end as refers_to
        from p left join k on p.payload_digest = k.payload_digest and p.payload_bytes >= 1000""",
}
