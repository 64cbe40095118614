"""Registered queries of the training-data operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm import langid, toxicity
from candlemill.llm.chat import repair_chats
from candlemill.llm.decontaminate import contaminated
from candlemill.llm.embeddings import near_duplicates
from candlemill.llm.html_template import extract
from candlemill.llm.mixing import mix_sources
from candlemill.llm.ngram_join import ngram_join
from candlemill.llm.passages import repeated_passages
from candlemill.llm.token_align import align_tokens
from candlemill.llm.token_files import read_token_files, write_token_files
from candlemill.llm.url_filter import Rule, judge_urls
from candlemill.llm.whitening import whiten
from candlemill.sources.shared import new_folder

URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int) -> Column:
    """The fold of a row: the checksum of its doc_id as text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3)
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return mixed.select("row.doc_id", "source", "size", "source_size", "target", taken, "rate", "copies")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"), 0.95)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", fold(3) == 1)
    model = toxicity.train(docs.where("not held_out"), _table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(_table(spark, sf_dir, "conversations"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold(5) != 0))
    found = langid.identify(docs, model).select("row.doc_id", "lang_pred", "score", "spans")
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(_table(spark, sf_dir, "embeddings"), components=4)
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def vocabulary(name: str) -> str:
    """Where a vocabulary file of a public tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token_files")
    write_token_files(_table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


OP6_SQL = """
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') AS path
  FROM parts
), judged AS (
  SELECT page_id, host, path,
         CASE WHEN host = 'example.org' OR host LIKE '%.example.org' THEN
                CASE WHEN path LIKE '/en/1%' THEN 'example.org/en/1' WHEN path LIKE '/es/%' THEN 'example.org/es/' WHEN path LIKE '/%' THEN 'org/' END
              WHEN host = 'org' OR host LIKE '%.org' THEN CASE WHEN path LIKE '/%' THEN 'org/' END
              WHEN host = 'com' OR host LIKE '%.com' THEN CASE WHEN path LIKE '/fr/%' THEN 'com/fr/' WHEN path LIKE '/de/%' THEN 'com/de/' END
         END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_html_template": op2_html_template,
    "op3_passages": op3_passages,
    "op4_source_mix": op4_source_mix,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_chat_format": op8_chat_format,
    "op9_decontaminate": op9_decontaminate,
    "op10_langid": op10_langid,
    "op11_whitening": op11_whitening,
    "op12_token_align": op12_token_align,
    "op13_token_files": op13_token_files,
}
ORACLES = {"op6_url_filter": OP6_SQL}
