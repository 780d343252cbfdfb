"""One registered query per operator, over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import (
    near_dup,
    neighbours,
    packing,
    pieces,
    pii,
    quality_rules,
    resampling,
    sql,
    suffix_dedup,
    toxicity,
    url_filter,
    vector_codes,
    warc,
    weak_quality,
)
from clickloom.session import new_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.token_pieces(docs, vocabulary("word_bpe_49k.json")))


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_shingles", "component_id", "kept")


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.deduplicated(docs).select(
        "row.doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("left", 256).alias("kept_sha256"),
    )


@query("op6_bootstrapped_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id",
        *[pii.counted("base", k).alias(f"n_{k}") for k in pii.KINDS[:4]],
        F.sha2(pii.joined_spans("base"), 256).alias("base_sha256"),
        pii.joined_spans("spans").alias("spans"),
    )


URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{}', '{}')".format(
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
)
_PLAIN = r"trim(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g'))"
_ARTICLE = "regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1)"
_ARTICLE = f"regexp_replace(regexp_replace({_ARTICLE}, '(?s)<h1>.*?</h1>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _from, _to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
    _ARTICLE = f"replace({_ARTICLE}, '{_from}', '{_to}')"
_URL_SQL = rf"""
WITH p AS (
  SELECT page_id, {_HOST} AS host, {_PLAIN.format(_ARTICLE)} AS article,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
c AS (
  SELECT *, regexp_replace(host, '^(www\.|m\.)+|:[0-9]*$|\.+$', '', 'g')
            || regexp_replace(path, '(/index)?(\.html?)?/*$', '') AS canonical,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com'))
                   AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com'))
                   AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
         END AS rule
  FROM p),
l AS (
  SELECT DISTINCT canonical FROM c
  WHERE canonical <> '' AND article <> '' AND article IN (
    SELECT {_PLAIN.format("coalesce(text, '')")} FROM documents JOIN labels USING (doc_id) WHERE toxic = 1))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""


@query("op7_url_filter", _URL_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clickloom.llm.common import keep

    pages = table(spark, sf_dir, "pages")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    digest = url_filter.text_digest(url_filter.plain_text(F.col("text")))
    # The digests meet the labels, not the texts, so no text goes through a shuffle.
    texts = table(spark, sf_dir, "documents").select("doc_id", digest.alias("digest")).join(toxic, "doc_id")
    listed = keep(url_filter.listed_urls(pages.select("url", "html"), texts), "listed-urls")
    found = url_filter.judged(pages.select("page_id", "url"), URL_RULES, listed, listed.count())
    return found.select("row.page_id", "host", "path", "rule", "verdict")


@query("op9_repetition_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.measured(docs).select("row.doc_id", "rules.*")


@query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = vocabulary("piece_bpe_32k.model")
    return pieces.decoded(pieces.encoded(docs, model), model).select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "score",
        "ids_crc32",
        F.sha2("text", 256).alias("decoded_sha256"),
        (F.col("text") == F.coalesce("row.text", F.lit(""))).alias("round_trip"),
    )


@query("op4_projection_forest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0)


@query("op5_toxic_spans")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = toxicity.scored(docs, toxicity.learned(docs, labels))
    return found.select(
        "row.doc_id",
        F.coalesce(toxicity.held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_toxic_words"),
        F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"]))).alias("spans"),
    )


@query("op8_weak_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = weak_quality.featured(docs)
    found = weak_quality.scored(found, *weak_quality.learned(found))
    return found.select("row.doc_id", "pattern", "posterior", "score", "kept")


@query("op11_warc", sql.WARC)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(warc.with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return warc.pages(warc.records(spark, path, payloads=False))


@query("op12_vector_codes", sql.codes())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = vector_codes.compressed(vectors)
    return coded.select(
        "row.vec_id",
        "code",
        "error",
        F.col("group_error").alias("label_error"),
        F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"),
    )


@query("op13_importance_resampling", sql.draw())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = table(spark, sf_dir, "benchmark").select("text")
    found = resampling.resampled(docs, target)
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")
