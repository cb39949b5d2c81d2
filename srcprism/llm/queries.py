"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, lsh, packing, pii, pq, secrets, sharding, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _spans(found: Column, kinds: list[str], by_kind: bool) -> Column:
    """kind:start:end, joined by commas; by kind then start, or by start then kind."""
    ranked = F.transform(
        found,
        lambda x: F.struct(
            *(
                [F.array_position(F.array(*map(F.lit, kinds)), x["kind"]).alias("a"), x["start"].alias("b")]
                if by_kind
                else [x["start"].alias("a"), F.array_position(F.array(*map(F.lit, kinds)), x["kind"]).alias("b")]
            ),
            x["end"].alias("end"),
            x["kind"].alias("kind"),
            x["start"].alias("start"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(ranked), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op7_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    term = lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.transform("found", plain)
    return found.select(
        "doc_id",
        *map(count, pii.PATTERNS),
        F.sha2(_spans(base, pii.KINDS, True).cast("binary"), 256).alias("base_sha256"),
        _spans(F.concat(base, F.transform("terms", term)), pii.KINDS, True).alias("spans"),
        pii.sanitised().alias("sanitised"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.RULES]
    base = [r.kind for r in secrets.RULES if r.base]
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("found", lambda x: x["kind"].isin(base))
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(_spans(own, kinds, False).cast("binary"), 256).alias("base_sha256"),
        _spans(F.col("found"), kinds, False).alias("spans"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_licenses": op2_licenses,
    "op3_langid": op3_langid,
    "op4_packing": op4_packing,
    "op5_pq": op5_pq,
    "op6_sharding": op6_sharding,
    "op7_lsh": op7_lsh,
    "op8_pii": op8_pii,
    "op9_secrets": op9_secrets,
    "op10_simhash": op10_simhash,
    "pipeline": pipeline,
}

#: The exact operators that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op5_pq": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
      r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
      n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a), m AS (SELECT a AS vec_id, min(b) AS least FROM r GROUP BY a)
      SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept
      FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)""",
}
