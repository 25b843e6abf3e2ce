"""Sentence side of the pipeline: corpus -> pool -> permutation -> tiers/queries.

Stage cache (S8): the sentences in corpus order, the permutation of their
positions and the tiers are each written once per session, when first asked
for, under the shared checkpoint folder and read back; a later call finds
``_SUCCESS`` and skips the work, as the reference reuses its pickled pool.
Texts are shuffled once for their order and once more for tiers or queries.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.operators import embed as EM
from nearfold.operators import sampling as S
from nearfold.session import path_exists, scratch_path
from nearfold.sources import fixtures

_MEMO: dict = {}


def staged(spark: SparkSession, path: str, build) -> DataFrame:
    """Read the parquet stage at ``path``; compute and write it first if missing."""
    if not path_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@dataclass
class Corpus:
    n_sentences: int
    pool_rows: int
    numbered: DataFrame  # doc_id, pos, text, n_chars, pool_pos (all sentences)
    ranks: DataFrame  # pool_pos, perm_rank of the pool
    root: str

    @property
    def texts(self) -> DataFrame:
        return self.numbered.select("pool_pos", "text")

    @property
    def perm(self) -> DataFrame:
        """Pool rows + perm_rank."""
        return self.ranks.join(self.texts, "pool_pos")

    @property
    def pool(self) -> DataFrame:
        return S.sentence_pool(self.numbered, self.pool_rows)

    @property
    def inserts(self) -> DataFrame:
        return S.insert_pool(self.numbered, self.pool_rows, self.pool_rows // 2)

    @property
    def tier_sizes(self) -> list[int]:
        return S.tier_sizes(self.pool_rows)

    @property
    def max_tier(self) -> int:
        return S.max_tier(self.pool_rows)

    @property
    def vectors(self) -> DataFrame:
        """(pool_pos, embedding) of every sentence: embedded once, stored, read by all parts."""
        encode = EM.numpy_hashed_encoder()
        return staged(
            self.numbered.sparkSession, f"{self.root}/vectors", lambda: EM.embed_batches(self.texts, "text", encode, EM.DIM, ("pool_pos",))
        )

    def parts(self) -> DataFrame:
        """(part, id, pool_pos) of every tier, the queries and the inserts."""
        return (
            self.tier_ids().select(F.concat(F.lit("tier_"), F.col("tier").cast("string")).alias("part"), "id", "pool_pos")
            .unionByName(self.query_ids().select(F.lit("queries").alias("part"), F.col("qid").alias("id"), "pool_pos"))
            .unionByName(self.inserts.select(F.lit("inserts").alias("part"), F.col("seq").alias("id"), "pool_pos"))
        )

    def tier_ids(self) -> DataFrame:
        """(tier, id, pool_pos), stored when first asked for."""
        return staged(
            self.numbered.sparkSession, f"{self.root}/tier_ids", lambda: S.tier_slice(self.ranks, self.tier_sizes).select("tier", "id", "pool_pos")
        )

    def tiers(self) -> DataFrame:
        """(tier, id, pool_pos, text), stored when first asked for; ids are numbered without the texts."""
        build = lambda: self.tier_ids().join(self.texts, "pool_pos").select("tier", "id", "pool_pos", "text")
        return staged(self.numbered.sparkSession, f"{self.root}/tiers", build)

    def query_ids(self) -> DataFrame:
        """(qid, pool_pos) of the held-out sentences."""
        return S.query_slice(self.ranks, self.max_tier).select("qid", "pool_pos")

    def queries(self) -> DataFrame:
        return self.query_ids().join(self.texts, "pool_pos").select("qid", "pool_pos", "text")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    files = fixtures.fingerprint(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, sf_dir, files)
    if key in _MEMO:
        return _MEMO[key]
    root = scratch_path(spark, "corpus", hashlib.sha1(f"{sf_dir}:{files}".encode()).hexdigest()[:12], fresh=False)
    docs = fixtures.load(spark, sf_dir, "documents").select("doc_id", "text")
    numbered = S.numbered_from(spark, f"{root}/in_order", lambda: S.sentences(docs))
    n = numbered.count()
    pool_rows = S.pool_size(n)
    ranks = staged(spark, f"{root}/ranks", lambda: S.permuted(numbered.where(F.col("pool_pos") < pool_rows).select("pool_pos")))
    c = _MEMO[key] = Corpus(n, pool_rows, numbered, ranks, root)
    return c
