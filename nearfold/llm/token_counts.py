"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed entries.
A *batch* of changes becomes one table of entries: the counts of the rows it
brings, and the exact negation of what earlier batches say about the rows it
takes away.  It is computed from batches before it only: committing a batch
again, after a failure or by mistake, gives the same entries and totals.  A
commit writes a folder of its own and then publishes it with one small row, so
a crash leaves the earlier state, and a batch is never half there.

Changes are rows ``op, doc_id, text, source, lang`` (and ``text_hash`` in the
place of a text that is not at hand):

*   insert, revise: the document's rows are those of this batch;
*   delete: the document has no rows any more;
*   add, remove: one row of a document comes in; its rows of this text go.

Entries are per document and text, with the number of equal rows; the rollup
adds them up (partial sums before the shuffle, so a source with a third of all
rows is no burden).

Defined results: a document is named by ``doc_id``, or by its text where that
is null (the two never meet); every inserted or added row counts, repeated ones
as often as they occur; of several revisions of a document in one batch the
greatest text hash wins, and a deletion in the batch wins over insertions and
revisions; inserting a document that exists revises it, revising one that does
not inserts it, deleting or removing what is not there is nothing; null text
has no tokens; null source and language are groups of their own; empty batches
commit nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm import bpe
from nearfold.llm.common import python_ready, staged
from nearfold.llm.words import text_bytes, words_of
from nearfold.session import path_exists, scratch_path

#: Tokenizer versions by name: how many tokens a batch of texts has.
WORDS, BPE, BYTES = "words@1", "byte_bpe_50k@1", "utf8_bytes@1"
TOKENIZERS = (WORDS, BPE, BYTES)

ENTRY = "doc string, text_hash long, source string, lang string, tokenizer string, documents long, tokens long"


def _counts(texts: pa.Array, tokenizers: tuple[str, ...], paths: tuple[str, str]) -> dict[str, np.ndarray]:
    out = {}
    for name in tokenizers:
        if name == WORDS:
            out[name] = words_of(texts).counts
        elif name == BPE:
            out[name] = np.diff(bpe.encode(texts, paths, count_only=True)[1])
        elif name == BYTES:
            out[name] = np.diff(text_bytes(texts)[0])
        else:
            raise ValueError(f"unknown tokenizer version {name!r}")
    return out


class TokenLedger:
    """Signed entries under ``path``: one folder per commit, and the table ``commits`` of those that count."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: tuple[str, ...] = TOKENIZERS, paths: tuple[str, str] | None = None) -> None:
        self.spark, self.path, self.tokenizers = spark, path.rstrip("/"), tokenizers
        self.paths = paths or bpe.default_paths()
        #: Folder of every committed batch; a new driver goes on from what is published.
        self.folders: dict[int, str] = {}
        if path_exists(spark, f"{self.path}/commits"):
            for r in spark.read.parquet(f"{self.path}/commits").orderBy("attempt").collect():
                self.folders[r["batch"]] = r["folder"]

    @property
    def committed(self) -> set[int]:
        return set(self.folders)

    def entries(self, before: int | None = None) -> DataFrame:
        """Entries of the committed batches (of those before a batch)."""
        folders = [f for b, f in sorted(self.folders.items()) if before is None or b < before]
        if not folders:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*folders)

    def _counted(self, changes: DataFrame) -> DataFrame:
        """Slim rows ``doc, op, text_hash, source, lang, tokens, n``: ``n`` equal changes and their counts by tokenizer."""
        python_ready(self.spark)
        tokenizers, paths = self.tokenizers, self.paths
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        known = F.col("text_hash") if "text_hash" in changes.columns else F.lit(None).cast("long")
        rows = changes.select(
            F.coalesce(F.concat(F.lit("id:"), F.col("doc_id").cast("long").cast("string")), F.concat(F.lit("text:"), F.md5(text))).alias("doc"),
            F.col("op").alias("op"),
            F.when(F.col("op").isin("delete", "remove"), F.lit("")).otherwise(text).alias("text"),
            F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"),
            F.coalesce(known, F.xxhash64(text)).alias("text_hash"),
        )
        slim = ["doc", "op", "source", "lang", "text_hash"]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = _counts(b.column("text"), tokenizers, paths)
                tokens = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(tokenizers) * (b.num_rows + 1), len(tokenizers), dtype=np.int32)),
                    pa.array(np.stack([n[t] for t in tokenizers], axis=1).reshape(-1).astype(np.int64)),
                )
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in slim), tokens], names=[*slim, "tokens"])

        counted = rows.mapInArrow(count, "doc string, op string, source string, lang string, text_hash long, tokens array<long>")
        return counted.groupBy("doc", "op", "text_hash", "source", "lang").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Commit ``changes`` as batch number ``batch``.

        Batches are numbered 0, 1, 2, ...; the last one may be committed again and replaces itself."""
        if batch not in (len(self.folders), len(self.folders) - 1):
            raise ValueError(f"batch {batch} is neither the next nor the last one")
        new = staged(self._counted(changes), "token_changes")
        parts = [self._added(new)]
        if batch:
            parts.append(self._retracted(new, self.entries(before=batch)))
        folder = scratch_path(self.spark, "token_entries")
        reduce(DataFrame.unionByName, parts).write.parquet(folder)
        attempt = self.spark.read.parquet(f"{self.path}/commits").count() if self.folders else 0
        one = self.spark.createDataFrame([(batch, attempt, folder)], "batch int, attempt int, folder string")
        one.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.folders[batch] = folder

    def _added(self, new: DataFrame) -> DataFrame:
        """Entries of the rows that a batch brings."""
        revised = new.where("op = 'revise'").groupBy("doc").agg(F.max(F.struct("text_hash", "source", "lang", "tokens")).alias("c"))
        revised = revised.select("doc", "c.*", F.lit(1).cast("long").alias("n"))
        cols = ["doc", "text_hash", "source", "lang", "tokens", "n"]
        whole = new.where("op = 'insert'").select(*cols).unionByName(revised)
        kept = whole.join(new.where("op = 'delete'").select("doc").distinct(), "doc", "left_anti")
        names = F.array(*[F.lit(t) for t in self.tokenizers])
        rows = kept.unionByName(new.where("op = 'add'").select(*cols))
        rows = rows.withColumn("t", F.explode(F.arrays_zip(names.alias("tokenizer"), F.col("tokens").alias("tokens"))))
        return rows.select("doc", "text_hash", "source", "lang", "t.tokenizer", F.col("n").alias("documents"), (F.col("n") * F.col("t.tokens")).alias("tokens"))

    @staticmethod
    def _retracted(new: DataFrame, earlier: DataFrame) -> DataFrame:
        """The negation of what earlier entries say about the rows that a batch takes away."""
        whole = new.where("op IN ('insert', 'revise', 'delete')").select("doc").distinct()
        single = new.where("op = 'remove'").select("doc", "text_hash").distinct().join(whole, "doc", "left_anti")
        hit = earlier.join(whole, "doc", "left_semi").unionByName(earlier.join(single, ["doc", "text_hash"], "left_semi").select(*earlier.columns))
        return (
            hit.groupBy("doc", "text_hash", "source", "lang", "tokenizer")
            .agg((-F.sum("documents")).alias("documents"), (-F.sum("tokens")).alias("tokens"))
            .where("documents <> 0 OR tokens <> 0")
        )

    def rollup(self) -> DataFrame:
        """Totals by ``source, lang, tokenizer``, with the rows that came in and went."""
        return (
            self.entries()
            .groupBy("source", "lang", "tokenizer")
            .agg(
                F.sum("documents").alias("documents"),
                F.sum("tokens").alias("tokens"),
                F.sum(F.greatest("documents", F.lit(0))).alias("added"),
                F.sum(F.greatest(-F.col("documents"), F.lit(0))).alias("retracted"),
            )
        )


def change_feed(docs: DataFrame) -> list[DataFrame]:
    """A load and a correction made from a documents table.

    The load inserts every row, also of repeated and null ids.  The correction
    removes the rows whose text another row with a smaller id has as well, and
    replaces texts that end in white space by the text without it."""
    base = docs.select("doc_id", "text", "source", "lang")
    load = base.withColumn("op", F.lit("insert"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("_sha"), F.xxhash64(text).alias("text_hash"))
    first = slim.groupBy("_sha").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    gone = slim.join(first, "_sha").where("doc_id > _first").select("doc_id", "text_hash").distinct()
    none = [F.lit(None).cast("string").alias(c) for c in ("text", "source", "lang")]
    removed = gone.select("doc_id", *none, F.lit("remove").alias("op"), "text_hash")
    ends = base.where(F.col("text").rlike(r"[ \t\n\x0B\f\r]$")).withColumn("text_hash", F.xxhash64(text))
    key = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("text_hash") == F.col("_hash")]
    ends = ends.join(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), key, "left_anti")
    old = ends.withColumn("op", F.lit("remove"))
    new = ends.withColumns({"text": F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), "op": F.lit("add"), "text_hash": F.lit(None).cast("long")})
    return [load, removed.unionByName(old).unionByName(new)]
