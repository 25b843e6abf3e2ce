"""Batch embedding stage.

Two paths produce ``embedding array<float>`` for a text column:

* ``hashed_embedding`` (default): a deterministic signed hashed bag of words
  written with SQL functions, so it runs JVM-side with no Python worker.
  token -> md5 -> bucket (first 8 hex digits mod d) and sign (parity of the
  9th hex digit); the bucket sums are L2-normalised (all-zero when the text
  has no token).
* ``embed_batches``: a pluggable encoder ``Callable[[list[str]], ndarray]``
  (e.g. a sentence model) applied with ``mapInPandas`` to Arrow batches of at
  most ``batch_size`` rows; ``numpy_hashed_encoder`` reproduces the default in
  NumPy so both paths can be checked against each other.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.session import ship_package, spread

# Token pattern (runs of letters/digits), default dimension and
# the reference's encoder batch size.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}]+"
DIM = 64
BATCH_SIZE = 256


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed_embedding(text, dim: int = DIM) -> Column:
    """Signed hashed bag of words, L2-normalised, as a Column (JVM-side).

    md5 runs once per token, which becomes one number for bucket and sign; a
    bucket's sum is the difference of two counts over these numbers, and the
    norm is computed once per text.  Lambdas are not subject to common
    subexpression elimination, so what a body names more than once is bound
    to a variable."""
    text = F.col(text) if isinstance(text, str) else text
    digits = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.conv(F.substring(F.md5(t), 1, 9), 16, 10).cast("long"))
    # bucket from the first eight digits; negative where the ninth is odd
    codes = F.transform(digits, lambda x: (F.pmod(F.shiftright(x, 4), F.lit(dim)) + F.lit(dim) * x.bitwiseAND(F.lit(1))).cast("int"))

    def sums(c):
        without = lambda code: F.size(F.array_remove(c, code))
        return F.array(*[(without(b + dim) - without(b)).cast("double") for b in range(dim)])

    def normalised(v):
        n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y))
        return _bound(n, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float")))

    return F.when(text.isNotNull(), _bound(_bound(codes, sums), normalised))


def numpy_hashed_encoder(dim: int = DIM) -> Callable[[list[str]], np.ndarray]:
    """The default encoder in NumPy (same tokens, buckets, signs)."""
    import regex

    pat = regex.compile(TOKEN_SPLIT)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        # every distinct token of the batch is hashed once
        known: dict[str, int] = {}
        rows, codes = [], []
        for i, t in enumerate(texts):
            tokens = [known.setdefault(tok, len(known)) for tok in pat.split(t or "") if tok]
            rows += [i] * len(tokens)
            codes += tokens
        digests = [hashlib.md5(tok.encode("utf-8")).hexdigest() for tok in known]
        bucket = np.array([int(h[:8], 16) % dim for h in digests], np.int64)
        sign = np.array([1.0 if int(h[8], 16) % 2 == 0 else -1.0 for h in digests])
        if codes:
            np.add.at(out, (rows, bucket[codes]), sign[codes])
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.where(n > 0, out / np.where(n > 0, n, 1.0), 0.0).astype(np.float32)

    return encode


def embed_batches(df: DataFrame, text_col: str, encoder: Callable[[list[str]], np.ndarray], dim: int,
                  keep_cols: tuple[str, ...] = ("id",), batch_size: int = BATCH_SIZE,
                  with_timing: bool = False) -> DataFrame:
    """Apply ``encoder`` to Arrow batches of <= ``batch_size`` texts.

    With ``with_timing`` each output row also carries the seconds its batch
    took and the batch size, so rates can be aggregated (E14)."""
    fields = [f for f in df.schema.fields if f.name in keep_cols]
    out_fields = fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    if with_timing:
        out_fields += [T.StructField("batch_id", T.StringType()), T.StructField("batch_rows", T.LongType()),
                       T.StructField("batch_seconds", T.DoubleType())]
    schema = T.StructType(out_fields)
    cols = [f.name for f in fields]

    def run(it):
        for pdf in it:
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s : s + batch_size]
                t0 = time.perf_counter()
                vecs = encoder(part[text_col].tolist())
                dt = time.perf_counter() - t0
                out = part[cols].copy()
                out["embedding"] = list(np.asarray(vecs, dtype=np.float32))
                if with_timing:
                    out["batch_id"] = uuid.uuid4().hex
                    out["batch_rows"] = len(part)
                    out["batch_seconds"] = dt
                yield out

    ship_package(df.sparkSession)
    return spread(df.select(*cols, text_col)).mapInPandas(run, schema)


def embed_and_measure(df: DataFrame, text_col: str, encoder: Callable[[list[str]], np.ndarray], dim: int, path: str,
                      keep_cols: tuple[str, ...] = ("id",), batch_size: int = BATCH_SIZE) -> dict:
    """Write the embeddings of ``df`` to ``path``; the write itself measures rows, batches and encoder seconds.

    The figures are observed metrics of the one job that writes, so nothing is
    read or encoded a second time."""
    timed = embed_batches(df, text_col, encoder, dim, keep_cols, batch_size, with_timing=True)
    seen = Observation()
    timed = timed.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(1.0 / F.col("batch_rows")), F.lit(0.0)).alias("batches"),
        F.coalesce(F.sum(F.col("batch_seconds") / F.col("batch_rows")), F.lit(0.0)).alias("encoder_seconds"),
    )
    timed.drop("batch_id", "batch_rows", "batch_seconds").write.parquet(path)
    got = seen.get
    seconds = got["encoder_seconds"]
    return {"rows": got["rows"], "batches": round(got["batches"]), "encoder_seconds": seconds, "rows_per_sec": got["rows"] / seconds if seconds else 0.0}


def embedding_checksum(vec: str = "embedding") -> list[Column]:
    """Scalar summary of a vector for exact comparisons: dims, norm, weighted sum, non-zeros."""
    from nearfold.functions import vectors as V

    return [
        F.size(vec).cast("long").alias("dims"),
        V.norm(vec).alias("norm"),
        F.aggregate(F.transform(vec, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b).alias(
            "checksum"
        ),
        F.size(F.filter(vec, lambda x: x != 0)).cast("long").alias("n_nonzero"),
    ]
