"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores one bit per
failed rule together with the measurements behind it.  A *policy* is a
version and the set of rules that reject; applying one is a bitwise AND, so
policies can be compared without reading a text again.  Ablations count, per
policy and rule, the documents that the rule alone rejects, from a histogram
of the bit patterns (at most one row per pattern that occurs).

Defined results: a null or empty text has no words and fails ``too_short``;
repeated rows give repeated ledger rows; an empty table gives an empty
ledger; texts of any length are measured whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import python_ready, row_id, staged
from nearfold.llm.words import _IS_SPACE, doc_sums, line_repeats, repeated_window_words, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words")

#: Rules in bit order; a rule is true when the document fails it.  Integer arithmetic only.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("shouting", "100 * n_upper_words > 50 * n_words"),
)
#: Policy versions: the rules that reject under each.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_short", "repeated_windows"),
    "v1": ("too_short", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(name for name, _ in RULES),
}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << [name for name, _ in RULES].index(rule)


def mask(policy: str) -> int:
    return reduce(int.__or__, (bit(r) for r in POLICIES[policy]), 0)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = words_of(batch.column("text"))
        upper = np.fromiter((w.isupper() for w in words.vocabulary.cast(pa.large_string()).to_pylist()), bool, len(words.vocabulary))
        solid = ~_IS_SPACE[words.data]
        n_lines, n_dup = line_repeats(words)
        n = len(batch)
        values = {
            "n_words": words.counts,
            "word_chars": doc_sums(solid & ((words.data & 0xC0) != 0x80), words.offsets),
            "n_symbols": doc_sums(_IS_SYMBOL[words.data], words.offsets),
            "n_lines": n_lines,
            "n_dup_lines": n_dup,
            "n_repeat_words": repeated_window_words(words),
            "n_upper_words": np.bincount(words.owner[upper[words.codes]] if len(words.codes) else [], minlength=n),
        }
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_id"), batch.column("_th"), *(pa.array(np.asarray(values[m], np.int64)) for m in MEASURES)],
            names=["doc_id", "_id", "_th", *MEASURES],
        )


def failure_bits() -> Column:
    return reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)],
    )


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``failed_bits`` (and ``_id, _th``): one row per document."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *row_id())
    schema = "doc_id long, _id long, _th long, " + ", ".join(f"{m} long" for m in MEASURES)
    return rows.mapInArrow(_measure, schema).withColumn("failed_bits", failure_bits())


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger written to the shared folder and read back: policies and ablations then read no text again."""
    return staged(ledger(docs), "quality_ledger")


def passes(policy: str = CURRENT) -> Column:
    """True where the ledger row passes the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    return led.withColumn("base_failed", ~passes("base")).withColumn("kept", passes("base") & passes(policy))


def ablations(led: DataFrame) -> DataFrame:
    """Per policy and rule: documents that fail it, that it alone rejects, and kept without it."""
    patterns = led.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("_n"))
    cells = F.array(
        *[
            F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).cast("long").alias("mask"), F.lit(bit(r)).cast("long").alias("bit"))
            for p, rules in POLICIES.items()
            for r in rules
        ]
    )
    hit = F.col("failed_bits").bitwiseAND(F.col("c.mask"))
    count = lambda cond: F.sum(F.when(cond, F.col("_n")).otherwise(F.lit(0))).alias
    return (
        patterns.withColumn("c", F.explode(cells))
        .groupBy("c.policy", "c.rule")
        .agg(
            count(hit.bitwiseAND(F.col("c.bit")) != 0)("n_failed"),
            count(hit == F.col("c.bit"))("n_only_this"),
            count(hit.bitwiseAND(F.bitwise_not(F.col("c.bit"))) == 0)("n_kept_without"),
            count(hit == 0)("n_kept"),
            F.bit_or("failed_bits").alias("all_bits"),
        )
    )
