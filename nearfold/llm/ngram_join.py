"""N-gram Jaccard join with Bayesian candidate pruning.

1.  Every text becomes its set of five-word shingles (64-bit hashes of the
    whole text) and a MinHash signature.  Texts with equal sets form a class;
    copies are counted there and never paired.
2.  Signatures are cut into bands; classes that share a band are candidates.
    Each bucket is first compared with its smallest class only (a hub, so a
    bucket of m gives m - 1 pairs), and the verified links give components.
    Buckets that still hold several components are then compared across
    these.  Inside every final component all pairs are compared.  So each
    candidate pair is looked at, but pairs of a large bucket or component are
    compared in blocks inside tasks; they are never rows of a table.
3.  A comparison takes MinHash values in steps.  After each step the pair's
    posterior probability of reaching the threshold follows from the matches
    so far (uniform prior); pairs below ``TOLERANCE`` are dropped.  The rest
    are verified exactly on their shingle sets.

Bands miss a pair at the threshold itself with probability 6e-5, less above
it.  Classes are named by 64 bits of their set's 128-bit hash.

Defined results: a text of one to four words is one shingle; a text without
words (null, empty, white space) is in no group and has no links; repeated
rows are copies; a null ``doc_id`` counts as the largest id; an empty table
gives no rows; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import python_ready, row_id, staged
from nearfold.llm.graph import components
from nearfold.llm.words import words_of

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
#: MinHash values compared per step, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
#: Buckets and components up to this size are compared pair by pair, larger ones by blocks of BLOCK.
SMALL, BLOCK = 16, 512
#: Shingles of a block, on average: long texts get blocks of fewer classes, so that a task's two blocks fit its memory.
BLOCK_SHINGLES = 1 << 21
SEED = 20240229

_rng = np.random.default_rng(SEED)
_MULTIPLY = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = words_of(texts)
    name = np.fromiter((xxhash.xxh3_64_intdigest(w, SEED) for w in words.vocabulary.to_pylist()), np.uint64, len(words.vocabulary))
    word = name[words.codes]
    n = len(word)
    window = word.copy()
    for k in range(1, WIDTH):
        window = window[: n - k] * _ODD + word[k:] if n >= k else window
    window = _mix(window)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(window[a : b - WIDTH + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for w in word[a:b]:
                short = short * _ODD + w
            out.append(_mix(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Low 16 bits of each MinHash value; sets must not be empty."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 1 << 16):
            size += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[i : j - 1])])
        for k in range(HASHES):
            out[i:j, k] = np.minimum.reduceat((x ^ _FLIP[k]) * _MULTIPLY[k], starts).astype(np.uint16)
        i = j
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = shingles_of(batch.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            signed: list[bytes | None] = [None] * len(sets)
            names: list[list[int | None]] = [[None] * len(sets), [None] * len(sets)]
            for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                signed[i] = row.tobytes()
                names[0][i] = int(_mix(sets[i]).sum(dtype=np.uint64).view(np.int64))
                names[1][i] = int(_mix(sets[i] ^ _ODD).sum(dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "_id", "_th")),
                    pa.array(names[0], pa.int64()),
                    pa.array(names[1], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(signed, pa.binary()),
                ],
                names=["doc_id", "_id", "_th", "cls", "check", "n_shingles", "sig"],
            )


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            sig = _matrix(batch.column("sig")).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2]).copy()
            for r in range(ROWS):
                key = _mix(key * _ODD + sig[:, :, r])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("cls").to_numpy(), BANDS))], names=["key", "cls"]
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Values compared -> matches below which a pair is dropped.

    With a uniform prior the posterior after m matches of n is Beta(m + 1,
    n - m + 1), and its mass above t equals P(Binomial(n + 1, t) <= m)."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of signature rows survive all steps."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in fewest_matches().items():
        part = slice(n - STEP, n)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    keep = np.zeros(len(a), bool)
    keep[alive] = True
    return keep


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keep = plausible(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")))
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``key``, over the borders of batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(c).to_numpy() for c in key]
        change = np.zeros(n, bool)
        for c, name in zip(cols, key, strict=True):
            change[1:] |= c[1:] != c[:-1]
            change[0] |= bool(held) and held[-1].column(name)[-1].as_py() != c[0]
        cuts = [*np.flatnonzero(change).tolist(), n]
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held and cut < n:
                yield pa.Table.from_batches(held)
                held = []
            at = cut
    if held:
        yield pa.Table.from_batches(held)


_TASK = ("grp", "lo", "hi")


def _block_pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that a block task is to compare (as a mask's row and column)."""
    side = group.column("block").to_numpy()
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    if lo == hi:
        return np.arange(len(side)), np.arange(len(side))
    return np.flatnonzero(side == lo), np.flatnonzero(side == hi)


def _plausible_block(left: np.ndarray, right: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of ``mask``'s pairs between two blocks of signatures survive all steps."""
    i, j = np.nonzero(mask)
    out = np.zeros_like(mask)
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        keep = plausible(left[a], right[b])
        out[a[keep], b[keep]] = True
    return out


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links between components that meet in two blocks of a bucket.

    Only links that join components not yet joined by the task's own links
    are given out, so a task has fewer results than rows; links are counted
    within the final components later."""
    for group in _groups(batches, _TASK):
        a, b = _block_pairs(group)
        cls, comp = group.column("cls").to_numpy(), group.column("comp").to_numpy()
        mask = comp[a][:, None] != comp[b][None, :]
        i, j = np.nonzero(_linked(group, a, b, mask))
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = top.get(up, up)
                x = up
            return x

        # One link for each pair of components.
        _, code = np.unique(comp, return_inverse=True)
        _, one = np.unique(code[a[i]] * len(comp) + code[b[j]], return_index=True)
        out: list[tuple[int, int]] = []
        for x, y in zip(a[i[one]].tolist(), b[j[one]].tolist(), strict=True):
            p, q = find(int(comp[x])), find(int(comp[y]))
            if p != q:
                top[max(p, q)] = min(p, q)
                out.append((int(cls[x]), int(cls[y])))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _linked(group: pa.Table, a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of ``mask``'s pairs between rows ``a`` and ``b`` survive all steps and reach the threshold."""
    sig = _matrix(group.column("sig").combine_chunks())
    mask = _plausible_block(sig[a], sig[b], mask)
    if not mask.any():
        return mask
    lists = group.column("shingles").combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    sets = [values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
    inter = _common([sets[i] for i in a], [sets[i] for i in b])
    size = np.array([len(s) for s in sets], float)
    return mask & (inter / (size[a][:, None] + size[b][None, :] - inter) >= THRESHOLD)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of 0/1 matrices."""
    both = [*left, *right]
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    values, code, uses = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right)), np.float64)
    shared = uses[code] > 1
    owner, code = owner[shared], code[shared]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    code = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if len(code) else code
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [first, first + 4096])
        grid = np.zeros((len(both), 4096), np.float32)
        grid[owner[a:b], code[a:b] - first] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class of a block task: how many documents of the other block it is linked to."""
    for group in _groups(batches, _TASK):
        a, b = _block_pairs(group)
        cls, copies = group.column("cls").to_numpy(), group.column("copies").to_numpy()
        one = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        mask = np.ones((len(a), len(b)), bool)
        if one:
            mask[np.diag_indices(len(a))] = False
        link = _linked(group, a, b, mask)
        rows, counts = [cls[a]], [link @ copies[b]]
        if not one:
            rows.append(cls[b])
            counts.append(link.T @ copies[a])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(counts).astype(np.int64))], names=["cls", "links"])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = shingles_of(batch.column("text"))
            ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["cls", "shingles"])


def _n_blocks(classes: Column, shingles: Column) -> Column:
    """Number of blocks for so many classes with so many shingles together."""
    return F.greatest(F.ceil(classes / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _in_blocks(df: DataFrame, task: Callable, schema: str) -> DataFrame:
    """Runs ``task`` on every pair of blocks.

    ``df``: ``grp, block, partners`` (first and last block to meet) and what the task needs."""
    met = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("partners"))))
    met = met.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_other", "partners")
    return met.repartition(*_TASK).sortWithinPartitions(*_TASK).mapInArrow(task, schema)


def _pruned(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (``a, b``) that survive the comparison of their signatures."""
    sig = classes.select("cls", "sig")
    return (
        pairs.join(sig.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sig.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b")), "b")
        .mapInArrow(_prune, "a long, b long")
    )


def _verified(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """The pairs whose shingle sets reach the threshold."""
    side = lambda c: store.select(F.col("cls").alias(c), F.col("shingles").alias(f"_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(common / (F.size("_a") + F.size("_b") - common) >= THRESHOLD).select("a", "b")


def _pairs_of(small: DataFrame, group: str, differ: str | None = None) -> DataFrame:
    """Distinct pairs a < b within the groups of a table of small groups."""
    extra = [differ] if differ else []
    left = small.select(group, F.col("cls").alias("a"), *[F.col(c).alias(f"{c}_a") for c in extra])
    right = small.select(group, F.col("cls").alias("b"), *[F.col(c).alias(f"{c}_b") for c in extra])
    pairs = left.join(right, group).where("a < b")
    if differ:
        pairs = pairs.where(F.col(f"{differ}_a") != F.col(f"{differ}_b"))
    return pairs.select("a", "b").distinct()


def ngram_join(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, class_id`` (smallest id of its group), ``n_links, copies, n_shingles``.

    ``n_links``: other documents at a similarity of ``THRESHOLD`` or more,
    copies included.  Also ``_id, _th`` and ``is_first`` (its group's first row)."""
    python_ready(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *row_id())
    signed = staged(
        rows.mapInArrow(_sign, "doc_id long, _id long, _th long, cls long, check long, n_shingles long, sig binary"), "signatures"
    )
    classes = staged(
        signed.where("cls IS NOT NULL")
        .groupBy("cls", "check")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("_id", "_th")).alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")),
        "shingle_classes",
    )
    bands = classes.select("cls", "sig").mapInArrow(_band_keys, "key long, cls long")
    several = bands.groupBy("key").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = staged(bands.join(several, "key"), "band_buckets")

    # The shingle sets of all classes that share a bucket.
    wanted = buckets.select("cls").distinct().join(classes.select("cls", "rep"), "cls")
    wanted = wanted.select("cls", F.col("rep._id").alias("_id"), F.col("rep._th").alias("_th"))
    firsts = rows.select("text", "_id", "_th").join(wanted, ["_id", "_th"])
    store = staged(firsts.select("cls", "text").mapInArrow(_store, "cls long, shingles array<long>").dropDuplicates(["cls"]), "shingle_sets")

    # Hub pairs, and the components they give.
    hubs = buckets.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    links = staged(_verified(_pruned(hubs, classes), store), "hub_links")
    comps = components(links)

    # Buckets that still hold several components.
    member = buckets.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select(
        "key", "cls", "n", F.coalesce("label", "cls").alias("comp")
    )
    mixed = member.groupBy("key").agg(F.min("comp").alias("_min"), F.max("comp").alias("_max")).where("_min <> _max").select("key")
    member = staged(member.join(mixed, "key"), "mixed_buckets")
    cross = _pruned(_pairs_of(member.where(F.col("n") <= SMALL), "key", "comp"), classes)
    lengths = classes.select("cls", "n_shingles")
    large = member.where(F.col("n") > SMALL).join(lengths, "cls")
    # The most frequent component of a large bucket need not be compared with itself.
    per = large.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_c"), F.sum("n_shingles").alias("_s"))
    per = per.groupBy("key").agg(F.max(F.struct("_c", "comp", "_s")).alias("_top"), F.sum("_c").alias("_c"), F.sum("_s").alias("_s"))
    few = _n_blocks(F.col("_c") - F.col("_top._c"), F.col("_s") - F.col("_top._s"))
    per = per.select("key", F.col("_top.comp").alias("_major"), few.alias("_few"), _n_blocks(F.col("_top._c"), F.col("_top._s")).alias("_many"))
    large = large.join(per, "key").withColumn("_is_major", F.col("comp") == F.col("_major"))
    block = F.when(F.col("_is_major"), F.col("_few") + F.pmod(F.xxhash64("cls"), F.col("_many")).cast("int")).otherwise(
        F.pmod(F.xxhash64("cls"), F.col("_few")).cast("int")
    )
    last = F.when(F.col("_is_major"), F.col("_few") - 1).otherwise(F.col("_few") + F.col("_many") - 1)
    large = large.select(F.col("key").alias("grp"), "cls", "comp", block.alias("block"), last.alias("partners"))
    large = large.join(classes.select("cls", "sig"), "cls").join(store, "cls")
    more = staged(_verified(cross, store).union(_in_blocks(large, _across, "a long, b long")), "cross_links")
    comps = components(links.union(more))

    # All pairs within the final components.
    sized = comps.withColumnRenamed("node", "cls").join(lengths, "cls")
    sized = sized.join(sized.groupBy("label").agg(F.count(F.lit(1)).alias("_m"), F.sum("n_shingles").alias("_s")), "label").select("cls", "label", "_m", "_s")
    sized = staged(sized, "components")
    pairs = _verified(_pruned(_pairs_of(sized.where(F.col("_m") <= SMALL), "label"), classes), store)
    both = pairs.union(pairs.select("b", "a")).toDF("cls", "_with")
    counted = both.join(classes.select(F.col("cls").alias("_with"), "copies"), "_with").select("cls", F.col("copies").alias("links"))
    blocks = _n_blocks(F.col("_m"), F.col("_s"))
    big = (
        sized.where(F.col("_m") > SMALL)
        .select(F.col("label").alias("grp"), "cls", F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"), (blocks - 1).alias("partners"))
        .join(classes.select("cls", "sig", "copies"), "cls")
        .join(store, "cls")
    )
    counted = counted.union(_in_blocks(big, _within, "cls long, links long"))
    links_of = counted.groupBy("cls").agg(F.sum("links").alias("links"))

    grouped = classes.select("cls", "copies", "rep").join(sized.select("cls", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    first = grouped.groupBy("label").agg(F.min("rep").alias("first"))
    per_class = grouped.join(first, "label").join(links_of, "cls", "left").select(
        "cls", "copies", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    own = F.struct("_id", "_th")
    lead = F.coalesce(F.col("first"), own)
    return signed.join(per_class, "cls", "left").select(
        "doc_id",
        F.nullif(lead["_id"], F.lit((1 << 63) - 1)).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        "n_shingles",
        (lead == own).alias("is_first"),
        "_id",
        "_th",
    )
