r"""Phrase collocation mining with broadcast double-array tries.

Level by level, for phrases of one to four words: the Apriori-safe candidates
of a level go into double-array tries, which are broadcast.  Tasks hold the
word positions of a batch as numpy arrays, start one state at every position
and advance all of them together, one word (two digits of its code) at a time.
Accepting states are counted with ``bincount`` and the tasks' counts are summed.
In the same scan, two accepted states at neighbouring positions propose the
phrase that both overlap in; a proposal seen often enough is a candidate of the
next level.  Both its shorter parts are then candidates of this level, so no
frequent phrase can be missed, and nothing is joined that the texts do not hold.

Bounds: a trie holds about ``MAX_CANDIDATES`` phrases.  More candidates are
dealt over several tries by their hash.  A scan matches up to ``SCAN_TRIES`` of
them, and proposes from all pairs among these; only where a level has more
tries does it take several scans, one per pair of half-sized groups of them.
The driver holds one trie at a time while
it is built.  The candidates per trie do not depend on the size of the corpus.

Words are ``[^\x20\x09]+`` of the pieces between ``[.,;:!?\x0A-\x0D]``, with A-Z
lower-cased.  ``n`` counts all words of a language, ``f`` all occurrences of a
phrase inside pieces.  A candidate's score is that of its lowest-scoring cut,
floor(2000000 a / (l + r)); it is dropped if it lies inside a longer phrase
with at least 80 % of its count.  Arithmetic is in decimals, so it is exact.

Defined results: a null language is ``und``; null and empty texts have no
words; repeated rows count as often as they occur; an empty table gives no
rows; ties go by the stated order; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.llm.common import python_ready, staged
from nearfold.llm.words import _edges, slices, text_bytes
from nearfold.operators.indexing import dense_index

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
#: Percent of a phrase's count from which a longer phrase around it replaces it.
COVERED = 80
#: Phrases in one trie.
MAX_CANDIDATES = 1 << 19
#: Tries that a scan holds.
SCAN_TRIES = 4
#: Bits of a phrase's place in its trie; its number among all phrases of a level has the trie's number above them.
_PLACE_BITS = 20
_NUMBER_BITS = 31

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


@dataclass
class Tokens:
    codes: np.ndarray  # of each word: its place in ``vocabulary``
    owner: np.ndarray  # of each word: its text
    joined: np.ndarray  # the next word belongs to the same piece
    vocabulary: pa.Array


def tokens(texts: pa.Array) -> Tokens:
    offsets, data = text_bytes(texts)
    data = _FOLD[data]
    solid = ~_GAP[data]
    starts, ends = _edges(solid, offsets)
    encoded = slices(ends - starts, data[solid]).dictionary_encode()
    owner = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_BREAK[data], out=breaks[1:])
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (owner[1:] == owner[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
    return Tokens(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), owner, joined, encoded.dictionary)


class DoubleArray:
    """Phrases as paths of digits: state ``s`` goes by digit ``d`` to ``base[s] + d`` if ``check`` there is ``s``."""

    def __init__(self, langs: np.ndarray, codes: np.ndarray, n_langs: int, n_codes: int):
        """``langs`` (N) choose the root, ``codes`` (N, words) the path; rows are distinct."""
        self.width = codes.shape[1]
        self.radix = max(2, math.isqrt(max(n_codes - 1, 0)) + 1)
        self.n_langs = n_langs
        self._rng = np.random.default_rng(7)
        self.base = np.zeros(n_langs, np.int32)
        self.check = np.full(n_langs, -1, np.int32)
        digits = np.stack([codes // self.radix, codes % self.radix], axis=2).reshape(len(codes), 2 * self.width)
        order = np.lexsort([*digits.T[::-1], langs])
        state = langs[order].astype(np.int64)
        node = np.unique(langs[order], return_inverse=True)[1].astype(np.int64)
        for depth in range(digits.shape[1]):
            d = digits[order, depth]
            fresh = np.ones(len(d), bool)
            fresh[1:] = (node[1:] != node[:-1]) | (d[1:] != d[:-1])
            first = np.flatnonzero(fresh)
            slots = self._place(state[first], d[first])
            node = np.cumsum(fresh) - 1
            state = slots[node]
        self.base[state] = order  # paths are equally long, so a last state has no children: it holds its phrase

    def _grow(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def _place(self, parents: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """Slots of the children (``parents`` are sorted in runs): the bases of all parents are chosen here."""
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]])) if len(parents) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(parents)))
        low = self.n_langs  # slots below are the roots
        used = lambda slots: self.check[slots] >= 0
        base = np.zeros(len(first), np.int64)
        # Rows that fill an eighth of their span stand one after another.
        dense = np.flatnonzero(size > max(1, self.radix // 8))
        begin = max(low, len(self.base))
        base[dense] = begin + np.arange(len(dense)) * self.radix
        self._grow(begin + len(dense) * self.radix)
        self._take(parents, digits, first, size, base, dense)
        # The others of two or more children propose bases at random until nothing collides.
        left = np.flatnonzero((size > 1) & (size <= max(1, self.radix // 8)))
        left = left[np.argsort(-size[left], kind="stable")]
        if len(left):
            self._grow(len(self.base) + 2 * int(size[left].sum()) + 2 * self.radix)
        while len(left):
            trial = self._rng.integers(low, len(self.base) - self.radix + 1, len(left))
            row = np.repeat(np.arange(len(left)), size[left])
            child = _ranges(first[left], size[left])
            slots = trial[row] + digits[child]
            bad = np.zeros(len(left), bool)
            bad[row[used(slots)]] = True
            by = np.argsort(slots, kind="stable")
            bad[row[by[1:][slots[by[1:]] == slots[by[:-1]]]]] = True
            good = np.flatnonzero(~bad)
            base[left[good]] = trial[good]
            self._take(parents, digits, first, size, base, left[good])
            if len(good) * 4 < len(left):
                self._grow(len(self.base) + len(self.base) // 4 + self.radix)
            left = left[bad]
        # Single children fill the free slots in order.
        single = np.flatnonzero((size == 1) & (size <= max(1, self.radix // 8)))
        if len(single):
            free = np.flatnonzero(self.check[low + self.radix :] < 0) + low + self.radix
            if len(free) < len(single):
                end = max(len(self.base), low + self.radix)
                free = np.append(free, np.arange(end, end + len(single) - len(free)))
            free = free[: len(single)]
            self._grow(int(free[-1]) + self.radix + 1)
            base[single] = free - digits[first[single]]
            self._take(parents, digits, first, size, base, single)
        self._grow(int(base.max(initial=0)) + self.radix)
        return np.repeat(base, size) + digits

    def _take(self, parents, digits, first, size, base, rows) -> None:
        child = _ranges(first[rows], size[rows])
        self.check[np.repeat(base[rows], size[rows]) + digits[child]] = parents[child]
        self.base[parents[first[rows]]] = base[rows]

    def match(self, root: np.ndarray, code: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, phrases): where a phrase of the trie begins, and which.

        ``root`` and ``code`` are given for every word position, -1 where the trie has none."""
        at = np.flatnonzero((root >= 0) & (code >= 0))
        state = root[at]
        for k in range(self.width):
            if k:
                on = at + k < len(code)
                at, state = at[on], state[on]
                on = joined[at + k - 1] & (code[at + k] >= 0)
                at, state = at[on], state[on]
            for half in (0, 1):
                to = self.base[state].astype(np.int64) + np.divmod(code[at + k], self.radix)[half]
                on = self.check[to] == state
                at, state = at[on], to[on]
        return at, self.base[state].astype(np.int64)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of ``first[i] .. first[i] + size[i] - 1``."""
    if not len(size):
        return np.zeros(0, np.int64)
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


@dataclass
class Trie:
    """One shard of candidates, ready to be broadcast: phrase ``i`` of the shard is accepted as ``i``."""

    langs: list[str]
    words: pa.Array
    n: int
    array: DoubleArray

    @classmethod
    def build(cls, rows: pa.Table) -> Trie:
        """From ``idx, lang, phrase``; ``idx`` runs from 0."""
        rows = rows.take(pc.sort_indices(rows, [("idx", "ascending")]))
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        split = pc.split_pattern(rows.column("phrase").combine_chunks().cast(pa.large_string()), " ")
        words = split.values.cast(pa.large_binary()).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # Frequent candidates' words get small codes, so that rows of the trie are dense.
        order = np.argsort(-np.bincount(codes, minlength=len(words.dictionary)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        path = rank[codes].reshape(len(rows), -1)
        array = DoubleArray(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), path, len(langs.dictionary), len(order))
        return cls(langs.dictionary.to_pylist(), words.dictionary.take(pa.array(order)), len(rows), array)

    def match(self, t: Tokens, langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        code = _places(t.vocabulary, self.words)[t.codes]
        root = _places(langs, pa.array(self.langs, langs.type))[t.owner]
        return self.array.match(root, code, t.joined)


def _places(values: pa.Array, among: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


_COUNT, _PROPOSAL = 0, 1


def _rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"]
    )


def _scanner(tries: dict, fresh: set[int], group: dict[int, int], proposals: bool):
    """Counts of the phrases of the tries of ``fresh`` groups, and overlaps of a phrase with the next position's phrase.

    ``tries`` are the broadcast tries by their number.  Pairs within a group are counted where it is fresh, other pairs always."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {number: shared.value for number, shared in tries.items()}
        counted = {number: np.zeros(t.n, np.int64) for number, t in held.items() if group[number] in fresh}
        of = np.full(max(tries) + 1, -1)
        of[list(tries)] = [group[number] for number in tries]
        is_fresh = np.zeros(max(group.values()) + 1, bool)
        is_fresh[list(fresh)] = True
        for batch in batches:
            t = tokens(batch.column("text"))
            langs = batch.column("lang")
            here = np.full(len(t.codes) + 1, -1, np.int64)  # a position begins one phrase at most
            for number, one in held.items():
                at, phrase = one.match(t, langs)
                here[at] = (number << _PLACE_BITS) | phrase
                if number in counted:
                    counted[number] += np.bincount(phrase, minlength=one.n)
            if proposals:
                at = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0) & t.joined)
                left, right = here[at], here[at + 1]
                if len(held) > 1:
                    a, b = of[left >> _PLACE_BITS], of[right >> _PLACE_BITS]
                    new = (a != b) | is_fresh[a]
                    left, right = left[new], right[new]
                keys, n = np.unique((left << _NUMBER_BITS) | right, return_counts=True)
                if len(keys):
                    yield _rows(_PROPOSAL, keys, n)
        for number, total in counted.items():
            seen = np.flatnonzero(total)
            yield _rows(_COUNT, (number << _PLACE_BITS) | seen, total[seen])

    return scan


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = tokens(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        size = max(len(t.vocabulary), 1)
        keys, n = np.unique(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[t.owner] * size + t.codes, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(keys // size)), t.vocabulary.take(pa.array(keys % size)).cast(pa.large_string()).cast(pa.string()), pa.array(n.astype(np.int64))],
            names=["lang", "word", "n"],
        )


def _dealt(phrases: DataFrame, max_candidates: int, name: str) -> tuple[DataFrame, int]:
    """``lang, phrase`` with a trie number ``shard`` and a place ``idx`` in it; the number of tries (0: no phrase)."""
    total = phrases.count()
    if not total:
        return phrases, 0
    # Hashes deal unevenly: some room stays free where several tries are needed.
    room = max(max_candidates / 2, max_candidates - 6 * math.sqrt(max_candidates))
    n = 1 if total <= max_candidates else math.ceil(total / room)
    if n >= 1 << (_NUMBER_BITS - _PLACE_BITS) or max_candidates > 1 << (_PLACE_BITS - 1):
        raise ValueError(f"{total} candidates in tries of {max_candidates}")
    shard = F.pmod(F.xxhash64("lang", "phrase"), F.lit(n)).cast("int")
    return staged(dense_index(phrases.withColumn("shard", shard), ["lang", "phrase"], "idx", ["shard"]), name), n


def _groups(n: int, alone: bool) -> list[list[list[int]]]:
    """The scans of ``n`` tries: each a list of groups of tries, so that all pairs of tries meet (``alone``: each trie once)."""
    if n <= SCAN_TRIES or alone:
        return [[list(range(a, min(n, a + SCAN_TRIES)))] for a in range(0, n, SCAN_TRIES)]
    half = max(1, SCAN_TRIES // 2)
    groups = [list(range(a, min(n, a + half))) for a in range(0, n, half)]
    return [[groups[i], groups[j]] for i in range(len(groups)) for j in range(i + 1, len(groups))]


def _level(docs: DataFrame, candidates: DataFrame, n: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Counts ``lang, phrase, f`` of one level's candidates, and the phrases proposed for the next level."""
    sc = docs.sparkSession.sparkContext

    def trie(shard: int):
        return sc.broadcast(Trie.build(candidates.where(F.col("shard") == shard).select("idx", "lang", "phrase").toArrow()))

    found, held, done = [], {}, set()
    for scan in _groups(n, last):
        wanted = [x for g in scan for x in g]
        for x in set(held) - set(wanted):
            held.pop(x).destroy()
        for x in wanted:
            if x not in held:
                held[x] = trie(x)
        group = {x: g[0] for g in scan for x in g}
        fresh = set(group.values()) - done
        done |= fresh
        sums = docs.mapInArrow(_scanner(dict(held), fresh, group, not last), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
        found.append(staged(sums.where(F.col("n") >= MIN_COUNT), "collocation_scan"))
    for x in held.values():
        x.destroy()
    sums = found[0]
    for x in found[1:]:
        sums = sums.unionByName(x)
    number = F.shiftleft(F.col("shard").cast("long"), _PLACE_BITS).bitwiseOR(F.col("idx").cast("long"))
    here = candidates.select(number.alias("i"), "lang", "phrase")
    counted = sums.where(F.col("kind") == _COUNT).select(F.col("key").alias("i"), F.col("n").alias("f"))
    counts = counted.join(here, "i").select("lang", "phrase", "f")
    if last:
        return counts, None
    there = here.select(F.col("i").alias("j"), F.element_at(F.split("phrase", " "), -1).alias("next"))
    split = sums.where(F.col("kind") == _PROPOSAL).select(
        F.shiftright("key", _NUMBER_BITS).alias("i"), F.col("key").bitwiseAND(F.lit((1 << _NUMBER_BITS) - 1)).alias("j"))
    more = split.join(here, "i").join(there, "j").select("lang", F.concat_ws(" ", "phrase", "next").alias("phrase"))
    return counts, staged(more, "collocation_candidates")


def phrase_counts(docs: DataFrame, max_candidates: int = MAX_CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, f, width`` of all phrases of 1 to 4 words found 30 times or more, ``lang, n``)."""
    spark = docs.sparkSession
    python_ready(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = staged(texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "collocation_words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    proposed = words.where(F.col("n") >= MIN_COUNT).select("lang", F.col("word").alias("phrase"))
    levels = []
    for width in range(1, MAX_WORDS + 1):
        candidates, n = _dealt(proposed, max_candidates, "collocation_dealt")
        if not n:
            break
        counts, proposed = _level(texts, candidates, n, width == MAX_WORDS)
        levels.append(staged(counts.withColumn("width", F.lit(width)), "collocation_counts"))
    if not levels:
        return spark.createDataFrame([], "lang string, phrase string, f long, width int"), totals
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out, totals


def _part(first, size):
    return F.concat_ws(" ", F.slice("w", first, size))


def collocations(docs: DataFrame, top: int = TOP, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best-scoring phrases of each language."""
    counts, totals = phrase_counts(docs, max_candidates)
    phrases = counts.where(F.col("width") > 1).withColumn("w", F.split("phrase", " "))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    # Every cut of every candidate, with the counts of both sides.
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "w", "width", F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("width") - F.col("k")).alias("rest")
    )
    side = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("m")).select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")
    # The largest count among longer phrases around each shorter one.
    spans = F.expr(
        "flatten(transform(sequence(2, width - 1), s -> transform(sequence(1, width - s + 1), i -> concat_ws(' ', slice(w, i, s)))))"
    )
    around = (
        phrases.where(F.col("width") > 2)
        .select("lang", F.explode(spans).alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    kept = lowest.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100).cast("decimal(10,0)") * exact("longer") < F.lit(COVERED).cast("decimal(10,0)") * exact("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
