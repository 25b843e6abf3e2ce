r"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is a row of words (maximal runs of ASCII letters, digits and bytes from
0x80 on; A-Z lower-cased) cut into overlapping windows that cover all of it.
A word enters the network through its characters and as a whole:

* characters: the mean of learned vectors of its byte trigrams, and the largest
  and mean *evidence* of its byte n-grams with word borders,
* word: a learned vector by its hash, and the evidence of the whole word.

Evidence is the shrunken log ratio of the shares of toxic and of clean sample
texts that hold the feature.  In training, a text's own half of the sample never
contributes to its evidence, so the network learns how far unseen evidence can
be trusted.  Two gated recurrent layers run over a window in both directions,
attention pools their states, one unit gives the window's logit.  A text's score
is the calibrated largest logit of its windows.

Training runs in one task on a bounded sample of labelled rows: at most
``MAX_TEXTS`` texts of either label in the order of a hash, none above
``MAX_TRAIN_CHARS`` and ``MAX_LABEL_CHARS`` together.  Rows with
``crc32(doc_id) mod 4 = 2`` are held out.  Scoring is a map over all rows:
every whole text, in Arrow batches of bounded size.

Defined results: null and empty texts have no words and get the score of an
empty window; a null id is hashed as the empty string and has no label; a
document with several labels is toxic if one of them is; repeated rows get equal
scores; without both labels in the sample every score is the smoothed share of
toxic labels (0.5 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import python_ready
from nearfold.llm.words import _edges, slices, text_bytes

#: Labelled texts of either label that are trained on.
MAX_TEXTS = 2500
#: Longer texts are not trained on (they are scored whole), nor the longest ones beyond so many code points of a label.
MAX_TRAIN_CHARS, MAX_LABEL_CHARS = 50_000, 16_000_000
THRESHOLD = 0.3
WINDOW, STRIDE = 64, 48
HIDDEN, ATTENTION = 8, 8
CHAR_DIM, WORD_DIM = 6, 4
GRAMS = (3, 5, 8)
GRAM_BITS, WORD_BITS, CHAR_ROWS, WORD_ROWS = 20, 18, 1024, 2048
#: Texts that a feature needs before half of its log ratio counts.
SHRINK = 8.0
EPOCHS, BATCH, RATE = 8, 128, 0.01

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[97:123] = _SOLID[128:] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.random.default_rng(11).integers(1, 1 << 63, (64, 256), np.uint64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes of all words, first word of each text and one beyond, distinct words)."""
    offsets, data = text_bytes(texts)
    data = _FOLD[data]
    solid = _SOLID[data]
    starts, ends = _edges(solid, offsets)
    encoded = slices(ends - starts, data[solid]).dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offsets), encoded.dictionary


class Features:
    """Hashed features of distinct words: n-gram and word buckets."""

    def __init__(self, words: pa.Array):
        offsets, raw = text_bytes(words.cast(pa.large_binary()).view(pa.large_string()))
        size = np.diff(offsets) + 2
        self.first = np.concatenate([[0], np.cumsum(size)])
        data = np.zeros(self.first[-1], np.uint8)
        inner = np.ones(len(data), bool)
        inner[self.first[:-1]] = inner[self.first[1:] - 1] = False
        data[inner] = raw
        data[self.first[:-1]], data[self.first[1:] - 1] = 0x5E, 0x24
        room = np.repeat(self.first[1:], size) - np.arange(len(data))  # bytes to the word's end
        wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.n = len(size)
        self.owner = np.repeat(np.arange(self.n), size)
        self.grams = []  # (positions, buckets) for each length
        value = np.zeros(len(data), np.uint64)
        for k in range(max(GRAMS)):
            value = value | (wide[k : k + len(data)] << np.uint64(8 * k))
            if k + 1 in GRAMS:
                at = np.flatnonzero(room > k)
                self.grams.append((at, ((value[at] + np.uint64(k)) * _MIX >> np.uint64(64 - GRAM_BITS)).astype(np.int64)))
        place = (np.arange(len(data)) - np.repeat(self.first[:-1], size)) % 64
        sums = np.add.reduceat(_PLACES[place, data], self.first[:-1]) if self.n else np.zeros(0, np.uint64)
        mixed = sums * _MIX
        self.word = (mixed >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        self.word_row = (mixed >> np.uint64(20)).astype(np.int64) % WORD_ROWS
        at, bucket = self.grams[0]
        self.tri_owner, self.tri_row = self.owner[at], bucket % CHAR_ROWS
        self.tri_first = np.searchsorted(self.tri_owner, np.arange(self.n + 1))

    def evidence(self, gram: np.ndarray, word: np.ndarray) -> np.ndarray:
        """(n, 3): largest and mean evidence of the n-grams, evidence of the word."""
        out = np.zeros((self.n, 3), np.float32)
        if not self.n:
            return out
        best = np.zeros(self.first[-1], np.float32)
        total, count = np.zeros(self.n), np.zeros(self.n)
        for at, bucket in self.grams:
            e = gram[bucket]
            best[at] = np.maximum(best[at], e)
            total += np.bincount(self.owner[at], weights=e, minlength=self.n)
            count += np.bincount(self.owner[at], minlength=self.n)
        out[:, 0] = np.maximum.reduceat(best, self.first[:-1])
        out[:, 1] = total / np.maximum(count, 1)
        out[:, 2] = word[self.word]
        return out

    def chars(self, table: np.ndarray) -> np.ndarray:
        """Mean vector of each word's trigrams (a word and its borders have one at least)."""
        return np.add.reduceat(table[self.tri_row], self.tri_first[:-1], axis=0) / np.diff(self.tri_first)[:, None] if self.n else np.zeros((0, CHAR_DIM), np.float32)


def _log_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    seen = toxic + clean
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.clip(ratio * seen / (seen + SHRINK), -4, 4).astype(np.float32)


class Evidence:
    """Number of toxic and of clean texts that hold each feature, apart for the two halves of the sample."""

    def __init__(self, f: Features, codes: np.ndarray, first: np.ndarray, label: np.ndarray, half: np.ndarray):
        self.grams = np.zeros((2, 2, 1 << GRAM_BITS), np.int32)
        self.words = np.zeros((2, 2, 1 << WORD_BITS), np.int32)
        self.n = np.zeros((2, 2), np.int64)
        at = np.concatenate([f.owner[a] for a, _ in f.grams])
        bucket = np.concatenate([b for _, b in f.grams])
        order = np.argsort(at, kind="stable")
        bucket, begin = bucket[order], np.searchsorted(at[order], np.arange(f.n + 1))
        for d in range(len(first) - 1):
            own = np.unique(codes[first[d] : first[d + 1]])
            h, y = half[d], label[d]
            self.n[h, y] += 1
            if not len(own):
                continue
            self.words[h, y, np.unique(f.word[own])] += 1
            held = bucket[_spans(begin[own], begin[own + 1] - begin[own])]
            self.grams[h, y, np.unique(held)] += 1

    def tables(self, halves: list[int]) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[halves].sum(axis=0)
        return tuple(_log_ratio(x[halves, 1].sum(axis=0), x[halves, 0].sum(axis=0), n[1], n[0]) for x in (self.grams, self.words))


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, length) of the windows: every word lies in one or two, a text without words has an empty one."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    begin = first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    return text, begin, np.clip(first[text + 1] - begin, 0, WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


INPUTS = 3 + CHAR_DIM + WORD_DIM


def _parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    normal = lambda *shape, by=0.3: rng.normal(0, by, shape).astype(np.float32)
    p = {"chars": normal(CHAR_ROWS, CHAR_DIM, by=0.1), "words": normal(WORD_ROWS, WORD_DIM, by=0.1)}
    for side in ("f", "b"):
        for gate in "zrn":
            p[f"W{gate}{side}"], p[f"U{gate}{side}"], p[f"b{gate}{side}"] = normal(INPUTS, HIDDEN), normal(HIDDEN, HIDDEN), np.zeros(HIDDEN, np.float32)
    p |= {"A": normal(2 * HIDDEN, ATTENTION), "ab": np.zeros(ATTENTION, np.float32), "v": normal(ATTENTION), "u": normal(2 * HIDDEN), "c": np.zeros(1, np.float32)}
    return p


def _steps(side: str, width: int) -> range:
    return range(width) if side == "f" else range(width - 1, -1, -1)


def _run(p: dict, side: str, x: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States (time, window, HIDDEN) of one direction.  ``x``: projected inputs of the words by gate."""
    width, n = index.shape
    states = np.zeros((width, n, HIDDEN), np.float32)
    kept = [None] * width
    h = np.zeros((n, HIDDEN), np.float32)
    for t in _steps(side, width):
        z = _sigmoid(x["z"][index[t]] + h @ p[f"Uz{side}"])
        r = _sigmoid(x["r"][index[t]] + h @ p[f"Ur{side}"])
        a = h @ p[f"Un{side}"]
        c = np.tanh(x["n"][index[t]] + r * a)
        new = c + z * (h - c)
        if keep:
            kept[t] = (h, z, r, a, c)
        on = mask[t][:, None]
        h = np.where(on, new, h) if keep or not mask[t].all() else new
        states[t] = h
    return states, kept


def _project(p: dict, side: str, words: np.ndarray) -> dict[str, np.ndarray]:
    return {g: words @ p[f"W{g}{side}"] + p[f"b{g}{side}"] for g in "zrn"}


def _pool(p: dict, states: np.ndarray, mask: np.ndarray):
    """(logits, attention weights, hidden of the attention, pooled states)."""
    hidden = np.tanh(states @ p["A"] + p["ab"])
    weight = np.where(mask, hidden @ p["v"], -1e9)
    weight = np.exp(weight - weight.max(axis=0)) * mask
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    return pooled @ p["u"] + p["c"][0], weight, hidden, pooled


def _gradients(p: dict, words: np.ndarray, index: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray):
    """Gradients of the weighted log loss: (parameters, inputs of the words)."""
    runs, x = {}, {}
    for side in ("f", "b"):
        x[side] = _project(p, side, words)
        runs[side] = _run(p, side, x[side], index, mask, keep=True)
    states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    logit, att, hidden, pooled = _pool(p, states, mask)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d = ((_sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
    g["u"], g["c"] = pooled.T @ d, np.array([d.sum()], np.float32)
    d_pooled = d[:, None] * p["u"]
    d_states = att[:, :, None] * d_pooled
    d_att = np.einsum("tnh,nh->tn", states, d_pooled)
    d_score = att * (d_att - (att * d_att).sum(axis=0))
    g["v"] = np.einsum("tna,tn->a", hidden, d_score)
    d_hidden = d_score[:, :, None] * p["v"] * (1 - hidden * hidden)
    g["A"] = np.einsum("tnh,tna->ha", states, d_hidden)
    g["ab"] = d_hidden.sum(axis=(0, 1))
    d_states = d_states + d_hidden @ p["A"].T
    d_words = np.zeros_like(words)
    flat = index.ravel()
    for at, side in enumerate(("f", "b")):
        kept = runs[side][1]
        into = {k: np.zeros((*index.shape, HIDDEN), np.float32) for k in "zrn"}
        d_h = np.zeros((index.shape[1], HIDDEN), np.float32)
        for t in reversed(_steps(side, len(index))):
            h, z, r, a, c = kept[t]
            on = mask[t][:, None]
            d_h = d_h + d_states[t][:, at * HIDDEN : (at + 1) * HIDDEN]
            d_new = d_h * on
            back = d_h * ~on + d_new * z
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * a * r * (1 - r)
            into["z"][t], into["r"][t], into["n"][t] = d_z, d_r, d_c
            g[f"Uz{side}"] += h.T @ d_z
            g[f"Ur{side}"] += h.T @ d_r
            g[f"Un{side}"] += h.T @ (d_c * r)
            d_h = back + d_z @ p[f"Uz{side}"].T + d_r @ p[f"Ur{side}"].T + (d_c * r) @ p[f"Un{side}"].T
        for k in "zrn":
            by_word = np.stack([np.bincount(flat, weights=into[k][:, :, i].ravel(), minlength=len(words)) for i in range(HIDDEN)], axis=1).astype(np.float32)
            g[f"W{k}{side}"] = words.T @ by_word
            g[f"b{k}{side}"] = by_word.sum(axis=0)
            d_words += by_word @ p[f"W{k}{side}"].T
    return g, d_words


def _inputs(p: dict, f: Features, evidence: np.ndarray) -> np.ndarray:
    return np.concatenate([evidence, f.chars(p["chars"]), p["words"][f.word_row]], axis=1).astype(np.float32)


def _logits(p: dict, words: np.ndarray, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """Logits of windows given by their first word and length."""
    out = np.zeros(len(begin), np.float32)
    x = {side: _project(p, side, words) for side in ("f", "b")}
    order = np.argsort(size, kind="stable")  # windows of a chunk are about as long
    codes = np.append(codes, 0)
    for i in range(0, len(order), chunk):
        rows = order[i : i + chunk]
        width = int(size[rows[-1]])
        if not width or not len(words):
            out[rows] = p["c"][0]
            continue
        steps = np.arange(width)[:, None]
        mask = steps < size[rows]
        index = codes[np.where(mask, begin[rows] + steps, len(codes) - 1)]
        states = np.concatenate([_run(p, side, x[side], index, mask)[0] for side in ("f", "b")], axis=2)
        out[rows] = _pool(p, states, mask)[0]
    return out


def _largest(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.maximum.reduceat(logits, np.searchsorted(text, np.arange(n))) if n else np.zeros(0, np.float32)


def _calibrate(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression by Newton steps, with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = _sigmoid(a * x + b)
        g = np.array([(weight * (q - label) * x).sum() + 1e-2 * (a - 1), (weight * (q - label)).sum()])
        s = weight * q * (1 - q) + 1e-9
        h = np.array([[(s * x * x).sum() + 1e-2, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return max(float(a), 1e-3), float(b)


def train(texts: list[str], label: np.ndarray, share: float, seed: int = 5) -> dict[str, np.ndarray]:
    """All parameters of the model.  ``share``: of toxic rows among all labelled rows that may be learnt from."""
    label = np.asarray(label, np.int64)
    constant = {"a": np.array(0.0), "b": np.array(np.log(share / (1 - share)))}
    if len(set(label.tolist())) < 2:
        return constant
    rng = np.random.default_rng(seed)
    codes, first, vocabulary = _tokens(pa.array(texts, pa.large_string()))
    f = Features(vocabulary)
    if not f.n:
        return constant
    half = np.zeros(len(label), np.int64)
    for y in (0, 1):
        own = rng.permutation(np.flatnonzero(label == y))
        half[own[::2]] = 1
    counts = Evidence(f, codes, first, label, half)
    cross = [f.evidence(*counts.tables([1 - h])) for h in (0, 1)]
    text, begin, size = _windows(first)
    # Which window of a toxic text is toxic is not known: the one with most evidence; clean texts give that and a random one.
    strength = np.where(half[np.repeat(np.arange(len(label)), np.diff(first))] == 1, cross[1][codes].max(axis=1), cross[0][codes].max(axis=1))
    total = np.concatenate([[0], np.cumsum(np.maximum(strength, 0))])
    held = total[begin + size] - total[begin]
    bounds = np.searchsorted(text, np.arange(len(label) + 1))
    top = np.array([lo + int(np.argmax(held[lo:hi])) for lo, hi in zip(bounds[:-1], bounds[1:])])
    other = np.array([rng.integers(lo, hi) for lo, hi in zip(bounds[:-1], bounds[1:])])
    chosen = np.concatenate([top, other[label == 0]])
    weights = np.array([(1 - share) / max(1, (label == 0).sum()), share / max(1, (label == 1).sum())]) * len(label)
    p = _parameters(rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    tick, padded = 0, np.append(codes, 0)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(chosen))
        for i in range(0, len(order), BATCH):
            rows = chosen[order[i : i + BATCH]]
            rows = rows[size[rows] > 0]
            if not len(rows):
                continue
            steps = np.arange(int(size[rows].max()))[:, None]
            mask = steps < size[rows]
            # The two halves of a batch see different evidence, so a word is an input once for each.
            whole = padded[np.where(mask, begin[rows] + steps, len(codes))] * 2 + half[text[rows]]
            used, index = np.unique(whole, return_inverse=True)
            index = index.reshape(mask.shape)
            word, side = used // 2, used % 2
            tri = _spans(f.tri_first[word], f.tri_first[word + 1] - f.tri_first[word])
            n_tri = np.diff(f.tri_first)[word]
            tri_word = np.repeat(np.arange(len(word)), n_tri)
            chars = np.add.reduceat(p["chars"][f.tri_row[tri]], np.cumsum(n_tri) - n_tri, axis=0) / n_tri[:, None]
            evidence = np.where(side[:, None] == 1, cross[1][word], cross[0][word])
            x = np.concatenate([evidence, chars, p["words"][f.word_row[word]]], axis=1).astype(np.float32)
            y = label[text[rows]]
            g, d = _gradients(p, x, index, mask, y.astype(np.float32), np.ones(len(y)))
            d_chars = (d[:, 3 : 3 + CHAR_DIM] / n_tri[:, None])[tri_word]
            g["chars"] = np.stack([np.bincount(f.tri_row[tri], weights=d_chars[:, k], minlength=CHAR_ROWS) for k in range(CHAR_DIM)], axis=1).astype(np.float32)
            g["words"] = np.stack([np.bincount(f.word_row[word], weights=d[:, 3 + CHAR_DIM + k], minlength=WORD_ROWS) for k in range(WORD_DIM)], axis=1).astype(np.float32)
            tick += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**tick) / (1 - 0.9**tick)
            for k, old in p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                p[k] = (old - rate * m[k] / (np.sqrt(v[k]) + 1e-6)).astype(np.float32)
    logits = np.zeros(len(text), np.float32)
    for h in (0, 1):
        rows = half[text] == h
        logits[rows] = _logits(p, _inputs(p, f, cross[h]), codes, begin[rows], size[rows])
    a, b = _calibrate(_largest(logits, text, len(label)).astype(float), label, weights[label])
    gram, word = counts.tables([0, 1])
    return p | {"gram": gram, "word": word, "a": np.array(a), "b": np.array(b)}


def score_texts(model: dict[str, np.ndarray], texts: pa.Array) -> np.ndarray:
    """Score of every text from the largest logit over its windows."""
    a, b = float(model["a"]), float(model["b"])
    if "gram" not in model:
        return np.full(len(texts), _sigmoid(np.float64(b)))
    codes, first, vocabulary = _tokens(texts)
    f = Features(vocabulary)
    words = _inputs(model, f, f.evidence(model["gram"], model["word"]))
    text, begin, size = _windows(first)
    return _sigmoid(a * _largest(_logits(model, words, codes, begin, size), text, len(texts)).astype(float) + b)


def held_out():
    """Rows whose label must not be learnt: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, max_texts: int = MAX_TEXTS) -> tuple[DataFrame, float]:
    """(``text, label``: at most ``max_texts`` of either label, in the order of a hash; share of toxic labels)."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("toxic") != 0).cast("int")).alias("label"))
        .where(~held_out())
    )
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(max_texts) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.where(F.length(F.coalesce("text", F.lit(""))) <= MAX_TRAIN_CHARS)
    # An id may be repeated: the bound holds for rows as well.
    order = [F.xxhash64(F.lit("toxicity"), "doc_id"), F.col("doc_id"), F.xxhash64("text")]
    parts = [rows.where(F.col("label") == y).orderBy(*order).limit(max_texts) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "text", "label"), share


def _fit(share: float):
    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(frames)
        rows = pd.concat(frames) if frames else pd.DataFrame({"doc_id": [], "text": [], "label": []})
        rows["text"] = rows["text"].fillna("")
        rows = rows.sort_values(["label", "doc_id", "text"], kind="stable", ignore_index=True)
        for y in (0, 1):
            own = rows[rows["label"] == y]
            fits = own["text"].map(len).astype("int64").sort_values(kind="stable").cumsum() <= MAX_LABEL_CHARS
            rows = rows.drop(fits.index[~fits])
        out = io.BytesIO()
        np.savez(out, **train(rows["text"].tolist(), rows["label"].to_numpy(), share))
        yield pd.DataFrame({"model": [out.getvalue()]})

    return fit


def fit(docs: DataFrame, labels: DataFrame, max_texts: int = MAX_TEXTS) -> dict[str, np.ndarray]:
    """Trains in one task on the bounded sample; the parameters (a few MB) come back to the driver."""
    python_ready(docs.sparkSession)
    sample, share = labelled_sample(docs, labels, max_texts)
    row = sample.repartition(1).mapInPandas(_fit(share), "model binary").first()
    return dict(np.load(io.BytesIO(row["model"]))) if row else train([], np.zeros(0), share)


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per document."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = score_texts(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values.astype(np.float64))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """Trains on the labelled rows that are not held out and scores every document."""
    return score(docs, fit(docs, labels, max_texts))
