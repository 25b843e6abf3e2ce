"""Plain-Python versions of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    w = words(text)
    n = len(w)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def shingles(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near(docs, threshold=0.8):
    """{doc_id: (class_id, n_links)} for {doc_id: text}."""
    sets = {d: shingles(t) for d, t in docs.items()}
    by = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    common = collections.Counter()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[(min(a, b), max(a, b))] += 1
    links = [(a, b) for (a, b), c in common.items() if c / (len(sets[a]) + len(sets[b]) - c) >= threshold]
    top = {d: d for d in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    n = collections.Counter()
    for a, b in links:
        n[a] += 1
        n[b] += 1
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {d: (find(d), n[d]) for d in docs}


def norm_sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()
