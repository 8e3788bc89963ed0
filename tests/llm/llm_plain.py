"""The contracts of the operators in plain Python, slow and obvious."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

LAST = (1 << 63) - 1
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def order(doc_id):
    return LAST if doc_id is None else doc_id


def rules(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(grams) < 3000 else None
    if marked is None:
        n = Counter(grams)
        marked = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def lines(docs, least=10):
    """(n_lines, n_dropped, text) of each row of (id, text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(order(d))
    out = []
    for d, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (len(key(x)) >= least and len(holders[key(x)]) > 1 and order(d) != min(holders[key(x)]))]
        out.append((len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def passages(docs, window):
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            first[g] = min(first.get(g, LAST), order(d))
    out = []
    for d, t in docs:
        w = words(t)
        lost = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < order(d) for k in range(window)}
        out.append((len(w), len(lost), " ".join(x for i, x in enumerate(w) if i not in lost)))
    return out


def strings(docs, window):
    texts = [(t or "").encode() for _, t in docs]
    n = Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        lost = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if n[t[i:i + window]] > 1:
                lost[i:i + window] = b"\1" * window
        spans = sum(lost[i] and not (i and lost[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(lost), spans, bytes(b for b, x in zip(t, lost, strict=True) if not x)))
    return out


def shingles(text, size=5):
    w = words((text or "").translate(UPPER))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def groups(docs, percent=75):
    """(n_shingles, component) of each row."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in holders[g]).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                up[root(i)] = root(j)
        for g in s:
            holders[g].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), LAST), order(d))
    return [(len(sets[i]), least[root(i)] if sets[i] else order(d)) for i, (d, _) in enumerate(docs)]


def leaks(docs, items, percent=75):
    """{(doc, item): (similarity, start)} of the best windows."""
    grams = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    found = {}
    for d, t in docs:
        w = words((t or "").translate(UPPER))
        for item, text in items:
            q = words((text or "").translate(UPPER))
            have = grams(q)
            for start in range(len(w) - len(q) + 1 if q else 0):
                other = grams(w[start:start + len(q)])
                common, total = sum((have & other).values()), sum((have | other).values())
                if 100 * common >= percent * total and common / total > found.get((d, item), (0, 0))[0]:
                    found[d, item] = (common / total, start)
    return found
