"""Plain-Python versions of the operators, for small tables."""
import collections
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def substring(docs, width):
    """{id: (n_words, n_removed, kept)} of {id: text}."""
    w, first = {i: words(t) for i, t in docs.items()}, {}
    for i in sorted(w):
        for k in range(len(w[i]) - width + 1):
            first.setdefault(tuple(w[i][k:k + width]), i)
    out = {}
    for i, x in w.items():
        gone = [False] * len(x)
        for k in range(len(x) - width + 1):
            if first[tuple(x[k:k + width])] < i:
                gone[k:k + width] = [True] * width
        out[i] = (len(x), sum(gone), " ".join(a for a, g in zip(x, gone) if not g))
    return out


def suffix(docs, length):
    """{id: (n_bytes, n_removed, n_spans, kept bytes)}."""
    raw = {i: (t or "").encode() for i, t in docs.items()}
    seen = collections.Counter(b[k:k + length] for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\x01" * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def component_ids(nodes, links):
    up = {i: i for i in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in nodes}


def jaccard(docs, width, percent):
    """{id: (n_shingles, component)}."""
    sets = {}
    for i, t in docs.items():
        w = words(t, lower=True)
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = component_ids(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def cosine(rows, threshold):
    """{id: (n_links, component)} of [(id, vector, label)]."""
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, dtype=np.float64), y) for i, v, y in rows if y is not None and usable(v)]
    links = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k]
             if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= threshold]
    n, comp = collections.Counter(x for l in links for x in l), component_ids([r[0] for r in rows], links)
    return {r[0]: (n[r[0]], comp[r[0]]) for r in rows}


def katz(docs, held_out, k=5, least=2):
    """{id: (n_tokens, n_known, N, base, score)}, and a function that gives P(word | history); word "?" stands for unknown ones."""
    tokens = {i: [(w,) for w in words(t, lower=True)] + ["end"] for i, t in docs.items()}
    train = [i for i in docs if not held_out(i)]
    count = collections.Counter(w for i in train for w in tokens[i])
    pairs = collections.Counter(p for i in train for p in zip(["start"] + tokens[i][:-1], tokens[i]))
    history = collections.Counter(h for i in train for h in ["start"] + tokens[i][:-1])
    n, v = sum(count.values()), len(count)

    def factors(by):
        a = (k + 1) * by[k + 1] / by[1] if by[1] else 1.0
        out = {}
        for c in range(1, k + 1):
            d = ((c + 1) * by[c + 1] / (c * by[c]) - a) / (1 - a) if by[c] and a != 1 else -a / (1 - a) if a != 1 else 0
            out[c] = d if 0 < d < 1 else (c - 0.5) / c
        return out

    by = collections.Counter(count.values())
    d1 = factors(by)
    left = sum(c * by[c] * (1 - d1[c]) for c in d1)
    word = {w: (d1.get(c, 1) * c / n if left > 0 else c / (n + 0.5)) for w, c in count.items()}
    unknown = left / n if left > 0 else 0.5 / (n + 0.5)
    kept = {p: c for p, c in pairs.items() if c >= least}
    by = collections.Counter(kept.values())
    by[1] = n - sum(kept.values())
    d2 = factors(by)
    share = {p: d2.get(c, 1) * c / history[p[0]] for p, c in kept.items()}
    mass, low = collections.Counter(), collections.Counter()
    for (h, w), s in share.items():
        mass[h] += s
        low[h] += word[w]
    scale = {h: history[h] / (history[h] + 1) / m if m > 1 - 1e-9 else 1 for h, m in mass.items()}
    alpha = {h: (1 - mass[h] * scale[h]) / max(1 - low[h], 1e-15) for h in mass}

    def p(h, w):
        return scale[h] * share[h, w] if (h, w) in share else alpha.get(h, 1) * word.get(w, unknown)

    out = {}
    for i, t in tokens.items():
        out[i] = (len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t),
                  sum(math.log10(p(h, w)) for h, w in zip(["start"] + t[:-1], t)))
    return out, p, list(count), list(history)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
