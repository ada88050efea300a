"""Plain, slow versions of the training-data operators."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash


def lower_az(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def components(ids, linked):
    """Smallest id reachable from each; linked(i, j) says whether two places link."""
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                if a != b:
                    parent[a] = b
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(ids))]


def exact(docs):
    groups = {}
    for i, x in docs:
        groups.setdefault(lower_az(x), []).append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256(x.encode()).hexdigest()) for x, g in groups.items() for i in g)


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", lower_az(text))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(docs):
    prints = [simhash(x) for _, x in docs]
    comp = components([i for i, _ in docs], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    return sorted((i, f"{p:016x}", c) for (i, _), p, c in zip(docs, prints, comp, strict=True))


def cosine_links(vectors, threshold=0.9):
    def sound(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        a, b = vectors[i][1], vectors[j][1]
        if not (sound(a) and sound(b)) or len(a) != len(b):
            return False
        a, b = np.array(a, float) / np.abs(a).max(), np.array(b, float) / np.abs(b).max()
        return a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold

    n = [sum(linked(i, j) for j in range(len(vectors)) if j != i) for i in range(len(vectors))]
    comp = components([i for i, _ in vectors], linked)
    return sorted((i, k, c, i == c) for (i, _), k, c in zip(vectors, n, comp, strict=True))


def crc(i):
    return zlib.crc32(str(i).encode())


def ngram(docs, priors, order=3, min_context=2):
    """(id, held_out, n_tokens, n_known, train_tokens, base, score) by the recursion over contexts, with dictionaries."""
    told = [(i, crc(i) % 7 == 2, [*re.findall(r"[^\x20\x09-\x0d]+", lower_az(x)), None]) for i, x in docs]
    uni, grams = Counter(), Counter()
    for _, held, w in told:
        if not held:
            uni.update(w)
            line = ["<s>", *w]
            for k in range(order + 1):
                grams.update(tuple(line[i : i + k]) for i in range(len(line) - k + 1))
    n, v = sum(uni.values()), len(uni)

    def p(h, w):
        if not h:
            return (uni[w] + 1) / (n + v + 1)
        if grams[h] < min_context:
            return p(h[1:], w)
        prior = priors[min(len(h), len(priors)) - 1]
        return (grams[*h, w] + prior * p(h[1:], w)) / (grams[h] + prior)

    out = []
    for i, held, w in told:
        line = ["<s>", *w]
        score = sum(math.log10(p(tuple(line[max(0, k - order + 1) : k]), line[k])) for k in range(1, len(line)))
        out.append((i, held, len(w), sum(uni[t] > 0 for t in w), n, sum(math.log10(p((), t)) for t in w), score))
    return sorted(out)


def maximal(turns):
    """(conv_id, n_turns, copies) of conversations that are no proper prefix of another."""
    told = {}
    for c, t, r, x in set(turns):
        told.setdefault(c, []).append((t, r or "", x or ""))
    told = {c: tuple(x[1:] for x in sorted(v)) for c, v in told.items()}
    kept = {}
    for c, v in told.items():
        if not any(len(o) > len(v) and o[: len(v)] == v for o in told.values()):
            kept.setdefault(v, []).append(c)
    return sorted((min(cs), len(v), len(cs)) for v, cs in kept.items())


def cheapest_cuts(cuts, costs, window):
    """The cost of the best windows by trying all starts; the last window's padding is free."""
    f = {0: 0.0}
    for k, (j, c) in enumerate(zip(cuts, costs, strict=True)):
        last = k + 1 == len(cuts)
        f[j] = min(f[i] + (0 if last else window - (j - i) + c) for i in f if j - window <= i < j)
    return f[cuts[-1]] if cuts else 0.0
