"""Plain versions of the operators, over lists of (id, text), for small inputs."""

from collections import Counter, defaultdict
from hashlib import sha256

import xxhash


def words(text):
    return (text or "").encode().split()


def repeat_words(text):
    w = words(text)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({i + o for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for o in range(3)})


def byte_repeats(docs, width=200):
    where = Counter(t[i : i + width] for _, t in docs for i in range(len(t) - width + 1))
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if where[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def word_repeats(docs, width=20):
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: x[0]):
        w, gone = words(t), set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone.update(range(i, i + width))
            seen.add(key)
        out.append((d, len(w), len(gone), sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, bits=2):
    """prints: [(id, fp)] -> {id: least id reachable}."""
    ids = defaultdict(list)
    for d, f in prints:
        ids[f].append(d)
    fps, root = list(ids), {f: f for f in ids}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, f in enumerate(fps):
        for g in fps[:i]:
            if (f ^ g).bit_count() <= bits:
                root[find(f)] = find(g)
    least = {}
    for f, own in ids.items():
        least[find(f)] = min([*own, *([least[find(f)]] if find(f) in least else [])])
    return {d: least[find(f)] for d, f in prints}
