"""Plain-Python versions of the contracts."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def similar_components(rows):
    """rows: (doc_id, text); gives (doc_id, n, smallest id) in the same order."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if sets[i] and ids else doc if not sets[i] else None))
    return out


def repeats_removed(rows, k=20):
    """rows: (doc_id, text); kept words per row; equal rows are one document, equal ids are not earlier."""
    seen = {}
    key = lambda d: (d is not None, d or 0)
    texts = {(r[0], r[1]) for r in rows}
    for d, t in texts:
        w = words(t)
        for i in range(len(w) - k + 1):
            seen.setdefault(tuple(w[i:i + k]), []).append((d, t, i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if any(key(e) < key(d) or (e == d and u == t and j < i) for e, u, j in seen[tuple(w[i:i + k])]):
                gone[i:i + k] = [True] * k
        out.append([x for x, g in zip(w, gone, strict=True) if not g])
    return out


def repeat_words(w, k=5):
    seen, hit = {}, [False] * len(w)
    for i in range(len(w) - k + 1):
        seen.setdefault(tuple(w[i:i + k]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                hit[i:i + k] = [True] * k
    return sum(hit)


def water_fill(sizes, weights, cap):
    """Targets by clamping and sharing again, source by source."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        share = {i: left * weights[i] / w for i in range(len(sizes)) if i not in full} if w else {}
        over = {i for i, x in share.items() if x > cap * sizes[i]}
        if not over:
            return [cap * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over
