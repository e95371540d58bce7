"""Plain forms of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

LAST = 1 << 63
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def covered(n, starts, width):
    out = [False] * n
    for s in starts:
        out[s : s + width] = [True] * width
    return out


def contamination(docs, items, size=10):
    """Items without an id hit words, but aren't listed."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = defaultdict(set)
    for i, t in items:
        w = find(t)
        for s in range(max(len(w) - size + 1, 1) if w else 0):
            wins[tuple(w[s : s + size])].add(i)
    out = []
    for i, t in docs:
        w, hit, ids = find(t), set(), set()
        for n in {len(g) for g in wins}:
            for s in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[s : s + n]))):
                    hit.update(range(s, s + n))
                    ids |= found - {None}
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids))).encode()), bool(hit)))
    return out


def components(docs, k, num, den):
    sets = []
    for _, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append({tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                root[find(a)] = find(b)
    least = defaultdict(lambda: LAST)
    for a, (i, _) in enumerate(docs):
        least[find(a)] = min(least[find(a)], LAST if i is None else i)
    return [(i, len(sets[a]), None if least[find(a)] == LAST else least[find(a)]) for a, (i, _) in enumerate(docs)]


def one_of_each(docs, k, num, den):
    """Rows that stay: those without words, and of what links lead together the least by doc_id, nulls last, and digest."""
    sets = []
    for _, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append({tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set())
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and den * o >= num * (len(sets[a]) + len(sets[b]) - o) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least, out = {}, [d for d, s in zip(docs, sets, strict=True) if not s]
    for d, s, g in zip(docs, sets, group, strict=True):
        if s:
            least[g] = min(least.get(g, (LAST + 1,)), (LAST if d[0] is None else d[0], sha(d[1].encode()), d), key=lambda x: x[:2])
    return out + [x[2] for x in least.values()]


def words_left(docs, size=50):
    least = {}
    texts = [(LAST if i is None else i, (t or "").encode().split()) for i, t in docs]
    for i, w in texts:
        for s in range(len(w) - size + 1):
            g = tuple(w[s : s + size])
            least[g] = min(least.get(g, LAST), i)
    out = []
    for (i, w), (doc, _) in zip(texts, docs, strict=True):
        gone = covered(len(w), [s for s in range(len(w) - size + 1) if least[tuple(w[s : s + size])] < i], size)
        out.append((doc, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def bytes_left(docs, size=200):
    seen = Counter(b[s : s + size] for _, t in docs for b in [(t or "").encode()] for s in range(len(b) - size + 1))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = covered(len(b), [s for s in range(len(b) - size + 1) if seen[b[s : s + size]] > 1], size)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def texts_left(docs, size=200):
    """Texts without the bytes of windows that stand twice; a character of which a byte goes, goes whole."""
    seen = Counter(b[s : s + size] for _, t in docs for b in [(t or "").encode()] for s in range(len(b) - size + 1))
    out = []
    for i, t in docs:
        if t is not None:
            b = t.encode()
            gone, at, kept = covered(len(b), [s for s in range(len(b) - size + 1) if seen[b[s : s + size]] > 1], size), 0, []
            for c in t:
                n = len(c.encode())
                if not any(gone[at : at + n]):
                    kept.append(c)
                at += n
            t = "".join(kept)
        out.append((i, t))
    return out
