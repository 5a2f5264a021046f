"""Plain Python versions of the operators' contracts."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, lower=False):
    found = WORD.findall(text or "")
    return [w.translate(LOWER) for w in found] if lower else found


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(rows):
    """[(doc_id, n_lines, n_dropped, text)]"""
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    held = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held[k].append(i)
    rank = lambda i: (i is not None, i or 0)
    keeper = {k: max(v, key=rank) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def substring_dedup(rows, size=50):
    first = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - size + 1):
                g = tuple(w[k : k + size])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        if i is not None:
            for k in range(len(w) - size + 1):
                if first[tuple(w[k : k + size])] < i:
                    gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(text, k=5):
    w = words(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def ngram_components(rows):
    """[(doc_id, n_shingles, component)]"""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            if None not in (i, j) and s and r and 100 * len(s & r) >= 80 * len(s | r):
                lo, hi = sorted((top(i), top(j)))
                up[hi] = lo
    return [(i, len(s), None if i is None else top(i)) for i, s in sets]


def statistics(text):
    text = text or ""
    w = words(text)
    grams = collections.defaultdict(list)
    for k in range(len(w) - 2):
        grams[tuple(w[k : k + 3])].append(k)
    covered = {k + d for v in grams.values() if len(v) > 1 for k in v for d in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
