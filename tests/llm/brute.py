"""Plain single-machine versions that the operators are held against."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(rows):
    """{doc_id: (n_shingles, component_id, n_links)} by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    near = {d: [] for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                    near[a].append(b)
                    near[b].append(a)
    root = {}
    for d in sorted(sets):
        stack = [d]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = d
                stack += near[x]
    return {d: (len(sets[d]), root[d], len(near[d])) for d in sets}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def dedup(rows, span=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    first, out = {}, {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - span + 1):
            if first.setdefault(b[s : s + span], (d, s)) < (d, s):
                gone[s : s + span] = [True] * span
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by sharing the excess again until none is above its cap. sizes: {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = float(sum(sizes.values())), dict.fromkeys(order, 0.0), set(order)
    left = total
    while open_ and left > 1e-9:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] >= most * sizes[s]}
        if not full:
            for s in open_:
                target[s] = per * weight[s]
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= full
    return target
