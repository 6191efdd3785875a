"""Plain versions of the training-data operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removals(docs, width):
    """docs: (id, text) -> multiset of (id, words, removed, sha256)."""
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in split:
        if i is not None:
            for p in range(len(w) - width + 1):
                k = tuple(w[p : p + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for p in range(len(w) - width + 1):
                if first[tuple(w[p : p + width])] < i:
                    gone |= set(range(p, p + width))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def pieces(text, vocabulary):
    """Greedy longest-match pieces of a text's words."""
    n = 0
    for w in WORD.findall(text or ""):
        b, at = b" " + w.encode(), 0
        while at < len(b):
            end = next(e for e in range(min(len(b), at + 140), at, -1) if b[at:e] in vocabulary and (at == 0 or b[at : at + 1] != b" "))
            n, at = n + 1, end
    return n
