"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def suffix_dedup(texts: list[str | None], length: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if n[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(r), sum(gone), runs, sha(bytes(c for c, g in zip(r, gone, strict=True) if not g))))
    return out


def phrase_dedup(docs: list[tuple], length: int) -> list[tuple]:
    """docs: (doc_id, text) in row order."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    seen, out = set(), [None] * len(docs)
    for i in order:
        w = WORD.findall(docs[i][1] or "")
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            p = tuple(w[k : k + length])
            if p in seen:
                gone[k : k + length] = [True] * length
            seen.add(p)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return out


def shingles(text: str | None, gram: int = 5) -> frozenset:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + gram]) for i in range(len(w) - gram + 1)) if len(w) >= gram else frozenset([tuple(w)] if w else [])


def components(docs: list[tuple], pct: int = 75, gram: int = 5) -> dict:
    """docs: (doc_id, text); component_id by doc_id."""
    sets = {d: shingles(t, gram) for d, t in docs}
    at = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            at[x].add(d)
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for d, s in sets.items():
        for e in set().union(*(at[x] for x in s)) if s else ():
            both = len(s & sets[e])
            if e < d and 100 * both >= pct * (len(s) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                comp[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}
