"""Brute-force versions and small tables for the tests of the training-data operators."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, rows, extra=True):
    """(doc_id, text) rows with columns whose names the operators also use."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    wide = [(*r, "src", 1, "row", 9, "k") for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, source string, id int, `row` string, n int, digest string")


def line_key(line: str):
    key = line.strip(STRIP).translate(LOWER)
    return key if len(key) >= 10 else None


def brute_lines(rows):
    """doc_id -> list of (n_lines, n_dropped, kept); the null id counts as the smallest."""
    order = lambda d: (d is not None, d or 0)
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if (k := line_key(line)) is not None:
                holders[k].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := line_key(x)) is None or len(holders[k]) < 2 or min(holders[k], key=order) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def brute_components(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}
