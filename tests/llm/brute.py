"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alphanumeric(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def in_order(doc_id):
    return LAST if doc_id is None else doc_id


def removals(rows, window=20):
    """doc_id -> (words, removed, digest) for rows of distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda row: in_order(row[0])):
        words = split(text)
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                keep[i : i + window] = [False] * window
            seen.add(key)
        stay = [word for word, kept in zip(words, keep, strict=True) if kept]
        out[doc_id] = (len(words), len(words) - len(stay), hashlib.sha256(" ".join(stay).encode()).hexdigest())
    return out


def shingles(text, size=5):
    words = split((text or "").translate(LOW))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(rows, percent):
    """Row number -> smallest id in order reachable, for (doc_id, text) rows."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if one and sets[j] and 100 * both >= percent * (len(one) + len(sets[j]) - both):
                root[top(i)] = top(j)
    smallest = defaultdict(lambda: LAST)
    for i, (doc_id, _) in enumerate(rows):
        smallest[top(i)] = min(smallest[top(i)], in_order(doc_id))
    return [smallest[top(i)] for i in range(len(rows))], [len(x) for x in sets]


def benchmark_hits(rows, items, window=10):
    known = defaultdict(set)
    for item_id, text in items:
        words = alphanumeric(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            known[tuple(words[i : i + window])].add("null" if item_id is None else str(item_id))
    out = []
    for doc_id, text in rows:
        words = alphanumeric(text)
        hit, found = set(), set()
        for size in {len(key) for key in known}:
            for i in range(len(words) - size + 1):
                if (key := tuple(words[i : i + size])) in known:
                    found |= known[key]
                    hit |= set(range(i, i + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def records(pages):
    newest = {}
    for page_id, html in pages:
        key = (html or "").encode()
        newest[key] = max(newest.get(key, -(2**63)), -(2**63) if page_id is None else page_id)
    out = []
    for page_id, html in pages:
        key = (html or "").encode()
        response = (-(2**63) if page_id is None else page_id) == newest[key]
        out.append((page_id, len(key), base64.b32encode(hashlib.sha1(key).digest()).decode(), "response" if response else "revisit", None if response else newest[key]))
    return out
