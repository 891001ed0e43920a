"""Plain Python versions of the training-data operators for small inputs."""
import re
import string

import numpy as np
import xxhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def tokens(text):
    return TOKEN.findall((text or "").translate(LOWER))


def contamination(text, items, width=10):
    """(n_words, n_hit, sorted ids) of one text; items: (id, text) pairs."""
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        v = words(item) if item_id is not None else []
        k = min(width, len(v))
        for i in range(len(v) - k + 1 if k else 0):
            for p in range(len(w) - k + 1):
                if w[p:p + k] == v[i:i + k]:
                    hit |= set(range(p, p + k))
                    ids.add(str(item_id))
    return len(w), len(hit), sorted(ids)


def fingerprint(text, shingle=3):
    w = tokens(text)
    if not w:
        return 0
    grams = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=3):
    """Root (smallest signed value reachable) of each distinct fingerprint."""
    fps = sorted({int(np.uint64(x).astype(np.int64)) for x in fps})
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in fps}


def line_dedup(rows, hash_of, width=3):
    """Cleaned texts of (doc_id, text) rows; ``hash_of`` orders rows that share an id."""
    places = {}
    lists = {}
    for doc, text in rows:
        if text is None:
            continue
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if re.search(r"[^ \t\n\x0b\f\r]", x)]
        lists[doc, text] = lines
        for s in range(len(full) - width + 1):
            at = full[s:s + width]
            places.setdefault(tuple(lines[i] for i in at), set()).add(
                ((doc is None, doc or 0, hash_of[text], at[0]), (doc, text), tuple(at)))
    gone = {k: set() for k in lists}
    for found in places.values():
        for _, key, at in sorted(found, key=lambda x: x[0])[1:]:
            gone[key] |= set(at)
    return [None if text is None else "\n".join(
        x for i, x in enumerate(lists[doc, text]) if i not in gone[doc, text])
        if gone[doc, text] else text for doc, text in rows]
