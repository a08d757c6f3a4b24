"""Plain restatements of the operators' contracts, for small tables."""

import re
from collections import defaultdict

import numpy as np

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [2 * int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[::-2]) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), places


def classes(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def text_classes(docs, words=5, similarity=0.8):
    """The class of each (doc_id, text) by the similarity of shingle sets."""
    sets, holders, ids = {}, defaultdict(list), [i for i, _ in docs]
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
        for s in sets[i]:
            holders[s].append(i)
    shared = defaultdict(int)
    for h in holders.values():
        for k, a in enumerate(h):
            for b in h[k + 1 :]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    return classes(links, ids)


def vector_links(rows, cosine=0.93):
    """Links of each (id, vector, label)."""
    good = [(i, np.array(v, float), x) for i, v, x in rows if x is not None and v is not None and None not in list(v)]
    good = [(i, v / np.linalg.norm(v), x) for i, v, x in good if np.isfinite(v).all() and v.any()]
    out = defaultdict(set)
    for k, (i, v, x) in enumerate(good):
        for j, w, y in good[k + 1 :]:
            if x == y and len(v) == len(w) and v @ w >= cosine:
                out[i].add(j)
                out[j].add(i)
    return out
