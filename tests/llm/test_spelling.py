"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from leafwright.llm import queries, spelling, store
from leafwright.llm.textscan import blocks

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, word string, n long, wid long, place int"


def _counts(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if n >= 3 and len(w) >= 5}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _restated(docs):
    words = _counts(docs)
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(size, ()) if _near(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: v if v and words[v] >= 2 * words[w] else None for w, v in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_whole_table(spark):
    docs = [tuple(r) for r in queries.documents(spark, SF).select("doc_id", "text").collect()]
    found = queries.op13_spelling(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in found} == _restated(docs) and len(found) > 1000
    assert any(r["form"] and r["root"] != r["form"] for r in found)


def test_odd_words_and_rows(spark):
    rng = np.random.default_rng(8)
    word = "".join(rng.choice(list("abcdeé"), 3000))
    rows = [(None, "Straße größer STRASSE naïve naive naives"), (None, None), (1, ""), (1, "aaaaaa aaaaa aaaaaaa abcde abced acbde"), (2, word + " " + word[:-1] + " " + "b" * 70), (3, "ÀÀÀÀÀ ÀÀÀÀÿ ààààà " + "c" * 66)]
    rows = [r for k, r in enumerate(rows) for _ in range(3 + k)] + [(5, "aaaaaa naive " * 40)]
    table = spark.createDataFrame([(i, t, "", 1, 1, 1) for i, t in rows], KIND)
    found = {tuple(r) for r in spelling.variants(table).collect()}
    assert found == _restated(rows)
    assert ("naives", "naive", "naive", 3, 1, 43) in found
    assert spelling.variants(table.limit(0)).collect() == []


def test_chains_are_followed_to_the_end(spark):
    chain = ["q" * k + "stuvw" for k in range(12)]
    rows = [(1, " ".join([w] * 3 * 2**k)) for k, w in enumerate(chain)]
    found = {r["word"]: r for r in spelling.variants(spark.createDataFrame([(i, t, "", 1, 1, 1) for i, t in rows], KIND)).collect()}
    assert {tuple(r) for r in found.values()} == _restated(rows)
    assert found[chain[0]]["root"] == found[chain[5]]["root"] and found[chain[0]]["form"] == chain[1]


@pytest.mark.parametrize("size", [1, 8, 63, 64, 65, 300])
def test_checksums_of_runs(size):
    data = np.frombuffer(b"abcdefgh" * 100, np.uint8)
    starts, ends = np.array([0, 5, 9]), np.array([size, 5 + 2 * size, 12])
    lead = np.array([zlib.crc32(b"1:"), zlib.crc32(b":"), zlib.crc32(b"77:")], np.uint32)
    want = [zlib.crc32(x + data[s:e].tobytes()) for x, s, e in zip((b"1:", b":", b"77:"), starts, ends, strict=True)]
    assert spelling.checksums(data, starts, ends, lead).tolist() == want


def test_anagrams_are_told_by_the_order_of_letters(spark):
    """A key that a thousand words share gives no pair of words in another order."""
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.permutation(list("abcdefghi"))) for _ in range(1000)})
    table = spark.createDataFrame([(i, w, 3) for i, w in enumerate(words)], "wid long, word string, n long")
    pairs = spelling.neighbours(table, store.Tables(spark))
    assert pairs.count() == 0
    assert len({int(k) for b in blocks(table.select("word").toArrow()["word"].combine_chunks()) for k in spelling._reduced(b)[1][: len(b)].astype(np.int64)}) == 1
