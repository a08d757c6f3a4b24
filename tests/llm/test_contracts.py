"""The queries against plain restatements on whole small tables."""

import binascii
import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from leafwright.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in queries.documents(spark, SF).select("doc_id", "text").collect()}


def test_licenses(spark, texts):
    found = rows(spark, "op3_licenses")
    assert set(found) == set(texts)
    for i, text in texts.items():
        n, places = brute.license_base(text)
        r, at = found[i], [p for p, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        if "GNU General Public License, version 3" in text:
            assert "gpl-3" in r["labels"].split(",")


def test_personal_data(spark, texts):
    found = rows(spark, "op5_pii")
    for i, text in texts.items():
        spans = brute.base_spans(text)
        shown = [f"{k}:{s}:{e}" for k, s, e in spans]
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(found[i]["spans"].split(",")) | {""}
        assert [found[i][f"n_{k}"] for k in brute.KINDS] == [sum(x[0] == k for x in spans) for k in brute.KINDS]


def test_near_dups(spark, texts):
    found = rows(spark, "op7_near_dups")
    want = brute.text_classes(sorted(texts.items()))
    assert {i: r["class_id"] for i, r in found.items()} == want
    assert all(r["kept"] == (r["class_id"] == i) for i, r in found.items())


def test_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = brute.vector_links([(r["vec_id"], r["embedding"], r["label"]) for r in table])
    found = rows(spark, "op8_vectors", "vec_id")
    total = sum(map(len, want.values()))
    assert all(r["n_links"] <= len(want[i]) for i, r in found.items())
    assert sum(r["n_links"] for r in found.values()) >= 0.9 * total


def test_language(spark):
    langs = {r["doc_id"]: r["lang"] for r in queries.documents(spark, SF).collect()}
    held = [r for r in rows(spark, "op4_language_id").values() if r["held_out"]]
    assert held and all(binascii.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.9


def test_byte_pairs(spark, texts):
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    tok.no_padding(), tok.no_truncation()
    for i, r in rows(spark, "op9_bpe").items():
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_files(spark, texts):
    tok, at = Tokenizer.from_file(queries.WORD_BPE), 0
    found = rows(spark, "op6_token_binary")
    for i in sorted(texts):
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert (found[i]["start"], found[i]["n_tokens"]) == (at, len(ids))
        assert found[i]["ids_crc32"] == binascii.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_mixing(spark):
    found = rows(spark, "op2_mixing").values()
    by_source = {}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by_source.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0], s[1] = s[0] + r["taken"], s[1] + r["size"]
    assert sum(s[2] for s in by_source.values()) == pytest.approx(1.5 * sum(s[1] for s in by_source.values()))
    for taken, size, target, stated in by_source.values():
        assert size == stated and abs(taken - target) <= 256 + 0.05 * target


def test_quality(spark, texts):
    import re

    for i, r in rows(spark, "op10_quality").items():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        marked = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 3000 else None
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", texts[i] or ""))
        lines = [x for x in (texts[i] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        if marked is not None:
            assert r["n_repeat_words"] == len(marked)
        assert r["base_failed"] == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
