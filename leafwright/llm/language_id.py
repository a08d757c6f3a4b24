"""Language identification with hyperdimensional profiles.

Each letter symbol has a random bipolar vector.  The vector of a three-letter
n-gram binds (multiplies) its letters' vectors, permuted once per place; a
text's vector bundles (adds) the vectors of all its n-grams, and a language's
prototype bundles all its training texts.  A text gets the language whose
prototype has the largest cosine with it.

Symbols: 0 for any run of non-letters, 1-26 for a-z of either case, the other
``SYMBOLS - 27`` for all other letters by code point, so that the letters of
one alphabet differ.  A null text and one without a letter get "und" with
score 0.  Training takes every labelled row it is given; the sums are
integers, so the prototypes do not depend on how rows are dealt.

Repeated rows and ids are judged one by one, a tie goes to the language that
is first in code-point order, an empty table gives no rows, without any
labelled row all texts are "und", and further columns are not read.  A text of
any length is one block; the others are taken ``BLOCK_BYTES`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.llm.textscan import Block, blocks, tidy

DIM, BITS, SEED = 512, 7, 20240607
SYMBOLS = 1 << BITS
BLOCK_BYTES = 1 << 19
_GRAMS = SYMBOLS**3
_DOCS = 64


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """The symbol of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return out


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of the symbols, permuted twice, once and not."""
    rng = np.random.Generator(np.random.Philox(SEED))
    letters = rng.choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
    turn = rng.permutation(DIM)
    return letters[:, turn][:, turn], letters[:, turn], letters


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of n-grams (first symbol most significant)."""
    twice, once, plain = _letters()
    return twice[grams >> 2 * BITS] * once[grams >> BITS & SYMBOLS - 1] * plain[grams & SYMBOLS - 1]


def gram_keys(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and n-gram of each n-gram of a block, and whether texts have letters."""
    points = np.frombuffer(b.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum((b.data & 0xC0) != 0x80, out=at[1:])
    bounds = at[b.offsets]
    # each text is led by a zero, and a last one follows them all
    code = np.insert(symbol_table()[points], bounds, 0)
    doc = np.repeat(np.arange(len(b) + 1, dtype=np.int32), np.append(np.diff(bounds) + 1, 1))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    return _grams(code[keep].astype(np.int32), doc[keep], len(b))


def _grams(code: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    has = np.zeros(n, bool)
    letters = code > 0
    has[doc[letters]] = True
    a, b, c = code[:-2], code[1:-1], code[2:]
    gram = (a << 2 * BITS) + (b << BITS) + c
    # a zero between two letters may be the end of a text
    ok = (b > 0) | ((a > 0) & (c > 0) & (doc[:-2] == doc[2:]))
    own = np.where(b > 0, doc[1:-1], doc[:-2])
    return own[ok], gram[ok], has


class _Bundler:
    """Sums of n-gram vectors, with the vectors of the n-grams met so far."""

    #: Vectors kept by a worker; beyond, the table starts anew.
    MOST = 1 << 15

    def __init__(self):
        self.row, self.vectors = np.full(_GRAMS, -1, np.int32), np.zeros((0, DIM), np.int8)
        self.place = np.zeros(_GRAMS, np.int32)

    def _of(self, used: np.ndarray) -> np.ndarray:
        new = used[self.row[used] < 0]
        if len(self.vectors) + len(new) > self.MOST:
            self.row[:], self.vectors, new = -1, self.vectors[:0], used
        if len(new):
            self.row[new] = np.arange(len(self.vectors), len(self.vectors) + len(new))
            self.vectors = np.concatenate([self.vectors, gram_vectors(new)])
        return self.vectors[self.row[used]]

    def sums(self, row: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        """The sum of the vectors of each of n rows' n-grams."""
        seen = np.zeros(_GRAMS, bool)
        seen[gram] = True
        used = np.flatnonzero(seen)
        if not len(used):
            return np.zeros((n, DIM))
        self.place[used] = np.arange(len(used), dtype=np.int32)
        tally = np.bincount(row * np.int64(len(used)) + self.place[gram], minlength=n * len(used)).reshape(n, len(used))
        # sums of no more than 2**24 units are exact in single precision
        kind = np.float32 if len(gram) < 1 << 24 else np.float64
        return np.rint(tally.astype(kind) @ self._of(used).astype(kind)).astype(np.float64)


@lru_cache(1)
def _bundler() -> _Bundler:
    return _Bundler()


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototype vectors, from all rows of
    ``docs`` with a text and a language.  One vector per language is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for batch in batches:
            lang = batch.column(1).to_pylist()
            for b in blocks(batch.column(0), BLOCK_BYTES):
                doc, gram, _ = gram_keys(b)
                names = sorted(set(lang[b.start : b.stop]))
                code = {x: i for i, x in enumerate(names)}
                of = np.array([code[x] for x in lang[b.start : b.stop]], np.int64)
                found = _bundler().sums(of[doc], gram, len(names)).astype(np.int64)
                for x, i in code.items():
                    seen[x] = seen.get(x, 0) + found[i]
        for x in sorted(seen):
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([seen[x].tolist()], pa.list_(pa.int64()))], ["lang", "part"])

    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    parts = known.mapInArrow(tidy(run), "lang string, part array<long>").select("lang", F.posexplode("part").alias("k", "v"))
    sums = parts.groupBy("lang", "k").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r[0] for r in sums})
    out = np.zeros((len(langs), DIM))
    for lang, k, v in sums:
        out[langs.index(lang), k] = v
    return langs, out


def predicted(model: tuple[list[str], np.ndarray], text_col: str = "text") -> Column:
    """(lang_pred, score) of a text, the score its cosine, 0 if below; only the
    text is handed to Python."""
    langs, proto = model
    norms = np.linalg.norm(proto, axis=1, keepdims=True)
    unit = proto / np.where(norms > 0, norms, 1)

    @F.arrow_udf("lang_pred string, score double")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array([*langs, "und"], object)

        def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for text in arrays:
                best, score = np.full(len(text), len(langs)), np.zeros(len(text))
                for b in blocks(text, BLOCK_BYTES):
                    _judged(b, unit, best[b.start : b.stop], score[b.start : b.stop])
                yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang_pred", "score"])

        yield from tidy(run)(texts)

    return judge(F.col(text_col))


def _cosines(b: Block, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some texts of a block that have letters, and their cosines with each language."""
    doc, gram, has = gram_keys(b)
    edge = np.searchsorted(doc, np.arange(0, len(b) + _DOCS, _DOCS))
    for k, at in enumerate(range(0, len(b), _DOCS)):
        n, own = min(_DOCS, len(b) - at), slice(edge[k], edge[k + 1])
        if own.start < own.stop and len(unit):
            v = _bundler().sums(doc[own] - at, gram[own], n)
            size = np.linalg.norm(v, axis=1)
            known = np.flatnonzero(has[at : at + n])
            yield at + known, (v @ unit.T / np.where(size > 0, size, 1)[:, None])[known]


def _judged(b: Block, unit: np.ndarray, best: np.ndarray, score: np.ndarray) -> None:
    """Fill in the best language and score of the texts of a block that have letters."""
    for rows, cos in _cosines(b, unit):
        best[rows], score[rows] = cos.argmax(1), cos.max(1).clip(0, 1)


def compared(model: tuple[list[str], np.ndarray], text_col: str = "text", lang_col: str = "lang") -> Column:
    """(lang_pred, score, own, lead) of a text and its label: ``own`` is the
    cosine with the label's language (null if it was not learned), ``lead`` how
    far the best language is before the second (0 with a single one)."""
    langs, proto = model
    norms = np.linalg.norm(proto, axis=1, keepdims=True)
    unit = proto / np.where(norms > 0, norms, 1)
    at = {lang: i for i, lang in enumerate(langs)}

    @F.arrow_udf("lang_pred string, score double, own double, lead double")
    def judge(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = np.array([*langs, "und"], object)

        def run(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for text, lang in arrays:
                n = len(text)
                best, score, own, lead = np.full(n, len(langs)), np.zeros(n), np.full(n, np.nan), np.zeros(n)
                label = np.array([at.get(x, -1) for x in lang.to_pylist()], np.int64)
                for b in blocks(text, BLOCK_BYTES):
                    for rows, cos in _cosines(b, unit):
                        rows = rows + b.start
                        top = np.sort(cos, 1)
                        best[rows], score[rows] = cos.argmax(1), top[:, -1].clip(0, 1)
                        if len(langs) > 1:
                            lead[rows] = top[:, -1] - top[:, -2]
                        told = np.flatnonzero(label[rows] >= 0)
                        own[rows[told]] = cos[told, label[rows[told]]]
                cols = [pa.array(names[best], pa.string()), pa.array(score), pa.array(own, from_pandas=True), pa.array(lead)]
                yield pa.StructArray.from_arrays(cols, ["lang_pred", "score", "own", "lead"])

        yield from tidy(run)(columns)

    # else a filter on what was found would be pushed below it with a second reading of the texts, in a worker of its own
    return judge.asNondeterministic()(F.col(text_col), F.col(lang_col))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns, ``lang_pred`` and ``score``."""
    return docs.select(*(F.col(f"`{c}`") for c in carry), predicted(model, text_col).alias("_judged")).select(*(F.col(f"`{c}`") for c in carry), "_judged.lang_pred", "_judged.score")


def held_out(id_col: str = "doc_id") -> Column:
    """One document in four, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), trained on the rows not held out."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", held_out())
    model = prototypes(d.where(~F.col("held_out")))
    return predict(d, model, ["doc_id", "held_out"])
