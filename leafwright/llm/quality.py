"""Quality rules by weak supervision.

Every rule votes good (+1), bad (-1) or abstains (0).  Expectation-maximisation
over the counts of all vote patterns in the corpus estimates how each rule
votes on good and on bad texts; a text is kept when its posterior probability
of being good reaches one half, and the base limits do not fail it.

Null and empty texts have no words, fail the base limits and are not kept.
Rows are judged one by one, so repeated rows get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.llm.store import cut
from leafwright.llm.textscan import IS_SPACE, Block, blocks, strings, tidy, word_spans

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xF5] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_stops", "n_upper"]


def block_counts(b: Block) -> list[np.ndarray]:
    """The COUNTS of each text of a block."""
    data = b.data
    starts, ends, n_words = word_spans(b)
    zero = np.zeros(len(b), np.int64)
    if not len(starts):
        return [zero] * len(COUNTS)
    word_chars = b.per_doc(((data & 0xC0) != 0x80) & ~IS_SPACE[data])
    dup, lines = _duplicate_lines(b, starts)
    return [n_words, word_chars, b.per_doc(_SYMBOL[data]), dup, _repeated_words(b, starts, ends, n_words), lines, b.per_doc(_LETTER[data]), b.per_doc(_STOP[data]), b.per_doc(_UPPER[data])]


def _duplicate_lines(b: Block, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line; lines with a word."""
    breaks = np.flatnonzero(b.data == 0x0A)
    bounds = np.unique(np.concatenate([b.offsets, breaks, breaks + 1]))
    code = strings(b.data, bounds).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.unique(np.searchsorted(bounds, starts, side="right") - 1)
    doc = np.searchsorted(b.offsets, bounds[piece], side="right") - 1
    lines = np.bincount(doc, minlength=len(b))
    width = int(code.max()) + 1
    distinct = np.bincount(np.unique(doc * width + code[piece]) // width, minlength=len(b))
    return lines - distinct, lines


def _repeated_words(b: Block, starts: np.ndarray, ends: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Words that stand in a window of three words found twice in the text."""
    n = len(starts)
    if n < 4:
        return np.zeros(len(b), np.int64)
    # words and the gaps between them alternate
    pieces = strings(b.data, np.stack([starts, ends], 1).ravel()).dictionary_encode()
    word = pieces.indices.to_numpy(zero_copy_only=False)[::2].astype(np.int64)
    doc = np.repeat(np.arange(len(b)), n_words)
    whole = np.flatnonzero(doc[:-2] == doc[2:])
    width = len(pieces.dictionary)
    pair, pair_code = np.unique(word[:-1] * width + word[1:], return_inverse=True)
    key = pair_code[whole] * width + word[whole + 2]
    _, code, seen = np.unique(key, return_inverse=True, return_counts=True)
    often = np.flatnonzero(seen[code] > 1)
    _, own, seen = np.unique(doc[whole[often]] * (int(code.max(initial=0)) + 1) + code[often], return_inverse=True, return_counts=True)
    first = whole[often[seen[own] > 1]]
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[first + k] = True
    return np.bincount(doc[mark], minlength=len(b))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and COUNTS of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                found = [pa.array(c, pa.int64()) for c in block_counts(b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.start, len(b)), *found], [id_col, *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"{id_col} {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules.  A rule without evidence (no words, few lines) abstains."""
    words = F.col("n_words")
    some = F.greatest(words, F.lit(1))
    length, lines = F.col("word_chars") / some, F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "enough_words": _vote(words >= 100, words < 20),
        "word_length": _vote((words > 0) & length.between(3, 9), (words > 0) & ((length < 2) | (length > 14))),
        "few_symbols": _vote((words > 0) & (F.col("n_symbols") <= 0.02 * some), F.col("n_symbols") > 0.1 * some),
        "own_lines": _vote((F.col("n_lines") > 2) & (F.col("n_dup_lines") <= 0.1 * lines), (F.col("n_dup_lines") > 0.5 * lines)),
        "own_phrases": _vote((words > 0) & (F.col("n_repeat_words") <= 0.15 * some), F.col("n_repeat_words") > 0.3 * some),
        "mostly_letters": _vote((words > 0) & (F.col("n_letters") >= 0.7 * F.col("word_chars")), (words > 0) & (F.col("n_letters") < 0.5 * F.col("word_chars"))),
        "sentences": _vote((F.col("n_stops") * 60 >= some) & (F.col("n_stops") * 3 <= some), ((words >= 100) & (F.col("n_stops") * 400 < words)) | ((words > 0) & (F.col("n_stops") > 0.5 * some))),
        "calm": _vote((words > 0) & (F.col("n_upper") <= 0.1 * F.col("n_letters")), (words > 0) & (F.col("n_upper") > 0.3 * F.col("n_letters"))),
    }


def fit(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 50, prior: float = 0.005) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior probability of "good" for each vote pattern, and the rules'
    vote probabilities by class (bad, good; -1, 0, +1).

    The first guess is that one bad vote makes a text bad; from there EM finds
    how often each rule casts each vote on either class, so that a rule which
    praises every text counts for nothing.  ``prior`` is the weight, relative
    to the corpus, of even pseudo votes.
    """
    every = list(product((-1, 0, 1), repeat=n_rules))
    n = np.array([patterns.get(p, 0) for p in every], float)
    v = np.array(every) + 1
    total = max(n.sum(), 1.0)
    good = np.where((v == 0).any(1), 0.1, 0.95)
    prob = np.zeros((n_rules, 2, 3))
    for _ in range(rounds):
        held = np.stack([n * (1 - good), n * good])
        share = (held[1].sum() + prior * total) / (total * (1 + 2 * prior))
        for r in range(n_rules):
            seen = np.stack([held[:, v[:, r] == k].sum(1) for k in range(3)], 1) + prior * held.sum(1, keepdims=True) + 1e-3
            prob[r] = seen / seen.sum(1, keepdims=True)
        score = np.log([1 - share, share])[None] + sum(np.log(prob[r][:, v[:, r]]).T for r in range(n_rules))
        good = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
    return dict(zip(every, good.tolist(), strict=True)), prob


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COUNTS, votes, ``posterior``, ``base_failed`` and ``kept`` of every text."""
    rules = votes()
    voted = cut(counts(docs, id_col, text_col).withColumns({f"vote_{k}": c for k, c in rules.items()}), "quality")
    names = [f"vote_{k}" for k in rules]
    # at most 3 ** rules patterns
    seen = {tuple(r[:-1]): r[-1] for r in voted.groupBy(*names).count().collect()}
    posterior, _ = fit(seen, len(rules))
    table = F.lit([posterior[p] for p in product((-1, 0, 1), repeat=len(rules))])
    code = F.lit(1)
    for k, name in enumerate(reversed(names)):
        code = code + (F.col(name) + 1) * 3**k
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("posterior", F.element_at(table, code.cast("int"))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
