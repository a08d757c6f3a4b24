"""License scans by an exact set-similarity join, in DataFrame functions only.

Text blocks are windows of ``2 * STEP`` words that begin at every ``STEP``-th
word.  A template's containment in a block is the share of its distinct words
that the block holds; the join finds every (block, template) that reaches
``THRESHOLD``:

* order: the words of all templates, rarest in the corpus first;
* prefix: a block that holds ``need`` of a template's ``n`` words holds one of
  its first ``n - need + 1`` in that order;
* length: a block with fewer than ``need`` template words can't match;
* position: after a match at places i and j, at most
  ``1 + min(n - 1 - i, m - 1 - j)`` words can be shared.

Only words of templates are carried: others can't be shared.  The templates
are fixed, so they and their words' counts are of bounded size.  Phrases of
consecutive words are found beside (``PHRASES``), from the same positions.

A null or empty text has no words and no labels.  Rows are told apart by a
row number, so repeated rows, null ids and extra columns do no harm.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.llm.store import cut

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
STEP, THRESHOLD = 32, 0.8

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

TEMPLATES = {
    "apache-2": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under the creative commons attribution sharealike license",
    "gpl-3": "licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2": "subject to the terms of the mozilla public license v 2 0",
}


def _hits(docs: DataFrame, words: list[str], id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_words, hits): where each text has one of ``words``."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)).alias("w"))
    # only ASCII words can be equal to one of a template, and are so folded by lower()
    listed = F.transform("w", lambda w, i: F.when((F.octet_length(w) == F.length(w)) & F.lower(w).isin(words), F.struct(i.cast("long").alias("at"), F.lower(w).alias("w"))))
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), F.array_compact(listed).alias("hits"))


def _phrase(words: list[str]) -> Column:
    """The starts of all places where ``words`` stand one after the other."""

    def here(h: Column, i: Column) -> Column:
        ok = h["w"] == words[0]
        for k, word in enumerate(words[1:], 1):
            later = F.get("hits", i + k)
            ok = ok & (later["w"] == word) & (later["at"] == h["at"] + k)
        return ok

    return F.transform(F.filter("hits", here), lambda h: h["at"])


def order_words(hits: DataFrame, words: list[str]) -> list[str]:
    """``words``, rarest in the corpus first (one count per template word)."""
    counted = dict(map(tuple, hits.select(F.explode("hits.w").alias("w")).groupBy("w").count().collect()))
    return sorted(words, key=lambda w: (counted.get(w, 0), w))


def similar(hits: DataFrame, templates: dict[str, str], words: list[str], threshold: float = THRESHOLD, step: int = STEP) -> DataFrame:
    """(row, block, label, containment) of every block and template that
    reach the threshold; ``words`` in global order."""
    spark, rank = hits.sparkSession, {w: i for i, w in enumerate(words)}
    sets = {label: sorted({rank[w] for w in text.split()}) for label, text in templates.items()}
    need = {label: ceil(threshold * len(s) - 1e-9) for label, s in sets.items()}
    prefix = [(s[i], label, i, len(s), need[label], s) for label, s in sets.items() for i in range(len(s) - need[label] + 1)]
    table = spark.createDataFrame(prefix, "tok int, label string, i int, n int, need int, tokens array<int>")
    rare = sorted({words[p[0]] for p in prefix})
    some = hits.where(F.exists("hits", lambda h: h["w"].isin(rare)))
    tokens = some.select("row", F.explode("hits").alias("h"))
    nth = F.floor(F.col("h.at") / step)
    # a word is in the window that begins with its step, and in the one before
    tokens = tokens.select("row", F.explode(F.array(nth, nth - 1)).alias("block"), F.array_position(F.lit(words), F.col("h.w")).cast("int").alias("p")).where("block >= 0")
    sets_of = tokens.groupBy("row", "block").agg(F.array_sort(F.collect_set(F.col("p") - 1)).alias("have"))
    sets_of = sets_of.where(F.size("have") >= min(need.values()))
    pairs = sets_of.select("row", "block", "have", F.posexplode("have").alias("j", "tok")).join(F.broadcast(table), "tok")
    pairs = pairs.where((F.size("have") >= F.col("need")) & (1 + F.least(F.col("n") - 1 - F.col("i"), F.size("have") - 1 - F.col("j")) >= F.col("need")))
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("have", "tokens"))).where(F.col("shared") >= F.col("need"))
    return pairs.select("row", "block", "label", (F.col("shared") / F.col("n")).alias("containment")).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score): the score is the best containment, 1 where a phrase stands."""
    vocabulary = sorted({w for text in [*templates.values(), *phrases] for w in text.split()})
    hits = cut(_hits(docs, vocabulary, id_col, text_col), "license-hits")
    found = similar(hits, templates, order_words(hits, vocabulary), threshold)
    found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    places = {p: _phrase(p.split()) for p in phrases}
    based = hits.withColumns({f"p{k}": c for k, c in enumerate(places.values())})
    starts = F.concat(*(F.col(f"p{k}") for k in range(len(phrases))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values()))))
    based = based.select("row", "doc_id", "n_words", starts.alias("starts"), F.array_sort(F.array_distinct(labels)).alias("base"))
    d = based.join(found, "row", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return d.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"),
    )
