"""Main text of web pages by consensus on host paths.

1. Each page's containers are scored by their text outside links and outside
   what tags, roles and names mark as menus, headers, footers, sidebars,
   notices, adverts, forms and comments (``html.Page``).
2. The best container votes with its generalised path: the steps from the top,
   each a tag with its class names (or id), numbers as ``#``.  Votes are added
   up by host and path in Spark.
3. A host's winning paths are those with at least ``LEAST_VOTES`` votes and
   ``LEAST_SHARE`` of the host's pages, most votes first.
4. Every page is read again: the first winning path that stands on it gives its
   text, from all elements of that path.  A page with none of them, or of a
   host without any, is extracted from its own best container.

Pages are never shuffled as long as all winning paths are small enough to be
sent to every task, of which the size is summed first; beyond, pages and paths
are joined by host and a salt, so that a large host is split.

A null or empty page, and one without text, gives an empty text.  A null url,
or one without a host, has no consensus.  Rows are extracted one by one, so
null and repeated ids and rows do no harm; ties of votes go to the path that is
first in code-point order; an empty table gives no rows; further columns are
not read.  White space is that of ``str.split``, so a no-break space too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.llm import store
from leafwright.llm.html import Page
from leafwright.llm.textscan import tidy

LEAST_VOTES, LEAST_SHARE = 2, 0.01
#: Bytes of all hosts and winning paths up to which they are sent to every task, and parts of a host beyond.
SENT_BYTES, SALT = 1 << 24, 32
#: Letters of texts after which a task hands on what it has.
HANDED = 1 << 22


def host(url: str | Column) -> Column:
    """The host of an address, without user and port; null if it has none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(found != "", F.lower(found))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, n) of the best containers of pages (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(html.as_py())
                best = page.best()
                if best >= 0:
                    found[name, page.path(best)] += 1
            rows = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([found[r] for r in rows], pa.int64())], ["host", "path", "n"])

    kept = pages.where("host is not null and html is not null").select("host", "html")
    return kept.mapInArrow(tidy(run), "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))


def winners(counted: DataFrame, least_votes: int = LEAST_VOTES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, paths, n_votes): each host's winning paths, most votes first.  A
    share leaves a host no more paths than fit into the whole."""
    total = counted.groupBy("host").agg(F.sum("n").alias("n_votes"))
    kept = counted.where(F.col("n") >= least_votes).join(total, "host").where(F.col("n") >= least_share * F.col("n_votes"))
    ranked = kept.groupBy("host", "n_votes").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "path"))).alias("of"))
    return ranked.select("host", F.transform("of", lambda x: x["path"]).alias("paths"), "n_votes")


def _tree(paths: list[str]) -> dict:
    """Paths as steps in steps; under an empty step, the path's rank."""
    root: dict = {}
    for rank, path in enumerate(paths):
        at = root
        for step in path.split(">") if path else ():
            at = at.setdefault(step, {})
        at[""] = rank
    return root


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees: dict[tuple[str, ...], dict] = {}
    for batch in batches:
        texts: list[str] = []
        paths: list[str | None] = []
        agreed: list[bool] = []
        size = start = 0
        for i, (won, scalar) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
            html, path, ranked = scalar.as_py(), None, {}
            text = ""
            if html:
                page = Page(html)
                if won:
                    key = tuple(won)
                    if key not in trees:
                        if len(trees) >= 1024:
                            trees.clear()
                        trees[key] = _tree(won)
                    ranked = page.find(trees[key])
                nodes = ranked[min(ranked)] if ranked else [n for n in (page.best(),) if n >= 0]
                if nodes:
                    path, text = page.path(nodes[0]), page.text(nodes)
            texts.append(text)
            paths.append(path)
            agreed.append(bool(ranked))
            size += len(text)
            if size >= HANDED or i + 1 == batch.num_rows:
                keys = [batch.column(c).slice(start, len(texts)) for c in (0, 1)]
                n_chars = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*keys, pa.array(texts, pa.string()), n_chars, pa.array(paths, pa.string()), pa.array(agreed)], ["page_id", "url", "text", "n_chars", "path", "agreed"])
                start, size = i + 1, 0
                texts, paths, agreed = [], [], []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars, path, agreed) of each page: ``path`` is that
    of the container extracted, ``agreed`` whether it is one of its host's."""
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    won = store.cut(winners(store.cut(votes(d), "page-votes")), "page-winners").select("host", "paths")
    held = won.select(F.sum(F.length("host") + F.aggregate("paths", F.lit(0), lambda n, p: n + F.length(p))).alias("n")).first()["n"]
    if (held or 0) <= sent_bytes:
        joined = d.join(F.broadcast(won), "host", "left")
    else:
        salted = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = d.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALT)).cast("int")).join(salted.hint("shuffle_hash"), ["host", "salt"], "left")
    kinds = [d.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return joined.select("page_id", "url", "paths", "html").mapInArrow(tidy(_read), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long, path string, agreed boolean")
