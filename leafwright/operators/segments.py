"""Page sequences cut into segments, with windows per bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwright.functions.text import jaccard
from leafwright.sources import shared


def header_similarity(pages: DataFrame, bundle: str = "bundle", page: str = "page", tokens: str = "tokens") -> DataFrame:
    """``pages`` with the similarity of each header with the one before."""
    before = F.lag(tokens).over(W.partitionBy(bundle).orderBy(page))
    return pages.withColumn("similarity", F.when(before.isNotNull(), jaccard(F.col(tokens), before)))


def index_segments(pages: DataFrame) -> DataFrame:
    """Segments of (bundle, page, provider, dos, doc_type, is_separator,
    is_cover): one starts at a bundle's first page, at and after a separator or
    cover, where the provider changes, and where a page with a provider states
    another date of service.

    A page without a provider continues the one before it.  A segment has the
    provider and date of its last page; its type is the last one stated after
    its head, plain clinical notes apart, else that of its head.
    """
    order = W.partitionBy("bundle").orderBy("page")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.row_number().over(order) == 1
    p = pages.withColumn("sep", (F.col("is_separator") | F.col("is_cover")) & ~first)
    p = p.withColumn("prov", F.coalesce(F.last("provider", ignorenulls=True).over(so_far), F.lit("Unknown")))
    p = p.withColumn("fresh", first | (~F.col("sep") & ~F.col("prov").eqNullSafe(F.lag("prov").over(order))))
    p = p.withColumn("turn", F.col("fresh") | F.col("sep") | F.coalesce(F.lag("sep").over(order), F.lit(False))).withColumn("run", F.sum(F.col("turn").cast("int")).over(so_far))
    within = W.partitionBy("bundle", "run").orderBy("page")
    until = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    strong = F.when((F.col("provider").isNotNull() | F.col("turn")) & ~F.col("sep"), F.col("dos"))
    weak = F.when(F.col("provider").isNull() & ~F.col("turn") & ~F.col("sep"), F.col("dos"))
    p = p.withColumn("cur_dos", F.coalesce(F.last(strong, ignorenulls=True).over(until), F.first(weak, ignorenulls=True).over(until)))
    before = F.lag("cur_dos").over(within)
    p = p.withColumn("other", ~F.col("sep") & F.col("provider").isNotNull() & F.col("dos").isNotNull() & ~F.col("dos").eqNullSafe(before))
    starts = F.col("turn") | F.col("other")
    p = p.withColumn("starts", starts).withColumn("segment", F.sum(starts.cast("int")).over(so_far))
    hard, kind = F.col("fresh") | F.col("other"), F.col("doc_type")
    told = F.when(kind.isNotNull() & (kind != "Clinical Note") & ~(F.col("starts") & hard), F.struct("page", "doc_type"))
    last = lambda c: F.max_by(c, "page")
    g = p.groupBy("bundle", "segment").agg(
        F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count("*").alias("page_count"), last("prov").alias("provider"), last("cur_dos").alias("dos"), F.max("sep").alias("is_separator"),
        F.max(F.col("is_cover") & F.col("sep")).alias("cover"), F.max(told).alias("told"), F.max(F.when(F.col("starts") & hard, kind)).alias("head"),
    )
    kinds = F.when(F.col("is_separator"), F.when(F.col("cover"), "Cover Sheet").otherwise("Separator")).otherwise(F.coalesce("told.doc_type", "head", F.lit("Unknown")))
    return g.withColumn("dos", F.when(~F.col("is_separator"), F.col("dos"))).withColumn("doc_type", kinds).drop("cover", "told", "head")


def split_segments(pages: DataFrame, threshold: float = 0.2, hysteresis: int = 1) -> DataFrame:
    """Parts of (bundle, page, type, is_separator, tokens): one starts at the
    first page, at and after a separator, where a stated type differs from the
    last stated one, and where headers have been unlike the ones before for
    ``hysteresis`` pages in a row; then from the first of these on.

    With a hysteresis of 1 windows say it all; a longer one has a state, which
    is carried from block to block of pages (``_parts``).  Pages have integer
    numbers, each once in a bundle.
    """
    if hysteresis > 1:
        return _parts(pages, threshold, hysteresis)
    order = W.partitionBy("bundle").orderBy("page")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.row_number().over(order) == 1
    p = header_similarity(pages).withColumn("sep", F.col("is_separator") & ~first).withColumn("unlike", ~first & (F.col("similarity") < threshold))
    none = F.struct(F.lit(None).cast("string").alias("t"))
    event = F.when(F.col("sep"), none).when(F.col("type").isNotNull(), F.struct(F.col("type").alias("t"))).when(F.col("unlike"), none)
    p = p.withColumn("cur", F.last(event, ignorenulls=True).over(so_far)["t"])
    start = first | F.col("sep") | F.coalesce(F.lag("sep").over(order), F.lit(False)) | (F.col("type").isNotNull() & ~F.col("type").eqNullSafe(F.lag("cur").over(order))) | F.col("unlike")
    p = p.withColumn("part", F.sum(start.cast("int")).over(so_far))
    g = p.groupBy("bundle", "part").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.max("sep").alias("is_separator"), F.max_by("cur", "page").alias("cur"))
    return g.select("bundle", "part", "start_page", "end_page", F.when(F.col("is_separator"), "separator").otherwise(F.col("cur")).alias("type"))


#: Pages of a block, on average over a bundle; they are folded at a time.
BLOCK = 512
_STATE = "struct<c:boolean,k:string,r:int,since:bigint,before:bigint,same:boolean>"


def _step(e: str, p: str, h: int) -> dict[str, str]:
    """What page ``p`` makes of a state ``e``: the part's kind ``k`` (known only if
    ``c``, else ``same`` says whether it is the first kind that the block states),
    unlike pages in a row ``r``, where these begin and the page before that."""
    run = f"if({p}.u, {e}.r + 1, 0)"
    other = f"({p}.t is not null and not case when {e}.c then {p}.t <=> {e}.k else {e}.same end)"
    late = f"({run} >= {h} and not {p}.f and not {p}.s and not {other})"
    fresh = f"({p}.f or {p}.s or {other} or {late})"
    first = lambda now, then: f"case when {fresh} or {run} = 0 then null when {run} = 1 then {now} else {then} end"
    return {
        "other": other, "late": late, "c": f"{e}.c or {fresh} or {p}.t is not null", "k": f"case when {p}.s and not {p}.f then null when {fresh} or {p}.t is not null then {p}.t else {e}.k end", "r": f"if({fresh}, 0, {run})",
        "since": first(f"{p}.page", f"{e}.since"), "before": first(f"{p}.before", f"{e}.before"),
    }


def _state(x: dict[str, str], same: str) -> str:
    return f"cast(named_struct('c', {x['c']}, 'k', {x['k']}, 'r', {x['r']}, 'since', {x['since']}, 'before', {x['before']}, 'same', {same}) as {_STATE})"


def _composed(h: int) -> str:
    """The table ``a.states`` followed by ``b.states``."""
    same = "if(e.c, b.t1 is not null and e.k <=> b.t1, e.same)"
    f = f"b.states[if({same}, {h}, 0) + e.r]"
    out = {"c": "e.c or f.c", "k": "if(f.c, f.k, e.k)", "r": "f.r", "since": "if(f.r > 0, coalesce(f.since, e.since), null)", "before": "if(f.r > 0, coalesce(f.before, e.before), null)"}
    return f"transform(a.states, e -> transform(array({f}), f -> {_state(out, 'e.same')})[0])"


def _parts(pages: DataFrame, threshold: float, h: int, block: int = BLOCK) -> DataFrame:
    """Parts by a prefix scan over blocks of pages.

    A block's pages are folded from every state that the one before can leave:
    the run of unlike pages, and whether the part's kind is the first one that
    the block states.  The resulting table is a function of states, and the
    tables of a bundle's blocks are composed by doubling, which gives each block
    the state that it begins in.  It is then folded once more to find starts."""
    page = "struct(page, type as t, coalesce(is_separator, false) as sep, tokens)"
    # a bundle's numbers are divided evenly; the join is of one row for each bundle, so that a large one can be split
    width = pages.groupBy(F.col("bundle").alias("of")).agg(F.min("page").alias("low"), F.greatest(F.lit(1.0), (F.max("page") - F.min("page") + 1) / F.count("*") * block).alias("width"))
    b = pages.join(width, F.expr("bundle <=> of")).groupBy("bundle", F.floor((F.col("page") - F.col("low")) / F.col("width")).alias("block")).agg(F.sort_array(F.collect_list(F.expr(page))).alias("ps"))
    b = shared.cut(b, "blocks")
    w = W.partitionBy("bundle").orderBy("block")  # a row for each block
    ends = b.select("bundle", "block", F.element_at("ps", -1).alias("end"), F.col("ps")[0]["page"].alias("begin"))
    ends = ends.select("bundle", "block", F.row_number().over(w).alias("rank"), F.lag("end").over(w).alias("prev"), F.lead("block").over(w).isNull().alias("final"), F.first("begin").over(w).alias("first_page"))
    b = b.alias("b").join(ends.alias("e"), F.expr("b.bundle <=> e.bundle and b.block = e.block")).select("b.*", "e.rank", "e.prev", "e.final", "e.first_page")
    b = b.withColumn("ps", F.transform("ps", lambda p, i: F.struct(p.alias("p"), F.when(i == 0, F.col("prev")).otherwise(F.get("ps", i - 1)).alias("q"))))
    unlike = F.transform("ps", lambda x: F.struct(
        x["p"]["page"].alias("page"), x["p"]["t"].alias("t"), x["q"].isNull().alias("f"), (x["q"].isNotNull() & x["p"]["sep"]).alias("s"),
        F.coalesce(x["q"].isNotNull() & (jaccard(x["p"]["tokens"], x["q"]["tokens"]) < threshold), F.lit(False)).alias("u"), x["q"]["page"].alias("before"),
        F.coalesce(x["q"]["sep"] & (x["q"]["page"] != F.col("first_page")), F.lit(False)).alias("a"),
    ))
    b = b.withColumn("ps", unlike).drop("prev", "first_page").withColumn("t1", F.expr("get(filter(ps, p -> p.t is not null), 0).t"))
    begun = ", ".join(_state({"c": "false", "k": "null", "r": str(r), "since": "null", "before": "null"}, same) for same in ("false", "true") for r in range(h))
    fold = f"aggregate(ps, array({begun}), (states, p) -> transform(states, e -> {_state(_step('e', 'p', h), 'e.same')}))"
    b = shared.cut(b.withColumn("states", F.expr(fold)), "block-tables")
    # only bundles of several blocks are scanned
    tables = b.select("bundle", "rank", "t1", "states")
    most = tables.agg(F.max("rank")).first()[0] or 0
    many = b.where("final and rank > 1").select(F.col("bundle").alias("of"))
    tables = tables.join(many, F.expr("bundle <=> of"), "left_semi")
    reach = 1
    while reach < most:
        after = tables.alias("b").join(tables.alias("a"), F.expr(f"a.bundle <=> b.bundle and a.rank = b.rank - {reach}"), "left")
        tables = shared.cut(after.select("b.bundle", "b.rank", F.expr("if(a.rank is null, b.t1, coalesce(a.t1, b.t1))").alias("t1"), F.expr(f"if(a.rank is null, b.states, {_composed(h)})").alias("states")), "block-scan")
        reach *= 2
    entry = tables.select(F.col("bundle").alias("of"), (F.col("rank") + 1).alias("at"), F.col("states")[0].alias("e"))
    b = b.join(entry, F.expr("bundle <=> of and rank = at"), "left")
    step = _step("z.e", "p", h)
    start = "struct<start:bigint,late:boolean,before:bigint,kind:string>"
    at = lambda page, late, before, kind: f"cast(named_struct('start', {page}, 'late', {late}, 'before', {before}, 'kind', {kind}) as {start})"
    told = f"""case when p.f then array({at('p.page', 'false', 'null', 'null')}) when p.s or p.a or {step['other']} then array({at('p.page', 'false', 'p.before', "if(p.a, 'separator', z.e.k)")})
        when {step['late']} then array({at('z.e.since', 'true', 'z.e.before', 'z.e.k')}) else cast(array() as array<{start}>) end"""
    none = _state({"c": "true", "k": "null", "r": "0", "since": "null", "before": "null"}, "false")
    begin = f"named_struct('e', coalesce(e, {none}), 'out', cast(array() as array<{start}>))"
    last = "element_at(ps, -1)"
    end = at("null", "false", f"{last}.page", f"if({last}.s, 'separator', z.e.k)")
    fold = f"aggregate(ps, {begin}, (z, p) -> named_struct('e', {_state(step, 'false')}, 'out', concat(z.out, {told})), z -> if(final, concat(z.out, array({end})), z.out))"
    starts = b.select("bundle", F.explode(F.expr(fold)).alias("s")).select("bundle", "s.*")
    # a run of unlike pages that begins where a part does anyway
    starts = starts.groupBy("bundle", "start").agg(F.min(F.struct("late", "before", "kind")).alias("x"))
    w = W.partitionBy("bundle").orderBy(F.col("start").asc_nulls_last())  # a row for each part
    parts = starts.select("bundle", F.row_number().over(w).cast("long").alias("part"), F.col("start").alias("start_page"), F.lead("x.before").over(w).alias("end_page"), F.lead("x.kind").over(w).alias("type"))
    return parts.where("start_page is not null")


def provider_summary(segments: DataFrame) -> DataFrame:
    """Segments, pages, dates of service and encounters (dos, doc_type, pages,
    page_count) by date, of each bundle's providers."""
    s = segments.where(~F.col("is_separator"))
    spread = F.concat_ws("-", "start_page", "end_page")
    each = F.array_sort(F.collect_list(F.struct(F.coalesce("dos", F.lit("")).alias("by"), "start_page", "dos", "doc_type", spread.alias("pages"), "page_count")))
    return s.groupBy("bundle", "provider").agg(
        F.count("*").alias("encounters"), F.sum("page_count").alias("pages"), F.array_join(F.array_sort(F.collect_set("dos")), ",").alias("dates"),
        F.transform(each, lambda e: e.dropFields("by", "start_page")).alias("visits"),
    )


def index_totals(segments: DataFrame) -> DataFrame:
    """(bundle, total_pages, total_segments, provider_count, encounter_count)."""
    real = ~F.col("is_separator")
    return segments.groupBy("bundle").agg(F.sum("page_count").alias("total_pages"), F.count("*").alias("total_segments"), F.countDistinct(F.when(real, F.col("provider"))).alias("provider_count"), F.count_if(real).alias("encounter_count"))


def islands(rows: DataFrame, group: str, order: str, cells: str, least_cells: int = 3, least_rows: int = 2) -> DataFrame:
    """Tables: runs of consecutive rows with enough cells."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    r = rows.withColumn("breaks", F.sum((F.col(cells) < least_cells).cast("int")).over(w)).where(F.col(cells) >= least_cells)
    g = r.groupBy(group, "breaks").agg(F.min(order).alias("first_row"), F.count("*").alias("row_count"), F.max(cells).alias("col_count"))
    return g.where(F.col("row_count") >= least_rows).drop("breaks")


def with_extractions(segments: DataFrame, extractions: DataFrame) -> DataFrame:
    """Segments with what was extracted from their first page (bundle, page,
    ...); separators and covers have nothing."""
    e = extractions.withColumnRenamed("page", "start_page")
    real = segments.where(~F.col("is_separator"))
    return real.join(e, ["bundle", "start_page"], "left").unionByName(segments.where(F.col("is_separator")), allowMissingColumns=True)
