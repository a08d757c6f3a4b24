"""Extractors of single forms, composed of layout and text operators.

Lines are (page, line, lx, lcx, right, ly, text), controls (page, ctrl, x, y,
edge, selected); a row's tokens stand in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwright.functions import text as T
from leafwright.operators import layout

# Patterns of tokens, and the columns of benefit statements.
FULL_DATE = r"^\d{2}/\d{2}/\d{4}$"
PROCEDURE = r"^\d{5}$"
#: Codes of an own list, which may be longer than the five digits of public ones.
OWN_PROCEDURE = r"^\d{5,}$"
PRICE = r"^\$?\d+(?:,\d{3})*\.\d{2}"
REASON = r"\b[A-Z]{2}-\d{1,4}\b"
MONEY_COLUMNS = ("billed", "allowed", "deductible", "copay", "coinsurance", "plan_paid", "patient_resp")


def yes_no(yes: Column, no: Column) -> Column:
    """True or false if just one of the two is selected, else null."""
    return F.when(yes & ~no, True).when(no & ~yes, False)


def _in_rows(items: DataFrame, tolerance: float, item: str, x: str, y: str, *more: str) -> DataFrame:
    """(page, row) and the named columns of items in rows of a height: they go
    with their numbers, so that no join sorts all items once more, and items
    that are dealt by page stay where they are."""
    whole = items.withColumn("_item", F.struct(item, x, y, *more))
    return layout.height_rows(whole, tolerance, "_item", x, y).select("page", "row", "item.*")


def claim_line(tokens: Column, procedure: str = PROCEDURE) -> Column:
    """One service line of a claim's row of tokens: the first date, the last
    procedure and price, the count after the last price that has one, and the
    first two digits after a date."""
    at = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.try_element_at(tokens, i + F.lit(2)).alias("after")))
    price = F.filter(at, lambda s: s["t"].rlike(PRICE))
    counted = F.filter(price, lambda s: F.coalesce(s["after"].rlike(r"^\d{1,2}$"), F.lit(False)))
    used = F.transform(counted, lambda s: s["i"] + 1)
    dated = F.filter(at, lambda s: s["t"].rlike(FULL_DATE))
    place = F.filter(at, lambda s: s["t"].rlike(r"^\d{2}$") & (s["i"] > F.try_element_at(dated, F.lit(1))["i"]) & ~F.array_contains(used, s["i"]))
    return F.struct(
        F.try_element_at(dated, F.lit(1))["t"].alias("date_from"),
        F.try_element_at(F.filter(tokens, lambda t: t.rlike(procedure)), F.lit(-1)).alias("cpt"),
        F.try_element_at(place, F.lit(1))["t"].alias("pos"),
        T.money(F.regexp_extract(F.try_element_at(price, F.lit(-1))["t"], f"({PRICE})", 1)).alias("charge"),
        F.try_element_at(counted, F.lit(-1))["after"].cast("int").alias("units"),
    )


def claim_lines(lines: DataFrame, tolerance: float = 5, procedure: str = PROCEDURE) -> DataFrame:
    """(page, row, date_from, cpt, pos, charge, units): the rows of a claim's
    service area that have a procedure, a token like ``procedure``."""
    placed = _in_rows(lines, tolerance, "line", "lx", "ly", "text")
    words = F.array_sort(F.collect_list(F.struct("lx", "line", F.split(F.trim("text"), r"\s+").alias("t"))))
    tokens = placed.groupBy("page", "row").agg(F.flatten(F.transform(words, lambda s: s["t"])).alias("tokens"))
    return tokens.select("page", "row", claim_line(F.col("tokens"), procedure).alias("s")).select("page", "row", "s.*").where("cpt is not null")


def benefit_lines(lines: DataFrame, columns: dict[str, float], header_y: float, tolerance: float = 3, procedure: str = PROCEDURE) -> tuple[DataFrame, DataFrame]:
    """A benefit statement's service lines and its totals.

    Cells go to the nearest column; rows from the first one that says TOTALS
    are no service lines, and that row holds the totals.  A procedure is a cell
    like ``procedure``.
    """
    cells = _in_rows(lines, tolerance, "line", "lx", "ly", "text").withColumn("said", F.trim("text")).withColumn("col", layout.column_of(F.col("lx"), columns))
    last = lambda name, value: F.max_by(F.when(F.col("col") == name, value), F.when((F.col("col") == name) & value.isNotNull(), F.struct("lx", "line"))).alias(name)
    said = F.col("said")
    date = F.nullif(F.regexp_extract(said, T.DATE, 1), F.lit(""))
    codes = F.regexp_extract_all(said, F.lit(REASON), F.lit(0))
    parsed = cells.groupBy("page", "row").agg(
        F.avg("ly").alias("height"), F.max(F.upper(said) == "TOTALS").alias("is_totals"), last("date_of_service", date), last("cpt", F.when(said.rlike(procedure), said)),
        *(last(c, T.money(F.nullif(F.regexp_extract(said, r"\$?(\d+(?:,\d{3})*\.\d{2})", 1), F.lit("")))) for c in MONEY_COLUMNS),
        F.array_join(last("reason", F.when(F.size(codes) > 0, codes)), ",").alias("reasons"),
    ).where(F.col("height") > header_y + 8)
    first = parsed.where("is_totals").groupBy("page").agg(F.min(F.struct("height", "row", *MONEY_COLUMNS)).alias("t"))
    totals = first.select("page", *(F.col(f"t.{c}") for c in MONEY_COLUMNS))
    ends = first.select("page", F.col("t.height").alias("end"))
    service = parsed.join(ends, "page", "left").where((F.col("end").isNull() | (F.col("height") < F.col("end"))) & (F.col("cpt").isNotNull() | F.col("date_of_service").isNotNull()))
    return service.select("page", "row", "date_of_service", "cpt", *MONEY_COLUMNS, "reasons"), totals


def reason_codes(text: Column) -> Column:
    """The distinct reason codes of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(REASON), F.lit(0))))


def likert_scores(controls: DataFrame, tolerance: float = 5, options: int = 4) -> DataFrame:
    """(page, row, score): the index of the one selected box of each row that
    has exactly ``options`` boxes; null if none or several are selected."""
    boxes = F.array_sort(F.collect_list(F.struct("x", "ctrl", "selected")))
    g = _in_rows(controls, tolerance, "ctrl", "x", "y", "selected").groupBy("page", "row").agg(boxes.alias("boxes")).where(F.size("boxes") == options)
    picked = F.transform("boxes", lambda b: b["selected"])
    one = F.size(F.filter(picked, lambda s: s)) == 1
    return g.select("page", "row", F.when(one, F.array_position(picked, F.lit(True)) - 1).alias("score"))


def likert_summary(scores: DataFrame, items: int = 9) -> DataFrame:
    """(page, total, difficulty): the first ``items`` rows' sum if all are
    answered, and the difficulty that the total suggests."""
    ranked = F.array_sort(F.collect_list(F.struct("row", "score")))
    g = scores.groupBy("page").agg(F.slice(ranked, 1, items).alias("s")).where(F.size("s") == items)
    g = g.select("page", F.when(F.forall("s", lambda x: x["score"].isNotNull()), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["score"])).alias("total"))
    return g.withColumn("difficulty", F.when(F.col("total") <= 4, 0).when(F.col("total") <= 9, 1).when(F.col("total") <= 14, 2).when(F.col("total").isNotNull(), 3))


def selected_options(lines: DataFrame, controls: DataFrame, options: list[str], reach: float = 20, band: float = 8, nearest: bool = True) -> DataFrame:
    """(page, chosen): the options whose line has a selected box to its left,
    sorted and joined by commas; pages with none have no row."""
    name = F.element_at(F.create_map(*(F.lit(v) for o in options for v in (o.lower(), o))), F.lower(F.trim("text")))
    named = lines.withColumn("option", name).where("option is not null")
    boxed = layout.box_left_of_label(named, controls, reach, band, nearest)
    picked = boxed.join(controls.where("selected").select("page", "ctrl"), ["page", "ctrl"], "left_semi")
    return named.join(picked, ["page", "line"]).groupBy("page").agg(F.array_join(F.array_sort(F.collect_set("option")), ",").alias("chosen"))


def key_values(lines: DataFrame) -> DataFrame:
    """(page, line, key, value): "Key: value" lines, and lines that end with a
    colon with the line after them."""
    after = F.lead(F.trim("text")).over(W.partitionBy("page").orderBy("line"))
    p = lines.select("page", "line", F.trim("text").alias("said"), after.alias("after"))
    key, value = F.regexp_extract("said", T.KEY_VALUE, 1), F.trim(F.regexp_extract("said", T.KEY_VALUE, 2))
    hit = F.col("said").rlike(T.KEY_VALUE)
    label = F.trim(F.regexp_replace("said", ":+$", ""))
    usable = F.col("said").endswith(":") & (F.length("after") > 0) & ~F.col("after").endswith(":") & ~F.col("after").startswith("_") & (F.length(label) >= 2)
    p = p.select("page", "line", F.when(hit, key).when(usable, label).alias("key"), F.when(hit, value).when(usable, F.col("after")).alias("value"))
    return p.where(F.col("key").isNotNull() & ~F.col("value").startswith("_"))
