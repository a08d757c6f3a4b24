"""What each page of a records bundle says of itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions import text as T

# Providers named in text, what large print names no provider,
# and the types that a header tells, in order.
PROVIDER_TEXTS = (r"(?i)records?\s+from\s+(.+?)(?:\n|$)", r"(?i)provider[:\s]+(.+?)(?:\n|$)")
NO_PROVIDERS = ("medical records", "transmittal", "confidential", "cover", "separator", "===")
HEADER_TYPES = (
    ("(?i)patient intake|intake form", "medical_intake"), ("(?i)insurance claim|claim form", "insurance_claim"), ("(?i)authorization|hipaa|release", "authorization"),
    ("(?i)fax cover|cover sheet", "cover"), ("(?i)separator", "separator"),
)
HEADER_POINTS = 120


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def provider_in_text(text: Column) -> Column:
    """The provider that "Records from" or "Provider:" names, of more than two characters."""
    names = [_bare(F.regexp_replace(_bare(F.regexp_extract(text, p, 1)), "=+$", "")) for p in PROVIDER_TEXTS]
    return F.coalesce(*(F.when(F.length(n) > 2, n) for n in names))


def provider_in_header(spans: Column, points: float = HEADER_POINTS) -> Column:
    """The text of the largest span (text, size, y0) in the top of a page, the
    highest of equals, that isn't a general heading."""
    own = F.filter(F.transform(spans, lambda s, i: F.struct((-s["size"]).alias("less"), s["y0"].alias("y"), i.alias("i"), _bare(s["text"]).alias("said"))), lambda s: (s["y"] <= points) & (F.length(s["said"]) > 2))
    named = F.filter(own, lambda s: ~reduce(lambda a, b: a | b, (F.contains(F.lower(s["said"]), F.lit(w)) for w in NO_PROVIDERS)))
    return F.array_min(named)["said"]


def header_type(tokens: Column) -> Column:
    """The first type that a page's header tokens name, or null."""
    header = F.array_join(tokens, " ")
    return F.coalesce(*(F.when(header.rlike(p), name) for p, name in HEADER_TYPES))


def page_info(pages: DataFrame) -> DataFrame:
    """(bundle, page, provider, dos, doc_type, is_separator, is_cover) of pages
    (bundle, page, text, spans); separators and covers have no date or type,
    and a provider only in words."""
    p = pages.withColumns({"is_separator": F.col("text").rlike(T.SEPARATOR_PAGE), "is_cover": F.col("text").rlike(T.COVER_PAGE)})
    flagged = F.col("is_separator") | F.col("is_cover")
    return p.select(
        "bundle", "page", F.when(flagged, provider_in_text(F.col("text"))).otherwise(provider_in_header(F.col("spans"))).alias("provider"),
        F.when(~flagged, T.service_date(F.col("text"))).alias("dos"), F.when(~flagged, T.doc_type(F.col("text"))).alias("doc_type"), "is_separator", "is_cover",
    )
