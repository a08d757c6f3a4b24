"""Scalar expressions over text: patterns, normal forms, dates, money."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of extracted entities, and of document types.
PHONE = r"\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
CURRENCY = r"\$\d+(?:,\d{3})*(?:\.\d{2})?"
ICD10 = r"\b[A-TV-Z]\d{2}(?:\.[A-Z0-9]{1,5})?\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
NPI = r"(?i)\bNPI[:\s#]*(\d{10})\b"
MRN = r"(?i)\b(?:MRN|MR#|Medical Record)\s*[:#]?\s*([A-Z0-9-]{4,15})\b"
DATE = r"\b(\d{2}/\d{2}/\d{4})\b"
KEY_VALUE = r"^([A-Z][A-Za-z\s/&'.()-]{2,40}):\s+(.{1,200})$"
DOC_TYPES = (
    (r"(?i)office\s+visit|progress\s+note", "Office Visit"),
    (r"(?i)emergency|er\s+report", "ER Report"),
    (r"(?i)operative\s+report|surgery", "Operative Report"),
    (r"(?i)discharge\s+summary", "Discharge Summary"),
    (r"(?i)radiology|mri|ct\s+scan|x-ray|imaging", "Imaging Report"),
    (r"(?i)physical\s+therapy|pt\s+note|pt\s+session", "PT Note"),
    (r"(?i)lab\s+result|laboratory|quest\s+diagnostics", "Lab Result"),
    (r"(?i)chiropractic|manipulation", "Chiropractic Note"),
)
DEFAULT_DOC_TYPE = "Clinical Note"
# Words near a date of service, and near other dates; patterns
# of separator and cover pages.
SERVICE_WORDS = (
    "date of service", "visit date", "encounter date", "date:", "dos:", "exam date", "procedure date", "session date", "date of visit", "treatment date", "date of injury", "injury date", "admission date",
)
OTHER_WORDS = ("date of birth", "dob:", "dob ", "print date", "printed:", "fax date", "date prepared", "date received", "date paid", "statement date")
SEPARATOR_PAGE = r"(?i)={5,}|separator|records?\s+from"
COVER_PAGE = r"(?i)medical records?\s+transmittal|records?\s+retrieval|cover\s+(sheet|page)|confidential.*hipaa"


def found(text: Column, pattern: str, most: int) -> Column:
    """The distinct matches of a pattern in text order, at most ``most``."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), 1, most)


def phones(text: Column) -> Column:
    return found(text, PHONE, 5)


def emails(text: Column) -> Column:
    return found(text, EMAIL, 5)


def icd10(text: Column) -> Column:
    """Distinct diagnosis codes, sorted, at most 15."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(ICD10), F.lit(0)))), 1, 15)


def money(shown: Column) -> Column:
    return F.regexp_replace(shown, "[$,]", "").try_cast("double")


def amounts(text: Column) -> Column:
    """Distinct amounts, the largest first, at most 10."""
    every = F.array_distinct(F.regexp_extract_all(text, F.lit(CURRENCY), F.lit(0)))
    return F.slice(F.transform(F.sort_array(F.transform(every, lambda m: F.struct(money(m).alias("value"), m.alias("shown"))), asc=False), lambda s: s["shown"]), 1, 10)


def masked_ssns(text: Column) -> Column:
    return F.transform(found(text, SSN, 3), lambda s: F.concat(F.lit("***-**-"), F.right(s, F.lit(4))))


def npis(text: Column) -> Column:
    """The distinct provider numbers in text order, at most three."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(NPI), F.lit(1))), 1, 3)


def mrns(text: Column) -> Column:
    """The distinct record numbers in text order, at most three."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(MRN), F.lit(1))), 1, 3)


def doc_type(text: Column) -> Column:
    """The first document type whose pattern the text has."""
    rest = F.lit(DEFAULT_DOC_TYPE)
    return reduce(lambda other, x: F.when(text.rlike(x[0]), x[1]).otherwise(other), reversed(DOC_TYPES), rest)


def tokens_of(words: Column) -> Column:
    """Words in lower case without signs; one that signs divide ("a-b") is one token."""
    return F.filter(F.transform(words, lambda w: F.trim(F.lower(F.regexp_replace(w, "[^A-Za-z0-9]+", " ")))), lambda t: t != "")


def header_tokens(text: Column, most: int) -> Column:
    """The distinct tokens among the first ``most`` of a text."""
    return F.array_distinct(F.slice(tokens_of(F.split(text, r"\s+")), 1, most))


def top_tokens(words: Column, height: float = 108) -> Column:
    """The tokens of words (word, y0) that begin in the top of a page."""
    return tokens_of(F.transform(F.filter(words, lambda w: w["y0"] <= height), lambda w: w["word"]))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def service_date(text: Column) -> Column:
    """The date that most looks like one of service, or null.

    In the window from 35 characters before a date's first place to 10 after
    it, a word of service gives 10, another kind of date takes 20, and a place
    in the first 500 characters gives 3; the first of the best counts, if its
    score isn't negative.
    """

    def placed(d: Column, i: Column) -> Column:
        at = F.instr(text, d) - 1
        begin = F.greatest(at - 35, F.lit(0))
        return F.struct(d.alias("date"), i.alias("i"), at.alias("at"), F.lower(F.substring(text, begin + 1, at + F.length(d) + 10 - begin)).alias("near"))

    def scored(p: Column) -> Column:
        score = F.when(p["near"].rlike(_any(SERVICE_WORDS)), 10).otherwise(0) - F.when(p["near"].rlike(_any(OTHER_WORDS)), 20).otherwise(0) + F.when(p["at"] < 500, 3).otherwise(0)
        return F.struct(score.alias("score"), (-p["i"]).alias("first"), p["date"].alias("date"))

    # a lambda's variable is computed once: places first, then their scores
    places = F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(1)), placed)
    best = F.transform(F.array(F.array_max(F.transform(places, scored))), lambda s: F.when(s["score"] >= 0, s["date"]))
    return F.get(best, F.lit(0))


def _any(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


def page_kind(text: Column) -> Column:
    """"Separator" or "Cover Sheet" pages by their text, else null."""
    return F.when(text.rlike(SEPARATOR_PAGE), "Separator").when(text.rlike(COVER_PAGE), "Cover Sheet")


def digits_list(ids: Column) -> Column:
    """The numbers of a comma-separated list; other entries go."""
    return F.transform(F.filter(F.transform(F.split(ids, ","), lambda s: F.trim(s)), lambda s: s.rlike(r"^\d+$")), lambda s: s.cast("long"))
