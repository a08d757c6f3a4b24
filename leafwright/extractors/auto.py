"""Classify a document by its first page, extract its form, add what any page states.

First pages are classified and read for what any page states once, in one
scan, and written divided by form type; each extractor reads the part of its
type, and the records come together as JSON, which leaves out what was not
found.  No page is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.extractors import authorization, benefits, claim, generic, injury, intake, marks, questionnaire
from leafwright.extractors import page as P
from leafwright.operators import classify, compare
from leafwright.sources import shared

Extractor = Callable[[DataFrame], DataFrame]


def report_of_injury(pages: DataFrame) -> DataFrame:
    """A report with marks is read from them, any other by its boxes."""
    if "drawings" not in pages.columns:
        return injury.injury(pages)
    has = F.size(F.expr(marks.found())) > 0
    return marks.marked_report(pages.where(has)).unionByName(injury.injury(pages.where(~has)), allowMissingColumns=True)


#: The extractor of each form type; any other type has none of its own.
EXTRACTORS: dict[str, Extractor] = {
    "cms1500": claim.claim, "phq9": questionnaire.questionnaire, "hipaa": authorization.authorization, "froi": report_of_injury, "eob": benefits.benefits, "medical": intake.intake, "insurance": intake.intake,
}
# The general fields that a form's record takes over where it has none.
ADDED = ("key_value_pairs", "dates", "entities", "tables", "section_headers", "stats", "acroform_fields", "patient_name", "patient_dob", "provider_name", "mrn", "diagnoses", "selected_controls")
LEAST_CONFIDENCE = 0.15
#: The part of the types without an extractor.
REST = "_rest"


def first_pages(pages: DataFrame) -> DataFrame:
    """The first page of each file; pages are numbered from 0."""
    return pages.where("page_no = 0")


def classified(pages: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Pages with form_type and confidence by their lines' text; below ``least`` they are unknown."""
    p = classify.classify(pages.withColumn("_text", F.expr("array_join(transform(lines, l -> l.text), ' ')")), "_text").drop("_text")
    return p.withColumn("form_type", F.when(F.col("confidence") < least, "unknown").otherwise(F.col("form_type")))


def types(pages: DataFrame) -> DataFrame:
    """(file, form_type, confidence) of each file's first page: what ``extract``
    dispatches by, for those who want no records and so need nothing written."""
    return classified(first_pages(pages)).select("file", "form_type", "confidence")


def _packed(pages: DataFrame) -> DataFrame:
    """Pages whose ``page`` holds all their columns, for extractors that return it and nothing else of theirs."""
    return pages.withColumn("page", F.struct(*pages.columns))


def _enriched(pages: DataFrame) -> DataFrame:
    """Prepared pages with ``found``, what any page states."""
    g = generic.generic(_packed(P.prepare(pages)))
    return g.select("page.*", F.struct(*(F.col(c) for c in g.columns if c != "page")).alias("found"))


def extract(pages: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """(file, form_type, confidence, record) of pages (file, page_no, lines,
    controls, and what else extractors read): ``record`` is JSON."""
    extractors = EXTRACTORS if extractors is None else extractors
    known = classified(first_pages(pages))
    part = F.when(F.col("form_type").isin(*extractors), F.col("form_type")).otherwise(F.lit(REST))
    table = shared.cut(_enriched(known).withColumn("_part", part), "forms", by="_part")
    present = {r[0] for r in table.select("_part").distinct().collect()}  # no more than there are extractors
    rest = table.where(F.col("_part") == REST)
    out = rest.select("file", "form_type", "confidence", _record("generic", "found", [], generic_only=True).alias("record"))
    for kind, extractor in extractors.items():
        if kind in present:
            x = extractor(_packed(table.where(F.col("_part") == kind).drop("_part")))
            own = [c for c in x.columns if c != "page"]
            x = x.select("page.file", "page.confidence", "page.found", F.struct(*own).alias("own"))
            # named anew, so that a filter on the type leaves other types' parts unread
            out = out.unionByName(x.select("file", F.lit(kind).alias("form_type"), "confidence", _record(kind, "found", own).alias("record")))
    return out


def _record(kind: str, found: str, own: list[str], generic_only: bool = False) -> Column:
    fields = [F.lit(kind).alias("form_type"), *(F.lit(True).alias("enriched_via_generic") for _ in range(not generic_only))]
    for c in own:
        mine = F.col(f"own.{c}")
        fields.append((F.coalesce(mine, F.col(f"{found}.{c}")) if c in ("patient_name", "patient_dob", "diagnoses") else mine).alias(c))
    fields += [F.col(f"{found}.{c}").alias(c) for c in ADDED if c not in own]
    return F.to_json(F.struct(*fields))


def field_confidence(field: str) -> str:
    """The largest confidence of the controls that tell a field, 0 without any."""
    labels = {"sex": intake.SEXES, "claim_type": intake.CLAIM_TYPES}
    if field in ("smoker", "diabetic", "work_related", "auto_accident"):
        test = "c.label in ('Yes', 'No')"
    elif field in labels:
        test = f"array_contains({P.array(labels[field])}, c.label) and c.selected"
    else:
        return "0D"
    return f"coalesce(array_max(transform(filter(controls, c -> {test}), c -> c.conf)), 0D)"


#: Fields whose confidence a review shows.
REVIEWED = ("sex", "smoker", "diabetic", "claim_type")


def review(pages: DataFrame, least: float = 0.5) -> DataFrame:
    """(file, sex, sex_conf, ..., allergies_count, symptoms_count, flags) of
    the first pages of intake forms: what is ambiguous or of low confidence."""
    p = P.prepare(first_pages(pages))
    p = P.staged(p, {f"{f}_conf": field_confidence(f) for f in REVIEWED})
    x = intake.intake(_packed(p))
    answers = {f: F.col(f) for f in ("smoker", "diabetic", "work_related", "auto_accident")}
    flagged = compare.flags(answers, {f: F.col(f"page.{f}_conf") for f in REVIEWED}, least)
    shown = [c for f in REVIEWED for c in (F.col(f), F.round(f"page.{f}_conf", 3).alias(f"{f}_conf"))]
    return x.select("page.file", *shown, F.size("allergies").alias("allergies_count"), F.size("symptoms").alias("symptoms_count"), flagged.alias("flags"))
