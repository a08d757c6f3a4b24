"""Fields of authorizations to release records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leafwright.extractors import ink
from leafwright.extractors import page as P
from leafwright.extractors.benefits import DATE

# Options of the form.
SENSITIVE = ["Mental Health", "HIV/AIDS", "Substance Abuse", "Genetic Information"]
PURPOSES = ["Legal Proceedings", "Insurance Claim", "Personal Use", "Continuity of Care", "Other"]
RECORD_TYPES = ["Office Notes", "Imaging Reports", "Lab Results", "Operative Reports", "Billing Records", "Discharge Summaries"]
ANCHORS = {
    "at_name": ("patient name",), "at_name_of": ("patient's name",), "at_birth": ("date of birth",), "at_from": ("date of service from", "date of service"), "at_purpose": ("purpose of disclosure",),
    "at_year": ("one year from date",), "at_date": ("specific date",),
}


def chosen(options: list[str], line: str, box: str) -> str:
    """The options, sorted, whose line (an expression of the option ``o``, or
    null) has a selected box (an expression of the line ``q.l``)."""
    lined = f"transform({P.array(options)}, o -> named_struct('o', o, 'l', {line}))"
    return f"array_sort(transform(filter({lined}, q -> coalesce({box}.selected, false)), q -> q.o))"


def _by_ink(pages: DataFrame) -> DataFrame:
    """What boxes left open on pages read optically, by the ink left of the options' texts."""
    p = ink.only_scanned(pages)
    p = ink.marked_options(p, "_by_record_types", RECORD_TYPES, "records to be released")
    p = ink.marked_options(p, "_by_purposes", PURPOSES, "purpose of disclosure")
    p = ink.marked_options(p, "_refused", [f"Do NOT release {c}" for c in SENSITIVE], "specially protected")
    p = ink.marked_options(p, "_ends", ["One year from date of signature", "Specific date"], "expiration")
    p = P.staged(p, {
        "_by_record_types": "array_sort(_by_record_types)", "_by_purposes": "array_sort(_by_purposes)", "_by_excluded_categories": "array_sort(transform(_refused, r -> replace(r, 'Do NOT release ', '')))",
        "_by_expiration_type": "case when array_contains(_ends, 'One year from date of signature') then 'one_year' when array_contains(_ends, 'Specific date') then 'specific_date' end",
    })
    return ink.filled_in(p, "record_types", "purposes", "excluded_categories", "expiration_type")


def authorization(pages: DataFrame, threshold: float | None = 0.78) -> DataFrame:
    """(page, patient_name, patient_dob, date_range_from, date_range_to,
    record_types, excluded_categories, purposes, expiration_type) of prepared
    pages.  A selected box excludes a category."""
    holds = "contains(lower(l.text), lower(o))"
    first = lambda where: f"get(filter(lines, l -> {where}), 0)"
    refused = f"coalesce({first('contains(lower(l.text), concat(' + P.quoted('do not release ') + ', lower(o)))')}, {first(holds + ' and contains(lower(l.text), ' + P.quoted('do not release') + ')')})"
    left = P.box_left("q.l", 20, 8, nearest=False)
    year, date = (f"coalesce({P.box_left(a, 20, 8, nearest=False)}.selected, false)" for a in ("at_year", "at_date"))
    p = P.staged(
        P.anchored(pages, ANCHORS, (), threshold),
        {
            "patient_name": f"coalesce(nullif({P.text_right('at_name', 350, 5)}, ''), {P.text_right('at_name_of', 350, 5)})",
            "patient_dob": f"nullif(regexp_extract({P.text_right('at_birth', 250, 5)}, {P.quoted(DATE)}, 1), '')",
            "in_range": "flatten(transform(" + P.by("filter(lines, l -> abs(l.cy - at_from.cy) <= 5)", "l.x0") + f", l -> regexp_extract_all(l.text, {P.quoted(DATE)}, 1)))",
            "record_types": chosen(RECORD_TYPES, first(holds), P.box_left("q.l", 15, 8)), "excluded_categories": chosen(SENSITIVE, refused, left),
            "purposes": chosen(PURPOSES, first(holds + " and l.cy between at_purpose.y1 and at_purpose.y1 + 60"), left),
            "expiration_type": f"case when {year} and not {date} then 'one_year' when {date} and not {year} then 'specific_date' end",
        },
        {"date_range_from": "get(in_range, 0)", "date_range_to": "get(in_range, 1)"},
    )
    if ink.scanned(p):
        p = _by_ink(p)
    return p.select("page", "patient_name", "patient_dob", "date_range_from", "date_range_to", "record_types", "excluded_categories", "purposes", "expiration_type")
