"""Fields of health insurance claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.extractors import ink
from leafwright.extractors import page as P
from leafwright.operators import forms

# Options of the form, in their order, and patterns.
INSURANCE_TYPES = ["Medicare", "Medicaid", "TRICARE", "CHAMPVA", "Group Health Plan", "FECA Blk Lung", "Other"]
RELATIONSHIPS = ["Self", "Spouse", "Child", "Other"]
ICD10 = r"\b([A-TV-Z]\d{2}(?:\.[A-Z0-9]{1,5})?)\b"
CURRENCY = r"\$?(\d+(?:,\d{3})*\.\d{2})"
ANCHORS = {
    "at_type": ("1. medicare",), "at_name": ("patient's name",), "at_sex": ("patient's birth date", "birth date"),
    "at_relation": ("patient relationship to insured", "6. patient relationship"), "at_job": ("employment",), "at_auto": ("auto accident",),
    "at_other": ("other accident",), "at_codes": ("diagnosis or nature of illness",), "at_lines": ("date(s) of service", "24."),
    "at_total": ("28. total charge",), "at_assign": ("accept assignment",), "at_tax": ("federal tax i.d.",),
}


def _price(text: str) -> str:
    return f"try_cast(replace(nullif(regexp_extract({text}, {P.quoted(CURRENCY)}, 1), ''), ',', '') as double)"


def _by_ink(pages: DataFrame) -> DataFrame:
    """What boxes left open on pages read optically, by the ink at the options'
    texts; answers without a text of their own share that of the first YES and NO."""
    p = ink.best_option(ink.only_scanned(pages), "_yes_no", ["YES", "NO"])
    for field, options in (("relationship_to_insured", RELATIONSHIPS), ("tax_id_type", ["SSN", "EIN"])):
        p = ink.best_option(p, f"_by_{field}", options)
    answers = ("condition_employment", "condition_auto", "condition_other", "accept_assignment")
    p = p.withColumns({f"_by_{f}": F.col("_yes_no") == "YES" for f in answers})
    # the letters of the sexes themselves are circled or crossed
    said, sex = "upper(regexp_replace(l.text, '[^A-Za-z]', ''))", "get(filter(lines, m -> contains(m.norm, 'sex')), 0)"
    row = f"abs(l.cy - {sex}.cy) <= 15 and l.x0 >= {sex}.x1"
    places = {
        "_m": (f"contains({said}, 'M') and length({said}) <= 5 and l.x0 < {sex}.x1 + 120", "l.cx"), "_f": (f"contains(left({said}, 3), 'F') and l.x0 > {sex}.x1 + 50", "l.x0 + 2"),
    }
    for name, (test, x) in places.items():
        p = ink.measured(p, name, f"transform(filter(lines, l -> {row} and {test}), l -> {ink.spot(x, 'l.cy', 8)})")
    p = P.staged(p, {"_m": "coalesce(array_max(_m), 0D)", "_f": "coalesce(array_max(_f), 0D)"}, {"_by_patient_sex": "case when greatest(_m, _f) <= 0.15 then null when _m > _f * 1.1 then 'M' when _f > _m * 1.1 then 'F' end"})
    return ink.filled_in(p, "relationship_to_insured", "tax_id_type", "patient_sex", *answers)


def claim(pages: DataFrame, threshold: float | None = 0.78) -> DataFrame:
    """(page, insurance_type, patient_name, patient_sex, relationship_to_insured,
    condition_*, diagnoses, service_lines, total_charge, accept_assignment,
    tax_id_type) of prepared pages; what is not found is null, lists are empty."""
    p = P.anchored(pages, ANCHORS, ("at_type",), threshold)
    rows = {
        "r_type": P.row("at_type.cy + 12", 8, "at_type.x0 - 5", "at_type.x0 + 360"), "r_sex": P.row("at_sex.cy + 10", 10, "at_sex.x1", "at_sex.x1 + 200"),
        "r_relation": P.row("at_relation.cy + 10", 10, "at_relation.x0 - 5", "at_relation.x0 + 200"),
        **{f"r_{k}": P.row(f"at_{k}.cy", 8, f"at_{k}.x1", f"at_{k}.x1 + 250") for k in ("job", "auto", "other")},
        "r_assign": P.row("at_assign.cy + 10", 12, "at_assign.x0 - 5", "at_assign.x1 + 100"), "r_tax_all": P.row("at_tax.cy + 10", 10, "at_tax.x0", "at_tax.x0 + 160"),
        "l_codes": P.region("0", "at_codes.y1", "9999", "at_codes.y1 + 45"),
        "l_lines": P.clustered(P.region("0", "at_lines.y1 + 2", "9999", "at_lines.y1 + 120"), 5),
    }
    small = {"r_tax": "case when size(filter(r_tax_all, c -> c.w < 6.5)) < 2 then r_tax_all else filter(r_tax_all, c -> c.w < 6.5) end"}
    one = "size(filter(r_sex, c -> c.selected)) = 1"
    hits = "transform(regexp_extract_all(regexp_replace(l.said, '^[A-L]\\\\.', ''), " + P.quoted(ICD10) + ", 1), (code, j) -> named_struct('r', bround(l.y0 / 5), 'x', l.x0, 'i', l.i, 'j', j, 'code', code))"
    fields = {
        "insurance_type": P.option("r_type", INSURANCE_TYPES),
        "patient_name": P.text_below("at_name", "patient's name"),
        "patient_sex": f"coalesce(left(upper(get(filter(r_sex, c -> c.selected and upper(c.label) in ('M', 'MALE', 'F', 'FEMALE')), 0).label), 1), case when {one} then {P.option('r_sex', ['M', 'F'])} end)",
        "relationship_to_insured": f"coalesce(get(filter(r_relation, c -> c.selected and array_contains({P.array(RELATIONSHIPS)}, c.label)), 0).label, {P.option('r_relation', RELATIONSHIPS)})",
        "condition_employment": P.yes_no("r_job"), "condition_auto": P.yes_no("r_auto"), "condition_other": P.yes_no("r_other"),
        "diagnoses": f"slice(array_distinct(transform(array_sort(flatten(transform(l_codes, l -> {hits}))), h -> h.code)), 1, 12)",
        "tokens": "transform(" + P.by("l_lines", "r.h", value="r") + ", r -> filter(flatten(transform(" + P.by("r.of", "l.x0") + ", l -> split(l.said, '\\\\s+'))), t -> t <> ''))",
        "total_charge": "get(filter(transform(" + P.region("at_total.x0", "at_total.y1", "at_total.x1 + 80", "at_total.y1 + 30") + f", l -> {_price('l.text')}), v -> v is not null), 0)",
        "accept_assignment": P.yes_no("r_assign"),
        "tax_id_type": "case when size(r_tax) < 2 then null when get(r_tax, 0).selected and not get(r_tax, 1).selected then 'SSN' when get(r_tax, 1).selected and not get(r_tax, 0).selected then 'EIN' end",
    }
    p = P.staged(p, rows, small, fields)
    if ink.scanned(p):
        p = _by_ink(p)
    p = p.withColumn("service_lines", F.filter(F.transform("tokens", lambda t: forms.claim_line(t)), lambda s: s["cpt"].isNotNull()))
    return p.select("page", "insurance_type", "patient_name", "patient_sex", "relationship_to_insured", "condition_employment", "condition_auto", "condition_other", "diagnoses", "service_lines", "total_charge", "accept_assignment", "tax_id_type")
