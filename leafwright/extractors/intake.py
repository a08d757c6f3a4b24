"""Fields of intake and insurance forms in two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwright.extractors import page as P
from leafwright.operators import fuzzy

# Options of the form, the texts of its anchors, and patterns.
ALLERGIES = ["Penicillin", "Peanuts", "Latex", "Shellfish", "Pollen", "Dust", "None Known"]
SYMPTOMS = ["Fever", "Cough", "Headache", "Fatigue", "Shortness of breath", "Nausea", "Dizziness", "Chest pain"]
CLAIM_TYPES = ["Visit", "Procedure", "Medication", "Other"]
SEXES = ["Male", "Female", "Other"]
ANCHORS = {
    "at_sex": ("sex", "gender"), "at_smoker": ("smoker",), "at_diabetic": ("diabetic",), "at_work": ("is this work-related", "work-related", "work related"), "at_auto": ("auto accident", "motor vehicle", "mva"),
    "at_symptoms": ("current symptoms", "symptoms", "presenting symptoms", "symptom"), "at_allergies": ("allergies", "allergy", "known allergies", "check all that apply", "check all"),
}
READ_GLYPHS = r"^[\[(©®@O□■☐☑✓✗Xx\s.)\]]+"
CHOSEN_GLYPHS = r"^[\[\(C]*[XxKk✓☑][\]\)]*\s*|^\|[\|I!l]\|?\s*|^[J]\s+|^\[_\]\s*|^[☐☑✗✓]\s*"


def cleaned(text: str) -> str:
    """A text without what optical recognition reads from a box; its last word if that is an answer."""
    bare = f"regexp_replace(regexp_replace({text}, {P.quoted(READ_GLYPHS)}, ''), '^\\\\s+|\\\\s+$', '')"
    return f"case when {bare} rlike '(?i)\\\\s(yes|no|male|female|other)$' then regexp_extract({bare}, '(\\\\S+)$', 1) else {bare} end"


def _told(pages: DataFrame) -> DataFrame:
    """``pages`` with which allergies and symptoms each line is like, and which
    symptoms each label; a page read optically has lower thresholds."""
    options, n = ALLERGIES + SYMPTOMS, len(ALLERGIES)
    texts = pages.select(F.explode(F.concat("lines.text", "controls.label")).alias("text"))
    found = fuzzy.Pairs(fuzzy.alike(texts, options, 0.5))
    for name, texts, least in (("_a", "lines.text", 0.8), ("_a_read", "lines.text", 0.55), ("_s", "lines.text", 0.7), ("_s_read", "lines.text", 0.5), ("_label", "controls.label", 0.5)):
        pages = found.told(pages, texts, name, least)
    of = lambda name, test: f"transform({name}, ks -> transform(filter(ks, k -> k {test}), k -> {P.array(options)}[k]))"
    told = {"is_allergy": of("if(ocr, _a_read, _a)", f"< {n}"), "is_symptom": of("if(ocr, _s_read, _s)", f">= {n}"), "labels_symptom": of("_label", f">= {n}")}
    return P.staged(pages, told).drop("_a", "_a_read", "_s", "_s_read", "_label")


def anchored(pages: DataFrame, anchors: dict[str, tuple[str, ...]], threshold: float = 0.78) -> DataFrame:
    """``pages`` with a line for each name: by the longest text that any line
    has in any letter case, else by the longest, of four letters or more, that
    one nearly has."""
    exact = {f"_x_{n}": "coalesce(" + ", ".join(f"get(filter(lines, l -> contains(lower(l.text), {P.quoted(t)})), 0)" for t in P.variant(ts)) + ")" for n, ts in anchors.items()}
    near = P.anchored(P.staged(pages, exact), {f"_n_{n}": tuple(t for t in P.variant(ts) if len(t) >= 4) for n, ts in anchors.items() if any(len(t) >= 4 for t in ts)}, (), threshold)
    return P.staged(near, {n: f"coalesce(_x_{n}, {f'_n_{n}' if f'_n_{n}' in near.columns else 'null'})" for n in anchors}).drop(*exact, *(f"_n_{n}" for n in anchors))


def _band(a: str, dx: float = 320, dy: float = 28) -> str:
    """The boxes of an anchor's row and column half, from left to right."""
    side = f"(c.cx < mid) = (({a}.x0 + {a}.x1) / 2 < mid)"
    near = f"c.kind in ('checkbox', 'radio') and {side} and abs(c.cy - {a}.cy) <= {dy}D * tol and c.cx - {a}.x1 between -12D * tol and {dx}D * tol"
    return P.by(f"filter(controls, c -> {near})", "c.cx", value="c")


def _sex(row: str) -> dict[str, str]:
    names = P.array(SEXES)
    label = f"coalesce(nullif(c.label, ''), {_beside('c')})"
    placed = f"transform(filter(transform(array_sort({row}), (c, i) -> named_struct('c', c, 'i', i)), q -> q.c.selected and q.i < 3), q -> q.i)"
    by_label = f"get(filter({names}, o -> exists(controls, c -> c.label = o and c.selected and abs(c.cy - at_sex.cy) <= 30)), 0)"
    read = f"transform(filter({row}, c -> c.selected), c -> lower({cleaned('c.label')}))"
    return {
        "sex_1": f"get(filter(transform(filter({row}, c -> c.selected), c -> {label}), n -> array_contains({names}, n)), 0)", "sex_2": f"get({names}, get({placed}, 0))", "sex_3": f"case when at_sex is not null then {by_label} end",
        "sex_4": f"case when ocr then get(filter(transform({read}, n -> case when n in ('male', 'm') then 'Male' when n in ('female', 'f') then 'Female' end), n -> n is not null), 0) end",
        "sex_5": f"case when size({row}) > 0 and not exists({row}, c -> c.selected and array_contains({names}, c.label)) then 'Other' end",
    }


def _beside(c: str, dx: float = 60) -> str:
    """The nearest text right of a box in the nearest row of its anchor's column, if that is within 14 points."""
    rows = "if(at_sex.x0 < mid, left_rows, right_rows)"
    row = f"array_min(transform({rows}, (r, i) -> named_struct('d', abs(r.h - {c}.cy), 'i', i)))"
    near = f"filter(get({rows}, {row}.i).of, l -> l.x0 - {c}.cx between 0 and {dx}D)"
    return f"case when {row}.d <= 14 then array_min(transform({near}, l -> named_struct('dx', l.x0 - {c}.cx, 'i', l.i, 'said', l.said))).said end"


def _column_rows(test: str) -> str:
    """The rows of a column half, by height, each within 9 points of its row's mean so far."""
    none = f"cast(array() as array<struct<h:double,of:array<{P.LINE}>>>)"
    top = "try_element_at(rows, -1)"
    joined = f"named_struct('h', ({top}.h * size({top}.of) + l.cy) / (size({top}.of) + 1), 'of', concat({top}.of, array(l)))"
    step = f"case when abs(l.cy - {top}.h) <= 9 then concat(slice(rows, 1, size(rows) - 1), array({joined})) else concat(rows, array(named_struct('h', l.cy, 'of', array(l)))) end"
    return f"aggregate({P.by(f'filter(lines, l -> {test})', 'l.cy')}, {none}, (rows, l) -> {step})"


def _answer(a: str, dx: float, dy: float) -> str:
    """Whether yes or no is chosen in the row of boxes closest to an anchor."""
    others = P.array(ALLERGIES + SYMPTOMS + CLAIM_TYPES + SEXES)
    rows = P.clustered(f"filter({_band(a, dx, dy)}, c -> not array_contains({others}, c.label))", 6, "c", P.CONTROL)
    closest = f"array_min(transform({rows}, (r, i) -> named_struct('d', abs(r.h - {a}.cy), 'i', i, 'of', array_sort(r.of)))).of"
    return f"transform(array({closest}), r -> {P.yes_no('r', yes='c.label = ' + P.quoted('Yes'), no='c.label = ' + P.quoted('No'))})[0]"


def _boxed(line: str, same_side: str | None = None) -> str:
    side = "" if same_side is None else f"and (c.cx < mid) = ({same_side}.x0 < mid)"
    near = f"filter(controls, c -> abs(c.cy - {line}.cy) <= 12D * tol and {line}.x0 - c.cx between 0 and 35D * tol {side})"
    best = f"array_min(transform({near}, c -> named_struct('dx', {line}.x0 - c.cx, 'i', c.i, 'on', c.selected and coalesce(c.conf, 1) >= 0.51)))"
    return f"coalesce({best}.on, false)"


def intake(pages: DataFrame) -> DataFrame:
    """(page, sex, smoker, diabetic, work_related, auto_accident, allergies,
    symptoms, claim_type) of prepared pages, which may have ``width`` and
    ``text_source``; reach is wider where text was recognised optically."""
    for name, value in (("width", F.lit(612.0)), ("text_source", F.lit("native"))):
        if name not in pages.columns:
            pages = pages.withColumn(name, value)
    p = P.staged(anchored(pages, ANCHORS), {"mid": "coalesce(width, 612D) / 2", "ocr": "coalesce(text_source = 'ocr', false)"}, {"tol": "if(ocr, 1.8D, 1D)"})
    p = _told(p)
    listed = "filter(transform(lines, (l, i) -> named_struct('l', l, 'o', get(is_allergy[i], 0))), q -> q.o is not null and q.l.cy - at_allergies.cy between 4 and 220)"
    below = "filter(lines, l -> (l.cx < mid) = (at_symptoms.x0 < mid) and l.cy > at_symptoms.cy and array_contains(is_symptom[l.i], o))"
    symptom = f"transform({P.array(SYMPTOMS)}, o -> named_struct('o', o, 'l', get({P.by(below, 'l.y0')}, 0)))"
    by_label = lambda options, test: f"filter({P.array(options)}, o -> exists(controls, c -> c.label = o and c.selected {test}))"
    marked = lambda options, a: (
        f"array_sort(filter({P.array(options)}, o -> coalesce(get(filter(lines, l -> l.cy >= {a}.y0 and contains(lower(l.text), lower(o))), 0).said rlike {P.quoted(CHOSEN_GLYPHS)}, false)))"
    )
    p = P.staged(
        p, {"left_rows": _column_rows("l.cx < mid"), "right_rows": _column_rows("l.cx >= mid"), "r_sex": _band("at_sex", 320, 26), "at_claim": "get(filter(lines, l -> startswith(lower(l.said), 'claim type')), 0)"},
        _sex("r_sex") | {
            "smoker": _answer("at_smoker", 320, 26), "diabetic": _answer("at_diabetic", 320, 26), "work_related": _answer("at_work", 320, 26), "auto_accident": _answer("at_auto", 220, 20),
            "allergies_1": f"array_distinct(transform(filter({listed}, q -> {_boxed('q.l')}), q -> q.o))", "symptoms_1": f"transform(filter({symptom}, q -> q.l is not null and {_boxed('q.l', 'at_symptoms')}), q -> q.o)",
            "allergies_2": by_label(ALLERGIES, "and coalesce(c.conf, 1) >= 0.51"), "symptoms_2": f"filter({P.array(SYMPTOMS)}, o -> exists(controls, c -> c.selected and array_contains(labels_symptom[c.i], o)))",
            "allergies_3": f"if(ocr, {marked(ALLERGIES, 'at_allergies')}, array())", "symptoms_3": f"if(ocr, {marked(SYMPTOMS, 'at_symptoms')}, array())",
            "claim_1": f"get(filter({P.array(CLAIM_TYPES)}, o -> exists(controls, c -> c.label = o and c.selected and (c.cx < mid) = (at_claim.x0 < mid) and abs(c.cy - at_claim.cy) < 120 and c.cx - at_claim.x1 > -20 and c.cx - at_claim.x1 < 260)), 0)",
            "claim_2": f"get({by_label(CLAIM_TYPES, '')}, 0)",
        },
        {
            "sex": "coalesce(sex_1, sex_2, sex_3, sex_4, sex_5)", "claim_type": "coalesce(claim_1, claim_2)",
            **{x: f"case when size({x}_1) > 0 then {x}_1 when size({x}_2) > 0 then {x}_2 else {x}_3 end" for x in ("allergies", "symptoms")},
        },
    )
    return p.select("page", "sex", "smoker", "diabetic", "work_related", "auto_accident", "allergies", "symptoms", "claim_type")
