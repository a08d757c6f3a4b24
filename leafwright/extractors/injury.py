"""Fields of first reports of injury."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leafwright.extractors import ink
from leafwright.extractors import page as P
from leafwright.extractors.authorization import chosen
from leafwright.extractors.benefits import DATE

# Options of the form; parts of the body, and those with two sides.
BODY_PARTS = [
    "Head", "Eye", "Ear", "Face", "Neck", "Shoulder", "Upper Arm", "Elbow", "Forearm", "Wrist", "Hand", "Fingers", "Chest", "Back-Upper", "Back-Lower", "Abdomen", "Hip", "Thigh", "Knee", "Lower Leg", "Ankle", "Foot",
    "Toes", "Internal", "Multiple",
]
TWO_SIDED = ["Eye", "Ear", "Shoulder", "Upper Arm", "Elbow", "Forearm", "Wrist", "Hand", "Fingers", "Hip", "Thigh", "Knee", "Lower Leg", "Ankle", "Foot", "Toes"]
NATURES = ["Strain/Sprain", "Fracture", "Laceration", "Contusion", "Burn", "Dislocation", "Puncture", "Concussion", "Other"]
CAUSES = ["Fall - Same Level", "Fall - From Height", "Struck By Object", "Struck Against Object", "Caught In/Between", "Repetitive Motion", "Lifting", "Motor Vehicle", "Chemical Exposure", "Other"]
TREATMENTS = ["First Aid Only", "Clinic/Doctor Visit", "Emergency Room", "Hospitalized", "None"]
SECTIONS = {"at_body": ("body parts injured",), "at_nature": ("nature of injury",), "at_cause": ("cause of injury",), "at_treat": ("treatment received",)}
ANCHORS = {"at_name": ("employee name",), "at_firm": ("employer name",), "at_injury": ("date of injury",), "at_site": ("on employer premises",), **SECTIONS}


def section_end(start: str, following: list[str]) -> str:
    """Where a section ends: at the highest following section below its start."""
    tops = f"filter(array({', '.join(f'{a}.y0' for a in following)}), y -> y > {start}.y1 and y < 99999)"
    return f"coalesce(array_min({tops}), 99999D)"


def _by_ink(pages: DataFrame) -> DataFrame:
    """What boxes left open on pages read optically, by the ink left of the answers' and options' texts."""
    p = ink.yes_or_no(ink.only_scanned(pages), "_by_on_premises", "on employer premises")
    p = ink.marked_options(p, "_natures", NATURES, either=False)
    p = ink.marked_options(p, "_by_causes", CAUSES, "cause of injury", either=False)
    p = ink.marked_options(p, "_by_treatments", TREATMENTS, "treatment received", either=False)
    p = P.staged(p, {"_by_nature_of_injury": "get(_natures, 0)", "_by_causes": "array_sort(_by_causes)", "_by_treatments": "array_sort(_by_treatments)"})
    return ink.filled_in(p, "on_premises", "nature_of_injury", "causes", "treatments")


def injury(pages: DataFrame, threshold: float | None = 0.78) -> DataFrame:
    """(page, employee_name, employer_name, injury_date, on_premises,
    injured_body_parts, nature_of_injury, causes, treatments) of prepared pages."""
    p = P.anchored(pages, ANCHORS, (), threshold)
    ends = {
        "end_body": section_end("at_body", ["at_nature", "at_cause", "at_treat"]), "end_nature": section_end("at_nature", ["at_cause", "at_treat"]), "end_cause": section_end("at_cause", ["at_treat"]),
        "r_site": P.row("at_site.cy", 7, "at_site.x1 - 5", "at_site.x1 + 200", "c.kind = 'checkbox'"),
    }

    # the lines of each section, in which its options are looked for, and the boxes in any such line's band
    places = {"body": ("at_body.y1", "end_body"), "nature": ("at_nature.y1", "end_nature"), "cause": ("at_cause.y1", "end_cause"), "treat": ("at_treat.y1", "at_treat.y1 + 100")}
    sections = {f"l_{n}": f"filter(lines, l -> l.cy between {y0} and {y1})" for n, (y0, y1) in places.items()}
    sections |= {f"c_{n}": f"filter(controls, c -> c.kind = 'checkbox' and c.cy between {y0} - 9 and {y1} + 9)" for n, (y0, y1) in places.items()}

    def labelled(within: str) -> str:
        return f"get(filter({within}, l -> lower(l.said) = lower(o) or contains(concat(' ', lower(l.text), ' '), concat(' ', lower(o)))), 0)"

    nearest = {n: P.box_left("q.l", 20, 7, among=f"c_{n}") for n in ("nature", "cause", "treat")}
    beside = "transform(" + P.by("filter(c_body, c -> abs(c.cy - q.l.cy) <= 6 and c.cx between q.l.x1 and q.l.x1 + 120)", "c.cx", value="c") + ", c -> c.selected)"
    lined = f"filter(transform({P.array(BODY_PARTS)}, o -> named_struct('o', o, 'l', get(filter(l_body, l -> l.said = o), 0))), q -> q.l is not null)"
    sides = f"case when array_contains({P.array(TWO_SIDED)}, q.o) then case when size(q.s) >= 2 then concat(if(q.s[0], array(concat(q.o, '-L')), array()), if(q.s[1], array(concat(q.o, '-R')), array())) else array() end when get(q.s, 0) then array(q.o) else array() end"
    natures = f"transform({P.array(NATURES)}, o -> named_struct('o', o, 'l', {labelled('l_nature')}))"
    p = P.staged(p, ends, sections, {
        "employee_name": f"regexp_replace({P.text_right('at_name', 300, 5)}, ':+$', '')", "employer_name": f"regexp_replace({P.text_right('at_firm', 300, 5)}, ':+$', '')",
        "injury_date": f"get(filter(transform(filter(lines, l -> abs(l.cy - at_injury.cy) <= 4 and l.x0 >= at_injury.x1), l -> nullif(regexp_extract(l.text, {P.quoted(DATE)}, 1), '')), d -> d is not null), 0)",
        "on_premises": P.yes_no("r_site", "startswith(lower(c.label), 'yes')", "startswith(lower(c.label), 'no')"),
        "injured_body_parts": f"array_sort(flatten(transform(transform({lined}, q -> named_struct('o', q.o, 's', {beside})), q -> {sides})))",
        "nature_of_injury": f"get(filter({natures}, q -> q.l is not null and coalesce({nearest['nature']}.selected, false)), 0).o",
        "causes": chosen(CAUSES, labelled("l_cause"), nearest["cause"]), "treatments": chosen(TREATMENTS, labelled("l_treat"), nearest["treat"]),
    })
    if ink.scanned(p):
        p = _by_ink(p)
    return p.select("page", "employee_name", "employer_name", "injury_date", "on_premises", "injured_body_parts", "nature_of_injury", "causes", "treatments")
