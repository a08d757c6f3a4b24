"""Scores of depression questionnaires."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leafwright.extractors import marks as M
from leafwright.extractors import page as P

# Items and answers of the form.
ITEMS, ANSWERS = 9, 4
TOTAL = r"(?i)total\s*score\s*:?\s*(\d{1,2})"


def answered(tolerance: float = 5) -> str:
    """Rows (h, score) of four boxes, from top to bottom, scored by their only selected one."""
    rows = P.clustered(P.by("filter(controls, c -> c.kind = 'checkbox')", "c.cy", value="c"), tolerance, "c", P.CONTROL)
    picked = "transform(array_sort(r.of), c -> c.selected)"
    score = f"case when size(filter(r.of, c -> c.selected)) = 1 then cast(array_position({picked}, true) as int) - 1 end"
    return f"array_sort(transform(filter({rows}, r -> size(r.of) = {ANSWERS}), (r, i) -> named_struct('h', r.h, 'i', i, 'score', {score})))"


def split(scores: str, rows: str = "answers") -> str:
    """Scores with the difficulty set apart: of ten rows of boxes or more,
    those after the largest gap, if it exceeds the upper median by half and
    leaves nine rows before it, give their first score alone."""
    gaps = f"transform(slice({rows}, 2, greatest(size({rows}) - 1, 0)), (r, i) -> named_struct('gap', r.h - {rows}[i].h, 'at', i + 1))"
    median = f"get(array_sort({gaps}), cast(floor((size({rows}) - 1) / 2) as int)).gap"
    # the first of equal gaps counts
    widest = f"array_max(transform({gaps}, g -> named_struct('gap', g.gap, 'first', -g.at)))"
    apart = f"size({scores}) >= {ITEMS} and size({rows}) >= 10 and {widest}.gap > {median} * 1.5 and -{widest}.first >= {ITEMS}"
    rest = f"slice(filter(transform(slice({rows}, 1 - {widest}.first, size({rows})), r -> r.score), s -> s is not null), 1, 1)"
    return f"case when {apart} then concat(slice({scores}, 1, -{widest}.first), {rest}) else {scores} end"


def printed_total() -> str:
    """The first total score from 0 to 27 that a line states."""
    value = f"try_cast(nullif(regexp_extract(l.text, {P.quoted(TOTAL)}, 1), '') as int)"
    return f"get(filter(transform(lines, l -> {value}), v -> v between 0 and 27), 0)"


def questionnaire(pages: DataFrame) -> DataFrame:
    """(page, extraction_mode, scores, total_computed, total_printed, total,
    difficulty) of prepared pages.  With ``drawings``, a page that has marks is
    scored by the digits that they touch."""
    marked = "drawings" in pages.columns
    p = P.staged(
        pages, {"answers": answered(), "marks": M.found() if marked else "cast(array() as array<int>)", "total_printed": printed_total()},
        {"read": f"case when size(marks) > 0 then {M.likert()} else transform(answers, r -> r.score) end" if marked else "transform(answers, r -> r.score)", "extraction_mode": "if(size(marks) > 0, 'marks', 'checkboxes')"},
        {"every": split("read")}, {"scores": f"case when size(every) >= {ITEMS} then slice(every, 1, {ITEMS}) end"},
        {"total_computed": "case when forall(scores, s -> s is not null) then aggregate(scores, 0, (a, s) -> a + s) end"}, {"total": "coalesce(total_printed, total_computed)"},
        # a tenth row that is there but unread leaves the difficulty open
        {"difficulty": f"case when size(every) > {ITEMS} then get(every, {ITEMS}) when total <= 4 then 0 when total <= 9 then 1 when total <= 14 then 2 when total > 14 then 3 end"},
    )
    return p.select("page", "extraction_mode", "scores", "total_computed", "total_printed", "total", "difficulty")
