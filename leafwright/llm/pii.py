"""Personal data by weak supervision.

Strict patterns find e-mail addresses, IP addresses, payment cards and phone
numbers (``base_spans``); these always stand.  Looser patterns propose further
spans: local phone numbers, national ids, bank accounts, secrets, written-out
addresses and names (``_LOOSE``).  Labelers vote on each proposal (+1 personal, -1
not, 0 abstain): its shape, a gazetteer, the words before it, and how it is
bounded.  Expectation-maximisation over the counts of all vote patterns in the
corpus estimates how reliable each labeler is; its posteriors weigh the
training of a logistic span classifier on the votes and the kind, which alone
decides.

A null text is an empty one and has no spans, an empty table gives no rows,
further columns are not read (``redact`` carries them).  Spans are in code
points, end exclusive.  Names are of any alphabet that has capitals, with marks,
hyphens and apostrophes.  Rows are judged one by one; what is collected is one count per
kind and vote pattern, of which there are few.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.llm import store
from leafwright.llm.textscan import tidy

BASE = ("email", "ip", "card", "phone")
# The tail of an address; the part before is read backwards from the sign, in linear time.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed in ``BASE``, then start."""
    out, done = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                done = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _class(test: Callable[[str], bool]) -> str:
    """The inside of a character class: the ranges of letters that pass a test."""
    points = [p for p in range(0x1E943 + 1) if test(chr(p))]
    starts = [p for k, p in enumerate(points) if k == 0 or points[k - 1] != p - 1]
    ends = [p for k, p in enumerate(points) if k + 1 == len(points) or points[k + 1] != p + 1]
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in zip(starts, ends, strict=True))


_UPPER = f"[{_class(lambda c: c.isupper() or c.istitle())}]"
# what follows in a name: letters that aren't capitals, and marks that stand by themselves
_LOWER = f"[{_class(lambda c: c.isalpha() and not c.isupper() and not c.istitle())}\u0300-\u036f]"
_NAME = rf"(?:[DLO]['’])?{_UPPER}{_LOWER}++(?:[-'’]{_UPPER}{_LOWER}++)*+"

_LOOSE = {
    "local_phone": re.compile(r"(?:\([0-9]{3}\)\x20?|\b[0-9]{3}[-.\x20])[0-9]{3}[-.][0-9]{4}\b"),
    "national_id": re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
    "secret": re.compile(r"\b(?:password|passwd|pwd|secret|token|api_key|apikey|access_key)\x20?[=:]\x20?\S{6,}+|\bAKIA[A-Z0-9]{16}\b"),
    "spelled_email": re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,}+(?![A-Za-z0-9_])"),
    "name": re.compile(rf"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20{_NAME}(?:\x20{_NAME})?(?!\w)"),
}
#: A text without any of these has no proposal.
_HINT = re.compile(r"[0-9]{4}|[=:\[(]|\bAKIA|\b[A-Z]{2}[0-9]{2}[\x20A-Z0-9]|\b(?:M[rs]|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor)")
# Gazetteers: given names of several languages, and top-level domains.
_GIVEN = frozenset("""
    adam alan albert alex alice amelie amy ana andrea andrew angela anna anne annette antonio barbara ben bernd brian camille carla carlos carmen caroline catherine charles charlotte christian christine claire clara claude
    daniel david diego dieter elena elizabeth emil emily emma erik eva felix fernando francisco frank franz fritz george greta hans heinz helen helga henri henry hugo ines ingrid isabel jack jacques james jan jane jean
    jennifer jens joan john jorge jose joseph juan julia julie jürgen karen karin karl katrin kevin klaus laura lena leo lin linda louis louise lucas lucia luis manuel marc margaret maria marie mario mark marta martin mary
    max michael miguel monika nancy nicolas nina olga oliver oscar pablo patricia patrick paul pedro peter petra philip pierre rachel rafael richard rita robert rosa ruth sabine sandra sarah simon sofia sophie stefan susan
    sylvia teresa thomas ursula uwe victor walter werner william wolfgang
""".split())  # fmt: skip


def _folded(text: str) -> str:
    """Letters in lower case without their marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


_GIVEN = frozenset(map(_folded, _GIVEN))
_DOMAINS = frozenset("ai at au be biz br ca ch cn co com cz de dev dk edu es eu fi fr gov gr hu ie in info int io it jp kr mil mx net nl no nz org pl pt ro ru se tr uk us".split())
_FOR = re.compile(r"\b(?:call|phone|tel|fax|mobile|contact|ssn|social|id|iban|account|bank|mail|email|login|user|password|key|name|dear|by)\b[^.\n]{0,20}$", re.I)
_AGAINST = re.compile(r"\b(?:isbn|issn|version|order|invoice|serial|part|ref|figure|chapter|example)\b[^.\n]{0,20}$", re.I)
LABELERS = ("shape", "gazetteer", "context", "bounds")
KINDS = tuple(_LOOSE)


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """The labelers' votes on a proposed span."""
    span, lead = text[start:end], text[max(0, start - 40) : start]
    digits = "".join(_DIGIT.findall(span))
    if kind == "national_id":
        shape = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "local_phone":
        shape = 1 if digits[0] not in "01" else -1
    elif kind == "iban":
        shape = 1 if _iban(span.replace(" ", "")) else -1
    elif kind == "secret":
        value = re.split(r"[=:]", span, maxsplit=1)[-1].strip()
        shape = 1 if _DIGIT.search(value) and re.search("[A-Za-z]", value) else -1
    else:
        shape = 0
    gazetteer = 0
    if kind == "name":
        gazetteer = 1 if _GIVEN & set(re.split(r"[\s'’-]", _folded(span))) else 0
    elif kind == "spelled_email":
        gazetteer = 1 if re.split(r"[\])\x20]", span)[-1].lower() in _DOMAINS else -1
    context = -1 if _AGAINST.search(lead) else 1 if _FOR.search(lead) or kind in ("secret", "name") else 0
    near = text[max(0, start - 1) : start] + text[end : end + 1]
    return shape, gazetteer, context, -1 if re.search(r"[\w/=-]", near) else 1


#: Cuts between lengths of spans, and between shares of digits.
_LENGTHS, _SHARES = (8, 12, 16, 24, 40), (0.01, 0.35, 0.7, 0.95)
FEATURES = ("length", "digits", "case", "before", "opening", "after", "position")


def features(text: str, start: int, end: int) -> tuple[int, ...]:
    """What the classifier sees of a span and its surroundings, in few levels
    each: length, share of digits, mix of cases, the sign before it, whether
    its line begins with it, the sign after it, and the third of the text."""
    span = text[start:end]
    lead, tail = text[max(0, start - 2) : start].rstrip(" "), text[end : end + 1]
    share = sum(c.isdigit() for c in span) / len(span)
    case = 2 * any(c.isupper() for c in span) + any(c.islower() for c in span)
    return (
        sum(len(span) >= n for n in _LENGTHS), sum(share >= x for x in _SHARES), case, 1 if lead[-1:] in (":", "=") else 2 if lead[-1:] in ("(", "[", "<", "\"") else 3 if lead[-1:] in (",", ";", ".") else 0,
        int(start == 0 or text[start - 1] == "\n"), 1 if tail in ("", "\n") else 2 if tail in ".,;:)" else 0, min(2, 3 * start // max(1, len(text))),
    )


def _iban(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def proposals(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, tuple[int, ...], tuple[int, ...]]]:
    """Loose spans outside the base ones, with their votes and features."""
    out, taken = [], sorted((s, e) for _, s, e in base)
    if not _HINT.search(text):
        return out
    starts = np.array([s for s, _ in taken])
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else starts
    for kind, pattern in _LOOSE.items():
        for m in pattern.finditer(text):
            k = int(np.searchsorted(starts, m.end())) if taken else 0
            if k == 0 or reach[k - 1] <= m.start():
                out.append((kind, m.start(), m.end(), votes(kind, text, m.start(), m.end()), features(text, m.start(), m.end())))
    return out


Pattern = tuple[str, tuple[int, ...], tuple[int, ...]]


def fit(counts: dict[Pattern, int], rounds: int = 40, prior: float = 1.0) -> dict[Pattern, float]:
    """Probability of being personal for each (kind, votes, features) seen.

    EM starts from the balance of votes; labelers are independent given the
    class.  The classifier is logistic in the kind, each labeler's two votes
    and the levels of the features, fitted by gradient steps to the
    posteriors, each pattern weighing its count: it so learns from spans on
    which labelers agree what the others look like.
    """
    if not counts:
        return {}
    seen = sorted(counts)
    n = np.array([counts[s] for s in seen], float)
    v = np.array([s[1] for s in seen]) + 1
    post = 1 / (1 + np.exp(-2.0 * (v - 1).sum(1)))
    for _ in range(rounds):
        held = np.stack([n * (1 - post), n * post])
        score = np.log(held.sum(1) + prior)[:, None] * np.ones(len(seen))
        for k in range(v.shape[1]):
            # before any data, a labeler is right three times in four when it votes
            seen_k = np.stack([held[:, v[:, k] == x].sum(1) for x in range(3)], 1) + prior * np.array([[3, 2, 1], [1, 2, 3]])
            score += np.log(seen_k / seen_k.sum(1, keepdims=True))[:, v[:, k]]
        post = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
    levels = np.array([s[2] for s in seen])
    shown = [levels[:, k, None] == np.unique(levels[:, k])[None] for k in range(levels.shape[1])]
    x = np.hstack([np.ones((len(seen), 1)), np.array([[s[0] == k for k in KINDS] for s in seen]), v == 0, v == 2, *shown]).astype(float)
    w, total = np.zeros(x.shape[1]), n.sum()
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= 0.3 * (x.T @ (n * (p - post)) / total + 1e-4 * w)
    return dict(zip(seen, (1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))).tolist(), strict=True))


_SPAN = "array<struct<kind:string,start:int,end:int,votes:string>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string())]))


def candidates(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns, base spans and proposals of every text."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for scalar in batch.column(len(carry)):
                text = scalar.as_py() or ""
                found = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e, "votes": ""} for k, s, e in found])
                more.append([{"kind": k, "start": s, "end": e, "votes": _shown(x, y)} for k, s, e, x, y in proposals(text, found)])
            cols = [*(batch.column(i) for i in range(len(carry))), pa.array(base, _SPAN_ARROW), pa.array(more, _SPAN_ARROW)]
            yield pa.RecordBatch.from_arrays(cols, [*carry, "base", "more"])

    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(tidy(run), ", ".join([*kinds, f"base {_SPAN}", f"more {_SPAN}"]))


def model(found: DataFrame) -> list[str]:
    """The ``kind|votes;features`` that the classifier accepts, from all
    candidates; what is collected is the patterns seen, of a few levels each."""
    rows = found.select(F.explode("more").alias("s")).groupBy("s.kind", "s.votes").count().collect()
    split = lambda t: tuple(tuple(map(int, part.split(","))) for part in t.split(";"))
    counts = Counter({(r[0], *split(r[1])): r[2] for r in rows})
    return [f"{kind}|{_shown(v, f)}" for (kind, v, f), p in fit(counts).items() if p >= 0.5]


def _shown(votes: tuple[int, ...], levels: tuple[int, ...]) -> str:
    return ";".join(",".join(map(str, x)) for x in (votes, levels))


def spans(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns, ``base`` and ``spans`` (all, by kind, then start)."""
    found = store.cut(candidates(docs, carry, text_col), "pii")
    accepted = model(found)
    good = F.create_map(*(F.lit(x) for p in accepted for x in (p, True))) if accepted else F.create_map().cast("map<string,boolean>")
    kept = F.filter("more", lambda s: F.coalesce(F.try_element_at(good, F.concat_ws("|", s["kind"], s["votes"])), F.lit(False)))
    return found.select(*carry, "base", F.concat("base", kept).alias("spans"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans); the
    counts of kinds and the checksum are of the base spans, the last of all."""
    found = spans(docs, [id_col], text_col)

    def shown(col: str) -> Column:
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col(id_col), *map(number, BASE), F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; spans
    that overlap become one.  A text without spans stays as it is."""
    good = set(model(store.cut(candidates(docs, [], text_col), "pii")))
    # columns go by numbers, as the names of some can't be given to mapInArrow
    at, names = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else _masked(t, good) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names)

    return docs.toDF(*names).mapInArrow(tidy(run), kinds).toDF(*docs.columns)


def _masked(text: str, good: set[str]) -> str:
    base = base_spans(text)
    more = [(k, s, e) for k, s, e, v, f in proposals(text, base) if f"{k}|{_shown(v, f)}" in good]
    out, done = [], 0
    for kind, start, end in sorted([*base, *more], key=lambda x: (x[1], -x[2])):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])
