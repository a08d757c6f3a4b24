"""Extracted records against the truth: fields, forms, everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.operators import compare, metrics

# The fields of each form type and how they are compared, and
# where the truth of intake forms keeps them.
FIELDS = {
    "medical": {"sex": "categorical", "smoker": "boolean", "diabetic": "boolean", "allergies": "set_partial", "symptoms": "set_partial"},
    "insurance": {"work_related": "boolean", "auto_accident": "boolean", "claim_type": "categorical"},
    "cms1500": {
        "insurance_type": "categorical", "patient_sex": "categorical", "relationship_to_insured": "categorical", "condition_employment": "boolean", "condition_auto": "boolean", "condition_other": "boolean", "diagnoses": "set",
        "total_charge": "numeric", "accept_assignment": "boolean", "tax_id_type": "categorical", "service_line_count": "numeric", "service_line_cpts": "set",
    },
    "phq9": {"scores": "sequence_partial", "total": "numeric", "difficulty": "numeric"},
    "hipaa": {"patient_name": "categorical", "date_range_from": "categorical", "date_range_to": "categorical", "record_types": "set", "excluded_categories": "set", "purposes": "set", "expiration_type": "categorical"},
    "froi": {
        "employee_name": "categorical", "employer_name": "categorical", "injury_date": "categorical", "on_premises": "boolean", "injured_body_parts": "set", "nature_of_injury": "categorical", "causes": "set", "treatments": "set",
    },
    "eob": {
        "payer_name": "categorical", "member_name": "categorical", "claim_number": "categorical", "check_number": "categorical", "service_line_count": "numeric_tolerant", "service_line_cpts": "set_partial",
        "total_billed": "numeric_tolerant", "total_allowed": "numeric_tolerant", "total_plan_paid": "numeric_tolerant", "total_patient_resp": "numeric", "reason_codes_used": "set",
    },
}
TRUTH_PATHS = {
    "sex": "$.person.sex", "smoker": "$.meta.smoker", "diabetic": "$.meta.diabetic", "allergies": "$.meta.allergies", "symptoms": "$.meta.symptoms", "work_related": "$.meta.work_related", "auto_accident": "$.meta.auto_accident",
    "claim_type": "$.meta.claim_type",
}
SYMPTOMS = ("Fever", "Cough", "Headache", "Fatigue", "Shortness of breath", "Nausea", "Dizziness", "Chest pain")
SETS = ("set", "set_partial")


def _codes(record: str) -> Column:
    lines = F.from_json(F.get_json_object(record, "$.service_lines"), "array<struct<cpt:string>>")
    return F.filter(F.transform(lines, lambda s: s["cpt"]), lambda c: c.isNotNull())


def _value(record: str, form: Column, field: str, truth: bool) -> Column:
    """A field of a JSON record, as text; lists are JSON."""
    plain = F.get_json_object(record, f"$.{field}")
    if field == "service_line_count":
        n = F.size(_codes(record)) if truth else F.nullif(F.size(_codes(record)), F.lit(0))
        return F.when(form == "cms1500", (F.coalesce(n, F.lit(0)) if truth else n).cast("string")).otherwise(plain)
    if field == "service_line_cpts":
        return F.when(form == "cms1500", F.to_json(F.coalesce(_codes(record), F.array().cast("array<string>")))).otherwise(plain)
    if truth and field in TRUTH_PATHS:
        at = F.get_json_object(record, TRUTH_PATHS[field])
        if field == "symptoms":
            names = F.array(*map(F.lit, SYMPTOMS))
            return F.to_json(F.transform(F.coalesce(F.from_json(at, "array<int>"), F.array().cast("array<int>")), lambda i: F.get(names, i)))
        return F.coalesce(at, F.lit("[]")) if field == "allergies" else at
    return plain


def paired(records: DataFrame, truths: DataFrame) -> DataFrame:
    """(file, form_type, field, compared, predicted, truth) of each field that
    counts for a form: records (file, form_type, record) joined with truths
    (file, form_type, truth) by file and type."""
    both = truths.join(records.select("file", "form_type", "record"), ["file", "form_type"])
    form = F.col("form_type")
    rows = [
        F.when(form == kind, F.struct(F.lit(field).alias("field"), F.lit(how).alias("compared"), _value("record", form, field, False).alias("predicted"), _value("truth", form, field, True).alias("truth")))
        for kind, fields in FIELDS.items() for field, how in fields.items()
    ]
    return both.select("file", "form_type", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("file", "form_type", "f.*")


def judged(pairs: DataFrame) -> DataFrame:
    """Pairs (compared, predicted, truth) with ``correct``, ``missed``, and the
    set scores of sets."""
    p, t, how = F.col("predicted"), F.col("truth"), F.col("compared")
    missed = p.isNull() & t.isNotNull()
    sets = [F.from_json(c, "array<string>") for c in (p, t)]
    rows = [F.from_json(c, "array<string>") for c in (p, t)]
    x, y = p.try_cast("double"), t.try_cast("double")
    precision, recall, f1 = metrics.set_scores(*sets)
    empty = F.coalesce(F.size(sets[1]), F.lit(0)) == 0
    correct = (
        F.when(how == "categorical", metrics.categorical_match(p, t)).when(how == "boolean", ~missed & compare.boolean_match(p.try_cast("boolean"), t.try_cast("boolean"))).when(how == "set", f1 >= 1.0).when(how == "set_partial", f1 >= 0.5)
        .when(how == "numeric", compare.numeric_match(x, y)).when(how == "numeric_tolerant", compare.tolerant_match(x, y)).when(how == "sequence", compare.sequence_match(*rows)).when(how == "sequence_partial", compare.sequence_match(*rows, 0.7))
        .otherwise(p.eqNullSafe(t))
    )
    is_set = how.isin(*SETS)
    return pairs.withColumns({
        "correct": correct, "missed": F.when(how.isin(*SETS, "sequence", "sequence_partial"), p.isNull() & ~empty).otherwise(missed),
        "precision_": F.when(is_set, precision), "recall": F.when(is_set, recall), "f1": F.when(is_set, f1),
    })


def by_field(results: DataFrame) -> DataFrame:
    """Per field of judged results (with ``confidence`` or without): counts,
    rates, mean set scores of sets, mean confidences of right and wrong."""
    conf = F.col("confidence") if "confidence" in results.columns else F.lit(None).cast("double")
    right, wrong = F.col("correct") & ~F.col("missed"), ~F.col("correct") & ~F.col("missed")
    g = results.groupBy("field").agg(
        F.count("*").alias("total"), F.count_if(right).alias("correct"), F.count_if(wrong).alias("wrong"), F.count_if("missed").alias("missing"), *(F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("precision_", "recall", "f1")),
        F.round(F.avg(F.when(right, conf)), 4).alias("mean_conf_correct"), F.round(F.avg(F.when(wrong, conf)), 4).alias("mean_conf_wrong"),
    )
    rate = lambda c: F.round(F.col(c) / F.col("total"), 4)
    return g.withColumns({"accuracy": rate("correct"), "miss_rate": rate("missing"), "error_rate": rate("wrong")})


def by_file(results: DataFrame) -> DataFrame:
    """(file, form_type, accuracy, missed_fields, wrong_fields) of each form."""
    names = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("field"))))
    return results.groupBy("file", "form_type").agg(
        F.round(F.count_if("correct") / F.count("*"), 4).alias("accuracy"), names(F.col("missed")).alias("missed_fields"), names(~F.col("correct") & ~F.col("missed")).alias("wrong_fields"),
    )


def overall(results: DataFrame) -> DataFrame:
    """One row: forms, forms with errors, accuracy and miss rate of all fields."""
    f = results.groupBy("file", "form_type").agg(F.count("*").alias("n"), F.count_if("correct").alias("ok"), F.count_if("missed").alias("gone"))
    rate = lambda c: F.coalesce(F.round(F.sum(c) / F.nullif(F.sum("n"), F.lit(0)), 4), F.lit(0.0))
    return f.agg(F.count("*").alias("total_forms"), F.count_if(F.col("ok") < F.col("n")).alias("forms_with_errors"), rate("ok").alias("overall_accuracy"), rate("gone").alias("overall_miss_rate"))


def report(results: DataFrame, worst: int = 5) -> str:
    """The figures as text for a terminal: totals, fields, the worst forms short of perfect."""
    o = overall(results).first()
    lines = [f"Forms: {o['total_forms']}  with errors: {o['forms_with_errors']}", f"Accuracy: {o['overall_accuracy']:.1%}  missed: {o['overall_miss_rate']:.1%}", ""]
    # one row a field, and ``worst`` forms
    lines += [f"{r['field']:<28}{r['accuracy']:>8.1%}{r['correct']:>7}/{r['total']}" for r in by_field(results).orderBy("field").collect()]
    bad = by_file(results).where("accuracy < 1").orderBy("accuracy", "file").limit(worst).collect()
    return "\n".join([*lines, *(f"{r['file']}: {r['accuracy']:.1%} missed {','.join(r['missed_fields'])} wrong {','.join(r['wrong_fields'])}" for r in bad)])


def comparison(change: DataFrame, accuracy: float, before: float = 0.0) -> str:
    """Accuracies against those of an earlier run, all fields' first, as text."""
    line = lambda name, old, new: f"{name:<28}{old:>8.1%} -> {new:.1%} ({new - old:+.1%})"
    shown = change.orderBy("field").collect()  # one row a field
    return "\n".join([line("overall", before, accuracy), *(line(r["field"], r["before"], r["accuracy"]) for r in shown)])
