"""The document store: records to tables and back, searches, batch reports.

Rows are appended under the name of their writer, and a row of the ledger
(``commits``), written last, makes them count: the tables that are read are
views of the rows whose writer is the first of its batch there.  What a batch
is, and its ids, come from its contents alone.  So a writer that fails leaves
nothing to be seen, one that repeats a batch finds it stored, and of two that
write the same at once one counts, with the same ids whichever it is.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.operators.relational import NO_FIELDS
from leafwright.sources import shared

#: The store's tables.
SCHEMAS = {
    "documents": "id long, file_path string, file_name string, form_type string, confidence double, extracted_at string, processing_time_ms double, raw_json string, digest string",
    "fields": "document_id long, field_name string, field_value string, field_type string",
    "service_lines": "document_id long, line_number int, cpt_code string, date_of_service string, pos string, charge double, units int, reason_codes string",
    "diagnoses": "document_id long, icd10_code string, position int",
    "page_index": "bundle string, start_page int, end_page int, provider string, date_of_service string, doc_type string, page_count int, indexed_at string, digest string",
}
#: A batch's ids begin at a multiple of two to this power, which its contents choose.
RANGE_BITS = 25


def create_tables(spark: SparkSession, database: str) -> None:
    """The tables as Parquet in the session's warehouse, as views of committed rows."""
    spark.sql(f"create database if not exists {database}")
    spark.sql(f"create table if not exists {database}.commits (kind string, batch string, base long, n long, writer string) using parquet partitioned by (writer)")
    for name, columns in SCHEMAS.items():
        spark.sql(f"create table if not exists {database}.{name}_rows ({columns}, writer string) using parquet partitioned by (writer)")
        counted = f"select min(writer) from {database}.commits group by kind, batch"
        spark.sql(f"create or replace view {database}.{name} as select {', '.join(c.split()[0] for c in columns.split(', '))} from {database}.{name}_rows where writer in ({counted})")


def append(rows: DataFrame, database: str, table: str, writer: str) -> None:
    """Add a writer's rows to a table by column name; columns they lack are null."""
    kinds = [x.split() for x in SCHEMAS[table].split(", ")]
    known = set(rows.columns)
    _write(rows.select(*(F.col(c).cast(t).alias(c) if c in known else F.lit(None).cast(t).alias(c) for c, t in kinds)), f"{database}.{table}_rows", writer)


def _write(rows: DataFrame, table: str, writer: str) -> None:
    """A writer's rows as a partition in a folder of its own: writers into one folder would remove each other's files."""
    spark = rows.sparkSession
    path = spark.sql(f"describe formatted {table}").where("col_name = 'Location'").first()["data_type"] + f"/writer={writer}"
    rows.write.parquet(path)
    spark.sql(f"alter table {table} add partition (writer = '{writer}') location '{path}'")


def _new(rows: DataFrame, database: str, table: str, content: list[str]) -> tuple[DataFrame, str, int] | None:
    """The distinct rows by ``content`` that a table lacks, with their digest and
    place ``nth`` in its order; the name of the batch, and their number."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    have = rows.sparkSession.table(f"{database}.{table}").select("digest")
    fresh = rows.withColumn("digest", digest).dropDuplicates(["digest"]).join(have, "digest", "left_anti")
    part, at = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")
    staged = shared.cut(fresh.repartitionByRange("digest").sortWithinPartitions("digest").select("*", part, at), "staged")
    found = staged.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x")).collect()  # one row a task
    if not found:
        return None
    before, total, mixed = {}, 0, 0
    for r in sorted(found):
        before[r["part"]], total, mixed = total, total + r["n"], mixed ^ r["x"]
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("part"))
    return staged.withColumn("nth", offset.cast("long") + F.col("at")).drop("part", "at"), f"{mixed & (1 << 64) - 1:016x}-{total}", total


def _commit(spark: SparkSession, database: str, kind: str, batch: str, base: int, n: int, writer: str) -> None:
    _write(spark.createDataFrame([(kind, batch, base, n)], "kind string, batch string, base long, n long").coalesce(1), f"{database}.commits", writer)


def _base(spark: SparkSession, database: str, batch: str, n: int) -> int:
    """Where a batch's ids begin: told by its name, beyond ranges that others have."""
    taken = spark.table(f"{database}.commits").where((F.col("kind") == "documents") & (F.col("batch") != batch))
    at = int(batch[:9], 16) << RANGE_BITS
    while (clash := taken.where((F.col("base") < at + n) & (F.col("base") + F.col("n") > at)).agg(F.max(F.col("base") + F.col("n"))).first()[0]) is not None:
        at = -(-clash >> RANGE_BITS) << RANGE_BITS
    return at


def record_fields(records: DataFrame) -> DataFrame:
    """(document_id, field_name, field_value, field_type) of JSON records (id,
    record), one row per key but those of ``NO_FIELDS``; nested values are JSON."""
    # the variant tells types, the map keeps nested values as they are written
    r = records.select(F.col("id").alias("document_id"), F.expr("parse_json(record)").alias("v"), F.from_json("record", "map<string,string>").alias("texts"))
    e = r.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.expr("schema_of_variant(value)")
    typed = F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), "json").when(kind == "BOOLEAN", "boolean").when(kind.isin("STRING", "VOID"), "text").otherwise("numeric")
    shown = F.when(typed == "json", F.try_element_at("texts", F.col("key"))).when(typed == "boolean", F.initcap(F.expr("cast(value as string)"))).otherwise(F.expr("cast(value as string)"))
    return e.where(~F.col("key").isin(*NO_FIELDS)).select("document_id", F.col("key").alias("field_name"), shown.alias("field_value"), typed.alias("field_type"))


def record_lines(records: DataFrame) -> DataFrame:
    """(document_id, line_number, ...) of the service lines of JSON records (id, record)."""
    line = "array<struct<date_from:string,date_of_service:string,cpt:string,pos:string,charge:double,units:int,reason_codes:array<string>,reason:array<string>>>"
    e = records.select(F.col("id").alias("document_id"), F.posexplode(F.from_json(F.get_json_object("record", "$.service_lines"), line)).alias("at", "s")).where("s is not null")
    date = F.coalesce(F.nullif("s.date_from", F.lit("")), F.col("s.date_of_service"))
    return e.select(
        "document_id", (F.col("at") + 1).alias("line_number"), F.col("s.cpt").alias("cpt_code"), date.alias("date_of_service"), F.col("s.pos").alias("pos"), F.col("s.charge").alias("charge"), F.col("s.units").alias("units"),
        F.to_json(F.coalesce("s.reason_codes", "s.reason", F.array().cast("array<string>"))).alias("reason_codes"),
    )


def record_codes(records: DataFrame) -> DataFrame:
    """(document_id, icd10_code, position) of JSON records (id, record)."""
    return explode_diagnoses(records.select("id", F.from_json(F.get_json_object("record", "$.diagnoses"), "array<string>").alias("diagnoses"))).withColumnRenamed("id", "document_id")


def store_extractions(extractions: DataFrame, database: str, at: str | None = None) -> DataFrame:
    """Add extractions (file, form_type, confidence, record[, ms]) to the four
    tables of a database and return those that it had not, with their ids.  A
    file with the same record is stored once, whoever stores it how often."""
    spark = extractions.sparkSession
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if at is None else F.lit(at)
    ms = F.col("ms") if "ms" in extractions.columns else F.lit(None).cast("double")
    rows = extractions.select(F.col("file").alias("file_path"), base_name(F.col("file")).alias("file_name"), "form_type", "confidence", ms.alias("processing_time_ms"), now.alias("extracted_at"), F.col("record").alias("raw_json"))
    new = _new(rows, database, "documents", ["file_path", "form_type", "raw_json"])
    if new is None:
        return spark.table(f"{database}.documents").where("false")
    rows, batch, n = new
    writer, base = uuid.uuid4().hex, _base(spark, database, batch, n)
    numbered = rows.withColumn("id", F.col("nth") + base)
    records = numbered.select("id", F.col("raw_json").alias("record"))
    append(numbered, database, "documents", writer)
    append(record_fields(records), database, "fields", writer)
    append(record_lines(records), database, "service_lines", writer)
    append(record_codes(records), database, "diagnoses", writer)
    _commit(spark, database, "documents", batch, base, n, writer)
    return spark.table(f"{database}.documents").where(F.col("id").between(base, base + n - 1))


def store_index(segments: DataFrame, database: str, at: str | None = None) -> None:
    """Add the segments that are no separators or covers to a database's index, each once."""
    spark = segments.sparkSession
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if at is None else F.lit(at)
    kept = segments.where(~F.col("doc_type").isin("Cover Sheet", "Separator")).withColumn("date_of_service", F.col("dos")).withColumn("indexed_at", now)
    new = _new(kept, database, "page_index", ["bundle", "start_page", "end_page", "provider", "date_of_service", "doc_type"])
    if new is not None:
        rows, batch, n = new
        writer = uuid.uuid4().hex
        append(rows, database, "page_index", writer)
        _commit(spark, database, "page_index", batch, 0, n, writer)


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


# Keys of a record that its display leaves out.
NOT_SHOWN = (
    "form_type", "extraction_mode", "stats", "enriched_via_generic", "marks_detected", "overlays_detected", "key_value_pairs", "selected_controls", "acroform_fields", "entities", "dates", "tables", "section_headers",
)


def shown_fields(records: DataFrame) -> DataFrame:
    """(id, name, value) of JSON records (id, record) as an index shows them:
    pairs, plain fields and lists of texts, codes and numbers, dates by their
    context; of a name told several times the last."""
    listed = lambda path: F.array_join(F.from_json(F.get_json_object("record", path), "array<string>"), ", ")
    pairs = F.from_json(F.get_json_object("record", "$.key_value_pairs"), "array<struct<label:string,value:string>>")
    plain = F.map_entries(F.map_filter(F.from_json("record", "map<string,string>"), lambda k, v: ~k.isin(*NOT_SHOWN) & v.isNotNull() & ~v.startswith("{") & ~(v.startswith("[") & ~v.startswith('["'))))
    text = F.transform(plain, lambda e: F.struct(e["key"].alias("name"), F.when(e["value"].startswith('["'), F.array_join(F.from_json(e["value"], "array<string>"), ", ")).otherwise(e["value"]).alias("value")))
    named = [F.struct(F.lit(n).alias("name"), F.nullif(listed(f"$.entities.{k}"), F.lit("")).alias("value")) for n, k in (("ICD-10 Codes", "icd10_codes"), ("MRN", "mrn"), ("Phone", "phone_numbers"))]
    dates = F.transform(F.from_json(F.get_json_object("record", "$.dates"), "array<struct<date:string,context:string>>"), lambda d: F.struct(F.coalesce(F.nullif(d["context"], F.lit("")), F.lit("Date")).alias("name"), d["date"].alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    own = F.transform(F.filter(pairs, lambda p: (p["label"] != "") & (p["value"] != "")), lambda p: F.struct(p["label"].alias("name"), p["value"].alias("value")))
    every = F.filter(F.concat(*(F.coalesce(x.cast("array<struct<name:string,value:string>>"), none) for x in (own, text, F.array(*named), dates))), lambda x: x["value"].isNotNull())
    # a record's names meet in the task that holds it, and no task sorts more than those of so many records
    e = shared.dealt(records, 20_000, "id").select("id", F.posexplode(every).alias("at", "f"))
    return e.groupBy("id", F.col("f.name").alias("name")).agg(F.max_by("f.value", "at").alias("value"))


#: Queries that the explorer offers, over a database's tables.
EXAMPLES = {
    "All documents": "select id, file_name, form_type, concat(round(confidence * 100), '%') confidence, concat(round(processing_time_ms), 'ms') time from documents order by id",
    "Form type breakdown": "select form_type, count(*) n, round(avg(confidence) * 100) avg_confidence_pct, round(avg(processing_time_ms)) avg_time_ms from documents group by form_type order by n desc",
    "Patient names": "select d.file_name, d.form_type, f.field_value patient_name from documents d join fields f on d.id = f.document_id where f.field_name in ('patient_name', 'member_name') order by f.field_value",
    "Claim charges": "select d.file_name, f.field_value total_charge from documents d join fields f on d.id = f.document_id where d.form_type = 'cms1500' and f.field_name = 'total_charge' order by coalesce(try_cast(f.field_value as double), 0) desc",
    "Diagnoses": "select d.file_name, x.icd10_code, x.position from diagnoses x join documents d on d.id = x.document_id order by x.icd10_code",
    "Service lines": "select d.file_name, s.cpt_code, s.date_of_service, s.charge, s.units from service_lines s join documents d on d.id = s.document_id order by s.cpt_code",
    "All field names": "select distinct field_name from fields order by field_name",
    "Tables": "show tables",
}


def example(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """One of ``EXAMPLES`` over given tables instead of a database's."""
    sql = EXAMPLES[name]
    for t in tables:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **tables)


def nested(documents: DataFrame, **children: tuple[DataFrame, str, str]) -> DataFrame:
    """Each document with, per child (rows, value, order), the array of its
    values in order; empty where it has none."""
    out = documents
    for name, (rows, value, order) in children.items():
        each = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("v"))))
        lists = rows.groupBy(F.col("document_id").alias("id")).agg(F.transform(each, lambda s: s["v"]).alias(name))
        out = out.join(lists, "id", "left")
    return out


def explode_service_lines(records: DataFrame) -> DataFrame:
    """(document_id, line_number, ...) of records with an array of lines
    (date_from, date_of_service, cpt, charge, units, reasons)."""
    e = records.select(F.col("id").alias("document_id"), F.posexplode("service_lines").alias("at", "s")).where("s is not null")
    date = F.coalesce(F.nullif("s.date_from", F.lit("")), F.col("s.date_of_service"))
    return e.select("document_id", (F.col("at") + 1).alias("line_number"), F.col("s.cpt").alias("cpt_code"), date.alias("date_of_service"), F.col("s.charge").alias("charge"), F.col("s.units").alias("units"), F.coalesce(F.to_json("s.reasons"), F.lit("[]")).alias("reason_codes"))


def explode_diagnoses(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").alias("document_id"), F.posexplode("diagnoses").alias("at", "icd10_code")).where("icd10_code is not null").select("document_id", "icd10_code", (F.col("at") + 1).alias("position"))


def search_provider(index: DataFrame, provider: str) -> DataFrame:
    """Index rows whose provider holds the text, in any case, by date."""
    return index.where(F.col("provider").ilike(f"%{provider}%")).orderBy("date_of_service")


def merged(specific: Column, generic: Column, allowed: list[str]) -> Column:
    """A map of fields with the allowed ones of ``generic`` that it lacks."""
    extra = F.map_filter(generic, lambda k, v: k.isin(allowed) & ~F.map_contains_key(specific, k))
    return F.map_concat(specific, extra)


#: Leaves of a plan that are tables, views or given rows.
_READS = ("LogicalRelation", "HiveTableRelation", "DataSourceV2Relation", "DataSourceV2ScanRelation", "LogicalRDD", "LocalRelation", "OneRowRelation", "Range", "CTERelationRef", "InMemoryRelation")
#: Commands that show what is there, and functions of tables and of values that read or run something else.
_SHOWS = ("ShowTables", "ShowColumns", "ShowNamespaces", "DescribeRelation", "DescribeColumn", "ExplainCommand")
_TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer")
_RUNS = ("CallMethodViaReflection", "TryReflect", "PythonUDF", "PythonUDTF", "ScalaUDF")


def _walk(top, *ways: str) -> list:
    """A tree of the session's plan or expressions, with what hangs on its nodes in given ways."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        out.append(node)
        for way in ways:
            inner = getattr(node, way)()
            todo += [inner.apply(i) for i in range(inner.size())]
    return out


def guarded(spark: SparkSession, query: str) -> DataFrame:
    """A query's rows, if it does no more than read: its plan, as analysed, holds
    no command, its leaves are tables and views of the session or rows that it
    states, and nothing in it names files or runs other code.  Nothing has run
    before that is known."""
    state, class_of = spark._jsparkSession.sessionState(), spark._jvm.java.lang.Class.forName

    def refuse(what: str) -> None:
        raise ValueError(f"only queries over tables and views can be explored, not {what}")

    parsed = state.sqlParser().parsePlan(query)
    name = lambda node: node.getClass().getSimpleName()
    if name(parsed) in _SHOWS:
        return spark.sql(query)
    statements = [class_of(f"org.apache.spark.sql.catalyst.plans.logical.{c}") for c in ("Command", "ParsedStatement")]
    nodes = _walk(parsed, "children", "subqueries")
    for with_ in (n for n in list(nodes) if name(n) == "UnresolvedWith"):
        for i in range(with_.cteRelations().size()):
            nodes += _walk(with_.cteRelations().apply(i)._2(), "children", "subqueries")
    for node in nodes:
        if any(c.isInstance(node) for c in statements):
            refuse(name(node))
        if name(node) == "UnresolvedRelation" and node.multipartIdentifier().size() == 2:
            # format.`path` is two names as well, of no table
            table = ".".join(f"`{node.multipartIdentifier().apply(i)}`" for i in (0, 1))
            if not spark.catalog.tableExists(table):
                refuse(f"{table}, which is none")
        if name(node) == "UnresolvedTableValuedFunction" and node.name().mkString(".").lower() not in _TABLE_FUNCTIONS:
            refuse(f"the function {node.name().mkString('.')}")
    analysed = state.analyzer().execute(parsed)
    for node in _walk(analysed, "children", "subqueries"):
        if any(c.isInstance(node) for c in statements):
            refuse(name(node))
        if analysed.resolved() and node.children().isEmpty() and name(node) not in _READS:
            refuse(name(node))
        for i in range(node.expressions().size()):
            for e in _walk(node.expressions().apply(i), "children"):
                if name(e) in _RUNS:
                    refuse(e.toString())
    return spark.sql(query)


def explore(spark: SparkSession, query: str, most: int = 500, by: list[str] | None = None, after: tuple | None = None) -> DataFrame:
    """The first ``most`` rows of a query that only reads.  With ``by``, columns
    that tell rows apart, rows are in their order and begin after the values
    ``after``: the last row's of the page before."""
    rows = guarded(spark, query)
    if by is not None:
        if after is not None:
            rows = rows.where(F.struct(*by) > F.struct(*(F.lit(x).cast(rows.schema[c].dataType).alias(c) for c, x in zip(by, after, strict=True))))
        rows = rows.orderBy(*by)
    return rows.limit(most)


def batch_summary(runs: DataFrame) -> DataFrame:
    """Per form type of (form_type, error, ms): files, errors, times."""
    ms = F.col("ms").cast("decimal(18,2)")
    return runs.groupBy("form_type").agg(F.count("*").alias("files"), F.count("error").alias("errors"), F.sum(ms).cast("double").alias("total_ms"), F.round(F.avg(ms), 2).cast("double").alias("mean_ms"))


def with_all_columns(frames: list[DataFrame]) -> DataFrame:
    """The rows of frames of different columns, with their sorted union."""
    first, *rest = frames
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first.select(*sorted(first.columns))
