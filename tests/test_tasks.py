"""What tasks hold, and what plans move, as tables grow."""

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_types_are_told_without_records(spark):
    from leafwright.extractors import auto
    from leafwright.plans.run_queries import mixed_pages

    types = auto.types(mixed_pages(spark, SF))
    assert "leafwright-" not in _plan(queries()["auto_types"](spark, SF))  # nothing was written to be read
    whole = auto.extract(mixed_pages(spark, SF)).drop("record")
    assert types.count() == 200 and whole.exceptAll(types).isEmpty() and types.exceptAll(whole).isEmpty()


def test_benefit_rows_stay_with_their_page(spark):
    plan = _plan(queries()["benefit_totals"](spark, SF))
    # numbers are dealt by page once; neither a join nor a sum moves or sorts the cells of all tasks again
    assert "Join" not in plan and plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_names_of_a_record_meet_in_its_task(spark):
    plan = _plan(queries()["index_fields"](spark, SF))
    assert "ENSURE_REQUIREMENTS" not in plan and plan.count("REPARTITION_BY_NUM") == 2


def test_headings_are_dealt(spark):
    assert queries()["page_headings"](spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_records_are_dealt(spark):
    # both sides of the join: else records are read and compared by as many tasks as the file has parts
    assert _plan(queries()["truth_pairs"](spark, SF)).count("REPARTITION_BY_NUM") == 2


def test_steps_of_a_raster_are_made_once(monkeypatch):
    from leafwright.extractors import raster
    from leafwright.sources import rasters

    rasters.form(0)
    drawn, edged = [], []
    lines, edges = rasters.lines, raster.edged
    monkeypatch.setattr(rasters, "lines", lambda *a: (drawn.append(1), lines(*a))[1])
    g = rasters.form(2)
    # a cross is drawn at once, and what stands on every page was drawn before
    assert len(drawn) == 1
    monkeypatch.setattr(raster, "edged", lambda g: (edged.append(1), edges(g))[1])
    mask = raster.inked(g)
    found = [raster.evidence(g, raster.summed(mask), *b) for b in raster.boxes(mask)]
    assert [f["kind"] for f in found] == ["radio", "checkbox"] or [f["kind"] for f in found] == ["checkbox", "radio"]
    # the edges that tell a mark's lines are those that tell its likeness to a tick
    assert len(edged) == 1


def test_texts_are_scored_by_one_worker_of_a_task(spark):
    import corpus_pipeline

    kept = corpus_pipeline.language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    # once for what is usual and once for the documents, not once more for each filter
    assert _plan(kept).count("ArrowEvalPython") == 2
