"""Queries over scanned pages, with the numbers that they are drawn from as their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.extractors import raster
from leafwright.plans.queries import query
from leafwright.sources import rasters


@query("""with p as (select p_partkey::bigint k from part) select k page, 'checkbox' kind, (10 + k % 30)::double x, (12 + k % 11)::double y, (30 + k % 21)::double w, (30 + k % 21)::double h, k % 4 > 0 selected from p
union all select k, 'radio', (120 + k % 17)::double, (40 - k % 13)::double, (34 + k % 17)::double, (34 + k % 17)::double, k % 3 = 1 from p""")
def raster_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster.controls(rasters.pages(spark, sf_dir, rasters.form))
    return p.select("page", F.explode("controls").alias("c")).select("page", "c.kind", "c.x", "c.y", "c.w", "c.h", "c.selected")


@query("""with p as (select p_partkey::bigint k, (40 + p_partkey % 5 * 2)::int side, (p_partkey % 12 * 2)::int inner_ from part), b as (select *, side - 2 * (side * 18 // 100) room from p)
select k page, round(least(inner_, room)::double * least(inner_, room) / (room * room), 6) fill, inner_ > 0 marked from b""")
def raster_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rasters.pages(spark, sf_dir, rasters.filled).withColumn("c", F.explode(raster.found("image")))
    # the least square has edges all around, whatever little it fills
    return p.select("page", F.round("c.fill", 6).alias("fill"), (F.col("c.edges") > 0).alias("marked"))


@query("""select p_partkey::bigint page, ((p_partkey % 41 - 20) / 4.0)::double planted, true near, abs(p_partkey % 41 - 20) > 1 turned from part""")
def raster_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a page's two rasters are larger than all that is said about it
    p = rasters.pages(spark, sf_dir, rasters.slanted, raster.levelling, "page long, skew double, turned boolean")
    planted = (F.col("page") % 41 - 20) / 4
    return p.select("page", planted.alias("planted"), (F.abs(F.col("skew") - planted) <= 0.2).alias("near"), "turned")
