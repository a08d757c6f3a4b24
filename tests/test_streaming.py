"""Streams have the results of tables."""

import random

from leafwright.operators import segments
from leafwright.streaming import bundles


def test_arriving_pages_are_segmented_like_a_table(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for b in range(6):
        for p in range(rng.choice([1, 4, 12])):
            sep = rng.random() < 0.15
            rows.append((f"b{b}", p, rng.choice([None, "A", "B"]), rng.choice([None, "01/02/2024", "03/04/2024"]), rng.choice(["Clinical Note", "Lab Result", None]), sep, sep and rng.random() < 0.5, f"2024-01-01 10:{rng.randint(0, 8):02d}:00"))
    shuffled = rows + rows[:5]
    rng.shuffle(shuffled)
    kind = bundles.PAGES.replace("at timestamp", "at string")
    # files of any order within the watermark, and at last one from a later day, by which all before have been silent
    parts = [shuffled[k::3] for k in range(3)] + [[("late", 0, "A", None, "Lab Result", False, False, "2024-01-03 00:00:00")], [("later", 0, "A", None, "Lab Result", False, False, "2024-01-03 00:00:01")]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.json(str(tmp_path / f"in{k}"))
    (tmp_path / "all").mkdir()
    for k in range(len(parts)):
        for f in (tmp_path / f"in{k}").glob("*.json"):
            f.rename(tmp_path / "all" / f"{k}.json")
    arriving = spark.readStream.schema(bundles.PAGES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "all"))
    out = str(tmp_path / "out")
    query = bundles.segmented(arriving, lambda s: s.write.mode("append").parquet(out), str(tmp_path / "ck"), "30 minutes", "20 minutes")
    query.awaitTermination()
    got = spark.read.parquet(out)
    want = segments.index_segments(spark.createDataFrame(rows, kind).drop("at"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.select("bundle").distinct().count() == 6
