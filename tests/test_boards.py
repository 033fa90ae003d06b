from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestack.schemas import RAW_POSTING
from lodestack.sources import boards


def page(folder, number, *names):
    (folder / f"page={number}").mkdir(parents=True)
    results = [{"id": n, "title": f"Job {n}", "company": {"display_name": "Acme"}} for n in names]
    (folder / f"page={number}" / "part-0.txt").write_text(json.dumps({"results": results}) + "\n\n")


def test_pages_and_pushed_filters(spark, tmp_path):
    for n in (1, 2, 3, 12):
        page(tmp_path, n, f"{n}a", f"{n}b")
    (tmp_path / "page=2" / "_SUCCESS").write_text("")
    (tmp_path / "other").mkdir()
    rows = boards.register(spark).read.format("jobboard").option("path", str(tmp_path)).load()
    assert rows.columns == ["page", "file", "record"] and rows.rdd.getNumPartitions() == 4
    assert {r["page"] for r in rows.collect()} == {1, 2, 3, 12}
    # pages that a filter leaves out are no partitions, and so aren't opened
    (tmp_path / "page=12" / "part-0.txt").write_bytes(b"\xff\xfe broken")
    few = rows.where("page <= 3 and page > 1")
    assert sorted(r["page"] for r in few.collect()) == [2, 3] and few.rdd.getNumPartitions() == 2
    assert rows.where(F.col("page").isin(1, 3) & F.col("record").contains("3a")).count() == 1
    made = boards.load(spark, "adzuna", f"file://{tmp_path}", pages=2)
    assert made.columns == [c.split()[0] for c in RAW_POSTING.split(", ")] and sorted(r["external_id"] for r in made.collect()) == ["1a", "1b"]
    assert boards.register(spark).read.format("jobboard").option("path", str(tmp_path / "nothing")).load().count() == 0


def test_a_stream_walks_on_after_a_restart(spark, tmp_path):
    zone, sink, marks = tmp_path / "zone", str(tmp_path / "sink"), str(tmp_path / "marks")

    def walk(**given):
        stream = boards.load_stream(spark, "arbeitnow", str(zone), **given)
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(once=True).start().awaitTermination()
        return sorted(r["external_id"] for r in spark.read.schema("external_id string").parquet(sink).collect())

    def land(number, *names):
        rows = spark.createDataFrame([(number, [(n, f"Job {n}") for n in names])], "page int, data array<struct<slug:string,title:string>>")
        boards.land(rows, str(zone))

    land(1, "a", "b")
    land(3, "e")
    assert walk() == ["a", "b"]  # page 2 hasn't landed
    land(2, "c", "d")
    land(4, "f")
    assert walk() == ["a", "b", "c", "d", "e", "f"]
    assert walk() == ["a", "b", "c", "d", "e", "f"]
    offsets = sorted((tmp_path / "marks" / "offsets").glob("[0-9]*"))
    assert '{"page": 4}' in offsets[-1].read_text().replace('{"page":4}', '{"page": 4}')
    land(5, "g")
    land(6, "h")
    assert walk(pages=5)[-1] == "g"
