from pyspark.sql import functions as F

from lorekeep.operators import notes
from lorekeep.plans.store import Store
from lorekeep.session import drop_written, written

from .oracle import DATA


def test_store(spark):
    d = f"{DATA}/sf0.001"
    memories, events, tasks = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("memories", "recall_events", "tasks"))
    store = Store(memories, events, tasks)
    best = store.search("cache timeout retry", "2026-07-01 00:00:00", k=3)
    rows = best.collect()
    assert 0 < len(rows) <= 3 and all(r["citation"] and r["snippet"] for r in rows)
    assert store.search("  ", "2026-07-01 00:00:00").count() == 0
    assert store.logged("q", best, "2026-07-01T00:00:00").count() == events.count() + 1
    assert store.page(rows[0]["id"]).first()["id"] == rows[0]["id"] and store.page("no such note").count() == 0
    assert store.topics().count() == memories.where("not archived").select("id").distinct().count()
    assert store.forget([rows[0]["id"]]).where(F.col("id") == rows[0]["id"]).where("not archived").count() == 0
    said = spark.createDataFrame([("keep password=abcdef1 safe", "project", None, ["a"]), (" ", None, None, None)], "body string, scope string, project_key string, tags array<string>")
    after = store.remember(said, "2026-07-01")
    new = after.where("source = 'manual' and created = '2026-07-01'").collect()
    assert [(r["scope"], "abcdef1" in r["body"], r["body"].startswith("# keep")) for r in new] == [("personal", False, True)]
    assert store.waiting() >= store.next_task().count() == 1
    project = memories.where("scope = 'project' and not archived").first()["project_key"]
    assert store.context(project).count() == 1
    assert notes.scopes(memories, "personal").where("scope = 'project'").count() == 0 and notes.scopes(memories, "current_project").count() == 0


def test_page_cuts_between_characters(spark):
    for t, want in (("中" * 10, "中" * 3), ("a" * 10, "a" * 10), ("a中😀b😀", "a中😀b"), ("x" * 11, "x" * 10), ("a😀😀😀", "a😀😀")):
        got = spark.range(1).select(notes.page(F.lit(t), 10)).first()[0]
        assert got == want, (t, got)


def test_written_tables_can_be_dropped(spark, tmp_path):
    df = written(spark.range(5))
    path = df.inputFiles()[0]
    assert df.count() == 5
    drop_written(spark)
    from pathlib import Path

    assert not Path(path.removeprefix("file://")).exists()
