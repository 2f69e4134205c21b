"""Tasks, settings, paths and the store's upkeep on small tables."""

import pytest
from pyspark.sql import functions as F

from lorekeep import session
from lorekeep.functions import config, text
from lorekeep.operators import notes, recall, tasks

TASK = "task_id string, batch_date string, created_at string, status string, mtime double"


def test_tasks_pass_through_their_states(spark):
    rows = [("a", "2026-01-02", None, "pending", 3.0), ("b", "", None, "pending", 9.0), ("c", None, None, "pending", 1.0), ("d", "2026-01-01", None, "in_progress", None), ("d", "2026-01-01", None, "pending", 5.0)]
    t = tasks.one_of_each(spark.createDataFrame(rows, TASK))
    state = lambda df: {r["task_id"]: r["status"] for r in df.collect()}
    assert state(t)["d"] == "pending"  # the later row
    two = tasks.taken(t, 2)
    assert state(two) == {"a": "pending", "b": "in_progress", "c": "in_progress", "d": "pending"}
    ids = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "task_id string")
    assert state(tasks.submitted(two, ids)) == {"a": "pending", "c": "in_progress", "d": "pending"}
    assert state(tasks.failed(two, ids)) == {"a": "pending", "b": "failed", "c": "in_progress", "d": "pending"}
    assert set(state(tasks.reset(two)).values()) == {"pending"}
    assert set(state(tasks.cleaned(t, "1970-01-08 00:00:04", 7))) == {"b", "d"}
    more = tasks.added(two, spark.createDataFrame([("b", "2026-02-01"), ("n", None)], "task_id string, batch_date string"), 7.0)
    assert state(more) == {"a": "pending", "b": "pending", "c": "in_progress", "d": "pending", "n": "pending"}
    assert tasks.taken(t.limit(0)).count() == 0


def test_layers_and_types():
    got = config.layered({"a": 1, "b": {"x": True, "y": "s"}, "c": 1.5}, {"a": "2", "b": {"x": "no", "z": 3}}, {"a": "bad", "c": None, "b": 5})
    assert got == {"a": 2, "b": {"x": False, "y": "s", "z": 3}, "c": 1.5}
    assert config.layered({"n": True}, {"n": "perhaps"}) == {"n": True}


def test_remote_of_a_folder(tmp_path):
    repo = tmp_path / "r"
    (repo / ".git").mkdir(parents=True)
    (repo / ".git" / "config").write_text('[core]\n\tbare = false\n[remote "origin"]\n\turl = git@H.example:a/b.git\n\tfetch = +refs/*\n')
    (repo / "x" / "y").mkdir(parents=True)
    assert config.remote_of(repo / "x" / "y") == "git@H.example:a/b.git"
    work = repo / ".git" / "worktrees" / "w"
    work.mkdir(parents=True)
    (work / "commondir").write_text("../..\n")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / ".git").write_text(f"gitdir: {work}\n")
    assert config.remote_of(tmp_path / "w") == "git@H.example:a/b.git"
    (repo / ".git" / "config").write_text("broken")
    assert config.remote_of(repo) is None
    assert config.workspace("a") == "a" and config.workspace(None, {"LOREKEEP_WORKSPACE": "b"}) == "b"


def test_settings_rows_and_numbers(spark):
    rows = [(0, "k", "1"), (2, "k", None), (1, "k", "x"), (0, None, "y"), (1, "j", "7.5")]
    got = {r["key"]: r for r in config.settings(spark.createDataFrame(rows, "layer int, key string, value string")).withColumn("n", config.number(F.col("value"), 3)).collect()}
    assert {k: (r["value"], r["n"]) for k, r in got.items()} == {"k": ("x", 3.0), "j": ("7.5", 7.5)}


@pytest.mark.parametrize(("path", "want"), [("/m/a", True), ("/m", False), ("/m/", False), ("/m/../a", False), ("/m/x/../a", True), ("/mm/a", False), ("m/a", False), (None, False), ("/../../m/a", True), ("", False)])
def test_paths_inside(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(text.inside(F.col("p"), "/m")).first()[0] is want


def test_templates_and_slugs(spark):
    one = spark.range(1)
    assert one.select(text.rendered("{a}-{b}-{c}", {"a": F.lit("{b}"), "b": F.lit(None)})).first()[0] == "--{c}"
    assert one.select(text.han_slug(F.lit("  修复 Bug: 连接池!  v2 "))).first()[0] == "修复-bug-连接池-v2"
    assert tuple(one.select(text.head(F.lit("\n \na\n\nb\nc"), 2)).first()[0]) == (3, "a\nb")
    assert tuple(one.select(text.head(F.lit(None).cast("string"), 2)).first()[0]) == (1, "")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://h:1"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            return Context

        @staticmethod
        def isDefined():  # noqa: N802
            return False

    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

        sparkContext = Context  # noqa: N815

    with pytest.raises(RuntimeError, match="share"):
        session.shared_dir(Session)


NOTE = "id string, scope string, project_key string, title string, tags array<string>, created string, archived boolean, potential_conflicts array<string>, potentially_superseded_by array<string>"


def test_new_notes_mark_both_ways(spark):
    row = lambda i, tags, ahead=None, behind=None: (i, "personal", None, i, tags, "2026-01-01", False, ahead, behind)
    stored = spark.createDataFrame([row("o1", ["a", "b"], None, ["x"]), row("o2", ["c"]), row("o3", ["b", "a"], ["o1"])], NOTE)
    new = spark.createDataFrame([row("n1", ["A", "B"], ["gone"]), row("n2", ["a", "b"]), row("o3", ["c", "d"])], NOTE)
    got = {r["id"]: (r["potential_conflicts"], r["potentially_superseded_by"]) for r in notes.marked(stored, new).collect()}
    assert got == {"o1": (None, ["x", "n1", "n2"]), "o2": (None, None), "n1": (["o1"], None), "n2": (["o1"], None), "o3": ([], None)}
    assert notes.marked(stored, new.limit(0)).count() == 3


def test_an_empty_query_hits_nothing(spark):
    docs = spark.createDataFrame([(1, "abc")], "k int, t string")
    assert recall.line_hits(docs, "", "k", "t").count() == 0


def test_rerank_ties_and_missing_vectors(spark):
    top = spark.createDataFrame([(5, 1.0, [1.0, 0.0]), (3, 1.0, [1.0, 0.0]), (9, 2.0, None)], "key bigint, bm25 double, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0])], "query_id bigint, asked array<float>")
    got = {}
    for r in recall.rerank(top, asked).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["key"], r["final_score"]))
    assert sorted(got[0]) == [(1, 3, 0.7), (2, 5, 0.7), (3, 9, 0.3)]
    assert sorted(got[20]) == sorted(got[40]) == [(1, 9, 0.3), (2, 3, 0.0), (3, 5, 0.0)]
    assert recall.rerank(top.limit(0), asked).count() == 0


def test_dictated_notes_take_their_first_line(spark):
    said = [("## Head  \nrest", None, None, None, "high"), ("\n  first line that is longer than thirty characters\nmore", "project", "k", ["a"] * 8, "odd"), ("#\nx", "project", "", None, None), (" ", None, None, None, None), (None, None, None, None, None)]
    rows = {r["title"]: r for r in notes.remembered(spark.createDataFrame(said, "body string, scope string, project_key string, tags array<string>, value string"), "2026-07-01").collect()}
    assert set(rows) == {"Head", "first line that is longer than", ""}
    assert rows["Head"]["body"] == "## Head  \nrest" and rows["Head"]["value"] == "high" and rows["Head"]["scope"] == "personal"
    long = rows["first line that is longer than"]
    assert long["body"].startswith("# first line that is longer than\n\nfirst line") and len(long["tags"]) == 6 and (long["scope"], long["value"]) == ("project", "medium")
    assert rows[""]["scope"] == "personal"


def test_a_word_stands_for_the_newest_note(spark):
    rows = [("x", "project", "k", "Find me", "2026-01-01", None, False), ("y", "personal", None, "find ME too", "2026-01-01", "2026-03-01", True), ("z", "personal", None, None, None, None, False), ("x", "personal", None, "o", "2020-01-01", None, True), ("x", "personal", None, "own", "2020-01-01", None, False)]
    df = spark.createDataFrame(rows, "id string, scope string, project_key string, title string, created string, updated string, archived boolean")
    assert notes.resolved(df, "find me").first()["id"] == "y"
    assert notes.resolved(df, "x").first()["title"] == "own"
    assert notes.resolved(df, "nothing like it").count() == 0


def test_task_files(spark, tmp_path):
    (tmp_path / "a.task").write_text('{"task_id": "a", "prompt": "p\\nq"}')
    (tmp_path / "b.task.in_progress").write_text('{"task_id": "b", "batch_date": "2026-01-01"}')
    (tmp_path / "c.task.failed").write_text('{"task_id": "c"}\n# error: bad\n# failed_at: now\n')
    (tmp_path / "d.task").write_text("{broken")
    (tmp_path / "e.txt").write_text('{"task_id": "e"}')
    got = {r["task_id"]: (r["status"], r["prompt"]) for r in tasks.read_files(spark, str(tmp_path)).where("mtime > 0").collect()}
    assert got == {"a": ("pending", "p\nq"), "b": ("in_progress", None), "c": ("failed", None)}


def test_search_by_index_and_kept_counts(spark, tmp_path):
    from lorekeep.plans.core_queries import _PROJECT, AS_OF, NOTE_QUERY

    from .oracle import DATA

    memories, events = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("memories", "recall_events"))
    want = [tuple(r) for r in recall.search(memories, events, NOTE_QUERY, _PROJECT, AS_OF, 20).collect()]
    index = recall.note_index(memories, str(tmp_path / "i"))
    counts = recall.recall_counts(events, AS_OF).cache()
    assert [tuple(r) for r in recall.search(memories, events, NOTE_QUERY, _PROJECT, AS_OF, 20, index, counts).collect()] == want != []
    assert recall.search(memories, events, "  ", None, AS_OF, 5, index).count() == 0
