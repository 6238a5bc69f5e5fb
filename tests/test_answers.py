"""Answers are asked once, whatever is lost or run again."""

import pytest

from tessera.operators.answers import Answers


def counted(path, fail=(), die=()):
    """A model that writes down each call."""

    def call(text):
        with open(path, "a") as f:
            f.write(text + "\n")
        if text in fail:
            raise TimeoutError(text)
        if text in die:
            raise SystemExit("the driver is gone")
        return text.upper()

    return call


def calls(path):
    return sorted(path.read_text().split("\n")[:-1]) if path.exists() else []


def rows(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")


def test_each_text_is_asked_once_though_cached_blocks_are_lost(spark, tmp_path):
    seen = tmp_path / "seen"
    table = Answers(spark, f"{tmp_path}/a")
    got = table.ask(rows(spark, "a", "b", "a", None), "text", counted(seen), "k")
    for _ in range(2):
        for rdd in list(spark.sparkContext._jsc.getPersistentRDDs().values()):
            rdd.unpersist(True)
        spark.catalog.clearCache()
        assert {(r["id"], r["text"], r["answer"], r["error"]) for r in got.collect()} == {(0, "a", "A", None), (1, "b", "B", None), (2, "a", "A", None), (3, None, "", None)}
    assert table.ask(rows(spark, "b", "c"), "text", counted(seen), "k").count() == 2
    assert calls(seen) == ["", "a", "b", "c"]
    table.ask(rows(spark, "a"), "text", counted(seen), "other").count()  # another kind is another question
    assert calls(seen) == ["", "a", "a", "b", "c"]


def test_a_run_goes_on_where_a_crash_ended_it(spark, tmp_path):
    seen, texts = tmp_path / "seen", [f"t{k}" for k in range(12)]
    before = spark.sparkContext._jsc.sc().getConf().get("spark.task.maxFailures", "1")
    assert before  # local mode gives up at the first failure of a task
    with pytest.raises(Exception):  # noqa: B017, PT011  the worker's end, as Spark reports it
        Answers(spark, f"{tmp_path}/a", 4).ask(rows(spark, *texts), "text", counted(seen, die=("t5",)), "k")
    lost = calls(seen)
    done = {r["answer"].lower() for r in Answers(spark, f"{tmp_path}/a").read().collect()}
    again = tmp_path / "again"
    got = Answers(spark, f"{tmp_path}/a", 4).ask(rows(spark, *texts), "text", counted(again), "k")
    assert sorted(r["answer"] for r in got.collect()) == sorted(t.upper() for t in texts)
    assert calls(again) == sorted(set(texts) - done) and done <= set(lost) and "t5" not in done


def test_failures_stay_for_the_run_and_are_asked_again_by_the_next(spark, tmp_path):
    seen = tmp_path / "seen"
    table = Answers(spark, f"{tmp_path}/a")
    for _ in range(2):
        got = {r["text"]: (r["answer"], r["error"]) for r in table.ask(rows(spark, "x", "y"), "text", counted(seen, fail=("y",)), "k", attempts=3).collect()}
        assert got == {"x": ("X", None), "y": (None, "TimeoutError: y")}
    assert calls(seen) == ["x", "y", "y", "y"]
    got = {r["text"]: r["answer"] for r in Answers(spark, f"{tmp_path}/a").ask(rows(spark, "x", "y"), "text", counted(seen), "k").collect()}
    assert got == {"x": "X", "y": "Y"} and calls(seen) == ["x", "y", "y", "y", "y"]
