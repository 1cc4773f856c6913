"""Stages that go on behind a broken run, and the composed ontology run."""

import json
import os

import pytest
from pyspark.sql import functions as F

from kgspark.operators.run import ontology_run
from kgspark.plans.ontology_queries import ask_markets, propose_markets
from kgspark.sources.stages import Stages, content_fingerprint
from kgspark.storage import local_table


def numbers(spark, values):
    return local_table(spark, [(v,) for v in values], "n long")


def chain(stages, source, calls, fail=None):
    """source -> parity -> counts, noting which stages are computed."""
    def note(name, tables):
        calls.append(name)
        if fail == name:
            tables["broken"] = next(iter(tables.values())).select(F.raise_error(F.lit("lost")).alias("x"))
        return tables

    stages.source("numbers", source)
    stages.run("parity", ["numbers"], lambda t: note("parity", {"rows": t["numbers"].select((F.col("n") % 2).alias("p"))}))
    return stages.run("counts", ["parity"], lambda t: note("counts", {
        "rows": t["rows"].groupBy("p").agg(F.count(F.lit(1)).alias("c")), "all": t["rows"].agg(F.count(F.lit(1)).alias("c")),
    }))


def test_fingerprint_is_of_contents(spark):
    a = content_fingerprint(numbers(spark, [1, 2, 2]))
    assert a == content_fingerprint(numbers(spark, [2, 1, 2]).repartition(3))
    others = [numbers(spark, v) for v in ([1, 2], [1, 2, 3], [1, 2, None], [], [1, 1, 2, 2])]
    others += [numbers(spark, [1, 2, 2]).withColumnRenamed("n", "m"), numbers(spark, [1, 2, 2]).select(F.col("n").cast("int"))]
    assert len({a} | {content_fingerprint(o) for o in others}) == len(others) + 1
    two = [local_table(spark, [row], "a string, b string") for row in (("x", None), (None, "x"))]
    assert content_fingerprint(two[0]) != content_fingerprint(two[1])


def test_stages_go_on_and_follow_changes(spark, tmp_path):
    root = str(tmp_path / "run")
    calls = []
    with pytest.raises(Exception, match="lost"):
        chain(Stages(spark, root), numbers(spark, [1, 2, 3]), calls, fail="counts")
    # The tables written before the failure have no mark: the stage is done again, the one before it is not.
    written = [f for f, _, names in os.walk(f"{root}/counts") if "_SUCCESS" in names]
    assert written and not any("done.json" in names for _, _, names in os.walk(f"{root}/counts"))
    stages = Stages(spark, root)
    tables = chain(stages, numbers(spark, [1, 2, 3]), calls)
    assert calls == ["parity", "counts", "counts"] and stages.reused == {"parity": True, "counts": False}
    assert {(r["p"], r["c"]) for r in tables["rows"].collect()} == {(0, 1), (1, 2)}
    # Another order is the same input; other numbers of the same parity stop at the first stage.
    stages = Stages(spark, root)
    chain(stages, numbers(spark, [3, 1, 2]), calls)
    assert len(calls) == 3 and all(stages.reused.values())
    stages = Stages(spark, root)
    chain(stages, numbers(spark, [5, 2, 3]), calls)
    assert calls[3:] == ["parity"] and stages.reused == {"parity": False, "counts": True}
    chain(Stages(spark, root), numbers(spark, [5, 2, 4]), calls)
    assert calls[4:] == ["parity", "counts"]
    mark = next(os.path.join(f, "done.json") for f, _, names in os.walk(f"{root}/counts") if "done.json" in names)
    assert set(json.load(open(mark))["tables"]) == {"rows", "all"}


def test_parameters_are_part_of_a_stage(spark, tmp_path):
    for params, reused in ((1, False), (2, False), (1, True)):
        stages = Stages(spark, str(tmp_path / "run"))
        stages.source("numbers", numbers(spark, [1]))
        stages.run("s", ["numbers"], lambda t: {"rows": t["numbers"]}, params)
        assert stages.reused == {"s": reused}


def test_composed_run(spark, scratch, tmp_path):
    """A run that stops in the proposals goes on there, and repairs what the batches leave in pieces."""
    groups = local_table(spark, [
        (1, "high", 7, "BUILDING"), (2, "low", 7, "BUILDING"), (3, "medium", 8, "AUTOMOBILE"), (4, "low", 9, "FURNITURE"),
        (5, "none", 10, "BUILDING"), (6, "low", 11, "MACHINERY"),
    ], "group_id long, priority string, c_nationkey int, c_mktsegment string")
    asked = []

    def ask(members):
        asked.append(1)
        questions = ask_markets(members)
        return questions.unionByName(questions.select("group_id", "slot", F.lit(" ").alias("text"))).unionByName(
            questions.select("group_id", "slot", F.lit(None).cast("string").alias("text"))
        )

    def broken(batches):
        raise ValueError("model is away")

    root = str(tmp_path / "run")
    with pytest.raises(ValueError, match="away"):
        ontology_run(Stages(spark, root), groups, ask, broken, scratch, batch_size=2)
    run = ontology_run(Stages(spark, root), groups, ask, propose_markets, scratch, batch_size=2)
    assert len(asked) == 1
    assert [n for n, reused in run.reused.items() if not reused] == ["concepts", "ontology", "fixed"]
    names = {r["name"] for r in run.ontology.classes.collect()}
    assert names == {"Thing", "Market7Building", "Market8Automobile", "Market9Furniture", "Market11Machinery"}
    assert [(r["batch_id"], r["valid"]) for r in run.log.orderBy("batch_id").collect()] == [(0, True), (1, True)]
    assert run.history.isEmpty() and run.ontology.subclass_of.count() == 4
