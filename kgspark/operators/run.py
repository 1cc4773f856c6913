"""The whole way from groups of experts to one ontology, as a graph of stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from kgspark.operators import sampling
from kgspark.operators.hierarchy import fix_ontology
from kgspark.operators.incremental import build_incremental
from kgspark.operators.ontology import Ontology, empty_ontology
from kgspark.operators.text import number_rows
from kgspark.sources.stages import Stages, Tables
from kgspark.storage import Scratch

ONTOLOGY_TABLES = ["classes", "subclass_of", "object_properties", "data_properties"]


@dataclass(frozen=True)
class OntologyRun:
    ontology: Ontology
    log: DataFrame        # verdict of each batch
    history: DataFrame    # repair operations
    reused: dict[str, bool]


def _as_tables(onto: Ontology) -> Tables:
    return {t: getattr(onto, t) for t in ONTOLOGY_TABLES}


def ontology_run(
    stages: Stages, groups: DataFrame, ask: Callable[[DataFrame], DataFrame],
    propose: Callable[[DataFrame], DataFrame], scratch: Scratch, *, batch_size: int = 4,
    threshold: float = 0.8, ops: DataFrame | None = None, prune_below: int = 0,
    name: str = "ontology", versions: tuple[str, str] = ("", ""),
) -> OntologyRun:
    """Members by quota, their questions, duplicates, batches, incremental build, repair.

    ``groups`` (group_id, priority, ..). ``ask`` maps members (groups with slot) to questions
    (group_id, slot, text); ``propose`` maps batches of questions (batch_id, seq, text) to
    concept rows, as ``build_incremental`` takes them. Both are models or rules, whose
    ``versions`` are parts of their stages. Null and blank questions are left out. Each
    step is a stage of its own: a stopped run goes on behind its last finished stage.
    """
    stages.source("groups", groups)
    stages.run("members", ["groups"], lambda g: {"rows": sampling.expand_quota(g["groups"])})
    stages.run("questions", ["members"], lambda m: {"rows": number_rows(
        ask(m["rows"]).where("trim(text) != ''"), [F.asc("group_id"), F.asc("slot"), F.asc("text")],
        scratch, "idx",
    )}, versions[0])
    stages.run("duplicates", ["questions"], lambda q: {"rows": sampling.near_dup_groups(
        q["rows"].select("idx", "text"), "idx", "text", scratch, threshold
    )}, threshold)
    stages.run("batches", ["questions", "duplicates"], lambda q, d: {
        "rows": _batches(q["rows"].select("idx", "text"), d["rows"], batch_size, scratch)
    }, batch_size)
    stages.run("concepts", ["batches"], lambda b: {"rows": propose(b["rows"])}, versions[1])

    def build(concepts: Tables) -> Tables:
        onto, log = build_incremental(empty_ontology(stages.spark, name), concepts["rows"], scratch)
        return {**_as_tables(onto), "log": log}

    def repair(built: Tables, *given: Tables) -> Tables:
        table = given[0]["operations"] if given else None
        onto = Ontology(name, *[built[t] for t in ONTOLOGY_TABLES])
        fixed, history = fix_ontology(onto, scratch, table, prune_below=prune_below)
        return {**_as_tables(fixed), "history": history}

    built = stages.run("ontology", ["concepts"], build)
    if ops is not None:
        stages.source("operations", ops)
    fixed = stages.run("fixed", ["ontology"] + (["operations"] if ops is not None else []), repair, prune_below)
    onto = Ontology(name, *[fixed[t] for t in ONTOLOGY_TABLES])
    return OntologyRun(onto, built["log"], fixed["history"], dict(stages.reused))


def _batches(questions: DataFrame, duplicates: DataFrame, batch_size: int, scratch: Scratch) -> DataFrame:
    """(batch_id, seq, text): the texts that stay, by their first index, ``batch_size`` in a batch."""
    kept, _ = sampling.apply_duplicate_ids(questions, duplicates)
    firsts = questions.join(kept, "text", "left_semi").groupBy("text").agg(F.min("idx").alias("idx"))
    numbered = number_rows(firsts, [F.asc("idx")], scratch)
    return numbered.select(F.floor(F.col("seq") / batch_size).cast("long").alias("batch_id"), "seq", "text")
