"""Incremental build of an ontology: all batches of concepts judged at once, to a fixpoint.

The rule is sequential: a batch is added whole if it has no issue against the ontology and
all batches added before it, else it is skipped. But a batch depends on earlier ones only
through a few facts, each with the first batch that states it: the classes there are (by
name in any case, and exactly), the superclass a class has, whether a class stands above any,
the properties there are, and how many classes nothing stands below. So batches are not
folded one by one: all are judged together against "stated by an added batch before mine",
first as if every batch were added; then those that ask for a fact whose batch
has changed are judged again, until no verdict changes. As verdicts depend on earlier
batches only, the result is that of the sequential rule, in as many rounds as the
longest chain of batches whose verdicts hang on each other, whatever their number.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from kgspark import schemas
from kgspark.functions.scalars import starts_uppercase
from kgspark.operators.ontology import (
    Ontology, all_properties, build_step_by_step, extend, split_concepts, superclass_sets,
)
from kgspark.skew import DEFAULT_SKEW, SkewPolicy, by_shuffle, hot_ends, lookup_join as skew_join, running_total
from kgspark.storage import Scratch

BASE = -(1 << 62)  # the place of the given ontology before all batches

# Every table here but the given ontology's grows with the batches, and a round has some forty
# joins: broadcasts of all that is still small enough would add up in the driver.
lookup_join = partial(skew_join, shuffled=True)


class _Facts:
    """Rows of all batches with what does not depend on other batches; written once."""

    def __init__(self, onto: Ontology, batches: DataFrame, scratch: Scratch, policy: SkewPolicy):
        self.onto, self.scratch, self.policy = onto, scratch, policy
        self.n_rows = batches.count()
        self.ids = scratch.save(batches.select("batch_id").distinct(), "ids")

        def rows(kind: str) -> DataFrame:
            return batches.where(F.col("kind") == kind).select("batch_id", f"{kind}.*", "seq")

        self.classes = scratch.save(self._classes(rows("class")), "class_rows")
        own = self.classes.groupBy("batch_id", "key").agg(F.collect_set("name").alias("own_names"))
        self.own = scratch.save(own.select(F.struct("batch_id", "key").alias("_own"), "own_names"), "own")
        self.relations = scratch.save(self._relations(rows("subclass_relation")), "relation_rows")
        properties = rows("object_property").select(
            "batch_id", "name", F.lit("object").alias("kind"), "domain", "range", "seq"
        ).unionByName(rows("data_property").select(
            "batch_id", "name", F.lit("data").alias("kind"), "domain", F.array().cast("array<string>").alias("range"), "seq"
        ))
        self.properties = scratch.save(properties, "property_rows")
        self.items = scratch.save(self._items(), "items")
        self.hot = hot_ends(self.relations, ["subclass", "superclass"], scratch, policy)
        self.hot |= {k: v for k, v in hot_ends(self.items, ["key"], scratch, policy).items()}
        names = F.explode(F.array("subclass", "superclass"))
        self.names = scratch.save(self.relations.select(names.alias("name")).unionAll(
            self.classes.select("name")
        ).distinct().withColumn("key", F.lower("name")), "names")
        self.given_keys = onto.classes.select(F.lower("name").alias("key")).distinct()
        self.given_properties = all_properties(onto).select("name")
        relations = self.relations.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_relations"))
        self.n_relations = scratch.save(relations, "n_relations")

    def _classes(self, rows: DataFrame) -> DataFrame:
        """``own_issue``: badly named, or repeating a class of its batch."""
        named = rows.select(
            "batch_id", "seq", "name", F.lower("name").alias("key"), starts_uppercase("name").alias("well"),
        )
        first = named.groupBy("batch_id", "key").agg(F.min(F.when(F.col("well"), F.col("seq"))).alias("first"))
        keyed = lambda df: df.withColumn("_own", F.struct("batch_id", "key")).drop("batch_id", "key")
        met = lookup_join(keyed(named), keyed(first), "_own", policy=self.policy, rows=self.n_rows)
        repeats = F.coalesce(F.col("first") < F.col("seq"), F.lit(False))
        return met.select("_own.*", "seq", "name", (repeats | F.coalesce(~F.col("well"), F.lit(False))).alias("own_issue"))

    def _with_own(self, rows: DataFrame, name: str) -> DataFrame:
        """``<name>_own``: the classes of the row's own batch with that name in any case."""
        keyed = rows.withColumn("_own", F.struct("batch_id", F.lower(name).alias("key")))
        return lookup_join(
            keyed, self.own.withColumnRenamed("own_names", f"{name}_own"), "_own", policy=self.policy, rows=self.n_rows
        ).drop("_own")

    def _relations(self, rows: DataFrame) -> DataFrame:
        """Relations with the classes of their own batch and what the given ontology states."""
        rows = rows.select("batch_id", "seq", "subclass", "superclass")
        sets = superclass_sets(self.onto)
        placed = self.onto.subclass_of.select(F.col("subclass").alias("class_name"), F.lit(True).alias("placed")).distinct()
        given = self.scratch.save(sets.join(placed, "class_name", "left"), "given")
        for end in ("subclass", "superclass"):
            rows = self._with_own(rows, end)
            facts = given.select(
                F.col("class_name").alias(end), F.col("supers").alias(f"{end}_given"), F.col("placed").alias(f"{end}_placed")
            )
            rows = lookup_join(rows, facts, end, policy=self.policy, rows=self.n_rows)
        return rows.drop("superclass_placed")

    def _items(self) -> DataFrame:
        """(batch_id, kind, seq, list, key, own): the classes that properties name."""
        both = F.explode(F.concat(*[
            F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("list"), x.alias("name")))
            for c in ("domain", "range")
        ]))
        rows = self.properties.select("batch_id", "kind", "seq", both.alias("x")).select("batch_id", "kind", "seq", "x.*")
        return self._with_own(rows, "name").select(
            "batch_id", "kind", "seq", "list", F.lower("name").alias("key"), F.col("name_own").isNotNull().alias("own")
        )

    # --------------------------------------------------------- state of a round

    def added(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        return lookup_join(rows, state.where("valid").select("batch_id"), "batch_id", "left_semi", self.policy, rows=self.n_rows)

    def states(self, state: DataFrame) -> dict[str, DataFrame]:
        """First places of all facts, given the verdicts: keys, names, properties, leaves per batch."""
        scratch = self.scratch
        first = lambda df, key: df.groupBy(key).agg(F.min("at").alias("at"))
        at = F.col("batch_id").alias("at")
        given = F.lit(BASE).cast("bigint").alias("at")
        classes, relations = self.added(self.classes, state), self.added(self.relations, state)
        keys = scratch.save(first(
            classes.select("key", at).unionAll(self.given_keys.select("key", given)), "key"
        ).withColumnRenamed("at", "key_at"), "keys")
        null = lambda kind: F.lit(None).cast(kind)
        stated = classes.select("name", at.alias("class_at"), null("bigint").alias("above_at"), null("struct<at:bigint,seq:bigint,up:string>").alias("up"))
        stated = stated.unionAll(self.onto.classes.select("name", given, null("bigint"), null("struct<at:bigint,seq:bigint,up:string>")))
        stated = stated.unionAll(relations.select(F.col("superclass"), null("bigint"), at, null("struct<at:bigint,seq:bigint,up:string>")))
        stated = stated.unionAll(self.onto.subclass_of.select("superclass", null("bigint"), given, null("struct<at:bigint,seq:bigint,up:string>")))
        stated = stated.unionAll(relations.select(
            F.col("subclass"), null("bigint"), null("bigint"), F.struct(at, "seq", F.col("superclass").alias("up"))
        ))
        facts = stated.groupBy("name").agg(
            F.min("class_at").alias("class_at"), F.min("above_at").alias("above_at"), F.min("up").alias("up")
        )
        facts = scratch.save(facts, "facts")
        names = scratch.save(self.names.join(by_shuffle(keys), "key", "left").join(by_shuffle(facts), "name", "left").select(
            "name", "key_at", "class_at", "above_at", F.col("up.at").alias("up_at"), F.col("up.up").alias("up")
        ), "names")
        properties = scratch.save(first(
            self.added(self.properties, state).select("name", at).unionAll(self.given_properties.select("name", given)), "name"
        ).withColumnRenamed("at", "property_at"), "properties")
        # A class nothing stands below counts from its batch until one that places a class under it.
        turns = facts.where("class_at is not null and not coalesce(above_at <= class_at, false)").select(F.explode(F.array(
            F.struct(F.col("class_at").alias("at"), F.lit(1).alias("d")),
            F.struct(F.col("above_at").alias("at"), F.lit(-1).alias("d")),
        )).alias("e")).select("e.*").where("at is not null")
        steps = turns.groupBy(F.col("at").alias("batch_id")).agg(F.sum("d").alias("d"))
        every = self.ids.select("batch_id").unionAll(steps.select("batch_id")).distinct().join(by_shuffle(steps), "batch_id", "left")
        totals = running_total(every.select("batch_id", F.coalesce("d", F.lit(0)).alias("d")), "batch_id", "d", "total", scratch)
        leaves = scratch.save(totals.select("batch_id", (F.col("total") - F.col("d")).alias("leaves")), "leaves")
        return {"keys": keys, "names": names, "properties": properties, "leaves": leaves}

    # ------------------------------------------------------------------ verdicts

    def judge(self, facts: dict[str, DataFrame], only: DataFrame | None) -> DataFrame:
        """(batch_id, valid, n_issues) of all batches, or of those in ``only``."""
        pick = (lambda df: df) if only is None else (
            lambda df: lookup_join(df, only, "batch_id", "left_semi", self.policy, rows=self.n_rows)
        )
        before = lambda c: F.coalesce(F.col(c) < F.col("batch_id"), F.lit(False))
        classes = lookup_join(pick(self.classes), facts["keys"], "key", policy=self.policy, rows=self.n_rows)
        of_class = classes.groupBy("batch_id").agg(F.sum((F.col("own_issue") | before("key_at")).cast("bigint")).alias("class_issues"))

        rows = pick(self.relations)
        for end in ("subclass", "superclass"):
            seen = facts["names"].select(F.col("name").alias(end), *[
                F.col(c).alias(f"{end}_{c}") for c in ("key_at", "class_at", "above_at", "up_at", "up")
            ])
            rows = lookup_join(rows, seen, end, policy=self.policy, hot=self.hot[end])
        no = F.lit(False)
        has = lambda end: F.col(f"{end}_own").isNotNull() | before(f"{end}_key_at")
        up = lambda end: F.when(before(f"{end}_up_at"), F.col(f"{end}_up"))  # noqa: E731  the added superclass
        none = F.array().cast("array<string>")

        def above(end: str):
            """The class itself, if it is one or is placed, and its superclasses, given and added."""
            exact = F.coalesce(F.array_contains(f"{end}_own", F.col(end)), no) | before(f"{end}_class_at") | up(end).isNotNull()
            return F.concat(
                F.coalesce(f"{end}_given", none), F.when(exact, F.array(end)).otherwise(none),
                F.when(up(end).isNotNull(), F.array(up(end))).otherwise(none),
            )

        rows = rows.withColumn(
            "code",
            F.when(~has("subclass"), F.lit("lost")).when(~has("superclass"), F.lit("lost"))
            .when(F.col("subclass") == F.col("superclass"), F.lit("wrong"))
            .when(F.arrays_overlap(above("subclass"), above("superclass")), F.lit("wrong")),
        )
        # The first good relation of a class in its batch; the key is bounded by the batch's rows of one class.
        mine = F.struct("batch_id", F.col("subclass").alias("name"))
        good = rows.where("code is null").groupBy(mine.alias("_mine")).agg(F.min("seq").alias("first_seq"))
        rows = lookup_join(rows.withColumn("_mine", mine), good, "_mine", policy=self.policy, rows=self.n_rows)
        again = (F.coalesce(F.col("code") != "lost", F.lit(True))) & (
            F.coalesce("subclass_placed", no) | up("subclass").isNotNull() | F.coalesce(F.col("first_seq") < F.col("seq"), no)
        )
        covers = F.when(
            F.col("code").isNull() & before("superclass_class_at") & ~before("superclass_above_at"), F.col("superclass")
        )
        judged = self.scratch.save(rows.select(
            "batch_id", "subclass", "code", covers.alias("covers"),
            (again.cast("bigint") + F.col("code").isNotNull().cast("bigint")).alias("n"),
        ), "judged")
        of_relation = judged.groupBy("batch_id").agg(F.sum("n").alias("relation_issues"))
        covered = judged.where("covers is not null").select("batch_id", "covers").distinct().groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("covered")
        )
        # New classes without a superclass: no good relation of the batch, none given, none added.
        below = judged.where("code is null").select("batch_id", F.col("subclass").alias("name")).distinct()
        placed = self.onto.subclass_of.select(F.col("subclass").alias("name")).distinct()
        bare = pick(self.classes).select("batch_id", "name").join(by_shuffle(below), ["batch_id", "name"], "left_anti").join(placed, "name", "left_anti")
        bare = lookup_join(bare, facts["names"].select("name", "up_at"), "name", policy=self.policy, rows=self.n_rows)
        of_bare = bare.where(~before("up_at")).groupBy("batch_id").agg(F.count(F.lit(1)).alias("bare"))

        items = lookup_join(pick(self.items), facts["keys"], "key", policy=self.policy, hot=self.hot["key"])
        missing = items.where(~(F.col("own") | before("key_at"))).select("batch_id", "kind", "seq").distinct()
        rows = pick(self.properties).select("batch_id", "name", "kind", "seq").join(
            by_shuffle(missing.withColumn("lost", F.lit(True))), ["batch_id", "kind", "seq"], "left"
        )
        mine = F.struct("batch_id", "name")
        good = rows.where("lost is null").groupBy(mine.alias("_mine")).agg(F.min("seq").alias("first_seq"))
        rows = lookup_join(rows.withColumn("_mine", mine), good, "_mine", policy=self.policy, rows=self.n_rows)
        rows = lookup_join(rows, facts["properties"], "name", policy=self.policy, rows=self.n_rows)
        bad = F.col("lost").isNotNull() | before("property_at") | F.coalesce(F.col("first_seq") < F.col("seq"), no)
        of_property = rows.groupBy("batch_id").agg(F.sum(bad.cast("bigint")).alias("property_issues"))

        out = pick(self.ids)
        for part in (of_class, of_relation, covered, of_bare, of_property, facts["leaves"]):
            out = out.join(by_shuffle(part), "batch_id", "left")
        n = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
        rootless = n("leaves") <= n("covered")
        roots = F.when(rootless & (n("bare") <= 1), 0).otherwise(n("bare"))
        issues = F.when(n("class_issues") > 0, n("class_issues")).otherwise(n("relation_issues") + roots + n("property_issues"))
        return out.select("batch_id", (issues == 0).alias("valid"), issues.cast("bigint").alias("n_issues"))

    def touched(self, old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
        """Batches that ask for a fact which has moved."""
        def moved(table: str, key: str) -> DataFrame:
            rows = new[table].select(key, F.struct(*[c for c in new[table].columns if c != key]).alias("now"))
            was = old[table].select(key, F.struct(*[c for c in old[table].columns if c != key]).alias("was"))
            return self.scratch.save(rows.join(by_shuffle(was), key, "full_outer").where("not (now <=> was)").select(key), "moved")

        keys, names, properties = moved("keys", "key"), moved("names", "name"), moved("properties", "name")
        parts = [
            self.classes.join(by_shuffle(keys), "key", "left_semi"), self.items.join(by_shuffle(keys), "key", "left_semi"),
            self.classes.join(by_shuffle(names), "name", "left_semi"), self.properties.join(by_shuffle(properties), "name", "left_semi"),
        ]
        for end in ("subclass", "superclass"):
            parts.append(self.relations.join(by_shuffle(names.withColumnRenamed("name", end)), end, "left_semi"))
        # Whether there is a root can change only where as few leaves are left as the batch may cover.
        leaves = new["leaves"].join(by_shuffle(old["leaves"].withColumnRenamed("leaves", "was")), "batch_id").join(
            by_shuffle(self.n_relations), "batch_id", "left"
        )
        few = F.least("leaves", "was") <= F.coalesce("n_relations", F.lit(0))
        out = leaves.where((F.col("leaves") != F.col("was")) & few).select("batch_id")
        for part in parts:
            out = out.unionAll(part.select("batch_id"))
        return self.scratch.save(out.distinct(), "touched")


def build_incremental(
    onto: Ontology, concept_batches: DataFrame, scratch: Scratch, closure: str = "direct",
    policy: SkewPolicy = DEFAULT_SKEW,
) -> tuple[Ontology, DataFrame]:
    """Add batches of concepts in ``batch_id`` order; a batch with issues is skipped as a whole.

    Returns the ontology and a log (batch_id, valid, n_issues). Rows are ordered by ``seq``
    within a batch, and all behind the batches before them. Rows without a batch are left out. With the
    transitive closure a relation can hang on any earlier one, so batches are then
    judged one after the other.
    """
    batches = scratch.save(concept_batches.where("batch_id is not null"), "concepts")
    if closure != "direct":
        return build_step_by_step(onto, batches, scratch, closure, policy)
    facts = _Facts(onto, batches, scratch, policy)
    state = scratch.save(facts.ids.select("batch_id", F.lit(True).alias("valid"), F.lit(0).cast("bigint").alias("n_issues")), "state")
    seen = facts.states(state)
    after = scratch.save(facts.judge(seen, None), "state")
    while True:
        moved = after.join(by_shuffle(state.select("batch_id", F.col("valid").alias("was"))), "batch_id").where("valid != was")
        if moved.isEmpty():
            break
        scratch.drop(state)
        state, old = after, seen
        seen = facts.states(state)
        again = facts.judge(seen, facts.touched(old, seen))
        after = scratch.save(
            state.join(by_shuffle(again.select("batch_id", F.struct("valid", "n_issues").alias("again"))), "batch_id", "left").select(
                "batch_id", F.coalesce("again.valid", "valid").alias("valid"), F.coalesce("again.n_issues", "n_issues").alias("n_issues")
            ), "state",
        )
        scratch.drop(*old.values())
    added = lookup_join(batches, after.where("valid").select("batch_id"), "batch_id", "left_semi", policy, rows=facts.n_rows)
    return extend(onto, split_concepts(added)), after
