"""Operations on a split class hierarchy, a whole table of them judged at once.

One by one, an operation is refused or applied against the hierarchy that those
before it left. ``replay`` gives the same history in few rounds:

* Operations that name classes of the same cluster form a group; groups do not
  touch each other's clusters, so all are judged together.
* In a group the merges and bridges up to the next prune are one least spanning
  forest of the clusters, ordered by operation: an operation joins clusters if and
  only if it owns an edge of that forest. A prune is judged when it comes first.
* Indexes are checked against the number of clusters, which only falls. It is known
  between two bounds, by running totals; what lies between them waits a round.
* What stands behind an operation whose refusal changes the forest waits as well.

Rounds follow the changes between merges and prunes within a group and the checks
that wait, not the number of operations. Relations carry the operation that added
and the one that dropped them, from which domains and ranges follow at the end.

Tables by operation have a row for each, in few bytes of a file: as files they look small
enough to broadcast long before they are. So all joins here are shuffled, none of
these tables passes the driver.

Results for odd rows: a null class or relation end is unknown to a merge or prune
and no relation to a bridge; a null or too small index is an unknown cluster; a kind
other than merge, bridge and prune is an ``unknown_operation``; rows of one ``op_seq``
go by their other columns; operations behind the last needed one are not in the history.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window, functions as F

from kgspark.operators.components import connected_components
from kgspark.operators.ontology import Ontology, restrict_properties
from kgspark.skew import DEFAULT_SKEW, SkewPolicy, by_shuffle, dense_index, lookup_join, running_total
from kgspark.storage import Scratch

# Number of cluster indexes each kind of operation takes.
ARITY = {"merge": 2, "bridge": 2, "prune": 1}
OP_COLUMNS = ["op_seq", "op", "indexes", "relations", "classes"]
# Relations added by operations are numbered behind those of the ontology.
FIRST_ADDED = 1 << 40
NEVER = (1 << 62)


def spanning_forest(edges: DataFrame, scratch: Scratch, policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """The edges (a, b, rank) of the least spanning forest; ranks are distinct.

    Every node picks its least edge, the picked edges contract to one node per
    component, and loops and parallel edges go, until no edge is left: at least
    half of the nodes go with every round.
    """
    def least(rows: DataFrame) -> DataFrame:
        return rows.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
            F.min("rank").alias("rank")
        )

    live = scratch.save(least(edges), "live")
    picked_ranks = live.select("rank").where(F.lit(False))
    while not live.isEmpty():
        ends = live.select(F.explode(F.array("a", "b")).alias("node"), "rank")
        best = ends.groupBy("node").agg(F.min("rank").alias("rank")).select("rank").distinct()
        picked = scratch.save(live.join(by_shuffle(best), "rank", "left_semi"), "picked")
        picked_ranks = picked_ranks.unionByName(picked.select("rank"))
        labels = connected_components(picked, scratch, policy=policy, shuffled=True)
        n = live.count()
        for end in ("a", "b"):
            live = lookup_join(
                live, labels.withColumnRenamed("node", end), end, policy=policy, rows=n, shuffled=True
            ).withColumn(end, F.coalesce("component", end)).drop("component")
        live = scratch.save(least(live), "live")
    return edges.join(by_shuffle(picked_ranks), "rank", "left_semi").select("a", "b", "rank")


class _Replay:
    """The tables of a replay: operations with their verdicts, classes, relations."""

    def __init__(self, onto: Ontology, ops: DataFrame, scratch: Scratch, policy: SkewPolicy):
        self.scratch, self.policy = scratch, policy
        save = scratch.save
        numbered = dense_index(ops.select(OP_COLUMNS), [F.asc(c) for c in OP_COLUMNS], "pos", scratch)
        self.ops = save(numbered, "ops")
        kind_arity = F.coalesce(*[F.when(F.col("op") == k, F.lit(n)) for k, n in ARITY.items()])
        names = F.when(F.col("op") == "prune", F.coalesce("classes", F.array())).otherwise(
            F.flatten(F.transform(
                F.coalesce("relations", F.array()), lambda r: F.array(r["subclass"], r["superclass"])
            ))
        )
        size = F.coalesce(F.size("indexes"), F.lit(0))
        heads = self.ops.select(
            "pos", "op", kind_arity.alias("arity"), size.alias("given"),
            F.coalesce(F.array_max("indexes"), F.lit(0)).alias("top"),
            F.coalesce(F.exists("indexes", lambda i: i.isNull() | (i < 1)), F.lit(False)).alias("bad_index"),
            names.alias("names"),
        ).select(
            "pos", "op", "top", "bad_index",
            F.exists("names", lambda x: x.isNull()).alias("has_null"),
            # A relation joins two clusters at most, a pruned class stands in one.
            F.when(F.col("op") == "prune", F.size("names")).otherwise(F.size("names") / 2).cast("long").alias("most"),
            F.when(F.col("arity").isNull(), "unknown_operation")
            .when(F.col("given") != F.col("arity"), "wrong_arity").alias("error"),
        )
        heads = save(heads, "heads")
        self.done = save(heads.where("error is not null").select(
            "pos", F.lit("error").alias("verdict"), "error", F.lit(0).cast("long").alias("drops"), F.lit(0).alias("round")
        ), "done")
        self.pending = save(heads.where("error is null").drop("error"), "pending")
        # Relations of operations, and the classes that each one names.
        relations = self.ops.where("op in ('merge', 'bridge')").select(
            "pos", F.posexplode("relations").alias("i", "r")
        ).select("pos", "i", F.col("r.subclass").alias("subclass"), F.col("r.superclass").alias("superclass"))
        self.asked = save(relations.where("subclass is not null and superclass is not null"), "asked")
        pruned = self.ops.where("op = 'prune'").select("pos", F.explode("classes").alias("name"))
        self.named = save(
            self.asked.select("pos", F.explode(F.array("subclass", "superclass")).alias("name"))
            .unionByName(pruned.where("name is not null")).distinct(), "named",
        )
        self.members = save(connected_components(
            onto.subclass_of, scratch, "subclass", "superclass", policy=policy, shuffled=True
        ), "members")
        self.edges = save(onto.subclass_of.select(
            "subclass", "superclass", "seq",
            F.lit(-1).cast("long").alias("born"), F.lit(NEVER).alias("died"),
        ), "edges")
        self.clusters = self.members.select("component").distinct().count()
        self.round = 0

    def component_of(self, rows: DataFrame, column: str, n: int) -> DataFrame:
        """Add ``component`` of the class in ``column``, or null."""
        return lookup_join(rows, self.members.withColumnRenamed("node", column), column, policy=self.policy, rows=n, shuffled=True)

    def high(self) -> DataFrame:
        """(pos, high) of every operation: the clusters before it, if no pending one drops any."""
        drops = self.done.select("pos", "drops").unionByName(
            self.pending.select("pos", F.lit(0).cast("long").alias("drops"))
        )
        totals = running_total(drops, "pos", "drops", "upto", self.scratch)
        return totals.select("pos", (F.lit(self.clusters) - F.col("upto") + F.col("drops")).alias("high"))

    def groups(self, touched: DataFrame) -> DataFrame:
        """(pos, grp): operations linked by the clusters and new classes they name."""
        links = touched.select(
            F.concat(F.lit("o"), F.col("pos").cast("string")).alias("a"), F.concat(F.lit("r"), "resource").alias("b")
        ).unionByName(self.pending.select(
            F.concat(F.lit("o"), F.col("pos").cast("string")).alias("a"),
            F.concat(F.lit("o"), F.col("pos").cast("string")).alias("b"),
        ))
        found = connected_components(links.distinct(), self.scratch, policy=self.policy, shuffled=True)
        return found.where("node like 'o%'").select(
            F.expr("cast(substring(node, 2) as bigint)").alias("pos"), F.col("component").alias("grp")
        )

    def step(self) -> None:
        """Judge all operations that this round can, and apply those accepted."""
        save, policy = self.scratch.save, self.policy
        self.round += 1
        n_named = self.named.count()
        touched = save(self.component_of(
            self.named.join(by_shuffle(self.pending.select("pos")), "pos", "left_semi"), "name", n_named
        ).withColumn("resource", F.coalesce("component", "name")), "touched")
        work = self.pending.join(by_shuffle(self.high()), "pos").join(by_shuffle(self.groups(touched)), "pos").withColumn(
            "able", F.expr("not bad_index and top <= high and high >= 2")
        )
        work = save(work, "work")

        # New classes, by the first bridge that may bring them in.
        brought = save(
            touched.where("component is null").join(by_shuffle(work.where("able and op = 'bridge'").select("pos")), "pos")
            .groupBy("name").agg(F.min("pos").alias("bringer")), "brought",
        )
        strange = touched.where("component is null").join(by_shuffle(brought), "name", "left").where(
            "bringer is null or bringer >= pos"
        ).select("pos").distinct().withColumn("strange", F.lit(True))
        work = work.join(by_shuffle(strange), "pos", "left").withColumn(
            "unknown", F.expr("op != 'bridge' and (has_null or coalesce(strange, false))")
        ).drop("strange").withColumn("live", F.expr("able and not unknown"))
        cuts = work.where("live").groupBy("grp").agg(
            F.min("pos").alias("first"), F.min(F.when(F.col("op") == "prune", F.col("pos"))).alias("prune")
        )
        work = save(work.join(by_shuffle(cuts), "grp", "left").withColumn(
            "active", F.expr("live and ((op = 'prune' and pos = first) or "
                             "(op != 'prune' and pos < coalesce(prune, pos + 1)))")
        ), "work")

        forest = self._forest(work)
        after = self._after_prunes(work, touched)
        joins = forest.groupBy(F.col("rank.pos").alias("pos")).agg(F.count(F.lit(1)).alias("joins"))
        news = brought.groupBy(F.col("bringer").alias("pos")).agg(F.count(F.lit(1)).alias("news"))
        pruned = after.groupBy("pos").agg((F.countDistinct("old") - F.countDistinct("component")).alias("pruned"))
        work = work.join(by_shuffle(joins), "pos", "left").join(by_shuffle(news), "pos", "left").join(
            by_shuffle(pruned), "pos", "left"
        ).withColumn("drops", F.when(F.col("active"), F.when(
            F.col("op") == "prune", F.coalesce("pruned", F.lit(0))
        ).otherwise(F.coalesce("joins", F.lit(0)) - F.coalesce("news", F.lit(0)))))
        # The last operation of a group that is judged for certain: the prune that is first,
        # the one before the next prune, or a bridge whose new class does not come.
        spoiled = F.min(F.when(
            F.expr("active and op = 'bridge' and coalesce(news, 0) > 0 and drops <= 0"), F.col("pos")
        )).over(Window.partitionBy("grp"))
        work = save(work.withColumn("last", F.least(
            F.coalesce(spoiled, F.lit(NEVER)),
            F.expr(f"case when prune is null then {NEVER} when prune = first then prune else prune - 1 end"),
        )), "work")

        # The fewest clusters there can be before each operation.
        most = work.select("pos", F.expr(
            "case when not live then 0L when active and pos <= last then greatest(drops, 0L) else most end"
        ).alias("most"))
        fewest = running_total(most, "pos", "most", "upto", self.scratch).select(
            "pos", (F.col("upto") - F.col("most")).alias("before")
        )
        work = work.join(by_shuffle(fewest), "pos").withColumn("low", F.expr("high - before"))
        waits = F.min(F.when(
            F.expr("active and pos <= last and (top > low or (drops > 0 and low < 2))"), F.col("pos")
        )).over(Window.partitionBy("grp"))
        work = work.withColumn("waits", waits).where("pos <= last and pos < coalesce(waits, pos + 1)")
        verdicts = save(work.select(
            "pos", F.expr("if(active and drops > 0, op, 'error')").alias("verdict"),
            F.expr("""case when unknown then 'unknown_class' when not active then 'unknown_cluster'
                      when drops <= 0 then 'clusters_not_reduced' end""").alias("error"),
            F.expr("if(active and drops > 0, drops, 0L)").alias("drops"), F.lit(self.round).alias("round"),
        ), "verdicts")
        if verdicts.isEmpty():
            raise RuntimeError("no operation could be judged")
        self._apply(verdicts, forest, after, touched)
        self.done = save(self.done.unionByName(verdicts), "done")
        self.pending = save(self.pending.join(by_shuffle(verdicts.select("pos")), "pos", "left_anti"), "pending")

    def _forest(self, work: DataFrame) -> DataFrame:
        """Forest edges (a, b, rank (pos, i)) of the active merges and bridges over the clusters."""
        edges = self.asked.join(by_shuffle(work.where("active and op != 'prune'").select("pos")), "pos", "left_semi")
        n = self.asked.count()
        for column, end in (("subclass", "a"), ("superclass", "b")):
            edges = self.component_of(edges, column, n).withColumn(end, F.coalesce("component", column)).drop("component")
        edges = self.scratch.save(edges.select("a", "b", F.struct("pos", "i").alias("rank")), "asks")
        return self.scratch.save(spanning_forest(edges, self.scratch, self.policy), "forest")

    def _after_prunes(self, work: DataFrame, touched: DataFrame) -> DataFrame:
        """(pos, old, node, component) of the clusters that active prunes touch.

        One row per class that keeps a relation, and one without a class per old cluster.
        """
        hit = self.scratch.save(touched.join(
            by_shuffle(work.where("active and op = 'prune'").select("pos")), "pos", "left_semi"
        ).select("pos", "name", F.col("component").alias("old")), "hit")
        olds = self.scratch.save(hit.select("pos", "old").distinct(), "olds")
        if olds.isEmpty():
            return olds.select("pos", "old", F.lit(None).cast("string").alias("node"),
                               F.lit(None).cast("string").alias("component"))
        gone = hit.select(F.col("name").alias("node")).withColumn("gone", F.lit(True))
        rows = lookup_join(
            self.members.withColumnRenamed("component", "old"), olds, "old", "inner", self.policy, rows=self.members.count(),
            shuffled=True,
        ).join(by_shuffle(gone), "node", "left")
        inside = self.scratch.save(rows.where("gone is null"), "inside")
        left = self.edges.where(F.col("died") == NEVER).select("subclass", "superclass")
        n = self.edges.count()
        for end in ("subclass", "superclass"):
            names = inside.select(F.col("node").alias(end))
            left = lookup_join(left, names, end, "left_semi", self.policy, rows=n, shuffled=True)
        pieces = connected_components(left, self.scratch, "subclass", "superclass", policy=self.policy, shuffled=True)
        kept = pieces.join(by_shuffle(inside.select("node", "pos", "old")), "node")
        return self.scratch.save(kept.select("pos", "old", "node", "component").unionByName(
            olds.select("pos", "old", F.lit(None).cast("string").alias("node"), F.lit(None).cast("string").alias("component"))
        ), "after")

    def _apply(self, verdicts: DataFrame, forest: DataFrame, after: DataFrame, touched: DataFrame) -> None:
        save = self.scratch.save
        merged = verdicts.where("verdict in ('merge', 'bridge')").select("pos")
        pruned = verdicts.where("verdict = 'prune'").select("pos")
        if not merged.isEmpty():
            links = forest.join(by_shuffle(merged.withColumn("rank", F.col("pos")).select(F.col("rank").alias("p"))),
                                F.col("rank.pos") == F.col("p"), "left_semi")
            labels = connected_components(links, self.scratch, policy=self.policy, shuffled=True).select(
                F.col("node").alias("component"), F.col("component").alias("label")
            )
            new = touched.where("component is null").join(by_shuffle(merged), "pos", "left_semi").select("name").distinct()
            members = self.members.unionByName(new.select(F.col("name").alias("node"), F.col("name").alias("component")))
            n = self.members.count() + touched.count()
            members = save(lookup_join(members, labels, "component", policy=self.policy, rows=n, shuffled=True).select(
                "node", F.coalesce("label", "component").alias("component")
            ), "members")
            there = self.edges.where(F.col("died") == NEVER).select("subclass", "superclass")
            added = self.asked.join(by_shuffle(merged), "pos", "left_semi").join(
                by_shuffle(there), ["subclass", "superclass"], "left_anti"
            ).groupBy("subclass", "superclass").agg(F.min(F.struct("pos", "i")).alias("by"))
            edges = self.edges.unionByName(added.select(
                "subclass", "superclass", (F.lit(FIRST_ADDED) + F.col("by.pos") * 1000 + F.col("by.i")).alias("seq"),
                F.col("by.pos").alias("born"), F.lit(NEVER).alias("died"),
            ))
            self.members, self.edges = members, save(edges, "edges")
        if not pruned.isEmpty():
            hit = save(touched.join(by_shuffle(pruned), "pos", "left_semi").select("name", F.col("pos").alias("by")), "hit")
            n = self.edges.count()
            edges = self.edges
            for end in ("subclass", "superclass"):
                edges = lookup_join(edges, hit.withColumnRenamed("name", end), end, policy=self.policy, rows=n, shuffled=True)
                edges = edges.withColumn(
                    "died", F.when((F.col("died") == NEVER) & F.col("by").isNotNull(), F.col("by")).otherwise(F.col("died"))
                ).drop("by")
            split = after.join(by_shuffle(pruned), "pos", "left_semi")
            olds = split.select(F.col("old").alias("component")).distinct()
            members = self.members.join(by_shuffle(olds), "component", "left_anti").select("node", "component").unionByName(
                split.where("node is not null").select("node", "component")
            )
            self.members, self.edges = save(members, "members"), save(edges.select(self.edges.columns), "edges")

    def history(self) -> DataFrame:
        """(operation columns, error, pos, round) of the operations before the hierarchy was one piece."""
        reached = self.high().where("high >= 2")
        return self.scratch.save(
            self.ops.join(by_shuffle(self.done.drop("drops")), "pos").join(by_shuffle(reached.select("pos")), "pos", "left_semi"), "history"
        )

    def ontology(self, onto: Ontology) -> Ontology:
        """The ontology after all accepted operations.

        A merge or bridge takes classes without a relation out of domains and ranges, a
        prune those it names: a class stays if it is not pruned and its relations
        cover the time behind every merge or bridge.
        """
        accepted = self.done.where("verdict != 'error'").select("pos", "verdict")
        if accepted.isEmpty():
            return onto
        edges = self.edges.where(F.col("died") == NEVER).select("subclass", "superclass", "seq")
        joins = accepted.where("verdict != 'prune'").select("pos")
        names = onto.object_properties.select(F.explode(F.concat("domain", "range")).alias("class_name")).unionByName(
            onto.data_properties.select(F.explode("domain").alias("class_name"))
        ).where("class_name is not null").distinct()
        pruned = self.named.join(by_shuffle(accepted.where("verdict = 'prune'").select("pos")), "pos", "left_semi")
        names = names.join(by_shuffle(pruned.select(F.col("name").alias("class_name")).distinct()), "class_name", "left_anti")
        total = joins.count()
        if total:
            names = names.join(by_shuffle(self._always_related(joins, total)), "class_name", "left_semi")
        return restrict_properties(replace(onto, subclass_of=edges), self.scratch.save(names, "kept"), "left_semi")

    def _always_related(self, joins: DataFrame, total: int) -> DataFrame:
        """(class_name): classes in a relation behind each of the ``total`` accepted merges and bridges.

        ``turn`` numbers merges and bridges; a relation is there from one turn up to another.
        """
        marks = joins.select("pos", F.lit(1).cast("long").alias("one")).unionByName(
            self.edges.select(F.explode(F.array("born", "died")).alias("pos")).distinct()
            .where(f"pos >= 0 and pos < {NEVER}").join(by_shuffle(joins), "pos", "left_anti")
            .select("pos", F.lit(0).cast("long").alias("one"))
        )
        turns = running_total(marks, "pos", "one", "upto", self.scratch)
        turns = self.scratch.save(turns.select("pos", (F.col("upto") - F.col("one")).alias("turn")), "turns")
        spans = self.edges.select(F.explode(F.array("subclass", "superclass")).alias("class_name"), "born", "died")
        spans = spans.groupBy("class_name", "born").agg(F.max("died").alias("died"))
        for end in ("born", "died"):
            spans = lookup_join(
                spans, turns.withColumnRenamed("pos", end), end, policy=self.policy, shuffled=True
            ).withColumn(end, F.coalesce("turn", F.when(F.col(end) < 0, F.lit(0)).otherwise(F.lit(total)))).drop("turn")
        # Turns that a span covers and no earlier one of its class does.
        reach = F.max("died").over(
            Window.partitionBy("class_name").orderBy("born", "died").rowsBetween(Window.unboundedPreceding, -1)
        )
        own = F.greatest(F.col("died") - F.greatest("born", F.coalesce(reach, F.lit(0))), F.lit(0))
        return spans.withColumn("own", own).groupBy("class_name").agg(F.sum("own").alias("n")).where(
            F.col("n") == total
        ).select("class_name")


def replay(
    onto: Ontology, ops: DataFrame, scratch: Scratch, policy: SkewPolicy = DEFAULT_SKEW
) -> tuple[Ontology, DataFrame]:
    """(ontology, history (operation columns, error, pos, round)) of a table of operations.

    The same as one by one in ``op_seq`` order until the hierarchy is one piece;
    ``round`` is the round that judged a row, 0 for those refused as they are.
    """
    state = _Replay(onto, ops, scratch, policy)
    while not state.pending.isEmpty():
        state.step()
    history = state.history().select(*OP_COLUMNS, "error", "pos", "round")
    return state.ontology(onto), history
