"""Triple tables: validation against an ontology by joins, accumulation by sets.

The ordered, row-by-row rules are restated per group: the first isA row of an
entity that passes its own tests defines the type, everything else is judged by
lookups. So there is no scan in order, no window over a hot entity, and one
shuffle per triple end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from kgspark import schemas
from kgspark.functions.scalars import is_snake_case, triple_to_string
from kgspark.operators.ontology import Ontology, all_properties, class_names, superclass_sets
from kgspark.skew import DEFAULT_SKEW, NO_HOT_KEYS, SkewPolicy, hot_ends, lookup_join, packed_join, too_small
from kgspark.storage import Scratch, local_table, path_exists

SPO = ["subject", "predicate", "object"]
IS_A = "isA"


# ------------------------------------------------------------------ set ops

MANY_PREDICATES = 1_000  # names that reach the driver


def predicates_of(triples: DataFrame) -> list[str | None] | None:
    """The predicates that occur, or None if they are many."""
    found = triples.select("predicate").distinct().limit(MANY_PREDICATES + 1).collect()
    return None if len(found) > MANY_PREDICATES else [r["predicate"] for r in found]


def has_predicate(names: list[str | None]) -> Column:
    """Is the row's predicate among the names? Nulls are equal."""
    among = F.coalesce(F.col("predicate").isin([n for n in names if n is not None]), F.lit(False))
    return among | F.col("predicate").isNull() if None in names else among


def new_triples(
    triples: DataFrame, kg: DataFrame, policy: SkewPolicy = DEFAULT_SKEW, is_set: bool = False
) -> DataFrame:
    """Rows whose triple is not in the graph yet; copies of a hot triple are spread.

    Copies in the graph are merged first, unless ``is_set`` tells that it has none. Triples
    with a predicate that the graph does not use are new as they are, and are not shuffled.
    """
    small = too_small(triples, policy)
    known = kg.select(*SPO)
    known = known if is_set else known.distinct()
    names = None if small else predicates_of(kg)
    if names is None:
        return packed_join(triples, known, SPO, "left_anti", policy, NO_HOT_KEYS if small else None)
    asked = has_predicate(names)
    found = packed_join(triples.where(asked), known, SPO, "left_anti", policy)
    return found.unionByName(triples.where(~asked))


def accumulate(*parts: DataFrame) -> DataFrame:
    """Set union of triples; copies are merged before the shuffle."""
    rows = parts[0].select(*SPO)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*SPO))
    return rows.distinct()


def accumulate_first(triples: DataFrame) -> DataFrame:
    """Set of triples, each with the place (batch_id, seq) where it came first."""
    return triples.groupBy(*SPO).agg(
        F.min(F.struct("batch_id", "seq")).alias("at")
    ).select(*SPO, "at.batch_id", "at.seq")


def entity_types(triples: DataFrame) -> DataFrame:
    """(subject, class_name): the first accepted isA row of each entity.

    First by (epoch, batch_id, seq); a table without epochs is one epoch.
    """
    order = [c for c in ("epoch", "batch_id", "seq") if c in triples.columns]
    return (
        triples.where(F.col("predicate") == IS_A)
        .groupBy("subject")
        .agg(F.min(F.struct(*order, "object")).alias("first"))
        .select("subject", F.col("first.object").alias("class_name"))
    )


def to_digraph_edges(triples: DataFrame) -> DataFrame:
    """One edge per (source, target); the last label wins."""
    return triples.groupBy(
        F.col("subject").alias("source"), F.col("object").alias("target")
    ).agg(F.max(F.struct("batch_id", "seq", "predicate")).alias("last")).select(
        "source", "target", F.col("last.predicate").alias("label")
    )


def is_valid_for(subject_supers: Column, object_supers: Column, domain: Column, range_: Column) -> Column:
    """Some superclass of the subject in the domain and of the object in the range."""
    return F.arrays_overlap(subject_supers, domain) & F.arrays_overlap(object_supers, range_)


# --------------------------------------------------------------- validation

@dataclass(frozen=True)
class Rules:
    """What validation asks of an ontology, as three written lookup tables."""

    names: DataFrame
    properties: DataFrame
    supers: DataFrame


def prepare_rules(onto: Ontology, scratch: Scratch, closure: str = "direct") -> Rules:
    return Rules(
        scratch.save(class_names(onto).select("name_key"), "names"),
        scratch.save(all_properties(onto).withColumnRenamed("name", "predicate"), "properties"),
        scratch.save(superclass_sets(onto, closure, scratch), "supers"),
    )


# Joins with ontology tables are plain: these are schema-sized, Spark measures
# them and broadcasts them if they are small, else adaptive execution splits the
# skewed parts. Joins with the types of entities grow with the graph, and use
# lookup_join with hot keys found once on the input triples.

def _flag(df: DataFrame, column: str, names: DataFrame, out: str) -> DataFrame:
    """Add ``out``: does some class have the name in ``column``, in any case?"""
    keyed = df.withColumn("name_key", F.lower(column))
    marked = keyed.join(names.select("name_key", F.lit(True).alias(out)), "name_key", "left")
    return marked.withColumn(out, F.coalesce(out, F.lit(False))).drop("name_key")


def _with_class_flags(triples: DataFrame, rules: Rules) -> DataFrame:
    rows = _flag(triples, "subject", rules.names, "subject_is_class")
    return _flag(rows, "object", rules.names, "object_is_class")


def _defining(rows: DataFrame) -> DataFrame:
    """isA rows that could define the type of their subject."""
    return rows.where(
        (F.col("predicate") == IS_A) & F.col("object_is_class") & ~F.col("subject_is_class")
    )


def _join_supers(rows: DataFrame, rules: Rules, column: str, out: str) -> DataFrame:
    table = rules.supers.select(F.col("class_name").alias(column), F.col("supers").alias(out))
    return rows.join(table, column, "left")


def _isa_code() -> Column:
    """Verdict on an isA row; ``def_*`` describe the defining row of the subject."""
    later = F.col("def_class").isNotNull()
    narrower = F.coalesce(F.array_contains("object_type_supers", F.col("def_class")), F.lit(False))
    return (
        F.when(later & (narrower | F.col("is_definer") | F.col("is_repeat")), F.lit(None))
        .when(later & ~is_snake_case("subject"), F.lit("isa_not_snake_case"))
        .when(later, F.lit("isa_reclassified"))
        .when(~F.col("object_is_class"), F.lit("isa_unknown_class"))
        .when(F.col("subject_is_class"), F.lit("isa_subject_is_class"))
    )


def _property_code() -> Column:
    """Verdict on a property row, first rule that fails."""
    is_object = F.col("kind") == "object"
    fits = F.coalesce(
        is_valid_for(
            F.col("subject_supers"), F.col("object_supers"), F.col("domain"), F.col("range")
        ),
        F.lit(False),
    )
    return (
        F.when(F.col("kind").isNull(), F.lit("unknown_property"))
        .when(F.col("subject_type").isNull(), F.lit("subject_untyped"))
        .when(F.col("subject_is_class"), F.lit("subject_is_class"))
        .when(F.col("object_is_class"), F.lit("object_is_class"))
        .when(~F.col("subject_snake"), F.lit("subject_not_snake_case"))
        .when(is_object & F.col("object_type").isNull(), F.lit("object_untyped"))
        .when(is_object & ~fits, F.lit("domain_range_mismatch"))
        .when(is_object & ~F.col("object_snake"), F.lit("object_not_snake_case"))
    )


def _facts(rows: DataFrame, rules: Rules) -> DataFrame:
    """Property rows with their ``kind`` and what the names of both ends tell.

    Domains, ranges and superclasses are joined behind the lookups of types, so that they
    are not shuffled with every row; nor is an end whose lookup is done, unless it is asked for.
    """
    kinds = rules.properties.select("predicate", "kind")
    return rows.where(F.col("predicate") != IS_A).join(kinds, "predicate", "left").withColumn(
        "subject_snake", is_snake_case("subject")
    ).withColumn("object_snake", is_snake_case("object"))


def _by_kind(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of object properties, and the others: only the first ask for the object's type.

    Literals repeat a lot; they are neither shuffled by object nor looked up.
    """
    is_object = F.coalesce(F.col("kind") == "object", F.lit(False))
    return facts.where(is_object).withColumn("kind", F.lit("object")), facts.where(~is_object)


def _judged_facts(links: DataFrame, others: DataFrame, rules: Rules, columns: list[str]) -> DataFrame:
    """``columns`` and ``error_code`` of property rows, once the types of their ends are known."""
    links = links.join(rules.properties.select("predicate", "domain", "range"), "predicate", "left")
    links = _join_supers(_join_supers(links, rules, "subject_type", "subject_supers"), rules, "object_type", "object_supers")
    for name, kind in (
        ("object_type", "string"), ("subject_supers", "array<string>"), ("object_supers", "array<string>"),
        ("domain", "array<string>"), ("range", "array<string>"),
    ):
        others = others.withColumn(name, F.lit(None).cast(kind))
    code = _property_code().alias("error_code")
    return links.select(*columns, code).unionByName(others.select(*columns, code))


BEFORE_ALL = -(1 << 62)  # batch of a type that was known beforehand


def _prior_types(prior: DataFrame) -> DataFrame:
    return entity_types(prior).withColumnRenamed("class_name", "prior_class")


def validate(
    triples: DataFrame,
    onto: Ontology | Rules | None,
    scratch: Scratch,
    prior: DataFrame | None = None,
    closure: str = "direct",
    policy: SkewPolicy = DEFAULT_SKEW,
    prior_is_set: bool = False,
) -> DataFrame:
    """Row mode: every row judged on its own; ``error_code`` is null if accepted.

    Equals quarantining bad rows one by one in (batch_id, seq) order, where the
    isA rows of a batch are read before its property rows. A type is seen by a
    batch if its defining row lies in the same or an earlier batch. Rows already
    in ``prior`` are left out, not judged. Without an ontology all rows pass.
    ``prior_is_set`` tells that no triple is twice in ``prior``.
    """
    if prior is not None:
        # Read several times below, and the product of a join: written once.
        triples = scratch.save(new_triples(triples, prior, policy, prior_is_set), "new")
    if onto is None:
        return triples.withColumn("error_code", F.lit(None).cast("string"))
    rules = onto if isinstance(onto, Rules) else prepare_rules(onto, scratch, closure)
    columns = triples.columns
    # The rows are read three times (hot keys, types, verdicts), each time only the
    # columns needed. A caller whose input is costly to compute pins it first.
    rows = _with_class_flags(triples, rules)
    hot = hot_ends(triples, ["subject", "object"], scratch, policy)

    first = (
        _defining(rows)
        .groupBy("subject")
        .agg(F.min(F.struct("batch_id", "seq", "object")).alias("d"))
        .select("subject", "d.batch_id", "d.seq", F.col("d.object").alias("class"))
    )
    if prior is None:
        types = first.toDF("subject", "def_batch", "def_seq", "def_class")
    else:
        given = F.col("prior_class").isNotNull()
        types = first.join(_prior_types(prior), "subject", "full_outer").select(
            "subject",
            F.when(given, F.lit(BEFORE_ALL)).otherwise(F.col("batch_id")).alias("def_batch"),
            F.when(given, F.lit(-1)).otherwise(F.col("seq")).alias("def_seq"),
            F.coalesce("prior_class", "class").alias("def_class"),
        )
    types = scratch.save(types, "types")

    isa = lookup_join(rows.where(F.col("predicate") == IS_A), types, "subject", hot=hot["subject"])
    place = F.struct("batch_id", "seq")
    definer = F.struct(F.col("def_batch"), F.col("def_seq"))
    isa = isa.withColumn("order", F.when(place == definer, 0).when(place > definer, 1).otherwise(-1))
    isa = isa.withColumn(
        "def_class", F.when(F.col("order") >= 0, F.col("def_class"))
    ).withColumn(
        "is_definer", F.col("order") == 0
    ).withColumn(
        # a copy of the defining row in a later batch is a known triple
        "is_repeat",
        F.coalesce(
            (F.col("order") > 0) & (F.col("object") == F.col("def_class"))
            & (F.col("batch_id") > F.col("def_batch")),
            F.lit(False),
        ),
    )
    isa = isa.withColumn("object_class", F.col("object"))
    isa = _join_supers(isa, rules, "object_class", "object_type_supers")
    isa = isa.select(*columns, _isa_code().alias("error_code"))

    def typed(facts: DataFrame, end: str) -> DataFrame:
        seen = types.select(
            F.col("subject").alias(end),
            F.col("def_batch").alias("seen_from"),
            F.col("def_class").alias("seen_class"),
        )
        facts = lookup_join(facts, seen, end, hot=hot[end])
        return facts.withColumn(
            f"{end}_type", F.when(F.col("seen_from") <= F.col("batch_id"), F.col("seen_class"))
        ).drop("seen_from", "seen_class")

    links, others = _by_kind(typed(_facts(rows, rules), "subject"))
    return isa.unionByName(_judged_facts(typed(links, "object"), others, rules, columns))


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where("error_code is null").drop("error_code")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where("error_code is not null")


# What each code says about its row; the row itself is put in front.
ERROR_TEXT = {
    "isa_reclassified": "the entity already has another class",
    "isa_not_snake_case": "the entity must be named in snake_case",
    "isa_unknown_class": "the object is not a class of the ontology",
    "isa_subject_is_class": "the subject is a class, not an entity",
    "unknown_property": "the predicate is not a property of the ontology",
    "subject_untyped": "the subject has no class; state its isA triple first",
    "subject_is_class": "the subject is a class, not an entity",
    "object_is_class": "the object is a class, not an entity",
    "subject_not_snake_case": "the subject must be named in snake_case",
    "object_untyped": "the object has no class; state its isA triple first",
    "domain_range_mismatch": "the property does not connect entities of these classes",
    "object_not_snake_case": "the object must be named in snake_case",
}


def error_messages(judged: DataFrame) -> DataFrame:
    """Rejected rows with a readable ``message``."""
    text = F.lit(None).cast("string")
    for code, message in ERROR_TEXT.items():
        text = F.when(F.col("error_code") == code, F.lit(message)).otherwise(text)
    return rejected(judged).withColumn(
        "message", F.concat(triple_to_string(*SPO), F.lit(": "), text)
    )


def validation_report(judged: DataFrame) -> DataFrame:
    """Per batch: rows, errors, verdict and the codes that occur (at most twelve)."""
    return (
        judged.groupBy("batch_id", "error_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("batch_id")
        .agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("error_code").isNotNull(), F.col("n"))), F.lit(0)).alias("n_errors"),
            F.array_join(F.sort_array(F.collect_set("error_code")), ",").alias("codes"),
        )
        .withColumn("valid", F.col("n_errors") == 0)
    )


# --------------------------------------------------------------- batch mode

def accept_batches(
    triples: DataFrame,
    onto: Ontology | Rules | None,
    scratch: Scratch,
    prior: DataFrame | None = None,
    closure: str = "direct",
    policy: SkewPolicy = DEFAULT_SKEW,
    prior_is_set: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Batch mode: a batch with any error is rejected whole.

    Whether a batch is accepted depends only on accepted earlier batches. What each
    batch asks of them is found once (``_batch_needs``): most of it comes down to batches that
    must be accepted. Rounds over these small tables follow, until the set no longer
    changes. Rounds needed: depth of the dependencies. Single rows are judged only
    against the final types, when the judged rows are read.
    ``prior_is_set`` tells that no triple is twice in ``prior``.
    Returns (judged rows, batches (batch_id, accepted)).
    """
    if prior is not None:
        triples = scratch.save(new_triples(triples, prior, policy, prior_is_set), "new")
    if onto is None:
        judged = triples.withColumn("error_code", F.lit(None).cast("string"))
        return judged, _all_accepted(triples)
    rules = onto if isinstance(onto, Rules) else prepare_rules(onto, scratch, closure)
    rows, hot, own, batches = _verdicts(triples, rules, scratch, prior, policy)
    types = _types_before(own, batches, prior, policy, hot)
    return _judge_batches(rows, own, types, rules, triples.columns, policy, hot), batches


def _all_accepted(triples: DataFrame) -> DataFrame:
    return triples.select("batch_id").distinct().withColumn("accepted", F.lit(True))


def _verdicts(
    triples: DataFrame, rules: Rules, scratch: Scratch, prior: DataFrame | None, policy: SkewPolicy
) -> tuple[DataFrame, dict, DataFrame, DataFrame]:
    """(rows with class flags, hot ends, types by batch, batches (batch_id, accepted)) of new triples."""
    rows = _with_class_flags(triples, rules)
    hot = hot_ends(triples, ["subject", "object"], scratch, policy)
    own = _own_types(rows, rules, scratch)
    needs, many = _batch_needs(rows, own, rules, scratch, prior, hot, policy)
    return rows, hot, own, _settle(needs, many, rules, scratch, policy)


def _own_types(rows: DataFrame, rules: Rules, scratch: Scratch) -> DataFrame:
    """(subject, batch_id, own_seq, own_class, asks, never): per entity and batch.

    The class that the batch gives the entity, which does not depend on what is accepted; the
    properties it is subject of; and whether a property row fails whatever the types are.
    """
    kinds = rules.properties.select("predicate", "kind")
    known = rows.where("predicate is not null").join(kinds, "predicate", "left")
    is_object, is_fact = F.col("kind") == "object", F.col("predicate") != IS_A
    never = (
        F.col("kind").isNull() | F.col("subject_is_class") | F.col("object_is_class") | ~is_snake_case("subject")
        | (is_object & ~is_snake_case("object"))
    )
    defines = ~is_fact & F.col("object_is_class") & ~F.col("subject_is_class")
    found = known.groupBy("subject", "batch_id").agg(
        F.min(F.when(defines, F.struct("seq", "object"))).alias("d"),
        F.collect_set(F.when(is_fact & F.col("kind").isNotNull(), F.col("predicate"))).alias("asks"),
        F.bool_or(is_fact & F.coalesce(never, F.lit(False))).alias("never"),
    )
    return scratch.save(found.select(
        "subject", "batch_id", F.col("d.seq").alias("own_seq"), F.col("d.object").alias("own_class"), "asks", "never"
    ), "own_types")


def _definers(own: DataFrame) -> DataFrame:
    """(subject, batch_id, own_seq, own_class): types that a batch gives to later ones."""
    return own.where("own_class is not null and subject is not null and batch_id is not null").select(
        "subject", "batch_id", "own_seq", "own_class"
    )


def _with_own(facts: DataFrame, own: DataFrame, end: str, policy: SkewPolicy, hot: DataFrame | object | None) -> DataFrame:
    """The class that the row's own batch gives the entity; hot entities are split."""
    mine = own.where("own_class is not null").select(
        F.col("subject").alias(end), "batch_id", F.col("own_class").alias(f"{end}_own")
    )
    return packed_join(facts, mine, [end, "batch_id"], policy=policy, hot=NO_HOT_KEYS if hot is NO_HOT_KEYS else None)


def _isa_with_own(isa: DataFrame, own: DataFrame, policy: SkewPolicy, hot: DataFrame | object | None) -> DataFrame:
    """isA rows with the type that their batch gives; an entity's rows in one batch may be any share of all."""
    mine = own.where("own_class is not null and subject is not null").select("subject", "batch_id", "own_seq", "own_class")
    return packed_join(isa, mine, ["subject", "batch_id"], policy=policy, hot=NO_HOT_KEYS if hot is NO_HOT_KEYS else None)


def _isa_verdict(rows: DataFrame, rules: Rules) -> DataFrame:
    """Add ``error_code`` to isA rows with ``def_batch``, ``earlier_class`` and the type of their own batch."""
    typed = _join_supers(rows.withColumn("object_class", F.col("object")), rules, "object_class", "object_type_supers")
    earlier = F.coalesce(F.col("def_batch") < F.col("batch_id"), F.lit(False))
    return typed.withColumn("is_earlier", earlier).withColumn(
        "is_definer", ~F.col("is_earlier") & F.coalesce(F.col("seq") == F.col("own_seq"), F.lit(False))
    ).withColumn(
        "is_repeat", F.col("is_earlier") & (F.col("object") == F.col("earlier_class"))
    ).withColumn(
        "def_class",
        F.when(F.col("is_earlier"), F.col("earlier_class")).when(
            F.col("seq") >= F.col("own_seq"), F.col("own_class")
        ),
    ).withColumn("error_code", _isa_code())


def _misfits(uses: DataFrame, rules: Rules) -> DataFrame:
    """Add ``bad``: does ``type_class`` not do for the entity's place (``end``) under the predicate?"""
    ends = rules.properties.groupBy("predicate").agg(
        F.max(F.col("kind") == "object").alias("is_object"), F.collect_list(F.struct("domain", "range")).alias("sides")
    )
    met = _join_supers(uses.join(ends, "predicate", "left"), rules, "type_class", "type_supers")
    fits = lambda x: F.coalesce(F.arrays_overlap("type_supers", F.when(
        F.col("end") == "subject", x["domain"]).otherwise(x["range"])), F.lit(False))
    return met.withColumn("bad", F.col("type_class").isNull() | (F.col("is_object") & ~F.forall("sides", fits)))


NEED = ["batch_id", "needed", "bad", "entity", "end", "predicate", "own_class", "object", "seq", "own_seq",
        "subject_is_class", "object_is_class"]


def _batch_needs(
    rows: DataFrame, own: DataFrame, rules: Rules, scratch: Scratch, prior: DataFrame | None, hot: dict, policy: SkewPolicy
) -> tuple[DataFrame, DataFrame]:
    """(needs, many): what each batch asks of the types of entities, each thing once.

    A type that a single batch gives is known for all later ones if that batch is accepted: the
    use of such an entity comes down to ``bad``, if its class does not do, or to the batch
    ``needed``. Uses of entities that several batches define stay as they are, with ``end``
    subject, object or isA; ``many`` holds their definers. Every judged batch has a row.
    """
    found = _definers(own).groupBy("subject").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("batch_id", "own_seq", "own_class")).alias("d")
    ).select("subject", "n", F.col("d.batch_id").alias("def_batch"), F.col("d.own_seq").alias("def_seq"),
             F.col("d.own_class").alias("earlier_class"))
    if prior is not None:
        given = F.col("prior_class").isNotNull()
        found = found.join(_prior_types(prior), "subject", "full_outer").where("subject is not null").select(
            "subject", F.when(given, F.lit(1)).otherwise(F.col("n")).alias("n"),
            F.when(given, F.lit(BEFORE_ALL)).otherwise(F.col("def_batch")).alias("def_batch"), "def_seq",
            F.coalesce("prior_class", "earlier_class").alias("earlier_class"),
        )
    sources = scratch.save(found, "sources")
    several = sources.where("n > 1")
    many = scratch.save(_definers(own).join(several.select("subject"), "subject", "left_semi"), "many")

    # Without an entity or a batch only the own batch tells a type, and such keys are equal to each other.
    def loose(entity: str) -> Column:
        return F.col(entity).isNull() | F.col("batch_id").isNull()

    def padded(df: DataFrame) -> DataFrame:
        kinds = {"batch_id": "bigint", "needed": "bigint", "bad": "boolean", "seq": "bigint", "own_seq": "bigint",
                 "subject_is_class": "boolean", "object_is_class": "boolean"}
        return df.select(*[
            F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in NEED
        ])

    needed = F.when(
        ~F.col("bad") & (F.col("def_batch") < F.col("batch_id")) & (F.col("def_batch") > BEFORE_ALL), F.col("def_batch")
    )

    def facts(uses: DataFrame, end: str) -> DataFrame:
        """Of rows (<end>, batch_id, predicate, or asks with several)."""
        met = lookup_join(uses.where(~loose(end)), sources.drop("def_seq").withColumnRenamed("subject", end), end,
                          hot=hot[end], policy=policy)
        if end == "subject":
            met = met.withColumn("predicate", F.explode("asks")).drop("asks")
        met = met.withColumn("end", F.lit(end)).withColumnRenamed(end, "entity")
        single = F.coalesce(F.col("n"), F.lit(1)) == 1
        kind = met.withColumn("open", ~single).withColumn(
            "type_class", F.when(single & (F.col("def_batch") <= F.col("batch_id")), F.col("earlier_class"))
        )
        judged = _misfits(kind, rules)
        # One pass over the joined rows for both sorts.
        keep = lambda c: F.when(F.col("open"), F.col(c)).alias(c)
        cut = judged.withColumn("needed", F.when(~F.col("open"), needed)).withColumn("bad", ~F.col("open") & F.col("bad"))
        return padded(cut.where("open or bad or needed is not null").select(
            "batch_id", "needed", "bad", keep("entity"), keep("end"), keep("predicate"),
        ))

    def odd_facts(uses: DataFrame, end: str) -> DataFrame:
        """Rows without entity or batch."""
        met = _with_own(uses.where(loose(end)), own, end, policy, hot[end])
        if end == "subject":
            met = met.withColumn("predicate", F.explode("asks")).drop("asks")
        judged = _misfits(met.withColumn("end", F.lit(end)).withColumnRenamed(f"{end}_own", "type_class"), rules)
        return padded(judged.where("bad").select("batch_id", "bad"))

    objects = rules.properties.where("kind = 'object'").select("predicate").distinct()
    links = rows.where(F.col("predicate") != IS_A).join(objects, "predicate").select("object", "batch_id", "predicate")
    subjects = own.where(F.size("asks") > 0).select("subject", "batch_id", "asks")

    isa_columns = ["subject", "batch_id", "seq", "object", "subject_is_class", "object_is_class"]
    isa = rows.where(F.col("predicate") == IS_A).select(*isa_columns)
    met = lookup_join(isa.where(~loose("subject")), sources, "subject", hot=hot["subject"], policy=policy)
    mine = F.col("def_batch") == F.col("batch_id")
    single = _isa_verdict(
        met.withColumn("open", F.coalesce(F.col("n") > 1, F.lit(False)))
        .withColumn("own_seq", F.when(mine, F.col("def_seq"))).withColumn("own_class", F.when(mine, F.col("earlier_class"))),
        rules,
    ).withColumn("bad", ~F.col("open") & F.col("error_code").isNotNull()).withColumn("needed", F.when(~F.col("open"), needed))
    keep = lambda c, to=None: F.when(F.col("open"), F.col(c)).alias(to or c)
    isa_needs = padded(single.where("open or bad or needed is not null").select(
        "batch_id", "needed", "bad", keep("subject", "entity"), F.when(F.col("open"), F.lit(IS_A)).alias("end"),
        keep("object"), keep("seq"), keep("subject_is_class"), keep("object_is_class"),
    ))
    none = F.lit(None)
    odd_isa = _isa_verdict(_isa_with_own(isa.where(loose("subject")), own, policy, hot["subject"]).withColumn(
        "def_batch", none.cast("bigint")).withColumn("earlier_class", none.cast("string")), rules)
    odd_isa = padded(odd_isa.where("error_code is not null").select("batch_id", F.lit(True).alias("bad")))
    every = padded(own.select("batch_id", F.col("never").alias("bad")))
    needs = every
    for part in (facts(subjects, "subject"), facts(links, "object"), isa_needs,
                 odd_facts(subjects, "subject"), odd_facts(links, "object"), odd_isa):
        needs = needs.unionByName(part)
    return scratch.save(needs.distinct(), "needs"), many


def _settle(needs: DataFrame, many: DataFrame, rules: Rules, scratch: Scratch, policy: SkewPolicy) -> DataFrame:
    """(batch_id, accepted) of all judged batches, from what each asks of the earlier ones."""
    fixed = scratch.save(needs.groupBy("batch_id").agg(F.bool_or("bad").alias("never")), "fixed")
    hot = hot_ends(needs, ["needed"], scratch, policy)["needed"]
    edges = needs.where("needed is not null").select("batch_id", "needed")
    opened, isa = None, None
    if not many.isEmpty():
        # What is asked of entities with several definers, with the type that the own batch gives.
        asked = scratch.pin(needs.where("end is not null"), "asked")
        hot_many = hot_ends(many, ["batch_id"], scratch, policy)["batch_id"]
        hot_asked = hot_ends(asked, ["entity"], scratch, policy)["entity"]
        opened = asked.where(F.col("end") != IS_A).select("entity", "batch_id", "end", "predicate")
        opened = scratch.save(_with_own(opened, many, "entity", policy, hot_asked), "opened")
        isa = asked.where(F.col("end") == IS_A).select(
            F.col("entity").alias("subject"), "batch_id", "seq", "object", "subject_is_class", "object_is_class"
        )
        isa = scratch.save(_isa_with_own(isa, many, policy, hot_asked), "isa")

    def failing(state: DataFrame) -> DataFrame:
        """Batches that do not pass if those of ``state`` are accepted; others than in ``fixed``."""
        gone = state.where("not accepted").select(F.col("batch_id").alias("needed"))
        out = lookup_join(edges, gone, "needed", "left_semi", policy, hot=hot).select("batch_id")
        if opened is None:
            return out.distinct()
        first = lookup_join(many, state.where("accepted").select("batch_id"), "batch_id", "inner", policy, hot=hot_many)
        types = scratch.save(first.groupBy("subject").agg(F.min(F.struct("batch_id", "own_class")).alias("d")).select(
            "subject", F.col("d.batch_id").alias("def_batch"), F.col("d.own_class").alias("earlier_class")
        ), "types")
        spent.append(types)
        met = lookup_join(opened, types.withColumnRenamed("subject", "entity"), "entity", "left", policy, hot=hot_asked)
        typed = met.withColumn("type_class", F.when(
            F.col("def_batch") < F.col("batch_id"), F.col("earlier_class")).otherwise(F.col("entity_own")))
        out = out.unionByName(_misfits(typed, rules).where("bad").select("batch_id"))
        judged = _isa_verdict(lookup_join(isa, types, "subject", "left", policy, hot=hot_asked), rules)
        return out.unionByName(judged.where("error_code is not null").select("batch_id")).distinct()

    state, spent = scratch.save(fixed.select("batch_id", (~F.col("never")).alias("accepted")), "accepted"), []
    while True:
        found = failing(state).withColumn("fails", F.lit(True))
        after = scratch.save(fixed.join(found, "batch_id", "left").select(
            "batch_id", (~F.col("never") & F.col("fails").isNull()).alias("accepted")
        ), "accepted")
        # As no batch waits for a later one, equal states are the only end.
        scratch.drop(*spent)
        spent.clear()
        changed = after.join(state.withColumnRenamed("accepted", "before"), "batch_id").where("accepted != before")
        if changed.isEmpty():
            return after
        scratch.drop(state)
        state = after


def _types_before(
    own: DataFrame, batches: DataFrame, prior: DataFrame | None, policy: SkewPolicy, hot: dict
) -> DataFrame:
    """(subject, def_batch, earlier_class): first type by an accepted batch, or known beforehand."""
    unsplit = NO_HOT_KEYS if hot["subject"] is NO_HOT_KEYS else None
    mine = lookup_join(_definers(own), batches.where("accepted").select("batch_id"), "batch_id", "inner", policy, hot=unsplit)
    first = mine.groupBy("subject").agg(
        F.min(F.struct("batch_id", "own_class")).alias("d")
    ).select("subject", F.col("d.batch_id").alias("from_batch"), F.col("d.own_class").alias("from_class"))
    if prior is None:
        return first.toDF("subject", "def_batch", "earlier_class")
    return first.join(_prior_types(prior), "subject", "full_outer").select(
        "subject",
        F.when(F.col("prior_class").isNotNull(), F.lit(BEFORE_ALL)).otherwise(F.col("from_batch")).alias("def_batch"),
        F.coalesce("prior_class", "from_class").alias("earlier_class"),
    )


def _judge_batches(
    rows: DataFrame, own: DataFrame, types: DataFrame, rules: Rules, columns: list[str], policy: SkewPolicy, hot: dict
) -> DataFrame:
    """Every row's verdict, given the types by accepted batches."""
    isa = _isa_with_own(rows.where(F.col("predicate") == IS_A), own, policy, hot["subject"])
    judged_isa = _isa_verdict(lookup_join(isa, types, "subject", hot=hot["subject"]), rules).select(*columns, "error_code")

    def with_type(facts: DataFrame, end: str) -> DataFrame:
        facts = _with_own(facts, own, end, policy, hot[end])
        facts = lookup_join(facts, types.withColumnRenamed("subject", end), end, hot=hot[end])
        return facts.withColumn(
            f"{end}_type",
            F.when(F.col("def_batch") < F.col("batch_id"), F.col("earlier_class"))
            .otherwise(F.col(f"{end}_own")),
        ).drop("def_batch", "earlier_class", f"{end}_own")

    links, others = _by_kind(with_type(_facts(rows, rules), "subject"))
    return judged_isa.unionByName(_judged_facts(with_type(links, "object"), others, rules, columns))


def accepted_batch_triples(judged: DataFrame, batches: DataFrame) -> DataFrame:
    """Set of triples of the accepted batches."""
    good = batches.where("accepted").select("batch_id")
    return accumulate(lookup_join(judged.drop("error_code"), good, "batch_id", "left_semi"))


# ------------------------------------------------------------------- epochs

PROGRESS = "batch_id long, candidates long, new_triples long, total long"


def run_epochs(
    extract: Callable[[DataFrame, int], DataFrame],
    empty: DataFrame,
    onto: Ontology | Rules | None,
    scratch: Scratch,
    epochs: int = 3,
    policy: SkewPolicy = DEFAULT_SKEW,
    mode: str = "row",
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Up to ``epochs`` passes, each seeing the graph so far; stop when none is new.

    ``extract(kg, epoch)`` returns candidate triples. ``mode`` tells whether single
    rows or whole batches are rejected. Returns (kg, progress): the graph has the
    epoch of each triple, so that a type stays the one of its first epoch; progress
    rows are (epoch, batch_id, candidates, new_triples, total), with the size of the
    graph after the batch.

    With a ``path`` each pass is published there as soon as it is judged: its triples as the
    folder ``epoch=k``, then its progress, whose success marker commits the pass. A run
    that is started again on the path goes on behind the last committed pass; one that
    was only written in part is done anew. A path belongs to one set of inputs.
    """
    spark = empty.sparkSession
    kg = scratch.save(empty.select(*SPO, "batch_id", "seq").withColumn("epoch", F.lit(-1)), "kg")
    size = kg.count()
    begun_empty = size == 0
    rules = onto if onto is None or isinstance(onto, Rules) else prepare_rules(onto, scratch)
    progress = []
    for epoch in range(epochs):
        if path is None or not path_exists(spark, f"{path}/_progress/epoch={epoch}/_SUCCESS"):
            # Tables that only this pass reads go with it.
            with Scratch(spark) as work:
                # An extractor may call a model, so its rows are written before any use.
                candidates = work.pin(extract(kg, epoch), "candidates")
                # A pass adds only triples that are new, each once, so the graph is a set.
                judged, good = judge(
                    candidates, rules, work, kg if size else None, mode, policy, prior_is_set=begun_empty
                )
                found = scratch.save(accumulate_first(good), "found")
                log = (
                    judged.groupBy("batch_id").agg(F.count(F.lit(1)).alias("candidates"))
                    .join(found.groupBy("batch_id").agg(F.count(F.lit(1)).alias("new_triples")), "batch_id", "left")
                    .select(F.lit(epoch).alias("epoch"), "batch_id", "candidates",
                            F.coalesce("new_triples", F.lit(0)).alias("new_triples"))
                )
                log = scratch.save(running_total(work.save(log, "log"), size, work), "progress")
            if path is not None:
                found.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
                log.drop("epoch").write.mode("overwrite").parquet(f"{path}/_progress/epoch={epoch}")
        if path is not None:
            found = spark.read.schema(schemas.TRIPLES).parquet(f"{path}/epoch={epoch}")
            log = spark.read.schema(PROGRESS).parquet(f"{path}/_progress/epoch={epoch}")
            log = log.select(F.lit(epoch).alias("epoch"), *log.columns)
        progress.append(log)
        n_new = found.count()
        if n_new == 0:
            break
        size += n_new
        # The triples of a pass are disjoint from the graph: append, no shuffle.
        kg = kg.unionByName(found.withColumn("epoch", F.lit(epoch)).select(kg.columns))
    table = progress[0]
    for part in progress[1:]:
        table = table.unionByName(part)
    return kg, table


def judge(
    triples: DataFrame, rules: Rules | None, scratch: Scratch, prior: DataFrame | None, mode: str,
    policy: SkewPolicy = DEFAULT_SKEW, prior_is_set: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(judged rows, accepted rows) by ``mode``: "row" or "batch".

    In batch mode a row's verdict is that of its batch: the rows judged are told as they are,
    without an ``error_code`` of each (``accept_batches`` has those). Rows without a predicate
    have no verdict under an ontology. What judging needs for itself is dropped at its end.
    """
    if mode == "row":
        with Scratch(scratch.spark) as work:
            judged = validate(triples, rules, work, prior=prior, policy=policy, prior_is_set=prior_is_set)
            judged = scratch.save(judged, "judged")
        return judged, accepted(judged)
    if mode != "batch":
        raise ValueError(f"no such mode: {mode}")
    if prior is not None:
        triples = scratch.save(new_triples(triples, prior, policy, prior_is_set), "new")
    if rules is None:
        judged, batches = triples, _all_accepted(triples)
    else:
        with Scratch(scratch.spark) as work:
            batches = scratch.save(_verdicts(triples, rules, work, prior, policy)[-1], "batches")
        judged = triples.where("predicate is not null")
    good = batches.where("accepted").select("batch_id")
    return judged, lookup_join(judged, good, "batch_id", "left_semi", policy)


def running_total(log: DataFrame, before: int, scratch: Scratch) -> DataFrame:
    """Add ``total``: the graph's size after each batch, in the order of batch ids.

    Sums within ranges of ids, then over the ranges, whose sums (one per
    partition) come to the driver.
    """
    within = Window.partitionBy("_part").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    parts = log.repartitionByRange("batch_id").withColumn("_part", F.spark_partition_id())
    parts = scratch.save(parts, "log")
    total, offsets = before, []
    for row in parts.groupBy("_part").agg(F.sum("new_triples").alias("n")).orderBy("_part").collect():
        offsets.append((row["_part"], total))
        total += row["n"]
    # One row per partition of the log.
    table = F.broadcast(local_table(log.sparkSession, offsets, "_part int, _before long"))
    return parts.withColumn("_sum", F.sum("new_triples").over(within)).join(table, "_part").select(
        *log.columns, (F.col("_before") + F.col("_sum")).alias("total")
    )


def epoch_totals(progress: DataFrame) -> DataFrame:
    return progress.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("candidates").alias("candidates"),
        F.sum("new_triples").alias("new_triples"),
        F.max("total").alias("total"),
    )


# -------------------------------------------------------------------- parse

def parse_triples(responses: DataFrame, response: str = "response", batch: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Model replies, JSON lists of triples, as (triples, unreadable replies).

    A JSON ``null`` means "nothing found" and gives no rows; a reply that is not
    a list of complete triples is set apart.
    """
    parsed = responses.withColumn("items", F.from_json(response, schemas.TRIPLE_LIST))
    null_reply = F.trim(response) == "null"
    complete = F.forall(
        "items",
        lambda t: t.isNotNull() & t["subject"].isNotNull() & t["predicate"].isNotNull() & t["object"].isNotNull(),
    )
    readable = F.coalesce(null_reply, F.lit(False)) | F.coalesce(complete, F.lit(False))
    triples = (
        parsed.where(readable)
        .select(F.col(batch).cast("long").alias("batch_id"), F.posexplode("items").alias("seq", "t"))
        .select("t.subject", "t.predicate", "t.object", "batch_id", F.col("seq").cast("long").alias("seq"))
    )
    return triples, parsed.where(~readable).drop("items")
