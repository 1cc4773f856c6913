"""Ontology tables: lookups, integrity rules over a delta, incremental build."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kgspark import schemas
from kgspark.functions.scalars import starts_uppercase
from kgspark.skew import DEFAULT_SKEW, NO_HOT_KEYS, SkewPolicy, hot_ends, hot_keys, lookup_join, too_small
from kgspark.storage import Scratch, local_table


@dataclass(frozen=True)
class Ontology:
    """Four tables; every table carries ``seq``, its order of definition."""

    name: str
    classes: DataFrame
    subclass_of: DataFrame
    object_properties: DataFrame
    data_properties: DataFrame

    def pinned(self, scratch: Scratch) -> "Ontology":
        """Write the tables, so that Spark knows their sizes when it plans joins."""
        return Ontology(
            self.name,
            scratch.save(self.classes, "classes"),
            scratch.save(self.subclass_of, "subclass_of"),
            scratch.save(self.object_properties, "object_properties"),
            scratch.save(self.data_properties, "data_properties"),
        )


def empty_ontology(spark: SparkSession, name: str = "ontology") -> Ontology:
    return Ontology(
        name,
        local_table(spark, [], schemas.CLASSES),
        local_table(spark, [], schemas.SUBCLASS_OF),
        local_table(spark, [], schemas.OBJECT_PROPERTIES),
        local_table(spark, [], schemas.DATA_PROPERTIES),
    )


# ---------------------------------------------------------------- lookups

def class_names(onto: Ontology) -> DataFrame:
    """(name_key, class_name): names by lower case, the first definition of each."""
    return onto.classes.groupBy(F.lower("name").alias("name_key")).agg(
        F.min_by("name", "seq").alias("class_name")
    )


def get_class(onto: Ontology, name: Column) -> DataFrame:
    """First class with this name in any case."""
    return onto.classes.where(F.lower("name") == F.lower(name)).orderBy("seq").limit(1)


def first_superclasses(onto: Ontology) -> DataFrame:
    """(subclass, superclass): the first superclass stated for each class."""
    return onto.subclass_of.groupBy("subclass").agg(
        F.min_by("superclass", "seq").alias("superclass")
    )


def subclasses(onto: Ontology, superclass: str) -> DataFrame:
    return onto.subclass_of.where(F.col("superclass") == superclass).select("subclass", "seq")


def all_properties(onto: Ontology) -> DataFrame:
    """Both property tables; object properties win over data properties of one name."""
    both = onto.object_properties.select(
        "name", F.lit("object").alias("kind"), "domain", "range",
        F.struct(F.lit(0).alias("table"), "seq").alias("rank"),
    ).unionByName(
        onto.data_properties.select(
            "name", F.lit("data").alias("kind"), "domain", F.array("range").alias("range"),
            F.struct(F.lit(1).alias("table"), "seq").alias("rank"),
        )
    )
    return both.groupBy("name").agg(
        F.min_by(F.struct("kind", "domain", "range"), "rank").alias("p")
    ).select("name", "p.kind", "p.domain", "p.range")


def root_class(onto: Ontology) -> DataFrame:
    """First class that is never a superclass (as the reference rule computes it)."""
    used = onto.subclass_of.select(F.col("superclass").alias("name"))
    return onto.classes.join(used, "name", "left_anti").orderBy("seq").limit(1)


def top_classes(onto: Ontology) -> DataFrame:
    """Classes that have no superclass (what the rule is meant to find)."""
    used = onto.subclass_of.select(F.col("subclass").alias("name"))
    return onto.classes.join(used, "name", "left_anti")


def superclass_pairs(onto: Ontology) -> DataFrame:
    """(class_name, super): each class with itself and its direct superclasses."""
    edges = onto.subclass_of
    return (
        onto.classes.select(F.col("name").alias("class_name"), F.col("name").alias("super"))
        .union(edges.select("subclass", "subclass"))
        .union(edges.select("subclass", "superclass"))
        .distinct()
    )


def transitive_superclass_pairs(
    onto: Ontology, scratch: Scratch
) -> DataFrame:
    """As above over any number of steps; paths double in length each round."""
    closure = scratch.save(superclass_pairs(onto), "closure")
    size = closure.count()
    while True:
        left = closure.select("class_name", F.col("super").alias("mid"))
        right = closure.select(F.col("class_name").alias("mid"), "super")
        grown = scratch.save(
            left.join(right, "mid").select("class_name", "super").distinct(), "closure"
        )
        grown_size = grown.count()
        scratch.drop(closure)
        closure = grown
        if grown_size == size:
            return closure
        size = grown_size


def superclass_sets(onto: Ontology, closure: str = "direct", scratch: Scratch | None = None) -> DataFrame:
    """(class_name, supers): the pairs as one array per class."""
    if closure == "direct":
        pairs = superclass_pairs(onto)
    else:
        pairs = transitive_superclass_pairs(onto, scratch)
    return pairs.groupBy("class_name").agg(F.collect_set("super").alias("supers"))


# ------------------------------------------------------------ delta rules

def split_concepts(concepts: DataFrame) -> Ontology:
    """A delta of tagged rows as four tables."""
    def rows(kind: str, field: str) -> DataFrame:
        return concepts.where(F.col("kind") == kind).select(f"{field}.*", "seq")

    return Ontology(
        "delta",
        rows("class", "class"),
        rows("subclass_relation", "subclass_relation"),
        rows("object_property", "object_property"),
        rows("data_property", "data_property"),
    )


def extend(onto: Ontology, delta: Ontology) -> Ontology:
    """Append without checks; delta rows are ordered after the existing ones.

    ``seq`` of the delta is moved behind the greatest of the ontology, one number
    read from its four tables.
    """
    tables = ("classes", "subclass_of", "object_properties", "data_properties")
    ends = [getattr(onto, name).select("seq") for name in tables]
    last = ends[0].unionAll(ends[1]).unionAll(ends[2]).unionAll(ends[3]).agg(F.max("seq")).first()[0]
    starts = [getattr(delta, name).select("seq") for name in tables]
    first = starts[0].unionAll(starts[1]).unionAll(starts[2]).unionAll(starts[3]).agg(F.min("seq")).first()[0]
    move = 0 if last is None or first is None or first > last else last + 1 - first
    return replace(onto, **{
        name: getattr(onto, name).unionByName(
            getattr(delta, name).withColumn("seq", (F.col("seq") + F.lit(move)).cast("long"))
        ) for name in tables
    })


def _issues(rows: DataFrame, code: Column | str, path: Column, message: Column,
            context: Column | None = None, hint: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select(
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        path.alias("path"),
        message.alias("message"),
        (null if context is None else context).alias("context"),
        (null if hint is None else hint).alias("hint"),
        "seq",
    )


def _quoted(c: str | Column) -> Column:
    return F.concat(F.lit("'"), F.col(c) if isinstance(c, str) else c, F.lit("'"))


def judge_classes(
    onto: Ontology, classes: DataFrame, policy: SkewPolicy = DEFAULT_SKEW, rows: int | None = None
) -> DataFrame:
    """Delta classes with ``code`` (null: accepted) and the class they repeat.

    Per name (any case) the first delta row with a capital is accepted, unless
    the ontology has the name; rows after it repeat it, rows before it only fail
    the naming rule. One aggregate per name replaces the ordered scan.
    """
    named = classes.withColumn("name_key", F.lower("name")).withColumn(
        "named_well", starts_uppercase("name")
    )
    accepted = named.groupBy("name_key").agg(
        F.min(F.when(F.col("named_well"), F.struct("seq", "name"))).alias("first"),
        F.count(F.lit(1)).alias("n"),
    )
    known = class_names(onto).withColumnRenamed("class_name", "known")
    firsts = accepted.join(known, "name_key", "left")
    judged = lookup_join(named, firsts, "name_key", policy=policy, weight="n", rows=rows)
    first_seq = F.col("first.seq")
    return judged.withColumn(
        "existing",
        F.when(F.col("known").isNotNull(), F.col("known")).when(
            first_seq < F.col("seq"), F.col("first.name")
        ),
    ).withColumn(
        "code",
        F.when(F.col("existing").isNotNull(), F.lit("class_already_exists")).when(
            ~F.col("named_well"), F.lit("class_name_not_uppercase")
        ),
    ).drop("known", "first", "name_key", "named_well")


def check_classes(
    onto: Ontology, classes: DataFrame, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    return class_issues(judge_classes(onto, classes, policy))


def class_issues(judged: DataFrame) -> DataFrame:
    judged = judged.where("code is not null")
    exists = F.col("code") == "class_already_exists"
    return _issues(
        judged,
        F.col("code"),
        F.when(exists, F.concat(F.lit("class:"), "name")).otherwise(F.col("name")),
        F.when(
            exists, F.concat(F.lit("The name "), _quoted("name"), F.lit(" is taken by a class"))
        ).otherwise(
            F.concat(F.lit("The name "), _quoted("name"), F.lit(" lacks a capital first letter"))
        ),
        F.when(exists, F.concat(F.lit("Taken by "), _quoted("existing"))),
        F.when(exists, F.lit("Use another name or leave out the repeated definition."))
        .otherwise(F.lit("Start the class name with an uppercase letter.")),
    )


def accepted_classes(
    onto: Ontology, classes: DataFrame, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    return judge_classes(onto, classes, policy).where("code is null").drop("code", "existing")


RELATION_CODES = [
    "subclass_not_found",
    "superclass_not_found",
    "subclass_equals_superclass",
    "circular_subclass_relation",
]


def judge_relations(
    onto: Ontology, known: DataFrame, relations: DataFrame, supers: DataFrame,
    policy: SkewPolicy = DEFAULT_SKEW, n_rows: int | None = None,
) -> DataFrame:
    """Delta relations with ``code`` (null: accepted) and ``earlier``.

    ``known`` holds (name_key, class_name) after the delta's classes; ``supers``
    the superclass sets before the delta. ``earlier`` is the superclass that the
    subclass already has; it is reported but does not stop the row.
    """
    names = known.select("name_key", F.lit(True).alias("found"))

    def look_up(rows: DataFrame, column: Column, table: DataFrame, key: str) -> DataFrame:
        """Join on ``column`` as ``key``; a class that many relations name is split."""
        small = too_small(relations, policy) or (n_rows is not None and n_rows < policy.min_rows)
        hot = NO_HOT_KEYS if small else hot_keys(relations.select(column.alias(key)), key, policy)
        return lookup_join(rows.withColumn(key, column), table, key, hot=hot)

    rows = look_up(relations, F.lower("subclass"), names, "name_key").withColumnRenamed("found", "has_sub")
    rows = look_up(rows, F.lower("superclass"), names, "name_key").withColumnRenamed("found", "has_super")
    rows = rows.drop("name_key")
    rows = look_up(rows, F.col("subclass"), supers.select(
        F.col("class_name").alias("subclass"), F.col("supers").alias("sub_supers")
    ), "subclass")
    rows = look_up(rows, F.col("superclass"), supers.select(
        F.col("class_name").alias("superclass"), F.col("supers").alias("super_supers")
    ), "superclass")
    circular = F.coalesce(F.arrays_overlap("sub_supers", "super_supers"), F.lit(False))
    rows = rows.withColumn(
        "code",
        F.when(F.col("has_sub").isNull(), F.lit("subclass_not_found"))
        .when(F.col("has_super").isNull(), F.lit("superclass_not_found"))
        .when(F.col("subclass") == F.col("superclass"), F.lit("subclass_equals_superclass"))
        .when(circular, F.lit("circular_subclass_relation")),
    ).drop("has_sub", "has_super", "sub_supers", "super_supers")
    # The first superclass of a class: from the ontology, else its first accepted row.
    firsts = rows.groupBy("subclass").agg(
        F.min(F.when(F.col("code").isNull(), F.struct("seq", "superclass"))).alias("first"),
        F.count(F.lit(1)).alias("n"),
    ).join(
        first_superclasses(onto).withColumnRenamed("superclass", "given"), "subclass", "left"
    )
    rows = lookup_join(rows, firsts, "subclass", policy=policy, weight="n", rows=n_rows)
    reached = F.col("code").isNull() | ~F.col("code").isin("subclass_not_found", "superclass_not_found")
    return rows.withColumn(
        "earlier",
        F.when(
            reached,
            F.when(F.col("given").isNotNull(), F.col("given")).when(
                F.col("first.seq") < F.col("seq"), F.col("first.superclass")
            ),
        ),
    ).drop("given", "first")


def check_subclass_relations(
    onto: Ontology, known: DataFrame, relations: DataFrame, supers: DataFrame,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    return relation_issues(judge_relations(onto, known, relations, supers, policy))


def relation_issues(judged: DataFrame) -> DataFrame:
    """Issues of the relation rules; a row can have two (repeated and one more)."""
    codes = F.array_compact(F.array(
        F.when(F.col("earlier").isNotNull(), F.lit("subclass_already_has_superclass")), F.col("code")
    ))
    rows = judged.withColumn("issue", F.explode(codes))
    path = F.concat(F.lit("relation:"), "subclass", F.lit("->"), "superclass")
    is_code = lambda code: F.col("issue") == code
    message = (
        F.when(is_code("subclass_not_found"),
               F.concat(F.lit("The lower class "), _quoted("subclass"), F.lit(" is not defined")))
        .when(is_code("superclass_not_found"),
              F.concat(F.lit("The upper class "), _quoted("superclass"), F.lit(" is not defined")))
        .when(is_code("subclass_already_has_superclass"),
              F.concat(_quoted("subclass"), F.lit(" is placed below "), _quoted("earlier"), F.lit(" before")))
        .when(is_code("subclass_equals_superclass"),
              F.concat(_quoted("subclass"), F.lit(" is placed below itself")))
        .otherwise(F.lit("The relation closes a circle"))
    )
    context = F.when(
        is_code("circular_subclass_relation"),
        F.concat(_quoted("superclass"), F.lit(" and "), _quoted("subclass"), F.lit(" share a class above them")),
    )
    hint = (
        F.when(F.col("issue").endswith("_not_found"), F.lit("Define the class before relating it."))
        .when(is_code("subclass_already_has_superclass"), F.lit("Keep one superclass per class."))
        .when(is_code("subclass_equals_superclass"), F.lit("Remove the relation or correct the names."))
        .otherwise(F.lit("Remove the relation or turn it around."))
    )
    return _issues(rows, F.col("issue"), path, message, context, hint)


def classes_without_superclass(classes: DataFrame, after: Ontology) -> DataFrame:
    related = after.subclass_of.select(F.col("subclass").alias("name"))
    return classes.join(related, "name", "left_anti")


def check_roots(classes: DataFrame, after: Ontology) -> DataFrame:
    """New classes without a superclass, judged against the root of ``after``.

    If several are left without a root, each of them is an issue; the context
    tells how many there are.
    """
    no_super = classes_without_superclass(classes, after)
    root = root_class(after).select("name")
    # A root that belongs to the delta itself does not count as a root.
    root = root.join(classes.select("name"), "name", "left_anti")
    has_root = root.agg(F.count(F.lit(1)) > 0).scalar()
    n_without = no_super.agg(F.count(F.lit(1))).scalar()
    orphan = _issues(
        no_super.where(has_root),
        "superclass_not_found",
        F.concat(F.lit("class:"), "name"),
        F.concat(_quoted("name"), F.lit(" is not placed below any class")),
        None,
        F.concat(F.lit("Place "), _quoted("name"), F.lit(" in the hierarchy by a subclass relation")),
    )
    multiple = _issues(
        no_super.where(~has_root & (n_without > 1)),
        "multiple_classes_without_superclass",
        F.concat(F.lit("class:"), "name"),
        F.concat(_quoted("name"), F.lit(" is one of several classes that nothing stands above")),
        F.concat(n_without.cast("string"), F.lit(" such classes")),
        F.lit("Add one general top class and relate all other classes to it."),
    )
    return orphan.unionByName(multiple)


def _missing_names(properties: DataFrame, column: str, known: DataFrame, out: str) -> DataFrame:
    """(kind, seq, out): names in a list column that no class has, quoted, in list order.

    The grouping is by property row, so a group is one list.
    """
    items = properties.select("kind", "seq", F.posexplode(column).alias("pos", "item")).withColumn(
        "name_key", F.lower("item")
    )
    names = known.select("name_key", F.lit(True).alias("found"))
    missing = items.join(names, "name_key", "left").where("found is null")
    return missing.groupBy("kind", "seq").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "item"))),
                lambda x: F.concat(F.lit("'"), x["item"], F.lit("'")),
            ),
            ", ",
        ).alias(out)
    )


def judge_properties(
    onto: Ontology, known: DataFrame, object_properties: DataFrame, data_properties: DataFrame,
    policy: SkewPolicy = DEFAULT_SKEW, n_rows: int | None = None,
) -> DataFrame:
    """(seq, name, kind, code, missing): both delta tables, judged in ``seq`` order."""
    both = object_properties.select("seq", "name", F.lit("object").alias("kind"), "domain", "range").unionByName(
        data_properties.select(
            "seq", "name", F.lit("data").alias("kind"), "domain",
            F.array().cast("array<string>").alias("range"),
        )
    )
    no_domain = _missing_names(both, "domain", known, "missing_domain")
    no_range = _missing_names(both, "range", known, "missing_range")
    row_id = ["kind", "seq"]
    rows = both.select("seq", "name", "kind").join(no_domain, row_id, "left").join(no_range, row_id, "left")
    rows = rows.withColumn(
        "own_code",
        F.when(F.col("missing_domain").isNotNull(), F.lit("domain_classes_not_found")).when(
            F.col("missing_range").isNotNull(), F.lit("range_classes_not_found")
        ),
    )
    given = all_properties(onto).select("name", F.lit(True).alias("given"))
    firsts = rows.groupBy("name").agg(
        F.min(F.when(F.col("own_code").isNull(), F.col("seq"))).alias("first_seq"),
        F.count(F.lit(1)).alias("n"),
    ).join(given, "name", "left")
    rows = lookup_join(rows, firsts, "name", policy=policy, weight="n", rows=n_rows)
    repeated = F.col("given").isNotNull() | F.coalesce(F.col("first_seq") < F.col("seq"), F.lit(False))
    return rows.select(
        "seq", "name", "kind",
        F.when(repeated, F.lit("property_already_exists")).otherwise(F.col("own_code")).alias("code"),
        F.when(repeated, F.lit(None)).otherwise(F.coalesce("missing_domain", "missing_range")).alias("missing"),
    )


def check_properties(
    onto: Ontology, known: DataFrame, object_properties: DataFrame, data_properties: DataFrame,
    policy: SkewPolicy = DEFAULT_SKEW, n_rows: int | None = None,
) -> DataFrame:
    judged = judge_properties(onto, known, object_properties, data_properties, policy, n_rows)
    repeated = F.col("code") == "property_already_exists"
    domain = F.col("code") == "domain_classes_not_found"
    return _issues(
        judged.where("code is not null"),
        F.col("code"),
        F.concat(F.lit("property:"), "name"),
        F.when(repeated, F.concat(F.lit("The name "), _quoted("name"), F.lit(" is taken by a property")))
        .when(domain, F.concat(F.lit("The domain of "), _quoted("name"), F.lit(" has undefined classes")))
        .otherwise(F.concat(F.lit("The range of "), _quoted("name"), F.lit(" has undefined classes"))),
        F.when(repeated, F.concat(F.lit("Taken by "), _quoted("name")))
        .otherwise(F.concat(F.lit("Undefined: "), "missing")),
        F.when(repeated, F.lit("Use another name or leave out the repeated property."))
        .otherwise(F.lit("Define the classes first or leave them out of the list.")),
    )


@dataclass(frozen=True)
class DeltaResult:
    valid: bool
    issues: DataFrame
    ontology: Ontology


def try_add_concepts(
    onto: Ontology, delta: Ontology, scratch: Scratch, closure: str = "direct",
    policy: SkewPolicy = DEFAULT_SKEW, n_rows: int | None = None,
) -> DeltaResult:
    """All or nothing: the extended ontology if there is no issue, else the old one.

    Issues of classes end the check; else the relation, root and property rules
    are applied. Verdicts that later rules read are written in between. ``n_rows``
    is a bound on the rows of the delta, if the caller knows one.
    """
    classes = scratch.save(judge_classes(onto, delta.classes, policy, n_rows), "judged_classes")
    issues = class_issues(classes)
    if not issues.isEmpty():
        return DeltaResult(False, issues, onto)
    grown = replace(onto, classes=onto.classes.unionByName(delta.classes))
    known = scratch.save(class_names(grown), "known")
    supers = scratch.save(superclass_sets(grown, closure, scratch), "supers")
    relations = scratch.save(
        judge_relations(onto, known, delta.subclass_of, supers, policy, n_rows), "judged_relations"
    )
    accepted = relations.where("code is null").select("subclass", "superclass", "seq")
    after = replace(grown, subclass_of=onto.subclass_of.unionByName(accepted))
    issues = scratch.save(
        relation_issues(relations)
        .unionByName(check_roots(delta.classes, after))
        .unionByName(check_properties(onto, known, delta.object_properties, delta.data_properties, policy, n_rows)),
        "issues",
    )
    valid = issues.isEmpty()
    return DeltaResult(valid, issues, extend(onto, delta) if valid else onto)


def build_step_by_step(
    onto: Ontology, concept_batches: DataFrame, scratch: Scratch, closure: str = "direct",
    policy: SkewPolicy = DEFAULT_SKEW,
) -> tuple[Ontology, DataFrame]:
    """Fold batches of concepts in ``batch_id`` order; a batch with issues is skipped.

    One pass per batch, which reads its own rows by a filter; ``incremental`` judges all
    batches at once. Returns the ontology and a log
    (batch_id, valid, n_issues).
    """
    spark = concept_batches.sparkSession
    batches = scratch.save(concept_batches, "concepts")
    n_rows = batches.count()
    base, accepted, log = onto, [], []
    for row in batches.select("batch_id").distinct().orderBy("batch_id").toLocalIterator():
        batch_id = row["batch_id"]
        delta = split_concepts(batches.where(F.col("batch_id") == batch_id))
        result = try_add_concepts(onto, delta, scratch, closure, policy, n_rows)
        log.append((batch_id, result.valid, 0 if result.valid else result.issues.count()))
        if result.valid:
            # The state is a filter on the concept table, so plans do not grow.
            accepted.append((batch_id,))
            taken = local_table(spark, accepted, "batch_id long")
            onto = extend(base, split_concepts(batches.join(taken, "batch_id", "left_semi")))
    return onto, local_table(spark, log, "batch_id long, valid boolean, n_issues long")


def ontology_metrics(onto: Ontology) -> DataFrame:
    """Classes named in relations, and both property counts, in one row."""
    ends = onto.subclass_of.select(F.explode(F.array("subclass", "superclass")).alias("c"))
    return ends.agg(F.countDistinct("c").alias("classes")).select(
        F.col("classes"),
        onto.object_properties.agg(F.count(F.lit(1))).scalar().alias("object_properties"),
        onto.data_properties.agg(F.count(F.lit(1))).scalar().alias("data_properties"),
    )


# -------------------------------------------------------- derived ontologies

def induced_properties(
    triples: DataFrame, types: DataFrame, scratch: Scratch, distinct: bool = True,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Profile of a typed graph: (predicate, domain class, range class, n_triples).

    ``types`` holds one row (subject, class_name) per entity. An untyped object
    gives a null range: the predicate then is a data property. ``distinct``
    counts copies of a triple once.
    """
    facts = triples.where("predicate != 'isA'")
    hot = hot_ends(facts, ["subject"], scratch, policy)
    if distinct:
        facts = facts.select("subject", "predicate", "object").distinct()
    rows = lookup_join(
        facts, types.select("subject", F.col("class_name").alias("domain_class")), "subject",
        how="inner", hot=hot["subject"],
    )
    # Only what is counted goes on: the triples of an object are merged before they are shuffled by it.
    rows = rows.groupBy("object", "predicate", "domain_class").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(types.select(F.col("subject").alias("object"), F.col("class_name").alias("range_class")), "object", "left")
    counts = rows.groupBy("predicate", "domain_class", "range_class").agg(F.sum("n").alias("n_triples"))
    return scratch.save(counts, "profile")  # schema-sized, and read for each kind of property


def ontology_from_profile(name: str, classes: DataFrame, subclass_of: DataFrame, profile: DataFrame) -> Ontology:
    """Ontology whose properties are induced from a profile (see above)."""
    grouped = profile.groupBy("predicate").agg(
        F.sort_array(F.collect_set("domain_class")).alias("domain"),
        F.sort_array(F.collect_set("range_class")).alias("range"),
    )
    null_guide = F.lit(None).cast(schemas.GUIDELINE).alias("usage_guideline")
    no_traits = F.array().cast("array<string>").alias("characteristics")
    # Far from the ends of a long, so that a delta can be ordered behind it.
    seq = F.pmod(F.xxhash64("predicate"), F.lit(1 << 60)).alias("seq")
    described = F.concat(F.lit("induced from use of "), "predicate").alias("description")
    objects = grouped.where("size(range) > 0").select(
        F.col("predicate").alias("name"), described, "domain", "range", no_traits, null_guide, seq
    )
    data = grouped.where("size(range) = 0").select(
        F.col("predicate").alias("name"), described, "domain", F.lit("xsd:string").alias("range"),
        no_traits, null_guide, seq,
    )
    return Ontology(name, classes, subclass_of, objects, data)


# Datatype of each column type.
XSD_OF_TYPE = {
    "string": "xsd:string", "tinyint": "xsd:integer", "smallint": "xsd:integer",
    "int": "xsd:integer", "bigint": "xsd:integer", "float": "xsd:float", "double": "xsd:float",
    "boolean": "xsd:boolean", "date": "xsd:date", "timestamp": "xsd:dateTime",
    "timestamp_ntz": "xsd:dateTime",
}


def xsd_of(dtype: str) -> str:
    """Datatype of a column: decimals by their scale; types without one are text."""
    if dtype.startswith("decimal"):
        return "xsd:integer" if dtype.endswith(",0)") else "xsd:float"
    return XSD_OF_TYPE.get(dtype, "xsd:string")


def class_of_table(table: str) -> str:
    """``line_item`` is the table of class LineItem."""
    return "".join(word.capitalize() for word in table.split("_"))


def ontology_from_tables(
    spark: SparkSession, tables: dict[str, DataFrame], foreign_keys: dict[tuple[str, str], str],
    name: str = "catalog", top: str = "Thing",
) -> Ontology:
    """Table -> class, foreign key -> object property, other column -> data property.

    Works on the tables' schemas alone; no data is read.
    """
    classes, relations, objects, data = [(top, "any entity", None, 0)], [], [], []
    for seq, (table, df) in enumerate(tables.items(), start=1):
        cls = class_of_table(table)
        classes.append((cls, f"row of {table}", None, seq))
        relations.append((cls, top, seq))
        for pos, (column, dtype) in enumerate(df.dtypes):
            at = (seq << 32) + pos
            if (table, column) in foreign_keys:
                target = class_of_table(foreign_keys[(table, column)])
                objects.append((column, f"{table}.{column}", [cls], [target], [], None, at))
            else:
                data.append((column, f"{table}.{column}", [cls], xsd_of(dtype), [], None, at))
    return Ontology(
        name,
        local_table(spark, classes, schemas.CLASSES),
        local_table(spark, relations, schemas.SUBCLASS_OF),
        local_table(spark, objects, schemas.OBJECT_PROPERTIES),
        local_table(spark, data, schemas.DATA_PROPERTIES),
    )


# ---------------------------------------------------------------- lists of classes

def _keep_list(properties: DataFrame, column: str, names: DataFrame, how: str) -> DataFrame:
    """Filter a list column by a semi or anti join on its items; order and repeats stay."""
    items = properties.select("name", "seq", F.posexplode(column).alias("pos", "class_name"))
    kept = items.join(names.select("class_name").distinct(), "class_name", how)
    lists = kept.groupBy("name", "seq").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "class_name"))), lambda x: x["class_name"])
        .alias("_kept")
    )
    return properties.join(lists, ["name", "seq"]).withColumn(column, F.col("_kept")).drop("_kept")


def restrict_properties(onto: Ontology, names: DataFrame, how: str) -> Ontology:
    """Filter domains and ranges; a property with an emptied list vanishes."""
    objects = _keep_list(_keep_list(onto.object_properties, "domain", names, how), "range", names, how)
    data = _keep_list(onto.data_properties, "domain", names, how)
    return replace(
        onto,
        object_properties=objects.select(onto.object_properties.columns),
        data_properties=data.select(onto.data_properties.columns),
    )
