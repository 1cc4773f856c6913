"""O1-O12 and G22: ontology rules over concepts that the part table proposes.

Every part row proposes classes, subclass relations and properties taken from
its name and brand, some of them faulty; most repeat what an earlier row said.
The ontology they are checked against comes from the brands.
"""

from pyspark.sql import functions as F

from kgspark import schemas
from kgspark.operators import ontology as O
from kgspark.operators.incremental import build_incremental
from kgspark.operators.run import ontology_run
from kgspark.operators.triples import entity_types, validate
from kgspark.plans.registry import n_rows, query
from kgspark.plans.star import SQL_STAR, SUBCLASS_OF, star_ontology, star_triples
from kgspark.sources.mapping import schema_facts, triples_from_table, triples_from_tables
from kgspark.sources.stages import Stages
from kgspark.storage import local_table

FIRST = 1_000_000  # seq of the first concept of the delta
NULL_GUIDE = f"cast(null as {schemas.GUIDELINE}) AS usage_guideline"


def brand_ontology(t):
    """Thing, Part, Brand and one class per brand; one data property per brand."""
    spark = t.spark
    brands = t.part.groupBy(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "").alias("name")).agg(
        (F.min("p_partkey") + 10).alias("seq")
    )
    heads = local_table(spark, [("Thing", 0), ("Part", 1), ("Brand", 2)], "name string, seq long")
    classes = heads.unionByName(brands).selectExpr("name", "cast(null as string) AS description", NULL_GUIDE, "seq")
    edges = local_table(spark, [("Part", "Thing", 0), ("Brand", "Thing", 1)], schemas.SUBCLASS_OF)
    relations = edges.unionByName(brands.selectExpr("name AS subclass", "'Brand' AS superclass", "seq"))
    data = brands.selectExpr(
        "concat('has', name) AS name", "cast(null as string) AS description", "array(name) AS domain",
        "'xsd:string' AS range", "cast(array() as array<string>) AS characteristics", NULL_GUIDE, "seq",
    )
    return O.Ontology("brands", classes, relations, O.empty_ontology(spark).object_properties, data)


SQL_BRANDS = """br AS (SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS name, min(p_partkey) + 10 AS q FROM part GROUP BY 1),
bcls AS (SELECT * FROM (VALUES ('Thing', 0), ('Part', 1), ('Brand', 2)) v(name, q) UNION ALL SELECT name, q FROM br),
bsub AS (SELECT * FROM (VALUES ('Part', 'Thing', 0), ('Brand', 'Thing', 1)) v(a, b, q) UNION ALL SELECT name, 'Brand', q FROM br)"""

_ADJ = "initcap(substring_index(p_name, ' ', 1))"
_NOUN = "initcap(substring_index(p_name, ' ', -1))"
_SEQ = f"p_partkey * 16 + {FIRST}"


def class_delta(t):
    """Per part row: noun, adjective-noun, and now and then a faulty or known name."""
    return t.part.selectExpr(f"""inline(filter(array(
        named_struct('name', {_NOUN}, 'seq', {_SEQ}),
        named_struct('name', concat({_ADJ}, {_NOUN}), 'seq', {_SEQ} + 1),
        if(p_partkey % 10 = 0, named_struct('name', p_name, 'seq', {_SEQ} + 2), null),
        if(p_partkey % 7 = 0, named_struct('name', lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '')), 'seq', {_SEQ} + 3), null),
        if(p_partkey % 5 = 0, named_struct('name', {_ADJ}, 'seq', {_SEQ} + 4), null)
      ), x -> x is not null))""").selectExpr("name", "cast(null as string) AS description", NULL_GUIDE, "seq")


SQL_PARTS = f"""w AS (SELECT p_partkey k, p_name, p_brand, p_partkey * 16 + {FIRST} AS q,
  upper(split_part(p_name, ' ', 1)[1]) || lower(substr(split_part(p_name, ' ', 1), 2)) AS adj,
  upper(split_part(p_name, ' ', -1)[1]) || lower(substr(split_part(p_name, ' ', -1), 2)) AS noun,
  regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS brand FROM part)"""

SQL_CLASS_DELTA = f"""{SQL_BRANDS}, {SQL_PARTS},
dc AS (SELECT noun AS name, q FROM w UNION ALL SELECT adj || noun, q + 1 FROM w
  UNION ALL SELECT p_name, q + 2 FROM w WHERE k % 10 = 0 UNION ALL SELECT lower(brand), q + 3 FROM w WHERE k % 7 = 0
  UNION ALL SELECT adj, q + 4 FROM w WHERE k % 5 = 0),
good AS (SELECT lower(name) AS key, min(q) AS q, arg_min(name, q) AS name FROM dc WHERE lower(name[1]) <> name[1] GROUP BY 1),
jc AS (SELECT dc.name, dc.q, coalesce(b.name, CASE WHEN g.q < dc.q THEN g.name END) AS old,
    CASE WHEN b.name IS NOT NULL OR g.q < dc.q THEN 'class_already_exists'
         WHEN lower(dc.name[1]) = dc.name[1] THEN 'class_name_not_uppercase' END AS code
  FROM dc LEFT JOIN (SELECT lower(name) AS key, arg_min(name, q) AS name FROM bcls GROUP BY 1) b ON b.key = lower(dc.name)
  LEFT JOIN good g ON g.key = lower(dc.name))"""


@query("O1_split_concepts", f"""WITH {SQL_CLASS_DELTA}
SELECT 'class' AS kind, count(*) AS n, min(name) AS first_name, CAST(sum(q) AS BIGINT) AS seq_sum FROM dc
UNION ALL SELECT 'subclass_relation', count(*), min(adj || noun), CAST(sum(q) AS BIGINT) FROM w""")
def o1(t):
    classes = class_delta(t).select(
        "seq", F.lit("class").alias("kind"), F.struct("name", "description", "usage_guideline").alias("class"),
        F.lit(None).cast(schemas.RELATION).alias("subclass_relation"),
    )
    relations = t.part.selectExpr(
        f"{_SEQ} AS seq", "'subclass_relation' AS kind", f"cast(null as {schemas.CLASS}) AS class",
        f"named_struct('subclass', concat({_ADJ}, {_NOUN}), 'superclass', {_NOUN}) AS subclass_relation",
    )
    concepts = classes.unionByName(relations).select(
        "*", F.lit(None).cast(schemas.OBJECT_PROPERTY).alias("object_property"),
        F.lit(None).cast(schemas.DATA_PROPERTY).alias("data_property"),
    )
    delta = O.split_concepts(concepts)
    parts = [("class", delta.classes, "name"), ("subclass_relation", delta.subclass_of, "subclass"),
             ("object_property", delta.object_properties, "name"), ("data_property", delta.data_properties, "name")]
    out = None
    for kind, table, name in parts:
        rows = table.groupBy(F.lit(kind).alias("kind")).agg(
            n_rows(), F.min(name).alias("first_name"), F.sum("seq").alias("seq_sum")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("O2_extend", f"""WITH {SQL_CLASS_DELTA}
SELECT name, count(*) AS n, min(q) AS first_seq FROM (SELECT name, q FROM bcls UNION ALL SELECT name, q FROM dc) GROUP BY 1""")
def o2(t):
    onto = brand_ontology(t)
    grown = O.extend(onto, O.Ontology("delta", class_delta(t), onto.subclass_of.limit(0),
                                      onto.object_properties, onto.data_properties.limit(0)))
    return grown.classes.groupBy("name").agg(n_rows(), F.min("seq").alias("first_seq"))


@query("O3_check_classes", f"""WITH {SQL_CLASS_DELTA}
SELECT code, CASE WHEN old IS NOT NULL THEN 'class:' ELSE '' END || name AS path,
  'Taken by ''' || old || '''' AS context, count(*) AS n, CAST(sum(q) AS BIGINT) AS seq_sum
FROM jc WHERE code IS NOT NULL GROUP BY ALL""")
def o3(t):
    issues = O.check_classes(brand_ontology(t), class_delta(t))
    return issues.groupBy("code", "path", "context").agg(n_rows(), F.sum("seq").alias("seq_sum"))


def accepted_delta(t):
    """Delta classes that pass their rules, in a table of their own."""
    return t.scratch.save(O.accepted_classes(brand_ontology(t), class_delta(t)), "accepted")


def relation_delta(t):
    return t.part.selectExpr(f"""inline(filter(array(
        named_struct('subclass', concat({_ADJ}, {_NOUN}), 'superclass', {_NOUN}, 'seq', {_SEQ}),
        named_struct('subclass', {_NOUN}, 'superclass', 'Part', 'seq', {_SEQ} + 1),
        if(p_partkey % 11 = 0, named_struct('subclass', concat({_ADJ}, {_NOUN}), 'superclass', 'Ghost', 'seq', {_SEQ} + 2), null),
        if(p_partkey % 13 = 0, named_struct('subclass', 'Ghost', 'superclass', {_NOUN}, 'seq', {_SEQ} + 3), null),
        if(p_partkey % 17 = 0, named_struct('subclass', {_NOUN}, 'superclass', {_NOUN}, 'seq', {_SEQ} + 4), null),
        if(p_partkey % 19 = 0, named_struct('subclass', 'Thing', 'superclass', 'Part', 'seq', {_SEQ} + 5), null)
      ), x -> x is not null))""")


SQL_RELATION_DELTA = f"""{SQL_CLASS_DELTA},
ac AS (SELECT name, q FROM jc WHERE code IS NULL),
kn AS (SELECT lower(name) AS key FROM bcls UNION SELECT lower(name) FROM ac),
dr AS (SELECT adj || noun AS a, noun AS b, q FROM w UNION ALL SELECT noun, 'Part', q + 1 FROM w
  UNION ALL SELECT adj || noun, 'Ghost', q + 2 FROM w WHERE k % 11 = 0 UNION ALL SELECT 'Ghost', noun, q + 3 FROM w WHERE k % 13 = 0
  UNION ALL SELECT noun, noun, q + 4 FROM w WHERE k % 17 = 0 UNION ALL SELECT 'Thing', 'Part', q + 5 FROM w WHERE k % 19 = 0),
bup AS (SELECT name AS c, name AS up FROM bcls UNION SELECT name, name FROM ac UNION SELECT a, a FROM bsub UNION SELECT a, b FROM bsub),
jr AS (SELECT a, b, q, CASE WHEN lower(a) NOT IN (SELECT key FROM kn) THEN 'subclass_not_found'
    WHEN lower(b) NOT IN (SELECT key FROM kn) THEN 'superclass_not_found'
    WHEN a = b THEN 'subclass_equals_superclass'
    WHEN EXISTS (SELECT 1 FROM bup x JOIN bup y ON x.up = y.up WHERE x.c = dr.a AND y.c = dr.b) THEN 'circular_subclass_relation' END AS code FROM dr),
fr AS (SELECT a, min(q) AS q, arg_min(b, q) AS b FROM jr WHERE code IS NULL GROUP BY a),
br1 AS (SELECT a, arg_min(b, q) AS b FROM bsub GROUP BY a),
je AS (SELECT jr.*, coalesce(br1.b, CASE WHEN fr.q < jr.q THEN fr.b END) AS earlier FROM jr LEFT JOIN br1 USING (a) LEFT JOIN fr ON fr.a = jr.a)"""


@query("O4_check_subclass_relations", f"""WITH {SQL_RELATION_DELTA},
i AS (SELECT code, 'relation:' || a || '->' || b AS path, CASE code
        WHEN 'subclass_not_found' THEN 'The lower class ''' || a || ''' is not defined'
        WHEN 'superclass_not_found' THEN 'The upper class ''' || b || ''' is not defined'
        WHEN 'subclass_equals_superclass' THEN '''' || a || ''' is placed below itself'
        ELSE 'The relation closes a circle' END AS message, q FROM je WHERE code IS NOT NULL
      UNION ALL SELECT 'subclass_already_has_superclass', 'relation:' || a || '->' || b,
        '''' || a || ''' is placed below ''' || earlier || ''' before', q FROM je
      WHERE earlier IS NOT NULL AND coalesce(code, '') NOT IN ('subclass_not_found', 'superclass_not_found'))
SELECT code, path, message, count(*) AS n, CAST(sum(q) AS BIGINT) AS seq_sum FROM i GROUP BY ALL""")
def o4(t):
    onto, accepted = brand_ontology(t), accepted_delta(t)
    grown = O.Ontology("grown", onto.classes.unionByName(accepted), onto.subclass_of,
                       onto.object_properties, onto.data_properties)
    issues = O.check_subclass_relations(onto, O.class_names(grown), relation_delta(t), O.superclass_sets(grown))
    return issues.groupBy("code", "path", "message").agg(n_rows(), F.sum("seq").alias("seq_sum"))


@query("O5_check_roots", f"""WITH {SQL_RELATION_DELTA},
allc AS (SELECT name, q FROM bcls UNION ALL SELECT name, q FROM ac),
alls AS (SELECT a, b FROM bsub UNION ALL SELECT a, b FROM jr WHERE code IS NULL),
root AS (SELECT name FROM allc WHERE name NOT IN (SELECT b FROM alls) ORDER BY q LIMIT 1),
orph AS (SELECT name, q FROM ac WHERE name NOT IN (SELECT a FROM alls))
SELECT 'with_root' AS scenario, 'superclass_not_found' AS code, 'class:' || name AS path, NULL AS context FROM orph
  WHERE EXISTS (SELECT 1 FROM root WHERE name NOT IN (SELECT name FROM ac))
UNION ALL SELECT 'no_root', 'multiple_classes_without_superclass', 'class:' || name,
  (SELECT count(*) FROM ac) || ' such classes' FROM ac WHERE (SELECT count(*) FROM ac) > 1""")
def o5(t):
    onto, accepted = brand_ontology(t), accepted_delta(t)
    grown = O.Ontology("grown", onto.classes.unionByName(accepted), onto.subclass_of,
                       onto.object_properties, onto.data_properties)
    judged = O.judge_relations(onto, O.class_names(grown), relation_delta(t), O.superclass_sets(grown))
    edges = judged.where("code is null").select("subclass", "superclass", "seq")
    edges = t.scratch.save(onto.subclass_of.unionByName(edges), "edges")
    after = O.Ontology("after", grown.classes, edges, onto.object_properties, onto.data_properties)
    empty = O.empty_ontology(t.spark)
    alone = O.Ontology("alone", accepted, empty.subclass_of, empty.object_properties, empty.data_properties)
    with_root = O.check_roots(accepted, after).withColumn("scenario", F.lit("with_root"))
    no_root = O.check_roots(accepted, alone).withColumn("scenario", F.lit("no_root"))
    return with_root.unionByName(no_root).select("scenario", "code", "path", "context")


def property_delta(t):
    """Per part row a data property and, for every third, an object property."""
    brand = "regexp_replace(p_brand, '[^A-Za-z0-9]', '')"
    rest = "cast(array() as array<string>) AS characteristics"
    data = t.part.selectExpr(
        f"concat('has', if(p_partkey % 4 = 0, {brand}, {_NOUN})) AS name", "cast(null as string) AS description",
        f"if(p_partkey % 6 = 1, array({_NOUN}, 'Ghost', 'Spectre'), array({_NOUN})) AS domain",
        "'xsd:string' AS range", rest, NULL_GUIDE, f"{_SEQ} + 1 AS seq",
    )
    objects = t.part.where("p_partkey % 3 = 0").selectExpr(
        f"concat('soldAs', {_ADJ}) AS name", "cast(null as string) AS description", f"array({_NOUN}) AS domain",
        f"if(p_partkey % 2 = 0, array('Phantom', {brand}), array({brand})) AS range", rest, NULL_GUIDE, f"{_SEQ} AS seq",
    )
    return objects, data


@query("O6_check_properties", f"""WITH {SQL_RELATION_DELTA},
dp AS (SELECT 'has' || CASE WHEN k % 4 = 0 THEN brand ELSE noun END AS name, q + 1 AS q, 'data' AS kind,
    CASE WHEN k % 6 = 1 THEN '''Ghost'', ''Spectre''' END AS md, NULL AS mr FROM w
  UNION ALL SELECT 'soldAs' || adj, q, 'object', NULL, CASE WHEN k % 2 = 0 THEN '''Phantom''' END FROM w WHERE k % 3 = 0),
ok AS (SELECT name, min(q) AS q FROM dp WHERE md IS NULL AND mr IS NULL GROUP BY 1),
jp AS (SELECT dp.*, dp.name IN (SELECT 'has' || name FROM br) OR coalesce(ok.q < dp.q, FALSE) AS again FROM dp LEFT JOIN ok USING (name))
SELECT CASE WHEN again THEN 'property_already_exists' WHEN md IS NOT NULL THEN 'domain_classes_not_found' ELSE 'range_classes_not_found' END AS code,
  'property:' || name AS path, CASE WHEN again THEN 'Taken by ''' || name || '''' ELSE 'Undefined: ' || coalesce(md, mr) END AS context,
  count(*) AS n, CAST(sum(q) AS BIGINT) AS seq_sum
FROM jp WHERE again OR md IS NOT NULL OR mr IS NOT NULL GROUP BY ALL""")
def o6(t):
    onto, accepted = brand_ontology(t), accepted_delta(t)
    known = O.class_names(O.Ontology("grown", onto.classes.unionByName(accepted), onto.subclass_of,
                                     onto.object_properties, onto.data_properties))
    issues = O.check_properties(onto, known, *property_delta(t))
    return issues.groupBy("code", "path", "context").agg(n_rows(), F.sum("seq").alias("seq_sum"))


def clean_delta(t):
    """Distinct classes and relations: noun below Part, adjective-noun below noun."""
    nouns = t.part.groupBy(F.expr(_NOUN).alias("name")).agg((F.min("p_partkey") * 16 + FIRST).alias("seq"))
    kinds = t.part.groupBy(F.expr(f"concat({_ADJ}, {_NOUN})").alias("name"), F.expr(_NOUN).alias("noun")).agg(
        (F.min("p_partkey") * 16 + FIRST + 1).alias("seq")
    )
    classes = nouns.unionByName(kinds.select("name", "seq")).selectExpr(
        "name", "cast(null as string) AS description", NULL_GUIDE, "seq"
    )
    relations = nouns.selectExpr("name AS subclass", "'Part' AS superclass", "seq").unionByName(
        kinds.selectExpr("name AS subclass", "noun AS superclass", "seq")
    )
    empty = O.empty_ontology(t.spark)
    return O.Ontology("delta", classes, relations, empty.object_properties, empty.data_properties)


@query("O7_try_add_concepts", f"""WITH {SQL_CLASS_DELTA}
SELECT 'clean' AS scenario, TRUE AS valid, CAST(0 AS BIGINT) AS n_issues,
  (SELECT count(*) FROM bcls) + (SELECT count(DISTINCT noun) FROM w) + (SELECT count(DISTINCT adj || noun) FROM w) AS n_classes
UNION ALL SELECT 'faulty', FALSE, (SELECT count(*) FROM jc WHERE code IS NOT NULL), (SELECT count(*) FROM bcls)""")
def o7(t):
    onto, clean = brand_ontology(t).pinned(t.scratch), clean_delta(t)
    faulty = O.Ontology("delta", class_delta(t), clean.subclass_of, clean.object_properties, clean.data_properties)
    out = None
    for name, delta in (("clean", clean), ("faulty", faulty)):
        result = O.try_add_concepts(onto, delta, t.scratch)
        row = result.issues.agg(F.count(F.lit(1)).alias("n_issues")).select(
            F.lit(name).alias("scenario"), F.lit(result.valid).alias("valid"), "n_issues",
            result.ontology.classes.agg(F.count(F.lit(1))).scalar().alias("n_classes"),
        )
        out = row if out is None else out.unionByName(row)
    return out


SQL_CLEAN = f"""{SQL_BRANDS}, {SQL_PARTS},
ocls AS (SELECT name, q FROM bcls UNION ALL SELECT noun, min(q) FROM w GROUP BY 1 UNION ALL SELECT adj || noun, min(q) + 1 FROM w GROUP BY 1),
osub AS (SELECT a, b, q FROM bsub UNION ALL SELECT noun, 'Part', min(q) FROM w GROUP BY 1 UNION ALL SELECT adj || noun, noun, min(q) + 1 FROM w GROUP BY 1, 2)"""


def part_ontology(t):
    """The brand ontology with the clean delta added."""
    return O.extend(brand_ontology(t), clean_delta(t)).pinned(t.scratch)


@query("O8_lookups", f"""WITH {SQL_CLEAN}
SELECT p_partkey, c.name AS class_name, s.b AS superclass, (SELECT count(*) FROM osub x WHERE x.b = s.b) AS siblings,
  EXISTS (SELECT 1 FROM br WHERE name = w.brand) AS has_property
FROM w JOIN part ON p_partkey = k LEFT JOIN (SELECT lower(name) AS key, arg_min(name, q) AS name FROM ocls GROUP BY 1) c ON c.key = lower(replace(w.p_name, ' ', ''))
LEFT JOIN (SELECT a, arg_min(b, q) AS b FROM osub GROUP BY 1) s ON s.a = c.name""")
def o8(t):
    onto = part_ontology(t)
    siblings = onto.subclass_of.groupBy("superclass").agg(F.count(F.lit(1)).alias("siblings"))
    properties = O.all_properties(onto).select(F.col("name").alias("property"), F.lit(True).alias("has_property"))
    parts = t.part.selectExpr(
        "p_partkey", "lower(replace(p_name, ' ', '')) AS name_key",
        "concat('has', regexp_replace(p_brand, '[^A-Za-z0-9]', '')) AS property",
    )
    return (
        parts.join(O.class_names(onto), "name_key", "left")
        .join(O.first_superclasses(onto).withColumnRenamed("subclass", "class_name"), "class_name", "left")
        .join(siblings, "superclass", "left")
        .join(properties, "property", "left")
        .select("p_partkey", "class_name", "superclass", "siblings",
                F.coalesce("has_property", F.lit(False)).alias("has_property"))
    )


@query("O9_root", f"""WITH {SQL_CLEAN}
SELECT 'root' AS kind, name FROM (SELECT name FROM ocls WHERE name NOT IN (SELECT b FROM osub) ORDER BY q LIMIT 1)
UNION ALL SELECT 'top', name FROM ocls WHERE name NOT IN (SELECT a FROM osub)""")
def o9(t):
    onto = part_ontology(t)
    return O.root_class(onto).select(F.lit("root").alias("kind"), "name").unionByName(
        O.top_classes(onto).select(F.lit("top").alias("kind"), "name")
    )


@query("O10_superclasses", f"""WITH RECURSIVE {SQL_CLEAN},
up(c, up) AS (SELECT name, name FROM ocls UNION SELECT a, a FROM osub UNION SELECT up.c, b FROM up JOIN osub ON a = up.up)
SELECT 'direct' AS closure, name AS class_name, name AS super FROM ocls UNION SELECT 'direct', a, a FROM osub UNION SELECT 'direct', a, b FROM osub
UNION SELECT 'transitive', c, up FROM up""")
def o10(t):
    onto = part_ontology(t)
    direct = O.superclass_pairs(onto).select(F.lit("direct").alias("closure"), "class_name", "super")
    closed = O.transitive_superclass_pairs(onto, t.scratch)
    return direct.unionByName(closed.select(F.lit("transitive").alias("closure"), "class_name", "super"))


def concept_batches(t):
    """Batch 0 names Thing, batch r + 1 a region and its nations, and each customer is a batch.

    Two of three customers propose the class of their nation and segment, which only the first
    of them can add; the others propose a class of their own below it, which needs an
    earlier batch that has added it.
    """
    region = "concat('Region', r_regionkey)"
    nation = "concat('Nation', n_nationkey)"
    market = "concat('Market', c_nationkey, initcap(c_mktsegment))"
    nations = t.nation.join(t.region, F.expr("n_regionkey = r_regionkey"))
    null_class = f"cast(null as {schemas.CLASS})"
    null_rel = f"cast(null as {schemas.RELATION})"

    def pair(df, batch, name, superclass, seq):
        guide = f"named_struct('name', {name}, 'description', cast(null as string), 'usage_guideline', cast(null as {schemas.GUIDELINE}))"
        rel = f"named_struct('subclass', {name}, 'superclass', {superclass})"
        return df.selectExpr(f"""inline(array(
            named_struct('batch_id', cast({batch} as bigint), 'seq', cast({seq} as bigint), 'kind', 'class', 'class', {guide}, 'subclass_relation', {null_rel}),
            named_struct('batch_id', cast({batch} as bigint), 'seq', cast({seq} as bigint) + 1, 'kind', 'subclass_relation', 'class', {null_class}, 'subclass_relation', {rel})))""")

    own = "c_custkey % 3 = 0"
    rows = (
        pair(t.region, "r_regionkey + 1", region, "'Thing'", "(r_regionkey + 1) * 1000")
        .unionByName(pair(nations, "r_regionkey + 1", nation, region, "(r_regionkey + 1) * 1000 + 10 + n_nationkey * 2"))
        .unionByName(pair(
            t.customer, "c_custkey + 100", f"if({own}, concat('Client', c_custkey), {market})",
            f"if({own}, {market}, concat('Nation', c_nationkey))", "(cast(c_custkey as bigint) + 100) * 1000",
        ))
        # Region 2 also relates an unknown class, so its batch is refused.
        .unionByName(pair(t.region.where("r_regionkey = 2"), "3", "'Extra'", "'Ghost'", "3990"))
    )
    thing = pair(t.region.where("r_regionkey = 0"), "0", "'Thing'", "'Thing'", "0").where("kind = 'class'")
    return rows.unionByName(thing).select(
        "*", F.lit(None).cast(schemas.OBJECT_PROPERTY).alias("object_property"),
        F.lit(None).cast(schemas.DATA_PROPERTY).alias("data_property"),
    )


@query("O11_build_ontology_incremental", """
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT n, s, min(k) AS first FROM c WHERE k % 3 <> 0 AND r <> 2 GROUP BY 1, 2),
log AS (SELECT CAST(0 AS BIGINT) AS batch_id, CAST(0 AS BIGINT) AS n_issues, CAST(1 AS BIGINT) AS adds
  UNION ALL SELECT n_regionkey + 1, CASE WHEN n_regionkey = 2 THEN 2 ELSE 0 END, 1 + count(*) FROM nation GROUP BY n_regionkey
  UNION ALL SELECT k + 100, CASE WHEN r = 2 THEN 2 WHEN k % 3 <> 0 THEN (CASE WHEN k = first THEN 0 ELSE 1 END)
                                 WHEN first < k THEN 0 ELSE 2 END, 1 FROM c LEFT JOIN m USING (n, s))
SELECT batch_id, n_issues = 0 AS valid, n_issues, (SELECT CAST(sum(adds) AS BIGINT) FROM log WHERE n_issues = 0) AS n_classes FROM log""")
def o11(t):
    onto, log = build_incremental(O.empty_ontology(t.spark), concept_batches(t), t.scratch)
    total = onto.classes.agg(F.count(F.lit(1))).scalar()
    return log.select("batch_id", "valid", "n_issues", total.alias("n_classes"))


_MARKET = "concat('Market', c_nationkey, initcap(c_mktsegment))"


def ask_markets(members):
    """Every member asks about its market."""
    return members.select("group_id", "slot", F.expr(
        f"concat('Which parts do clients of ', {_MARKET}, ' order most?')"
    ).alias("text"))


def propose_markets(batches):
    """A class per question below Thing, which the first batch brings."""
    name = F.regexp_extract("text", r"(Market\w+)", 1)
    parts = [F.struct(F.lit(0).alias("at"), F.lit("class").alias("kind"), name.alias("name"), F.lit(None).cast("string").alias("above")),
             F.struct(F.lit(1).alias("at"), F.lit("subclass_relation").alias("kind"), name.alias("name"), F.lit("Thing").alias("above"))]
    thing = F.struct(F.lit(-1).alias("at"), F.lit("class").alias("kind"), F.lit("Thing").alias("name"), F.lit(None).cast("string").alias("above"))
    rows = batches.select("batch_id", "seq", F.explode(F.when(F.col("seq") == 0, F.array(thing, *parts)).otherwise(F.array(*parts))).alias("c"))
    is_class = F.col("c.kind") == "class"
    guide = F.lit(None).cast(schemas.GUIDELINE)
    return rows.select(
        "batch_id", (F.col("seq") * 10 + F.col("c.at") + 1).cast("long").alias("seq"), "c.kind",
        F.when(is_class, F.struct(F.col("c.name").alias("name"), F.lit(None).cast("string").alias("description"), guide.alias("usage_guideline"))).alias("class"),
        F.when(~is_class, F.struct(F.col("c.name").alias("subclass"), F.col("c.above").alias("superclass"))).alias("subclass_relation"),
        F.lit(None).cast(schemas.OBJECT_PROPERTY).alias("object_property"),
        F.lit(None).cast(schemas.DATA_PROPERTY).alias("data_property"),
    )


@query("U7_ontology_run", """
WITH m AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY 1, 2),
b AS (SELECT CAST(floor((row_number() OVER (ORDER BY k) - 1) / 4) AS BIGINT) AS batch_id FROM m)
SELECT batch_id, true AS valid, count(*) AS n_questions, (SELECT count(*) + 1 FROM m) AS n_classes,
  CAST(0 AS BIGINT) AS reused_first, CAST(7 AS BIGINT) AS reused_second FROM b GROUP BY 1""")
def u7_run(t):
    groups = t.customer.selectExpr(
        "cast(c_custkey as bigint) AS group_id", "element_at(array('low', 'medium', 'high'), cast(c_custkey % 3 + 1 as int)) AS priority",
        "c_nationkey", "c_mktsegment",
    )
    root = t.scratch.new_path("run")
    runs = []
    for _ in range(2):
        stages = Stages(t.spark, root)
        runs.append(ontology_run(stages, groups, ask_markets, propose_markets, t.scratch))
    n_classes = runs[1].ontology.classes.agg(F.count(F.lit(1))).scalar()
    questions = stages.tables["batches"]["rows"].groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_questions"))
    return runs[1].log.join(questions, "batch_id").select(
        "batch_id", "valid", "n_questions", n_classes.alias("n_classes"),
        F.lit(sum(runs[0].reused.values())).cast("long").alias("reused_first"),
        F.lit(sum(runs[1].reused.values())).cast("long").alias("reused_second"),
    )


def star_profile(t):
    # The mapping is a narrow projection: reading it again is cheaper than writing it.
    kg = star_triples(t)
    types = t.scratch.save(entity_types(kg), "types")
    return O.induced_properties(kg, types, t.scratch, distinct=False)


SQL_PROFILE = """ty AS (SELECT s, o AS cl FROM kg WHERE p = 'isA'),
prof AS (SELECT p, a.cl AS dc, b.cl AS rc, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM kg WHERE p <> 'isA') f
  JOIN ty a ON a.s = f.s LEFT JOIN ty b ON b.s = f.o GROUP BY ALL)"""


def induced_ontology(t):
    """Classes and hierarchy of the star ontology, properties as the graph uses them."""
    base = star_ontology(t.spark)
    return O.ontology_from_profile("induced", base.classes, base.subclass_of, star_profile(t)).pinned(t.scratch)


@query("O12_ontology_from_tables", f"""WITH {SQL_STAR}, {SQL_PROFILE}
SELECT p AS name, CASE WHEN count(rc) > 0 THEN 'object' ELSE 'data' END AS kind,
  string_agg(DISTINCT dc, ',' ORDER BY dc) AS domain,
  coalesce(string_agg(DISTINCT rc, ',' ORDER BY rc), 'xsd:string') AS range FROM prof GROUP BY 1""")
def o12(t):
    rows = O.all_properties(induced_ontology(t))
    return rows.select("name", "kind", F.array_join("domain", ",").alias("domain"), F.array_join("range", ",").alias("range"))


# Keys of the tables, and what their foreign keys point to.
TABLE_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey",
}
FOREIGN_KEYS = {
    ("nation", "n_regionkey"): "region", ("customer", "c_nationkey"): "nation",
    ("supplier", "s_nationkey"): "nation", ("orders", "o_custkey"): "customer",
}
SQL_BY_SCHEMA = " UNION ALL ".join(
    [f"SELECT 'isA' AS p, '{table.capitalize()}' AS o FROM {table}" for table in TABLE_KEYS]
    + [
        f"SELECT '{column}', '{FOREIGN_KEYS.get((table, column), '')}' || CAST({column} AS VARCHAR) FROM {table}"
        for table, columns in {
            "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
            "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
            "supplier": "s_suppkey s_name s_nationkey s_acctbal",
            "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
            "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
        }.items() for column in columns.split()
    ]
)


@query("O12_rows_by_schema", f"""WITH f AS ({SQL_BY_SCHEMA})
SELECT p AS predicate, CASE WHEN p = 'isA' THEN NULL WHEN p IN ('n_regionkey', 'c_nationkey', 's_nationkey', 'o_custkey') THEN 'object' ELSE 'data' END AS kind,
  CAST(NULL AS VARCHAR) AS error_code, count(o) AS n, count(DISTINCT o) AS n_objects FROM f GROUP BY 1, 2""")
def o12_rows(t):
    """Rows of all tables as triples, judged by the ontology that the tables' schemas give."""
    tables = {name: getattr(t, name) for name in TABLE_KEYS}
    onto = O.ontology_from_tables(t.spark, tables, FOREIGN_KEYS)
    kg = triples_from_tables([
        triples_from_table(df, schema_facts(name, df, TABLE_KEYS[name], FOREIGN_KEYS), "0", f"{TABLE_KEYS[name]} * 16L")
        for name, df in tables.items()
    ])
    kinds = O.all_properties(onto).select(F.col("name").alias("predicate"), "kind")
    judged = validate(kg, onto, t.scratch).groupBy("predicate", "error_code").agg(
        n_rows(), F.countDistinct("object").alias("n_objects")
    )
    return judged.join(kinds, "predicate", "left").select("predicate", "kind", "error_code", "n", "n_objects")


@query("G22_ontology_metrics", f"""WITH {SQL_STAR}, {SQL_PROFILE}, k AS (SELECT p, count(rc) > 0 AS ob FROM prof GROUP BY p)
SELECT CAST({len(set(c for e in SUBCLASS_OF for c in e))} AS BIGINT) AS classes, count(*) FILTER (ob) AS object_properties, count(*) FILTER (NOT ob) AS data_properties FROM k""")
def g22(t):
    return O.ontology_metrics(induced_ontology(t))
