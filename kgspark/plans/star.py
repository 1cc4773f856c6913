"""The star schema as a knowledge graph: mapping, ontology, and SQL twins.

``star_triples`` is the clean graph. ``raw_triples`` is the same with faults
planted by key, so that every validation rule meets rows that break it. Order
``k`` with its lines is batch ``4 + k``; the dimension tables are batches 0 to 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark import schemas
from kgspark.operators.ontology import Ontology
from kgspark.plans.registry import Tables
from kgspark.sources.mapping import Fact, entity, triples_from_table, triples_from_tables
from kgspark.storage import local_table

SLOTS = 64


def _typed(prefix: str, key: str, cls: str) -> Fact:
    return Fact(entity(prefix, key), "isA", f"'{cls}'")


def dimension_triples(t: Tables) -> DataFrame:
    region, nation = entity("region", "r_regionkey"), entity("nation", "n_nationkey")
    customer, supplier = entity("customer", "c_custkey"), entity("supplier", "s_suppkey")
    part = entity("part", "p_partkey")
    return triples_from_tables([
        triples_from_table(t.region, [
            _typed("region", "r_regionkey", "Region"),
            Fact(region, "hasName", "r_name"),
        ], "0", f"r_regionkey * {SLOTS}"),
        # Regions share batch 0; the offset keeps the rows apart.
        triples_from_table(t.nation, [
            _typed("nation", "n_nationkey", "Nation"),
            Fact(nation, "partOf", entity("region", "n_regionkey")),
            Fact(nation, "hasName", "n_name"),
        ], "0", f"(n_nationkey + 100) * {SLOTS}"),
        triples_from_table(t.customer, [
            _typed("customer", "c_custkey", "Customer"),
            Fact(customer, "locatedIn", entity("nation", "c_nationkey")),
            Fact(customer, "hasSegment", "c_mktsegment"),
        ], "1", f"c_custkey * {SLOTS}"),
        triples_from_table(t.supplier, [
            _typed("supplier", "s_suppkey", "Supplier"),
            Fact(supplier, "locatedIn", entity("nation", "s_nationkey")),
        ], "2", f"s_suppkey * {SLOTS}"),
        triples_from_table(t.part, [
            _typed("part", "p_partkey", "Part"),
            Fact(part, "hasBrand", "p_brand"),
            Fact(part, "hasName", "p_name"),
        ], "3", f"p_partkey * {SLOTS}"),
    ])


def line_triples(t: Tables) -> DataFrame:
    order = entity("order", "l_orderkey")
    return triples_from_table(t.lineitem, [
        Fact(order, "containsPart", entity("part", "l_partkey")),
        Fact(order, "shippedBy", entity("supplier", "l_suppkey")),
    ], "l_orderkey + 4", f"l_orderkey * {SLOTS} + 16 + l_linenumber * 4")


def order_triples(t: Tables) -> DataFrame:
    order = entity("order", "o_orderkey")
    return triples_from_table(t.orders, [
        Fact(order, "isA", "'Order'"),
        Fact(order, "placedBy", entity("customer", "o_custkey"), slot=4),
        Fact(order, "hasStatus", "o_orderstatus", slot=6),
    ], "o_orderkey + 4", f"o_orderkey * {SLOTS}")


def star_triples(t: Tables) -> DataFrame:
    return triples_from_tables([dimension_triples(t), order_triples(t), line_triples(t)])


def raw_order_triples(t: Tables) -> DataFrame:
    def every(n: int, r: int) -> str:
        return f"o_orderkey % {n} = {r}"

    subject = f"concat(if({every(97, 5)}, 'Order_', 'order_'), o_orderkey)"
    customer = entity("customer", "o_custkey")
    named_badly = entity("Customer", "o_orderkey")
    payer = (
        f"CASE WHEN {every(107, 19)} THEN 'Customer' WHEN {every(109, 23)} THEN {entity('nation', 'o_custkey % 25')} "
        f"WHEN {every(113, 29)} THEN {entity('ghost', 'o_orderkey')} WHEN {every(61, 7)} THEN {named_badly} "
        f"ELSE {customer} END"
    )
    cls = f"CASE WHEN {every(101, 13)} THEN 'Gadget' WHEN {every(71, 3)} THEN 'order' ELSE 'Order' END"
    return triples_from_table(t.orders, [
        Fact(subject, "isA", cls, f"not {every(83, 11)}", 0),
        Fact(subject, "isA", "'Customer'", f"{every(79, 3)} or {every(97, 5)}", 1),
        Fact(subject, "isA", "'RushOrder'", every(73, 1), 2),
        Fact("'Thing'", "isA", "'Order'", every(103, 17), 3),
        Fact(subject, "placedBy", payer, slot=4),
        Fact(named_badly, "isA", "'Customer'", every(61, 7), 5),
        Fact(subject, "hasStatus", "o_orderstatus", slot=6),
        Fact(subject, "unknownLink", customer, every(89, 7), 7),
        Fact(subject, "isA", "'order'", every(142, 3), 8),
        Fact("'Order'", "hasStatus", "o_orderstatus", every(137, 9), 10),
        Fact(subject, "followsOrder", entity("order", "o_orderkey - 1"), "o_orderkey % 4 != 0", 9),
    ], "o_orderkey + 4", f"o_orderkey * {SLOTS}")


def raw_triples(t: Tables) -> DataFrame:
    return triples_from_tables([dimension_triples(t), raw_order_triples(t), line_triples(t)])


def prior_triples(t: Tables) -> DataFrame:
    """Triples taken as given before validation: some statuses, some odd types."""
    order = entity("order", "o_orderkey")
    return triples_from_table(t.orders, [
        Fact(order, "hasStatus", "o_orderstatus", "o_orderkey % 10 = 0"),
        Fact(order, "isA", "'RushOrder'", "o_orderkey % 131 = 31"),
        Fact("'Order'", "isA", "'Order'", "o_orderkey = 1"),
    ], "-1", f"o_orderkey * {SLOTS}")


# The ontology the star schema is checked against.
CLASSES = [
    "Thing", "Agent", "Place", "Product", "Customer", "Supplier", "Region", "Nation", "Part", "Order", "RushOrder",
]
SUBCLASS_OF = [
    ("Agent", "Thing"), ("Place", "Thing"), ("Product", "Thing"), ("Customer", "Agent"),
    ("Supplier", "Agent"), ("Region", "Place"), ("Nation", "Place"), ("Part", "Product"),
    ("Order", "Thing"), ("RushOrder", "Order"),
]
OBJECT_PROPERTIES = [
    ("partOf", ["Place"], ["Place"]), ("locatedIn", ["Agent"], ["Place"]),
    ("placedBy", ["Order"], ["Agent"]), ("containsPart", ["Order"], ["Product"]),
    ("shippedBy", ["Order"], ["Supplier"]), ("followsOrder", ["Order"], ["Order"]),
]
DATA_PROPERTIES = [
    ("hasName", ["Place", "Product"]), ("hasSegment", ["Customer"]), ("hasBrand", ["Part"]), ("hasStatus", ["Order"]),
]


def star_ontology(spark: SparkSession) -> Ontology:
    return make_ontology(spark, "star", CLASSES, SUBCLASS_OF, OBJECT_PROPERTIES, DATA_PROPERTIES)


def make_ontology(spark, name, classes, subclass_of, object_properties, data_properties) -> Ontology:
    """An ontology from short Python lists (a schema, so driver-sized)."""
    return Ontology(
        name,
        local_table(spark, [(c, None, None, i) for i, c in enumerate(classes)], schemas.CLASSES),
        local_table(spark, [(a, b, i) for i, (a, b) in enumerate(subclass_of)], schemas.SUBCLASS_OF),
        local_table(
            spark, [(p, None, d, r, [], None, i) for i, (p, d, r) in enumerate(object_properties)],
            schemas.OBJECT_PROPERTIES,
        ),
        local_table(
            spark, [(p, None, d, "xsd:string", [], None, i) for i, (p, d) in enumerate(data_properties)],
            schemas.DATA_PROPERTIES,
        ),
    )


# ------------------------------------------------------------- SQL twins

_SQL_DIMENSIONS = """
  SELECT 'region_' || r_regionkey s, 'isA' p, 'Region' o, 0 b, r_regionkey * 64 q FROM region
  UNION ALL SELECT 'region_' || r_regionkey, 'hasName', r_name, 0, r_regionkey * 64 + 1 FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, 'isA', 'Nation', 0, (n_nationkey + 100) * 64 FROM nation
  UNION ALL SELECT 'nation_' || n_nationkey, 'partOf', 'region_' || n_regionkey, 0, (n_nationkey + 100) * 64 + 1 FROM nation
  UNION ALL SELECT 'nation_' || n_nationkey, 'hasName', n_name, 0, (n_nationkey + 100) * 64 + 2 FROM nation
  UNION ALL SELECT 'customer_' || c_custkey, 'isA', 'Customer', 1, c_custkey * 64 FROM customer
  UNION ALL SELECT 'customer_' || c_custkey, 'locatedIn', 'nation_' || c_nationkey, 1, c_custkey * 64 + 1 FROM customer
  UNION ALL SELECT 'customer_' || c_custkey, 'hasSegment', c_mktsegment, 1, c_custkey * 64 + 2 FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, 'isA', 'Supplier', 2, s_suppkey * 64 FROM supplier
  UNION ALL SELECT 'supplier_' || s_suppkey, 'locatedIn', 'nation_' || s_nationkey, 2, s_suppkey * 64 + 1 FROM supplier
  UNION ALL SELECT 'part_' || p_partkey, 'isA', 'Part', 3, p_partkey * 64 FROM part
  UNION ALL SELECT 'part_' || p_partkey, 'hasBrand', p_brand, 3, p_partkey * 64 + 1 FROM part
  UNION ALL SELECT 'part_' || p_partkey, 'hasName', p_name, 3, p_partkey * 64 + 2 FROM part
"""
_SQL_LINES = """
  UNION ALL SELECT 'order_' || l_orderkey, 'containsPart', 'part_' || l_partkey, l_orderkey + 4, l_orderkey * 64 + 16 + l_linenumber * 4 FROM lineitem
  UNION ALL SELECT 'order_' || l_orderkey, 'shippedBy', 'supplier_' || l_suppkey, l_orderkey + 4, l_orderkey * 64 + 17 + l_linenumber * 4 FROM lineitem
"""
_SQL_ORDERS = """
  UNION ALL SELECT 'order_' || o_orderkey, 'isA', 'Order', o_orderkey + 4, o_orderkey * 64 FROM orders
  UNION ALL SELECT 'order_' || o_orderkey, 'placedBy', 'customer_' || o_custkey, o_orderkey + 4, o_orderkey * 64 + 4 FROM orders
  UNION ALL SELECT 'order_' || o_orderkey, 'hasStatus', o_orderstatus, o_orderkey + 4, o_orderkey * 64 + 6 FROM orders
"""
_SQL_RAW_ORDERS = """
  UNION ALL SELECT * FROM (
    WITH x AS (
      SELECT o_orderkey k, o_custkey c, o_orderstatus st,
             CASE WHEN o_orderkey % 97 = 5 THEN 'Order_' ELSE 'order_' END || o_orderkey AS s
      FROM orders)
    SELECT s, 'isA' p, CASE WHEN k % 101 = 13 THEN 'Gadget' WHEN k % 71 = 3 THEN 'order' ELSE 'Order' END o, k + 4 b, k * 64 q FROM x WHERE k % 83 <> 11
    UNION ALL SELECT s, 'isA', 'Customer', k + 4, k * 64 + 1 FROM x WHERE k % 79 = 3 OR k % 97 = 5
    UNION ALL SELECT s, 'isA', 'RushOrder', k + 4, k * 64 + 2 FROM x WHERE k % 73 = 1
    UNION ALL SELECT 'Thing', 'isA', 'Order', k + 4, k * 64 + 3 FROM x WHERE k % 103 = 17
    UNION ALL SELECT s, 'placedBy',
      CASE WHEN k % 107 = 19 THEN 'Customer' WHEN k % 109 = 23 THEN 'nation_' || (c % 25)
           WHEN k % 113 = 29 THEN 'ghost_' || k WHEN k % 61 = 7 THEN 'Customer_' || k
           ELSE 'customer_' || c END, k + 4, k * 64 + 4 FROM x
    UNION ALL SELECT 'Customer_' || k, 'isA', 'Customer', k + 4, k * 64 + 5 FROM x WHERE k % 61 = 7
    UNION ALL SELECT s, 'hasStatus', st, k + 4, k * 64 + 6 FROM x
    UNION ALL SELECT s, 'unknownLink', 'customer_' || c, k + 4, k * 64 + 7 FROM x WHERE k % 89 = 7
    UNION ALL SELECT s, 'isA', 'order', k + 4, k * 64 + 8 FROM x WHERE k % 142 = 3
    UNION ALL SELECT 'Order', 'hasStatus', st, k + 4, k * 64 + 10 FROM x WHERE k % 137 = 9
    UNION ALL SELECT s, 'followsOrder', 'order_' || (k - 1), k + 4, k * 64 + 9 FROM x WHERE k % 4 <> 0)
"""
_SQL_PRIOR = """
  SELECT 'order_' || o_orderkey s, 'hasStatus' p, o_orderstatus o, -1 b, o_orderkey * 64 q FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 'order_' || o_orderkey, 'isA', 'RushOrder', -1, o_orderkey * 64 + 1 FROM orders WHERE o_orderkey % 131 = 31
  UNION ALL SELECT 'Order', 'isA', 'Order', -1, o_orderkey * 64 + 2 FROM orders WHERE o_orderkey = 1
"""


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


SQL_STAR = f"kg AS ({_SQL_DIMENSIONS}{_SQL_ORDERS}{_SQL_LINES})"
SQL_RAW = f"kg AS ({_SQL_DIMENSIONS}{_SQL_RAW_ORDERS}{_SQL_LINES})"
SQL_PRIOR = f"prior AS ({_SQL_PRIOR})"
SQL_ONTOLOGY = (
    "cls(c) AS (VALUES " + ", ".join(f"('{c}')" for c in CLASSES) + "),\n"
    "sub(a, b, q) AS (VALUES " + ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(SUBCLASS_OF)) + "),\n"
    "sup AS (SELECT c, c AS up FROM cls UNION SELECT a, b FROM sub),\n"
    "prop(name, kind, dom, rng, q) AS (VALUES "
    + ", ".join(
        [f"('{p}', 'object', {_list(d)}, {_list(r)}, {i})" for i, (p, d, r) in enumerate(OBJECT_PROPERTIES)]
        + [f"('{p}', 'data', {_list(d)}, ['xsd:string'], {i})" for i, (p, d) in enumerate(DATA_PROPERTIES)]
    )
    + ")"
)
