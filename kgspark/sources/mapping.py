"""Triples from relational rows, web pages, JSON fields and text rules.

These take the place of a text-understanding extractor: a list of facts per
table, each a narrow projection, so a whole mapping runs without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.functions.scalars import to_snake_case
from kgspark.operators.ontology import class_of_table


@dataclass(frozen=True)
class Fact:
    """One triple per row of a table, if ``when`` holds; the parts are SQL expressions."""

    subject: str
    predicate: str
    object: str
    when: str | None = None
    slot: int | None = None


def entity(prefix: str, key: str) -> str:
    """SQL for the id of a row as an entity: ``prefix_key``."""
    return f"concat('{prefix}_', {key})"


def triples_from_table(df: DataFrame, facts: list[Fact], batch_id: str, first_seq: str) -> DataFrame:
    """Explode the facts of each row; ``seq`` is ``first_seq`` plus the fact's slot."""
    structs = []
    for position, fact in enumerate(facts):
        slot = position if fact.slot is None else fact.slot
        triple = (
            f"named_struct('subject', {fact.subject}, 'predicate', '{fact.predicate}', "
            f"'object', cast({fact.object} as string), 'batch_id', cast({batch_id} as bigint), "
            f"'seq', cast({first_seq} as bigint) + {slot})"
        )
        structs.append(triple if fact.when is None else f"if({fact.when}, {triple}, null)")
    # A fact whose condition fails, or with a missing end, gives no triple.
    return df.selectExpr(f"inline(array({', '.join(structs)}))").where(
        "subject is not null and object is not null"
    )


def schema_facts(table: str, df: DataFrame, key: str, foreign_keys: dict[tuple[str, str], str]) -> list[Fact]:
    """Facts of a table by its schema alone, as ``ontology_from_tables`` describes them.

    A row is an entity of its table's class; a foreign key names a row of the table it
    points to, by that table's key; other columns are values. A null gives no triple.
    """
    me = entity(table, key)
    facts = [Fact(me, "isA", f"'{class_of_table(table)}'")]
    for column in df.columns:
        target = foreign_keys.get((table, column))
        facts.append(Fact(me, column, entity(target, column) if target else column))
    return facts


def triples_from_tables(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def triples_from_links(
    pages: DataFrame, subject: str, html: str, batch_id: str, predicate: str = "linksTo"
) -> DataFrame:
    """One triple per href of a page; the position in the page is the ``seq``.

    ``batch_id`` is SQL, as ``subject``; so the rows of all three functions can be validated.
    """
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]*)"'), F.lit(1))
    found = pages.select(F.expr(subject).alias("subject"), _batch(batch_id), F.posexplode(hrefs).alias("seq", "object"))
    return found.withColumn("predicate", F.lit(predicate)).transform(_triples)


def triples_from_json(
    df: DataFrame, subject: str, json: str, batch_id: str, prefix: str = "has"
) -> DataFrame:
    """One triple per key of a flat JSON object: (subject, hasKey, value); the key's place is the ``seq``."""
    entries = F.posexplode(F.map_entries(F.from_json(F.col(json), "map<string,string>"))).alias("seq", "e")
    return df.select(F.expr(subject).alias("subject"), _batch(batch_id), entries).withColumn(
        "predicate", F.concat(F.lit(prefix), F.initcap("e.key"))
    ).withColumn("object", F.col("e.value")).transform(_triples)


def triples_from_pattern(
    docs: DataFrame, subject: str, text: str, predicate: str, pattern: str, batch_id: str, group: int = 1,
    as_entity: bool = True,
) -> DataFrame:
    """One triple per match of a rule in the whole text of a document; matches count up the ``seq``."""
    found = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).alias("seq", "m")
    value = to_snake_case("m") if as_entity else F.col("m")
    rows = docs.select(F.expr(subject).alias("subject"), _batch(batch_id), found)
    return rows.withColumn("predicate", F.lit(predicate)).withColumn("object", value).transform(_triples).where("object != ''")


def _triples(rows: DataFrame) -> DataFrame:
    return rows.select("subject", "predicate", "object", "batch_id", F.col("seq").cast("long").alias("seq"))


def _batch(batch_id: str) -> Column:
    return F.expr(batch_id).cast("long").alias("batch_id")
