"""The whole extraction run: texts to a validated graph by a model.

Long texts are cut to chunks; every chunk is a request that carries the types
already known of entities it names. Replies are parsed and judged; those at fault
are sent again with their errors. Accepted triples of a pass join the graph, and
passes go on until one finds nothing new. If a path is given, each pass is published
there as soon as it is judged, and a run that was stopped goes on behind its last pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from kgspark import schemas
from kgspark.operators import models, text as texts, triples as T
from kgspark.operators.ontology import Ontology
from kgspark.skew import dense_index
from kgspark.sources.files import write_partial
from kgspark.storage import Scratch, local_table

INSTRUCTION = "List the facts of the text as triples of the ontology."


def number_chunks(docs: DataFrame, doc_id: str, text: str, scratch: Scratch, chunk_size: int) -> DataFrame:
    """(request_id, doc, pos, text): chunks of the texts that need them, numbered in order."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("trim(text) != ''")
    # Written first, as numbering reads the keys once more to find its ranges: texts are cut once.
    chunks = scratch.save(texts.chunk_gate(rows, "text", chunk_size), "cut")
    return scratch.save(dense_index(chunks, [F.asc("doc"), F.asc("pos")], "request_id", scratch), "chunks")


def known_types(chunks: DataFrame, kg: DataFrame) -> DataFrame:
    """(request_id, known): JSON list of the types of entities that a chunk names.

    One type per entity and at most one entity per word, so a list is as long as
    the chunk. Only types are sent: what else is known of an entity has no bound.
    """
    types = T.entity_types(kg).select("subject", F.lit(T.IS_A).alias("predicate"), F.col("class_name").alias("object"))
    mentioned = models.mentioned_state(chunks, types, "request_id", "text")
    return mentioned.groupBy("request_id").agg(
        F.to_json(F.sort_array(F.collect_set(F.struct(*T.SPO)))).alias("known")
    )


def generate_kg(
    docs: DataFrame, doc_id: str, text: str, onto: Ontology, make: Callable[[], models.BatchFunction],
    scratch: Scratch, epochs: int = 3, tries: int = models.TRIES, mode: str = "row",
    chunk_size: int = texts.CHUNK_SIZE, path: str | None = None, delay: float = models.DELAY,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kg, progress, failed): graph with epochs, its growth, and requests that failed all tries.

    ``make`` gives the model, see ``models.map_model``. What a reply states wrongly
    is a fault of the reply; after the last try its good triples still count in
    row mode.
    """
    spark = docs.sparkSession
    chunks = number_chunks(docs, doc_id, text, scratch, chunk_size)
    rules = T.prepare_rules(onto, scratch)
    failures: dict[int, DataFrame] = {}

    def read_failed(schema, epoch: int) -> DataFrame:
        names = [f.name for f in schema if f.name != "epoch"]
        return spark.read.parquet(f"{path}/_failed/epoch={epoch}").select(*names).withColumn("epoch", F.lit(epoch))

    def extract(kg: DataFrame, epoch: int) -> DataFrame:
        known = scratch.save(known_types(chunks, kg), "known")
        asked = chunks.join(known, "request_id", "left").withColumn("known", F.coalesce("known", F.lit("[]")))
        requests = scratch.save(models.render_requests(asked, INSTRUCTION, ["text", "known"]), "requests")

        def check(replies: DataFrame) -> DataFrame:
            rows, broken = T.parse_triples(replies)
            judged = T.validate(scratch.save(rows, "parsed"), rules, scratch, prior=kg)
            return models.reply_errors(T.error_messages(judged)).unionByName(broken.select(
                F.col("request_id").cast("long"), F.lit("the reply is no list of triples").alias("errors")
            ))

        answered, failed = models.validate_and_retry(requests, make, check, scratch, tries=tries, delay=delay)
        failed = failed.withColumn("epoch", F.lit(epoch))
        if path is None:
            failed = scratch.save(failed, "failed")
        else:  # before the pass is committed, so that a committed pass has them
            write_partial(failed.drop("epoch"), epoch, f"{path}/_failed")
            failed = read_failed(failed.schema, epoch)
        failures[epoch] = failed
        replies = answered.select("request_id", "response").unionByName(failed.select("request_id", "response"))
        return T.parse_triples(replies)[0]

    empty = local_table(spark, [], schemas.TRIPLES)
    kg, progress = T.run_epochs(extract, empty, rules, scratch, epochs, mode=mode, path=path)
    if path is not None:
        # Passes of an earlier run have their failures there.
        for (epoch,) in progress.select("epoch").distinct().collect():
            if epoch not in failures:
                failures[epoch] = spark.read.parquet(f"{path}/_failed/epoch={epoch}").withColumn("epoch", F.lit(epoch))
    parts = [failures[epoch] for epoch in sorted(failures)]
    failed = parts[0]
    for part in parts[1:]:
        failed = failed.unionByName(part)
    return kg, progress, failed
