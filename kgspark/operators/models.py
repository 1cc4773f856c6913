"""Calling a model on a table: render, map, parse, validate, retry.

The model is any user function on pandas batches: a remote service, a rule
engine, a table of stored replies. Spark partitions the requests and runs one
function per partition; failed rows, and only these, are sent again.
"""

from __future__ import annotations

import heapq
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from kgspark.operators.triples import SPO
from kgspark.rows import over_rows
from kgspark.skew import DEFAULT_SKEW, NO_HOT_KEYS, SkewPolicy, hot_keys, lookup_join, too_small
from kgspark.storage import Scratch

# Retry budget of a model call.
TRIES = 25
DELAY = 0.5
BACKOFF = 2.0
MAX_DELAY = 15.0
JITTER = 0.1

BatchFunction = Callable[[pd.DataFrame], pd.Series]


def render_requests(
    df: DataFrame, instruction: str, payload: list[str], request_id: str = "request_id",
    fixed: dict[str, str] | None = None,
) -> DataFrame:
    """(request_id, request): JSON of the instruction and the payload columns.

    ``fixed`` adds the same values to every request, such as an ontology as JSON.
    """
    parts = [F.lit(instruction).alias("instruction")]
    parts += [F.lit(value).alias(name) for name, value in (fixed or {}).items()]
    parts += [F.col(c) for c in payload]
    return df.select(F.col(request_id).cast("long").alias("request_id"), F.to_json(F.struct(*parts)).alias("request"))


def mentioned_state(
    chunks: DataFrame, kg: DataFrame, chunk_id: str, text: str, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """(chunk_id, subject, predicate, object): known triples of entities a chunk names.

    The prior state of a request is limited to entities whose id is a word of
    the chunk; a lookup by word instead of sending the whole graph each time. A word
    of very many chunks is split by chunk, and its triples go to each part; as a chunk
    has a word once, there is none in a small table of chunks.
    """
    def words(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col(chunk_id), F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{Nd}_]+"))).alias("subject")
        )

    if too_small(chunks, policy):
        hot = NO_HOT_KEYS
    else:
        # Chunks are sampled before they are cut into words; shares scale to all chunks.
        part = replace(policy, sample=1.0, min_rows=max(1, int(policy.min_rows * policy.sample)),
                       rows_per_split=max(1, int(policy.rows_per_split * policy.sample)))
        hot = hot_keys(words(chunks.sample(fraction=policy.sample, seed=7) if policy.sample < 1.0 else chunks), "subject", part)
    return lookup_join(words(chunks), kg.select(*SPO), "subject", "inner", hot=hot).select(chunk_id, *SPO)


def map_model(
    df: DataFrame, make: Callable[[], BatchFunction], output: str = "response"
) -> DataFrame:
    """Add a string column computed by a user function on pandas batches.

    ``make`` runs once per partition and returns the function, so that a client
    or a loaded model is shared by all batches of the partition.
    """
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for batch in batches:
            yield batch.assign(**{output: call(batch).astype("object")})[[*columns, output]]

    schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType())])
    return df.mapInPandas(run, schema)


def parse_response(df: DataFrame, schema: str, response: str = "response", out: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """(parsed, quarantine): typed replies, and those that do not fit the schema.

    ``schema`` is a struct or array type. A broken list parses as null; a broken
    object is told by its corrupt-record field.
    """
    if not schema.startswith("struct<"):
        parsed = df.withColumn(out, F.from_json(response, schema))
        return parsed.where(F.col(out).isNotNull()), parsed.where(F.col(out).isNull()).drop(out)
    marked = f"{schema[:-1]},_corrupt_record:string>"
    value = F.from_json(response, marked, {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = df.withColumn(out, value)
    good = F.coalesce(F.col(out).isNotNull() & F.col(f"{out}._corrupt_record").isNull(), F.lit(False))
    return (
        parsed.where(good).withColumn(out, F.col(out).dropFields("_corrupt_record")),
        parsed.where(~good).drop(out),
    )


def validate_and_retry(
    requests: DataFrame,
    make: Callable[[], BatchFunction],
    check: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    tries: int = TRIES,
    delay: float = DELAY,
    backoff: float = BACKOFF,
    max_delay: float = MAX_DELAY,
    jitter: float = JITTER,
    sleep: Callable[[float], None] = time.sleep,
) -> tuple[DataFrame, DataFrame]:
    """(answered, failed): call a model, re-run rows that fail their check.

    ``requests`` (request_id, request). ``check`` maps (request_id, response) to
    (request_id, errors) for the rows at fault. A row that failed is sent again
    with its error text and attempt number, after a growing pause. Each attempt
    is one table, so a lost executor never repeats calls that were answered.
    """
    pending = requests.select(
        "request_id", "request", F.lit(1).alias("attempt"), F.lit(None).cast("string").alias("errors")
    )
    done: list[DataFrame] = []
    pause = delay
    failed = None
    for attempt in range(1, tries + 1):
        replies = scratch.save(map_model(pending, make), "replies")
        faults = scratch.save(
            check(replies.select("request_id", "response")).select("request_id", F.col("errors").alias("fault")),
            "faults",
        )
        done.append(replies.join(faults, "request_id", "left_anti").select(
            "request_id", "request", "response", "attempt"
        ))
        failed = replies.join(faults, "request_id").select(
            "request_id", "request", "response", "attempt", F.col("fault").alias("errors")
        )
        if faults.isEmpty():
            break
        if attempt < tries:
            pending = failed.select(
                "request_id", "request", (F.col("attempt") + 1).alias("attempt"), "errors"
            )
            if pause > 0:
                sleep(min(pause, max_delay) + random.uniform(0, jitter))
            pause *= backoff
    answered = done[0]
    for part in done[1:]:
        answered = answered.unionByName(part)
    return answered, failed


# Rows of a task that wait for their next try; no new row is read while there are more.
MAX_WAITING = 1024


def queue_calls(
    requests: DataFrame,
    make: Callable[[], Callable[[int, str, int, str | None], str]],
    scratch: Scratch,
    check: Callable[[str, str], str | None] | None = None,
    in_flight: int = 8,
    tries: int = TRIES,
    delay: float = DELAY,
    backoff: float = BACKOFF,
    max_delay: float = MAX_DELAY,
    jitter: float = JITTER,
) -> tuple[DataFrame, DataFrame]:
    """(answered, failed): calls that may fail, each row with tries and pauses of its own.

    For a model behind a network, whose replies can be judged one by one; a check that
    needs joins goes to ``validate_and_retry``. ``make`` runs once per task and gives
    ``call(request_id, request, attempt, errors)``, which threads share; an exception, or
    a text from ``check(request, response)``, is the fault that the next try is told. A
    task keeps its rows in a queue by the time of their next try and has at most
    ``in_flight`` calls open, so a slow or failing row holds up no other. Rows are read
    only as calls end: memory is bounded by the queue. All outcomes are written once; a
    lost executor repeats the calls of its unfinished tasks only.

    Both tables have (request_id, request, response, attempt, errors). The response of a
    failed row is the last reply, null if the last call raised; a null reply is a reply.
    """
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        call = make()
        waiting: list[tuple] = []  # (time of the next try, number, request_id, request, attempt, errors)
        flying = {}
        source, more, number = iter(rows), True, 0

        def one(request_id, request, attempt, errors):
            try:
                reply = call(request_id, request, attempt, errors)
                return reply, check(request, reply) if check else None
            except Exception as error:  # a call may fail in any way; the next try is told how
                return None, f"{type(error).__name__}: {error}"

        with ThreadPoolExecutor(in_flight) as pool:
            while more or waiting or flying:
                now = time.monotonic()
                while len(flying) < in_flight:
                    if waiting and waiting[0][0] <= now:
                        state = heapq.heappop(waiting)[2:]
                    elif more and len(waiting) < MAX_WAITING:
                        row = next(source, None)
                        if row is None:
                            more = False
                            continue
                        state = (*row, 1, None)
                    else:
                        break
                    flying[pool.submit(one, *state)] = state
                due = max(0.0, waiting[0][0] - now) if waiting else None
                if not flying:
                    time.sleep(due or 0.0)
                    continue
                # With all slots taken only the end of a call lets another one start.
                done, _ = wait(flying, due if len(flying) < in_flight else None, FIRST_COMPLETED)
                for future in done:
                    request_id, request, attempt, _ = flying.pop(future)
                    reply, fault = future.result()
                    if fault is None or attempt >= tries:
                        yield request_id, request, reply, attempt, fault
                        continue
                    pause = min(delay * backoff ** (attempt - 1), max_delay) + random.uniform(0, jitter)
                    number += 1
                    heapq.heappush(
                        waiting, (time.monotonic() + pause, number, request_id, request, attempt + 1, fault)
                    )

    outcomes = scratch.save(over_rows(
        requests.select(F.col("request_id").cast("long").alias("request_id"), "request"), run,
        "request_id bigint, request string, response string, attempt int, errors string",
    ), "calls")
    return outcomes.where("errors is null"), outcomes.where("errors is not null")


def reply_errors(judged: DataFrame) -> DataFrame:
    """(request_id, errors): the messages of each rejected reply as one text.

    ``judged`` has (batch_id, seq, message), one batch per reply, so a group is
    as large as one reply.
    """
    return judged.groupBy(F.col("batch_id").alias("request_id")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]), "\n- "
        ).alias("errors")
    )
