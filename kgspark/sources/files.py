"""Text folders, ontology and graph documents, stage tables, exports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kgspark import schemas
from kgspark.operators.ontology import Ontology
from kgspark.operators.triples import SPO, to_digraph_edges
from kgspark.rows import over_rows
from kgspark.skew import dense_index
from kgspark.storage import Scratch, hadoop_path, local_table, path_exists, shuffles_freed

# File suffixes that count as text sources.
TEXT_SUFFIXES = [
    ".txt", ".md", ".rst",
    ".py", ".java", ".js", ".ts", ".c", ".cpp", ".h", ".cs", ".go", ".rb", ".php",
    ".html", ".css", ".json", ".xml", ".yml", ".yaml", ".toml",
    ".csv", ".tsv",
]
# Supported by name, but they need a decoder that the user brings.
BINARY_SUFFIXES = [".pdf", ".docx", ".doc", ".rtf", ".odt"]
MAX_PROBLEM = 200  # characters of an error message


def _suffix(path):
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def scan_text_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents (path, text), skipped (path)): a folder tree, one row per file.

    Files with an unknown suffix are left out; those that need a decoder are
    listed in ``skipped``. Spark does not list files of length 0: an empty file
    gives no row, which is what dropping empty documents would do to it.
    """
    texts = (
        spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        .where(_suffix(F.col("path")).isin(TEXT_SUFFIXES))
    )
    # Only names are read here, the content column is pruned.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return texts, listed.where(_suffix(F.col("path")).isin(BINARY_SUFFIXES))


def _utf8(content: bytes) -> str:
    return content.decode("utf-8")


# A file is one row, and a row's text has to fit into an Arrow batch.
MAX_FILE_BYTES = 1 << 30


def decode_files(
    spark: SparkSession, folder: str, scratch: Scratch,
    decoders: dict[str, Callable[[bytes], str | None]] | None = None, max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """(path, text, problem): a folder tree, one row per file with a known suffix.

    ``decoders`` maps a suffix in lower case to a function from a file's bytes to its
    text; suffixes of texts are UTF-8 unless given, further suffixes become known by
    being given. Files are dealt to tasks by size and decoded there. A file that gives
    no text stays in the table, with an empty text and its ``problem``: ``no decoder``,
    ``too long`` (more than ``max_bytes``; ``read_lines`` has no such limit),
    ``unreadable`` (the file system fails on it or it went away), or the class and
    message of the decoder's error. A decoder's None is an empty text. An empty file
    gives no row, as Spark lists none.
    """
    known = {**dict.fromkeys(TEXT_SUFFIXES, _utf8), **(decoders or {})}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    # Names and lengths come from the listing; no file is opened for them.
    listed = files.load(folder).select("path", "length").withColumn("suffix", _suffix(F.col("path"))).where(
        F.col("suffix").isin(sorted(set(known) | set(BINARY_SUFFIXES)))
    )

    def decode(rows):
        for path, suffix, content in rows:
            try:
                yield path, known[suffix](content or b"") or "", None
            except Exception as error:  # any decoder may fail in any way; the row tells how
                yield path, "", f"{type(error).__name__}: {error}"[:MAX_PROBLEM]

    contents = files.option("ignoreCorruptFiles", True).load(folder).where(F.col("length") <= max_bytes).select(
        "path", _suffix(F.col("path")).alias("suffix"), "content"
    ).where(F.col("suffix").isin(sorted(known)))
    read = scratch.save(over_rows(contents, decode, "path string, text string, problem string"), "decoded")
    rest = listed.join(read.select("path"), "path", "left_anti").select(
        "path", F.lit("").alias("text"),
        F.when(~F.col("suffix").isin(sorted(known)), "no decoder")
        .when(F.col("length") > max_bytes, "too long").otherwise("unreadable").alias("problem"),
    )
    return read.unionByName(rest)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line, after_end) of line files.

    A final line break gives one more, empty line, marked ``after_end``, as does an
    empty file; without that row the lines do not depend on the number of files.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.split("value", "\n", -1).alias("lines")
    )
    lines = files.select("path", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    return lines.select(
        "path", "pos", "line", ((F.col("pos") == F.col("n") - 1) & (F.col("line") == "")).alias("after_end")
    )


def write_lines(df: DataFrame, text: str, path: str, order: list | None = None) -> None:
    """One line per row; with ``order`` the files, read by name, are in order."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.select(text).write.text(path)


# ---------------------------------------------------------------- documents

def _json_documents(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """Parsed documents with ``_corrupt_record``; bytes that are no UTF-8 are dropped."""
    value = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    raw = spark.read.text(path, wholetext=not lines).where("trim(value) != ''")
    return raw.select(F.from_json(value, schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record",
    }).alias("d"), value.alias("raw")).select("d.*", "raw").withColumn(
        "_corrupt_record", F.when(F.col("_corrupt_record").isNotNull() | F.col("name").isNull(), F.col("raw"))
    ).drop("raw")


def read_ontology(spark: SparkSession, path: str, lines: bool = False) -> tuple[Ontology, DataFrame]:
    """(ontology, unreadable): an ontology as four tables.

    One document per file, or with ``lines`` one per line, as ``write_ontology``
    gives them. ``seq`` is the place in the document, after the line's own one.
    """
    docs = _json_documents(spark, path, "seq bigint, " + schemas.ONTOLOGY_JSON, lines=lines)
    good = docs.where("_corrupt_record is null")

    def rows(column: str) -> DataFrame:
        return good.select("seq", F.posexplode(column).alias("pos", "r")).select(
            "r.*", (F.coalesce("seq", F.lit(0)) + F.col("pos")).cast("long").alias("seq")
        )

    first = good.select("name").first()
    onto = Ontology(
        first["name"] if first else "ontology",
        rows("classes"), rows("subclass_relations"), rows("object_properties"), rows("data_properties"),
    )
    return onto, docs.where("_corrupt_record is not null").select("_corrupt_record")


# Field of an ontology document and attribute of the ontology it holds.
SECTIONS = {
    "classes": "classes", "subclass_relations": "subclass_of",
    "object_properties": "object_properties", "data_properties": "data_properties",
}


def write_ontology(onto: Ontology, path: str) -> None:
    """JSON lines, one small document per concept, with its place; of any size.

    Every line is an ontology document of one concept, so a reader of documents
    can read each line by itself.
    """
    lines = None
    for section, attribute in SECTIONS.items():
        table = getattr(onto, attribute)
        fields = F.struct(*[c for c in table.columns if c != "seq"])
        line = F.to_json(
            F.struct(F.lit(onto.name).alias("name"), F.col("seq"), F.array(fields).alias(section)),
            {"ignoreNullFields": "false"},
        )
        part = table.select(line.alias("value"))
        lines = part if lines is None else lines.unionAll(part)
    spark = onto.classes.sparkSession
    head = spark.range(1).select(F.to_json(F.struct(F.lit(onto.name).alias("name"))).alias("value"))
    lines.unionAll(head).write.text(path)


def write_ontology_document(onto: Ontology, path: str) -> None:
    """One JSON document, as other programs exchange it: the only file of the folder ``path``.

    No row holds more than one concept, so an ontology may be of any size. Each concept
    is a line, in the order of its section, then ``seq``, then JSON; the lines are
    written as range-sorted part files, which ``join_parts`` makes one file.
    """
    spark = onto.classes.sparkSession
    # Rows of the document: an opening for each section, its items, and the end.
    openings = [f'"{section}": [' for section in SECTIONS]
    openings = [f'{{"name": {json.dumps(onto.name)}, {openings[0]}'] + [f"], {o}" for o in openings[1:]] + ["]}"]
    rows = local_table(
        spark, [(place, True, None, text) for place, text in enumerate(openings)],
        "place int, opens boolean, at long, line string",
    )
    for place, attribute in enumerate(SECTIONS.values()):
        table = getattr(onto, attribute)
        item = F.to_json(F.struct(*[c for c in table.columns if c != "seq"]), {"ignoreNullFields": "false"})
        rows = rows.unionByName(table.select(
            F.lit(place).alias("place"), F.lit(False).alias("opens"), F.col("seq").alias("at"), item.alias("line")
        ))
    with Scratch(spark) as scratch:
        order = [F.asc("place"), F.desc("opens"), F.asc("at"), F.asc("line")]
        numbered = scratch.save(dense_index(rows, order, "number", scratch), "lines")
        # Five rows; the line behind an opening has no comma before it.
        firsts = [r["number"] + 1 for r in numbered.where("opens").select("number").collect()]
        comma = F.when(F.col("opens") | F.col("number").isin(firsts), "").otherwise(",")
        parts = scratch.new_path("parts")
        write_lines(numbered.withColumn("line", F.concat(comma, "line")), "line", parts, [F.col("number")])
        join_parts(spark, parts, f"{path}/part-00000.json")


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a folder, in order, as one file, which gets its name when it is whole.

    A file system that can concatenate files (HDFS) moves no bytes; elsewhere they
    pass through a buffer of a megabyte.
    """
    fs, source = hadoop_path(spark, folder)
    target_fs, target = hadoop_path(spark, path)
    _, unfinished = hadoop_path(spark, f"{path}.unfinished")
    names = [s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")]
    # More than 99,999 parts have longer numbers, which names do not sort by.
    names.sort(key=lambda p: (int(p.getName().split("-")[1].split(".")[0]), p.getName()))
    target_fs.mkdirs(target.getParent())
    jvm = spark.sparkContext._jvm
    if names and fs.getUri().toString() == target_fs.getUri().toString() and fs.getScheme() == "hdfs":
        rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(names) - 1)
        for i, name in enumerate(names[1:]):
            rest[i] = name
        if len(rest):
            fs.concat(names[0], rest)
        fs.rename(names[0], unfinished)
    else:
        out = target_fs.create(unfinished, True)
        try:
            for name in names:
                part = fs.open(name)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
        finally:
            out.close()
    target_fs.delete(target, False)
    if not target_fs.rename(unfinished, target):
        raise OSError(f"cannot rename {unfinished} to {target}")


def write_ontology_tables(onto: Ontology, path: str) -> None:
    for name in ("classes", "subclass_of", "object_properties", "data_properties"):
        getattr(onto, name).write.parquet(f"{path}/{name}")


def read_kg(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(triples with kg_name, batch_id, seq; unreadable): graph documents of a path.

    A document without triples, or with null for them, gives no rows. A graph may
    be spread over any number of documents: one per file, or one per line, which
    Spark splits over tasks.
    """
    docs = _json_documents(spark, path, schemas.KG_JSON, lines)
    good = docs.where("_corrupt_record is null")
    triples = good.select("name", F.posexplode("triplets").alias("seq", "t")).select(
        F.col("name").alias("kg_name"), "t.subject", "t.predicate", "t.object",
        F.lit(0).cast("long").alias("batch_id"), F.col("seq").cast("long").alias("seq"),
    )
    return triples, docs.where("_corrupt_record is not null").select("_corrupt_record")


def write_kg(triples: DataFrame, name: str, path: str) -> None:
    """The graph as a parquet table, split by graph name."""
    triples.withColumn("kg_name", F.lit(name)).write.partitionBy("kg_name").parquet(path)


def write_kg_lines(triples: DataFrame, name: str, path: str, rows_per_document: int = 10_000) -> None:
    """JSON lines for exchange, compressed: documents of about ``rows_per_document`` triples.

    Copies of a triple are in one document, so its set merges them, and rows are shuffled once.
    """
    total = triples.count()
    documents = max(1, -(-total // rows_per_document))
    bucket = F.pmod(F.xxhash64(*SPO), F.lit(documents)).alias("bucket")
    lists = triples.select(F.struct(*SPO).alias("t"), bucket).groupBy("bucket").agg(
        F.sort_array(F.collect_set("t")).alias("triplets")
    )
    with shuffles_freed(triples.sparkSession):
        lists.select(F.to_json(F.struct(F.lit(name).alias("name"), "triplets"))).write.option("compression", "gzip").text(path)


# ------------------------------------------------------------------ exports

def graph_stats(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, nodes, edges) of the digraph with one edge per ordered pair."""
    edges = _digraph(triples)
    nodes = _ends(edges)
    return _sizes(nodes, edges), nodes, edges


def _digraph(triples: DataFrame) -> DataFrame:
    return to_digraph_edges(triples).select("source", "target", F.coalesce("label", F.lit("")).alias("label"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def _sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("edges_count")).select(
        nodes.agg(F.count(F.lit(1))).scalar().alias("nodes_count"), "edges_count"
    )


def _written(df: DataFrame, path: str) -> DataFrame:
    """Write JSON lines, compressed, and read them back, so that what is made from them does not compute them again."""
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "gzip").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_graph_stats(triples: DataFrame, path: str) -> None:
    edges = _written(_digraph(triples), f"{path}/edges")
    nodes = _written(_ends(edges), f"{path}/nodes")
    _sizes(nodes, edges).write.json(f"{path}/counts")


def write_node_link(triples: DataFrame, path: str) -> None:
    """Node-link tables as JSON lines: head with the flags, nodes, links."""
    spark = triples.sparkSession
    spark.range(1).select(
        F.lit(True).alias("directed"), F.lit(False).alias("multigraph")
    ).write.json(f"{path}/head")
    edges = _written(_digraph(triples), f"{path}/links")
    _written(_ends(edges).select(F.col("node").alias("id")), f"{path}/nodes")


def write_op_history(
    onto: Ontology, relations_by_cluster: DataFrame, history: DataFrame, path: str
) -> None:
    """Original ontology and clusters as tables, and the ordered operations."""
    write_ontology_tables(onto, f"{path}/original_ontology")
    relations_by_cluster.write.parquet(f"{path}/original_clusters")
    history.write.parquet(f"{path}/history")


def write_partial(batch: DataFrame, batch_id: int, path: str) -> None:
    """Publish one batch of a table; writing the same batch again replaces it."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={batch_id}")


# ------------------------------------------------------------------- stages

def input_fingerprint(*inputs: DataFrame) -> str:
    """Hash of the files behind the inputs: path, size and time of change."""
    parts = []
    for df in inputs:
        files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        row = files.distinct().agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time")).alias("h"),
        ).first()
        parts.append(f"{row['n']}-{(row['h'] or 0) & ((1 << 64) - 1):016x}")
    return "_".join(parts)


def stage(
    spark: SparkSession, root: str, name: str, fingerprint: str, compute: Callable[[], DataFrame]
) -> tuple[DataFrame, bool]:
    """(table, reused): load a finished stage, else compute, store and load it.

    A stage is finished if its success marker is there. It belongs to the
    fingerprint of its inputs, so changed inputs are computed anew.
    """
    path = f"{root}/{name}/{fingerprint}"
    reused = path_exists(spark, f"{path}/_SUCCESS")
    if not reused:
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), reused
