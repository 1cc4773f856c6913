"""Token ids of documents in shard files with a minimal perfect hash index.

Documents are range-partitioned by id; each task encodes its range in order and
writes one shard:

    <shard>.ids   ids of all its documents, little endian, 2 bytes each (4 if the
                  vocabulary or the end id needs them), nothing else
    <shard>.idx   an index: for each distinct key the first record with this key,
                  found through a minimal perfect hash, and the records' offsets

The hash is built in levels: each level gives every remaining key a bit of an
array twice as long as there are keys; keys alone at their bit are done, the
others go to the next level. The number of set bits before a key's bit is its
slot, so n keys have slots 0 to n - 1. A slot stores a 32-bit fingerprint of its
key, which tells keys that are not there, and the record number; a record stores
the offset of its ids. A look-up touches one bit per level and one slot.

A manifest row per shard (written as a table) has the file names, the least and
greatest key and the counts. File names carry a random part, and only the rows of
tasks that succeeded reach the manifest, so tasks can be run again at any time;
files of lost attempts are never read. Files are written through Arrow's file
systems, so the folder may be a local shared one or a remote store.

Defined results: a null text is empty and has the end id alone; a null id is a key
of its own and comes first; documents of equal id are ordered by text and found
together, also across shards; an empty table has no shards.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from kgspark.llm.common import map_rows, shuffle_partitions
from kgspark.storage import Scratch, local_table

END_ID = 2
KEPT_WORDS = 400_000
KEPT_LENGTH = 64
MARKS = frozenset(".,:;!?")
TWO_SPACES = re.compile(r"\s\s")
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
GAMMA = 2
NO_KEY = b"\x00null"

MANIFEST = (
    "shard string, low binary, high binary, n_docs bigint, n_ids bigint, width int"
)


# ------------------------------------------------------------------ encoding

class _Known(dict):
    """Ids of pieces seen lately, at most twice ``size``: a full table becomes the old one, and
    pieces that are asked for again move to the new one. Unknown ones are made when asked for."""

    def __init__(self, size: int, make):
        super().__init__()
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """The library's ids of whole texts, with a table of words seen before.

    The vocabulary's pattern never crosses a single space between two non-space
    characters, other than by starting there; so a text is cut before such
    spaces, and each piece has the ids it has within the text. Pieces that are
    not in the table are encoded by the library.
    """

    def __init__(self, path: str, width: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = {2: "H", 4: "I"}[width]
        self.first = _Known(KEPT_WORDS, lambda piece: self._ids(piece, ""))
        self.later = _Known(KEPT_WORDS, lambda piece: self._ids(piece, " "))
        self.marks: dict[str, bytes] = {}

    def _ids(self, piece: str, before: str) -> bytes:
        if piece.isalpha():
            return self._letters(before, piece)
        if piece[-1:] in MARKS and piece[:-1].isalpha():
            # The pattern ends a run of letters before a mark: two parts, each with ids of its own.
            return (self.later if before else self.first)[piece[:-1]] + self._mark(piece[-1])
        return array(self.code, self.tokenizer.encode(before + piece, add_special_tokens=False).ids).tobytes()

    def _letters(self, before: str, word: str) -> bytes:
        """Ids of letters after at most one space: one match of the pattern, so the model alone decides."""
        if word.isascii():  # letters of one byte are written as they are
            text = SPACE_SIGN + word if before else word
        else:
            text = (before + word).encode().decode("latin-1").translate(BYTE_SIGNS)
        return array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            text = mark.encode().decode("latin-1").translate(BYTE_SIGNS)
            self.marks[mark] = array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()
        return self.marks[mark]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or TWO_SPACES.search(text):
            lines = [BETWEEN_WORDS.split(text)]
        else:
            # A line break between two non-space characters is a match of its own.
            lines = [line.split(" ") for line in text.split("\n")]
        first, later, line_end = self.first, self.later, self._mark("\n")
        out = []
        for pieces in lines:
            out.append(first[pieces[0]] if pieces[0] else b"")
            out += [later[p] for p in pieces[1:]]
            out.append(line_end)
        out.pop()
        return b"".join(out)


def _byte_signs() -> dict[int, str]:
    """The sign by which byte-level vocabularies write each byte: printable ones as they are, the
    others, in order, from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_SIGNS = _byte_signs()
SPACE_SIGN = BYTE_SIGNS[ord(" ")]

_open: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    if (path, width) not in _open:
        _open[path, width] = Encoder(path, width)
    return _open[path, width]


def id_width(path: str, end_id: int) -> int:
    """Bytes per id: 2 if all ids fit."""
    return 2 if max(end_id, Tokenizer.from_file(path).get_vocab_size() - 1) < 1 << 16 else 4


# ------------------------------------------------------- minimal perfect hash

def key_bytes(doc_id) -> bytes:
    return NO_KEY if doc_id is None else str(doc_id).encode()


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _at_level(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    x = hashes + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 of n distinct 64-bit key hashes."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # of booleans
        self.before, n = [], 0
        for bits in levels:
            counts = np.cumsum(bits)
            self.before.append(counts - bits + n)
            n += int(counts[-1])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels = []
        while len(hashes):
            at = _at_level(hashes, len(levels), GAMMA * len(hashes))
            alone = np.bincount(at, minlength=GAMMA * len(hashes)) == 1
            levels.append(alone)
            hashes = hashes[~alone[at]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for some that were not built in."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = _at_level(hashes[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out


# -------------------------------------------------------------------- shards

def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(7)).astype(np.uint32)


class ShardIndex:
    """Index of one shard: records in order, and the slot table over distinct keys."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.keys_blob, self.key_ends = parts["keys"], parts["key_ends"]
        self.offsets, self.records, self.prints = parts["offsets"], parts["records"], parts["prints"]
        self.hash = PerfectHash([
            np.unpackbits(parts[f"level{k}"], count=int(n)).astype(bool) for k, n in enumerate(parts["level_sizes"])
        ])

    @classmethod
    def arrays(cls, keys: list[bytes], offsets: np.ndarray) -> dict[str, np.ndarray]:
        """What is stored. ``keys`` are in order, so equal ones are adjacent."""
        first = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        hashes = _hashes([keys[i] for i in first])
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two keys of a shard have one 64-bit hash")
        perfect = PerfectHash.build(hashes)
        slots = perfect.slots(hashes)
        records, prints = np.zeros(len(first), np.uint32), np.zeros(len(first), np.uint32)
        records[slots], prints[slots] = first, _fingerprints(hashes)
        out = {
            "keys": np.frombuffer(b"".join(keys), np.uint8),
            "key_ends": np.cumsum([len(k) for k in keys], dtype=np.uint64),
            "offsets": offsets.astype(np.uint64), "records": records, "prints": prints,
            "level_sizes": np.array([len(b) for b in perfect.levels], np.uint64),
        }
        return out | {f"level{k}": np.packbits(b) for k, b in enumerate(perfect.levels)}

    @staticmethod
    def pack(parts: dict[str, np.ndarray]) -> bytes:
        """A length, a JSON table of (name, type, bytes), then the arrays."""
        head = json.dumps([(k, v.dtype.str, v.nbytes) for k, v in parts.items()]).encode()
        return struct.pack("<I", len(head)) + head + b"".join(v.tobytes() for v in parts.values())

    @classmethod
    def unpack(cls, blob: bytes) -> ShardIndex:
        n = struct.unpack_from("<I", blob)[0]
        at, parts = 4 + n, {}
        for name, kind, size in json.loads(blob[4:4 + n]):
            parts[name] = np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at)
            at += size
        return cls(parts)

    def keys(self) -> list[bytes]:
        blob, ends = self.keys_blob.tobytes(), self.key_ends.tolist()
        return [blob[a:b] for a, b in zip([0, *ends], ends)]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """First record of each key, -1 if the fingerprint says it is not here."""
        hashes = _hashes(keys)
        slots = self.hash.slots(hashes)
        here = slots >= 0
        here[here] = self.prints[slots[here]] == _fingerprints(hashes[here])
        out = np.full(len(keys), -1, np.int64)
        out[here] = self.records[slots[here]]
        return out


def _write(path: str, name: str, data: Iterator[bytes]) -> None:
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_output_stream(f"{folder}/{name}") as out:
        for part in data:
            out.write(part)


def _read(path: str, name: str, start: int = 0, size: int | None = None) -> bytes:
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{folder}/{name}") as f:
        f.seek(start)
        return f.read(size)


def write_store(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write shards to ``folder`` and the manifest to ``folder/manifest``; returns the manifest."""
    spark = docs.sparkSession
    width = id_width(tokenizer, end_id)
    tail = array({2: "H", 4: "I"}[width], [end_id]).tobytes()
    store, local = fs.FileSystem.from_uri(folder)
    store.create_dir(local)

    def shard(rows):
        enc = encoder(tokenizer, width)
        name = f"shard-{uuid.uuid4().hex}"
        keys, ends = [], []

        def payload():
            total, waiting, size = 0, [], 0
            for doc_id, text in rows:
                ids = enc.encode(text or "") + tail
                total += len(ids)
                keys.append(key_bytes(doc_id))
                ends.append(total // width)
                waiting.append(ids)
                size += len(ids)
                if size > 4 << 20:
                    yield b"".join(waiting)
                    waiting, size = [], 0
            yield b"".join(waiting)

        parts = payload()
        begun = next(parts)
        if not keys:
            return
        _write(folder, f"{name}.ids", _chain(begun, parts))
        _write(folder, f"{name}.idx", iter([ShardIndex.pack(ShardIndex.arrays(keys, np.array([0, *ends])))]))
        yield name, keys[0], keys[-1], len(keys), ends[-1], width

    # Equal ids meet in neighbouring ranges; the text's hash spreads an id that many rows have.
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.asc_nulls_first("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(docs), *order[:2])
    rows = map_rows(ranged.sortWithinPartitions(*order), shard, MANIFEST)
    # The position of a shard is the number of the range it holds.
    placed = rows.withColumn("range", F.spark_partition_id())
    placed.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def read_store(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, from the files.

    Every record is looked up by its key through the perfect hash. The manifest,
    one row per shard, comes to the driver to add up the shards' starts.
    """
    def values(rows):
        for doc_id, start, ids in _records(rows, folder):
            yield doc_id, start, len(ids), ids.tolist()

    return _scan(spark, folder, values, "doc_id string, start bigint, n_tokens bigint, ids array<bigint>").withColumn(
        "doc_id", F.col("doc_id").cast(kind)
    )


def read_digests(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): crc32 of the ids as 32-bit little-endian numbers."""
    def values(rows):
        for doc_id, start, ids in _records(rows, folder):
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    return _scan(spark, folder, values, "doc_id string, start bigint, n_tokens bigint, ids_crc32 bigint").withColumn(
        "doc_id", F.col("doc_id").cast(kind)
    )


def _scan(spark: SparkSession, folder: str, values, schema: str) -> DataFrame:
    shards = spark.read.parquet(f"{folder}/manifest").orderBy("range").select("shard", "n_ids", "width").collect()
    starts, total = [], 0
    for row in shards:
        starts.append((row["shard"], total, row["width"]))
        total += row["n_ids"]
    table = local_table(spark, starts, "shard string, start bigint, width int")
    return map_rows(table.repartition(max(1, len(starts))), values, schema)


def _records(rows, folder: str) -> Iterator[tuple[str | None, int, np.ndarray]]:
    for shard, start, width in rows:
        index = ShardIndex.unpack(_read(folder, f"{shard}.idx"))
        payload = np.frombuffer(_read(folder, f"{shard}.ids"), f"<u{width}")
        keys = index.keys()
        records = index.find(keys)
        for i, key in enumerate(keys):
            # Records of one key are adjacent, the index names the first.
            i = int(records[i]) if not i or key != keys[i - 1] else i
            a, b = int(index.offsets[i]), int(index.offsets[i + 1])
            yield None if key == NO_KEY else key.decode(), start + a, payload[a:b]


def look_up(spark: SparkSession, folder: str, doc_id) -> list[np.ndarray]:
    """Ids of the documents with this key: shards by their key range, then index and a range read."""
    key, out = key_bytes(doc_id), []
    manifest = spark.read.parquet(f"{folder}/manifest")
    for row in manifest.where(_may_hold(doc_id)).orderBy("range").collect():
        index = ShardIndex.unpack(_read(folder, f"{row['shard']}.idx"))
        i = int(index.find([key])[0])
        keys = index.keys() if i >= 0 else []
        while 0 <= i < len(keys) and keys[i] == key:
            a, b, w = int(index.offsets[i]), int(index.offsets[i + 1]), row["width"]
            out.append(np.frombuffer(_read(folder, f"{row['shard']}.ids", a * w, (b - a) * w), f"<u{w}"))
            i += 1
    return out


def _may_hold(doc_id):
    """Shards whose first and last keys enclose the key, as numbers or else as text."""
    if doc_id is None:
        return F.col("low") == F.lit(NO_KEY)
    kind = "decimal(38,0)" if isinstance(doc_id, int) else "string"
    low, high = (F.col(c).cast("string").try_cast(kind) for c in ("low", "high"))
    value = F.lit(str(doc_id)).cast(kind)
    return (low.isNull() | (low <= value)) & (high >= value)


def store(docs: DataFrame, tokenizer: str, scratch: Scratch) -> DataFrame:
    """The registered query: write all documents, read the files back."""
    folder = scratch.new_path("tokens")
    write_store(docs, tokenizer, folder)
    return read_digests(docs.sparkSession, folder, docs.schema["doc_id"].dataType.simpleString())
