"""SentencePiece encoding by a single-pass Viterbi over an Aho-Corasick automaton.

The automaton holds the pieces of a public vocabulary file. It reads a text once;
at each position its output links give all pieces that end there, and each of
them relaxes the best score of that position. The path with the greatest sum of
piece scores is traced back. A character that no piece covers gets the score of
the least piece less 10 and becomes its UTF-8 byte pieces, so every text can be
encoded and decoded without loss.

The file holds merge ranks, whose sums mean nothing to a lattice. Scores are
therefore log-probabilities of the pieces: ``piece_scores`` counts, over all
documents, how often the library's own encoder uses each piece (words are counted
in the task, and each distinct word is encoded once; one small aggregate of a row
per piece and task), adds one to each count and takes the logarithm of its share.
As many numbers as the vocabulary has pieces come to the driver and go to tasks.

Spaces become the mark U+2581 and one mark goes before a text, as the library
does with these files. No piece of the vocabulary crosses from a non-space into
a space or holds a line break (checked when the file is read), so the best path
of a text is the sequence of the best paths of its words; words are solved once
per worker and kept in a table of bounded size.

Defined results: a null or empty text has no ids and decodes to the empty text; a
mark U+2581 of the text itself becomes byte pieces and so comes back as it was;
repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter
from itertools import chain

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from kgspark.llm.common import Recent, map_rows, utf8

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
LEFT_OUT = -1e8  # control pieces and runs of marks have scores below this
UNKNOWN_PENALTY = 10.0
LEAST = float("-inf")
KEPT_WORDS = 250_000
KEPT_LENGTH = 64
COUNTED_WORDS = 200_000
KEPT_TEXT = 64 << 20  # characters whose words are counted before they are encoded
RUN = re.compile(r" *[^ \n]+| +|\n+")


class Pieces:
    """Encoder and decoder of one vocabulary file, with the file's own scores or given ones."""

    def __init__(self, path: str, scores: bytes | None = None):
        given = None if scores is None else array("d", scores)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.byte_ids = [0] * 256
        self.out = [b""] * model.get_piece_size()
        self.single: set[str] = set()
        lowest = 0.0
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), model.get_score(i) if given is None else given[i]
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.out[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if re.search(f"[^{MARK}]{MARK}|\n", piece):
                    raise ValueError(f"piece {piece!r} crosses a word boundary")
                self.automaton.add_word(piece, (len(piece), i, score))
                self.out[i] = piece.replace(MARK, " ").encode()
                if len(piece) == 1:
                    self.single.add(piece)
                if score > LEFT_OUT:
                    lowest = min(lowest, score)
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        self.known = Recent(KEPT_WORDS)

    def best_path(self, text: str) -> tuple[bytes, float]:
        """Ids (packed 32-bit) and score of the best path of a text in marks."""
        n = len(text)
        best = [LEAST] * (n + 1)
        back = [None] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(text):
            for end, hit in self.automaton.iter(text):
                end += 1
                total = best[end - hit[0]] + hit[2]
                if total > best[end]:
                    best[end] = total
                    back[end] = hit
        else:
            self._relax_with_gaps(text, best, back)
        ids: list[int] = []
        i = n
        while i:
            length, piece, _ = back[i]
            if piece is None:
                ids.extend(self.byte_ids[b] for b in reversed(text[i - 1].encode()))
            else:
                ids.append(piece)
            i -= length
        ids.reverse()
        return array("I", ids).tobytes(), best[n]

    def _relax_with_gaps(self, text: str, best: list[float], back: list) -> None:
        """As above, for a text with characters that no piece covers."""
        gaps = [i for i, c in enumerate(text) if c not in self.single]
        gap, n_gaps = 0, len(gaps)
        for end, hit in self.automaton.iter(text):
            while gap < n_gaps and gaps[gap] <= end:
                self._relax_unknown(best, back, gaps[gap], self.unknown)
                gap += 1
            end += 1
            total = best[end - hit[0]] + hit[2]
            if total > best[end]:
                best[end] = total
                back[end] = hit
        for i in gaps[gap:]:
            self._relax_unknown(best, back, i, self.unknown)

    @staticmethod
    def _relax_unknown(best: list[float], back: list, i: int, score: float) -> None:
        if best[i] + score > best[i + 1]:
            best[i + 1] = best[i] + score
            back[i + 1] = (1, None, score)

    def _word(self, word: str) -> tuple[bytes, float]:
        found = self.known.old.get(word) or self.best_path(word.replace(" ", MARK))
        if len(word) <= KEPT_LENGTH:
            self.known.young[word] = found
        return found

    def encode(self, text: str) -> tuple[bytes, float]:
        """Packed ids and score of a whole text."""
        if not text:
            return b"", 0.0
        out, scores = [], 0.0
        marks = array("I", (self.byte_ids[b] for b in MARK.encode())).tobytes()
        self.known.turn()
        known = self.known.young.get
        for k, part in enumerate((" " + text).split(MARK)):
            if k:
                out.append(marks)
                scores += len(MARK.encode()) * self.unknown
            for word in RUN.findall(part):
                ids, score = known(word) or self._word(word)
                out.append(ids)
                scores += score
        return b"".join(out), scores

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; the first mark is the one that encoding adds."""
        out = self.out
        return b"".join([out[i] for i in array("I", ids)])[1:].decode()


_open: dict[tuple[str, bytes | None], Pieces] = {}


def pieces_of(path: str, scores: bytes | None = None) -> Pieces:
    """The encoder of a worker process for a file and its scores; the last one is kept."""
    if (path, scores) not in _open:
        _open.clear()
        _open[path, scores] = Pieces(path, scores)
    return _open[path, scores]


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """(piece, n): how often the library's encoder uses each piece in all texts.

    Words stand between spaces and line breaks; a space is part of the word behind it.
    """
    def run(rows):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        used = np.zeros(model.get_piece_size(), np.int64)
        words: Counter = Counter()

        def flush():
            found = model.encode(list(words), num_threads=1)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int64, lengths.sum())
            np.add.at(used, ids, np.repeat(np.fromiter(words.values(), np.int64, len(found)), lengths))
            words.clear()

        held = 0
        for (text,) in rows:
            text = text.decode()
            used[model.piece_to_id("<0x0A>")] += text.count("\n")
            words.update(text.replace("\n", " ").split(" "))
            held += len(text)
            if len(words) >= COUNTED_WORDS or held >= KEPT_TEXT:
                flush()
                held = 0
        flush()
        yield from ((int(i), int(used[i])) for i in used.nonzero()[0])

    counts = map_rows(docs.select(utf8()), run, "piece int, n bigint")
    return counts.groupBy("piece").agg(F.sum("n").alias("n"))


def piece_scores(docs: DataFrame, path: str) -> bytes:
    """Log-probabilities of all pieces of a file, as packed doubles by piece id."""
    size = sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
    counts = {row["piece"]: row["n"] for row in piece_counts(docs, path).collect()}
    total = math.log(sum(counts.values()) + size)
    return array("d", (math.log(counts.get(i, 0) + 1) - total for i in range(size))).tobytes()


def encode(docs: DataFrame, path: str, scores: bytes | None = None) -> DataFrame:
    """(doc_id, n_tokens, score, ids, round_trip): ids of each whole text.

    ``round_trip`` tells whether the ids decode to the text. Without ``scores`` those
    of ``docs`` are counted first, which reads the texts once more.
    """
    scores = piece_scores(docs, path) if scores is None else scores

    def run(rows):
        pieces = pieces_of(path, scores)
        for doc_id, text in rows:
            text = text.decode()
            ids, score = pieces.encode(text)
            yield doc_id, len(ids) // 4, score, array("I", ids).tolist(), pieces.decode(ids) == text

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(
        docs.select("doc_id", utf8()), run,
        f"doc_id {kind}, n_tokens bigint, score double, ids array<int>, round_trip boolean",
    )


def encode_digests(docs: DataFrame, path: str, scores: bytes | None = None) -> DataFrame:
    """(doc_id, n_tokens, score, ids_crc32, decoded_sha256, round_trip), without the ids."""
    scores = piece_scores(docs, path) if scores is None else scores

    def run(rows):
        pieces = pieces_of(path, scores)
        for doc_id, text in rows:
            ids, score = pieces.encode(text.decode())
            back = pieces.decode(ids).encode()
            yield doc_id, len(ids) // 4, score, zlib.crc32(ids), hashlib.sha256(back).hexdigest(), back == text

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(
        docs.select("doc_id", utf8()), run,
        f"doc_id {kind}, n_tokens bigint, score double, ids_crc32 bigint, decoded_sha256 string, round_trip boolean",
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of a table with doc_id and ids; null ids give the empty text."""
    def run(rows):
        pieces = pieces_of(path)
        for doc_id, ids in rows:
            yield doc_id, pieces.decode(array("I", ids or ()).tobytes())

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_rows(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")
