"""Best-fit packing of documents into sequences of bounded length.

Lengths are counted first; best fit, longest pieces first, then runs over the counts
instead of the documents, and pieces take the planned slots by their rank within
their length. The plan does not grow with the corpus: each length closes or splits a
few runs of equal sequences, and a run is visited again only by lengths at most half
the last remainder, so ``capacity`` 2048 gives at most some 70,000 plan rows.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purchase_insights.llm.sampling import in_batches
from purchase_insights.sources.scratch import materialize

CACHED_WORDS = 500_000
LONGEST_CACHED = 64
ENCODED_AT_ONCE = 2000
DOCUMENTS_AT_ONCE = 200
#: Bytes of a text with A to Z in lower case and blanks for line breaks; the tokenizer lowers all letters.
LOWERED = bytes(32 if byte == 10 else byte + 32 if 65 <= byte <= 90 else byte for byte in range(256))
#: A mark before a comma or stop that ends a word. A dotted capital I ends with one when it is lowered.
MARK_AFTER_MARK = re.compile(r"(?:[^\w\s]|[_\u0130])[,.] ")


class Run(NamedTuple):
    """Pieces of one length, by rank, in consecutive sequences."""

    length: int
    first_rank: int
    n_pieces: int
    first_sequence: int
    per_sequence: int
    offset: int


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit-decreasing over a histogram of lengths (1 to ``capacity``).

    Sequences with the same contents are kept as ranges by the room they have left.
    A sequence that takes one piece and still has room is the tightest for the next
    of that length, so a range takes ``room // length`` pieces per sequence at once.
    """
    runs: list[Run] = []
    ranges: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, number)]
    rooms: list[int] = []  # keys of ranges, sorted
    next_sequence = 0

    def keep(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first, number = capacity, next_sequence, -(-left // (capacity // length))
                next_sequence += number
            each = room // length
            filled = min(number, left // each)
            if filled:
                runs.append(Run(length, rank, filled * each, first, each, capacity - room))
                keep(room - each * length, first, filled)
                rank, left = rank + filled * each, left - filled * each
            if filled < number and left:  # fewer pieces are left than the next sequence has room for
                runs.append(Run(length, rank, left, first + filled, left, capacity - room))
                keep(room - left * length, first + filled, 1)
                filled, left = filled + 1, 0
            keep(room, first + filled, number - filled)
    return runs


class _WordIds(dict):
    """Token ids of a word as little-endian bytes. Of two generations of words the older goes when the newer is full."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.older = Tokenizer.from_file(tokenizer_path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, words: set[str]) -> None:
        """Look up the new words, many in a call.

        Words of letters are one token sequence each that ends with a token that ends
        words, so they are encoded as a text; others, and those of a text whose words don't
        come out one by one so, are encoded as texts of their own.
        """
        older = self.older
        new = [w for w in words if w not in self and w not in older and len(w) <= LONGEST_CACHED]
        plain = [w for w in new if w.isalpha()]
        others = [w for w in new if not w.isalpha()]
        for start in range(0, len(plain), ENCODED_AT_ONCE):
            some = plain[start : start + ENCODED_AT_ONCE]
            ids = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            ids = np.array(ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                content, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
                self._make_room()
                self.update((word, content[bounds[i] : bounds[i + 1]]) for i, word in enumerate(some))
            else:
                others += some
        for start in range(0, len(others), ENCODED_AT_ONCE):
            some = others[start : start + ENCODED_AT_ONCE]
            encoded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self._make_room()
            self.update((word, np.array(e.ids, "<u4").tobytes()) for word, e in zip(some, encoded))

    def _make_room(self) -> None:
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST_CACHED:
            self._make_room()
            self[word] = ids
        return ids


#: The words that a worker process knows, by tokenizer: kept from task to task.
_known: dict[str, _WordIds] = {}


def _word_ids(tokenizer_path: str) -> _WordIds:
    if tokenizer_path not in _known:
        _known[tokenizer_path] = _WordIds(tokenizer_path)
    return _known[tokenizer_path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 (and ids).

    A document's ids are those of its text (a missing one is empty) and ``end_id``.
    Only documents longer than ``capacity`` are cut. The tokenizer's pattern and
    normalisation never reach across a blank or a line break, so words are encoded
    one by one and common ones are remembered.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = _word_ids(tokenizer_path)
        for batch in batches:
            out: dict[str, list] = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for row, words in enumerate(_words(batch, known)):
                ids = b"".join(map(known.__getitem__, words)) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out["row"].append(row)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = {
                "doc_id": batch["doc_id"].take(pa.array(out["row"], pa.int64())),
                "piece": pa.array(out["piece"], pa.int32()),
                **{name: pa.array(out[name], pa.int64()) for name in ("start", "length", "ids_crc32")},
            }
            if keep_ids:
                columns["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return in_batches(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        cut, schema + (", ids array<int>" if keep_ids else "")
    )


def _split(text: str) -> list[str]:
    """What is encoded by itself: what stands between blanks and line breaks, letters in lower case.

    A comma or stop that ends a word is apart too, unless another mark stands before one
    anywhere: marks that follow each other belong together.
    """
    if "<|" in text:  # perhaps a special token, in the case it is written in
        return text.replace("\n", " ").split(" ")
    text = text.encode().translate(LOWERED).decode() + " "
    if not MARK_AFTER_MARK.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


def _words(batch: pa.RecordBatch, known: _WordIds) -> Iterator[list[str]]:
    """What each text is split to; the words are made known first."""
    for start in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
        split = [_split(text or "") for text in batch["text"].slice(start, DOCUMENTS_AT_ONCE).to_pylist()]
        known.learn(set().union(*split))
        yield from split


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """One row per piece of each document, with its sequence and its place there.

    Columns: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.
    ``docs`` has doc_id and text; others are ignored. A missing text is empty and
    gives a piece of ``end_id`` alone; repeated rows and missing ids are packed like
    any others; no documents give no rows. Places in a sequence are gapless from 0.

    Pieces are written once to the shared folder with the part of the input that
    they come from. Ranks within a length are counted within each part and shifted
    by the counts of earlier parts, so a common length never meets in one task.
    """
    spark = docs.sparkSession
    found = pieces(docs, tokenizer_path, capacity, end_id, keep_ids)
    found = materialize(found.withColumn("part", F.spark_partition_id()), "pieces")
    counts = materialize(found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_best_fit(histogram, capacity)  # at most one count per length from 1 to capacity

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece")
    ranked = found.withColumn("rank", F.row_number().over(within) - 1).join(shifts, ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("shift"))
    planned = spark.createDataFrame(
        plan,
        "of_length bigint, first_rank bigint, n_pieces bigint, first_sequence bigint, per_sequence bigint, base bigint",
    )
    place = F.col("rank") - F.col("first_rank")
    in_run = (F.col("length") == F.col("of_length")) & (place >= 0) & (place < F.col("n_pieces"))
    return ranked.join(F.broadcast(planned), in_run).select(
        *(c for c in found.columns if c != "part"),
        (F.col("first_sequence") + F.floor(place / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("base") + place % F.col("per_sequence") * F.col("length")).alias("offset"),
    )
