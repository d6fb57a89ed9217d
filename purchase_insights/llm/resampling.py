"""Importance resampling towards the distribution of a target.

Word n-grams are hashed to buckets. A bucket's gain compares how common it is in the
target with how common it is in the documents, a document's weight adds up the gains of
its n-grams, and the best of weight plus Gumbel noise are drawn: a sample without
replacement in proportion to the weights' exponentials.

The n-grams of a block of words are interned in an open-addressed NumPy table: xxhash64
keys, verified by the bytes, find each n-gram's slot. The slots hold the bucket, computed
once per different n-gram, and the count; the slot ids of the occurrences gather gains.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchase_insights.llm.sampling import in_batches
from purchase_insights.sources.scratch import materialize

WORDS_AT_ONCE = 1 << 14
PADDING = bytes(32)
#: A word of up to so many bytes is appended to a checksum by look-ups.
SHORT_WORD = 63

# The primes of xxhash64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _folding() -> bytes:
    """Per byte: digits, letters in lower case and all of a character beyond ASCII stay, others become blanks."""
    table = bytearray(b" " * 128) + bytearray(range(128, 256))
    for byte in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[byte] = byte
    for byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[byte] = byte + 32
    return bytes(table)


FOLDING = _folding()


class Words(NamedTuple):
    """The words of a batch of documents: blanks between them, line breaks between documents."""

    text: bytes  # with PADDING
    start: np.ndarray
    end: np.ndarray
    document: np.ndarray
    crc: np.ndarray  # crc32 of each


def words_of(texts: list[bytes | None]) -> Words:
    split = [(t or b"").translate(FOLDING).split() for t in texts]
    text = b"\n".join(map(b" ".join, split)) + b"\n"
    gap = np.frombuffer(text, np.uint8) <= 32
    after_gap = np.concatenate([[True], gap[:-1]])
    start = np.flatnonzero(after_gap & ~gap)
    end = np.flatnonzero(gap & ~after_gap)
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    crc = np.fromiter(map(zlib.crc32, chain.from_iterable(split)), np.uint32, len(start))
    return Words(text + PADDING, start, end, np.searchsorted(breaks, start), crc)


class Grams(NamedTuple):
    """Occurrences of n-grams: where their bytes are, their first word, how many words, and the document."""

    start: np.ndarray
    length: np.ndarray
    first: np.ndarray
    n: np.ndarray
    document: np.ndarray


def grams_of(words: Words, low: int, high: int, longest: int) -> Grams:
    """The n-grams of up to ``longest`` words that begin with word ``low`` to ``high`` - 1."""
    parts = []
    for n in range(1, longest + 1):
        first = np.arange(low, min(high, len(words.start) - n + 1))
        first = first[words.document[first] == words.document[first + n - 1]]
        start = words.start[first]
        parts.append((start, words.end[first + n - 1] - start, first, np.full(len(first), n), words.document[first]))
    return Grams(*map(np.concatenate, zip(*parts)))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _windows(text: bytes) -> np.ndarray:
    """The eight bytes from every position on, as little-endian numbers."""
    return np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))


def xxhash64(text: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of the given parts of ``text``, which ends with ``PADDING``."""
    windows = _windows(text)
    n = length.astype(np.uint64)
    h = n + _P5
    for k in range(int(min(length.max(initial=0), 31)) // 8):
        lane = _rotated(windows[np.minimum(start + 8 * k, len(windows) - 1)] * _P2, 31) * _P1
        h = np.where(length >= 8 * k + 8, _rotated(h ^ lane, 27) * _P1 + _P4, h)
    rest = windows[start + (length & ~7)]
    four = (length & 4) > 0
    h = np.where(four, _rotated(h ^ ((rest & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3, h)
    rest = np.where(four, rest >> np.uint64(32), rest)
    for k in range(3):
        byte = (rest >> np.uint64(8 * k)) & np.uint64(0xFF)
        h = np.where((length & 3) > k, _rotated(h ^ (byte * _P5), 11) * _P1, h)
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(length >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(text[start[i] : start[i] + length[i]])
    return h


def _same_bytes(text: bytes, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the parts of ``length`` bytes from ``a`` and from ``b`` on are equal."""
    windows = _windows(text)
    same = np.ones(len(a), bool)
    active, at = np.flatnonzero(a != b), 0
    while len(active):
        differ = windows[a[active] + at] ^ windows[b[active] + at]
        unused = np.clip(8 - (length[active] - at), 0, 7).astype(np.uint64) * np.uint64(8)
        equal = (differ << unused) == 0
        same[active[~equal]] = False
        at += 8
        active = active[equal & (length[active] > at)]
    return same


def _appending() -> np.ndarray:
    """[n, k, x]: what byte k of a crc32, of value x, becomes when n + 1 zero bytes follow (a blank and n more)."""
    one = np.array([zlib.crc32(bytes([x])) ^ zlib.crc32(b"\0") for x in range(256)], np.uint32)
    found = np.zeros((SHORT_WORD + 1, 4, 256), np.uint32)
    state = np.array([[x << (8 * k) for x in range(256)] for k in range(4)], np.uint32)
    for n in range(SHORT_WORD + 1):
        state = one[state & 0xFF] ^ (state >> 8)
        found[n] = state
    return found


APPENDING = _appending()
#: By length: the crc32 of a blank and a word is that of the word, changed by this.
BLANK_BEFORE = np.array([zlib.crc32(b" " + bytes(n)) ^ zlib.crc32(bytes(n)) for n in range(SHORT_WORD + 1)], np.uint32)


def _checksums(words: Words, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc32 of the n-grams of ``n`` words from word ``first`` on: of the first word, then further ones appended."""
    sums = words.crc[first]
    for k in range(1, int(n.max(initial=0))):
        more = np.flatnonzero(n > k)
        word, before = first[more] + k, sums[more]
        length = words.end[word] - words.start[word]
        long = np.flatnonzero(length > SHORT_WORD)
        length = np.minimum(length, SHORT_WORD)
        shifted = APPENDING[length, 0, before & 0xFF] ^ APPENDING[length, 1, before >> 8 & 0xFF]
        shifted ^= APPENDING[length, 2, before >> 16 & 0xFF] ^ APPENDING[length, 3, before >> 24]
        sums[more] = shifted ^ words.crc[word] ^ BLANK_BEFORE[length]
        for i in long.tolist():
            sums[more[i]] = zlib.crc32(words.text[words.start[first[more[i]]] : words.end[word[i]]])
    return sums


class Table(NamedTuple):
    """Open-addressed table of n-grams: bucket and count by slot, and each occurrence's slot."""

    bucket: np.ndarray
    count: np.ndarray
    slot: np.ndarray


def intern(words: Words, grams: Grams, buckets: int, keys: np.ndarray | None = None) -> Table:
    """A slot for each different n-gram. Equal ``keys`` (by default xxhash64) are told apart by the bytes."""
    keys = xxhash64(words.text, grams.start, grams.length) if keys is None else keys
    size = 1 << max(1, (2 * len(keys) - 1).bit_length())
    owner = np.full(size, -1, np.int32)
    slot = (keys & np.uint64(size - 1)).astype(np.int32)
    waiting, at, key = np.arange(len(keys), dtype=np.int32), slot, keys
    while len(waiting):
        free = owner[at] < 0
        owner[at[free]] = waiting[free]  # of several, one gets the slot
        holder = owner[at]
        same = keys[holder] == key
        alike = np.flatnonzero(same & (holder != waiting))
        i, j = waiting[alike], holder[alike]
        length = grams.length[i]
        same[alike] = (length == grams.length[j]) & _same_bytes(words.text, length, grams.start[i], grams.start[j])
        waiting = waiting[~same]
        key, at = keys[waiting], (slot[waiting] + 1) & (size - 1)
        slot[waiting] = at
    bucket = np.zeros(size, np.int64)
    used = np.flatnonzero(owner >= 0)
    bucket[used] = _checksums(words, grams.first[owner[used]], grams.n[owner[used]]) % buckets
    return Table(bucket, np.bincount(slot, minlength=size), slot)


def _binary(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch["text"].cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """bucket, n: occurrences of n-grams by bucket, over all rows of ``texts`` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            words = words_of(_binary(batch))
            for low in range(0, len(words.start), WORDS_AT_ONCE):
                table = intern(words, grams_of(words, low, low + WORDS_AT_ONCE, longest), buckets)
                total += np.bincount(table.bucket, table.count, buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})

    counted = in_batches(texts).select("text").mapInArrow(count, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the documents, both smoothed by one."""
    all_raw, all_target = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)

    def gain(bucket: int) -> int:
        above, below = (target.get(bucket, 0) + 1.0) * all_raw, (raw.get(bucket, 0) + 1.0) * all_target
        return math.floor(1000 * math.log(above / below))

    return np.array([gain(b) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of ``docs``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(_binary(batch))
            rows = batch.num_rows
            weight, n_features = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for low in range(0, len(words.start), WORDS_AT_ONCE):
                grams = grams_of(words, low, low + WORDS_AT_ONCE, longest)
                table = intern(words, grams, len(gains))
                of_occurrence = gains[table.bucket][table.slot]
                # sums of so few gains are exact in doubles
                weight += np.bincount(grams.document, of_occurrence, rows).astype(np.int64)
                n_features += np.bincount(grams.document, minlength=rows)
            n_words = np.bincount(words.document, minlength=rows)
            columns = {"n_words": n_words, "n_features": n_features, "weight": weight}
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch["doc_id"], **{name: pa.array(c, pa.int64()) for name, c in columns.items()}}
            )

    source = in_batches(docs).select(F.col("doc_id").cast("bigint"), "text")
    return source.mapInArrow(add, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with rank (from 1) by score, largest first, ties by the smaller doc_id (NULL first).

    Rows are sorted over ranges of that order and written; a row's rank is the number of
    rows in the ranges before its own, and its place there. ``row`` parts a hot doc_id.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("row").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits number the range, the lower 33 the place in it
    placed = materialize(dealt.withColumn("place", F.monotonically_increasing_id()), "resampling-ranks")
    number, place = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(number.alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per task
    before, starts = 0, []
    for size in sorted(sizes):
        starts.append((size["range"], before))
        before += size["n"]
    starts = rows.sparkSession.createDataFrame(starts, "range bigint, before bigint")
    ranked = placed.withColumn("range", number).join(F.broadcast(starts), "range")
    return ranked.withColumn("rank", F.col("before") + place + 1).drop("range", "before", "place")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    least_words: int = 20,
    buckets: int = 10_000,
    longest: int = 3,
    seed: int = 42,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (NULL: not drawn) of each row of ``docs``.

    ``docs`` has doc_id and text, ``target`` text; other columns are ignored. Letters A to
    Z are lowered; words are runs of ASCII letters, digits and all characters beyond
    ASCII. Features are runs of 1 to ``longest`` words. Of the rows with ``least_words``
    words, ``percent`` of a hundred (rounded down) with the highest scores are drawn, ties
    by the smaller doc_id. A missing or empty text has no features and weight 0; the noise
    of a row without doc_id is that of an empty id, and it precedes others in a tie;
    repeated rows are repeated, and drawn each. No documents give no rows; an empty target
    leaves the smoothing.

    All documents are read twice: to count buckets, and to weigh. Only the bucket counts
    (``buckets`` rows) and the number of rows by range of scores reach the driver.
    """
    spark = docs.sparkSession
    raw = {r["bucket"]: r["n"] for r in bucket_counts(docs, buckets, longest).collect()}
    wanted = {r["bucket"]: r["n"] for r in bucket_counts(target, buckets, longest).collect()}
    weighed = weigh(docs, bucket_gains(raw, wanted, buckets), longest)
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored, "resampling-scores")
    allowed = scored.where(F.col("n_words") >= least_words)
    n_drawn = percent * allowed.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    others = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    if n_drawn == 0:
        return others.union(allowed.select(*columns, F.lit(None).cast("bigint").alias("rank")))
    drawn = F.when(F.col("rank") <= n_drawn, F.col("rank"))
    return others.union(_ranked(allowed).select(*columns, drawn.alias("rank")))
