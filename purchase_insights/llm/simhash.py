"""Near-duplicate documents by SimHash fingerprints and BK-trees.

Two fingerprints that differ in at most three bits agree in one of four blocks, so
fingerprints are sharded by the value of a block. A shard whose value is common is
sharded again by the remaining bits, in the same way and without loss. In each shard
the fingerprints go into a BK-tree, children keyed by their Hamming distance to the
parent, and each follows only the edges within the radius. A shard returns which
fingerprints hang together, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purchase_insights.llm.components import connected_components
from purchase_insights.llm.sampling import in_batches
from purchase_insights.sources.scratch import materialize

SEED = 42
LARGE_SHARD = 1000
COUNTED_AT_ONCE = 50_000


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """64 bits; bit k is set if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    hashes = np.array([xxhash.xxh64_intdigest(shingle, SEED) for shingle in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), COUNTED_AT_ONCE):
        some = hashes[start : start + COUNTED_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id, text_hash and fingerprint (its 64 bits as a signed long) of each document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py() or "", shingle_words) for text in batch["text"]]
            column = pa.array(np.array(found, "<u8").view("<i8"))
            names = ["doc_id", "text_hash", "fingerprint"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], column], names)

    source = in_batches(docs).select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_hash"))
    return source.mapInArrow(compute, "doc_id bigint, text_hash bigint, fingerprint bigint")


class BKTree:
    """Integers by Hamming distance; a node is [value, {distance to it: child}]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            other, children = open_nodes.pop()
            distance = (other ^ value).bit_count()
            if distance <= radius:
                found.append(other)
            for edge, child in children.items():
                if -radius <= edge - distance <= radius:
                    open_nodes.append(child)
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of each value of a shard to the first of those that it hangs together with."""
    tree, above = BKTree(), {}

    def top(value: int) -> int:
        while above[value] != value:
            above[value] = value = above[above[value]]
        return value

    for value in values:
        above[value] = value
        for other in tree.within(value, radius):
            above[top(other)] = top(value)
        tree.add(value)
    return [(value, top(value)) for value in values if top(value) != value]


def _sharded(rows: DataFrame, blocks: int, width: int) -> DataFrame:
    """Each row once per block of its remaining bits: shard gets the block, rest loses it."""

    def taken(block: int) -> Column:
        low = block * width
        value = F.shiftrightunsigned("rest", low).bitwiseAND((1 << width) - 1)
        above = F.shiftleft(F.shiftrightunsigned("rest", low + width), low) if low + width < 64 else F.lit(0).cast("long")
        rest = above.bitwiseOR(F.col("rest").bitwiseAND((1 << low) - 1))
        shard = F.shiftleft(F.shiftleft("shard", 2).bitwiseOR(block), width).bitwiseOR(value)
        return F.struct(shard.alias("shard"), rest.alias("rest"))

    split = rows.select("fingerprint", F.explode(F.array(*(taken(b) for b in range(blocks)))).alias("s"))
    return split.select("fingerprint", "s.shard", "s.rest")


def fingerprint_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links a, b between fingerprints; their components are those of all links within ``radius``.

    ``distinct`` has each fingerprint once. No pair of a link is lost: radius + 1
    blocks cannot all differ, whatever bits have been split off before.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the shards are made for a radius of 0 to 3 bits")
    blocks = 4

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_shard, kept = None, np.empty(0, np.int64)
        for batch in batches:
            shards, values = batch["shard"].to_numpy(), batch["fingerprint"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
            links = []
            for start, end in zip(starts[:-1], starts[1:]):
                if shards[start] == kept_shard:
                    kept = np.concatenate([kept, values[start:end]])
                    continue
                if len(kept) > 1:
                    links += shard_links((kept.view("<u8")).tolist(), radius)
                kept_shard, kept = shards[start], values[start:end]
            yield _link_batch(links)
        if len(kept) > 1:
            yield _link_batch(shard_links(kept.view("<u8").tolist(), radius))

    found = None
    rows = distinct.select("fingerprint", F.lit(0).cast("long").alias("shard"), F.col("fingerprint").alias("rest"))
    for width, last in ((16, False), (12, False), (9, True)):
        rows = materialize(_sharded(rows, blocks, width), "shards")
        large = None
        if not last:
            counts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
            large = materialize(counts.where(F.col("n") > LARGE_SHARD).select("shard"), "large-shards")
        split_on = large is not None and not large.isEmpty()
        now = rows.join(large, "shard", "left_anti") if split_on else rows
        now = now.select("shard", "fingerprint").repartition("shard").sortWithinPartitions("shard", "fingerprint")
        links = now.mapInArrow(link, "a bigint, b bigint")
        found = links if found is None else found.union(links)
        if not split_on:
            break
        rows = rows.join(large, "shard", "left_semi")
    return found


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(links, "<u8").reshape(-1, 2).view("<i8")
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 hex digits) and component_id of each row of ``docs``.

    component_id is the smallest doc_id that can be reached over links, the row's own
    included. A missing or blank text has fingerprint zero and is linked like any
    other; repeated rows are repeated; a row without doc_id never names a component
    (NULL where nothing else is reached); other columns are ignored; no documents
    give no rows. Only fingerprints leave the first pass, and equal ones go on once.
    """
    prints = materialize(fingerprints(docs, shingle_words), "fingerprints")
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    classes = materialize(connected_components(fingerprint_links(distinct, radius)), "components")
    tied = classes.withColumnRenamed("node", "fingerprint")
    smallest = tied.join(distinct, "fingerprint").groupBy("component").agg(F.min("first_id").alias("class_id"))
    classed = tied.join(smallest, "component").select("fingerprint", "class_id")
    ids = distinct.join(classed, "fingerprint", "left").select(
        "fingerprint", F.coalesce("class_id", "first_id").alias("component_id")
    )
    return prints.join(materialize(ids, "component-ids"), "fingerprint").select(
        "doc_id",
        "text_hash",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def deduplicate(docs: DataFrame, shingle_words: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component of near duplicates, with all its columns: that of the smallest doc_id.

    Of rows that repeat this doc_id and text one stays. Components without any doc_id
    keep one row per fingerprint.
    """
    found = materialize(near_duplicates(docs, shingle_words, radius), "near-duplicates")
    named = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "text_hash")
    unnamed = found.where("doc_id IS NULL AND component_id IS NULL").groupBy("doc_id", "fingerprint")
    n = F.count(F.lit(1)).alias("n")
    # a doc_id may come with several texts of one component: the smallest hash stays
    named = named.agg(n).groupBy("doc_id").agg(F.min(F.struct("text_hash", "n")).alias("first")).select("doc_id", "first.*")
    unnamed = unnamed.agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash", F.lit(2).cast("bigint").alias("n"))
    kept = materialize(named.unionByName(unnamed).toDF("kept_id", "kept_hash", "n"), "kept")

    def rows_of(keys: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(keys["kept_id"]) & (F.xxhash64(docs["text"]) == keys["kept_hash"])
        return docs.join(keys, same, "left_semi")

    single = rows_of(kept.where("n = 1"))
    if kept.where("n > 1").isEmpty():
        return single
    repeated = rows_of(kept.where("n > 1"))
    return single.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
