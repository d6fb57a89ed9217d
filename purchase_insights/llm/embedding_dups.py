"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product exceeds a bound.
The directions form a structured product code: each block of the rotated vector has
its own small set of random code words, and a direction is one word per block, so all
directions that a vector passes are listed without looking at the others. Vectors of
a label that pass a common direction are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchase_insights.llm.components import connected_components
from purchase_insights.sources.scratch import materialize

LARGE_BUCKET = 8192
ROWS_AT_ONCE = 512
FILTERS_AT_ONCE = 1024
PAIRS_AT_ONCE = 20_000
#: From so many candidates per vector on, common filters are looked up for all pairs at once.
DENSE = 16
#: The share of pairs at the threshold that are to have a common filter, and on how many it is measured.
RECALL = 0.99
PLANTED = 4000


class Code(NamedTuple):
    """``words[b]``: code words of block b; a direction is numbered by its words' numbers."""

    rotation: np.ndarray
    words: np.ndarray  # block, word, dimension
    bound: float
    least: int


def _halves(unit: np.ndarray, rotation: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products with all pairs of words of the first two blocks, and of the last two."""
    near = np.einsum("nbd,bwd->nbw", (unit @ rotation).reshape(len(unit), 4, -1), words)
    first = (near[:, 0, :, None] + near[:, 1, None, :]).reshape(len(unit), -1)
    return first, (near[:, 2, :, None] + near[:, 3, None, :]).reshape(len(unit), -1)


def pairs_at(cosine: float, dimensions: int, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors, and for each another one at the cosine."""
    a, b = rng.normal(size=(2, n, dimensions))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = cosine * a + np.sqrt(max(0.0, 1 - cosine * cosine)) * b
    return a, b / np.linalg.norm(b, axis=1, keepdims=True)


def _bound_for(probes: np.ndarray, rotation: np.ndarray, words: np.ndarray, filters_per_vector: float) -> float:
    """The bound that lets the probes pass so many filters on average, all directions counted."""
    first, second = _halves(probes, rotation, words)
    second = np.sort(second, axis=1)
    low, high = -1.0, 1.0
    while high - low > 1e-5:
        bound = (low + high) / 2
        passed = sum(second.shape[1] * len(f) - int(np.searchsorted(s, bound - f).sum()) for f, s in zip(first, second))
        low, high = (bound, high) if passed > filters_per_vector * len(probes) else (low, bound)
    return low


def shared_filters(a: np.ndarray, b: np.ndarray, code: Code) -> float:
    """The share of pairs of rows that pass a common filter."""
    n_shared, n_directions = 0, code.words.shape[1] ** 4
    for start in range(0, len(a), 100):
        sides = (passed_filters(unit[start : start + 100], code) for unit in (a, b))
        common = np.intersect1d(*(rows * n_directions + filters for rows, filters in sides), assume_unique=True)
        n_shared += len(np.unique(common // n_directions))
    return n_shared / len(a)


def make_code(
    dimensions: int,
    words_per_block: int,
    filters_per_vector: float | None = None,
    seed: int = 5,
    threshold: float = 0.93,
    recall: float = RECALL,
) -> Code:
    """A code of four blocks, whose bound gives at least a share ``recall`` of pairs at the threshold a common filter.

    The share is measured on planted pairs. With ``filters_per_vector`` the bound lets a
    random unit vector pass so many filters on average instead, whatever the recall.
    """
    rng = np.random.default_rng(seed)
    padded = -(-dimensions // 4) * 4
    rotation = np.linalg.qr(rng.normal(size=(padded, padded)))[0][:dimensions]
    words = rng.normal(size=(4, words_per_block, padded // 4))
    words /= 2 * np.linalg.norm(words, axis=2, keepdims=True)  # four of norm 1/2 make a direction of norm 1
    probes = rng.normal(size=(200, dimensions))
    probes /= np.linalg.norm(probes, axis=1, keepdims=True)

    def code_for(filters: float) -> Code:
        return Code(rotation, words, _bound_for(probes, rotation, words, filters), max(1, int(filters // 2)))

    if filters_per_vector is not None:
        return code_for(filters_per_vector)
    a, b = pairs_at(threshold, dimensions, PLANTED, rng)
    measured = recall + 2 * (recall * (1 - recall) / PLANTED) ** 0.5  # two standard errors more
    few, enough = 4.0, 8.0
    while enough < words_per_block**4 and shared_filters(a, b, code_for(enough)) < measured:
        few, enough = enough, 2 * enough
    while enough > 1.05 * few:
        filters = (few * enough) ** 0.5
        few, enough = (few, filters) if shared_filters(a, b, code_for(filters)) >= measured else (filters, enough)
    return code_for(enough)


def passed_filters(unit: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter that each row of ``unit`` passes.

    The bound is lowered for a vector that would pass less than half as many as on
    average, so that none is left out; its near neighbours have theirs lowered too.
    Sums of the first two and of the last two blocks are listed apart; sorted, the
    second list is cut for each of the first where the bound is no longer reached.
    """
    n_words, least = code.words.shape[1], code.least
    first, second = _halves(unit, code.rotation, code.words)
    rows, filters = [], []
    for i in range(len(unit)):
        order = np.argsort(-second[i])
        best = np.sort(first[i])[: -least - 1 : -1][:, None] + second[i][order[:least]]
        bound = min(code.bound, np.partition(best.ravel(), -least)[-least])
        left = np.flatnonzero(first[i] >= bound - second[i][order[0]])
        n_right = np.searchsorted(-second[i][order], first[i][left] - bound, side="right")
        found = np.repeat(left, n_right) * n_words**2
        starts = np.repeat(np.cumsum(n_right) - n_right, n_right)
        found += order[np.arange(len(found)) - starts]
        rows.append(np.full(len(found), i))
        filters.append(found)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(filters)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _earlier(rows: np.ndarray, filters: np.ndarray) -> pa.Array:
    """For each (row, filter), sorted by both: the smaller filters of its row, as bytes of int32."""
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    n_earlier = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    starts = np.arange(len(rows)) - n_earlier
    bounds = np.concatenate([[0], np.cumsum(n_earlier)])
    places = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - starts, n_earlier)
    values = np.ascontiguousarray(filters[places].astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(values)])


def _filtered(vectors: DataFrame, code: Code, with_vectors: bool) -> DataFrame:
    """label, filter (and vec_id, copies, embedding, earlier): a row per filter that a vector passes.

    ``earlier`` are the smaller filters that the vector passes: two vectors belong
    together in the bucket of their smallest common filter.
    """
    columns = ["label", "filter", "vec_id", "copies", "embedding", "earlier"] if with_vectors else ["label", "filter"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(start, ROWS_AT_ONCE)
                x = _matrix(some["embedding"])
                rows, filters = passed_filters(x / np.linalg.norm(x, axis=1, keepdims=True), code)
                order = np.lexsort((filters, rows))
                rows, filters = rows[order], filters[order]
                taken = pa.array(rows)
                made = {"filter": pa.array(filters)}
                if with_vectors:
                    made["earlier"] = _earlier(rows, filters)
                yield pa.RecordBatch.from_pydict({c: made[c] if c in made else some[c].take(taken) for c in columns})

    chosen = vectors.select("label", "vec_id", "copies", "embedding")
    types = {name: "bigint" for name in columns} | {"embedding": dict(vectors.dtypes)["embedding"], "earlier": "binary"}
    return chosen.mapInArrow(apply, ", ".join(f"{c} {types[c]}" for c in columns))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; the same whatever else is compared."""
    dot = (a * b).sum(axis=1)
    return dot / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


class Bucket(NamedTuple):
    """Vectors of a bucket, or of two of its chunks (``side`` 0 and 1)."""

    ids: np.ndarray
    labels: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray
    side: np.ndarray
    earlier: list[np.ndarray]


class _Shared:
    """Which vectors of a bucket have a smaller filter in common too, and so belong together elsewhere."""

    def __init__(self, earlier: list[np.ndarray]):
        self.n = len(earlier)
        rows = np.repeat(np.arange(self.n), [len(x) for x in earlier])
        _, number, count = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
        several = count[number] > 1
        number = (np.cumsum(count > 1) - 1)[number]
        self.rows, self.filters = rows[several], number[several]
        self.n_filters = int((count > 1).sum())
        self.listed: np.ndarray | None = None

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For all pairs of a row of ``a`` and one of ``b``, by products of their incidence with the filters."""
        common = np.zeros((len(a), len(b)), bool)
        for low in range(0, self.n_filters, FILTERS_AT_ONCE):
            some = (self.filters >= low) & (self.filters < low + FILTERS_AT_ONCE)
            has = np.zeros((self.n, min(FILTERS_AT_ONCE, self.n_filters - low)), np.float32)
            has[self.rows[some], self.filters[some] - low] = 1
            common |= has[a] @ has[b].T > 0
        return common

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each row of ``a`` with that of ``b``: sorted together, a common filter stands twice."""
        if self.listed is None:
            n_of_row = np.bincount(self.rows, minlength=self.n)
            place = np.arange(len(self.rows)) - np.repeat(np.cumsum(n_of_row) - n_of_row, n_of_row)
            self.listed = np.full((self.n, n_of_row.max(initial=0)), -1, np.int64)
            self.listed[self.rows, place] = self.filters
        right = self.listed[b]
        both = np.sort(np.concatenate([self.listed[a], np.where(right < 0, -2, right)], axis=1), axis=1)
        return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)).any(axis=1)


def links_within(bucket: Bucket, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many rows each vector is linked with, and links (positions) that connect all that links connect.

    Only pairs without a smaller filter in common count. Candidates come from a matrix
    product, with a margin for its rounding; the decision is ``cosines``.
    """
    ids, labels, copies, x, side, earlier = bucket
    n = len(ids)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    two = side.any()
    a_of, b_of = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(n), np.arange(n))
    counts, root, forest = np.zeros(n, np.int64), np.arange(n), []
    shared: _Shared | None = None
    for start in range(0, len(a_of), ROWS_AT_ONCE):
        rows = a_of[start : start + ROWS_AT_ONCE]
        near = unit[rows] @ unit[b_of].T >= threshold - 1e-9
        near &= (labels[rows][:, None] == labels[b_of]) & (ids[rows][:, None] != ids[b_of])  # a bucket is known by a hash
        if not two:
            near &= rows[:, None] < b_of
        if not near.any():
            continue
        shared = shared or _Shared(earlier)
        dense = near.sum() > DENSE * len(rows)
        if dense:
            near &= ~shared.between(rows, b_of)
        i, j = np.nonzero(near)
        i, j = rows[i], b_of[j]
        for at in range(0, len(i), PAIRS_AT_ONCE):
            p, q = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
            if not dense:
                apart = ~shared.of_pairs(p, q)
                p, q = p[apart], q[apart]
            linked = cosines(x[p], x[q]) >= threshold
            p, q = p[linked], q[linked]
            counts += np.bincount(p, copies[q], n).astype(np.int64) + np.bincount(q, copies[p], n).astype(np.int64)
            joins = root[p] != root[q]
            for a, b in zip(p[joins].tolist(), q[joins].tolist()):
                if root[a] != root[b]:
                    forest.append((a, b))
                    root[root == root[b]] = root[a]
    return counts, forest


def _bucket_links(buckets: DataFrame, threshold: float) -> DataFrame:
    """From rows sorted by bucket, of which one at a time is held: a, b, n.

    A vector ``a`` that has links in a bucket has a row with their number n (b is NULL),
    and what is linked there is connected by rows with b (n is NULL), fewer than vectors.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, []

        def links() -> Iterator[pa.RecordBatch]:
            if sum(len(part) for part in kept) < 2:
                return
            whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            ids, labels, copies, side = (whole[name].to_numpy() for name in ("vec_id", "label", "copies", "side"))
            earlier = [np.frombuffer(value.as_py(), np.int32) for value in whole["earlier"]]
            counts, forest = links_within(Bucket(ids, labels, copies, _matrix(whole["embedding"]), side, earlier), threshold)
            counted = np.flatnonzero(counts)
            if len(counted) == 0:
                return
            a, b = np.array(forest, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[counted], ids[a]])),
                    pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(ids[b])]),
                    pa.concat_arrays([pa.array(counts[counted]), pa.nulls(len(a), pa.int64())]),
                ],
                ["a", "b", "n"],
            )

        for batch in batches:
            buckets = batch["bucket"].to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for start, end in zip(starts[:-1], starts[1:]):
                if end == start:
                    continue
                if buckets[start] != key:
                    yield from links()
                    key, kept = buckets[start], []
                kept.append(batch.slice(start, end - start))
        yield from links()

    return buckets.mapInArrow(link, "a bigint, b bigint, n bigint")


def words_for(n: int) -> int:
    """Words per block for n vectors: about n / 4 directions, so that few filters per vector reach the recall."""
    return int(np.clip(round((n / 4) ** 0.25), 8, 64))


def near_links(vectors: DataFrame, threshold: float, filters_per_vector: float | None = None) -> DataFrame:
    """Links of cosine ``threshold`` or more between different vectors of one label, as ``_bucket_links`` gives them.

    ``vectors`` has label, vec_id, copies and embedding (an array of numbers, of one length,
    none zero) and each vector once. No pairs leave a bucket, however many links it has. The number of directions follows the number of vectors,
    so that a bucket's expected size grows only as the filters per vector that the recall
    takes. Buckets with more than ``LARGE_BUCKET`` rows are cut into chunks that are
    compared two at a time.
    """
    first = vectors.select(F.size("embedding").alias("n")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "a bigint, b bigint, n bigint")
    n = vectors.count()
    code = make_code(first["n"], words_for(n), filters_per_vector, threshold=threshold)
    sizes = _filtered(vectors, code, False).groupBy("label", "filter").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.where(F.col("n") > LARGE_BUCKET), "large-buckets")
    rows = _filtered(vectors, code, True)
    carried = ["label", "vec_id", "copies", "embedding", "earlier"]
    if large.isEmpty():
        dealt = rows.select(F.struct("label", "filter").alias("bucket"), F.lit(0).alias("side"), *carried)
    else:
        # chunk k of a bucket of c chunks meets each of the others once, and itself alone
        chunks = large.select("label", "filter", F.ceil(F.col("n") / LARGE_BUCKET).alias("chunks"))
        sized = rows.join(chunks, ["label", "filter"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        sized = sized.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")))
        sized = sized.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        dealt = sized.select(
            F.struct("label", "filter", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("bucket"),
            (F.col("chunk") > F.col("other")).cast("int").alias("side"),
            *carried,
        )
    dealt = dealt.withColumn("bucket", F.xxhash64("bucket"))
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "vec_id")
    # counts of a vector from several buckets are added up before they are dealt out
    return _bucket_links(dealt, threshold).groupBy("a", "b").agg(F.sum("n").alias("n"))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93, filters_per_vector: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``embeddings`` (vec_id, embedding, label).

    Rows are linked if their labels are equal and not null and their vectors' cosine is
    ``threshold`` or more. A vector that is missing, empty, zero or holds a missing or
    non-finite component, and a row without vec_id, links with nothing; vectors of
    different length are not compared. n_links counts the other rows linked directly,
    component_id is the smallest vec_id that links reach (the row's own included), kept
    is whether the two are equal. Equal vectors of a label are compared once and counted
    as often as they occur, so no pairs of copies are made; repeated rows are such
    copies. Other columns are ignored. Nothing is linked below the threshold. Of the
    links at the threshold a share ``RECALL`` is expected to be found, of closer ones more,
    whatever the number of rows; ``filters_per_vector`` fixes the effort instead.
    """
    kind = "float" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "double"
    numbers = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0).cast(kind))  # no negative zeros
    label = F.col("label").cast("bigint")
    if dict(embeddings.dtypes)["label"] not in ("tinyint", "smallint", "int", "bigint"):
        label = F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string")))
    rows = embeddings.select(F.col("vec_id").cast("bigint"), label.alias("label"), numbers.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & nonzero, F.lit(False))
    code = F.struct(F.xxhash64("label", "embedding"), F.xxhash64("embedding", "label", F.lit(1)))  # 128 bits
    classes = rows.where(usable).groupBy("label", "embedding")
    classes = materialize(classes.agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    lengths = [r["n"] for r in classes.groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect()]
    found = None
    for length in lengths:  # as a rule one
        links = near_links(classes.where(F.size("embedding") == length), threshold, filters_per_vector)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], "a bigint, b bigint, n bigint")
    found = materialize(found, "vector-links")
    components = materialize(connected_components(found.where("b IS NOT NULL").select("a", "b")), "vector-components")
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("linked"))
    tied = components.withColumnRenamed("node", "vec_id")
    of_class = classes.join(linked, "vec_id", "left").join(tied, "vec_id", "left")
    of_class = of_class.select(
        code.alias("code"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    result = rows.select("vec_id", F.when(usable, code).alias("code")).join(materialize(of_class, "vector-results"), "code", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
