"""Near-duplicate vectors and nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from plain import plain_components

from purchase_insights.llm import ann, embedding_dups

SCHEMA = "vec_id long, embedding array<float>, label int, component string, vector int, ids int, code string"
ODD = [
    (9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [float("inf")] + [1.0] * 15, 1),
    (9005, [None] + [1.0] * 15, 1), (9006, [], 1), (9007, [1.0, 2.0], 1), (9008, [-0.0, 1.0] + [0.0] * 14, 2),
    (9009, [0.0, 1.0] + [0.0] * 14, 2), (9010, [0.0, 2.0] + [0.0] * 14, 2), (9011, [0.0, 2.0] + [0.0] * 14, None),
    (None, [0.0, 1.0] + [0.0] * 14, 2),
]


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = []
    for k in range(900):
        x = centres[k % 40] + rng.normal(size=16) * rng.choice([0.1, 0.3, 1.5])
        rows.append((k, x.astype(np.float32).tolist(), k % 3))
    rows += [(1000 + k, rows[4][1], 1) for k in range(60)] + [(1200, rows[5][1], 1), (1200, rows[5][1], 1)]
    return rows + ODD


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, 2, "b") for r in rows], SCHEMA).repartition(5)


def usable(row):
    x = row[1]
    return row[0] is not None and x is not None and None not in x and np.isfinite(x).all() and np.any(x)


def test_near_duplicates(spark, monkeypatch):
    for large in (8192, 20):  # also with buckets cut into chunks
        monkeypatch.setattr(embedding_dups, "LARGE_BUCKET", large)
        rows = vectors()
        # so many filters that no link is missed
        found = embedding_dups.near_duplicates(frame(spark, rows), threshold=0.93, filters_per_vector=300).collect()
        linked = []
        for a, p in enumerate(rows):
            for b in range(a):
                q = rows[b]
                if usable(p) and usable(q) and p[2] == q[2] and p[2] is not None and len(p[1]) == len(q[1]):
                    x, y = np.array(p[1], float), np.array(q[1], float)
                    if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                        linked.append((a, b))
        n_links = np.bincount(np.array(linked).ravel(), minlength=len(rows))
        classes = plain_components(range(len(rows)), linked)
        smallest = {}
        for k, row in enumerate(rows):
            if row[0] is not None:
                smallest[classes[k]] = min(row[0], smallest.get(classes[k], row[0]))
        want = [(r[0], int(n_links[k]), smallest.get(classes[k]), r[0] is not None and smallest[classes[k]] == r[0]) for k, r in enumerate(rows)]
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_usual_filters_find_nearly_all_links(spark):
    rows = [r for r in vectors() if usable(r) and len(r[1]) == 16][:900]
    found = embedding_dups.near_duplicates(frame(spark, rows), threshold=0.93).collect()
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([-1 if r[2] is None else r[2] for r in rows])
    linked = (x @ x.T >= 0.93) & (labels[:, None] == labels) & ~np.eye(len(x), dtype=bool)
    assert 0.99 * linked.sum() <= sum(r.n_links for r in found) <= linked.sum()


def test_listed_filters_are_those_that_exceed_the_bound():
    rng = np.random.default_rng(1)
    code = embedding_dups.make_code(16, 6, 20)
    unit = rng.normal(size=(50, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows, filters = embedding_dups.passed_filters(unit, code)
    blocks = (unit @ code.rotation).reshape(50, 4, -1)
    near = np.einsum("nbd,bwd->nbw", blocks, code.words)
    sums = sum(near[:, b].reshape(50, *(6 if k == b else 1 for k in range(4))) for b in range(4)).reshape(50, -1)
    for i in range(50):
        bound = min(code.bound, np.sort(sums[i])[-code.least])
        listed = set(filters[rows == i].tolist())
        assert len(listed) == (rows == i).sum()
        surely, perhaps = (set(np.flatnonzero(sums[i] >= bound + e).tolist()) for e in (1e-9, -1e-9))
        assert surely <= listed <= perhaps


@pytest.mark.parametrize("n", [10_256, 1_000_000, 3_000_000])
def test_recall_at_the_threshold_does_not_fall_with_the_table(n):
    code = embedding_dups.make_code(64, embedding_dups.words_for(n), threshold=0.93)
    a, b = embedding_dups.pairs_at(0.93, 64, 1000, np.random.default_rng(77))
    (i, f), (j, g) = (embedding_dups.passed_filters(x, code) for x in (a, b))
    pairs = set(zip(i.tolist(), f.tolist())) & set(zip(j.tolist(), g.tolist()))
    assert len({row for row, _ in pairs}) >= 980  # 32 filters for any n gave 0.86 at 3 million


def test_no_vectors(spark):
    empty = frame(spark, ODD).limit(0)
    assert embedding_dups.near_duplicates(empty).count() == 0
    assert ann.nearest(empty, empty).count() == 0
    only_odd = frame(spark, ODD[:6])
    assert {(r.n_links, r.kept) for r in embedding_dups.near_duplicates(only_odd).collect()} == {(0, True)}
    assert ann.nearest(only_odd, only_odd).count() == 0


def test_nearest(spark):
    rows = vectors()
    table = frame(spark, rows)
    queries = table.where("vec_id % 7 = 0 OR vec_id IN (4, 1001, 9007, 9009)")
    found = ann.nearest(table, queries, k=10, shard_size=300)
    answers = {}
    for r in found.collect():
        answers.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    known = {r[0]: np.array(r[1], float) for r in rows if usable(r)}
    asked = [i for i in known if i % 7 == 0 or i in (4, 1001, 9007, 9009)]
    hits = total = 0
    assert set(answers) == {i for i in asked if i != 9007}  # nothing else has its length
    for i in answers:
        best = sorted((-(known[i] @ x), j) for j, x in known.items() if j != i and len(x) == len(known[i]))[:10]
        got = sorted(answers[i])
        assert [rank for rank, _, _ in got] == list(range(1, len(got) + 1))
        assert [(-s, j) for _, j, s in got] == sorted((-s, j) for _, j, s in got)
        assert all(s == pytest.approx(known[i] @ known[j], abs=1e-9) for _, j, s in got)
        hits += len({j for _, j in best} & {j for _, j, _ in got})
        total += len(best)
    assert hits / total > 0.97
    copies = [j for _, j, _ in sorted(answers[1001])]
    assert copies == [4, 1000, *range(1002, 1010)]  # equal vectors, the smaller ids


def test_fewer_candidates_than_asked(spark):
    table = frame(spark, [(k, [float(k + 1)] * 16, 0) for k in range(5)])
    found = ann.nearest(table, table.where("vec_id = 2"), k=20).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in found] == [(1, 4, 240.0), (2, 3, 192.0), (3, 1, 96.0), (4, 0, 48.0)]


def test_repeated_rows_meet_in_no_window(spark):
    table = frame(spark, [(7, [1.0] * 16, 0)] * 500 + [(k, [1.0] * 16, 0) for k in range(5)])
    assert sorted(r.vec_id for r in ann._smallest_ids(table, 21).collect()) == [0, 1, 2, 3, 4, 7]


def test_graph_recall():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(2000, 24)) * rng.uniform(0.5, 2, size=(2000, 1))
    graph = ann.build_graph(points, degree=24, beam=40, relax=1.2)
    assert ((graph.edges >= 0).sum(axis=1) <= 24).all() and not (graph.edges == np.arange(2000)[:, None]).any()
    queries = rng.normal(size=(100, 24))
    found = ann.beam_search(graph, queries, 64, points)
    best = np.argsort(-(queries @ points.T), axis=1)[:, :10]
    assert np.mean([len(set(f) & set(b)) / 10 for f, b in zip(found.tolist(), best.tolist())]) > 0.9


@pytest.mark.parametrize("spread", [0.0, 0.1, 0.5])
def test_recall_of_lengths(spark, spread):
    """Unit vectors, and directions with log-normal lengths: recall against brute force."""
    rng = np.random.default_rng(7)
    points = rng.normal(size=(8192, 64))
    points *= np.exp(rng.normal(size=(8192, 1)) * spread) / np.linalg.norm(points, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, x) for i, x in enumerate(points.tolist())], "vec_id bigint, embedding array<double>")
    found = ann.nearest(table, table.where("vec_id % 40 = 0"), k=20).collect()
    products = points[::40] @ points.T
    products[np.arange(len(products)), np.arange(0, 8192, 40)] = -np.inf
    best = {40 * q: set(row[:20]) for q, row in enumerate(np.argsort(-products, axis=1).tolist())}
    assert len(found) == 20 * len(best)
    assert sum(r.vec_id in best[r.query_id] for r in found) / len(found) >= 0.95


def test_each_graph_goes_to_one_task(spark):
    """However many blocks of queries there are, a graph is read once per shard."""
    rng = np.random.default_rng(8)
    table = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(900, 8)).tolist())], "vec_id bigint, embedding array<double>")
    classes = ann._smallest_ids(table, 3).groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    sharded, n_shards = ann._sharded(classes, 900, 100)
    graphs = ann.index(sharded, n_shards, 16, 24, 1.2)
    assert graphs.count() == n_shards and sum(len(r.ids) for r in graphs.collect()) == 900
    found = ann.search(graphs, n_shards, ann._usable(table), 5, 2, 24)
    assert found.count() == 900 * n_shards * 2
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_links_of_a_large_group_leave_the_buckets_as_counts(spark):
    """Near copies of one vector: all are linked with all, and what the buckets hand on grows with the rows only."""
    rng = np.random.default_rng(9)
    centre, handed = rng.normal(size=16), []
    for n in (1250, 5000):
        rows = [(k, (centre + rng.normal(size=16) * 0.02).tolist(), 1, 1) for k in range(n)]
        table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint, copies bigint")
        found = embedding_dups.near_links(table, 0.93).collect()
        handed.append(len(found) / n)
        counts, forest = np.zeros(n, int), []
        for r in found:
            if r.b is None:
                counts[r.a] += r.n
            else:
                forest.append((r.a, r.b))
        assert (counts == n - 1).mean() > 0.99 and counts.max() == n - 1
        assert set(plain_components(range(n), forest).values()) == {0}
    assert handed[1] < 1.2 * handed[0] + 1


def test_a_pair_belongs_to_its_smallest_common_filter():
    rng = np.random.default_rng(10)
    lists = [np.unique(rng.integers(0, 60, rng.integers(0, 12))).astype(np.int32) for _ in range(80)]
    shared = embedding_dups._Shared(lists)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(80), np.arange(80), indexing="ij"))
    want = [bool(set(lists[i]) & set(lists[j])) for i, j in zip(a, b)]
    differ = a != b
    assert (shared.of_pairs(a, b)[differ] == np.array(want)[differ]).all()
    assert (shared.between(np.arange(80), np.arange(80)).ravel()[differ] == np.array(want)[differ]).all()
    rows = np.repeat(np.arange(80), [len(x) for x in lists])
    earlier = embedding_dups._earlier(rows, np.concatenate(lists).astype(np.int64))
    assert [np.frombuffer(e.as_py(), np.int32).tolist() for e in earlier] == [x[:k].tolist() for x in lists for k in range(len(x))]


def test_labels_of_any_type(spark):
    rows = [(k, [1.0, 2.0, 3.0, 4.0 + k / 100], label) for k, label in enumerate(["a", "a", "b", None, "a "])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    found = embedding_dups.near_duplicates(table, filters_per_vector=300).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id) for r in found] == [(1, 0), (1, 0), (0, 2), (0, 3), (0, 4)]
