"""Importance resampling against a plain version, and the table of n-grams."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from purchase_insights.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(rows, target, percent=5, least=20):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % 10_000

    s = Counter(bucket(f) for _, text in rows for f in features(text)[1])
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for doc_id, text in rows:
        words, found = features(text)
        gains = (math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, found))
        weight = sum(gains)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words) >= least])
    allowed = sorted((r for r in out if r[5]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for rank, row in enumerate(allowed[: percent * len(allowed) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, (r[:5] for r in out)), key=str)


def found(docs, target, **changes):
    return sorted(map(tuple, resampling.resample(docs, target, **changes).collect()), key=str)


ROWS = [
    (1, "The cat, the CAT sat on the mat. The end" * 3),
    (2, None),
    (3, ""),
    (4, "ÀÉ straße ÀÉ   don't stop_now x1y2 " * 9),
    (5, "one two three four five six seven eight nine ten eleven twelve " * 2),
    (5, "one two three four five six seven eight nine ten eleven twelve " * 2),
    (6, "y" * 100 + " z" * 30),
    (None, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    *((i, f"word{i} stone river {i % 7} lamp " * (i % 9)) for i in range(10, 80)),
]


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_against_plain(spark, percent):
    docs = spark.createDataFrame([(*r, "x", 0) for r in ROWS], "doc_id bigint, text string, rank string, score int").repartition(5)
    target = ["stone river lamp, stone", "the cat sat", None]
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    assert found(docs, texts, percent=percent) == plain(ROWS, target, percent)


def test_odd_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert found(none, docs) == []
    assert found(docs, none) == plain(ROWS, [])


def test_hot_row_and_long_text(spark):
    """A row that holds most of the table is drawn as often as it occurs; a text longer than a block is whole."""
    rows = [(7, "stone " * 25)] * 300 + [(i, f"some other text {i} " * 6) for i in range(100)]
    rows += [(1000, " ".join(f"w{i % 5000}" for i in range(2 * resampling.WORDS_AT_ONCE + 7)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = docs.where("doc_id = 7").select("text").limit(1)
    assert found(docs, target, percent=50) == plain(rows, ["stone " * 25], 50)


def test_given_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs, target) == plain(rows, [r.text for r in target.collect()])


def test_xxhash64():
    rng = np.random.default_rng(1)
    text = rng.bytes(3000) + resampling.PADDING
    start, length = rng.integers(0, 2900, 2000), rng.integers(0, 90, 2000)
    start, length = start, np.minimum(length, 3000 - start)
    expected = [xxhash.xxh64_intdigest(text[a : a + n]) for a, n in zip(start.tolist(), length.tolist())]
    assert resampling.xxhash64(text, start, length).tolist() == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aAbÄ \n.x0" + "long" * 3, max_size=60), max_size=6), st.integers(1, 5))
def test_table(texts, n_keys):
    """Slots and buckets are those of the bytes, also when almost all keys collide."""
    words = resampling.words_of([t.encode() for t in texts] + [b"q" * 70 + b" r " + b"s" * 64])
    grams = resampling.grams_of(words, 0, len(words.start), 3)
    names = [words.text[a : a + n] for a, n in zip(grams.start.tolist(), grams.length.tolist())]
    keys = np.array([len(name) % n_keys for name in names], np.uint64)
    for table in (resampling.intern(words, grams, 97), resampling.intern(words, grams, 97, keys)):
        slot_of = {}
        for name, slot in zip(names, table.slot.tolist()):
            assert slot_of.setdefault(name, slot) == slot and table.bucket[slot] == zlib.crc32(name) % 97
        assert len(set(slot_of.values())) == len(slot_of)
        assert {slot_of[name]: n for name, n in Counter(names).items()} == {s: n for s, n in enumerate(table.count) if n}


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("doc_id"), (F.col("id") % 50).alias("score"), F.col("id").alias("row")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = [(r.score, r.doc_id) for r in resampling._ranked(rows).orderBy("rank").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranked == sorted(((i % 50, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
