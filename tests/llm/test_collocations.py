"""Phrase mining against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from purchase_insights.llm import collocations, sampling

DELIMITER = re.compile(r"[.,;:!?\x0A-\x0D]")


def plain(rows, least=30, percent=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in DELIMITER.split(lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = set()
        for longer, of_longer in candidates.items():
            for k in range(2, len(longer)):
                for i in range(len(longer) - k + 1):
                    part = longer[i : i + k]
                    if 100 * of_longer >= percent * candidates[part]:
                        dropped.add(part)
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                cuts = ((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(spark, rows, partitions=5, **changes):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n long, phrase string")
    result = collocations.collocations(docs.repartition(partitions), **changes)
    assert result.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, result.collect()))


def texts(seed, n, words=12, langs=("en", "fr", None)):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "Éa", "x y", "\x00", *(f"w{i}" for i in range(words))]
    rows = []
    for _ in range(n):
        picked = (rng.choice(vocabulary) if rng.random() < 0.6 else rng.choice(["in the City of", "as well as", "a\tb"]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(langs), "".join(word + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for word in picked)))
    return rows


SMALL = dict(budget=40, words_at_once=150, common_pair=2)


@pytest.mark.parametrize("changes", [{}, SMALL, {"top": 5}, {"least": 3, "percent": 50, **SMALL}])
def test_against_plain(spark, changes):
    rows = [*texts(1, 300), (None, None), ("de", ""), ("de", "only once. here"), ("en", "a b c d " * 400), ("en", "a b c d " * 400)]
    limits = {k: v for k, v in changes.items() if k in ("least", "percent", "top")}
    expected = plain(rows, **limits)
    assert expected and found(spark, rows, **changes) == expected


def test_long_text_without_marks(spark):
    """A piece longer than a part loses no suffix where it is cut."""
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice(["a", "b", "c"]) for _ in range(4000)))]
    assert found(spark, rows, **SMALL) == plain(rows)
    assert found(spark, rows, words_at_once=7) == plain(rows)


def test_hot_line_over_many_parts(spark):
    rows = [("en", "the same line in all of them")] * 500 + texts(2, 100)
    assert found(spark, rows, partitions=9, **SMALL) == plain(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    expected = plain(rows, least=5)
    assert expected and sorted(map(tuple, collocations.collocations(docs, least=5).collect())) == expected
    small = collocations.collocations(docs, least=5, budget=500, words_at_once=3000, common_pair=2)
    assert sorted(map(tuple, small.collect())) == expected


def test_nothing(spark):
    assert found(spark, []) == [] and found(spark, [("en", "a b")]) == []


def test_equal_ids_take_another_seed(spark, monkeypatch):
    seeds = []
    real = collocations._counting

    def weak(seed, *sizes):
        seeds.append(seed)
        counting = real(seed, *sizes)
        if seed > 42:
            return counting

        def count(batches):
            for batch in counting(batches):
                yield batch.set_column(2, "id", (batch["id"].to_numpy() % 3).tolist())

        return count

    monkeypatch.setattr(collocations, "_counting", weak)
    rows = texts(4, 60)
    assert found(spark, rows, least=3) == plain(rows, least=3) and seeds == [42, 43]


def test_groups_stay_within_the_budget(spark):
    """A pair with a third of all words, however it goes on, is dealt over the groups."""
    rng = random.Random(5)
    rows = [("en", " ".join(["of the w%d w%d" % (rng.randrange(900), rng.randrange(900)) for _ in range(50)])) for _ in range(200)]
    text = spark.createDataFrame(rows, "lang string, text string")
    counted, seed = collocations._words_and_pairs(text, 10_000, 32)
    words, pairs = counted.where("second IS NULL"), counted.where("second IS NOT NULL")
    prefixes = collocations._prefixes(words, pairs, 2000)
    assert len(prefixes["en"].pairs) >= 1
    bits = np.full(sampling.FILTER_BITS // 8, 255, np.uint8)
    columns = ", ".join(f"{c} binary" for c in (*collocations.IDS, "n"))
    dealt = text.mapInArrow(collocations._dealing(seed, bits, prefixes, 10_000), f"lang string, group int, split boolean, {columns}")
    sizes = dealt.selectExpr("group", "octet_length(n) div 8 AS k").groupBy("group").sum("k").collect()
    assert max(r[1] for r in sizes) < 3 * 2000 and sum(r[1] for r in sizes) > 20_000
