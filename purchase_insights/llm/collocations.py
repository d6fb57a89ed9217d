"""Phrase mining: runs of words that occur together more often than their parts.

Frequencies of phrases come from suffix trees that are built in parts. A suffix of the
corpus begins at each word and is cut off after the longest phrase. Prefixes of suffixes
are grouped by a memory budget: a rare word is a prefix of its own, a frequent one is
continued by the second word, and a frequent pair by whole suffixes. Each group's
suffixes meet in one task, which sorts them to the leaves of a subtree, and reads a
node's frequency from the totals of its leaves.

Words that are rarer than a phrase may be are in no phrase, nor in a part of one; they
cut suffixes off as the end of a piece does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purchase_insights.llm.sampling import bit_table, in_batches, in_table
from purchase_insights.sources.scratch import materialize

#: The longest phrase, in words.
LONGEST = 4
#: Words of a task's part of the corpus that are sorted at once.
WORDS_AT_ONCE = 1_000_000
#: Suffixes that a group is to have, about.
BUDGET = 1 << 20
#: Beyond so many tasks they get several groups each, one after the other.
MOST_TASKS = 50_000
#: A pair as common as this in ``WORDS_AT_ONCE`` words is counted; a rarer one is no frequent pair.
COMMON_PAIR = 32

_END = b"."
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _folding() -> bytes:
    """A to Z in lower case, the marks that end a piece as one of them, a tab as a blank."""
    table = bytearray(range(256))
    for byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[byte] = byte + 32
    for byte in b".,;:!?\x0a\x0b\x0c\x0d":
        table[byte] = _END[0]
    table[9] = 32
    return bytes(table)


FOLDING = _folding()


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, and ``_END`` after each piece."""
    found = text.translate(FOLDING).replace(_END, b" . ").split()
    found.append(_END)
    return found


def word_id(word: bytes, seed: int) -> int:
    """Never 0, which stands for no word."""
    return xxhash.xxh64_intdigest(word, seed) or 1


def _signed(ids: np.ndarray) -> pa.Array:
    return pa.array(ids.view(np.int64))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Each language of a batch with its texts."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
        texts.setdefault(lang, []).append(text or b"")
    yield from texts.items()


class _Numbers(dict):
    """Numbers from 1 for the words of a language that are met; 0 for the end of a piece."""

    def __init__(self):
        self.words: list[bytes] = [_END]
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number


def _counting(seed: int, words_at_once: int, common_pair: int):
    """Words of a part of a task by language with their number, and its common pairs (``second`` is not NULL)."""

    def out(lang: str, words: list[bytes], firsts: np.ndarray, seconds: np.ndarray | None, counts: np.ndarray) -> pa.RecordBatch:
        second = pa.nulls(len(firsts), pa.int64()) if seconds is None else _signed(seconds)
        word = pa.nulls(len(firsts), pa.string()) if seconds is not None else pa.array(words, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(firsts), pa.string()), word, _signed(firsts), second, pa.array(counts, pa.int64())],
            ["lang", "word", "id", "second", "n"],
        )

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Numbers] = {}
        runs: dict[str, list[np.ndarray]] = {}
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in runs.items():
                numbers, run = known[lang], np.concatenate(parts)
                ids = np.array([word_id(word, seed) for word in numbers.words], np.uint64)
                n = np.bincount(run, minlength=len(ids))
                yield out(lang, numbers.words[1:], ids[1:], None, n[1:])
                pairs = (run[:-1] << 32) | run[1:]
                pairs, n = np.unique(pairs[(run[:-1] > 0) & (run[1:] > 0)], return_counts=True)
                pairs, n = pairs[n >= common_pair], n[n >= common_pair]
                if len(pairs):
                    yield out(lang, [], ids[pairs >> 32], ids[pairs & 0xFFFFFFFF], n)
            known.clear()
            runs.clear()

        for batch in batches:
            for lang, texts in _by_lang(batch):
                numbers = known.setdefault(lang, _Numbers())
                for text in texts:
                    found = words_of(text)
                    for start in range(0, len(found), words_at_once):
                        part = found[start : start + words_at_once]
                        runs.setdefault(lang, []).append(np.fromiter(map(numbers.__getitem__, part), np.int64, len(part)))
                        held += len(part)
                        if held >= words_at_once:
                            yield from flushed()
                            held, numbers = 0, known.setdefault(lang, _Numbers())
        yield from flushed()

    return count_words


class Prefixes(NamedTuple):
    """How the suffixes of a language are dealt out: to how many groups, and which prefixes are continued."""

    groups: int
    words: np.ndarray  # frequent words, sorted ids
    pairs: np.ndarray  # frequent pairs, sorted mixtures of both ids


def _mixed(*ids: np.ndarray) -> np.ndarray:
    mixed = np.zeros(len(ids[0]), np.uint64)
    for one in ids:
        mixed = (mixed ^ one) * _ODD
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _among(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    if len(chosen) == 0:
        return np.zeros(len(values), bool)
    return chosen[np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)] == values


def group_of(suffixes: list[np.ndarray], prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray]:
    """The group of each suffix (ids of its words, 0 for none), and whether its pair is continued."""
    pair = _mixed(*suffixes[:2])
    split = _among(pair, prefixes.pairs)
    mixed = np.where(_among(suffixes[0], prefixes.words), pair, _mixed(suffixes[0]))
    mixed = np.where(split, _mixed(*suffixes), mixed)
    return ((mixed >> np.uint64(20)) % np.uint64(prefixes.groups)).astype(np.int32), split


class _Frequent(dict):
    """Numbers from 1 for frequent words; 0 for the end of a piece and for words that the table knows to be rare.

    A wrong guess of the table only lets a suffix through.
    """

    def __init__(self, seed: int, bits: np.ndarray):
        self.seed, self.bits, self.ids = seed, bits, [0]
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        found = word_id(word, self.seed)
        number = 0
        if in_table(self.bits, found):
            number = len(self.ids)
            self.ids.append(found)
        self[word] = number
        return number


def _slices(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of ``values`` from each bound to the next."""
    offsets = pa.py_buffer((8 * bounds).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


IDS = [f"w{k}" for k in range(1, LONGEST + 1)]


def _dealing(seed: int, bits: np.ndarray, prefixes: dict[str, Prefixes], words_at_once: int):
    """The different suffixes of a part of a task by language and group: columns of word ids as bytes, and their number."""
    alone = Prefixes(1, np.empty(0, np.uint64), np.empty(0, np.uint64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Frequent] = {}
        runs: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in runs.items():
                ids = np.array(known[lang].ids, np.uint64)
                run = np.concatenate([*(run for run, _ in parts), np.zeros(LONGEST, np.int64)])
                own = np.concatenate([own for _, own in parts])
                starts = np.flatnonzero(own & (run[:-LONGEST] > 0) & (run[1 : 1 - LONGEST] > 0))
                if len(starts) == 0:
                    continue
                numbers = [run[starts], run[starts + 1]]
                for k in range(2, LONGEST):  # nothing follows the end of a piece
                    numbers.append(np.where(numbers[-1] > 0, run[starts + k], 0))
                high, low = (numbers[0] << 32) | numbers[1], (numbers[2] << 32) | numbers[3]
                order = np.lexsort((low, high))
                new = np.flatnonzero((np.diff(high[order], prepend=-1) != 0) | (np.diff(low[order], prepend=-1) != 0))
                n = np.diff(np.append(new, len(order)))
                suffixes = [ids[x[order[new]]] for x in numbers]
                group, split = group_of(suffixes, prefixes.get(lang, alone))
                place = 2 * group.astype(np.int64) + split
                order = np.argsort(place, kind="stable")
                place = place[order]
                first = np.flatnonzero(np.diff(place, prepend=-1))
                bounds = np.append(first, len(place))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(first), pa.string()),
                        pa.array(place[first] >> 1, pa.int32()),
                        pa.array((place[first] & 1).astype(bool)),
                        *(_slices(x[order], bounds) for x in suffixes),
                        _slices(n[order], bounds),
                    ],
                    ["lang", "group", "split", *IDS, "n"],
                )
            known.clear()
            runs.clear()

        for batch in batches:
            for lang, texts in _by_lang(batch):
                for text in texts:
                    found = words_of(text)
                    for start in range(0, len(found), words_at_once):
                        numbers = known.setdefault(lang, _Frequent(seed, bits))
                        # the words after a part are read with it, but begin suffixes of the next one
                        part = found[start : start + words_at_once + LONGEST - 1]
                        run = np.fromiter(map(numbers.__getitem__, part), np.int64, len(part))
                        runs.setdefault(lang, []).append((run, np.arange(len(part)) < words_at_once))
                        held += len(part)
                        if held >= words_at_once:
                            yield from flushed()
                            held = 0
        yield from flushed()

    return deal


def _subtrees(least: int):
    """The nodes of a group's subtree: phrases with the total of their leaves.

    Nodes above a prefix that is dealt out by whole suffixes are parts (``part``) of nodes
    whose other leaves are in other groups; all others are whole and rarer ones are left out.
    """

    def build(group: pa.Table) -> pa.Table:
        columns = [np.frombuffer(b"".join(group[name].to_pylist()), np.uint64) for name in IDS]
        n = np.frombuffer(b"".join(group["n"].to_pylist()), np.int64)
        split = np.repeat(group["split"].to_numpy(), [len(x) // 8 for x in group["n"].to_pylist()])
        order = np.lexsort(columns[::-1])
        columns, n, split = [x[order] for x in columns], n[order], split[order]
        new = np.zeros(len(n), bool)
        new[:1] = True
        out: list[list[np.ndarray]] = []
        for depth in range(1, LONGEST + 1):
            ids = columns[depth - 1]
            new[1:] |= ids[1:] != ids[:-1]
            first = np.flatnonzero(new)
            total = np.add.reduceat(n, first)
            part = split[first] & (depth < LONGEST)
            kept = (ids[first] > 0) & (part | (total >= least)) & (depth > 1)
            none = np.zeros(kept.sum(), np.uint64)
            nodes = [x[first[kept]] if k < depth else none for k, x in enumerate(columns)]
            out.append([*nodes, total[kept], part[kept]])
        *ids, f, part = (np.concatenate(x) for x in zip(*out))
        lang = pa.array([group["lang"][0].as_py()] * len(f), pa.string())
        return pa.table([lang, *map(_signed, ids), pa.array(f), pa.array(part)], ["lang", *IDS, "f", "part"])

    return build


def _words_and_pairs(texts: DataFrame, words_at_once: int, common_pair: int) -> tuple[DataFrame, int]:
    """lang, word, id, second and n; and the seed, with which no two words of a language have the same id."""
    for seed in count(42):
        schema = "lang string, word string, id bigint, second bigint, n bigint"
        found = texts.mapInArrow(_counting(seed, words_at_once, common_pair), schema)
        found = materialize(found.groupBy("lang", "word", "id", "second").agg(F.sum("n").alias("n")), "words-and-pairs")
        again = found.where("second IS NULL").groupBy("lang", "id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        if again.isEmpty():
            return found, seed


def _prefixes(words: DataFrame, pairs: DataFrame, budget: int) -> dict[str, Prefixes]:
    """How languages with more than ``budget`` words are dealt out.

    There is a row per ``budget`` words of the corpus at most, of languages, frequent words
    and frequent pairs each.
    """
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") > budget).collect()
    chosen: dict[str, tuple[list[int], list[int]]] = {row["lang"]: ([], []) for row in sizes}
    for row in words.where(F.col("n") > budget).select("lang", "id").toLocalIterator():
        chosen[row["lang"]][0].append(row["id"])
    for row in pairs.where(F.col("n") > budget).select("lang", "id", "second").toLocalIterator():
        chosen[row["lang"]][1].append((row["id"], row["second"]))
    found = {}
    for row in sizes:
        of_words, of_pairs = chosen[row["lang"]]
        both = np.array(of_pairs, np.int64).reshape(-1, 2).view(np.uint64)
        pair_keys = _mixed(both[:, 0], both[:, 1])
        found[row["lang"]] = Prefixes(
            -(-2 * row["n"] // budget), np.sort(np.array(of_words, np.int64).view(np.uint64)), np.sort(pair_keys)
        )
    return found


def phrase_counts(
    texts: DataFrame,
    least: int = 30,
    budget: int = BUDGET,
    words_at_once: int = WORDS_AT_ONCE,
    common_pair: int = COMMON_PAIR,
) -> tuple[DataFrame, DataFrame]:
    """All words: lang, word, id, n; and phrases of 2 to 4 words that occur ``least`` times: lang, w1 to w4 (ids, 0: none), f."""
    texts = in_batches(texts)
    counted, seed = _words_and_pairs(texts, words_at_once, common_pair)
    words, pairs = counted.where("second IS NULL").drop("second"), counted.where("second IS NOT NULL").drop("word")
    bits = bit_table(words.where(F.col("n") >= least), "id")
    prefixes = _prefixes(words, pairs, budget)
    deal = _dealing(seed, bits, prefixes, words_at_once)
    columns = ", ".join(f"{name} binary" for name in (*IDS, "n"))
    suffixes = texts.mapInArrow(deal, f"lang string, group int, split boolean, {columns}")
    ids = ", ".join(f"{name} bigint" for name in IDS)
    # as many tasks as there are groups, so that their size does not grow with the corpus
    n_tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(p.groups for p in prefixes.values()))
    dealt = suffixes.repartition(min(n_tasks, MOST_TASKS), "lang", "group")
    nodes = dealt.groupBy("lang", "group").applyInArrow(_subtrees(least), f"lang string, {ids}, f bigint, part boolean")
    nodes = materialize(nodes, "phrase-nodes")
    parts = nodes.where("part").groupBy("lang", *IDS).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return words, nodes.where("NOT part").drop("part").unionByName(parts)


def _phrase(*names: str) -> Column:
    """A struct of ``LONGEST`` ids: the named ones, then none."""
    ids = [F.col(name) for name in names] + [F.lit(0).cast("bigint")] * (LONGEST - len(names))
    return F.struct(*(x.alias(name) for x, name in zip(ids, IDS)))


def _cuts(phrases: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """lang, w1 to w4, a, and the lowest-scoring cut of each phrase."""
    cuts = F.array(
        *(
            F.struct(F.lit(k).alias("k"), _phrase(*IDS[:k]).alias("head"), _phrase(*IDS[k:]).alias("tail"))
            for k in range(1, LONGEST)
        )
    )
    exists = F.filter(cuts, lambda cut: cut["tail"]["w1"] != 0)
    cut = phrases.withColumnRenamed("f", "a").withColumn("cut", F.explode(exists))
    cut = cut.select("lang", *IDS, "a", "cut.k", "cut.head", "cut.tail")
    single = words.where(F.col("n") >= least).select("lang", F.struct(F.col("id").alias("w1"), *(F.lit(0).cast("bigint").alias(w) for w in IDS[1:])).alias("part"), F.col("n").alias("f"))
    parts = single.unionByName(phrases.select("lang", _phrase(*IDS).alias("part"), "f"))
    heads = parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l"))
    tails = parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r"))
    both = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr("CAST(2000000 AS DECIMAL(20, 0)) * a DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", *IDS, "a").agg(lowest).select("lang", *IDS, "a", "cut.l", "cut.r", "cut.score")


def _without_contained(candidates: DataFrame, phrases: DataFrame, percent: int) -> DataFrame:
    """The candidates that no longer phrase holds with ``percent`` of a hundred of their occurrences."""
    inner = [(i, j) for n in range(2, LONGEST) for i in range(LONGEST - n + 1) for j in [i + n]]
    held = F.array(*(F.struct(_phrase(*IDS[i:j]).alias("inner"), F.col(IDS[j - 1]).alias("last"), F.lit(j - i).alias("n")) for i, j in inner))
    length = F.lit(2) + (F.col("w3") != 0).cast("int") + (F.col("w4") != 0).cast("int")
    longer = phrases.where("w3 <> 0").withColumn("length", length).withColumn("held", F.explode(held))
    longer = longer.where("held.last <> 0 AND held.n < length")
    most = longer.groupBy("lang", *(F.col(f"held.inner.{name}").alias(name) for name in IDS)).agg(F.max("f").alias("longer"))
    joined = candidates.join(most, ["lang", *IDS], "left")
    exact = F.expr(f"CAST(longer AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {int(percent)}")
    return joined.where(F.col("longer").isNull() | ~exact).drop("longer")


def collocations(
    docs: DataFrame,
    least: int = 30,
    percent: int = 80,
    top: int = 2000,
    budget: int = BUDGET,
    words_at_once: int = WORDS_AT_ONCE,
    common_pair: int = COMMON_PAIR,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the best ``top`` phrases of each language.

    ``docs`` has lang and text; other columns are ignored. Letters A to Z are lowered,
    texts are cut at ``.,;:!?`` and line breaks into pieces and those at blanks and tabs
    into words. Candidates are phrases of 2 to 4 words that occur ``least`` times within
    pieces, overlaps included (a). A cut after some words gives l, r, the frequencies of
    both parts, and the score ``2000000 a / (l + r)`` rounded down; the lowest-scoring cut
    counts, of equal ones the first. A candidate goes if a longer one holds it that occurs
    ``percent`` of a hundred as often. The best are those of the highest score, then a,
    then the smallest phrase in the order of its bytes. n counts the language's words. A
    missing lang is ``und``, a missing text is empty; repeated rows count each; no
    documents, or none with frequent phrases, give no rows.

    All documents are read twice. A task sorts ``words_at_once`` words at a time and hands
    on each different suffix once. A group has ``budget`` suffixes in expectation, however
    common its words are, unless a pair that is rarer than ``common_pair`` in all parts of
    the corpus is more frequent than that.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words, phrases = phrase_counts(texts, least, budget, words_at_once, common_pair)
    best = _without_contained(_cuts(phrases, words, least), phrases, percent)
    order = [F.col("score").desc(), F.col("a").desc()]
    by_lang = Window.partitionBy("lang").orderBy(*order)
    best = best.withColumn("place", F.rank().over(by_lang)).where(F.col("place") <= top)  # all of a tie at the end
    best = materialize(best.drop("place"), "best-phrases")
    spelled = best.select("lang", *IDS, F.posexplode(F.array(*IDS)).alias("at", "id")).where("id <> 0")
    spelled = spelled.join(words.select("lang", "id", "word"), ["lang", "id"])
    in_order = F.sort_array(F.collect_list(F.struct("at", "word")))
    spelled = spelled.groupBy("lang", *IDS).agg(F.array_join(F.transform(in_order, lambda x: x["word"]), " ").alias("phrase"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    last = Window.partitionBy("lang").orderBy(*order, "phrase")
    ranked = best.join(spelled, ["lang", *IDS]).withColumn("place", F.row_number().over(last)).where(F.col("place") <= top)
    rank = F.col("place").cast("bigint").alias("rank")
    return ranked.join(totals, "lang").select("lang", rank, "phrase", "a", "l", "r", "n", "score")
