from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from purchase_insights.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, part int, rank string, sequence_id string"


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [room for room in rooms if room >= length]
        room = min(fitting) if fitting else capacity
        if fitting:
            rooms.remove(room)
        rooms.append(room - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
    places, planned = defaultdict(list), Counter()
    for run in packing.plan_best_fit(counts, capacity):
        assert run.first_rank == planned[run.length]
        planned[run.length] += run.n_pieces
        for k in range(run.n_pieces):
            place = run.offset + k % run.per_sequence * run.length
            places[run.first_sequence + k // run.per_sequence].append((place, run.length))
    assert planned == counts
    for sequence in places.values():
        at = 0
        for place, length in sorted(sequence):
            assert place == at
            at += length
        assert at <= capacity
    assert len(places) == best_fit_decreasing(Counter(counts).elements(), capacity)


def test_plan_is_small_for_many_documents():
    counts = {length: 1_000_003 + 7 * length for length in range(1, 2049)}
    assert len(packing.plan_best_fit(counts, 2048)) < 70_000


DOCS = [
    (1, "Hello, World. It's <|startoftext|> a<|endoftext|>"),
    (2, None),
    (3, ""),
    (4, "É é ǅ İstanbul ΣΑΣ straße x\x1cy\x85z\t1234 日本語 don't!!. ,"),
    (5, "word " * 5000),
    (6, "x" * 30_000),
    (7, "same text here"),
    (7, "same text here"),
    (None, "no id, but text."),
    *((100 + k, "the cat " * (k % 37)) for k in range(300)),
]


def test_packed_documents(spark):
    docs = spark.createDataFrame([(i, t, 1, "a", "b") for i, t in DOCS], SCHEMA).repartition(5)
    found = packing.pack_documents(docs, PATH, capacity=64, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in DOCS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) == best_fit_decreasing([r.length for r in found], 64)


def test_no_documents(spark):
    found = packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert found.count() == 0


def test_words_are_forgotten_without_effect(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    known, tokenizer = packing._WordIds(PATH), Tokenizer.from_file(PATH)
    text = "One two three. Four, five six seven eight nine ten one two"
    for _ in range(3):
        known.learn(set(text.split(" ")))
        ids = b"".join(map(known.__getitem__, text.split(" ")))
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_texts_are_split_without_effect():
    """Random texts of marks, special tokens, blanks and letters that change when they are lowered."""
    rng = random.Random(3)
    letters = "aBcÉß. ,!?-_'\n\t 1٣\xa0İΣ\u0301K…日"
    words = ["<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "don't", "'S ", "a,b. c", "x., y", "_., ", "K. ", "İ, "]
    texts = ["".join(rng.choice(words if rng.random() < 0.15 else letters) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    known, tokenizer = packing._word_ids(PATH), Tokenizer.from_file(PATH)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    for text, words in zip(texts, packing._words(batch, known)):
        ids = b"".join(map(known.__getitem__, words))
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
