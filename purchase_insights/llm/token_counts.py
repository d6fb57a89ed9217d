"""Token counts of documents, without token ids.

No piece of the vocabulary holds a blank after another character, so no merge reaches
from a word into the blanks before the next: a text's count is the sum over its
pre-tokens (a word with the blanks before it). Pieces are counted once for each
different pre-token of the corpus, and joined to the frequencies in each document.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchase_insights.llm.sampling import in_batches
from purchase_insights.sources.scratch import materialize

#: The mark that stands for a blank in the vocabulary; in a text it means the same.
BLANK = "▁"
WORDS = re.compile(r" *[^ ]+| +")
COUNTED_AT_ONCE = 200_000
ROWS_AT_ONCE = 100_000
#: Longer pre-tokens are known by a digest.
LONGEST_KEY = 64
#: Bytes that begin no character: a key that is a digest, and one that no pre-token has.
DIGEST, ROW = b"\xff", b"\xfe"
#: So many of the most frequent pre-tokens (of at most ``LONGEST_KEY`` bytes) are known to the tasks.
LISTED = 1 << 18


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first blank. The text itself begins with one more."""
    text = text.replace(BLANK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [word[1:] for word in WORDS.findall(" " + text)]
    return text.split(" ")


def _key(pre_token: str) -> bytes:
    """The UTF-8 bytes, or for a long one a mark and a digest of them."""
    text = pre_token.encode()
    return text if len(text) <= LONGEST_KEY else DIGEST + hashlib.sha256(text).digest()


class Pieces:
    """Counts the pieces of pre-tokens with a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_byte)
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(is_kind(i) for is_kind in special))
        if any(BLANK in piece.lstrip(BLANK) for piece in pieces) or "".join(model.encode(" a ", out_type=str)) != f"{BLANK * 2}a{BLANK}":
            raise ValueError("pieces reach across words, or blanks are not kept")
        # a lone blank cannot be given as a text, which gets a blank of its own
        self.lone = 1 if model.piece_to_id(BLANK) != model.unk_id() else len(BLANK.encode())

    def count(self, pre_tokens: list[str]) -> list[int]:
        ids = self.model.encode(pre_tokens, num_threads=1)
        return [len(x) if word else self.lone for x, word in zip(ids, pre_tokens)]


def _distinct(texts: DataFrame) -> DataFrame:
    """key, long (the pre-token where the key is a digest), n: each pre-token of the corpus once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            keys = [_key(word) for word in counts]
            long = [word if key[:1] == DIGEST else None for word, key in zip(counts, keys)]
            columns = [pa.array(keys, pa.binary()), pa.array(long, pa.string()), pa.array(counts.values(), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "long", "n"])

        for batch in batches:
            for text in batch["text"]:
                counts.update(pre_tokens(text.as_py() or ""))
                if len(counts) > COUNTED_AT_ONCE:
                    yield counted()
        yield counted()

    found = in_batches(texts).select("text").mapInArrow(count, "key binary, long string, n bigint")
    return found.groupBy("key", "long").agg(F.sum("n").alias("n"))


def piece_counts(texts: DataFrame, model_path: str) -> DataFrame:
    """key, n (occurrences) and pieces of each different pre-token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Pieces(model_path)
        for batch in batches:
            words = [long or key.decode() for key, long in zip(batch["key"].to_pylist(), batch["long"].to_pylist())]
            columns = [batch["key"], batch["n"], pa.array(counter.count(words), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "pieces"])

    return _distinct(texts).mapInArrow(count, "key binary, n bigint, pieces bigint")


def _listed(counted: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens: all with a frequency from some bound on, ``most`` at most."""
    short = counted.where(~F.startswith("key", F.lit(DIGEST)))
    size = F.floor(F.log2("n") * 16)  # a thousand sizes at most
    n_of_size = {r["size"]: r["k"] for r in short.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("k")).collect()}
    total, bound = 0, None
    for of_size in sorted(n_of_size, reverse=True):
        total += n_of_size[of_size]
        if total > most:
            break
        bound = of_size
    if bound is None:
        return {}
    chosen = short.where(size >= bound).select("key", "pieces").toArrow()
    return dict(zip((key.decode() for key in chosen["key"].to_pylist()), chosen["pieces"].to_pylist()))


def _frequencies(docs: DataFrame, listed: dict[str, int]) -> DataFrame:
    """Rows of doc_id, text_hash, key, times, n_bytes, known.

    One row per row of ``docs`` has its bytes and the pieces of its listed pre-tokens, and
    a key that nothing else has. The others have one of the other pre-tokens, how often
    it occurs in the text, and NULL bytes.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, times, sizes, known = [], [], [], [], []

            def listing() -> pa.RecordBatch:
                taken = pa.array(rows, pa.int64())
                out = pa.RecordBatch.from_pydict({
                    "doc_id": batch["doc_id"].take(taken),
                    "text_hash": batch["text_hash"].take(taken),
                    "key": pa.array(keys, pa.binary()),
                    "times": pa.array(times, pa.int64()),
                    "n_bytes": pa.array(sizes, pa.int64()),
                    "known": pa.array(known, pa.int64()),
                })
                for column in (rows, keys, times, sizes, known):
                    column.clear()
                return out

            for row, value in enumerate(batch["text"]):
                text = value.as_py() or ""
                pieces = 0
                for word, n in Counter(pre_tokens(text)).items():
                    of_word = listed.get(word)
                    if of_word is not None:
                        pieces += n * of_word
                        continue
                    rows.append(row)
                    keys.append(_key(word))
                    times.append(n)
                    sizes.append(None)
                    known.append(None)
                rows.append(row)
                keys.append(ROW + b"%d" % row)  # spread over the tasks of the join
                times.append(0)
                sizes.append(len(text.encode()))
                known.append(pieces)
                if len(rows) > ROWS_AT_ONCE:
                    yield listing()
            yield listing()

    source = in_batches(docs).select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_hash"))
    schema = "doc_id bigint, text_hash bigint, key binary, times bigint, n_bytes bigint, known bigint"
    return source.mapInArrow(find, schema)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, listed: int = LISTED) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``) of each row of ``docs``.

    ``docs`` has doc_id and text; other columns are ignored. ``model_path`` is a BPE model
    of sentencepiece that keeps blanks and joins no two words in a piece (else a
    ValueError); the counts are the library's, special strings being ordinary text. A
    missing or empty text has no bytes and tokens. Rows are told apart by doc_id and a
    hash of the text: repeated rows have the same counts, and are repeated.

    The pre-tokens of all documents are counted first. The pieces of the most frequent
    ones, ``listed`` at most, are known to the tasks and summed at once; the others are
    joined, so the list changes no result.
    """
    counted = materialize(piece_counts(docs, model_path), "pre-tokens")
    rows = _frequencies(docs, _listed(counted, listed))
    joined = rows.join(counted.select("key", "pieces"), "key", "left")
    copies = F.count("n_bytes")  # of a repeated row; each has the same pre-tokens
    other = F.coalesce(F.sum(F.col("times") * F.col("pieces")), F.lit(0))
    found = joined.groupBy("doc_id", "text_hash").agg(
        copies.alias("copies"),
        F.max("n_bytes").alias("n_bytes"),
        F.max("known").alias("known"),
        other.alias("other"),
    )
    n_tokens = F.col("known") + F.expr("other div copies")
    counts = found.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"), "copies")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return counts.withColumn("copy", each).drop("copies", "copy")
