"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

In a byte-pair encoding every prefix of a word has exactly one possible last token:
the one token that ends the prefix, whose remaining prefix's last token it may
follow. An automaton over the vocabulary reports the tokens that end each prefix; two
tokens may follow each other if, as their merges are undone from the last to the
first, no earlier merge reaches across the seam. Back-pointers then give the ids.
New words of many texts take these steps together, byte by byte.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchase_insights.llm.sampling import in_batches

#: The pre-tokenizer's pattern: fixed values of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class is the same in every version of Unicode that the libraries have.
SETTLED = re.compile("[\x00-՗‐-⁯぀-鿯가-힣]*")
#: A blank that the next word doesn't take.
LOOSE_BLANK = re.compile(r" (?:\s|\Z)")
CACHED_WORDS = 250_000
LONGEST_CACHED = 64
#: Bytes of texts, more or less, that are encoded together, and ids that are decoded together.
BYTES_AT_ONCE = 2_000_000
IDS_AT_ONCE = 1_000_000
#: In place of a last token where a word begins.
BEGIN = -1
#: Words of at most so many bytes take their steps together, if there are enough of them.
SHORT, TOGETHER = 64, 200
#: Slots of the table of pairs of tokens.
PAIR_BITS = 21


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        byte_of = {char: byte for byte, char in _byte_characters().items()}
        ids = content["model"]["vocab"]
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, token)) for token, i in ids.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, token)
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        for rank, (left, right) in enumerate(content["model"]["merges"]):
            token = ids[left + right]
            self.merged[ids[left], ids[right]] = (rank, token)
            self.parts.setdefault(token, (rank, ids[left], ids[right]))
        usable = {
            text: token
            for token, text in self.bytes_of.items()
            if len(text) == 1 or self._reachable(token)
        }
        self.automaton = ahocorasick.Automaton()
        for text, token in usable.items():
            self.automaton.add_word(text.decode("latin-1"), (token, len(text)))
        self.automaton.make_automaton()
        self.length_of = np.zeros(max(self.bytes_of) + 1, np.int32)
        self.length_of[list(self.bytes_of)] = [*map(len, self.bytes_of.values())]
        self._tables(usable)
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.findall = regex.compile(PATTERN).findall
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.follows = _Pairs(self)
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)  # by hash; -1 is no pair
        self.pair_follows = np.zeros(1 << PAIR_BITS, bool)

    def _tables(self, usable: dict[bytes, int]) -> None:
        """The automaton as arrays: next states by state and byte, and the tokens that end there, longest first."""
        prefixes = sorted({text[:n] for text in usable for n in range(len(text) + 1)}, key=len)
        state_of = {prefix: state for state, prefix in enumerate(prefixes)}
        depth = np.array([*map(len, prefixes)])
        parent = np.array([state_of[prefix[:-1]] for prefix in prefixes])
        byte = np.array([prefix[-1] if prefix else 0 for prefix in prefixes])
        token = np.array([usable.get(prefix, -1) for prefix in prefixes])
        self.next_state = np.zeros((len(prefixes), 256), np.int32)
        self.longest = np.full(len(prefixes), -1, np.int32)
        self.shorter = np.full(len(self.length_of), -1, np.int32)  # by token
        fallback = np.zeros(len(prefixes), np.int32)  # the longest proper ending of a prefix that is one too
        for n in range(depth[-1] + 1):
            here, below = np.flatnonzero(depth == n), np.flatnonzero(depth == n + 1)
            if n > 1:
                fallback[here] = self.next_state[fallback[parent[here]], byte[here]]
            if n:
                self.next_state[here] = self.next_state[fallback[here]]
                self.longest[here] = np.where(token[here] < 0, self.longest[fallback[here]], token[here])
                ended = here[token[here] >= 0]
                self.shorter[token[ended]] = self.longest[fallback[ended]]
            self.next_state[parent[below], byte[below]] = below

    def _undone(self, left: int, right: int, horizon: float) -> bool:
        """Whether no merge of rank below ``horizon`` joins the end of left to the start of right."""
        while True:
            rank, _ = self.merged.get((left, right), (horizon, 0))
            if rank < horizon:
                return False
            left_rank, _, left_end = self.parts.get(left, (-1, 0, 0))
            right_rank, right_start, _ = self.parts.get(right, (-1, 0, 0))
            if left_rank < 0 and right_rank < 0:
                return True
            if left_rank > right_rank:
                horizon, left = left_rank, left_end
            else:  # of two equal merges the left one comes first, so the right one is undone first
                horizon, right = right_rank + 1, right_start

    def _reachable(self, token: int) -> bool:
        """Whether the bytes of a token are encoded as that token."""
        if token not in self.parts:
            return len(self.bytes_of[token]) == 1
        rank, left, right = self.parts[token]
        return self._undone(left, right, rank) and self._reachable(left) and self._reachable(right)

    def may_follow(self, left: int, right: int) -> bool:
        return left == BEGIN or self._undone(left, right, float("inf"))

    def _may_follow_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``may_follow`` of many pairs; a table keeps the last pair of each hash."""
        pairs = left.astype(np.int64) << 32 | right
        slots = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        found = self.pair_follows[slots]
        new = np.flatnonzero(self.pairs[slots] != pairs)
        if len(new):
            different, at = np.unique(pairs[new], return_inverse=True)
            found[new] = np.array([self.may_follow(p >> 32, p & 0xFFFFFFFF) for p in different.tolist()])[at]
            self.pairs[slots[new]], self.pair_follows[slots[new]] = pairs[new], found[new]
        return found

    def _encode_together(
        self, content: np.ndarray, starts: np.ndarray, lengths: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short words, one after the other, and their numbers; words are in order of length, longest first."""
        last_token = np.full((lengths[0] + 1, len(starts)), BEGIN, np.int32)
        state = np.zeros(len(starts), np.int32)
        for at in range(lengths[0]):
            n_longer = np.searchsorted(-lengths, -at)
            state = self.next_state[state[:n_longer], content[starts[:n_longer] + at]]
            words, token = np.arange(n_longer), self.longest[state]
            while len(words):
                if token.min() < 0:
                    raise ValueError("the vocabulary has no token for a byte")
                follows = self._may_follow_all(last_token[at + 1 - self.length_of[token], words], token)
                last_token[at + 1, words[follows]] = token[follows]
                words, token = words[~follows], self.shorter[token[~follows]]
        steps, words, at = [], np.arange(len(starts)), lengths
        n_ids = np.zeros(len(starts), np.int64)
        while len(words):
            token = last_token[at, words]
            steps.append((words, token))
            n_ids[words] += 1
            at = at - self.length_of[token]
            words, at = words[at > 0], at[at > 0]
        ends = np.cumsum(n_ids)
        ids = np.empty(ends[-1], np.int32)
        for k, (words, token) in enumerate(steps, 1):
            ids[ends[words] - k] = token
        return ids, n_ids

    def _encode_alone(self, word: str) -> bytes:
        text = word.encode().decode("latin-1")
        last_token = [BEGIN] * (len(text) + 1)  # by the length of a prefix
        follows, settled = self.follows, -1
        for end, (token, length) in self.automaton.iter(text):
            if end != settled and follows[last_token[end - length + 1] << 32 | token]:
                settled = end
                last_token[end + 1] = token
        ids, at = [], len(text)
        while at:
            ids.append(last_token[at])
            at -= len(self.bytes_of[ids[-1]])
        return np.array(ids[::-1], np.int32).tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word of the pre-tokenizer, as int32 bytes."""
        if len(words) < TOGETHER:
            return [self._encode_alone(word) for word in words]
        encoded = [word.encode() for word in words]
        lengths = np.array([*map(len, encoded)])
        order = np.argsort(-lengths, kind="stable")
        order = order[(lengths[order] <= SHORT) & (lengths[order] > 0)]
        found: list[bytes | None] = [None] * len(words)
        if len(order):
            content = np.frombuffer(b"".join(encoded), np.uint8)
            starts = (np.cumsum(lengths) - lengths)[order]
            ids, n_ids = self._encode_together(content, starts, lengths[order])
            ids_bytes, ends = ids.tobytes(), (4 * np.cumsum(n_ids)).tolist()
            for k, start, end in zip(order.tolist(), [0, *ends], ends):
                found[k] = ids_bytes[start:end]
        return [self._encode_alone(word) if ids is None else ids for word, ids in zip(words, found)]

    def encode_word(self, word: str) -> list[int]:
        return np.frombuffer(self._encode_alone(word), np.int32).tolist()

    def words(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return self.findall(text)
        return [text[start:end] for _, (start, end) in self.pre_tokenizer.pre_tokenize_str(text)]


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in set(printable)]
    return {byte: chr(byte) for byte in printable} | {byte: chr(256 + n) for n, byte in enumerate(others)}


class _Pairs(dict):
    """Whether the right one of two tokens may follow the left one, by ``left << 32 | right``; bounded."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, pair: int) -> bool:
        if len(self) >= 4 * CACHED_WORDS:
            self.clear()
        found = self[pair] = self.vocabulary.may_follow(pair >> 32, pair & 0xFFFFFFFF)
        return found


class _Memo:
    """Ids by word, bounded between batches: of two generations the older goes when the newer is full."""

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def make_room(self) -> None:
        if len(self.known) >= CACHED_WORDS:
            self.known, self.older = {}, self.known

    def missing(self, words: set[str]) -> set[str]:
        """Those that have to be encoded; the others are in ``known`` now."""
        new = words.difference(self.known)
        again = {word: self.older[word] for word in new if word in self.older}
        self.known |= again
        return new.difference(again)

    def learn(self, ids: dict[str, bytes]) -> list[str]:
        """Returns what is too long to be kept."""
        self.known |= ids
        return [word for word in ids if len(word) > LONGEST_CACHED]

    def forget(self, words: list[str]) -> None:
        for word in words:
            del self.known[word]


class _Cut(NamedTuple):
    """A text without special tokens, in the pre-tokenizer's words and what stands between the blanks after them."""

    words: list[str]
    chunks: list[str]


class Encoder:
    """Ids of whole texts as int32 bytes, with the ids of common words remembered."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.special = {text: np.int32(i).tobytes() for text, i in self.vocabulary.special.items()}
        self.of_word = _Memo()
        #: What stands between two blanks, with the blank before it.
        self.of_chunk = _Memo()
        bytes_of = self.vocabulary.bytes_of
        self.content = np.frombuffer(b"".join(bytes_of.values()), np.uint8)
        lengths = np.array([*map(len, bytes_of.values())])
        self.starts, self.lengths = np.zeros((2, max(bytes_of) + 1), np.int64)
        self.lengths[list(bytes_of)] = lengths
        self.starts[list(bytes_of)] = np.cumsum(lengths) - lengths

    def _cut(self, text: str) -> _Cut:
        """A blank belongs to the word after it unless white space or the end follows."""
        if LOOSE_BLANK.search(text):
            return _Cut(self.vocabulary.words(text), [])
        first, *rest = text.split(" ")
        return _Cut(self.vocabulary.words(first), rest)

    def _parts(self, text: str) -> list[_Cut | bytes]:
        pattern = self.vocabulary.special_pattern
        if pattern is None or not pattern.search(text):
            return [self._cut(text)]
        return [self.special[x] if x in self.special else self._cut(x) for x in pattern.split(text)]

    def _learn(self, words: set[str], chunks: set[str]) -> tuple[list[str], list[str]]:
        """Makes ids known; letters with at most one mark after them need no pattern. Returns the too long ones."""
        stems, marked, split = [], [], {}
        for chunk in self.of_chunk.missing(chunks):
            mark = chunk[-1] in ".,"
            stem = chunk[:-1] if mark else chunk
            if not (stem.isalpha() and (stem.isascii() or SETTLED.fullmatch(stem))):
                split[chunk] = self.vocabulary.words(" " + chunk)
            elif mark:
                marked.append(chunk)
            else:
                stems.append(chunk)
        stems += self.of_chunk.missing({chunk[:-1] for chunk in marked}.difference(stems))
        new = [*self.of_word.missing(words.union((".", ","), *split.values()))]
        ids = self.vocabulary.encode_words([*(" " + stem for stem in stems), *new])
        long_words = self.of_word.learn(dict(zip(new, ids[len(stems) :])))
        long_chunks = self.of_chunk.learn(dict(zip(stems, ids)))
        of_word, of_chunk = self.of_word.known, self.of_chunk.known
        composed = {chunk: of_chunk[chunk[:-1]] + of_word[chunk[-1]] for chunk in marked}
        composed |= {chunk: b"".join(map(of_word.__getitem__, x)) for chunk, x in split.items()}
        return long_words, long_chunks + self.of_chunk.learn(composed)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; words that the texts have in common are encoded once."""
        self.of_word.make_room()
        self.of_chunk.make_room()
        parts_of = [self._parts(text) for text in texts]
        cuts = [part for parts in parts_of for part in parts if isinstance(part, _Cut)]
        long_words, long_chunks = self._learn(
            set().union(*(cut.words for cut in cuts)), set().union(*(cut.chunks for cut in cuts))
        )
        of_word, of_chunk = self.of_word.known.__getitem__, self.of_chunk.known.__getitem__
        found = []
        for parts in parts_of:
            ids = []
            for part in parts:
                if isinstance(part, bytes):
                    ids.append(part)
                else:
                    ids += map(of_word, part.words)
                    ids += map(of_chunk, part.chunks)
            found.append(b"".join(ids))
        self.of_word.forget(long_words)
        self.of_chunk.forget(long_chunks)
        return found

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _content(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.content[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(lengths.sum())].tobytes()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids, which begin and end at the offsets."""
        content = b"".join(self._content(ids[k : k + IDS_AT_ONCE]) for k in range(0, len(ids), IDS_AT_ONCE))
        bounds = np.concatenate([[0], np.cumsum(self.lengths[ids])])[offsets].tolist()
        return [content[start:end].decode("utf-8", "replace") for start, end in zip(bounds, bounds[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int32), np.array([0, len(ids)]))[0]


#: The encoders of a worker process, by file: words stay known from task to task.
_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _some_at_once(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some ``BYTES_AT_ONCE`` of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.flatnonzero(np.diff(ends // BYTES_AT_ONCE, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


def encode_documents(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of each document, and on request the decoded text.

    ``path`` is a byte-level BPE file in the format of the tokenizers library. The
    ids are the library's without added special tokens; a special token's text inside
    a document is that token. A missing text is empty and has no ids; other columns
    are ignored and repeated rows repeated. ``decoded`` is made from the ids alone.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for some in _some_at_once(batch):
                encoded = encoder.encode_all([text or "" for text in some["text"].to_pylist()])
                ids = np.frombuffer(b"".join(encoded), np.int32)
                offsets = np.cumsum([0, *(len(x) // 4 for x in encoded)]).astype(np.int32)
                columns = {
                    "doc_id": some["doc_id"],
                    "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                }
                if decode:
                    columns["decoded"] = pa.array(encoder.decode_all(ids, offsets), pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, ids array<int>" + (", decoded string" if decode else "")
    return in_batches(docs).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, schema)
