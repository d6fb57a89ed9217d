"""Token counts against the library on whole texts."""

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from purchase_insights.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)

TEXTS = [
    None, "", " ", "   ", "a", " a  b ", "two words", "tab\there\nline  end ", "▁x ▁▁ y▁", "<s> </s> <unk> <0x0A>",
    "ﬁ ①  日本語 テキスト 😀", "\x00 nul", "x" * 5000, "ab" * 300 + " " + "ab" * 300, " " * 500 + "end", "word " * 9000, "line\r\n\r\nline;\r",
]


def plain(rows, limit=4096):
    out = []
    for doc_id, text in rows:
        n = len(MODEL.encode(text or ""))
        out.append((doc_id, len((text or "").encode()), n, n > limit))
    return sorted(out, key=str)


@pytest.mark.parametrize("listed", [0, 5, token_counts.LISTED])
def test_against_library(spark, listed):
    rows = [*enumerate(TEXTS), (3, "other text"), (3, "other text"), (None, "no id"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, key int, pieces string").repartition(4)
    counted = token_counts.count_tokens(docs, PATH, listed=listed)
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, counted.collect()), key=str) == plain(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counted = token_counts.count_tokens(docs, PATH, listed=1000)
    assert sorted(map(tuple, counted.collect()), key=str) == plain(rows)


def test_no_documents(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab ▁\n\r\t;.ß日😀Ａ"), max_size=40) | st.text(max_size=40))
def test_pre_tokens(text):
    text = text.encode("utf-8", "replace").decode()
    words = token_counts.pre_tokens(text)
    assert "".join(" " + word for word in words) == (" " + text.replace("▁", " ") if text else "")
    assert sum(token_counts.Pieces(PATH).count(words)) == len(MODEL.encode(text))


def test_pieces_counted_once(spark):
    docs = spark.createDataFrame([(i, "same words here " * 20 + "q" * 100) for i in range(50)], "doc_id bigint, text string")
    counted = token_counts.piece_counts(docs.repartition(7), PATH).collect()
    # with a blank at the end of a run the last word has one more before it
    assert sorted((bytes(r.key)[:1], r.n) for r in counted)[:1] == [(b"h", 1000)] and len(counted) == 4


def test_other_models(monkeypatch):
    """A model with a piece that reaches across words is refused."""
    real = sentencepiece.SentencePieceProcessor.id_to_piece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda m, i: "▁to▁be" if i == 900 else real(m, i))
    with pytest.raises(ValueError, match="across words"):
        token_counts.Pieces(PATH)
