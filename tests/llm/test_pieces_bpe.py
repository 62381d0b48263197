import hashlib
import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import pieces_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = pieces_bpe.PieceCoder(MODEL)


def same(text):
    want = LIB.encode(text, add_bos=True, add_eos=True)
    assert OWN.encode(text) == want, repr(text)
    assert OWN.decode(want) == LIB.decode(want), repr(text)
    assert OWN.round_trip(text)[1] == LIB.decode(want), repr(text)


def test_odd_texts():
    for text in ["", " ", "  ", "\n", "a", " a ", "▁", "▁▁a", "a\n\nb", "<s> </s> <unk> <0x41>", "\x00\x01", "émile 😀 日本語", "a" * 500, " " * 70 + "x", "=" * 333, "x" * 100 + "\t" + "1234567890" * 30, " \u0085�", "é"]:
        same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabtheinorsl  \n▁.,;0127éß中😀\x00"), max_size=60))
def test_any_text(text):
    same(text)


def test_pieces_run_together():
    rng = random.Random(7)
    pieces = [p.replace("▁", " ") for p in OWN.ids]
    for _ in range(4000):
        same("".join(rng.choices(pieces, k=rng.randint(1, 6))))


def test_bytes_that_form_no_character():
    for ids in ([1, 3 + 0xE4, 3 + 0xB8], [3 + 0xFF], [3 + 0xE4, 3 + 0xB8, 3 + 0xAD, 3 + 0x80, 2], [0, 5], []):
        assert OWN.decode(ids) == LIB.decode(ids)


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the cat", "x"), (3, "the cat", "x"), (None, "z " * 5000, "x")]
    out = pieces_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, id string"), MODEL).collect()
    assert len(out) == 5
    for r in out:
        text = {1: "", 2: "", 3: "the cat"}.get(r.id, "z " * 5000)
        want = LIB.encode(text, add_bos=True, add_eos=True)
        assert hashlib.sha256(bytes(r.ids_le)).digest() == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).digest()
        assert r.decoded == LIB.decode(want)
    assert pieces_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pieces_bpe.encode(docs, MODEL).collect():
        want = LIB.encode(texts[r.id], add_bos=True, add_eos=True)
        assert bytes(r.ids_le) == b"".join(i.to_bytes(4, "little") for i in want)
        assert r.decoded == LIB.decode(want)
