import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from foliospark.llm import queries, token_counts

with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
    RAW = f.read()
LIBRARY = Tokenizer.from_str(RAW.decode())
#: What may meet at a boundary: marks that compose, white spaces of all kinds, special strings, contractions, digits.
ODD = ["abc", "Ü", "é", " ́", "́", "  ", "\n", "\xa0", "　", "1", "23", "'s", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>x", "—", "日本", "ΑΣ", "Σ́", "İ", "ﬀ", "̸", "=", "<", "\x1c", "\x85", "​", "it's", "...", "\r", "\x0b", "नमस्ते", "😀", "\0"]


def plain(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


def test_odd_texts_and_cuts():
    rng, counter = random.Random(1), token_counts.Counter(RAW)
    for _ in range(3000):
        text = "".join(rng.choice(ODD) + rng.choice(["", " ", "", "\t"]) for _ in range(rng.randint(0, 14)))
        parts = list(token_counts.cuts(text.encode(), 3))
        assert b"".join(parts) == text.encode()
        assert plain(text) == counter.texts(pa.array([text]))[0] == sum(counter.texts(pa.array([p], pa.binary()).view(pa.string()))[0] for p in parts)


def test_memory_of_chunks_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNKS", 20)
    monkeypatch.setattr(token_counts, "CALL", 50)
    rng, counter = random.Random(2), token_counts.Counter(RAW)
    for _ in range(60):
        texts = [" ".join(rng.choice(["to", "be", "or"]) + str(rng.randrange(40)) * rng.randrange(3) for _ in range(30)) + "x9" * rng.randrange(60) for _ in range(5)]
        assert counter.texts(pa.array(texts)).tolist() == [plain(t) for t in texts]
        assert len(counter.known) <= 20 >= len(counter.before)


def test_rows(spark, monkeypatch):
    long, solid = "Some words, 12 of them. " * 400_000, "ab1c" * 200_000
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (3, " \n ", None), (None, "<|endoftext|> hi", "c"), (4, long, "n"), (5, solid, "n"), (6, "x" * 5000, "n")]
    got = token_counts.count(spark.createDataFrame(rows, "n_tokens long, text string, `n.bytes` string"), RAW, ["n_tokens", "n.bytes"]).collect()
    unit = plain("Some words, 12 of them. ")
    want = [(i, t, len((t or "").encode()), 400_000 * unit if t is long else plain(t)) for i, t, _ in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.carried[0], r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(((i, b, n) for i, _, b, n in want), key=key)
    assert token_counts.count(spark.createDataFrame([], "doc_id long, text string"), RAW, ["doc_id"]).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op12_token_counts(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r.doc_id: (len((r.text or "").encode()), plain(r.text), plain(r.text) > 2048) for r in rows}


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError, match="can't be cut"):
        token_counts.check(f.read())
