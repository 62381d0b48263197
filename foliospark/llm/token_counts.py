"""Token counts of whole texts: what a tokenizer's ids would be is never kept, only how many there are.

Arrow batches are cut into parts of about equal bytes, not rows, and a text longer than a part is cut at safe
boundaries: before an ASCII white space or digit. Nothing that the tokenizer does reaches over one: normal forms
compose nothing with what stands before such a character, its pattern never matches across one, and the special
strings hold neither (`check` refuses a tokenizer of which that isn't true). A part's texts are then split at their
ASCII white spaces; the different chunks that a worker hasn't met are encoded in one batch, and a text's count is
the sum of its chunks'. A worker remembers the counts of a bounded number of chunks; that changes the time, not the result.

Defined results: null is the empty text, with no bytes and no tokens, as have white spaces alone; a null or repeated
id keeps its row; special strings inside a text are one token each, the library's default; bytes that are no UTF-8
count as replacement characters; no rows give no rows; extra columns are ignored, or carried in a struct whatever they are called.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, pieces

#: Bytes of text that are held at once; a text over it is cut at safe boundaries.
PART = 4_000_000
#: Half the chunks whose counts a worker remembers, and the longest of them in bytes.
CHUNKS, LONGEST = 300_000, 64
#: Bytes of chunks in one call of the library.
CALL = 500_000
_SAFE = re.compile(rb"[ \t-\r0-9]")
_DIGIT = re.compile(r"(?=[0-9])")


def check(tokenizer_json: bytes) -> None:
    """Raises ValueError unless counts of chunks between safe boundaries add up: white space dropped, digits alone, nothing put around a text."""
    told = json.loads(tokenizer_json)
    normal, split = json.dumps(told["normalizer"]), json.dumps(told["pre_tokenizer"])
    special = [t["content"] for t in told["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or _SAFE.search(t["content"].encode())]
    kinds = {k["type"] for k in (told["normalizer"] or {}).get("normalizers", [told["normalizer"] or {"type": "none"}])}
    if special or told["truncation"] or told["padding"] or not kinds <= {"NFC", "Replace", "Lowercase"} or "\\\\s+" not in normal or "[\\\\p{N}]|[^\\\\s" not in split or '"add_prefix_space": true' in split:
        raise ValueError("texts of this tokenizer can't be cut at white spaces and digits")


class Counter:
    """Counts of chunks, of which a bounded number is remembered."""

    def __init__(self, tokenizer_json: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        self.known: dict[bytes, int] = {}
        self.before: dict[bytes, int] = {}

    def encoded(self, chunks: list[bytes]) -> list[int]:
        """The number of tokens of each chunk, in calls of about equal bytes. Chunks over PART are cut before digits."""
        out: list[int] = []
        call, held = [], 0
        for k, chunk in enumerate(chunks):
            call.append(chunk.decode("utf-8", "replace"))
            held += len(chunk)
            if held >= CALL or k + 1 == len(chunks):
                if len(call[-1]) > CALL:
                    last = [x for x in _DIGIT.split(call.pop()) if x]
                    out += [len(e) for e in self.tokenizer.encode_batch_fast(call, add_special_tokens=False)]
                    out.append(sum(len(self.tokenizer.encode(x, add_special_tokens=False)) for x in last))
                else:
                    out += [len(e) for e in self.tokenizer.encode_batch_fast(call, add_special_tokens=False)]
                call, held = [], 0
        return out

    def chunks(self, different: list[bytes]) -> np.ndarray:
        """Counts of chunks that differ. What wasn't met since the last but one time that CHUNKS were held is encoded again."""
        new = [c for c in different if c not in self.known and c not in self.before]
        fresh = dict(zip(new, self.encoded(new), strict=True))
        counts = [fresh[c] if c in fresh else self.known[c] if c in self.known else self.before[c] for c in different]
        for c, n in zip(different, counts, strict=True):
            if len(c) <= LONGEST:
                if len(self.known) >= CHUNKS:
                    self.before, self.known = self.known, {}
                self.known[c] = n
        return np.array(counts, np.int64)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text; none may be null."""
        split = pc.ascii_split_whitespace(texts)
        ends = np.asarray(split.offsets).astype(np.int64)
        coded = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        if not len(coded):
            return np.zeros(len(texts), np.int64)
        counts = self.chunks(coded.dictionary.cast(pa.binary()).to_pylist())[coded.indices.to_numpy()]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return upto[ends[1:] - ends[0]] - upto[ends[:-1] - ends[0]]


def cuts(text: bytes, size: int = PART) -> Iterator[bytes]:
    """The text in parts of `size` bytes or a little more, each but the first beginning at a safe boundary."""
    start = 0
    while start < len(text):
        found = _SAFE.search(text, start + size)
        stop = found.start() if found else len(text)
        yield text[start:stop]
        start = stop


def count(docs: DataFrame, tokenizer_json: bytes, keep: list[str], text_col: str = "text") -> DataFrame:
    """Rows (carried, n_bytes, n_tokens), one for each row of docs; carried: the columns of `keep` in a struct."""
    check(tokenizer_json)
    given = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a file of a few MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in pieces(batches, PART):
            counter = counter or Counter(given.value)
            texts = batch.column(1)
            sizes = pc.binary_length(texts).cast(pa.int64())
            if batch.num_rows == 1 and sizes[0].as_py() > PART:
                whole = texts.cast(pa.binary())[0].as_py()
                n = np.array([sum(int(counter.texts(pa.array([part], pa.binary()).view(pa.string()))[0]) for part in cuts(whole))])
            else:
                n = counter.texts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(n)], ["carried", "n_bytes", "n_tokens"])

    told = docs.select(carried(keep), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return told.mapInArrow(run, T.StructType([told.schema["carried"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
