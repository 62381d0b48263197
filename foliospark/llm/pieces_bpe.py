"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly.

No piece has a space mark after another character and none holds a character that is no piece, so a
text divides into chunks (space marks and what follows up to the next mark or line end) that are
encoded on their own. Within a chunk: one scan by an Aho-Corasick automaton gives the longest piece that starts
at each position; it and the pieces that begin it are tried, longest first. A piece is taken if the pair with the piece
before it re-merges to just that pair and the position that it reaches has not failed; else a shorter one, else the position
is marked in the bitfield of failed ones and the piece before it is given up. Characters without a piece become byte pieces.

Defined results: null is the empty text, whose ids are the begin and end ids alone; repeated rows
each keep a row; a chunk of any length takes time in proportion to it; extra columns are ignored.
"""

from __future__ import annotations

import gc
import re
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, in_small_batches, pieces

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: The same where no piece has a letter beside another character but a space mark: letters are chunks of their own.
LETTER = r"[^\W\d_]"
WORD_CHUNK = re.compile(rf"{MARK}*{LETTER}+|{MARK}*(?:(?!{LETTER})[^{MARK}\n])+|{MARK}+|\n")
#: Chunks up to this length are remembered.
REMEMBERED = 64


class Recent(Memo):
    """A Memo of two generations: when one is full, what is not asked for during the next is forgotten."""

    def __init__(self, make, limit: int):
        super().__init__(make, limit // 2)
        self.older: dict = {}

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value


#: Chunks that a worker remembers.
CHUNKS = 800_000


class PieceCoder:
    """Encoder and decoder of one model, given as its bytes."""

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        special = {self.bos, self.eos, self.unk}
        for i, p in enumerate(self.pieces):
            if lib.is_byte(i):
                self.byte_of[i] = int(p[3:5], 16)
                self.byte_ids[self.byte_of[i]] = i
                special.add(i)
            elif lib.is_control(i) or lib.is_unknown(i):
                special.add(i)
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.letters = {p for p in self.ids if len(p) == 1}
        if any(c not in self.letters for p in self.ids for c in p) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("chunks of this model can't be encoded on their own")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            # What a longest match stands for: the piece and those that begin it, longest first, with their lengths.
            begun = tuple((self.ids[p[:m]], m) for m in range(len(p), 0, -1) if p[:m] in self.ids)
            self.automaton.add_word(p, (len(p) - 1, begun))
        self.automaton.make_automaton()
        order = {v: k for k, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: order[v] for p, v in self.score.items()}
        # No piece holds two characters that no piece has side by side: between them a chunk divides.
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        letter = lambda c: re.fullmatch(LETTER, c) is not None
        self.chunk = WORD_CHUNK if all(a == MARK or letter(a) == letter(b) for a, b in self.beside) else CHUNK
        self.pairs = Memo(self._fits, 1_000_000)
        self.parts = Recent(self._part, 100_000)
        self.chunks = Recent(self._code, CHUNKS)
        text = lambda i: bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in (self.bos, self.eos) else b" \xe2\x81\x87 " if i == self.unk else self.pieces[i].replace(MARK, " ").encode()
        self.text_of = [text(i) for i in range(n)]

    def forget(self, all_of_it: bool = False) -> None:
        """Gives back what is remembered of chunks; and of parts and pairs, if all_of_it."""
        for memo in (self.chunks, *([self.parts] if all_of_it else [])):
            memo.clear()
            memo.older = {}
        if all_of_it:
            self.pairs.clear()

    def merge(self, text: str) -> list[str]:
        """The model's own merges: again and again the adjacent pair whose union scores best, the leftmost first."""
        rank, none = self.rank.get, len(self.pieces)
        parts = list(text)
        unions = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while unions and (best := min(unions)) < none:
            k = unions.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del unions[k]
            if k:
                unions[k - 1] = rank(parts[k - 1] + parts[k], none)
            if k < len(unions):
                unions[k] = rank(parts[k] + parts[k + 1], none)
        return parts

    def _fits(self, pair: int) -> bool:
        a, b = (self.pieces[i] for i in divmod(pair, len(self.pieces)))
        return self.merge(a + b) == [a, b]

    def encode_chunk(self, chunk: str) -> list[int]:
        parts = self._divided(chunk)
        if len(parts) == 1:
            return self._part(chunk)
        return [i for part in parts for i in (self.parts[part] if len(part) <= REMEMBERED else self._part(part))]

    def _divided(self, chunk: str) -> list[str]:
        """Parts of a chunk between which no piece can stand."""
        if chunk[1:].isalpha() and self.letters.issuperset(chunk):
            return [chunk]  # words hardly divide
        beside = self.beside
        cuts = [k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in beside]
        return [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)] if cuts else [chunk]

    def _part(self, part: str) -> list[int]:
        """A part is one unknown character, as bytes, or pieces."""
        if part not in self.letters and len(part) == 1:
            return [self.byte_ids[b] for b in part.encode("utf-8", "replace")]
        return self._backtrack(part)

    def _backtrack(self, text: str) -> list[int]:
        n, pairs, width = len(text), self.pairs, len(self.pieces)
        longest: list[tuple[tuple[int, int], ...]] = [()] * n
        for end, (before_end, begun) in self.automaton.iter(text):
            longest[end - before_end] = begun  # ends rise, so the longest piece of each start comes last
        alive = bytearray(b"\1" * (n + 1))  # the bitfield: 0 where no way on was found
        taken: list[int] = []
        way: list[tuple[tuple[tuple[int, int], ...], int]] = []  # of each piece taken: the matches at its start and which of them it is
        pos, choice, before = 0, 0, -1
        matches = longest[0]
        while pos < n:
            count = len(matches)
            while choice < count:
                piece, size = matches[choice]
                if alive[pos + size] and (before < 0 or pairs[before * width + piece]):
                    break
                choice += 1
            if choice < count:
                taken.append(piece)
                way.append((matches, choice))
                pos, choice, before = pos + size, 0, piece
                if pos < n:
                    matches = longest[pos]
            else:
                if not taken:
                    raise ValueError("no encoding was found")
                alive[pos] = 0
                taken.pop()
                matches, choice = way.pop()
                pos -= matches[choice][1]
                choice += 1
                before = taken[-1] if taken else -1
        return taken

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text, the begin and end ids with them."""
        packed = self.packed(text)
        return [int.from_bytes(packed[k : k + 4], "little") for k in range(0, len(packed), 4)]

    def packed(self, text: str | None) -> bytes:
        """encode(), as little-endian unsigned 32-bit integers."""
        return self.bos.to_bytes(4, "little") + b"".join([x[0] for x in self._coded(text)]) + self.eos.to_bytes(4, "little")

    def _coded(self, text: str | None) -> list[tuple[bytes, bytes]]:
        """(packed ids, UTF-8 of what they stand for) of each chunk."""
        if not text:
            return []
        chunks = self.chunk.findall(MARK + text.replace(" ", MARK))
        if max(map(len, chunks)) <= REMEMBERED:
            return list(map(self.chunks.__getitem__, chunks))
        return [self.chunks[c] if len(c) <= REMEMBERED else self.chunks.make(c) for c in chunks]

    def _code(self, chunk: str) -> tuple[bytes, bytes]:
        ids = self.encode_chunk(chunk)
        return _packed(ids), self._show(ids)

    def _show(self, ids: list[int]) -> bytes:
        return b"".join([self.text_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces joined to characters (bytes that form none: U+FFFD each), control ids dropped, the mark that encoding put first dropped."""
        first = next((self.pieces[i] for i in ids if i not in (self.bos, self.eos)), "")
        return self._text([self._show(ids)], first.startswith(MARK))

    def _text(self, shown: list[bytes], marked: bool = True) -> str:
        whole = b"".join(shown)
        try:
            text = whole.decode()
        except UnicodeDecodeError:
            text = re.sub(rb"[\x80-\xff]+", lambda m: _lenient(m[0]), whole).decode()
        return text.removeprefix(" ") if marked else text

    def round_trip(self, text: str | None) -> tuple[bytes, str]:
        """(packed ids, the text that these ids decode to). Chunks decode on their own, as no character spans two."""
        coded = self._coded(text)
        return self.bos.to_bytes(4, "little") + b"".join([x[0] for x in coded]) + self.eos.to_bytes(4, "little"), self._text([x[1] for x in coded])


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _lenient(run: bytes) -> bytes:
    out, k = b"", 0
    while k < len(run):
        for n in (4, 3, 2):
            try:
                run[k : k + n].decode()
            except UnicodeDecodeError:
                continue
            out, k = out + run[k : k + n], k + n
            break
        else:
            out, k = out + b"\xef\xbf\xbd", k + 1
    return out


_CODERS: dict[int, PieceCoder] = {}


def coder(model: bytes) -> PieceCoder:
    """One coder of each model in a worker process."""
    key = hash(model)
    if key not in _CODERS:
        _CODERS[key] = PieceCoder(model)
        gc.freeze()  # the tables last as long as the process: no collection need pass through them
    return _CODERS[key]


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", chunks: int = 0) -> DataFrame:
    """Rows (id, ids_le binary, decoded string): the packed ids of each whole text and the text they decode to.

    chunks: how many a worker remembers, if not CHUNKS; then nothing is kept for its next task, for jobs that do much else with their memory.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a model file: under 1 MB whatever the corpus
    in_small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = coder(held.value)
        pieces_of.chunks.limit = (chunks or CHUNKS) // 2  # of each of its two generations
        for batch in pieces(batches):
            both = [pieces_of.round_trip(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in both], pa.binary()), pa.array([x[1] for x in both], pa.string())], ["id", "ids_le", "decoded"])
        pieces_of.forget(bool(chunks))  # the worker process goes on to other stages

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, ids_le binary, decoded string")
