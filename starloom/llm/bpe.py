"""BPE encoding and decoding by a backtracking encoder.

An Aho-Corasick automaton finds, at each position of a word that the encoder comes to, the longest token that starts there. The encoder takes it if
it is compatible with the token before, else tries the token's longest proper prefix that is a token itself, else steps back.
Two tokens are compatible if merging them from scratch gives those two tokens back. A word has one segmentation in which all
neighbours are compatible, and it is the one that the merge rules give; positions found to lead nowhere are never tried again,
so the time is linear in the word. Decoding gathers the tokens' bytes by a table of offsets.

Defined results: a null text is empty and an empty text has no tokens (and decodes to ""). Texts of any length are taken
whole; the memory for known words is bounded. Columns of the input are kept; a new column whose name clashes gets
underscores before it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from starloom.llm.common import free_name, small_batches

#: Unicode's White_Space property, at which the tokenizer cuts.
CHUNK = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The tokenizer's pattern for words, of chunks without white space (fixed values of the file format).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
WORD_END = "</w>"
#: Added to the code point of a word's last symbol.
LAST = 0x1000
#: Chunks, and pieces of chunks, that an encoder remembers at least; it remembers twice as many at most.
REMEMBERED = 250_000
NEVER = float("inf")
NONE = -1
#: Chunks in lower case that are one word, or a word and a mark: ASCII and Latin letters only, about which all versions of Unicode agree.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+([.,;:!?])?\\Z").match


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself if printable Latin-1, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Memo(dict):
    """A dict that computes what it lacks. When full it becomes the old generation, from which what is still in use returns."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Codec:
    """Encoder and decoder of a tokenizers file with a BPE model, byte alphabet and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*vocab.values(), *self.special.values())
        names = [""] * size
        for name, i in [*vocab.items(), *self.special.items()]:
            names[i] = name
        self.symbols = dict(enumerate(byte_alphabet()))
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        own = {i: self._symbols(n) for n, i in vocab.items() if i not in self.special.values()}
        self.length = {i: len(s) for i, s in own.items()}
        #: Right edge of a token: itself, its right part, that one's right part ..., each with the rank that absorbs it; likewise left.
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        for i, s in own.items():
            if len(s) == 1:
                self.right[i] = self.left[i] = [(i, NEVER)]
        for (a, b), (rank, i) in self.merge.items():
            if i not in self.right and a in self.right and b in self.right and self._crossing(a, b, rank) is None:
                self.right[i] = [(i, NEVER), (b, rank), *self.right[b][1:]]
                self.left[i] = [(i, NEVER), (a, rank), *self.left[a][1:]]
        reached = {own[i]: i for i in self.right}
        self.automaton = ahocorasick.Automaton()
        for s, i in reached.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        #: The longest proper prefix of a token that is a token.
        self.shorter = {i: next((reached[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in reached), None) for s, i in reached.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.chunks, self.pieces = Memo(self.chunk), Memo(self.piece)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.names = self._table([n.encode() for n in names])
        self.digits = self._table([str(i).encode() for i in range(size)])

    @staticmethod
    def _symbols(name: str) -> str:
        """A token's name with its word end folded into the last symbol."""
        if name.endswith(WORD_END) and len(name) > len(WORD_END):
            name = name[: -len(WORD_END)]
            return name[:-1] + chr(ord(name[-1]) + LAST)
        return name

    @staticmethod
    def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all rows, each followed by a blank; where each begins; its length with the blank."""
        length = np.array([len(r) + 1 for r in rows], np.int64)
        return np.frombuffer(b" ".join(rows) + b" ", np.uint8), np.cumsum(length) - length, length

    def _crossing(self, a: int, b: int, below: float) -> int | None:
        """The rank of a merge across the border of a and b that comes before both sides are complete, and before rank below."""
        for x, x_gone in self.right[a]:
            for y, y_gone in self.left[b]:
                m = self.merge.get((x, y))
                # Equal ranks merge from the left: x goes into its left neighbour first, y waits for the merge with x.
                if m and m[0] < below and m[0] < x_gone and m[0] <= y_gone:
                    return m[0]
        return None

    def fits(self, pair: tuple[int, int]) -> bool:
        if len(self.compatible) > REMEMBERED:
            self.compatible.clear()
        known = self.compatible[pair] = self._crossing(*pair, NEVER) is None
        return known

    def word(self, symbols: str) -> list[int]:
        """Ids of one word."""
        n = len(symbols)
        matches = self.automaton.iter_long
        # The longest match at each place where the one before ends; at other places it is looked for when a step back leads there.
        longest = {end - size + 1: i for end, (size, i) in matches(symbols)}
        out: list[int] = []
        nowhere: set[int] = set()
        length, shorter, known = self.length, self.shorter, self.compatible.get

        def fits(a: int, b: int) -> bool:
            found = known((a, b))
            return self.fits((a, b)) if found is None else found

        at, token = 0, longest[0]
        while at < n:
            after = at + length[token]
            if after not in nowhere and (not out or fits(out[-1], token)):
                out.append(token)
                at = after
                if at < n:
                    token = longest.get(at, NONE)
                    if token == NONE:
                        token = longest[at] = next(matches(symbols, at))[1][1]
            elif (less := shorter[token]) is not None:
                token = less
            else:
                nowhere.add(at)
                token = out.pop()
                at -= length[token]
        return out

    def piece(self, piece: str) -> bytes:
        """Ids of a piece in lower case, as 32-bit numbers."""
        s = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.symbols)
        return array("i", self.word(s[:-1] + chr(ord(s[-1]) + LAST))).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk without white space, as 32-bit numbers."""
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        # Lower case character by character: str.lower() would give a final sigma its own form.
        text = text.lower() if "\u03a3" not in text else "".join([c.lower() for c in text])
        if plain := PLAIN(text):
            return self.pieces[text[:-1]] + self.pieces[text[-1]] if plain[1] else self.pieces[text]
        return b"".join([self.pieces[p] for p in PIECE.findall(text)])

    def encode(self, text: str | None) -> np.ndarray:
        out: list[bytes] = []
        parts = self.cut.split(text or "") if self.cut and "<" in (text or "") else [text or ""]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(array("i", [self.special[part]]).tobytes())
            else:
                out += map(self.chunks.__getitem__, CHUNK.findall(part))
        return np.frombuffer(b"".join(out), np.int32)

    @staticmethod
    def gather(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
        """The rows of a table at ids, a blank between them."""
        blob, start, length = table
        n = length[ids]
        if not len(ids):
            return b""
        ends = np.cumsum(n)
        return blob[np.repeat(start[ids] - (ends - n), n) + np.arange(ends[-1])][:-1].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Names of the tokens, a blank between them, special ones too: the file has no decoder of its own."""
        return self.gather(ids, self.names).decode("utf-8")


@cache
def codec(path: str) -> Codec:
    """One per process."""
    return Codec(path)


@contextmanager
def borrowed(path: str) -> Iterator[Codec]:
    """A codec for a task. Afterwards the process lets go of it: the worker may serve other operators next, and building takes half a second."""
    c = codec(path)
    try:
        yield c
    finally:
        c.chunks.forget()
        c.pieces.forget()
        c.compatible.clear()
        codec.cache_clear()


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs and their ids (array of int); also what they decode to, in a column named by `decoded`, if it is given."""
    out = free_name(docs, to)
    back = free_name(docs, decoded) if decoded else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.int32())
        with borrowed(path) as c:
            for b in batches:
                texts = b.column(b.schema.names.index(text))
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    ids = [c.encode(t) for t in texts.slice(at, 256).to_pylist()]
                    more = {out: pa.array(ids, kind)} | ({back: pa.array([c.decode(i) for i in ids], pa.string())} if back else {})
                    yield pa.RecordBatch.from_arrays([*part.columns, *more.values()], names=[*part.schema.names, *more])

    fields = [StructField(out, ArrayType(IntegerType())), *([StructField(back, StringType())] if back else [])]
    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, *fields]))


def decode(docs: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """docs and the text of their ids; null ids give ""."""
    out = free_name(docs, to)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with borrowed(path) as c:
            for b in batches:
                column = b.column(b.schema.names.index(ids))
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    texts = pa.array([c.decode(np.array(x or [], np.int64)) for x in column.slice(at, 256).to_pylist()], pa.string())
                    yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, out])

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(out, StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, so that ids needn't leave the worker."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        with borrowed(path) as c:
            for b in batches:
                n, ids_sha, text_sha = [], [], []
                for at in range(0, b.num_rows, 256):
                    for t in b.column("text").slice(at, 256).to_pylist():
                        ids = c.encode(t)
                        n.append(len(ids))
                        ids_sha.append(hashlib.sha256(c.gather(ids, c.digits)).hexdigest())
                        text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
