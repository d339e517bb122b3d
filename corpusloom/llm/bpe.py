"""BPE encoding and decoding (operator 9).

Encoding backtracks: an Aho-Corasick automaton gives the longest vocabulary token at every
position of a pre-token; a token is appended only if the pair-compatibility table says that
merging in rank order would leave the boundary between the two tokens alone, otherwise the
next shorter token is tried and, when none is left, the last token is taken back. Every
position is given up at most once, so the work is linear in the text. Decoding gathers bytes
through an offset table over one blob that holds all tokens.

Defined results: null counts as the empty text (no ids, decoded text empty). The special
token's own string in a text becomes its id, as the tokenizers library has it.
"""

from __future__ import annotations

import json
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.base import append_arrow, held, texts

#: Fixed: the pre-tokenizer's published pattern, with white space as Unicode's property.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Where splitting at single spaces could cut a run of white space.
RUNS = regex.compile(r"[\p{White_Space}]{2}|\p{White_Space}\Z")
#: Entries of a worker's cache before it starts anew, and letters of an entry at most; they bound memory, never results.
CACHE, CACHED = 150_000, 64
_MARKS = frozenset(".,!?;:")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 as itself, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary, from the bytes of its tokenizer file."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.piece = [b""] * size
        for word, i in vocab.items():
            self.piece[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.piece[i] = word.encode()
        self.size = size
        self.left, self.right = list(range(size)), list(range(size))
        self.pair: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            i = vocab[a + b]
            if i != 256 + rank:
                raise ValueError("token ids must follow the merge ranks")
            self.left[i], self.right[i] = vocab[a], vocab[b]
            self.pair[vocab[a] * size + vocab[b]] = i
        self.matcher = ahocorasick.Automaton()
        known = {}
        for i in vocab.values():
            known[self.piece[i].decode("latin-1")] = i
        for word, i in known.items():
            self.matcher.add_word(word, i)
        self.matcher.make_automaton()
        self.length = [len(p) for p in self.piece]
        self.shorter = [-1] * size
        for word, i in known.items():
            for n in range(len(word) - 1, 0, -1):
                if (j := known.get(word[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.compatible: dict[int, bool] = {}
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(self.piece), dtype=np.uint8)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pretokens: dict[str, bytes] = {}
        self.pieces = _Pieces(self)

    def fits(self, a: int, b: int) -> bool:
        """Whether rank-order merging leaves tokens ``a`` and ``b`` apart when they stand side by side."""
        key = a * self.size + b
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 2 * CACHE:
                self.compatible.clear()
            known = self.compatible[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        # Undo merges on both sides of the boundary, latest first; a pair across it that
        # would have been merged before the side was complete rules the boundary out.
        bound = self.size
        while True:
            joined = self.pair.get(a * self.size + b)
            if joined is not None and joined < bound:
                return False
            inner, outer = self.right[a], self.left[b]
            if inner == a and outer == b:
                return True
            if outer == b or (inner != a and a > b):
                bound, a = a, inner
            else:
                bound, b = b + 1, outer

    def encode_pretoken(self, word: str) -> list[int]:
        raw = word.encode("utf-8").decode("latin-1")
        n, length = len(raw), self.length
        longest = [0] * n
        for end, token in self.matcher.iter(raw):
            longest[end - length[token] + 1] = token  # later ends are longer
        if length[longest[0]] == n:
            return [longest[0]]
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not dead[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = self.shorter[token]
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = self.shorter[token]

    def pretoken(self, word: str) -> bytes:
        if len(word) > CACHED:
            own = self.encode_pretoken(word)
            return struct.pack(f"<{len(own)}I", *own)
        ids = self.pretokens.get(word)
        if ids is None:
            if len(self.pretokens) > CACHE:
                self.pretokens.clear()
            own = self.encode_pretoken(word)
            ids = self.pretokens[word] = struct.pack(f"<{len(own)}I", *own)
        return ids

    def encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.pretoken, PRETOKEN.findall(text)))

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_special and any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else self._encode(p) for k, p in enumerate(parts))
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        if RUNS.search(text):
            return self.encode_plain(text)
        # No two white space characters meet: each single space begins a pre-token.
        first, *rest = text.split(" ")
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        return self.encode_plain(first) + b"".join(map(self.pieces.__getitem__, rest))

    def decode_bytes(self, ids: bytes, step: int = 1 << 18) -> bytes:
        every, out = np.frombuffer(ids, dtype="<u4").astype(np.int64), []
        for i in range(0, len(every), step):
            own = every[i : i + step]
            start = self.offsets[own]
            size = self.offsets[own + 1] - start
            before = np.cumsum(size) - size
            out.append(self.bytes[np.repeat(start - before, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Pieces(dict):
    """From what stands between single spaces to the ids of it with the space before."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        # Letters, or letters and one closing mark, need no pattern to find their pre-tokens.
        if piece.isalpha():
            ids = self.bpe.pretoken(" " + piece)
        elif piece[-1:] in _MARKS and piece[:-1].isalpha():
            ids = self.bpe.pretoken(" " + piece[:-1]) + self.bpe.pretoken(piece[-1])
        else:
            ids = self.bpe.encode_plain(" " + piece)
        if len(piece) <= CACHED:
            self[piece] = ids
        return ids


def load(blob: bytes) -> Bpe:
    """The vocabulary, built once in each worker process."""
    return held(("bpe", hash(blob)), lambda: Bpe(blob))


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", *, decoded: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens`` (long) and ``ids`` (binary, little-endian unsigned 32-bit) of every whole ``text``.

    ``decoded`` adds ``decoded``: the text that the ids give back through the offset table.
    ``tokenizer`` is the path of a byte-level tokenizer file; it is read once, by the driver,
    and broadcast (its size is the file's, whatever the data). Null: no ids, empty text.
    """
    with open(tokenizer, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        bpe = load(blob.value)

        def work(column):
            ids = [bpe.encode(t) for t in texts(column)]
            out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            return [*out, pa.array([bpe.decode(x) for x in ids], pa.string())] if decoded else out

        return work

    fields = [("n_tokens", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary())]
    if decoded:
        fields.append(("decoded", T.StringType(), pa.string()))
    return append_arrow(df, [text], make, fields, keep)


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of binary ``ids``. Null ids: empty text."""
    with open(tokenizer, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        bpe = load(blob.value)
        return lambda column: [pa.array([bpe.decode(x or b"") for x in column.to_pylist()], pa.string())]

    return append_arrow(df, [ids], make, [("decoded", T.StringType(), pa.string())])
