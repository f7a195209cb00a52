"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a pre-token has one encoding, so one last token.  An automaton over all vocabulary strings gives the tokens
that end at a position, longest first; the one that is compatible with the last token of the prefix before it is the last
token of the longer prefix.  Following the stored tokens back from the end gives the ids.

Two tokens are compatible if encoding their concatenation gives these two again.  That is decided by undoing merges, the
later one first: the pair fails if, at some earlier state, the tokens at the border would have merged before that state ended.

Defined cases: null text has no ids and decodes to the empty string; special strings inside a text become their own ids;
repeated rows are encoded one by one; texts are never cut short; an empty table gives no rows.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import BYTE_PATTERN, WORD_PATTERN, Remembered, byte_chars, default_path, is_byte_level, per_worker, space_pieces, spans_of

END_SHIFT = 0x400  # a last character that carries the word-end mark becomes a character of its own
NEVER = 1 << 60


class PrefixCodec:
    """Encoder and decoder of one vocabulary file (byte-level, or words with end marks)."""

    def __init__(self, path: str, keep: int = 400_000):
        import unicodedata

        import ahocorasick
        import regex
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.byte_level, self.normal = is_byte_level(spec), unicodedata.normalize
        self.end = model["end_of_word_suffix"] or ""
        self.findall = regex.compile(BYTE_PATTERN if self.byte_level else WORD_PATTERN).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.chars = byte_chars()
        vocab = model["vocab"]
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.joined = spec["decoder"] is None  # without a decoder, token strings are joined by spaces
        self.bytes_of = {c: b for b, c in self.chars.items()}

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank, self.made, self.left, self.right = {}, {}, {}, {}
        for k, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x << 20 | y] = k
            self.made[z], self.left[z], self.right[z] = k, x, y
        self.sizes, self.automaton = {}, ahocorasick.Automaton()
        for token, i in vocab.items():
            units = self._units(token)
            if units:
                self.automaton.add_word(units, (i, len(units)))
                self.sizes[i] = len(units)
        self.automaton.make_automaton()
        self.compatible, self.parts, self.pieces = (Remembered(f, keep) for f in (self._fits, self._part, self._piece))

    def _units(self, token: str) -> str:
        """A token as one character per symbol."""
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + END_SHIFT)
        return token

    def _fits(self, pair: int) -> bool:
        """Whether encoding the text of two tokens (one number of both ids) gives the two tokens again."""
        a, b, made, limit = pair >> 20, pair & 0xFFFFF, self.made.get, NEVER
        while True:
            if self.rank.get(a << 20 | b, NEVER) < limit:
                return False
            made_a, made_b = made(a, -1), made(b, -1)
            if made_a > made_b:
                limit, a = made_a, self.right[a]
            elif made_b >= 0:
                limit, b = made_b + 1, self.left[b]
            else:
                return True

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token."""
        units = part.encode().decode("latin-1").translate(self.chars)
        if self.end:
            units = units[:-1] + chr(ord(units[-1]) + END_SHIFT)
        last, compatible = [-1] * len(units), self.compatible
        for at, (token, size) in self.automaton.iter(units):
            if last[at] >= 0:
                continue
            before = at - size
            if before < 0:
                last[at] = token
                continue
            if compatible[last[before] << 20 | token]:
                last[at] = token
        ids, at = [], len(units) - 1
        while at >= 0:
            ids.append(last[at])
            at -= self.sizes[last[at]]
        ids.reverse()
        return array("I", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not self.byte_level:
            # per character, as the vocabulary's own lower-casing knows no context
            piece = "".join([c.lower() for c in self.normal("NFC", piece)]) if not piece.isascii() else piece.lower()
        parts = self.parts
        return b"".join([parts[p] for p in self.findall(piece)])

    def _section(self, text: str) -> bytes:
        for memory in (self.pieces, self.parts, self.compatible):
            memory.trim()
        known = self.pieces
        return b"".join([known[p] for p in (space_pieces(text) if self.byte_level else map(bytes.decode, text.encode().split()))])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        sections = self.split(text) if self.split else [text]
        return b"".join([np.array([self.special[s]], dtype="<u4").tobytes() if s in self.special else self._section(s)
                         for s in sections])

    def decode(self, ids: bytes) -> str:
        """Text of the ids, special tokens included."""
        names = [self.names[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]
        if self.joined:
            return " ".join(names)
        # a special token stands for its own text, any other for its bytes
        raw = b"".join([n.encode() if n in self.special else bytes([self.bytes_of[c] for c in n]) for n in names])
        return raw.decode("utf-8", errors="replace")


def _codec_rows(shared):
    def run(batches):
        import pyarrow as pa
        codec = shared.value()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in spans_of(texts):
                ids = [codec.encode(t) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array([codec.decode(i) for i in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"])
    return run


def encode_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
                  keep: int = 250_000) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded text, for every whole text; a map without shuffle."""
    shared = per_worker(docs, PrefixCodec, path or default_path("word_bpe_49k.json"), keep)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _codec_rows(shared), "doc_id long, ids binary, decoded string")
