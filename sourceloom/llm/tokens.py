"""Token ids of whole texts, made by the tokenizers library with a bounded memory of recurring pieces.

A text is cut where a token border is certain: at ASCII white space for vocabularies that drop white space, and in front of
a single space between two other characters for byte-level ones.  The library encodes each new piece once per task; the
ids of a text are the ids of its pieces in order, exactly as for the whole text.
"""

from __future__ import annotations

import json
import re
import weakref
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame

# The splitting patterns of the two vocabulary kinds.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path(name: str) -> str:
    """Where the installed public vocabulary files are."""
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    shifted = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(shifted)}


def is_byte_level(spec: dict) -> bool:
    """Whether white space is part of the tokens (true) or dropped before (false)."""
    return spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel"


def space_pieces(text: str) -> list[str]:
    """Cut in front of every single space that stands between two characters that are not white space."""
    if re.search(r" \s", text) or re.search(r"[^\S ] ", text):
        return re.split(r"(?<=\S)(?= \S)", text)
    first, *others = text.split(" ")
    return [first, *[" " + p for p in others]]


SETTLED = 0x250  # below: characters whose classes, cases and normal forms have not changed between Unicode versions


def settled_pattern(byte_level: bool) -> str:
    """The splitting pattern for texts of settled characters only, with the classes spelled out."""
    import unicodedata
    kinds = {chr(c): unicodedata.category(chr(c))[0] for c in range(SETTLED)}
    spaces = " \t\n\x0b\x0c\r\x85\xa0"
    letters, numbers = ("".join(re.escape(c) for c, k in kinds.items() if k == kind) for kind in "LN")
    pattern = BYTE_PATTERN if byte_level else WORD_PATTERN
    for plain in (r"[\p{L}]", r"[\p{N}]"):
        pattern = pattern.replace(plain, plain[1:-1])
    return pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(
        r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")


class Remembered(dict):
    """Values made once per key by a method; of those not used for ``keep`` new keys, only the later half is kept.

    The method is held weakly: an owner without users is freed at once, with all it remembers.
    """

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.older = weakref.WeakMethod(make), keep, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make()(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.keep:
            self.older = dict(self)
            self.clear()


class PerWorker:
    """Built at first use.  As the value of a broadcast variable it lasts as long as the worker process, over many tasks."""

    def __init__(self, build, *args):
        self.build, self.args, self.made = build, args, None

    def __call__(self):
        if self.made is None:
            self.made = self.build(*self.args)
        return self.made


def per_worker(df: DataFrame, build, *args):
    """A broadcast of ``build(*args)``, which every worker process makes for itself."""
    return df.sparkSession.sparkContext.broadcast(PerWorker(build, *args))


class LibraryEncoder:
    """Ids by the tokenizers library; ``keep`` bounds the remembered pieces.

    Texts of settled characters are split into pre-tokens here and each new pre-token is encoded by the library's model.
    Other texts, and those that may hold special strings, go through the library's whole chain piece by piece.
    """

    def __init__(self, path: str, keep: int = 250_000):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.byte_level = is_byte_level(spec)
        self.findall = re.compile(settled_pattern(self.byte_level)).findall
        self.wide = re.compile(f"[^\\x00-{chr(SETTLED - 1)}]|<\\|").search
        self.chars, self.tokenize = byte_chars(), self.library.model.tokenize
        self.parts, self.pieces = Remembered(self._part, keep), Remembered(self._piece, keep)

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token by the library's own model."""
        mapped = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(self.chars)
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.wide(text):
            known = self.pieces
            units = space_pieces(text) if self.byte_level else [p.decode() for p in text.encode().split()]
        else:
            known, units = self.parts, self.findall(text if self.byte_level else text.lower())
        known.trim()
        return b"".join([known[u] for u in units])


def spans_of(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about so many characters, at least one text each."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if k > begin and size + len(text) > chars:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)
