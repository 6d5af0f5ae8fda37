"""Token counts by heap-and-linked-list byte-pair merging, and token ids for packing.

A vocabulary file (a byte-level BPE in the ``tokenizers`` JSON form) is a parameter; tasks
read it by path, as an installed package's data file. Text is split as the file's library
splits it; each distinct piece is merged once per worker and remembered in a bounded table.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import struct
import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 600_000
#: Fixed value: the published pre-split pattern of this vocabulary family, with its letter, digit and other classes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{other}+|\s+(?!\S)|\s+"
_ALL = regex.compile(SPLIT.format(letter=r"\p{L}", digit=r"\p{N}", other=r"[^\s\p{L}\p{N}]"))


#: Below this character the standard module splits alike, in half the time, by classes spelled out.
SIMPLE_END = 0x558
_FAR = re.compile(f"[^\\0-{chr(SIMPLE_END - 1)}]")


def _class(kind: str) -> str:
    found = "".join(c for c in map(chr, range(SIMPLE_END)) if unicodedata.category(c)[0] == kind)
    return "".join(f"\\u{ord(c):04x}" for c in found)


_WHITE = r"\t-\r \x85\xa0"
_SIMPLE = re.compile(
    SPLIT.replace(r"(?!\S)", f"(?![^{_WHITE}])").replace(r"\s", f"[{_WHITE}]")
    .format(letter=f"[{_class('L')}]", digit=f"[{_class('N')}]", other=f"[^{_WHITE}{_class('L')}{_class('N')}]")
)


@functools.cache
def _newer() -> str:
    """Characters that this regex module knows as letters or digits and the library's older tables do not."""
    known = regex.compile(r"[\p{L}\p{N}]")
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and known.match(c))


@functools.cache
def _exact() -> tuple[regex.Pattern, regex.Pattern]:
    """Finds the newer characters; splits them as the library does, as neither letters nor digits."""
    new = f"[{_newer()}]"
    split = SPLIT.format(letter=rf"[\p{{L}}--{new}]", digit=rf"[\p{{N}}--{new}]", other=rf"(?:[^\s\p{{L}}\p{{N}}]|{new})")
    return regex.compile(new), regex.compile(split, regex.V1)


def pieces(text: str) -> list[str]:
    """The text's pieces before any merge."""
    if text.isascii() or not _FAR.search(text):
        return _SIMPLE.findall(text)
    new, exact = _exact()
    return (exact if new.search(text) else _ALL).findall(text)


@functools.cache
def _byte_names() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [names[b] if b in names else chr(next(spare)) for b in range(256)]


class Merges(dict):
    """Token count of each piece, by merging; filled as pieces are asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        self.rank = {tuple(p): k for k, p in enumerate(pairs)}
        self.special = [t["content"] for t in data["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[piece] = self.merged(piece)
        return n

    def merged(self, piece: str) -> int:
        """Initial symbols less merges. Pairs wait in a heap by rank, then place; symbols form a linked list."""
        names = _byte_names()
        symbol = [names[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(symbol)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank = self.rank
        heap = [(r, k, symbol[k], symbol[k + 1]) for k in range(n - 1) if (r := rank.get((symbol[k], symbol[k + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k]
            if j < 0 or symbol[k] != left or symbol[j] != right:
                continue
            merges += 1
            symbol[k], symbol[j] = left + right, None
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            after[j] = -1
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := rank.get((symbol[a], symbol[b]))) is not None:
                    heapq.heappush(heap, (r, a, symbol[a], symbol[b]))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string counts as that one token."""
        parts = self.split.split(text) if self.split else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, pieces(p))) for p in parts)


class Ids(dict):
    """Token ids of each piece as little-endian unsigned 32-bit bytes, by the library."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.model = library.model
        self.special = {t.content: k for k, t in library.get_added_tokens_decoder().items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.names = dict(enumerate(_byte_names()))

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        # A piece is split already, so the library's model alone, without its splitter, gives its ids.
        spelled = piece.encode("utf-8").decode("latin-1").translate(self.names)
        found = [self.special[piece]] if piece in self.special else [t.id for t in self.model.tokenize(spelled)]
        x = self[piece] = struct.pack(f"<{len(found)}I", *found)
        return x

    def encode(self, text: str) -> bytes:
        parts = self.split.split(text) if self.split else [text]
        return b"".join(b"".join(map(self.__getitem__, pieces(p) if k % 2 == 0 else [p])) for k, p in enumerate(parts) if p)


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


@functools.cache
def ids(path: str) -> Ids:
    return Ids(path)


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens) for every row of docs.

    Null and empty texts have no bytes and no tokens; long texts are counted whole, in
    time n log n of their longest piece; ids, null and repeated ones too, are carried; an
    empty table gives no rows; other columns are ignored. No row is shuffled.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches):
        table = merges(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "id": batch["id"],
                "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                "n_tokens": pa.array([table.count(t) if t else 0 for t in texts], pa.int64()),
            })

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_column)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): each text's ids and ``end``, cut where longer than capacity.

    Only longer documents are cut, into pieces of full capacity but for a shorter first.
    A null or empty text is one piece, of ``end`` alone; null and repeated ids are carried,
    a row's pieces each; texts are encoded whole; an empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        table = ids(vocabulary)
        for batch in batches:
            out = []
            for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                data = table.encode(text or "") + last
                n = len(data) // 4
                cut = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                out += [(key, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
            yield pa.RecordBatch.from_pydict({name: pa.array(x, pa.int64()) for name, x in zip(("id", "piece", "start", "length", "ids_crc32"), zip(*out))} if out else {name: pa.array([], pa.int64()) for name in ("id", "piece", "start", "length", "ids_crc32")})

    return rows.mapInArrow(run, "id long, piece long, start long, length long, ids_crc32 long")
