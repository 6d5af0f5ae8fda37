"""Bytes of several encodings in one source: shift states of ISO-2022-JP, and regions of a page that are each read on their own."""

from __future__ import annotations

import codecs
import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.batches import slices

# Escapes of ISO-2022-JP and what they designate; rows of JIS X 0208 that vendors filled.
DESIGNATIONS = {
    b"\x1b(B": "ascii", b"\x1b(J": "ascii", b"\x1b(I": "katakana", b"\x1b$@": "jis0208", b"\x1b$B": "jis0208", b"\x1b$(D": "jis0212",
}
VENDOR_ROWS = {0x2D, 0x79, 0x7A, 0x7B, 0x7C}
#: The name of the error handler for rows that the stock codec does not know.
VENDOR = "tidemark.vendor_rows"

_ESCAPE = re.compile(b"|".join(map(re.escape, DESIGNATIONS)))
_ENTITY = re.compile(rb"&(?:quot|apos|amp|lt|gt|#\d{2,3}|#[xX][0-9a-fA-F]{2});")
#: A Western letter inside or at the end of a word, or a currency, copyright or trade sign by a word or number.
_WESTERN = re.compile(rb"(?<=[A-Za-z])[\xc0-\xff](?![\x80-\xff])|[\x80\xa3\xa5\xa9\xae](?=[0-9 ])|(?<=[A-Za-z ])[\x91-\x97](?=[A-Za-z ]|\Z)")


def _vendor_row(error: UnicodeError):
    """A pair of an EUC-JP run that is in a vendor's row, by the code page that has it; any other is damage."""
    pair = bytes(b & 0x7F for b in error.object[error.start : error.start + 2])
    if len(pair) == 2 and pair[0] in VENDOR_ROWS and 0x21 <= pair[1] <= 0x7E:
        row, cell = divmod((pair[0] - 0x21) * 94 + pair[1] - 0x21, 188)
        moved = bytes((row + (0x81 if row < 31 else 0xC1), cell + (0x40 if cell < 63 else 0x41)))
        try:
            return moved.decode("cp932"), error.start + 2
        except UnicodeDecodeError:
            pass
    return "�", min(len(error.object), error.start + 2)


codecs.register_error(VENDOR, _vendor_row)


@dataclass(frozen=True)
class Region:
    """Bytes start to end of a source, the encoding they are read by, and their text."""

    start: int
    end: int
    encoding: str
    text: str


def _ascii(run: bytes) -> str:
    """ASCII, with Western letters where their neighbours show them; other high bytes are damage."""
    parts, at = [], 0
    for m in _WESTERN.finditer(run):
        parts += [run[at : m.start()].decode("ascii", "replace"), m[0].decode("cp1252", "replace")]
        at = m.end()
    return "".join([*parts, run[at:].decode("ascii", "replace")])


def _double(run: bytes, prefix: bytes) -> str:
    """Pairs of a shifted run. Blanks and controls stand for themselves; escaped ASCII characters are restored first, as they were made while shifted."""
    run = _ENTITY.sub(lambda m: html.unescape(m[0].decode()).encode(), run)
    out = []
    for part in re.split(rb"([\x00-\x20]+)", run):
        if part and part[0] > 0x20:
            whole, odd = part[: len(part) & ~1], len(part) & 1
            high = bytes(b | 0x80 for b in whole)
            if prefix:
                high = b"".join(prefix + high[k : k + 2] for k in range(0, len(high), 2))
            out.append(high.decode("euc_jp", "replace" if prefix else VENDOR) + "�" * odd)
        else:
            out.append(part.decode("ascii"))
    return "".join(out)


def shifted(data: bytes) -> list[Region]:
    """The runs of an ISO-2022-JP source between its escapes, in order; they start in ASCII. Damage is U+FFFD."""
    cuts = [(0, 0, "ascii"), *((m.start(), m.end(), DESIGNATIONS[m[0]]) for m in _ESCAPE.finditer(data))]
    ends = [c[0] for c in cuts[1:]] + [len(data)]
    out = []
    for (_, start, mode), end in zip(cuts, ends):
        run = data[start:end]
        if mode == "ascii":
            text = _ascii(run)
        elif mode == "katakana":
            text = "".join(chr(b - 0x21 + 0xFF61) if 0x21 <= b <= 0x5F else chr(b) if b <= 0x20 else "�" for b in run)
        else:
            text = _double(run, b"\x8f" if mode == "jis0212" else b"")
        if run:
            out.append(Region(start, end, mode, text))
    return out


# A node of a page, or a line of one. No trail byte of the encodings below is <, > or a line end.
_NODE = re.compile(rb"<[A-Za-z/!?][^<>]*>|[^<\n]+\n?|[<\n]")
_KANA = re.compile("[ぁ-ゖァ-ヺ]")
_JAPANESE = ("shift_jis", "euc_jp")


def _own(node: bytes) -> str | None:
    """The encoding that a node shows by itself: valid UTF-8 beyond ASCII, or strict Japanese with kana of three kinds or more."""
    for encoding in ("utf-8", *_JAPANESE):
        try:
            text = node.decode(encoding)
        except UnicodeDecodeError:
            continue
        kana = _KANA.findall(text)
        if encoding == "utf-8" or len(set(kana)) >= 3 and 4 * len(kana) >= sum(c > "\x7f" for c in text):
            return encoding
    return None


def _fits(node: bytes, encoding: str) -> bool:
    try:
        node.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def regions(data: bytes) -> list[Region]:
    """The source cut where its encoding changes; the regions' bytes follow each other and are all of it.

    Nodes that show their encoding decide. One that does not is Japanese like the decided
    node before it, if that is and the bytes fit, else Western. ASCII goes with what stands
    before it, or at the start with what follows.
    """
    found: list[list] = []  # [start, end, encoding]
    before = None
    for m in _NODE.finditer(data):
        encoding = None
        if not m[0].isascii():
            encoding = _own(m[0])
            if encoding:
                before = encoding
            else:
                encoding = before if before in _JAPANESE and _fits(m[0], before) else "cp1252"
        if found and (encoding in (None, found[-1][2]) or found[-1][2] is None):
            found[-1][1:] = m.end(), encoding or found[-1][2]
        else:
            found.append([m.start(), m.end(), encoding])
    out = []
    for start, end, encoding in found:
        run = data[start:end]
        if encoding == "cp1252" and not _fits(run, encoding):
            encoding = "iso8859-1"
        out.append(Region(start, end, encoding or "ascii", run.decode(encoding or "ascii")))
    return out


def decoded_regions(files: DataFrame, key: str, content: str, escapes: bool = False) -> DataFrame:
    """Rows (key, region, start, end, encoding, text): the regions of every source, or the runs between escapes.

    Null and empty content has no rows. Offsets count bytes.
    """
    names = ["region", "start", "end", "encoding", "text"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
    read = shifted if escapes else regions

    def run(batches):
        for batch in slices(batches, content):
            found = [(k, n, r.start, r.end, r.encoding, r.text) for k, data in enumerate(batch[content].to_pylist()) for n, r in enumerate(read(data or b""))]
            place, *columns = zip(*found) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(place, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], [key, *names])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, region int, start long, end long, encoding string, text string")


def joined(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, text, encodings, damaged): a source's regions in order."""
    parts = F.sort_array(F.collect_list(F.struct("region", "encoding", "text")))
    return rows.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.array_join(F.transform(parts, lambda p: p["encoding"]), ",").alias("encodings"),
        F.sum(F.regexp_count("text", F.lit("�"))).cast("long").alias("damaged"),
    )
