"""Captured bytes to text, with the encoding and what was damaged."""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.batches import slices
from tidemark.sources.regions import regions, shifted

# Byte order marks with their encodings; escapes that open ISO-2022-JP runs; Japanese encodings.
MARKS = [
    (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"),
    (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"),
]
ESCAPES = (b"\x1b$@", b"\x1b$B", b"\x1b$(D", b"\x1b(I")
JAPANESE = ("shift_jis", "cp932", "euc_jp")
# Damaged bytes allowed in a Japanese source (a share of its high bytes, within bounds).
DAMAGE_SHARE, LEAST_DAMAGE, MOST_DAMAGE = 50, 2, 64

_KANA = re.compile("[ぁ-ゖァ-ヺ]")
_OUTSIDE = re.compile("[^\x00-\x7f]")
_LABEL = re.compile(rb"""(?:charset|encoding)\s*=\s*["']?([\w.-]+)""", re.I)


def _named(data: bytes) -> list[str]:
    """Encodings that the head of the source claims, as codec names."""
    found = []
    for label in _LABEL.findall(data[:8192]):
        try:
            found.append(codecs.lookup(label.decode("ascii")).name)
        except (LookupError, UnicodeDecodeError):
            continue
    return found


def _marked_damage(data: bytes, encoding: str) -> tuple[str, int]:
    text = data.decode(encoding, "replace")
    return text, text.count("�")


def _japanese(data: bytes, named: list[str]):
    """The best Japanese reading, if a fourth of what is not ASCII is kana and little is damaged."""
    allowed = min(MOST_DAMAGE, max(LEAST_DAMAGE, sum(b > 127 for b in data) // DAMAGE_SHARE))
    readings = []
    for place, encoding in enumerate(JAPANESE):
        text, damaged = _marked_damage(data, encoding)
        kana, outside = len(_KANA.findall(text)), len(_OUTSIDE.findall(text))
        if damaged <= allowed and kana >= (2 if encoding in named else 8) and 4 * kana >= outside:
            readings.append((damaged, -kana, place, text))
    if readings:
        damaged, _, place, text = min(readings)
        return text, JAPANESE[place], "script", damaged
    return None


def _western(data: bytes, named: list[str]):
    for encoding in [*(n for n in named if n not in JAPANESE and n not in ("utf-8", "iso8859-1")), "cp1252"]:
        try:
            return data.decode(encoding), encoding, "fallback", 0
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("iso8859-1"), "iso8859-1", "fallback", 0


def read_bytes(data: bytes) -> tuple[str, str, str, int]:
    """(text, encoding, reason, damaged places). The first rule that holds decides.

    A byte order mark; escape runs; valid UTF-8; Japanese script; nodes or lines of different
    encodings; the named or a Western encoding.
    """
    for mark, encoding in MARKS:
        if data.startswith(mark):
            text, damaged = _marked_damage(data, encoding)
            return text, encoding, "mark", damaged
    if any(e in data for e in ESCAPES):
        text = "".join(r.text for r in shifted(data))
        return text, "iso2022_jp", "escape", text.count("�")
    try:
        return data.decode("utf-8"), "utf-8", "valid", 0
    except UnicodeDecodeError:
        named = _named(data)
    if found := _japanese(data, named):
        return found
    found = regions(data)
    if len({r.encoding for r in found}) > 1:
        return "".join(r.text for r in found), "mixed", "lines", 0
    return _western(data, named)


def decoded(files: DataFrame, key: str, content: str) -> DataFrame:
    """Rows (key, text, encoding, reason, damaged); null content gives nulls."""

    def run(batches):
        for batch in slices(batches, content):
            found = [(None,) * 4 if data is None else read_bytes(data) for data in batch.column(1).to_pylist()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "text", "encoding", "reason", "damaged"])

    rows = files.select(F.col(key).cast("long").alias(key), content)
    return rows.mapInArrow(run, f"`{key}` long, text string, encoding string, reason string, damaged long")


def repaired(title: Column, source_title: Column, encoding: str = "UTF-8") -> Column:
    """The source's title where the stored one is the same bytes read as Western; else the stored one."""
    misread = F.decode(F.encode(source_title, encoding), "ISO-8859-1")
    return F.when(title == misread, source_title).otherwise(title)
