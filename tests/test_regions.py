"""Regions and shifted runs of made-up sources decode back, with their exact bytes."""

import random

from tidemark.sources import decoding as D
from tidemark.sources import regions as R

PIECES = {
    "utf-8": ["naïve café", "これは日本語です", "Ωmega ½"], "cp1252": ["naïve", "“quoted” text", "£5 für dich"],
    "shift_jis": ["これはテスト", "カタカナとひらがな"], "euc_jp": ["ぶんしょうです", "ひらがなとカタカナ"], "ascii": ["plain words", "1 < 2", ""],
}


def test_mixed_pages_decode_back_with_their_offsets(spark):
    rng, pages = random.Random(4), []
    for k in range(300):
        parts = [(e, rng.choice(PIECES[e])) for e in (rng.choice(list(PIECES)) for _ in range(rng.randrange(1, 8)))]
        data, text, at, want = b"", "", 0, []
        for encoding, piece in parts:
            node = rng.choice(("<p>", "\n", "<br class='x'>"))
            own = f"{piece}{node}"
            data += own.encode(encoding)
            text += own
            if encoding != "ascii" and not own.isascii() and (not want or want[-1][2] != encoding):
                want.append([at, len(data), encoding])
            at = len(data)
        if not want:
            want = [[0, len(data), "ascii"]]
        want[0][0] = 0
        for a, b in zip(want, want[1:]):
            a[1] = b[0]
        want[-1][1] = len(data)
        found = R.regions(data)
        assert "".join(r.text for r in found) == text, parts
        assert [[r.start, r.end, r.encoding] for r in found] == want, parts
        pages.append((k, bytearray(data), text))
    df = spark.createDataFrame([(k, d) for k, d, _ in pages] + [(-1, None), (-2, bytearray())], "k long, c binary")
    got = {r.k: r.text for r in R.joined(R.decoded_regions(df, "k", "c"), "k").collect()}
    assert got == {k: t for k, _, t in pages if t}


def test_ambiguous_labels_go_with_their_region():
    label = "日本".encode("shift_jis")
    around = "これはテスト<br>".encode("shift_jis")
    assert [r.encoding for r in R.regions(around + label)] == ["shift_jis"] and R.regions(around + label)[0].text.endswith("日本")
    assert [r.encoding for r in R.regions(label)] == ["cp1252"] or R.regions(label)[0].encoding == "iso8859-1"
    assert R.regions(b"\x81 \x8d") == [R.Region(0, 3, "iso8859-1", "\x81 \x8d")] and R.regions(b"") == []


def test_shifted_runs_decode_back():
    rng = random.Random(5)
    for _ in range(300):
        parts = [rng.choice(("日本語のテスト", "plain text ", "ｱｲｳ", "髙①㈱", "一 二\n")) for _ in range(rng.randrange(1, 6))]
        data = b""
        for p in parts:
            if p == "ｱｲｳ":
                data += b"\x1b(I" + bytes(ord(c) - 0xFF61 + 0x21 for c in p) + b"\x1b(B"
            elif "①" in p:
                pairs = p.encode("cp932")[2:]  # the first character is in no row of JIS
                cells = [(a - (0x81 if a < 0xA0 else 0xC1)) * 188 + b - (0x40 if b < 0x7F else 0x41) for a, b in zip(pairs[::2], pairs[1::2])]
                data += b"\x1b$B" + b"".join(bytes((c // 94 + 0x21, c % 94 + 0x21)) for c in cells) + b"\x1b(B"
            else:
                data += p.encode("iso2022_jp")
        want = "".join(p.removeprefix("髙") for p in parts)
        assert "".join(r.text for r in R.shifted(data)) == want
        assert D.read_bytes(data) == (want, "iso2022_jp", "escape", 0) or b"\x1b" not in data
        found = R.shifted(data)
        assert all(data[r.start : r.end].count(b"\x1b") == 0 for r in found) and [r.start for r in found] == sorted(r.start for r in found)


def test_shifted_runs_with_damage():
    text = lambda data: "".join(r.text for r in R.shifted(data))
    assert text(b"\x1b$BF|K\x1b(B.") == "日�." and text(b"\x1b$B\x22\x7f\x7e\x7e") == "��"
    assert text(b"\x1b$B!&lt;\x1b(B&lt;") == "ー&lt;" and text(b"\x1b$(D\x22\x2f") == "˘"
    assert text(b"caf\xe9, \xa35 x\xffy \xff\xff") == "café, £5 xÿy ��" and text(b"") == ""
