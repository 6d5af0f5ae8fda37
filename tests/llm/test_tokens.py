"""Token counts and packing against the vocabulary's library, and edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, queries, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n \t x", "I'll don't we'VE 'sam", "a" * 3000, "ab" * 5000, " " * 500 + "x", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext", "naïve façade Ωmega",
    "漢字かな交じり文 한국어 текст", "٣٤ ½ ² Ⅷ ௧", "👩‍👩‍👧 é ​   　z", "\x00\x1f\x7f\x85", "ՠᲀẔa \U0001df00 \U00010d40 \U0001e5d0", "'s 's'S", "x  y   z \r\n\r\n q",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_and_pieces_on_edges(spark, library):
    rng = random.Random(2)
    chars = [chr(c) for c in (*range(32, 127), 9, 10, 13, *range(0xA0, 0x250), *range(0x370, 0x600), *range(0x1C80, 0x1CC0), *range(0x2000, 0x2070), *range(0x4E00, 0x4E40), *range(0x1F600, 0x1F640), *range(0x10D40, 0x10D90))]
    texts = TEXTS + ["".join(rng.choices(chars, k=rng.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame([(k, t, 0, "p") for k, t in enumerate(texts)], "doc_id long, text string, id long, piece string")
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(df, PATH).collect()}
    assert got == {k: (len((t or "").encode()), len(ids[k])) for k, t in enumerate(texts)}
    whole = {}
    for r in sorted(tokens.token_pieces(df, PATH, capacity=100).collect(), key=lambda r: (r.id, r.piece)):
        own = ids[r.id] + [0]
        part = own[r.start : r.start + r.length]
        assert len(part) == r.length <= 100 and (r.piece == 0 or r.length == 100) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r.start == whole.get(r.id, 0)
        whole[r.id] = r.start + r.length
    assert whole == {k: len(x) + 1 for k, x in enumerate(ids)}


def test_counts_of_the_query(spark, library):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_token_counts(spark, folder).collect()}
    n = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    assert got == {i: (len(t.encode()), n[i], n[i] > 512) for i, t in docs.items()}


def check_packed(rows, capacity):
    """Rows (length, sequence_id, offset) fill sequences without gaps; returns how many there are."""
    filled = {}
    for length, sequence, offset in sorted(rows, key=lambda r: (r[1], r[2])):
        assert offset == filled.get(sequence, 0)
        filled[sequence] = offset + length
    assert max(filled.values(), default=0) <= capacity
    return len(filled)


def test_packing_of_the_query(spark, folder, library):
    rows = queries.op9_best_fit_packing(spark, folder).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    n = check_packed([(r.length, r.sequence_id, r.offset) for r in rows], 2048)
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.piece):
        by_doc.setdefault(r.doc_id, []).append(r)
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(docs) == len(by_doc)
    for d in docs:
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 0]
        own = by_doc[d.doc_id]
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])) for r in own)
    large = sum(r.length > 1024 for r in rows)
    assert n <= max(large, -(-sum(r.length for r in rows) // 2048)) * 1.02 + 2


def test_plans(spark):
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.randrange(3, 60)
        counts = {s: rng.choice([0, 1, 2, 50]) for s in range(1, capacity + 1) if rng.random() < 0.6}
        kinds = packing.plan(counts, capacity)
        used = {}
        for n, own in kinds:
            assert n > 0 and sum(s * k for s, k in own) <= capacity and sum(k for s, k in own if s > capacity // 3) <= 2
            for s, k in own:
                used[s] = used.get(s, 0) + n * k
        assert used == {s: n for s, n in counts.items() if n}
        total = sum(s * n for s, n in counts.items())
        best = max(-(-total // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
        assert sum(n for n, _ in kinds) <= 1.5 * best + 1


def test_packing_ties_nulls_and_none(spark):
    df = spark.createDataFrame([(None, 5, 1), (1, 5, 2), (1, 5, 2), (2, 10, 3), (3, 1, 4)], "id long, length long, n long")
    rows = packing.pack(df, capacity=10).collect()
    assert check_packed([(r.length, r.sequence_id, r.offset) for r in rows], 10) == 3 and len(rows) == 5
    assert packing.pack(df.limit(0), capacity=10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 11), (2, None)], "id long, length long"), capacity=10)


def test_packing_with_clashing_columns(spark):
    names = "id piece row salt own rank before n key sequence_id offset".split()
    df = spark.createDataFrame([(3, *range(len(names))), (3, *range(len(names))), (7, *[None] * len(names))], "length long, " + ", ".join(f"`{c}` long" for c in names))
    rows = packing.pack(df, capacity=10).collect()
    assert check_packed([(r.length, r.sequence_id, r.offset) for r in rows], 10) == 2
    kept = ["length", *names[:-2]]
    assert rows[0].__fields__ == [*kept, "sequence_id", "offset"]
    assert sorted((tuple(r[c] for c in kept) for r in rows), key=repr) == sorted((tuple(r[c] for c in kept) for r in df.collect()), key=repr)


def test_counts_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "some words"), (1, "some words"), (None, None)], "doc_id long, text string")
    got = sorted(map(repr, map(tuple, tokens.count_tokens(docs, PATH).collect())))
    assert len(got) == 3 and got[0] == got[1] != got[2]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(none, PATH).count() == tokens.token_pieces(none, PATH).count() == 0
