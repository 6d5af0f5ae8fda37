"""The pipeline's stages against plain versions, each on its own input."""

import brute
import corpus_pipeline
from test_tokens import check_packed

from tidemark.llm import language_id


TEXT = "some words of text here"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}

    found = language_id.identify(docs, language_id.fit(docs)).where("not rejected")
    at = stages["language_id"](spark, docs, folder)
    want = {r.doc_id for r in found.collect()}
    assert {r.doc_id for r in at.collect()} == want and len(want) >= 0.98 * len(rows) and at.columns == docs.columns

    best = {}
    for i in want:
        best[brute.low(rows[i])] = max(i, best.get(brute.low(rows[i]), i))
    at = stages["exact_dedup"](spark, at, folder)
    want = set(best.values())
    assert {r.doc_id for r in at.collect()} == want and at.columns == docs.columns

    at = stages["near_dedup"](spark, at, folder)
    want = {i for i, (_, c) in brute.groups([(i, rows[i]) for i in want], 5, 80).items() if i == c}
    assert {r.doc_id for r in at.collect()} == want and at.columns == docs.columns

    at = stages["decontamination"](spark, at, folder)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want -= {i for i, *_ in brute.contained([(i, rows[i]) for i in want], items)}
    assert {r.doc_id for r in at.collect()} == want and at.columns == docs.columns

    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == want
    check_packed([(r.length, r.sequence_id, r.offset) for r in packed], 2048)


def test_stages_on_nulls_and_extra_columns(spark, folder):
    rows = [(1, None, "en"), (2, "", "en"), (3, None, None), (None, TEXT, "en"), (4, TEXT, "en"), (4, TEXT, "en")]
    docs = spark.createDataFrame([(*r, "s", None, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id long")
    want = {"language_id": [(4, TEXT), (4, TEXT), (None, TEXT)], "exact_dedup": [(4, TEXT)], "near_dedup": [(4, TEXT)], "decontamination": [(4, TEXT)]}
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, folder)
            rows = at.collect()
            if name in want:
                assert at.columns == docs.columns
                assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == (want[name] if table is docs else [])
            else:
                assert [(r.doc_id, r.piece, r.start, r.offset) for r in rows] == ([(4, 0, 0, 0)] if table is docs else [])
