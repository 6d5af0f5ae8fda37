"""Language, quality and licence models, and main-text extraction: held-out results and edge cases."""

import re
import zlib

from tidemark.llm import html_text, language_id, license_scan, quality, queries

FOLDER = "/root/testdata/sf0.01"
SHAPE = "doc_id long, text string, lang string, source string, id string, part string, at string, bucket string, host string, salt int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", "i", "p", "a", "b", "h", 1) for r in rows], SHAPE)


def test_language_of_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op10_language_id(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out == (r in held) and 0 <= got[r.doc_id].score <= 1 for r in docs)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert sum(got[r.doc_id].rejected for r in docs) <= 0.01 * len(docs)


def test_language_edges(spark):
    rows = [(k, "der die das und nicht mit" if k % 2 else "the and of to with not", "de" if k % 2 else "en") for k in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 ... !", "en"), (103, "漢字", None), (104, "und nicht das " * 20_000, None), (None, "the of and", None), (105, "×÷", "de")]
    docs = table(spark, rows)
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102, 105)] == ["und"] * 4 and all(got[k].rejected and got[k].score == 0 for k in (100, 101, 102))
    assert got[103].lang_pred in ("de", "en") and got[104].lang_pred == "de" and got[None].lang_pred == "en"
    left = language_id.keep_identified(docs, model)
    assert left.columns == docs.columns and not {100, 101, 102} & {r.doc_id for r in left.collect()}
    none = docs.limit(0)
    assert language_id.fit(none) is None and language_id.identify(none, None).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rows = [(k, f"word{k % 230}x letters{k % 230}y", f"l{k % 230:03}") for k in range(2300)]
    model = language_id.fit(table(spark, rows), sample_rows=1000)
    assert model.names == sorted({g for _, _, g in rows})


def test_averages_of_embeddings(spark):
    import numpy as np

    docs = table(spark, [(k, ("der die das " if k % 2 else "the and of ") + f"w{k}", "de" if k % 2 else "en") for k in range(80)])
    model = language_id.fit(docs)
    for text in ("der and das", "x", "the the the of"):
        raw = f" {''.join(c if c.isalpha() else ' ' for c in text)} ".encode()
        data = np.frombuffer(text.encode(), np.uint8)
        grams = np.concatenate([g for g, _ in language_id.subwords(data, np.array([0, len(data)]))])
        want = sum(b" " not in raw[i + 1 : i + n - 1] and len(raw[i : i + n]) == n for n in (3, 4) for i in range(len(raw)))
        assert len(grams) == want
        z = (np.mean([model.table[g] for g in grams], 0) if len(grams) else 0) + model.bias
        p = np.exp(z / model.heat) / np.exp(z / model.heat).sum()
        assert np.allclose(model.scores(data, np.array([0, len(data)]))[0], p, atol=1e-5)


def test_repeated_rows_of_the_classifiers(spark):
    docs = table(spark, [(k, "good words in a row ." if k % 2 else "$$ !! buy buy", "en" if k % 2 else "de") for k in range(40)] * 2)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] * 2, "doc_id long, quality int")
    found = {}
    for r in quality.score(docs, quality.fit(docs, labels)).collect():
        found.setdefault(r.doc_id, []).append(r.score)
    assert all(len(v) == 2 and v[0] == v[1] for v in found.values()) and len(found) == 40
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(docs, language_id.fit(docs)).collect()]
    assert len(got) == 80 and len(set(got)) == 40


def test_language_ignores_held_out_rows(spark):
    rows = [(k, "aaa bbb", "x") for k in range(40)]
    wrong = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 5 == 0 else g) for i, t, g in rows]
    assert language_id.fit(table(spark, wrong)).names == ["x"]


def auc(pairs):
    pairs = sorted(pairs)
    ones = [k for k, (_, y) in enumerate(pairs) if y]
    return (sum(ones) - len(ones) * (len(ones) - 1) / 2) / (len(ones) * (len(pairs) - len(ones)))


def test_quality_of_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op3_quality_classifier(spark, FOLDER).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    assert auc(held) >= 0.9


def test_quality_edges(spark):
    rows = [(k, "good words in a row ." if k % 2 else "$$ !! buy buy", "en") for k in range(60)] + [(100, None, "en"), (101, "", "en"), (102, "good words " * 30_000, "en"), (None, "x", "en")]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(70, None, 0), (None, 1, 1)], "doc_id long, quality int, text int")
    machine = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, machine).collect()}
    assert len(got) == len(rows) and got[1] > 0.5 > got[2] and got[100] == got[101]
    flipped = labels.withColumn("quality", (labels["doc_id"] >= 0).cast("int"))
    assert len({r.score for r in quality.score(docs, quality.fit(docs, flipped)).collect()}) == 1
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).first().score == 0.5
    assert quality.score(docs.limit(0), machine).count() == 0


def test_pairs_by_sums_of_squares():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 8192, 9)), rng.normal(size=quality.STATISTICS).astype(np.float32), k % 2, k % 5 == 0) for k in range(40)]
    m = quality.Machine(rows)
    data = np.frombuffer(b"one two, two THREE 4\n five", np.uint8)
    got = m.scores(data, np.array([0, len(data)]))[0]
    bucket, _, numbers = quality.features(data, np.array([0, len(data)]))
    x = m._dense([(bucket, numbers[0], 0, False)])[0][0].astype(float)
    at = np.flatnonzero(x)
    z = m.bias[0] + x @ m.weight + sum(x[i] * x[j] * (m.vector[i] @ m.vector[j]) for i in at for j in at if i < j)
    assert abs(got - 1 / (1 + np.exp(-(m.line[0] * z + m.line[1])))) < 1e-5


def test_licences(spark):
    filler = "An ordinary line of words about a river and a town.\n"
    cases = [
        (1, "MIT", "Released under the MIT License."), (2, "Apache-2.0", "Licensed under the Apache License, Version 2.0."), (3, "GPL", "This work is licensed under the GNU General Public License, version 3."),
        (4, "CC-BY", "Licensed under CC BY 4.0."), (5, "CC-BY-SA", "Licensed under CC BY-SA 4.0."), (6, "BSD", "note: Released under the BSD License."),
        (7, None, "She renewed her driving license in the spring."), (8, None, "Software is granted no permission here."), (9, None, None), (10, None, ""), (12, "LGPL", "Released under the LGPL license."),
    ]
    rows = [(i, None if t is None else filler * 3 + t + "\n" + filler, "en") for i, _, t in cases] + [(11, filler * 5000 + "Released under the MIT License.", "en"), (None, "Released under the MIT License.", "en")]
    docs = table(spark, rows)
    scanner = license_scan.fit(docs)
    got = {r.doc_id: r for r in license_scan.scan(docs, scanner).collect() if r.confirmed}
    assert {i: r.family for i, r in got.items()} == {i: f for i, f, _ in cases if f} | {11: "MIT", None: "MIT"}
    assert got[1].paragraph == 3 and got[11].paragraph == 5000
    assert license_scan.scan(docs.limit(0), scanner).count() == 0
    assert license_scan.scan(docs, license_scan.fit(docs.limit(0))).where("confirmed").count() == len(got)


def test_wrapped_licences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    cases = [(1, "A line.\n" + bsd), (2, bsd.replace("\n", "\n\n")), (3, "Released under the\r\nMIT\r\nLicense."), (4, "One.\nReleased under the MIT License.\nTwo.")]
    docs = table(spark, [(*c, "en") for c in cases])
    got = sorted((r.doc_id, r.paragraph, r.family) for r in license_scan.scan(docs, license_scan.fit(docs)).collect() if r.confirmed)
    assert got == [(1, 1, "BSD"), (3, 0, "MIT"), (4, 1, "MIT")]


def test_licences_without_cuts(spark):
    """Long lines, any wrap, several notices in a line, short names and reserved marks."""
    mit = "Released under the MIT License."
    permission = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    cases = [
        (1, "x " * 3000 + mit + " y" * 3000, {(0, "MIT", True)}), (2, "\n".join(mit.split()), {(0, "MIT", True)}), (3, "one\n" + re.sub(r"(\S+ \S+ \S+) ", r"\1\r\n", permission), {(1, "MIT", True)}),
        (4, mit + " Licensed under the Apache License, Version 2.0.", {(0, "MIT", True), (0, "Apache-2.0", True)}), (5, "Content is available under CC BY-SA 4.0.", {(0, "CC-BY-SA", False)}),
        (6, "BSD-3-Clause", {(0, "BSD", False)}), (7, "GPL version 3 or any later version", {(0, "GPL", False)}), (8, "Licensed under the EUPL, version 1.2. " + "word " * 200, {(0, "unknown", False)}),
        (9, "\x01Released under the\nMIT License.", {(0, "MIT", True)}), (10, mit + "\nplain\n" + mit, {(0, "MIT", True), (2, "MIT", True)}), (11, "\n".join(f"line {k} {mit}" for k in range(40)), {(k, "MIT", True) for k in range(40)}),
        (12, "\n\n" + mit, {(1, "MIT", True)}), (13, ("filler words " * 30 + mit + " ") * 3, {(0, "MIT", True)}),
    ]
    docs = table(spark, [(i, t, "en") for i, t, _ in cases] + [(100 + k, f"An ordinary line of words {k}.", "en") for k in range(30)])
    got = {}
    for r in license_scan.scan(docs, license_scan.fit(docs)).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, r.confirmed))
    assert {i: set(x) for i, x in got.items()} == {i: want for i, _, want in cases} and all(len(x) == len(set(x)) for x in got.values())


def test_wraps_against_plain_search(spark):
    """Notices at random places, wrapped at random, are found where their first word stands."""
    import random

    rng, cases, want = random.Random(5), [], set()
    fill = "river town walks seldom green over every small bridge".split()
    notices = [(f, t) for f, own in license_scan.NOTICES.items() for t in own]
    for i in range(120):
        family, notice = rng.choice(notices)
        words = rng.choices(fill, k=rng.randrange(60))
        at = len(words)
        words += notice.split() + rng.choices(fill, k=rng.randrange(60))
        line, lines, place = [], [], 0
        for k, w in enumerate(words):
            if k == at:
                place = len(lines)
            line.append(w)
            if rng.random() < 0.25:
                lines, line = [*lines, " ".join(line)], []
        text = rng.choice(("\n", "\r\n", "\r")).join([*lines, " ".join(line)] if line else lines)
        cases.append((i, text, "en"))
        want.add((i, place, family))
    docs = table(spark, cases)
    got = {(r.doc_id, r.paragraph, r.family) for r in license_scan.scan(docs, license_scan.fit(docs)).collect() if r.confirmed}
    assert len(want - got) <= 2 and len(got - want) <= 4, (want - got, got - want)


def test_notices_fit_into_windows():
    assert all(len(re.findall(license_scan.WORD, t.lower())) <= license_scan.STEP + 1 for own in license_scan.NOTICES.values() for t in own)


def bigrams(text):
    words = re.findall(license_scan.WORD, text.lower())
    return {*zip(words, words[1:])}


def test_every_notice_has_more_anchors_than_it_may_miss():
    for text in (t for own in license_scan.NOTICES.values() for t in own):
        words = re.findall(license_scan.WORD, text.lower())
        held = [any(a.strip() in f"{x} {y}" for a in license_scan.ANCHORS) for x, y in sorted(bigrams(text))]
        assert words and sum(held) > (1 - license_scan.CONFIRM) * len(held) - 1e-9, text


def test_other_licences_are_unknown(spark):
    filler = "An ordinary line of words about a river and a town."
    named = {1: "Licensed under the EUPL, version 1.2.", 2: "Released under the zlib license.", 3: "SPDX-License-Identifier: Zlib", 4: "This work is licensed under the Harbour Public License."}
    known = {5: ("SPDX-License-Identifier: MIT", "MIT"), 6: ("GPLv3 or later", "GPL")}
    plain = {7: filler, 8: "She renewed her driving license in the spring.", 9: "He was granted permission to modify the house.", 10: "The software company moved to a new town."}
    rows = [(i, t, "en") for i, t in (named | {i: t for i, (t, _) in known.items()} | plain).items()] * 2
    docs = table(spark, rows + [(100 + k, f"{filler} {k}", "en") for k in range(50)])
    got = sorted((r.doc_id, r.family, r.confirmed) for r in license_scan.scan(docs, license_scan.fit(docs)).collect())
    want = [(i, "unknown", False) for i in named] + [(i, f, True) for i, (_, f) in known.items()]
    assert got == sorted(want * 2)


def test_licences_of_the_query(spark):
    found = queries.op1_license_scans(spark, FOLDER)
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in found._jdf.queryExecution().toString()]
    notices = [(f, bigrams(t)) for f, own in license_scan.NOTICES.items() for t in own]
    want = set()
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        for k, line in enumerate(re.split("[\r\n]+", r.text or "")):
            held = bigrams(line)
            want |= {(r.doc_id, k, f) for f, own in notices if len(own & held) >= license_scan.CONFIRM * len(own)}
    rows = found.collect()
    assert rows and {(r.doc_id, r.paragraph, r.family) for r in rows if r.confirmed} == want
    assert len(rows) == len({(r.doc_id, r.paragraph) for r in rows}) <= 1.1 * len(want)


def test_main_text_on_edges(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>if (a < b) x('</p>')</script></head><body><nav><a>Home</a></nav><div class='cookie-banner'>We use cookies</div>"
        "<article><h1>The &amp; title</h1><p>One <b>bo</b>ld&nbsp;line<br>next</p><!-- no --><aside>Ad here</aside><p>Two &#233; &lt;x&gt;</p><form>Send</form></article>"
        "<section id=comments><p>First!</p></section><footer>(c)</footer></body></html>"
    )
    rows = [(1, "http://a.org/1", page), (2, "http://a.org/2", None), (3, None, ""), (4, "x", "plain words"), (5, "http://b.org", "<p>open <b>tags"), (None, "http://b.org/", "<div>n</div>"), (6, "http://c.org", "<p>" + "word " * 200_000 + "</p>")]
    df = spark.createDataFrame([(*r, "h", 1, "i") for r in rows], "page_id long, url string, html string, host string, salt int, id string")
    got = {r.page_id: r for r in html_text.main_texts(df).collect()}
    assert got[1].text == "The & title One bold line next Two é <x>" and got[1].n_chars == len(got[1].text)
    assert [got[k].text for k in (2, 3, 4, 5, None)] == ["", "", "plain words", "open tags", "n"] and got[6].n_chars == 999_999
    assert len(got) == len(rows) and html_text.main_texts(df.limit(0)).count() == 0


def test_parts_of_class_names_take_no_text_of_articles(spark):
    ten = "one two three four five six seven eight nine ten"
    pages = [f"<article><p>Start.</p><div class='share-price'>{ten}</div></article>", f"<div class='post notice-board'>{ten}</div>", f"<article><p>Start.</p><div class='share'>{ten}</div></article>", f"<div class='site-header'>{ten}</div><div class='post'>Start.</div>"]
    df = spark.createDataFrame([(k, f"http://h{k}.org", x) for k, x in enumerate(pages)], "page_id long, url string, html string")
    assert [r.text for r in sorted(html_text.main_texts(df).collect())] == [f"Start. {ten}", ten, "Start.", "Start."]


def test_repeated_stretches_go_where_the_structure_is_silent(spark):
    chrome = "home news about contact search the whole site map"
    pages = [(k, f"http://h.org/{k}", f"<div>{chrome}</div><div>{' '.join(f'own{k}x{j}' for j in range(12))}</div>") for k in range(5)]
    got = html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: " ".join(f"own{k}x{j}" for j in range(12)) for k in range(5)}


def test_repeated_stretches_go_inside_articles(spark):
    share = "share this story with friends by mail or post"
    pages = [(k, f"http://h.org/{k}", f"<article><p>{' '.join(f'own{k}x{j}' for j in range(12))}</p><p>{share}</p></article><main>beside{k} it</main><div>stray</div>") for k in range(5)]
    copy = "<article>" + " ".join(f"same{j}" for j in range(20)) + "</article>"
    pages += [(k, f"http://h.org/{k}", copy) for k in range(5, 9)]
    got = html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = {k: " ".join([*(f"own{k}x{j}" for j in range(12)), f"beside{k} it"]) for k in range(5)}
    assert {r.page_id: r.text for r in got} == want | {k: copy[9:-10] for k in range(5, 9)}


def test_repeats_are_settled_over_the_whole_host(spark):
    share = "share this story with friends by mail or post"
    own = {k: " ".join(f"own{k}x{j}" for j in range(12)) for k in range(400)}
    pages = [(k, f"http://{'h' if k % 2 else 'g'}.org/{k}", f"<article>{t}<p>{share if k in (1, 151, 301, 2, 152) else ''}</p></article>") for k, t in own.items()]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(8, "page_id")
    got = {r.page_id: r.text for r in html_text.main_texts(df).collect()}
    # Three pages of one host hold the line, but only two of the other.
    assert got == own | {k: f"{own[k]} {share}" for k in (2, 152)}


def test_suffix_array_against_windows():
    import random

    rng = random.Random(3)
    streams = [[rng.choice("ab") for _ in range(rng.randrange(30))] for _ in range(6)]
    run, want = html_text.RUN, []
    held = [{tuple(s[i : i + run]) for i in range(len(s) - run + 1)} for s in streams]
    for s in streams:
        flags = [False] * len(s)
        for i in range(len(s) - run + 1):
            if sum(tuple(s[i : i + run]) in h for h in held) >= html_text.PAGES:
                flags[i : i + run] = [True] * run
        want.append(flags)
    assert [list(x) for x in html_text.repeated(streams)] == want


def whole_host_texts(pages):
    """{page_id: text} by counting the stretches of whole hosts in plain Python."""
    import numpy as np

    run, parsed, held = html_text.RUN, {}, {}
    for i, url, source in pages:
        host = (url or "").split("://", 1)[-1].split("/")[0].split(":")[0].lower() if "://" in (url or "") else ""
        own = html_text.blocks(source or "")
        words = [w for _, t in own for w in t.split(" ")]
        parsed[i] = host, own, words
        for k in range(len(words) - run + 1):
            held.setdefault((host, *words[k : k + run]), set()).add(i)
    out = {}
    for i, (host, own, words) in parsed.items():
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - run + 1):
            if len(held[(host, *words[k : k + run])]) >= html_text.PAGES:
                gone[k : k + run] = True
        out[i] = html_text.main_text(own, gone)
    return out


def test_pages_of_few_words_against_counts(spark):
    import random

    rng = random.Random(8)
    pages = []
    for i in range(60):
        parts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(24))) for _ in range(rng.randrange(4))]
        pages.append((i, f"http://h{i % 3}.org/{i}", "".join(f"<{t}>{x}</{t}>" for t, x in zip(("div", "article", "p"), parts))))
    want = whole_host_texts(pages)
    for dealt in (1, 7):
        df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(dealt, "page_id")
        assert {r.page_id: r.text for r in html_text.main_texts(df).collect()} == want
    assert len(set(want.values())) > 20


def test_repeated_rows_are_pages_of_their_own(spark):
    pages = [(1, "http://h.org/", "<div>one two three four five six seven eight nine</div>")] * 3
    assert [r.text for r in html_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()] == [""] * 3


def test_pages_of_the_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html").collect()]
    rows = queries.op4_html_extraction(spark, FOLDER).collect()
    assert {r.page_id: r.text for r in rows} == whole_host_texts(pages) and len(rows) == len(pages)
    assert all(r.n_chars == len(r.text) > 0 for r in rows)
