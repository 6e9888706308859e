import math
import time

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from commitloom.llm import catalog, html, languages, licenses, quality, simhash, urls

SF = "/root/testdata/sf0.01"
words_of = st.lists(st.sampled_from(["a", "b", "c", "Dd", "#x"]), max_size=60)


@settings(max_examples=150, deadline=None)
@given(words_of)
def test_repeated_words_equal_all_windows(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    assert quality.repeated_words(words) == len(covered)


def test_statistics_of_odd_texts():
    assert quality.statistics(None)[:5] == quality.statistics("")[:5] == (0, 0, 0, 0, 0)
    text = "a b#\n\na b#\n \n $é"
    assert quality.statistics(text)[:5] == (5, 8, 3, 1, 0)
    assert quality.statistics("x " * 100_000)[:5] == (100_000, 100_000, 0, 0, 100_000)


def test_trees_are_monotonic_and_learn():
    random = np.random.default_rng(2)
    x = random.random((1500, 3))
    y = ((x[:, 0] < 0.5) ^ (random.random(1500) < 0.1)).astype(float)
    forest = quality.fit(x, y, np.array([-1, 1, 0]))
    assert ((forest.score(x) > 0) == (x[:, 0] < 0.5)).mean() > 0.95
    grid = np.repeat(x[:50], 30, axis=0)
    for column, sign in ((0, -1), (1, 1)):
        probe = grid.copy()
        probe[:, column] = np.tile(np.linspace(0, 1, 30), 50)
        assert (sign * np.diff(forest.score(probe).reshape(50, 30), axis=1) >= -1e-12).all()
    assert quality.fit(x[:0], y[:0], np.array([-1, 1, 0])).score(x).tolist() == [0.0] * 1500
    assert np.ptp(quality.fit(x, np.ones(1500), np.array([0, 0, 0])).score(x)) == 0


def test_quality_on_labelled_documents(spark):
    found = catalog.op9_quality_rules(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = found.join(labels, "doc_id").filter("not base_failed").toPandas()
    assert ((judged["score"] >= 0) == (judged["quality"] == 1)).mean() > 0.95
    docs = spark.createDataFrame([(None, None, "k"), (1, "", "k"), (1, "word " * 9, "k")], "doc_id long, text string, kept string")
    odd = quality.judge(docs, quality.train(docs, labels.limit(0))).collect()
    assert len(odd) == 3 and all(r.base_failed and not r.kept for r in odd)


def test_trees_are_fitted_on_one_text_of_each_key(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30 + 20 * i))) for i in range(8)]
    rows += [(0, " ".join(f"v{i}x{j}" for j in range(25))) for i in range(40)] + [(0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, signs: seen.append((x, y)))
    quality.train(docs, labels, limit=8)
    x, y = seen[0]
    assert sorted(np.expm1(x[:, 0]).round().astype(int).tolist())[-7:] == [50, 70, 90, 110, 130, 150, 170]
    assert len(y) == 8 and y.sum() == 4


def test_languages_on_held_out_documents(spark):
    found = catalog.op5_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = found.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97 and found.filter("score < 0 or score > 1").count() == 0


def test_language_mixtures_and_odd_texts(spark):
    sample = {"en": "the cat sat on the mat with the other cats and this is that ", "fr": "le chat est sur la table avec les autres chats et cela est "}
    rows = [(i, sample[lang] * 20, lang) for i, lang in enumerate(["en", "fr"] * 6)]
    model = languages.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [None, "", "123 !?", "1 le chat est sur la table avec les autres", sample["en"] * 30 + sample["fr"] * 20, "THE CAT SAT ON THE MAT"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    found = sorted(languages.identify(docs, model).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred for r in found] == ["und", "und", "und", "fr", "en", "en"]
    assert [len(r.languages) for r in found] == [0, 0, 0, 1, 2, 1]
    assert found[4].languages[1].share == pytest.approx(0.4, abs=0.1)
    nothing = languages.learn(docs.limit(0).withColumn("lang", F.lit("a")))
    assert {r.lang_pred for r in languages.identify(docs, nothing).collect()} == {"und"}


def plain_rule(host, path):
    best = ("", None, None)
    for verdict, name, start in urls.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start) and len(name + start) > len(best[0]):
            best = (name + start, name + start, verdict)
    return best[1:]


def test_urls(spark):
    given_urls = [None, "", "no-scheme.org/x", "http://A.Example.ORG/es/1?x", "http://example.org/en/17", "https://example.org", "x://y.com/de/?q", "http://notexample.org/es/",
        "http://www.cheappills.net/a", "http://freebets.example.net/en/3", "http://garden.example.net/en/3", "http://m.com/fr/x#://z", "http://a.net\n/x", "http://h?://b/c"]
    pages = [(None if u is None else i, u, None if i % 2 else "<title>cheap garden free pills</title>", "h") for i, u in enumerate(given_urls)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    found = urls.judge(table.union(spark.createDataFrame([(50, "http://garden.net/cheap/free", None, "")], table.schema))).collect()
    by_key = {r.page_id: r for r in found}
    for i, url in enumerate(given_urls):
        row = by_key[None if url is None else i]
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])]
        path = rest[len(host) :]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        assert (row.host, row.path) == (host, path)
        rule, verdict = plain_rule(host, path)
        assert row.rule == rule and (rule is None or row.verdict == verdict)
    assert [by_key[i].verdict for i in (8, 9, 10, 0 if 0 in by_key else 1)] == ["block", "block", "allow", "allow"]
    assert by_key[8].words[:3] == ["www", "cheap", "pills"]
    assert urls.judge(table.limit(0)).count() == 0


def test_urls_learn_from_all_words(spark):
    # more distinct words than 50 000, each of them rare
    letters = "bcdfghjklm"
    rare = ["q" + "".join(letters[int(c)] for c in f"{i:05d}") for i in range(52_000)]
    rows = [(i, f"http://garden.net/{w}/{w}", f"<title>{'x' * 2500} greenhouse</title>" if i == 0 else None) for i, w in enumerate(rare)]
    rows += [(60_000 + i, f"http://casino.net/{w}", None) for i, w in enumerate(rare[:40_000])]
    rows += [(-1, "http://zgreenhouse.net/", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in urls.judge(table).filter("page_id in (-1, 45000, 51999, 39999)").collect()}
    assert found[-1].words[:2] == ["z", "greenhouse"]
    assert found[51_999].words == ["garden", "net", "/" + rare[-1], "/" + rare[-1]]
    assert found[51_999].score == pytest.approx(found[45_000].score) and found[51_999].score < found[39_999].score


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">A</a><li>B</ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>{main}
<aside>Side</aside><section id="comments"><article class="comment"><p>First!</p></article></section>
<footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize(
    "main, text",
    [
        ("<article><h1>Head &amp; tail</h1><p><b>one\n two<br>three<p>four&nbsp;&lt;five&gt;</article>", "Head & tail\n\none two three\n\nfour <five>"),
        ("<article><div class='share-buttons'>Share</div><p>text</p><form>f <input></form><div class=cookie-notice>c</div></article>", "text"),
        ("<main><p>m</p></main>", "m"),
        ("<div class='post-content'><p>by class</p></div>", "by class"),
        ("<article><header><h1>Kept</h1></header><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><pre> a\n  b </pre></article>", "Kept\n\nx\n\ny\n\n1\n\n2\n\na b"),
        ("<article><p>cut off &#233;&#x41; <a href='x>y'>l</a>", "cut off éA l"),
        ("<article><p>open", "open"),
        ("<article></article>", ""),
    ],
)
def test_html_containers(main, text):
    found = next(html._parse(iter([__import__("pandas").DataFrame({"n": [0], "html": [PAGE.format(main=main)]})])))
    assert (found["text"][0] or "").split("\n\nSide")[0] == text


LONG_TEXT = "the long text of the page " * 5


@pytest.mark.parametrize(
    "main, text",
    [
        *((f"<div class='{c}'><article><p>body</p></article></div>", "body") for c in ("overflow-hidden", "has-sidebar", "no-comments", "sticky-header", "page widget", "modal")),
        ("<form id=aspnetForm><main><p>body</p><form>f</form></main></form>", "body"),
        ("<main><div class=widget><article><p>body</p></article></div></main>", "body"),
        (f"<main><p>{LONG_TEXT}</p><article class=teaser>next</article></main>", LONG_TEXT.strip() + "\n\nnext"),
        (f"<main><p>{LONG_TEXT}</p></main><article class=teaser>next</article>", LONG_TEXT.strip()),
        (f"<article class='post has-sidebar no-comments'>{LONG_TEXT}</article><div class=sidebar><article>next</article></div>", LONG_TEXT.strip()),
        ("<article><div class='share-price'>price</div><div class='site-footer'>no</div><p>body</p><div hidden>no</div></article>", "price\n\nbody"),
    ],
)
def test_html_names_around_containers(main, text):
    found = next(html._parse(iter([__import__("pandas").DataFrame({"n": [0], "html": [PAGE.format(main=main)]})])))
    assert found["text"][0] == text


def test_html_of_junk_names_only(spark):
    page = "<nav>menu</nav><div class='widget'><p>all the text there is</p></div><footer>us</footer>"
    found = html.extract(spark.createDataFrame([(1, "http://h.com/1", page)], "page_id long, url string, html string")).first()
    assert found.text == "all the text there is"


@pytest.mark.parametrize(
    "inside",
    [
        '<svg class="i"/><p>body</p>',
        "<svg class=i viewBox='a/>b' /><p>body</p>",
        "<math/><p>body</p>",
        "<svg><path d='M0'/><text>no</text></svg><p>body</p>",
        "<video-player></video-player><p>body</p>",
        "<object-list><p>body</p></object-list>",
        "<select-menu/><p>body</p>",
        "<video src=x><p>body</p>",
        "<iframe src=x></iframe ><script>no</script\n><p>body</p><script>no",
        "<p>body</p><style>no",
        "<svg ><p>body</p>",
    ],
)
def test_html_raw_elements_take_no_other_text(inside):
    page = "<html><body><article>" + inside + ("" if inside.endswith("no") else "</article></body></html>")
    assert [t for t, kind, junk in html.blocks(page) if kind and not junk] == ["body"]


def test_html_without_containers_by_host(spark):
    shared = "this banner line is found on every page of the host"
    pages = [(i, "http://h.com/%d" % i, f"<div>{shared}</div><p>page {i} has words that no other page has {i} {i} {i}</p><p>short {i}</p>") for i in range(5)]
    pages += [(10, "http://other.org/", f"<div>{shared}</div><p>x</p>"), (11, None, None), (12, "http://h.com/", ""), (0, pages[0][1], pages[0][2])]
    found = html.extract(spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, n int")).collect()
    texts = {(r.page_id, r.text) for r in found}
    want = {(i, f"page {i} has words that no other page has {i} {i} {i}\n\nshort {i}") for i in range(5)}
    assert texts == want | {(10, f"{shared}\n\nx"), (11, ""), (12, "")} and len(found) == len(pages)
    assert all(r.n_chars == len(r.text) for r in found)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


pages_of = st.lists(st.tuples(st.sampled_from(["h", "i"]), st.lists(st.lists(st.sampled_from("ab"), min_size=1, max_size=14), max_size=3)), min_size=1, max_size=24)


@settings(max_examples=60, deadline=None)
@given(pages_of, st.sampled_from([1, 40, 10**6]), st.booleans())
def test_suffix_arrays_find_all_repeats(pages, segment, is_open):
    import pandas as pd

    blocks = [[" ".join(b) for b in page] for _, page in pages]
    hosts = [host for host, _ in pages]
    page = [hash((host, *b)) for host, b in zip(hosts, blocks)]
    batch = pd.DataFrame({"host": hosts, "page": page, "known": 99, "open": is_open, "blocks": blocks})
    batch["n"], batch["named"], batch["kinds"], batch["junk"], batch["wide"] = range(len(pages)), False, blocks, blocks, blocks
    before, html._SEGMENT = html._SEGMENT, segment
    try:
        found, suffixes = pd.concat(html.repeats(iter([batch]))), pd.concat(html._suffixes(iter([batch])))
    finally:
        html._SEGMENT = before
    windows = {}
    for n, (host, b) in enumerate(zip(hosts, blocks)):
        words = " ".join(b).split()
        row = suffixes[suffixes["n"] == n]
        places, starts = ([v for values in row[c] for v in values] for c in ("places", "starts"))
        assert places == list(range(max(0, len(words) - 7)))
        for at, start in zip(places, starts):
            windows.setdefault((host, *words[at : at + 8]), (set(), set(), set()))
            for group, value in zip(windows[host, *words[at : at + 8]], (start, n, page[n])):
                group.add(value)
    keys = [start for starts, _, _ in windows.values() for start in starts]
    assert len(keys) == len(set(keys)) == len(windows)
    merged = found.groupby("start").agg({"low": "min", "high": "max", "held": "sum", "met": "sum"})
    for (host, *_), (starts, rows, texts) in windows.items():
        [start] = starts
        if is_open:
            assert tuple(merged.loc[start, ["low", "high"]]) == (min(texts), max(texts))
        if 2 * len(rows) > hosts.count(host):
            one = merged.loc[start]
            assert 10 * (2 * one["held"] - one["met"]) > hosts.count(host) - one["met"] and one["held"] <= len(rows)
    assert set(found["start"]) <= set(keys) and (not is_open or set(found["start"]) == set(keys))


def test_html_template_text_inside_containers_goes(spark):
    notice = "write to us if you have found an error on this page of ours"
    quoted = "a passage that four of the twelve articles quote word by word"
    unique = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    rows, want = [], {}
    for i in range(12):
        inside = f"<p>{unique(i)}</p>" + (f"<p>{quoted}</p>" if i < 4 else "")
        rows.append((i, f"http://h.example/{i}", f"<nav>menu</nav><article>{inside}<p>{notice}</p></article>"))
        want[i] = unique(i) + (f"\n\n{quoted}" if i < 4 else "")
    for i in range(20, 27):  # fewer pages than a template needs
        rows.append((i, f"http://small.example/{i}", f"<article><p>{unique(i)}</p><p>{notice}</p></article>"))
        want[i] = f"{unique(i)}\n\n{notice}"
    for i in range(40, 60):  # one article on all pages of a host, nearly the same or the same
        rows.append((i, f"http://copies.example/{i}", f"<article><h1>{i // 2}</h1><p>{unique(0)}</p><p>{quoted}</p></article>"))
        want[i] = f"{i // 2}\n\n{unique(0)}\n\n{quoted}"
    for i in range(60, 70):  # copies of a page are no template
        text = f"<p>{unique(min(i, 66))}</p><p>{notice if i > 63 else 'other'}</p>"
        rows.append((i, f"http://again.example/{i}", f"<article>{text}</article>"))
        want[i] = f"{unique(min(i, 66))}\n\n{notice if i > 63 else 'other'}"
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):
        assert {r.page_id: r.text for r in html.extract(table.repartition(parts)).collect()} == want


def test_containers_are_compared_by_what_the_host_does_not_repeat(spark):
    legal = "all that is written here is given without any warranty by those who wrote it " * 3
    rows = [(i, f"http://h.example/{i}", f"<main><p>{legal}</p><article><p>text {i} of its own</p></article></main>") for i in range(9)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {i: f"text {i} of its own" for i in range(9)}


def test_html_of_all_pages(spark):
    found = {r.page_id: r.text for r in catalog.op4_extract_html(spark, SF).collect()}
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = page.html.split("<article>")[1].split("</article>")[0]
        from html import unescape
        import re

        parts = [" ".join(unescape(re.sub("<[^>]*>", " " if "br" in p else "", p)).split()) for p in re.split("</?(?:p|h1)>", inside)]
        assert found[page.page_id] == "\n\n".join(p for p in parts if p)


def test_licences_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["op8_license_scan"]).fetchall(), key=repr)
    found = catalog.op8_license_scan(spark, SF).select("doc_id", "sentence_ids", "licences", "restricted")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert sum(bool(r[2]) for r in want) > 10


def test_licence_rules_and_odd_texts(spark):
    names = {i: s for s, i in licenses.SENTENCES.items()}
    texts = [None, "", "nothing here", names["MITperm"].title() + ".\n" + names["MITnotice"] + "!", " ".join(names[i] + "." for i in ("Apache2ref", "ApacheUse", "ApacheCopy")),
        "Licensed under\nthe MIT License. x\nReleased under the MIT license", names["BSDsource"] + ".\nOther words here.\n" + names["AllRights"]]
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, licences string")
    found = {r.doc_id: (r.licences, r.restricted) for r in licenses.scan(docs).collect()}
    assert found == {0: ([], False), 1: ([], False), 2: ([], False), 3: (["MIT"], False), 4: (["Apache-2.0"], False), 5: (["MIT"], False), 6: (["Proprietary"], True)}
    assert all(any(stem in s for stem in licenses.STEMS) for s in licenses.SENTENCES)


GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.

"""
GPL_COPY = """You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def licence_cases():
    def comment(mark, text):
        return "".join(f"{mark}{line}".rstrip() + "\n" for line in text.split("\n"))

    gpl3, gpl2 = GPL.format(":", ",", 3) + GPL_COPY, GPL.format(";", ";", 2) + GPL_COPY.replace(".  If", "; if")
    cases = [(gpl3, ["GPL-3.0-or-later"]), (gpl2, ["GPL-2.0-or-later"]), (GPL_COPY, ["GPL"]), (MIT, ["MIT"]), (APACHE, ["Apache-2.0"]), (MPL, ["MPL-2.0"])]
    cases = [(form, want) for text, want in cases for form in (text, text.replace("\n", "\r\n"), *(comment(m, text) for m in ("# ", " * ", "// ", ";; ", "dnl ")))]
    cases += [
        ("This software is licensed under the MIT License.", ["MIT"]),
        ("This software is not licensed under the MIT License.", []),
        ("Licensed under the MIT License\nCopyright 2020", ["MIT"]),
        ("We wrote about how it was licensed under the MIT License and later was not.", []),
    ]
    return cases


def test_licences_of_wrapped_notices(spark):
    cases = licence_cases()
    docs = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [found[i].licences for i in range(len(cases))] == [want for _, want in cases]
    assert all(found[i].restricted == any("GPL" in w for w in want) for i, (_, want) in enumerate(cases))
    assert found[28].sentence_ids == ["Apache2ref", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]


def test_the_licence_sql_knows_every_sentence_and_rule(spark):
    sentence = {i: t for t, i in reversed((licenses.SENTENCES | licenses.FURTHER_SENTENCES).items())}
    texts = [t for t, _ in licence_cases()]
    for pattern, _ in (*licenses.RULES, *licenses.FURTHER_RULES):
        said = ". ".join(sentence[i].capitalize() for i in pattern) + "."
        wrapped = "".join(w + ("\n * " if n % 7 == 6 else " ") for n, w in enumerate(said.split()))
        texts += [said, f"Some words. {said}\n\nMore words; and {said} The end", " * " + wrapped, said.replace(". ", ".\n\n"), "It is not " + said]
    texts += [" ".join(s.split()[:-1]) + "." for s in sentence.values()] + [f"x {s} y." for s in sentence.values()] + [f"HTTPS v. 2 {s};" for s in sentence.values()]
    texts += [None, "", " ", "rem Licensed under CC BY 4.0\nremark licensed under CC BY 4.0! dnl", "a. v? licen; \"All rights reserved.\" (All rights reserved!) all rights reserved"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.scan(docs).collect()
    got = sorted((r.doc_id, ",".join(r.sentence_ids), ",".join(r.licences), r.restricted) for r in found)
    documents = docs.toArrow()  # noqa: F841  read by the SQL
    want = sorted(duckdb.connect().execute(f"SELECT doc_id, sentence_ids, licences, restricted FROM ({licenses.scan_sql()})").fetchall())
    assert got == want
    assert {x for _, ids, _, _ in got for x in ids.split(",")} == {"", *sentence}
    assert {x for _, _, names, _ in got for x in names.split(",")} == {"", *(n for _, n in (*licenses.RULES, *licenses.FURTHER_RULES))}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=9), st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=5), st.integers(1, 50), max_size=8))
def test_a_split_is_the_cheapest_of_all(name, counts):
    total = sum(counts.values()) or 1

    def price(words):
        return sum(-math.log(counts[w] / total) if w in counts else math.log(total * 10) + 2.3 * len(w) for w in words)

    every = []
    for cuts in range(1 << (len(name) - 1)):
        words = [""]
        for i, letter in enumerate(name):
            words[-1] += letter
            if cuts >> i & 1 and i < len(name) - 1:
                words.append("")
        every.append(words)
    found = urls.split(name, counts, total)
    assert "".join(found) == name and math.isclose(price(found), min(map(price, every)), abs_tol=1e-9)


def test_words_of_any_length_split_names(spark, monkeypatch):
    monkeypatch.setattr(urls, "_MEMORY", 50)
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    counts = spark.createDataFrame([(long, 9), ("news", 20), ("best", 20)], "word string, count long")
    names = [f"best{long}news", "x" * 3000 + "news", "news"]
    found = {r.run: r.words for r in urls.segmented(spark.createDataFrame([(n,) for n in names], "run string"), counts).collect()}
    assert found == {names[0]: ["best", long, "news"], names[1]: ["x" * 3000, "news"], "news": ["news"]}


def test_pipeline_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for (name, stage), check in zip(corpus_pipeline.STAGES[:-1], (None, None, "dedup", "mix")):
        out = corpus_pipeline.scratch.stored(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        if check == "dedup":
            groups = simhash.near_duplicates(docs).collect()
            assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted({r.component_id for r in groups})
        elif check is None:
            assert 0 < out.count() <= docs.count() and out.exceptAll(docs).count() == 0
        else:
            assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3 and out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.agg(F.sum("length")).first()[0] == packed.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(words_of.filter(bool), min_size=1, max_size=6), st.sets(st.integers(0, 200)))
def test_uncovered_blocks_equal_word_by_word(parts, places):
    texts = [" ".join(p) for p in parts]
    flat = [(i, w) for i, p in enumerate(parts) for w in p]
    starts = [a for a in places if a + html.LONG <= len(flat)]
    covered = {a + k for a in starts for k in range(html.LONG)}
    inside = [sum(j in covered and i == b for j, (i, _) in enumerate(flat)) for b in range(len(parts))]
    want = [t for t, c, p in zip(texts, inside, parts) if c <= html.COVERED * len(p)]
    assert html.uncovered(texts, starts or None) == "\n\n".join(want)


@pytest.mark.parametrize("name", ["noscript", "svg", "select"])
def test_raw_elements_without_an_end_take_linear_time(name):
    page = f"<{name}><p>some words</p>" * 8_000
    started = time.process_time()
    found = html.blocks(page)
    assert time.process_time() - started < 2 and len(found) == 8_000
    assert html.blocks(f"<{name}>gone</{name}><p>kept</p><{name}><p>open</p>")[0][0] == "kept"
    assert [t for t, _, _ in html.blocks(f"<{name.upper()} a='>'>gone<p>too</{name} ><p>kept")] == ["kept"]


def test_boilerplate_of_a_host_goes(spark):
    menu = "one two three four five six seven eight nine"
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><div>" + " ".join(f"w{i}x{j}" for j in range(40)) + "</div>") for i in range(3)]
    rows += [(9, "http://other.example/", f"<div>{menu}</div>"), (10, None, ""), (11, "http://h.example/11", "<p>" + "long " * 30_000 + "</p>")]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(3):
        assert found[i] == " ".join(f"w{i}x{j}" for j in range(40))
    assert found[9] == menu and found[10] == "" and found[11] == " ".join(["long"] * 30_000)


def plain_em(chances, counts, steps=4000):
    """Shares of languages, one n-gram at a time."""
    share = [1 / len(chances)] * len(chances)
    for _ in range(steps):
        new = [0.0] * len(share)
        for slot, n in enumerate(counts):
            mixed = sum(s * c[slot] for s, c in zip(share, chances))
            for i, c in enumerate(chances):
                new[i] += n * share[i] * c[slot] / mixed
        share = [x / sum(counts) for x in new]
    return share, sum(n * math.log(sum(s * c[slot] for s, c in zip(share, chances))) for slot, n in enumerate(counts))


@pytest.mark.parametrize("seed", range(4))
def test_mixtures_equal_plain_expectation_maximisation(seed):
    random = np.random.default_rng(seed)
    chances = random.dirichlet(np.full(25, 0.3), 3) + 1e-4
    chances /= chances.sum(axis=1, keepdims=True)
    true = random.dirichlet(np.ones(3))
    counts = random.multinomial(3000, true @ chances)
    share, likely = languages.Languages(["a", "b", "c"], chances)._mixture(chances[:, counts > 0], counts[counts > 0].astype(float))
    want, most = plain_em(chances[:, counts > 0].tolist(), counts[counts > 0].tolist(), 600)
    assert np.allclose(share, want, atol=0.02) and most - 1 < likely <= most + 1e-6


def test_language_sets_are_the_best_penalised_ones():
    from itertools import combinations

    random = np.random.default_rng(7)
    chances = random.dirichlet(np.full(languages.SLOTS, 0.02), 4) + 1e-7
    chances /= chances.sum(axis=1, keepdims=True)
    model = languages.Languages(list("abcd"), chances)
    for true in ([1, 0, 0, 0], [0.6, 0.4, 0, 0], [0, 0.3, 0.3, 0.4], [0.25] * 4):
        counts = random.multinomial(2000, np.array(true) @ chances)
        seen = counts > 0
        best = max(
            (s for k in range(1, 5) for s in combinations(range(4), k)),
            key=lambda s: model._mixture(chances[list(s)][:, seen], counts[seen].astype(float))[1] - (len(s) - 1) * languages._PENALTY * math.log(2001),
        )
        assert {name for name, _ in model.predict(counts)[2]} == {"abcd"[i] for i in best} == {"abcd"[i] for i, t in enumerate(true) if t}


def test_learning_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, kept int, score string, licences int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = languages.learn(none)
    assert languages.identify(none, model).count() == 0 and licenses.scan(none).count() == 0
    assert quality.judge(none, quality.train(none, labels)).count() == 0
    one = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    assert languages.identify(one, model).first().lang_pred == languages.UNKNOWN
    assert quality.judge(one, quality.train(none, labels)).first().kept is False  # fewer than 20 words


def test_stages_take_rows_of_every_kind(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet")
    clashing = {c: F.lit("x") for c in ("kept", "score", "lang_pred", "component", "size", "target", "copies", "key", "ids", "start", "doc", "row", "id", "digest")}
    rows = [(None, None, None, None, None), (7, None, "en", "src1", 3), (None, "", "en", None, 0), (7_000, " \n ", None, "src1", 1), (7_001, "wo rd " * 30_000, "en", "src2", 1)]
    odd = spark.createDataFrame(rows * 2, given.schema)
    docs = given.union(given.limit(5)).union(odd).withColumns(clashing)
    docs = corpus_pipeline.scratch.stored(docs.withColumn("a map", F.create_map(F.lit("k"), F.col("doc_id"))))

    def plain(df):
        return df.withColumn("a map", F.to_json("a map"))

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.scratch.stored(stage(spark, docs, sf))
        assert out.columns == docs.columns and 0 < out.count(), name
        assert plain(out).distinct().exceptAll(plain(docs).distinct()).count() == 0, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    packed = corpus_pipeline.pack(spark, docs, sf)
    assert packed.filter("start = 0").count() == docs.count()
    assert corpus_pipeline.pack(spark, docs.limit(0), sf).count() == 0
