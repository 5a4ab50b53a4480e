from __future__ import annotations

import random
import re
import time
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.llm import html_extract, langid, licenses, quality_crf
from flowlake.llm.html_extract import extract_main_text

SF = "/root/testdata/sf0.01"


# html -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("<html><body></body></html>", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a&nbsp;&lt;b&gt;\n  c<br>d<p>e", "a <b> c d\ne"),
        ("<article><p>One, two.</p><script>var p = '</p>';</script><style>p{}</style><p>Three.</p></article><footer>f</footer>", "One, two.\nThree."),
        ("<body><header>h</header><nav><a href=x>m</a></nav><main><h1>T</h1><p>Body text, of the page.</p></main><aside>s</aside></body>", "T\nBody text, of the page."),
        ("<div id=content><p>Long enough, a paragraph of prose, here.</p><div class='comments'><p>Reader, comment, text, with, commas.</p></div></div>", "Long enough, a paragraph of prose, here."),
        ("<div><div class='cookie-notice'>We use cookies, and more.</div><div class=sideBar>s</div><p>The text, which is kept.</p><form><p>Sign, up, now</p></form></div>", "The text, which is kept."),
        ("<table><tr><td>a<td>b</table>", "a\nb"),
        ("<p>x <b>bold<p>y</b> z</p>", "x bold\ny z"),
        ("<p>a<!-- <p>no</p> -->b</p>", "ab"),
        ("<article><p>Kept, all of it.</p><article class='comment'><p>Not, this, one.</p></article></article>", "Kept, all of it."),
        ("<div hidden><p>no, no, no</p></div><p>yes, it is.</p>", "yes, it is."),
    ],
)
def test_extract(page, text):
    assert extract_main_text(page) == text


PROSE = "".join(f"<p>Paragraph {i} of the story, which goes on for a while, as stories do.</p>" for i in range(6))
TEXT = "\n".join(f"Paragraph {i} of the story, which goes on for a while, as stories do." for i in range(6))


@pytest.mark.parametrize(
    ("page", "after"),
    [
        (f"<div id=story><section>{PROSE}</section><section><h2>End</h2><p>Short closing.</p></section></div>", "\nEnd\nShort closing."),
        (f"<main><div><div>{PROSE}</div></div><div><p>A note, in a box of its own.</p></div></main>", "\nA note, in a box of its own."),
        (f"<body><div>{PROSE}</div>And a loose ending.</body>", "\nAnd a loose ending."),
        (f"<div><section>{PROSE}</section><section class='social-science'><p>Science of society, explained here.</p></section></div>", "\nScience of society, explained here."),
        (f"<div><div>{PROSE}</div><section class=legal-history><p>History of the law, told in short form.</p></section></div>", "\nHistory of the law, told in short form."),
        (f"<article>{PROSE}<div class='social-share'><p>Share this, please, with everyone you know.</p></div></article>", ""),
        (f"<article>{PROSE}<div class='legal-x'><a href=1>Terms</a> <a href=2>Privacy</a></div></article>", ""),
        (f"<nav/><a href=x>Menu entry, one</a></nav><article>{PROSE}</article>", ""),
        (f"<div class=menu data-u=/x/><p>Menu text, long enough to be taken for prose.</p></div><article>{PROSE}</article>", ""),
        (f"<article>{PROSE}<p class=\"abc>More text.</article>", "\nMore text."),
        (f"<main><article>{PROSE}</article><article><h3><a href=1>Another story</a></h3><p>A teaser.</p></article></main>", ""),
        (f"<body>{PROSE}<div><a href=1>One</a> <a href=2>Two</a></div></body>", ""),
        (f"<main><ul>{'<li><a href=x>Linked title, with, commas</a></li>' * 40}</ul><div>{PROSE}</div></main>", ""),
    ],
)
def test_extract_keeps_the_article_and_nothing_else(page, after):
    assert extract_main_text(page) == TEXT + after


def test_extract_prefers_prose_to_links():
    links = "".join(f"<li><a href={i}>Link number {i}, with, commas, in, it, and a long title</a></li>" for i in range(30))
    prose = "".join(f"<p>Paragraph {i} of the story, which goes on for a while.</p>" for i in range(4))
    got = extract_main_text(f"<body><div><ul>{links}</ul></div><div>{prose}</div></body>")
    assert got.count("\n") == 3 and "Link" not in got


def test_extract_long_and_deep_pages():
    assert len(extract_main_text("<div>" * 5000 + "<p>deep, text</p>")) == 10
    assert len(extract_main_text("<p>" + "long text, " * 200_000)) == 2_199_999
    extract_main_text("<" * 20_000 + "a" * 1000 + '"' * 999)


def test_extract_stray_end_tags_in_linear_time():
    began = time.perf_counter()
    page = "<div>" * 20_000 + "</nav></li></p><li>" * 20_000 + "<p>The end, at last.</p>"
    assert "The end, at last." in extract_main_text(page)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("empty", ["<!-->", "<!--->", "<!-- -->", "<!---->", "<!-- a --!>"])
def test_extract_empty_comments_end_at_once(empty):
    assert extract_main_text(f"<p>One, two.</p>{empty}<p>Three, four.</p><!-- x --><p>Five.</p>") == "One, two.\nThree, four.\nFive."


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>", "old", 7), (1, "u", "<p>é</p>", "old", 7), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract_pages(pages).collect()
    assert [r["text"] for r in got] == ["é", "é", ""] and html_extract.extract_pages(pages.limit(0)).count() == 0


def test_extract_the_given_pages(spark):
    """Against the article's blocks, cut out by pattern from these regular pages."""
    from html import unescape

    for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S).group(1)
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert extract_main_text(r["html"]) == "\n".join(b for b in blocks if b)


# language id ------------------------------------------------------------------------------------------------
def _model(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    train = [(r["text"], r["lang"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    return langid.WordModel.fit(train), rows


def test_language_accuracy_and_spans(spark):
    model, rows = _model(spark)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(model.label(r["text"])[0] == r["lang"] for r in held) / len(held) > 0.97
    en, de = (next(r["text"] for r in held if r["lang"] == x and len(r["text"]) > 2000)[:1500] for x in ("en", "de"))
    lang, score, spans = model.label(en + "\n" + de + de)
    assert lang == "de" and 0.5 < score < 0.8 and {s[0] for s in spans} == {"en", "de"} and len(spans) <= 4


def test_viterbi_is_exact():
    rng = np.random.default_rng(4)
    model = langid.WordModel.fit([("la le lo", "a"), ("xi xo", "b"), ("um ut", "c")])
    for n in range(1, 8):
        for _ in range(30):
            e, pen = rng.normal(0, 3, (n, 3)), float(rng.choice([0.5, 3.0, 12.0]))
            value = lambda p: sum(e[i, k] for i, k in enumerate(p)) - pen * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
            best = max(value(p) for p in product(range(3), repeat=n))
            assert abs(value(model.path(e, pen).tolist()) - best) < 1e-9


def test_scripts_narrow_candidates():
    model = langid.WordModel.fit([("the of and", "en"), ("мир и война", "ru"), ("και το", "el")])
    assert model.label("неведомое слово")[0] == "ru" and model.label("άγνωστο")[0] == "el" and model.label("zzz qqq")[0] == "en"
    assert langid.WordModel.fit([("la le", "a")]).label("xx")[:2] == ("a", 1.0)


def test_more_languages_than_a_byte_numbers():
    syllable = lambda i: "bcdfghjklmnpqrstvwxz"[i % 20] + "aeiou"[i // 20 % 5] + "bdgkm"[i // 100 % 5]
    model = langid.WordModel.fit([(" ".join([syllable(i) * 2] * 20), f"l{i:03}") for i in range(300)])
    text = " ".join([syllable(3) * 2] * 30 + [syllable(290) * 2] * 40)
    lang, _, spans = model.label(text)
    assert lang == "l290" and [s[0] for s in spans] == ["l003", "l290"]
    for text in ("½ ²", "Ⅷ", "٣ 7", "_"):
        assert model.label(text) == ("und", 0.0, [])
    assert model.label("漢字")[1] == 0.0 and langid.WordModel.fit([]) is None


def test_a_rare_language_is_learned(spark):
    """One language has all but a two-thousandth of the words; ids repeat; the rare one is found, in any order of rows."""
    common = [(i % 50, "alpha beta gamma delta epsilon omega " * 60, "en") for i in range(120)]
    rows = [*common, (200, "żółw ślimak gęś łąka", "pl"), (201, "źdźbło ćma żółw łoś", "pl"), (7, None, "pl"), (8, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert model.label("gęś i żółw")[0] == "pl" and model.label("alpha omega beta")[0] == "en"
    assert langid.fit(df.union(df).repartition(3), F.lit(True)).key == model.key


def test_language_odd_rows(odd, none):
    got = {(r["doc_id"], r["text"]): r["language"] for r in langid.identify(odd).select("doc_id", "text", "language").collect()}
    assert all(0 <= x["score"] <= 1 for x in got.values())
    und = {k[0] for k, x in got.items() if x["lang_pred"] == "und"}
    assert und == {3, 4, 6, 8, None} and got[(None, "a text without an id")]["lang_pred"] != "und"
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 5, 7}
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).select("language.lang_pred").collect()} == {"und"}


# quality ----------------------------------------------------------------------------------------------------
def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 4, 2, 6])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    bad, trans = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    p, pairs, log_z = quality_crf.forward_backward(bad, trans, starts, sizes)
    want_pairs = np.zeros((2, 2))
    for d, (s, n) in enumerate(zip(starts, sizes)):
        total, marg = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(bad[s + i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            marg += w * np.array(y)
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(bad[s + i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:]))) / total
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w
        assert np.allclose(p[s : s + n], marg / total) and np.isclose(log_z[d], np.log(total))
    assert np.allclose(pairs, want_pairs)


def test_quality_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_crf.score_documents(docs.select("doc_id", "text"), labels).filter(quality_crf.held_out())
    rows = scored.join(labels, "doc_id").select("quality", "quality_score").collect()
    good, bad = ([r["quality_score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([(r["quality_score"] >= 0.3) == bool(r["quality"]) for r in rows]) > 0.95


def _lines(n, junk, rng):
    words = ["the", "river", "was", "slow", "and", "nobody", "knew", "where", "its", "water", "went"]
    plain = lambda: " ".join(rng.choice(words) for _ in range(9)).capitalize() + "."
    return [" | ".join(rng.choice(words).capitalize() for _ in range(6)) + " |" if junk else plain() for _ in range(n)]


def test_half_a_document_of_junk_gets_both_labels(spark):
    """Only whole documents are labelled, and no bad one is junk throughout."""
    rng, docs, labels = random.Random(3), [], []
    for i in range(160):
        bad = i % 2
        lines = _lines(6, False, rng) + (_lines(10, True, rng) if bad else _lines(rng.randint(2, 10), False, rng))
        docs.append((i, "\n".join(lines)))
        labels.append((i, 1 - bad))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_crf.fit(d, lab, F.lit(True))
    p = model.label_lines("\n".join([*_lines(8, False, rng), *_lines(8, True, rng), *_lines(5, False, rng)]))
    assert (p[:8] < 0.5).mean() > 0.85 and (p[8:16] > 0.5).mean() > 0.85 and (p[16:] < 0.5).mean() > 0.75
    again = quality_crf.fit(d.union(d).repartition(3), lab.union(lab), F.lit(True))  # repeated ids give the same model
    assert np.allclose(again.theta, model.theta, atol=1e-6) and model.slope < 0


def test_long_chains_equal_short_ones(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = np.array([3, 40, 1, 17])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    bad, trans = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    want = quality_crf.forward_backward(bad, trans, starts, sizes)
    monkeypatch.setattr(quality_crf, "LONG_CHAIN", 16)
    for a, b in zip(want, quality_crf.forward_backward(bad, trans, starts, sizes)):
        assert np.allclose(a, b)


def test_text_of_many_lines_in_blocks(monkeypatch):
    text = "\n".join(f"line {i % 700} of it." for i in range(3000))
    whole = quality_crf.line_features(text)
    monkeypatch.setattr(quality_crf, "BLOCK_CHARS", 100)
    cut = quality_crf.line_features(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut)) and whole[0][:, quality_crf.REPEATED].sum() == 2300
    theta = np.random.default_rng(1).normal(size=quality_crf.N_WEIGHTS + 4)
    model = quality_crf.QualityModel(np.zeros(16), np.ones(16), theta)
    chains = quality_crf._Chains([whole[0]], [whole[1]], model.mean, model.scale)
    assert np.allclose(model._scores(text)[0], chains.emitted(model.w))
    assert len(model.label_lines("a\n" * 300_000)) == 300_001


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    got = quality_crf.score_documents(odd, labels)
    assert got.count() == odd.count() and got.filter("quality_score IS NULL OR quality_score < 0 OR quality_score > 1").count() == 0
    assert quality_crf.score_documents(none, labels).count() == 0
    assert {r[0] for r in quality_crf.score_documents(odd, labels.limit(0)).select("quality_score").collect()} == {0.5}
    clash = odd.withColumn("quality_score", F.lit("old"))
    assert dict(quality_crf.score_documents(clash, labels).dtypes)["quality_score"] == "double"
    one_class = quality_crf.score_documents(odd, labels.filter("quality = 1")).select("quality_score").collect()
    assert all(0 <= r[0] <= 1 for r in one_class)


# licences ---------------------------------------------------------------------------------------------------
def _brute_licenses(docs, templates, threshold=0.8):
    """The best window of all that have a template's length, from any word on, for every template."""
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        return list(zip(w, w[1:]))

    out = {}
    for doc, text in docs:
        g = grams(text or "")
        for name, template in templates:
            whole = grams(template)
            b = set(whole)
            for s in range(len(g)):
                if g[s] not in b:
                    continue
                window = g[s : s + len(whole)]
                while window[-1] not in b:
                    window.pop()
                dice = round(2 * len(set(window) & b) / (len(set(window)) + len(b)), 6)
                if dice >= threshold:
                    out[(doc, name)] = max(out.get((doc, name), (0, 0)), (dice, -s - 1))
    return {k: (dice, -s) for k, (dice, s) in out.items()}


def test_licenses_match_brute_force(spark):
    rng = random.Random(9)
    docs = []
    for i in range(150):
        name, text = rng.choice(licenses.TEMPLATES)
        words = text.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randint(0, len(words) - 1)] = rng.choice(["x", "the", "y z", ""])
        body = " ".join(words)
        if rng.random() < 0.4:
            at = rng.randint(1, max(1, len(words) - 1))
            body = " ".join(words[:at]) + "\n" + " ".join(words[at:])
        docs.append((i, f"Some prose of the kind.\n\n{body.upper() if i % 5 == 0 else body}\n \t\nMore prose, of a kind"))
    docs += [(1000, None), (1001, ""), (1002, "one"), (1003, "Released under the MIT License. " * 2), (1003, "Released under the MIT Licence")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (r["dice"], r["first_word"]) for r in licenses.scan_licenses(df).collect()}
    assert got == _brute_licenses(docs, licenses.TEMPLATES) and len(got) > 100


@pytest.mark.parametrize("comment", ["# ", " * ", "// ", "-- ", ""])
def test_licences_in_comments_sentences_and_files(spark, comment):
    """Wrapped headers right above code, a mention inside a sentence, and whole licence files."""
    def header(text):
        lines = [text.split()[i : i + 9] for i in range(0, len(text.split()), 9)]
        return comment + "\n" + "\n".join(comment + " ".join(x) for x in lines) + "\nimport os\n" + "x = call(y, z)\n" * 40

    long = {name: max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name in ("MIT", "GPL-3.0", "BSD", "Apache-2.0", "LGPL-2.1")}
    docs = [*((name, header(text)) for name, text in long.items()), ("MIT in a sentence", "This file is part of Foo and is released under the MIT License."),
            ("MIT file", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + "\n\n".join(licenses._MIT)), ("none", "Under the roof of the licence office, released prisoners met. " * 9)]
    rows = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id string, text string")).collect()
    found = {(r["doc_id"], r["license"]) for r in rows}
    assert {(n, n) for n in long} | {("MIT in a sentence", "MIT"), ("MIT file", "MIT")} <= found and not any(d == "none" for d, _ in found)


def test_licenses_odd_rows(odd, none):
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0
