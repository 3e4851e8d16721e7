"""Operators that work on one text at a time: page text, pieces, licences, token counts, quality."""

import os
import random
import textwrap
import zlib

import numpy as np
import pytest

from seriesloom.llm import html_text, license_scan, pieces, piece_model, quality, queries, token_count

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

PATH = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"
ALPHABET = [chr(c) for c in range(32, 127)] + list("▁\n\t\r\x0b\x1f\x00éäñ日本語テ　😀ﬁ") + [" "] * 8


def random_texts(count, longest, seed, alphabet=ALPHABET):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(count)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty, repeated and very long texts, and extra columns with clashing names."""
    long_text = "wordy text of some length. " * 20_000
    rows = [(1, None, 0.5), (2, "", None), (3, "Plain text here.", 1.0), (3, "Plain text here.", 1.0), (None, "No id.", 2.0), (4, long_text, 3.0)]
    schema = "doc_id long, text string, score double"
    return spark.createDataFrame(rows, schema).selectExpr("*", "7L AS n_tokens", "'x' AS ids", "'y' AS decoded", "1 AS n", "'k' AS text__source")


# ---- page text

PAGE = """<!doctype html><html><head><title>Site title</title><style>p {{}}</style></head><body class="has-sidebar home">
<header class="site-header"><h1>Site name</h1><p>A tag line that is quite long, with many words in it</p></header>
<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>
<div class="layout"><div id="content">{article}
<section id="comments"><h3>2 comments</h3><p>A reader's comment that goes on and on, dense in characters and without any link at all.</p></section>
</div><div class="sidebar widget-area"><p>Side text</p></div></div>
<div id="cookie-notice"><p>This site uses cookies for many good reasons that nobody reads.</p></div>
<form action="/s"><label>Search</label><input><button>Go</button></form><footer><p>&copy; 2024 Site</p></footer>
<script>document.write("<p>scripted</p>")</script></body></html>"""

PARAGRAPHS = ["First &amp; foremost, a <b>paragraph</b> of some length, with a <a href='x'>link</a> in it, to be kept in whole.", "Second   paragraph\n of text,<br>broken once and then going on for a while.", "Short."]
TEXTS = ["First & foremost, a paragraph of some length, with a link in it, to be kept in whole.", "Second paragraph of text, broken once and then going on for a while.", "Short."]


@pytest.mark.parametrize(
    "article",
    [
        "<article><h1>Headline</h1>{}</article>",
        "<main><h1>Headline</h1>{}</main>",
        "<div class='post'><h2>Headline</h2>{}</div>",
        "<article><header><h1>Headline</h1></header><div class='entry-content'>{}</div><aside>Related</aside><div class='share-buttons'>Share</div></article>",
        "<div><h2>Headline</h2><div><div>{}</div></div></div>",
    ],
)
def test_article_is_found_whatever_surrounds_it(article):
    inner = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = PAGE.format(article=article.format(inner))
    assert html_text.main_text(page) == "\n\n".join(["Headline", *TEXTS])


def test_unclosed_elements_lists_and_tables():
    page = "<body><article><p><b>One<br><p>Two<ul><li>three<li>four</ul><table><tr><td>five<td>six</table>seven</article>"
    assert html_text.main_text(page) == "One\n\nTwo\n\nthree\n\nfour\n\nfive\n\nsix\n\nseven"


@pytest.mark.parametrize(
    "page,text",
    [(None, ""), ("", ""), ("<html><body></body></html>", ""), ("words alone", "words alone"), ("<div class=ad>named alone</div>", "named alone"), ("a < b & c &lt; d", "a < b & c < d"), ("<p>cut off <a href='", "cut off"), ("<p>&#x41;&eacute;&nbsp;x</p>", "Aé x"), ("</p></div>stray", "stray"), ("<!-- c --><p>x</p><!-- open", "x")],
)
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_long_pages_end():
    assert html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    text = html_text.main_text("<article>" + "<p>paragraph of text</p>" * 20_000 + "</article>")
    assert text.count("paragraph") == 20_000


def test_densities_follow_the_formula():
    import math

    root = html_text.parse("<body><div><p>aaaa<a>bb</a></p><p>cccccc</p></div></body>")
    order = html_text.pruned(root, True)
    div = next(n for n in order if n.tag == "div")
    assert (div.chars, div.tags, div.link_chars, div.link_tags) == (12, 3, 2, 1)
    base = math.log(12 * 2 / 10 + 2 / 12 * 12 + math.e)
    assert div.density == pytest.approx(12 / 3 * math.log(12 / 2 * 3 / 1) / math.log(base))
    assert div.total == pytest.approx(sum(p.density for p in div.parts))


def test_pages_query_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x y</p>", "e"), (1, "u", "<p>x y</p>", "e"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text) for r in rows) == [(0, ""), (1, "x y"), (1, "x y")]
    assert html_text.extract(pages.limit(0)).collect() == []


# ---- pieces


@pytest.fixture(scope="module")
def unigram():
    """The library's Viterbi over the same pieces; scores of -1e9 would cost it its precision."""
    formats = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = formats.ModelProto()
    with open(PATH, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        if piece.score < -1e8:
            piece.score = -40000.0
    raw = proto.SerializeToString()
    return pieces.Codec(piece_model.parse(raw, formats)), sentencepiece.SentencePieceProcessor(model_proto=raw)


def test_viterbi_equals_the_library(unigram):
    codec, library = unigram
    for text in random_texts(1500, 40, 1) + random_texts(300, 60, 2, list("ab the  inonher\n")):
        assert codec.encode(text).tolist() == library.encode(text), text


def test_viterbi_is_optimal_by_brute_force(unigram):
    codec, _ = unigram
    model = codec.model

    def best(text):
        score = {0: 0.0}
        for end in range(1, len(text) + 1):
            options = [score[a] + model.scores[model.pieces[text[a:end]]] for a in range(max(0, end - 20), end) if text[a:end] in model.pieces]
            if text[end - 1] not in model.pieces:
                options.append(score[end - 1] + codec.unknown_score)
            score[end] = max(options)
        return score[len(text)]

    for text in random_texts(200, 25, 3):
        text = model.normalized(text)
        ids, total, run = codec.viterbi(text), 0.0, 0
        for i in ids:
            if i in model.byte_ids:
                run += 1
            else:
                total += model.scores[i]
        unknown = sum(c not in model.pieces for c in text)
        assert total + unknown * codec.unknown_score == pytest.approx(best(text)) or run == 0


def test_round_trip(spark, odd_docs):
    encoded = pieces.encode(odd_docs, PATH)
    rows = pieces.decode(encoded, PATH).collect()
    assert len(rows) == 6
    assert all(r.decoded == (r.text or "") for r in rows)
    codec = pieces.codec(PATH)
    for text in random_texts(400, 60, 4):
        assert codec.decode(codec.encode(text)) == text.replace("▁", " ")
    assert pieces.encode(odd_docs.limit(0), PATH).collect() == []


# ---- token counts


def test_token_counts_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    machine = token_count.transducer(PATH)
    texts = random_texts(2500, 50, 5) + random_texts(300, 80, 6, list(" \nab")) + random_texts(60, 1500, 7, list("aeintrs"))
    texts += [c * k for c in (" ", "a", "=", "the", "\n", "ab ", "é", "日") for k in (0, 1, 2, 7, 33, 300)]
    assert machine.count(texts).tolist() == [len(x) for x in library.encode(texts)]


def test_chunk_maps_compose():
    machine = token_count.transducer(PATH)
    word = "▁" + "interesting" * 200
    whole, count = token_count.START, 0
    for char in word:
        whole, change = machine.move(whole, char)
        count += change
    state, total = token_count.START, 0
    for at in range(0, len(word), 37):
        state, more = machine.chunk_map(state, word[at : at + 37])
        total += more
    assert (state, total) == (whole, count) and machine.count_long(word) == count


def test_counts_do_not_depend_on_what_is_kept():
    machine = token_count.transducer(PATH)
    texts = random_texts(50, 200, 8)
    first = machine.count(texts).tolist()
    machine.clear()
    machine.words.clear()
    assert machine.count(texts).tolist() == first


def test_token_counts_of_odd_documents(odd_docs):
    rows = token_count.token_counts(odd_docs, PATH).collect()
    counts = sorted((r.doc_id or 0, r.n_tokens) for r in rows)
    assert counts[0][1] > 0 and counts[1] == (1, 0) and counts[2] == (2, 0) and counts[3] == counts[4]
    assert token_count.with_limit(token_count.token_counts(odd_docs, PATH), 4096).where("over_limit").count() == 1


# ---- licences


def test_licenses_are_told_apart_by_exact_wording():
    known = license_scan.TEMPLATES
    for name, text in known.items():
        assert license_scan.identify(text, known)[0] == name
        found = license_scan.identify(f"In all files: {text} Thank you.", known)
        assert found[0] == name and found[2] == 0
    assert license_scan.identify("This work is licenced under the GNU General Public License, version 3.", known)[3] == ["-licensed", "+licenced"]
    assert license_scan.identify("He has a driving license and a dog.", known) is None


def test_brute_force_ranking_agrees_with_wording():
    known = license_scan.TEMPLATES
    for text in known.values():
        words = license_scan.WORD.findall(text.lower())
        fewest = min(license_scan.differences(words, license_scan.WORD.findall(t.lower()))[0] for t in known.values())
        assert license_scan.identify(text, known)[2] == fewest == 0


def plain_licenses(text, known):
    """Every template against every run of about its length, words folded, by plain comparison."""
    words = license_scan.WORD.findall(text.lower())
    found = set()
    for name, template in known.items():
        wording = license_scan.WORD.findall(template.lower())
        for a in range(len(words)):
            if words[a : a + len(wording)] == wording:
                found.add(name)
    return found


def test_notices_over_lines_and_beside_each_other():
    known = license_scan.TEMPLATES
    wrapped = {n: textwrap.fill(known[n], 76, break_on_hyphens=False, break_long_words=False) for n in ("MIT-text", "BSD-3-Clause", "Apache-2.0-header", "ISC-text")}
    for name, text in wrapped.items():
        body = "Some words before.\n\n" + "\n".join(f" * {line}" for line in text.splitlines()) + "\n\nThe rest of the file."
        (a, b, found, _, count, _, _), = license_scan.licenses(body, known)
        assert (found, count) == (name, 0) and body[a:b].startswith(" * ") and b == body.index("\n\nThe rest")
    both = "Released under the MIT License. Texts are licensed under CC BY 4.0."
    assert [n[2] for n in license_scan.licenses(both, known)] == ["CC-BY-4.0", "MIT"]
    assert [n[2] for n in license_scan.licenses("This work is licensed under the GNU General\nPublic License, version 3.", known)] == ["GPL-3.0"]
    assert [n[2] for n in license_scan.licenses("// SPDX-License-Identifier: MIT\nx = 1", known)] == ["MIT (SPDX)"]
    assert license_scan.licenses("A license\n\nunder the MIT", known) == []


def test_scan_finds_what_plain_comparison_finds(spark):
    """A table of texts with notices in prose, some of them twice, whatever stands around them."""
    r = random.Random(12)
    known = license_scan.TEMPLATES
    # of templates inside others only the larger is a notice of its own
    names = [n for n in known if not any(n != m and known[n].rstrip(".").lower() in known[m].lower() for m in known)]
    prose = "the code of this work and any other text is what it is under the sun".split()
    rows, expected = [], {}
    for i in range(120):
        chosen = r.sample(names, r.randint(0, 3))
        parts = [" ".join(r.choices(prose, k=r.randint(0, 90))) for _ in range(len(chosen) + 1)]
        text = parts[0]
        for name, more in zip(chosen, parts[1:]):
            text += r.choice(["\n", " ", "\n\n"]) + textwrap.fill(known[name], r.choice([40, 76, 1000]), break_on_hyphens=False, break_long_words=False) + r.choice(["\n", "\n\n"]) + more
        rows.append((i, text))
        expected[i] = set(chosen)
        assert expected[i] <= plain_licenses(text, known)
    found = {}
    for row in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert row.n_different == 0
        found.setdefault(row.doc_id, set()).add(row.license)
    assert {i: found.get(i, set()) for i in expected} == expected


def test_license_rows(spark, odd_docs):
    assert license_scan.scan(odd_docs).collect() == []
    docs = spark.createDataFrame([(1, "x\nReleased under the MIT License.\ny"), (1, "x\nReleased under the MIT License.\ny"), (2, None)], "doc_id long, text string")
    rows = license_scan.scan(docs).collect()
    assert [(r.doc_id, r.start, r.end, r.license, r.n_different) for r in rows] == [(1, 2, 33, "MIT", 0)] * 2


# ---- quality


def test_classifier_on_held_out_labels(spark):
    data = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else DATA
    labels, documents = queries.read(spark, data, "labels"), queries.read(spark, data, "documents")
    model = quality.train(documents, labels, sample_docs=1200)
    rows = quality.score(documents.join(labels, "doc_id").where(quality.held_out()), model).select("score", "quality").collect()
    right = [(r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows]
    good = [r.score >= quality.THRESHOLD for r in rows if r.quality == 1]
    assert sum(right) / len(right) > 0.95 and sum(good) / len(good) > 0.98


def test_fold_is_that_of_crc32(spark):
    ids = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    rows = ids.select("doc_id", quality.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_score_of_a_text_is_its_own():
    random_ = np.random.default_rng(1)
    shape = (quality.WIDTH * (quality.EMBED + 1), quality.FILTERS)
    model = quality.Model(*(random_.normal(size=s).astype(np.float32) for s in ((256, quality.EMBED), shape, quality.FILTERS, quality.FILTERS)), 0.1)
    model.embed[0] = 0
    texts = [t.encode() for t in random_texts(60, 700, 9)] + [b"", b"\0" * 10, b"aaaa" * 500]
    together = quality.scores(texts, model)
    alone = [quality.scores([t], model)[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-5)


def test_scores_without_labels_and_of_odd_documents(spark, odd_docs):
    none = spark.createDataFrame([(3, None)], "doc_id long, quality int")
    model = quality.train(odd_docs, none)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == 6 and all(r.score == 0.5 for r in rows)
    some = quality.train(odd_docs, spark.createDataFrame([(1, 0), (3, 1), (4, 1), (4, 1)], "doc_id long, quality int"))
    scored = quality.score(odd_docs, some).collect()
    assert len({r.score for r in scored if not r.text}) == 1 and all(0 <= r.score <= 1 for r in scored)
