"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tauflow.llm import decontaminate, html_text, line_dedup, mixing, quality, repetition, secrets, simhash, toxicity, warc
from tests.llm import plain

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
CLASHES = "label score words hash fp kept lines size bits prefix token n i b domain rate x _key window item_id node root".split()
ROWS = [
    (1, f"{PASSAGE}\nshort line"), (2, f"{PASSAGE} nu\nshort line"), (3, None), (4, ""), (5, LONG), (6, f"{PASSAGE}\nshort line"),
    (6, f"{PASSAGE}\nshort line"), (None, f"{PASSAGE}\nother words here"), (None, None), (7, "Été über NAÏVE ſtraße K"),
    (8, "x\x00y   z\x85w"), (9, "Alpha, BETA! gamma"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(12)] + [(None, 1, 1), (1, None, None), (2, 7, 7), (2, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def same(got, expected):
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_lines(docs, empty):
    plainly = plain.without_copied_lines(ROWS)
    got = line_dedup.dedup_lines(docs).collect()
    same([(r.doc_id, r.text) for r in got], [(d, plainly[d, t]) for d, t in ROWS])
    assert all(r.n_removed <= r.n_lines for r in got)
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.remove_copied_lines(docs).select("_doc.*").columns == docs.columns


def test_lines_of_a_large_group_of_near_copies(spark):
    base = [f"t{i}" for i in range(40)]
    texts = [" ".join(base[:k] + [f"new{k}-{j}"] + base[k + 1 :]) for j in range(6) for k in range(40)]
    rows = list(enumerate(texts + [" ".join(f"u{i}-{j}" for i in range(20)) for j in range(40)]))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    plainly = plain.without_copied_lines(rows)
    same([(r.doc_id, r.text) for r in got], [(d, plainly[d, t]) for d, t in rows])


ARTICLE = "<h1>A title</h1>" + "".join(
    f"<p>Paragraph {i} of the article, with a good number of words, so that it counts as text; it goes on and on.</p>" for i in range(6))
TEXT = html_text.main_text(f"<body><article>{ARTICLE}</article></body>")
AROUND = ("<nav><a href=a>Home</a> <a href=b>News</a></nav>", "<footer>All rights reserved <a href=c>Imprint</a></footer>")


@pytest.mark.parametrize("wrapper", [
    'div class="container has-sidebar"', 'div class="site fixed-header"', 'form id="aspnetForm"', 'div class="social-history"', 'div data-id="menu"',
    'div title="the hidden war"', 'div aria-hidden="false"', 'div class="layout sidebar-right"', 'div id="page" class="comments"', 'form action="/x"',
    'section id="share-prices"', 'div role="dialog"', 'div data-x="class=ad" data-style="display:none"', "div class=menu", 'table class="main menu"',
])
@pytest.mark.parametrize("inner", ["", "article", 'article data-title="the hidden war"'])
def test_wrappers_keep_the_text(wrapper, inner):
    content = f"<{inner}>{ARTICLE}</{inner.split()[0]}>" if inner else ARTICLE
    for before, after in (("", ""), AROUND):
        page = f"<html><body>{before}<{wrapper}>{content}</{wrapper.split()[0]}>{after}</body></html>"
        assert html_text.main_text(page) == TEXT, page[:120]


@pytest.mark.parametrize("clutter", [
    '<div class="comments"><p>Nice one, thank you for it all.</p></div>', '<div class="sidebar-left"><p>Read this as well, please do.</p></div>',
    '<div id="site-header"><a href=x>Start</a></div>', "<aside><p>Something else that is on the side.</p></aside>", '<div class="cookie-notice">We use cookies, more or less.</div>',
    "<form><label>Your name</label><button>Send</button></form>", '<div hidden>Not shown</div>', '<div style="display: none">Not shown</div>', '<div role="navigation">Up and down</div>',
])
def test_marked_clutter_goes(clutter):
    for page in (f"<body>{clutter}<div>{ARTICLE}</div></body>", f"<body><form><div class=content>{ARTICLE}</div>{clutter}</form></body>"):
        assert html_text.main_text(page) == TEXT, page[:100]


def test_part_of_an_article_with_a_telling_name_stays():
    page = f"<body><article>{ARTICLE}<section id='share-prices'><p>Prices went up by a lot and then they fell again.</p></section></article></body>"
    assert html_text.main_text(page) == TEXT + "\nPrices went up by a lot and then they fell again."


def test_articles_of_given_pages(spark, sf_dir):
    """The text of a given page with one article is that article's, but for marked parts of it."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect() if r.html and r.html.count("<article") == 1]
    assert len(pages) > 20
    for page in pages:
        inner = page[page.index("<article") : page.index("</article>")]
        assert html_text.main_text(page) == html_text.main_text(f"<body>{inner}</article></body>")


def test_pairs_of_a_group_of_near_copies_grow_with_its_size(spark):
    """Twice the near copies give about twice the pairs, not four times; ids may be texts."""
    def pairs(n):
        base = [f"t{i}" for i in range(30)]
        texts = [" ".join(base[: k % 30] + [f"own{k}"] + base[k % 30 + 1 :]) for k in range(n)]
        docs = spark.createDataFrame([(f"id-{i:05d}", t) for i, t in enumerate(texts)], "doc_id string, text string")
        lines = line_dedup.with_prefixes(line_dedup.first_lines(docs), line_dedup.token_levels(docs)).cache()
        hubs = line_dedup._hub_pairs(lines)
        near = line_dedup._verified(hubs, lines)
        flagged = lines.join(near.withColumn("s", F.lit(True)), F.col("lid") == F.col("x"), "left").withColumn("settled", F.col("s").isNotNull())
        counted = hubs.count() + line_dedup._prefix_pairs(flagged).count()
        plainly = plain.without_copied_lines(list(enumerate(texts)))
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
        assert [got[f"id-{i:05d}"] for i in range(n)] == [plainly[i, t] for i, t in enumerate(texts)]
        return counted

    few, many = pairs(300), pairs(600)
    assert many < 2.6 * few


@pytest.mark.parametrize("few", [decontaminate.FEW, 0])
def test_contamination(spark, docs, empty, few):
    items = [(1, PASSAGE), (2, f"zero {PASSAGE}"), (2, PASSAGE), (3, "beta gamma"), (4, None), (5, " .,"), (None, PASSAGE), (11, "naïve"), (6, LONG[:4000])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = decontaminate.find_contamination(docs, bench, few=few).collect()
    same([tuple(r)[:6] for r in got], plain.contamination(ROWS, items))
    assert decontaminate.find_contamination(empty, bench, few=few).count() == 0
    none = decontaminate.find_contamination(docs, bench.where("false"), few=few).collect()
    same([tuple(r)[:6] for r in none], plain.contamination(ROWS, []))
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and 2 not in {r.doc_id for r in clean.collect()}


def test_fingerprints(docs, empty):
    ids, texts = zip(*ROWS)
    prints = [plain.fingerprint(t) for t in texts]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    same(got, [(d, f"{p:016x}", c) for d, p, c in zip(ids, prints, plain.components(prints, list(ids)))])
    assert simhash.near_duplicates(empty).count() == 0
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and [r.doc_id for r in one.where("doc_id in (1, 6)").collect()] == [1]


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_links_of_any_segments_equal_all_pairs(spark, segments):
    import random

    rnd = random.Random(segments)
    prints = set()
    for _ in range(60):
        p = rnd.getrandbits(64)
        for _ in range(4):
            q = p
            for b in rnd.sample(range(64), rnd.randrange(0, 7)):
                q ^= 1 << b
            prints.add(q - (1 << 64) if q >> 63 else q)
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {tuple(r) for r in simhash.near_links(table, 4, segments).collect()}
    assert got == {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}


def test_repetition(docs, empty):
    got = [tuple(r)[:7] for r in repetition.apply_quality_rules(docs).collect()]
    same(got, [(d, *plain.repetition(t)) for d, t in ROWS])
    assert repetition.apply_quality_rules(empty).count() == 0


def test_repeated_runs_are_rejected_and_prose_is_kept():
    prose = " ".join(f"word{i}" for i in range(200))
    assert repetition.measure(prose)[6]
    assert not repetition.measure(prose + " " + " ".join(["one two three four five six"] * 20))[6]
    assert not repetition.measure("\n".join(["a line of several words that comes back"] * 9 + [prose[:300]]))[6]


def test_secrets(docs, empty):
    got = secrets.scan_secrets(docs).collect()
    same([(r.doc_id, r.base_sha256) for r in got], [(d, hashlib.sha256(plain.base_secrets(t).encode()).hexdigest()) for d, t in ROWS])
    assert secrets.scan_secrets(empty).count() == 0


def test_secret_kinds():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"ghp_{body}{secrets._base62_sum(body)}"
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    found = lambda t: [(t[a:b], k) for a, b, k in secrets.find_secrets(t)]
    assert found(f"É {good} x") == [(good, "github")] and found(bad) == []
    assert found(good.replace("ghp_", "npm_")) == [(good.replace("ghp_", "npm_"), "npm")]
    texts = [
        "PassWord = 'abcdef' token:abc api_key=token=secret99 AKIA" + "A" * 16 + " akiA" + "B" * 20, "ſecret=abcdefg toKen=abcdefg",
        "0123456789abcdef" * 3 + "g" + "f" * 23, "secret=secret=secret=secretsecret", 'passwd":   "x.y/z+=-_"',
    ]
    for t in texts:
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in secrets.find_secrets(t)) == plain.base_secrets(t)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers(docs, empty, labels, score):
    got = score(docs, labels).collect()
    same([(r.doc_id, r.held_out) for r in got], [(d, d is None or zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in ROWS])
    assert all(0 <= r.score <= 1 for r in got)
    assert score(empty, labels).count() == 0
    assert {r.score for r in score(docs, labels.where("false")).collect()} <= {0.0, 0.5}


def test_nearest_are_exact():
    import numpy as np

    rnd = np.random.default_rng(1)
    terms = {f"t{i}": i for i in range(30)}
    vectors = []
    for _ in range(900):
        at = sorted(rnd.choice(30, rnd.integers(1, 6), replace=False).tolist())
        x = rnd.random(len(at)) + 0.1
        vectors.append((at, x / np.sqrt(x @ x)))
    index = toxicity.build_index(range(900), rnd.integers(0, 2, 900), vectors, terms, np.ones(30), (500, 400))
    dense = np.zeros((900, 30))
    for e, (at, x) in enumerate(vectors):
        dense[e, at] = x
    for _ in range(50):
        at, x = vectors[rnd.integers(900)]
        full = np.round(dense[:, at] @ x, 12)
        expected = sorted(((-s, e) for e, s in enumerate(full) if s > 0))[:15]
        assert [(e) for _, e in index.nearest(at, x)] == [e for _, e in expected]


def test_mixing(docs, empty, labels):
    rows = mixing.document_rates(docs, labels).collect()
    same([r.doc_id for r in rows], [d for d, _ in ROWS])
    assert all(r.rate >= 0 and abs(r.p_00 + r.p_01 + r.p_10 + r.p_11 - 1) < 1e-4 for r in rows)
    assert mixing.document_rates(empty, labels).count() == 0
    assert {r.rate for r in mixing.document_rates(docs, labels.where("false")).collect()} != set()
    mixed = mixing.mix_documents(docs, labels)
    assert mixed.count() == len(ROWS) and set(mixed.columns) == set(docs.columns)


PAGES = {
    "": "", "<p>hi": "hi", "text only &amp; more": "text only & more", "<td>a<td>b": "a\nb",
    "<html><body><nav>menu</nav><article><h1>T</h1><p>one <b>two<p>three&nbsp;four\n five</article><footer>f</footer></body>": "T\none two\nthree four five",
    "<div class='cookie-notice'>c</div><div><p>long enough text of the page, really</p><p>and more of it here</p></div>":
        "long enough text of the page, really\nand more of it here",
    "<main><p>kept</p><section id=comments><p>dropped</p></section><script>var a='</p>';</script></main>": "kept",
    "<div id=header><h1>Site</h1></div><div><h1>Title</h1><div><p>one longer paragraph of text</p><p>and another of them</p></div></div>":
        "Title\none longer paragraph of text\nand another of them",
    "<p>a <!-- b --> c<![CDATA[d]]></p>": "a cd", "<p title='x>y'>q</p><p hidden>no</p>": "q",
}


@pytest.mark.parametrize("page", PAGES)
def test_page_texts(page):
    assert html_text.main_text(page) == PAGES[page]


def test_odd_pages(spark):
    odd = [None, "", "<" * 500, "<div>" * 3000 + "deep" + "</div>" * 2000, "<p " + "a='" * 200, "</b></p></div>x", "<p>" + "long " * 50_000 + "</p>"]
    df = spark.createDataFrame([(i, None, h) for i, h in enumerate(odd)] + [(0, None, None)], "page_id long, url string, html string")
    got = html_text.extract_pages(df.withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(odd) + 1 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[3] == "deep"


def test_archives(spark):
    long = "<p>WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é" * 200
    rows = [
        (3, "http://a/", long), (1, "http://b/", long), (2, None, long), (None, "http://c/", long), (4, "u", "short"), (5, "u", "short"),
        (6, "u", None), (7, "u", ""), (1, "http://b/", long), (8, "a\r\nb", "x" * 100), (9, "a", "x" * 100),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect()]
    expected = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = {long: 1, "x" * 100: 8}.get(html)
        copy = first is not None and page_id != first
        expected.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if copy else "response", first if copy else None))
    same(got, expected)
    assert warc.archive_round_trip(df.where("false")).count() == 0


def test_records_keep_their_payloads(spark):
    page = "line\r\n\r\nWARC/1.1\r\n" + "z" * 300
    df = spark.createDataFrame([(1, "http://a/", page)], "page_id long, url string, html string")
    path = f"{warc.archive_folder(spark)}"
    warc.write_captures(df, path)
    row = warc.assemble(warc.read_records(spark, path)).first()
    assert bytes(row.answer.payload).decode() == page and row.request is not None and "page-id: 1" in row.metadata.fields
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


LONG_PARTS = [f"Paragraph {i} of the text goes on for quite some words, so that it is much denser than a list of short labels." for i in range(8)]
BODY_TEXT = "<div>" + "".join(f"<p>{t}</p>" for t in LONG_PARTS) + "</div>"
LABELS = "<div class=zz>" + "".join(f"<p><span>Item {i}</span></p>" for i in range(6)) + "</div>"
MENU = "<nav>" + "".join(f"<a href=/{i}>Page {i}</a>" for i in range(5)) + "</nav>"


@pytest.mark.parametrize("page", [
    f"<body>{LABELS}{BODY_TEXT}{LABELS}</body>", f"<body>{MENU}{LABELS}{BODY_TEXT}{LABELS}<footer>Footer text</footer></body>",
    f"<body>{LABELS}<div>{BODY_TEXT}</div><div class=comments>{BODY_TEXT * 2}</div></body>",
])
def test_unnamed_clutter_goes_by_density(page):
    assert html_text.main_text(page) == "\n".join(LONG_PARTS)


def test_links_of_menus_count():
    nodes = html_text.weigh(html_text.parse(f"<body>{MENU}<p>text</p></body>"))
    assert {n.tag: n.link_tags for n in nodes}["body"] == 5 and {n.tag: n.density for n in nodes}["p"] > 0


def test_paragraphs_and_bare_text_beside_the_best_subtree_stay():
    assert html_text.main_text(f"<body>{LABELS}<p>{LONG_PARTS[0]}</p><div>{''.join(f'<p>{t}</p>' for t in LONG_PARTS[1:])}</div></body>") == "\n".join(LONG_PARTS)
    assert html_text.main_text("<body>" + "bare words " * 40 + "<div><p>x y</p><p>z</p></div></body>").startswith("bare words")


def test_an_embedded_article_does_not_replace_the_text_around_it():
    parts = "".join(f"<p>{t}</p>" for t in LONG_PARTS)
    quoted = "<article><p>A quoted post of another author that is not very long.</p></article>"
    for menu in ("", MENU):
        text = html_text.main_text(f"<body>{menu}<div>{parts}{quoted}</div></body>")
        assert text.split("\n") == [*LONG_PARTS, "A quoted post of another author that is not very long."]
    both = html_text.main_text(f"<body>{MENU}<main><article>{parts}</article><article>{parts}</article>{LABELS}</main></body>")
    assert both.split("\n") == LONG_PARTS * 2


def test_rare_and_varied_toxic_words_find_their_examples(spark):
    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5]
    # No word of a toxic text is in more than two texts of the sample.
    rows = [(i, f"plain common words here {i % 7} " + (f"slur{i // 4} vile{i // 4}" if i % 2 else f"kind{i // 4}")) for i in ids]
    asked = [(1000 + i, f"slur{i // 4} common words") for i in ids if i % 2]
    table = spark.createDataFrame([*rows, *asked], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(table, marks).collect()}
    texts = dict(rows)
    assert all(got[d].evidence and f"{t.split()[0]} " in f"{texts[got[d].evidence[0]]} " and t.split()[0] in got[d].terms for d, t in asked)
    index = toxicity.train(table, marks)
    assert set(index.terms) == {w for t in texts.values() for w in t.split()} and (index.idf > 0).all()


def near_lines_of_any_length(docs):
    """Plain join of all lines that have a token."""
    seen, out = [], {}
    for doc, text in docs:
        kept = []
        for line in text.split("\n"):
            tokens = set(line.replace("\t", " ").replace("\r", " ").split(" ")) - {""}
            if not tokens or not any(5 * len(tokens & s) >= 4 * len(tokens | s) for s in seen):
                kept.append(line)
            if tokens:
                seen.append(tokens)
        out[doc] = "\n".join(kept)
    return out


def test_short_lines_take_part(spark):
    long = "\u6587" * 300
    rows = [
        (1, f"Home\n\nRead more\n{long}\na b c d"), (2, f"Home\n\nmore Read\n{long}\na b c d e"), (3, "Home Home\nown words\na b c"),
        (4, " Home\n\n \nla la la la la la\na b"), (5, f"la la\nb a\n{long}\n\nown"),
    ]
    got = {r.doc_id: (r.text, r.n_left) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = near_lines_of_any_length(rows)
    assert {d: t for d, (t, _) in got.items()} == expected
    assert {d: n for d, (_, n) in got.items()} == {d: sum(bool(x.strip()) for x in t.split("\n")) for d, t in expected.items()}


def test_a_document_stays_while_it_has_a_line(spark):
    import corpus_pipeline

    shared = "one shared line of boilerplate words"
    rows = [(1, shared, 0), (2, f"{shared}\nown\nshort lines", 0), (3, f"{shared}\n" + "\u6587" * 100, 0), (4, f"{shared}\n \n", 0), (5, "", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_copied_lines(spark, table, "").collect()}
    assert got == {1: shared, 2: "own\nshort lines", 3: "\u6587" * 100, 5: ""}


def test_one_row_of_each_group_whatever_the_ids(spark):
    text = lambda w, n=40: " ".join(f"{w}{i}" for i in range(n))
    rows = [(7, text("a")), (7, text("b")), (7, text("c")), (None, text("d")), (None, text("d")), (None, text("a")), (3, text("e")), (5, text("e")), (5, text("f"))]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = [(7, text("a")), (7, text("b")), (7, text("c")), (None, text("d")), (3, text("e")), (5, text("f"))]
    same([tuple(r) for r in kept], expected)


def test_clean_rows_of_a_contaminated_id_stay(spark):
    rows = [(1, f"x {PASSAGE}"), (1, "clean text"), (None, PASSAGE), (None, "another clean text"), (2, None)]
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    kept = decontaminate.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    same([tuple(r) for r in kept], [rows[1], rows[3], rows[4]])


def test_totals_of_unrounded_posteriors_meet_the_targets(spark):
    n = [1000 + i for i in range(200)]
    kinds = [(0.02, 0.004, 0.964, 0.012)] * 9 + [(0.9, 0.02, 0.06, 0.02), (0.02, 0.9, 0.06, 0.02), (0.02, 0.02, 0.06, 0.9)]
    shares = [kinds[i % len(kinds)] for i in range(200)]  # most are below half of 1/20
    columns = "k0 double, k1 double, k2 double, k3 double, n_tokens long, copies long"
    found = spark.createDataFrame([(*p, w, 1) for p, w in zip(shares, n)], columns)
    rated = found.withColumn("rate", mixing._rate(mixing.fit(found))).collect()
    totals = [sum(r.rate * r.n_tokens * r[f"k{d}"] for r in rated) for d in range(4)]
    assert all(abs(t / sum(totals) - x) < 1e-3 for t, x in zip(totals, mixing.TARGETS))


def test_posteriors_are_not_rounded(spark, docs, labels):
    rows = mixing.document_rates(docs, labels).collect()
    assert any(abs(20 * r[f"p_{a}{b}"] - round(20 * r[f"p_{a}{b}"])) > 1e-3 for r in rows for a, b in mixing.DOMAINS)


def test_prefixes_are_shuffled_once_and_pairs_are_whole(spark):
    """The join of the prefixes with themselves has one exchange by token, and finds what a comparison of all pairs finds."""
    words = [f"w{i * i % 997}" for i in range(60)]
    rows = [(i, " ".join(words[(i * 7 + k) % 60] for k in range(5 + i % 23) if (i + k) % 9 or i % 3)) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup._stored(line_dedup.with_prefixes(line_dedup.first_lines(docs), line_dedup.token_levels(docs)), "lines")
    flagged = lines.select("lid", "size", "p0", "p1", "prefix", (F.col("doc_id") % 5 == 0).alias("settled"))
    found = line_dedup._prefix_pairs(flagged)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {frozenset(r) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("Initial Plan")].count("ReusedExchange") == 1
    sets = {r.lid: (set(r.line.split()), r.doc_id % 5 == 0) for r in lines.collect()}
    like = {frozenset((a, b)) for a, (s, x) in sets.items() for b, (t, y) in sets.items()
            if a < b and not (x and y) and 5 * len(s & t) >= 4 * len(s | t)}
    assert like and like <= got


def test_parity_takes_each_token_once(spark):
    """Both halves together hold as many odd bits as the set has tokens, less those that meet on a bit."""
    texts = ["", "a", "a b c d e f g", " ".join(f"t{i}" for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = line_dedup.with_prefixes(line_dedup.first_lines(docs), bytes(line_dedup.BUCKETS)).collect()
    assert sorted(r.size for r in rows) == [1, 7, 300]
    for r in rows:
        bits = sum(bin(p & (1 << 64) - 1).count("1") for p in (r.p0, r.p1))
        assert bits <= r.size and bits % 2 == r.size % 2 and r.prefix == sorted(r.prefix) and len(r.prefix) == r.size - -(-r.size * 4 // 5) + 1


def test_tokens_are_counted_only_where_long_ones_crowd(spark, monkeypatch):
    """Both orders of the tokens remove the same lines, also between sizes on both sides of a power of two."""
    rows = []
    for n in (4, 5, 7, 8, 9, 13, 15, 16, 17, 30, 31, 32, 33, 36, 40):
        words = [f"{'x' * (k % 7)}{k}" for k in range(n)]
        rows += [(100 * n + i, " ".join(words[i:] + [f"{n}-{i}-{j}" for j in range(i // 2)])) for i in range(9) if i < n]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plainly = plain.without_copied_lines(rows)
    count, counted = line_dedup.token_levels, []
    monkeypatch.setattr(line_dedup, "token_levels", lambda d: counted.append(1) or count(d))
    for crowd, times in ((line_dedup.CROWD, 0), (-1, 1)):
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        counted.clear()
        got = line_dedup.dedup_lines(docs).collect()
        same([(r.doc_id, r.text) for r in got], [(d, plainly[d, t]) for d, t in rows])
        assert len(counted) == times
    lines = line_dedup.with_prefixes(line_dedup.first_lines(docs)).withColumn("settled", F.lit(False)).cache()
    got = {frozenset(r) for r in line_dedup._prefix_pairs(lines).collect()}
    sets = {r.lid: set(r.line.split()) for r in lines.collect()}
    like = {frozenset((a, b)) for a, s in sets.items() for b, t in sets.items() if a < b and 5 * len(s & t) >= 4 * len(s | t)}
    assert like and like <= got
    assert any(min(map(len, p)) < 16 <= max(map(len, p)) for p in ([sets[i] for i in pair] for pair in like))
