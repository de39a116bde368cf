"""Each query over a whole small table against its plain version, or held-out accuracy."""

import collections
import hashlib

import pytest

import corpus_pipeline
from tauflow.llm import queries as q
from tests.llm import plain


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    return {"documents": [r[:2] for r in read("documents")], "pages": read("pages"), "benchmark": read("benchmark"), "labels": read("labels")}


def test_all_are_registered():
    import __spark_entry__

    names = [n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 14)] and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("query,label,at,least", [(q.op1_quality, 1, 0.3, 0.9), (q.op4_toxicity, 2, 0.5, 0.85)])
def test_classifier_holds_on_held_out_rows(spark, tables, query, label, at, least):
    # A larger table than the others: a classifier needs labels.
    folder, n = ("/root/testdata/sf0.1", 10_000) if query is q.op4_toxicity else ("/root/testdata/sf0.01", 1000)
    rows = query(spark, folder).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == n
    import zlib

    right, marks = [], collections.Counter()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= at)
        if r.held_out and r.doc_id in labels:
            right.append(r.predicted == labels[r.doc_id])
            marks[r.predicted, labels[r.doc_id]] += 1
    assert sum(right) / len(right) >= least
    # Both labels are found; a model that always says the same is none. Few rows carry toxic 1.
    for value in (0, 1):
        found = marks[value, value] / max(1, marks[0, value] + marks[1, value])
        assert found >= 0.8, (value, marks)


def test_lines(spark, sf_dir, tables):
    expected = plain.without_copied_lines(tables["documents"])
    got = {r.doc_id: r.text for r in q.op2_line_dedup(spark, sf_dir).collect()}
    assert got == {d: expected[d, t] for d, t in tables["documents"]}


def test_contamination(spark, sf_dir, tables):
    got = [tuple(r)[:6] for r in q.op3_decontamination(spark, sf_dir).collect()]
    assert sorted(got) == sorted(plain.contamination(tables["documents"], tables["benchmark"]))


def test_page_texts(spark, sf_dir, tables):
    got = {r.page_id: r for r in q.op5_html_text(spark, sf_dir).collect()}
    assert len(got) == len(tables["pages"])
    for page_id, _, html in tables["pages"]:
        article = html.partition("<article>")[2].partition("</article>")[0]
        assert got[page_id].n_chars == len(got[page_id].text) > 0
        assert "<" not in article or "<p>" not in got[page_id].text
        assert "&copy;" not in got[page_id].text and "©" not in got[page_id].text


def test_archives(spark, sf_dir, tables):
    first = {}
    for page_id, _, html in sorted(tables["pages"]):
        first.setdefault(html, page_id)
    expected = []
    for page_id, _, html in tables["pages"]:
        data = html.encode()
        copy = len(data) >= 100 and first[html] != page_id
        expected.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if copy else "response", first[html] if copy else None))
    got = [tuple(r)[:5] for r in q.op6_warc(spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_rates_meet_targets(spark, sf_dir):
    from tauflow.llm import mixing

    rows = q.op7_mixing(spark, sf_dir).collect()
    assert len(rows) == 200 and min(r.rate for r in rows) >= 0
    totals = [sum(r.rate * r.n_tokens * r[f"p_{a}{b}"] for r in rows) for a, b in mixing.DOMAINS]
    used = [t for t, x in zip(mixing.TARGETS, totals) if x > 0]
    for share, total in zip(mixing.TARGETS, totals):
        if total > 0:
            assert abs(total / sum(totals) - share / sum(used)) < 0.01


def test_fingerprints(spark, sf_dir, tables):
    ids, texts = zip(*tables["documents"])
    prints = [plain.fingerprint(t) for t in texts]
    expected = {d: (f"{p:016x}", c) for d, p, c in zip(ids, prints, plain.components(prints, list(ids)))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in q.op8_simhash(spark, sf_dir).collect()} == expected


def test_repetition(spark, sf_dir, tables):
    got = {r.doc_id: tuple(r)[1:7] for r in q.op9_quality_rules(spark, sf_dir).collect()}
    assert got == {d: plain.repetition(t) for d, t in tables["documents"]}


def test_secrets(spark, sf_dir, tables):
    got = {r.doc_id: r for r in q.op10_secrets(spark, sf_dir).collect()}
    for d, t in tables["documents"]:
        base = plain.base_secrets(t)
        kinds = collections.Counter(s.split(":")[0] for s in base.split(",") if s)
        assert got[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(filter(None, base.split(","))) <= set(got[d].spans.split(","))


def test_pipeline_stages(spark, sf_dir, tables):
    """Each stage against the plain version on its own input."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        before, docs = [tuple(r)[:2] for r in docs.collect()], spark.read.parquet(f"{folder}/{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == (columns if name != "mixing" else [*columns, "rate"])
        if name == "line_dedup":
            texts = plain.without_copied_lines(before)
            assert all(after[d] == texts[d, t] for d, t in before if d in after)
            assert len(after) < len(before)
        elif name == "simhash":
            ids = [d for d, _ in before]
            assert set(after) == set(plain.components([plain.fingerprint(t) for _, t in before], ids))
        elif name == "decontamination":
            assert set(after) == {r[0] for r in plain.contamination(before, tables["benchmark"]) if not r[5]}
        elif name == "mixing":
            assert set(after) == {d for d, _ in before}
