"""Archives of any size and make, and rates against plain least squares."""

import gzip
import hashlib
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tauflow.llm import mixing, warc


def response(number, payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.{number % 2}\r\nWARC-Type: response\r\nWARC-Record-ID: <{number}>\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


ODD = [b"", b"WARC/1.", b"xWARC/1.1\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nWARC/1.", b"WARWARC/1.WARC/1.", b"\r\n\r\n\r\n", bytes(range(256)) * 40, b"\xff\xfeWARC/1"]


def test_records_of_any_payload_by_member_or_by_file(spark):
    """One gzip member per record, as crawlers write them, or one per file."""
    path = warc.archive_folder(spark)
    spark.createDataFrame([("x",)], "value string").write.text(path)  # makes the folder; not a gzip file
    local = path.removeprefix("file:")
    records = [response(i, p) for i, p in enumerate(ODD)]
    with open(f"{local}/a.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(r) for r in records))
    with open(f"{local}/b.warc.gz", "wb") as f:
        f.write(gzip.compress(b"".join(records)))
    with open(f"{local}/c.warc.gz", "wb") as f:
        f.write(gzip.compress(b""))
    got = sorted((int(r.record_id[1:-1]), bytes(r.payload), r.digest, r.payload_bytes) for r in warc.read_records(spark, path).collect())
    assert got == sorted((i, p, hashlib.sha256(p).hexdigest(), len(p)) for i, p in enumerate(ODD) for _ in range(2))


def test_broken_archives_are_refused():
    whole = b"".join(response(i, p) for i, p in enumerate(ODD))
    assert [r["block"].partition(b"\r\n\r\n")[2] for r in warc.parse_records(whole)] == ODD
    for broken in (b"junk" + whole, whole[:-8], whole + b"junk", whole + b"WARC/1.1\r\nContent-Length"):
        with pytest.raises(ValueError):
            list(warc.parse_records(broken))
    assert list(warc.parse_records(b"")) == []


def test_an_archive_is_read_record_by_record():
    """200 MB of records, some of them with a thousand marks inside, pass in the memory of a few records."""
    payload = b"z" * 50_000 + warc.MARK * 1000 + b"z" * 50_000

    def pieces():
        yield b""
        for i in range(2000):
            yield from response(i, payload).split(warc.MARK)[1:]

    tracemalloc.start()
    n = sum(len(r["block"]) > 100_000 for r in warc.records_of(pieces()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 and peak < 4 << 20


def test_a_payload_of_most_pages_is_spread(spark):
    rows = [(i, f"http://{i}/", "the same page " * 20 if i % 3 else f"page {i} " * 20) for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_round_trip(df).collect()
    assert len(got) == 900 and {r.refers_to for r in got if r.page_id % 3 and r.page_id > 1} == {1}
    assert {r.page_id for r in got if r.record_type == "response"} == {1, *range(0, 900, 3)}
    assert all(r.payload_bytes == len(rows[r.page_id][2]) for r in got)
    assert df.select(warc._part("page_id", "url")).distinct().count() == warc.PARTS


def least_squares(p, n, targets):
    """Plain projected gradient in the same measure, many steps: gaps, their squares, and whether the targets are met."""
    own, gram = n @ p, (p * n[:, None]).T @ p
    inverse = np.linalg.pinv(gram, hermitian=True)
    lead = int(np.argmax(targets))
    goal = np.array(targets) / targets[lead] * own[lead]
    r = np.ones(len(n))
    for _ in range(50_000):
        r = np.maximum(0.0, r - p @ (inverse @ ((n * r) @ p - goal)))
    gaps = (n * r) @ p - goal
    return goal, float(gaps @ inverse @ gaps), bool(np.all(np.abs(gaps) <= mixing.CLOSE * goal)), inverse


@pytest.mark.parametrize("kind", ["sharp", "one domain"])
def test_rates_equal_plain_least_squares(spark, kind):
    rng = np.random.default_rng(7)
    if kind == "sharp":
        p = rng.dirichlet((0.3, 0.05, 0.6, 0.05), 300)
    else:  # nearly all of one domain: no rates meet the targets
        p = np.abs(np.tile((0.918, 0.031, 0.031, 0.020), (300, 1)) + rng.normal(0, 0.003, (300, 4)))
        p /= p.sum(axis=1, keepdims=True)
    n = rng.integers(1, 400, 300)
    goal, squares, met, inverse = least_squares(p, n.astype(float), mixing.TARGETS)
    found = spark.createDataFrame(
        [(*map(float, x), int(w), 1) for x, w in zip(p, n)], "k0 double, k1 double, k2 double, k3 double, n_tokens long, copies long"
    ).coalesce(1).cache()
    fitted = mixing.fit(found)
    rates = found.select("*", mixing._rate(fitted).alias("rate")).collect()
    totals = np.array([sum(r.rate * r.n_tokens * r[f"k{d}"] for r in rates) for d in range(4)])
    assert all(r.rate >= 0 for r in rates) and np.allclose(totals, fitted.reached) and np.allclose(goal, fitted.wanted)
    assert fitted.met == met == (kind == "sharp")
    gaps = totals - goal
    if met:
        assert np.all(np.abs(gaps) <= mixing.CLOSE * goal)
    else:
        assert gaps @ inverse @ gaps <= squares * 1.01
    found.unpersist()


def test_rates_without_words(spark):
    schema = "k0 double, k1 double, k2 double, k3 double, n_tokens long, copies long"
    assert mixing.fit(spark.createDataFrame([], schema)).met
    fitted = mixing.fit(spark.createDataFrame([(0.25, 0.25, 0.25, 0.25, 0, 3)], schema))
    assert fitted.steps == [] and fitted.met


def test_result_says_whether_targets_are_met(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, None)], "doc_id long, text string").withColumn("met", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert {type(r.met) for r in mixing.document_rates(docs, labels).collect()} == {bool}
    assert mixing.mix_documents(docs, labels).columns == ["doc_id", "text", "met", "rate"]
