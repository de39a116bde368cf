"""Importance resampling, ranked search and byte-level BPE against plain versions, with nulls, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from tauflow.llm import byte_bpe, lexical, resample
from tauflow.llm.word_bytes import words

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PLAIN = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon phi".split()
TEXTS = [
    " ".join(PLAIN), " ".join(PLAIN), " ".join(reversed(PLAIN)), None, "", "K ſ É İ NAÏVE x\x00y\x85z", "a" * 3000 + " " + " ".join(PLAIN),
    "漢" * 700, *(" ".join(PLAIN[i:] + PLAIN[:i]) for i in range(12)), " ".join(f"w{i % 97}" for i in range(20_000)),
    " ".join(PLAIN), "don't we'll they've 'tis  \n\n x ", " ".join(PLAIN),
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (0, "alpha beta"), (None, TEXTS[0]), (None, None)]
ITEMS = [(1, "alpha beta gamma"), (2, "Alpha beta gamma delta w5"), (2, "naïve"), (3, None), (4, " .,"), (None, "alpha omikron 漢"), (5, "absent words")]
CLASHES = "n terms times score rank item part bucket weight tokens ids offsets decoded _row _id _down n_words".split()


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def same(got, expected):
    assert sorted(map(str, got)) == sorted(map(str, expected))


@pytest.mark.parametrize("text", [t or "" for t in TEXTS[:8]])
def test_words(text):
    assert [w.decode() for w in words(text)] == plain_words(text)


def features(text):
    w = plain_words(text)
    return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def plain_resample(rows, items, percent):
    source, target = (sum((features(t) for _, t in table), Counter()) for table in (rows, items))
    s, t = source.total() + 10_000, target.total() + 10_000
    scored = []
    for doc_id, text in rows:
        own = features(text)
        weight = sum(n * math.floor(1000 * math.log((target[b] + 1) * s / ((source[b] + 1) * t))) for b, n in own.items())
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc_id, own.total(), weight, score, len(plain_words(text))))
    order = sorted((r for r in scored if r[4] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = order[: percent * len(order) // 100]
    return [(*r[:4], i + 1, r[4]) for i, r in enumerate(drawn)], scored, drawn


@pytest.mark.parametrize("percent", [0, 5, 12, 50, 100])
def test_resample(docs, items, percent):
    got = [tuple(r) for r in resample.resample(docs, items, percent).collect()]
    expected, scored, drawn = plain_resample(ROWS, ITEMS, percent)
    same([r for r in got if r[4] is not None], expected)
    same([(*r[:4], r[5]) for r in got], scored)
    assert len(drawn) == len(expected)


def test_resample_of_many_ties(spark):
    """One text and one id hold most rows: the cut runs through equal rows, and exactly as many as asked are drawn."""
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("doc_id"), F.lit(TEXTS[0]).alias("text"))
    got = resample.resample(rows, rows.limit(1)).where("rank is not null").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 46))
    ordered = sorted(got, key=lambda r: r["rank"])
    assert [r.score for r in ordered] == sorted((r.score for r in got), reverse=True)


def test_resample_of_empty_tables(docs, items):
    assert resample.resample(docs.where("false"), items).collect() == []
    expected, scored, _ = plain_resample(ROWS, [], 5)
    same([(*tuple(r)[:4], r[5]) for r in resample.resample(docs, items.where("false")).collect()], scored)


def test_joined_crc_of_words_of_any_length():
    for _ in range(200):
        own = [random.choice("ab漢") * random.choice([1, 2, 5, 63, 64, 300, 5000]) for _ in range(4)]
        coded = [w.encode() for w in own]
        got = [sorted(b.tolist()) for b, _ in resample.feature_buckets(coded, np.array([4]))]
        assert got == [sorted(zlib.crc32(b" ".join(coded[i : i + k])) % 10_000 for i in range(5 - k)) for k in (1, 2, 3)]


def plain_search(rows, items, top=10):
    own = {}
    for item_id, text in items:
        own.setdefault(item_id, set()).update(plain_words(text))
    counted = [(d, Counter(plain_words(t))) for d, t in rows if plain_words(t)]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(chain.from_iterable(c.keys() for _, c in counted))
    found = []
    for item_id, terms in own.items():
        scores = []
        for doc_id, c in counted:
            m = 10 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, math.inf if doc_id is None else doc_id))
        found += [(item_id, i + 1, None if d == math.inf else d, -s) for i, (s, d) in enumerate(sorted(scores)[:top])]
    return found


@pytest.mark.parametrize("block", [lexical.BLOCK, 6])
def test_search(docs, items, block):
    same([tuple(r) for r in lexical.search(docs, items, block=block).collect()], plain_search(ROWS, ITEMS))


def test_search_keeps_all_better_documents_of_a_batch(spark, items):
    rows = [(i, "alpha " * (1 + i % 7) + "filler " * (i % 11)) for i in range(3000)] + [(9000, "beta")]
    got = lexical.search(spark.createDataFrame(rows, "doc_id long, text string"), items, top=25).collect()
    same([tuple(r) for r in got], plain_search(rows, ITEMS, 25))


def test_search_of_empty_tables(docs, items):
    assert lexical.search(docs.where("false"), items).collect() == []
    assert lexical.search(docs, items.where("false")).collect() == []


def test_sharing_saves_additions_and_keeps_sums():
    rng = random.Random(3)
    common = [set(rng.sample(range(40), 12)) for _ in range(6)]
    sets = [set().union(*rng.sample(common, 2)) | {40 + i} for i in range(60)] + [set()]
    sharing = lexical.mine_sharing(sets, 100)
    values = np.array([rng.randrange(1000) for _ in range(100)])
    terms = np.arange(100)
    got = dict(lexical.item_scores(sharing, np.zeros(100, np.int64), terms, values, 1))
    assert [int(got[i][0]) if i in got else 0 for i in range(len(sets))] == [int(sum(values[t] for t in s)) for s in sets]
    assert sharing.additions() < sum(len(s) - 1 for s in sets if s) / 3


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        vocabulary = byte_bpe.Vocabulary(file.read())
    return vocabulary, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_pieces_equal_the_library(library):
    vocabulary, encoding = library
    rng = random.Random(5)
    letters = [*"'strevlmdxL \n\t1!.", " ", "٣", "é", "漢", "́", "😀", "\x00", " ", "ſ"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(5000)]
    texts += ["a" * 20_000, "漢" * 9000, " " * 5000, "<|endoftext|>", "'", "''s", " 's", "\n's", "'re've'll'lx'rx"]
    ids, offsets = vocabulary.encode(texts)
    for text, own, at in zip(texts, ids, offsets):
        assert np.frombuffer(own, "<u4").tolist() == encoding.encode_ordinary(text)
        assert vocabulary.decode(own, at) == vocabulary.decode(own) == text.encode()
        starts = [0, *np.cumsum([len(encoding.decode_single_token_bytes(int(i))) for i in np.frombuffer(own, "<u4")])]
        assert np.frombuffer(at, "<u4").tolist() == starts[:-1]


def test_scan_equals_a_loop():
    rng = np.random.default_rng(1)
    number, _, apply, _ = byte_bpe.automaton()
    for n in (1, 2, 3, 50, 1000, 4097):
        kinds = rng.integers(0, byte_bpe.OTHER + 1, n).astype(np.uint8)
        state, states = byte_bpe.START, []
        for k in kinds:
            states.append(state)
            state = int(apply[number[k], state])
        assert byte_bpe.states_before(kinds).tolist() == states


def test_full_cache_is_emptied(library, monkeypatch):
    vocabulary, encoding = library
    monkeypatch.setattr(byte_bpe, "CACHED", 2)
    text = "one two three four one two three"
    assert np.frombuffer(vocabulary.encode([text])[0][0], "<u4").tolist() == encoding.encode_ordinary(text)


def test_token_digests(docs, library):
    _, encoding = library

    def digests(text):
        ids = encoding.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = byte_bpe.token_digests(docs, RANKS).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    same([tuple(r) for r in got], [(d, *digests(t)) for d, t in ROWS])
    assert byte_bpe.token_digests(docs.where("false"), RANKS).collect() == []
