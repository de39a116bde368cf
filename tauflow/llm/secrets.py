"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions only near hits, checksum validation.

One pass over each text. The automaton finds every keyword in any ASCII case; an expression is tried only
at the positions where its keyword stands. Runs of hex digits have no keyword: a byte table turns digits
into one mark, and only texts with 24 marks in a row are searched. Tokens with an embedded checksum
(``github``, ``npm``: base62 CRC-32 in the last six characters; ``xprv``: base58 with four bytes of double
SHA-256) count only if the checksum holds.

Null and empty texts have no spans; texts of any length are scanned whole; repeated rows each get their row.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauflow.llm.common import record

# Kinds in the order of the output, keywords, and the alphabets of the two number texts.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SUM62 = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
_MARKS = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))

SPANS = record(n_assign="long", n_access="long", n_hex="long", base_sha256="string", spans="string")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("github", GITHUB_WORDS), ("npm", ("npm_",)), ("xprv", ("xprv",))):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _base62_sum(body: str) -> str:
    value, text = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        text = BASE62[digit] + text
    return text


def _base58_holds(text: str) -> bool:
    value = 0
    for c in text:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big").rjust(82, b"\0")
    return len(raw) == 82 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, ordered by start, then kind."""
    if not text:
        return []
    data = text.encode()
    folded = text.lower() if text.isascii() else data.lower().decode()
    found, ends = [], dict.fromkeys(KINDS, 0)
    starts = sorted((last - size + 1, kind) for last, (kind, size) in _automaton().iter(folded))
    for start, kind in starts:
        if start < ends[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            good = m and len(m[2]) >= 6
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m and len(m[0]) >= 20
        elif kind == "xprv":
            m = XPRV.match(text, start)
            good = m and _base58_holds(m[0])
        else:
            m = SUM62.match(text, start)
            good = m and _base62_sum(m[1]) == m[2]
        if m:
            ends[kind] = m.end()
        if good:
            found.append((start, m.end(), kind))
    if b"h" * 24 in data.translate(_MARKS):
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


@F.pandas_udf(SPANS)
def secret_spans(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = find_secrets(text)
        counts = [sum(s[2] == kind for s in spans) for kind in KINDS[:3]]
        base = _joined([s for s in spans if s[2] in KINDS[:3]])
        rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
    return pd.DataFrame(rows, columns=SPANS.names)


def scan_secrets(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """One row per document row: doc_id, counts of the base kinds, hash of the base spans, all spans."""
    return docs.select("doc_id", secret_spans(text).alias("_s")).select("doc_id", "_s.*")
