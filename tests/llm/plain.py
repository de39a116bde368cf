"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import xxhash

LOW = str.maketrans({c: c + 32 for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fingerprint(text):
    words = SPACED.findall((text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(prints: list[int], ids: list, distance: int = 4) -> list:
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(prints, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= distance):
            parent[find(i)] = find(int(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def contamination(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = WORDS.findall((text or "").translate(LOW))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(item)
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        words = WORDS.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(words) - n + 1):
                if (got := windows.get(tuple(words[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= {str(x) for x in got if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def without_copied_lines(docs):
    """Texts by (doc_id, text), earlier matches by doc_id (null first), then line number."""
    exact, sets, postings, out = {}, [], collections.defaultdict(set), {}
    for doc, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        kept = []
        for line in [] if text is None else text.split("\n"):
            tokens = frozenset(re.findall(r"[^\x20\x09\x0D]+", line))
            if not tokens:
                kept.append(line)
                continue
            if line in exact:
                continue
            exact[line] = True
            near = set().union(*[postings[t] for t in tokens])
            if not any(9 * len(tokens & sets[c]) >= 4 * (len(tokens) + len(sets[c])) for c in near):
                kept.append(line)
            for t in tokens:
                postings[t].add(len(sets))
            sets.append(tokens)
        out[doc, text] = None if text is None else "\n".join(kept)
    return out


def repetition(text):
    text = text or ""
    words = SPACED.findall(text)
    n = len(words)
    runs = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(n - 2) if runs[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            lines += line in seen
            seen.add(line)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), failed


def base_secrets(text):
    text = text or ""
    assign = re.compile(
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
    )
    found = [(*m.span(), 0) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(*m.span(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(*m.span(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort(key=lambda s: (s[0], s[2]))
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, b, k in found)
