"""Runs of words: union of suffix classes against a search over all periods."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from fieldzones.llm import period_runs
from tests.llm.tables import SPACE, rows_of


def brute(w):
    """Every period q, every maximal stretch of places that agree with those q words on."""
    n, found = len(w), []
    for q in range(1, n // 3 + 1):
        s = 0
        while s < n - q:
            if w[s] != w[s + q]:
                s += 1
                continue
            e = s
            while e < n - q and w[e] == w[e + q]:
                e += 1
            length = e - s + q
            if length >= max(24, 3 * q):
                part = w[s:s + length]
                if not any(all(part[i] == part[i + r] for i in range(length - r)) for r in range(1, q)):
                    found.append((s, length, q))
            s = e
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(seed):
    rng = random.Random(seed)
    w = []
    while len(w) < 400:
        kind = rng.random()
        if kind < 0.3:
            w += [rng.randint(0, 3) for _ in range(rng.randint(1, 30))]
        elif kind < 0.6:
            w += [rng.randint(0, 900) for _ in range(rng.randint(1, 30))]
        else:
            cycle = [rng.randint(0, 5) for _ in range(rng.randint(1, 25))]
            w += (cycle * rng.randint(2, 9))[:rng.randint(5, 200)]
            if kind > 0.9:
                w += w[-rng.randint(1, len(w)):]
    return w


def test_runs_are_all_and_only_those(monkeypatch):
    total = 0
    for seed in range(60):
        w = texts(seed)
        want = brute(w)
        total += len(want)
        assert period_runs.runs(np.array(w, np.int64)) == want, seed
    assert total > 150
    monkeypatch.setattr(period_runs, "BLOCK", 3)  # position sets of many blocks
    for seed in range(25):
        w = texts(seed)
        assert period_runs.runs(np.array(w, np.int64)) == brute(w)


def test_whole_text_of_one_word_and_none():
    assert period_runs.runs(np.zeros(5000, np.int64)) == [(0, 5000, 1)]
    assert period_runs.runs(np.zeros(23, np.int64)) == [] == period_runs.runs(np.zeros(0, np.int64))
    assert period_runs.runs(np.array([1, 2] * 12, np.int64)) == [(0, 24, 2)]


def expected(doc_id, text):
    w = re.findall(SPACE, text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w) if n < 3000 else period_runs.runs(np.unique(w, return_inverse=True)[1].astype(np.int64))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, odd, odd_rows, sf):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for folder, rows in ((odd, [(i, t) for i, t, _, _ in odd_rows]), (sf, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])):
        got = collections.Counter(tuple(r[c] for c in columns) for r in rows_of(spark, "op12_period_runs", folder))
        assert got == collections.Counter(expected(i, t) for i, t in rows)


def test_pieces_do_not_change_results(spark, odd):
    from fieldzones.llm import base

    docs = base.table(spark, odd, "documents")
    key = lambda df: collections.Counter(map(str, df.collect()))
    assert key(period_runs.period_runs(docs, period_runs.planted, 1)) == key(period_runs.period_runs(docs, period_runs.planted))
