"""Improbable-feature digests: entropies, choice and bits against scalar versions."""

import collections
import hashlib
import math
import random

import numpy as np

from fieldzones.llm import base, rare_digest as rd
from tests.llm.tables import build, rows_of, sentence


def scalar_levels(raw):
    out = []
    for i in range(len(raw) - rd.WINDOW + 1):
        total = sum(int(rd._TERM[c]) for c in collections.Counter(raw[i:i + rd.WINDOW]).values())
        out.append(int((rd._MOST - total) * ((rd.LEVELS - 1) / rd._MOST)))
    return out


def scalar_digest(raw, rank):
    """Sets of bits, one for each filter."""
    r = [int(rank[x]) for x in scalar_levels(raw)]
    points = collections.Counter()
    for s in range(-(rd.SPREAD - 1), len(r)):
        window = [(r[i], i) for i in range(max(s, 0), min(s + rd.SPREAD, len(r))) if r[i] >= 0]
        if window:
            points[min(window)[1]] += 1
    hashes = []
    for i in sorted(i for i, n in points.items() if n >= rd.POPULAR):
        h = int(rd.feature_hashes(np.frombuffer(raw, np.uint8), np.array([i]))[0])
        if h not in hashes:
            hashes.append(h)
    if not hashes and raw:
        hashes = [int.from_bytes(hashlib.sha256(raw).digest()[:8], "little")]
    return [{(h >> (11 * k)) % rd.BITS for h in hashes[a:a + rd.FULL] for k in range(rd.HASHES)} for a in range(0, len(hashes), rd.FULL)]


def scalar_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if (len(a), sum(map(len, a))) > (len(b), sum(map(len, b))):
        a, b = b, a
    best = []
    for x in a:
        scores = []
        for y in b:
            most, chance = min(len(x), len(y)), len(x) * len(y) / rd.BITS
            cut = chance + rd.CUT * (most - chance)
            scores.append(min(max((len(x & y) - cut) / (most - cut), 0), 1))
        best.append(max(scores))
    return sum(s * len(x) for s, x in zip(best, a)) / sum(map(len, a))


def bits(text):
    d = rd.Digest.parse(text)
    assert str(d) == text
    return [set(np.flatnonzero(row).tolist()) for row in np.unpackbits(d.filters, axis=1)]


def check(rows, got):
    """``got`` against the plain rule for (doc_id, text) rows of different ids."""
    docs = sorted(((i, (t or "")) for i, t in rows), key=lambda d: (d[0] is None, -(d[0] or 0)))
    n = collections.Counter(x for _, t in docs for x in scalar_levels(t.encode()))
    rank = [0] * rd.LEVELS
    for k, x in enumerate(sorted(range(rd.LEVELS), key=lambda x: (n[x], x))):
        rank[x] = k if x >= rd.LEAST else -1
    by = {r["doc_id"]: r for r in got}
    assert len(by) == len(got) == len(docs)
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        r, m = by[i], len(t) // 3
        new = t[:len(t) - m] + after[:m]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = (scalar_digest(x.encode(), rank) for x in (t, new, after))
        assert bits(r["fingerprint"]) == a and bits(r["edited_fingerprint"]) == b
        assert math.isclose(r["near_edited"], scalar_likeness(a, b), abs_tol=1e-6) and math.isclose(r["near_next"], scalar_likeness(a, c), abs_tol=1e-6)


def some_rows():
    rng = random.Random(8)
    rows = [(i * 3, sentence(rng, "en" if i % 2 else "de", rng.choice([0, 3, 9, 15, 40, 200, 900]))) for i in range(40)]
    rows += [(200, None), (201, ""), (202, "a" * 300), (203, "é" * 200 + "x"), (204, rows[5][1]), (205, "ü" * 63), (206, "ab" * 32), (207, "x" * 64), (None, rows[3][1])]
    rng.shuffle(rows)
    return rows


def test_levels_of_lanes():
    rng = np.random.default_rng(1)
    for n in (0, 63, 64, 65, 1000, 3000):
        raw = rng.integers(97, 97 + int(rng.integers(1, 30)), n).astype(np.uint8)
        assert rd.levels(raw).tolist() == scalar_levels(raw.tobytes())
    parts = [bytes(rng.integers(0, 256, k).astype(np.uint8)) for k in (10, 70, 0, 64, 500)]
    assert [x.tolist() for x in rd.levels_of(parts)] == [scalar_levels(p) for p in parts]


def test_against_plain_version(spark, tmp_path, monkeypatch):
    rows = some_rows()
    folder = build(spark, tmp_path, [(i, t, "en", "s") for i, t in rows])
    got = rows_of(spark, "op11_rare_features", folder)
    check(rows, got)
    # more tasks than documents, and one: only ends, or none
    docs = base.table(spark, folder, "documents")
    key = lambda rs: collections.Counter(str(sorted(r.items(), key=str)) for r in rs)
    for n in (1, 70):
        assert key([r.asDict() for r in rd.fingerprints(docs, n).collect()]) == key(got)


def test_single_document(spark, tmp_path):
    r, = rows_of(spark, "op11_rare_features", build(spark, tmp_path, [(1, "one two three " * 30, "en", "s")]))
    assert r["near_next"] == 1.0


def test_odd_rows(spark, odd, odd_rows):
    got = rows_of(spark, "op11_rare_features", odd)
    assert collections.Counter((r["doc_id"], r["n_chars"]) for r in got) == collections.Counter((i, len(t or "")) for i, t, _, _ in odd_rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = collections.defaultdict(set)
    text = {i: t or "" for i, t, _, _ in odd_rows if i is not None and i not in (3, 5, 6)}
    for r in got:
        if r["doc_id"] in text:
            prints[text[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_edits_are_nearer_than_other_texts(spark, sf):
    got = [r for r in rows_of(spark, "op11_rare_features", sf) if r["n_chars"] > 1000]
    assert np.median([r["near_edited"] for r in got]) > 0.4 and np.median([r["near_next"] for r in got]) < 0.05
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.97
