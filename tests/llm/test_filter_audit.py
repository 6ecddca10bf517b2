"""The filter audit: shards, dictionary and counts against plain Python."""

import collections
import itertools
import re

from fieldzones.llm import base, filter_audit
from tests.llm.tables import SPACE, rows_of


def test_matrix_of_tiny_shards(spark, odd, odd_rows):
    """Every document is a shard of its own; equal words have equal numbers in all of them."""
    docs = base.table(spark, odd, "documents")
    rows = filter_audit.term_matrix(docs, 1).collect()
    assert sum(len(r.doc_id) for r in rows) == len(odd_rows) and len(rows) > 30
    want = collections.Counter(w for _, t, _, _ in odd_rows for w in re.findall(SPACE, t or ""))
    got = collections.Counter()
    for r in rows:
        assert list(r.starts) == sorted(r.starts) and r.starts[-1] == len(r.numbers) == len(r.counts)
        for a, b in zip(r.starts, r.starts[1:]):
            assert len(set(r.numbers[a:b])) == b - a
        for n, c in zip(r.numbers, r.counts):
            got[n] += c
    assert sorted(got.values()) == sorted(want.values())
    whole = filter_audit.term_matrix(docs).collect()
    again = collections.Counter()
    for r in whole:
        for n, c in zip(r.numbers, r.counts):
            again[n] += c
    assert again == got  # a word's number does not depend on the shards


def test_audit_by_simulation(spark, odd, odd_rows):
    """All 120 orders, document by document, of the part that null and empty sources share."""
    least = {}
    for i, t, _, _ in odd_rows:
        least[t or ""] = min(least.get(t or "", (True, 0)), (i is None, i or 0))

    def fails(i, t):
        t = t or ""
        w = re.findall(SPACE, t)
        return {f for f, hit in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)),
                                 ("D", re.search("[#$%&*|]", t)), ("E", least[t] < (i is None, i or 0))) if hit}

    part = [(i, fails(i, t)) for i, t, _, s in odd_rows if (s or "") == ""]
    got = {(r["filter_order"], r["step"]): r for r in rows_of(spark, "op13_filter_audit", odd) if r["part"] == ""}
    assert len(got) == 600
    shapley = collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        left = part
        for k, f in enumerate(order, 1):
            r = got[order, k]
            gone = [x for x in left if f in x[1]]
            left = [x for x in left if f not in x[1]]
            shapley[f] += len(gone)
            assert (r["kept"], r["removed"], r["redundant"]) == (len(left), len(gone), sum(f in x[1] for x in part) - len(gone))
            assert r["unique_fails"] == sum(x[1] == {f} for x in part)
    assert all(r["shapley"] == shapley[o[k - 1]] for (o, k), r in got.items())
