"""Every query over odd and empty tables, against SQL or a brute-force version."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from fieldzones import llm
from tests.llm.tables import SPACE, build, rows_of, sentence, water



def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def remainder(i, m):
    return zlib.crc32(str(i).encode() if i is not None else b"") % m


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_empty_tables(spark, empty, name):
    n = len(rows_of(spark, name, empty))
    assert n == (1 if name.startswith("op10_") else 0)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
@pytest.mark.parametrize("where", ["odd", "sf"])
def test_against_sql(spark, odd, sf, name, where):
    folder = odd if where == "odd" else sf
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if where == 'odd' else ''}'")
    want = con.execute(llm.ORACLES[name])
    names = [c[0] for c in want.description]
    found = llm.QUERIES[name](spark, folder)
    assert sorted(found.columns) == sorted(names)
    assert collections.Counter(map(str, (tuple(r[c] for c in names) for r in found.collect()))) == collections.Counter(map(str, want.fetchall()))


def test_suffix_array_removes_every_later_string(spark, odd, odd_rows):
    texts = sorted({(i is None, i or 0, t) for i, t, _, _ in odd_rows if t is not None})
    groups = collections.defaultdict(list)
    for none, i, t in texts:
        groups[none, i].append(t.encode())
    earliest = {}  # by id, then start, as rows of one id are one document
    for d in sorted(groups):
        for s in range(max(map(len, groups[d]))):
            for k, b in enumerate(groups[d]):
                if s + 100 <= len(b):
                    earliest.setdefault(b[s:s + 100], (d, s, b))
    want = collections.Counter()
    for i, t, _, _ in odd_rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            d0, s0, b0 = earliest[b[s:s + 100]]
            if (d0, s0) < ((i is None, i or 0), s):
                gone[s:s + 100] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[i, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()] += 1
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(spark, "op1_suffix_array", odd))
    assert got == want


def test_split_keys_are_merged(spark, odd):
    """Tiny shards: every key with several contexts is split and merged, with the same result."""
    from fieldzones.llm import base, suffix_dedup

    docs = base.table(spark, odd, "documents").select("doc_id", "text")

    def spans(shard):
        return {(r.did, r.mark): [list(x) for x in zip(*[c.tolist() for c in suffix_dedup.joined(*map(np.array, zip(*[(s.start, s.end) for s in r.spans])))])] for r in suffix_dedup.removals(docs, shard).collect()}

    assert spans(1) == spans(20_000)


def test_language(spark, odd, odd_rows):
    got = rows_of(spark, "op3_nearest_centroid", odd)
    assert len(got) == len(odd_rows)
    lang = {i: lang for i, t, lang, _ in odd_rows if i is not None and i < 40}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (remainder(r["doc_id"], 3) == 1)
        assert r["lang_pred"] in ("en", "de", "und")
        if r["doc_id"] in (40, 41, 42, 45):
            assert r["lang_pred"] == "und" and r["rejected"]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["doc_id"] in lang]) > 0.9


def test_language_held_out(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in rows_of(spark, "op3_nearest_centroid", sf) if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95


def test_mix(spark, odd, odd_rows):
    got = rows_of(spark, "op4_pivotal_rounding", odd)
    again = rows_of(spark, "op4_pivotal_rounding", odd)
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(odd_rows)
    sizes = collections.Counter()
    for _, t, _, s in odd_rows:
        sizes[s] += len(re.findall(SPACE, t or ""))
    want = water(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert {(sizes[s], round(want[s], 6)) for s in sizes} == set(taken)
    for (size, target), n in taken.items():
        assert abs(n - target) <= 0.06 * size + 100 or size > 15_000  # the long text is most of its source


def test_duels_keep_words():
    from fieldzones.llm import mixing

    rng = np.random.default_rng(3)
    size = np.sort(rng.lognormal(5, 1.5, 500).astype(int) + 1)[::-1].astype(float)
    p = rng.random(500)
    out = mixing.duel(rng.integers(0, 1 << 63, 500, dtype=np.uint64), size, p, False)
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 1 and abs((out * size).sum() - (p * size).sum()) < 1e-3
    mean = np.mean([mixing.duel(rng.integers(0, 1 << 63, 60, dtype=np.uint64), size[:60], p[:60], False) for _ in range(1500)], axis=0)
    assert np.abs(mean - p[:60]).max() < 0.08  # expectations stay


def test_tree_of_residuals(spark, sf):
    from fieldzones.llm import base, mixing

    sized = mixing.sizes(base.table(spark, sf, "documents"))
    got = mixing.mix(sized, leaf=4, fan=2).collect()
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        assert 0 <= r.copies <= 3
        by[r.source] = [by[r.source][0] + r.copies * r["size"], r.target, max(by[r.source][2], r["size"])]
    assert len(got) == 200 and all(abs(n - t) <= m for n, t, m in by.values())


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_unigram_base_and_held_out_gain(spark, odd, sf, where):
    folder = odd if where == "odd" else sf
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    tokens = lambda t: re.findall(SPACE, lower(t)) + [None]
    c = collections.Counter(w for i, t in texts if remainder(i, 10) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, remainder(i, 10) == 0, len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 5)) for i, t in texts)
    got = rows_of(spark, "op5_brown_classes", folder)
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    if where == "sf":
        assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_class_model_is_a_distribution(spark, sf):
    from fieldzones.llm import base, class_lm

    model, counts = class_lm.fit(base.table(spark, sf, "documents"), classes=8, head=60, frequent=500)
    words = {base.unsigned([r.word])[0]: r.n for r in counts.collect()}
    for before in range(10):
        total = 0.0
        for w, n in words.items():
            at = model.words.find(np.array([w], np.uint64))[0]
            if w == class_lm.END:
                p1, p0 = model.move[before, 9], (n + 0.1) / model.norm
            elif at >= 0:
                p1, p0 = model.move[before, model.kind[at]] * model.emit[at], model.unigram[at]
            else:
                p1, p0 = model.move[before, 8] * (n + 0.1) / model.rare_norm, (n + 0.1) / model.norm
            total += 0.95 * p1 + 0.05 * p0
        total += 0.95 * model.move[before, 8] * 0.1 / model.rare_norm + 0.05 * 0.1 / model.norm
        assert abs(total - 1) < 1e-6


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    from fieldzones.llm import near_dedup

    rng = np.random.default_rng(1)
    pairs, limits = [], []
    for _ in range(150):
        a = list(rng.integers(0, 9, rng.integers(0, 60)))
        b = list(a)
        for _ in range(rng.integers(0, 14)):
            b[int(rng.integers(0, len(b) + 1)):][:0] = []
            q = int(rng.integers(0, len(b) + 1))
            b[q:q + int(rng.integers(0, 2))] = list(rng.integers(0, 9, rng.integers(0, 2)))
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
        limits.append(int(rng.integers(0, 30)))
    want = [min(edit(list(a), list(b)), m + 1) for (a, b), m in zip(pairs, limits)]
    assert near_dedup.distances(pairs, np.array(limits)).tolist() == want
    least = np.array([near_dedup.lower_bound(a.astype(np.uint64), b.astype(np.uint64)) for a, b in pairs])
    assert all(x <= edit(list(a), list(b)) for x, (a, b) in zip(least, pairs))
    assert near_dedup.distances(pairs, np.array(limits), least).tolist() == want


def test_near_duplicates(spark, odd, odd_rows):
    rows = rows_of(spark, "op6_order_minhash", odd)
    assert len(rows) == len(odd_rows)
    cls = collections.defaultdict(set)
    for r in rows:
        cls[r["doc_id"]].add(r["class_id"])
    assert cls[49] == {7} and cls[53] == cls[12] and cls[50] == cls[8] and cls[3] == {3}
    assert cls[40] == cls[41]  # null counts as empty
    texts = {i: (t or "").split() for i, t, _, _ in odd_rows if i is not None and i < 54 and i not in (6, 43, 47, 48)}
    for a in texts:
        for b in texts:
            if a < b and len(texts[a]) >= 10 and abs(len(texts[a]) - len(texts[b])) <= 0.2 * max(len(texts[a]), len(texts[b])):
                d = edit(texts[a], texts[b]) / max(len(texts[a]), len(texts[b]))
                assert (cls[a] == cls[b]) == (d <= 0.2), (a, b, d)


def test_near_duplicate_rounds(spark, tmp_path):
    """One bucket of several families: leaders of one do not hide the links of the others."""
    rng = np.random.default_rng(9)
    shared = [f"w{i}" for i in range(40)]
    rows, family = [], {}
    for f in range(6):
        own = [f"f{f}x{i}" for i in range(35)]
        for c in range(5):
            words = shared + own
            words[45 + int(rng.integers(0, 25))] = f"edit{f}{c}"
            family[len(rows)] = f
            rows.append((len(rows), " ".join(words), "en", "s"))
    got = rows_of(spark, "op6_order_minhash", build(spark, tmp_path, rows))
    cls = {r["doc_id"]: r["class_id"] for r in got}
    assert all((cls[a] == cls[b]) == (family[a] == family[b]) for a in family for b in family)


def test_near_duplicates_of_one_bucket_all_meet(spark, tmp_path):
    """More components than lead early, and texts at all distances from their family's centre: whoever shares a bucket and is similar is one class."""
    from fieldzones.llm import near_dedup

    rng = np.random.default_rng(12)
    rows = []
    for f in range(5):
        for _ in range(60):
            words = [f"f{f}x{i}" for i in range(100)]
            at, n = int(rng.integers(0, 75)), int(rng.integers(8, 26))
            words[at:at + n] = [f"e{len(rows)}x{i}" for i in range(n)]
            rows.append((len(rows), " ".join(words), "en", "s"))
    got = {r["doc_id"]: r["class_id"] for r in rows_of(spark, "op6_order_minhash", build(spark, tmp_path, rows))}
    texts = [t.split() for _, t, _, _ in rows]
    keys = []
    for t in texts:
        raw = " ".join(t).encode()
        w, first = near_dedup.word_ids(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        keys.append(set(near_dedup.sketch(near_dedup.labelled_runs(w, first)[0]).tolist()))
    ids = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    seqs = [np.array([ids[w] for w in t], np.uint32) for t in texts]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if keys[a] & keys[b]]
    d = near_dedup.distances([(seqs[a], seqs[b]) for a, b in pairs], np.full(len(pairs), 20))
    root = list(range(len(rows)))
    for (a, b), x in zip(pairs, d):
        if x <= 20:
            root = [root[b] if r == root[a] else r for r in root] if root[a] != root[b] else root
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert got == {i: least[r] for i, r in enumerate(root)}


def test_toxicity_and_quality_scores(spark, odd, odd_rows):
    for name, cut, m in (("op7_kneser_ney", 0.3, 4), ("op9_boosted_trees", 0.7, 4)):
        got = rows_of(spark, name, odd)
        assert len(got) == len(odd_rows)
        for r in got:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) and r["held_out"] == (remainder(r["doc_id"], m) == 2)


def test_toxicity_finds_insults(spark, tmp_path):
    import random


    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = sentence(rng, "en", rng.randint(60, 200)).split()
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["blockhead", "nitwit", "dunce"]))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic), "z"))
    got = [r for r in rows_of(spark, "op7_kneser_ney", build(spark, tmp_path, rows, labels)) if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in got]) > 0.97


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(r["predicted"], y[r["doc_id"]]) for r in rows_of(spark, "op7_kneser_ney", folder) if r["held_out"] and y.get(r["doc_id"]) is not None]
    hits, found, toxic = sum(p and t for p, t in got), sum(p for p, _ in got), sum(t for _, t in got)
    assert hits / found > 0.95 and hits / toxic > 0.85, (hits, found, toxic)
    print(f"precision {hits / found:.3f} recall {hits / toxic:.3f}")


@pytest.mark.parametrize("labels", [
    [(i, 1, int(i > 900), "z") for i in range(800, 1000)],  # labels of other documents only
    [(i, 1, 0, "z") for i in range(20)] + [(900, 1, 1, "z")],  # one class is left once they meet the documents
    [(0, 1, 0, "z"), (1, 1, 1, "z"), (1, 1, 1, "z"), (1, 1, 0, "z")],  # repeated labels, one document a class
])
def test_toxicity_labels_without_documents(spark, tmp_path, labels):
    import random

    rng = random.Random(1)
    rows = [(i, sentence(rng, "en", 30), "en", "s") for i in range(30)]
    got = rows_of(spark, "op7_kneser_ney", build(spark, tmp_path, rows, labels))
    assert len(got) == 30 and all(0 <= r["score"] <= 1 for r in got)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in rows_of(spark, "op9_boosted_trees", folder) if r["held_out"] and r["doc_id"] in y]
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in got]) > 0.95


def test_flattened_trees_walk_as_grown():
    from fieldzones.llm import quality_trees

    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, len(quality_trees.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_trees.grow(x, y)

    def one(row):
        total = float(model["start"])
        for at in model["roots"]:
            while model["feature"][at] >= 0:
                at = model["left"][at] if row[model["feature"][at]] <= model["cut"][at] else model["right"][at]
            total += model["value"][at]
        return 1 / (1 + math.exp(-total))

    p = quality_trees.walk(model, x)
    assert np.allclose(p[:50], [one(r) for r in x[:50]]) and np.mean((p > 0.5) == y) > 0.95


def test_winnowing_in_blocks(spark, odd):
    from fieldzones.llm import base, decontamination

    docs, bench = base.table(spark, odd, "documents"), base.table(spark, odd, "benchmark")
    key = lambda rows: collections.Counter(map(str, rows))
    assert key(decontamination.decontaminate(docs, bench, block_words=2).collect()) == key(decontamination.decontaminate(docs, bench).collect())
    kept = collections.Counter(r.doc_id for r in decontamination.clean(docs, bench, block_words=2).collect())
    assert kept == collections.Counter(r.doc_id for r in decontamination.decontaminate(docs, bench).where("NOT contaminated").collect())


def test_content_parts(spark):
    from fieldzones.llm import chat_format

    rows = spark.sql(f"""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, CAST(array(
        named_struct('type', 'text', 'text', 'look <|image|> ', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('type', 'image', 'text', null, 'ref', 'a.png', 'width', 56, 'height', 29, 'seconds', null, 'pages', null),
        named_struct('type', 'audio', 'text', null, 'ref', 'b.wav', 'width', null, 'height', null, 'seconds', 1.5D, 'pages', null),
        named_struct('type', 'document', 'text', null, 'ref', 'c.pdf', 'width', null, 'height', null, 'seconds', null, 'pages', 2)) AS array<{chat_format.PART}>) AS parts
        UNION ALL SELECT 1L, 1L, 'assistant', null""")
    out = chat_format.format_conversations(rows)
    r = out.first()
    assert r.formatted == "<|turn|>user<|body|>look <␛1|image|> <|image|><|audio|><|document|><|end|><|turn|>assistant<|body|><|end|>"
    assert [(a.turn, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 4), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 512)]
    assert r.expanded_tokens == 554 and sum(x.n for x in r.runs) == len(r.formatted)
    assert [tuple(t) for t in chat_format.read_back(out).first().turns] == [("user", "look <|image|> <|image|><|audio|><|document|>"), ("assistant", "")]
