"""The pipeline's stages over odd and empty tables, each against its operator's rule."""

import collections
import re

import corpus_pipeline
from fieldzones.llm import QUERIES, base
from tests.llm.tables import SPACE, rows_of, water


def test_stages(spark, odd, odd_rows, tmp_path):
    docs = base.table(spark, odd, "documents")
    columns = docs.columns
    inputs = {}
    for name, f in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = base.stored(f(spark, docs, odd))
        if name != "mixing":
            assert docs.columns == columns
            assert docs.select("size", "key", "did", "mark", "text_key").distinct().count() == 1  # extra columns stay
    assert docs.columns == [*columns, "copy_"]

    def query(name, stage):
        folder = str(tmp_path / stage)
        inputs[stage].write.parquet(f"{folder}/documents.parquet")
        base.table(spark, odd, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
        return rows_of(spark, name, folder)

    after = {a: inputs[b] for a, b in zip(list(inputs), list(inputs)[1:])}
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(after["language_id"]) == collections.Counter(r["doc_id"] for r in query("op3_nearest_centroid", "language_id") if not r["rejected"])
    near = query("op6_order_minhash", "near_dedup")
    classes = collections.Counter(r["class_id"] for r in near)
    kept = ids(after["near_dedup"])
    assert set(kept) == set(classes) and kept.total() >= len(classes)
    cut = {r["doc_id"]: r for r in query("op1_suffix_array", "suffix_dedup")}
    once = [i for i, n in ids(inputs["suffix_dedup"]).items() if n == 1]
    for r in after["suffix_dedup"].where(after["suffix_dedup"].doc_id.isin(once)).collect():
        if cut[r.doc_id]["n_removed"] == 0:
            assert len((r.text or "").encode()) == cut[r.doc_id]["n_bytes"]
        else:
            assert len(r.text.encode()) <= cut[r.doc_id]["n_bytes"] - cut[r.doc_id]["n_removed"] and r.n_chars == len(r.text)
    assert ids(after["decontamination"]) == collections.Counter(r["doc_id"] for r in query("op8_winnowing", "decontamination") if not r["contaminated"])
    sizes = collections.Counter()
    for r in inputs["mixing"].collect():
        sizes[r.source] += len(re.findall(SPACE, r.text or ""))
    taken = collections.Counter()
    for r in docs.collect():
        taken[r.source] += len(re.findall(SPACE, r.text or ""))
        assert r.copy_ in (1, 2, 3)
    for s, t in water(dict(sizes)).items():
        assert abs(taken[s] - t) <= 0.06 * sizes[s] + 100 or sizes[s] > 15_000


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
