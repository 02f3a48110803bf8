import corpus_pipeline
from pyspark.sql import functions as F

from svcgraph.llm import decontamination, language_id, packing, pii
from svcgraph.llm.common import materialize


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialize(stage(spark, docs, sf), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and all(before[i] == t for i, t in after.items())
        if name == "language":
            assert {i for i, t in before.items() if any(c.isalpha() for c in t or "")} == set(after)
        if name == "near_duplicates":
            def shingles(t):
                w = (t or "").lower().split()
                return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

            sets = {i: shingles(t) for i, t in before.items()}
            near = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
            root = {i: i for i in sets}
            for a in sorted(sets):
                for b in sorted(sets):
                    if a < b and near(a, b):
                        x, y = a, b
                        while root[x] != x:
                            x = root[x]
                        while root[y] != y:
                            y = root[y]
                        root[max(x, y)] = min(x, y)
            assert {i for i in sets if root[i] == i} == set(after)
        if name == "decontaminate":
            items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert all(i in after or any(x in decontamination.normal(t) for x in items) for i, t in before.items())
            assert not any(x in decontamination.normal(t) for t in after.values() for x in items)
    clean = materialize(corpus_pipeline.personal_data(spark, docs, sf), "clean")
    assert clean.count() == docs.count() <= n and clean.columns == columns
    assert not any(pii.base_spans(r.text) for r in clean.collect())
    pieces = corpus_pipeline.pack(spark, clean, sf)
    assert pieces.agg(F.sum("length")).first()[0] == packing.tokenize_partitions(clean).agg(F.sum("n")).first()[0]
    assert language_id.learn(docs)
