"""The pipeline's stages one after the other, each against a brute-force version over what the stage before kept."""

from collections import Counter

import corpus_pipeline
from docketloom.llm.common import stage
from tests.llm import samples
from tests.llm.test_mixing import number, poisson_inverse
from tests.llm.test_ngram_join import brute


def test_stages(spark):
    docs = samples.documents(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "bpe"]
    kept = [docs]
    for name, step in corpus_pipeline.STAGES:
        kept.append(stage(step(spark, kept[-1], samples.SF), f"test-{name}"))
    toxic, exact, near, mixed, encoded = ([tuple(r) for r in k.collect()] for k in kept[1:])
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    for k in kept[1:-1]:
        assert k.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{samples.SF}/labels.parquet").collect()}
    clean = [d for d, y in labels.items() if not y]
    assert all(r == rows[r[0]] for r in toxic) and sum(d in {r[0] for r in toxic} for d in clean) >= 0.8 * len(clean)
    best = {}
    for r in toxic:
        best[r[1] or ""] = max(r[0], best.get(r[1] or "", r[0]))
    assert sorted(r[0] for r in exact) == sorted(best.values())
    assert sorted(r[0] for r in near) == sorted(d for d, _, c in brute([(r[0], r[1]) for r in exact]) if d == c)
    n = Counter(r[3] for r in near)
    w = {s: k**0.7 for s, k in n.items()}
    want = Counter()
    for r in near:
        want[r[0]] += poisson_inverse(number(29, r[0], 1), len(near) * w[r[3]] / sum(w.values()) / n[r[3]])
    assert Counter(r[0] for r in mixed) == +want
    assert Counter(r[0] for r in encoded) == +want


def test_run_and_null_rows(spark, tmp_path):
    table = samples.table(spark)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
