"""The pipeline against its stages, and the registry."""

import corpus_pipeline
from loomway.core import materialize
from loomway.llm import registry


def test_stages(spark, docs, tmp_path):
    line = "A line of more than forty characters that returns in every text."
    body = lambda i: "\n".join(" ".join(f"w{i}x{k}y{j}" for k in range(12)) + "." for j in range(4))
    rows = [(i, f"{body(i // 2 if i < 4 else i)}\n{line}", "en", "ab"[i % 2], 0) for i in range(12)] + [(50, "too short", "en", "a", 9), (51, None, None, None, None)]
    d = docs(*rows)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = d, {}
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)))
        seen[name] = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == d.columns
    assert sorted(r["doc_id"] for r in seen["quality rules"].collect()) == list(range(12))
    assert sum(line in r["text"] for r in seen["line dedup"].collect()) == 1
    assert sorted(r["doc_id"] for r in seen["near duplicates"].collect()) == [0, 2, *range(4, 12)]
    assert {"sequence_id", "offset", "length"} <= set(seen["packing"].columns)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, seen["packing"].collect()))


def test_registry():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
