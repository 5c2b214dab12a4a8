"""The pipeline against the stages done by brute force on a small table."""

import hashlib
import random
import re
from collections import Counter


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randint(0, 9000)}" for _ in range(n))
    clean = [text(rng.randint(30, 400)) for _ in range(80)]
    toxic = [f"{text(60)} moron {text(30)} scumbag" for _ in range(30)]
    near = [" ".join(w if k != 15 else "other" for k, w in enumerate(t.split())) for t in clean if len(t.split()) > 150][:10]
    data = [*clean, *toxic, *clean[:20], *[t.replace(" ", "\n", 1) for t in clean[20:25]], *near, None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(data)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(t in toxic)) for i, t in enumerate(data)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = lambda name: sorted(r["doc_id"] for r in seen[name])
    assert ids("toxicity") == [i for i, t in enumerate(data) if t not in toxic]
    first = {}
    for i in ids("toxicity"):
        first.setdefault(hashlib.sha256(re.sub(r"\s+", " ", data[i] or "").encode()).digest(), i)
    assert ids("exact_dedup") == sorted(first.values())
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in ids("exact_dedup") for w in [(data[i] or "").split()]}
    like = lambda a, b: len(grams[a] & grams[b]) / max(1, len(grams[a] | grams[b]))
    left = []
    for i in ids("exact_dedup"):
        if all(like(i, j) < 0.8 for j in left):
            left.append(i)
    assert ids("near_dedup") == left
    mixed = Counter(ids("mixing"))
    assert set(mixed) <= set(left) and max(mixed.values()) <= 2
    assert seen["mixing"][0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert 0 <= 1.5 * words(seen["near_dedup"]) - words(seen["mixing"]) <= 3
    assert {r["doc_id"] for r in seen["packing"]} == set(mixed)
    per = Counter()
    for r in seen["packing"]:
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= 1024
