"""Every stage of the corpus pipeline against brute force on its own input."""

import collections
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from lexiflow.llm import quality
from tests.llm.test_results import WORD, jaccard_components, line_classes


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    items = [(i, " ".join(f"q{rng.randint(0, 50)}" for _ in range(rng.choice([4, 15])))) for i in range(6)]
    base = [["\n".join(" ".join(f"v{rng.randint(0, 300)}" for _ in range(12)) for _ in range(6))] for _ in range(12)]
    texts = []
    for i in range(90):
        t = rng.choice(base)[0] if i % 3 else "\n".join(" ".join(f"u{rng.randint(0, 300)}" for _ in range(12)) for _ in range(6))
        t = t.replace(f"v{i}", "changed") + ("\n" + rng.choice(items)[1] if i % 7 == 0 else "") + (" trash idiot scum" if i % 9 == 0 else "")
        texts.append(t)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    known = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append((before, {r["doc_id"]: r for r in now.collect()}))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    assert set(seen[0][1]) == {i for i in range(90) if i % 9}
    order = sorted(seen[1][0])
    rows, lead, _ = line_classes([seen[1][0][k]["text"] for k in order])
    for n, k in enumerate(order):
        left = [x for m, x in enumerate(seen[1][0][k]["text"].split("\n")) if not x.strip() or lead(x) == (n, m)]
        assert (seen[1][1][k]["text"] if k in seen[1][1] else "") == "\n".join(left)
    order = sorted(seen[2][0])
    classes = jaccard_components([seen[2][0][k]["text"] for k in order], 80, 5)
    assert set(seen[2][1]) == {k for n, k in enumerate(order) if classes[n][2]}
    joined = {k: f" {' '.join(words(r['text']))} " for k, r in seen[3][0].items()}
    windows = [" ".join(w[i : i + 10]) for _, t in items for w in [words(t)] for i in range(max(1, len(w) - 9))]
    assert set(seen[3][1]) == {k for k, t in joined.items() if not any(f" {w} " in t for w in windows)}
    assert set(seen[4][1]) == set(seen[4][0])
    taken, target = collections.Counter(), {}
    for k, r in seen[4][1].items():
        assert r["size"] == len(WORD.findall(seen[4][0][k]["text"]))
        taken[seen[4][0][k]["source"]] += r["taken"]
        target[seen[4][0][k]["source"]] = r["target"]
    assert all(abs(taken[s] - t) < 200 for s, t in target.items())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4][1])


def test_registered():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert "pipeline" in known and all(any(q.startswith(f"op{n}_") for q in known) for n in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5 and quality.SAMPLE_DOCS
