"""What the corpus operators take of the driver: memory of the fit, and tables made in vain."""

import os
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from plexa.llm import neardup, text, toxicity


def test_fit_memory():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghij klmno", k=6000)) for _ in range(240)]
    features = toxicity.Features()
    n = sum(len(features(t)) for t in texts)
    tracemalloc.start()
    toxicity.fit(texts, np.arange(240) % 2, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n + (24 << 20), peak / n


def test_no_tables_in_vain(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(12)]
    docs += [(20 + i, t) for i, (_, t) in enumerate(docs[:2])]
    made, stored = [], neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, name="table": made.append(name) or stored(df, name))
    monkeypatch.setattr(text, "checkpoint_dir", lambda _: f"file://{tmp_path}")
    out = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {i: i - 20 if i >= 20 else i for i, _ in docs}
    assert len(made) < 15, made
    assert [p.split("-")[1] for p in os.listdir(tmp_path)] == ["classes"]


def test_looked_up(spark):
    """Facts of which none, all and some are hot, and none at all, are joined alike."""
    for times in ([3] * 5000, [2, 5, 9], [9000, *[2] * 3000], []):
        facts = [(i, n, -i) for i, n in enumerate(times)]
        rows = [(7, "x"), (7, "y"), (0, "z"), (1, "q"), (10**6, "u"), (None, "v")]
        facts_ = spark.createDataFrame(facts, "key long, times long, fact long")
        got = text.looked_up(spark.createDataFrame(rows, "key long, name string"), facts_, ["key"], "times").select("key", "name", F.col("times").alias("n"), "fact").collect()
        known = {k: (n, f) for k, n, f in facts}
        assert {tuple(r) for r in got} == {(k, name, *known.get(k, (None, None))) for k, name in rows} and len(got) == len(rows)
