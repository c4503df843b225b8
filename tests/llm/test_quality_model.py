"""The quality model is fitted to all trusted documents, and its threshold is their exact quantile."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import common, quality


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_model_of_all_trusted_documents(spark, monkeypatch, most):
    """6,000 trusted documents, of which the last ones say what no other does: counts, scores and threshold as by hand."""
    monkeypatch.setattr(quality, "MOST_BROADCAST", most)
    rows = [(i, f"plain words of text number w{i % 50} v{i % 7} and so on until the end") for i in range(6000)] + [(7000 + i, "junk junk spam spam offer " * 3) for i in range(500)] + [(None, "no id"), (9000, None), (5, "twice by id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(6000)] + [(i, 0) for i in range(7000, 7500)] + [(None, 1), (5, 1)], "doc_id long, quality int")
    found = common.let(quality.word_hashes(common.space_words(F.coalesce("text", F.lit("")))), quality.features)
    features = [(r[0], r[1]) for r in docs.select("doc_id", found).collect()]
    good, raw = Counter(), Counter()
    for i, f in features:
        raw.update(f)
        if i is not None and i < 6000:
            good.update(f)
    table = quality.weights(good, raw)
    score = lambda f: sum(table[b] for b in f) / (len(f) + quality.NEUTRAL)
    bound = np.quantile([score(f) for i, f in features if i is not None and i < 6000], quality.TAIL) - quality.MARGIN
    got = [(r["doc_id"], r["score"], r["kept"] | r["base_failed"]) for r in quality.judge(docs, labels).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, round(x[1], 9))
    want = [(i, score(f), score(f) >= bound) for i, f in features]
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=1e-9) and (a[2] == b[2] or a[2]) for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True))
