"""The trained models against independent plain-Python versions, and on rows they have not seen."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lavka.llm import language_id, url_filter
from lavka.llm.queries import URL_RULES


def plain_ftrl(vectors, labels, languages, order, alpha, beta, l1, l2):
    """One weight at a time, in dictionaries; the bias is bucket -1."""
    z, n = {}, {}

    def weight(key):
        zi, ni = z.get(key, 0.0), n.get(key, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(ni)) / alpha + l2)

    for i in order:
        x = {**vectors[i], -1: 1.0}
        scores = [sum(v * weight((f, k)) for f, v in x.items()) for k in range(languages)]
        top = max(scores)
        chances = [math.exp(s - top) for s in scores]
        total = sum(chances)
        old = {(f, k): weight((f, k)) for f in x for k in range(languages)}
        for f, v in x.items():
            for k in range(languages):
                g = v * (chances[k] / total - (labels[i] == k))
                before = n.get((f, k), 0.0)
                z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * old[f, k]
                n[f, k] = before + g * g
    return {key: weight(key) for key in z}


def test_ftrl_weights():
    rng = random.Random(1)
    vectors = [{f: rng.random() for f in rng.sample(range(16), 5)} for _ in range(60)]
    labels = [rng.randrange(3) for _ in vectors]
    arrays = [(np.array(sorted(v)), np.array([v[f] for f in sorted(v)])) for v in vectors]
    weights, bias = language_id.ftrl(arrays, labels, 3, 4, alpha=1.5, beta=0.7, l1=0.05, l2=0.2, epochs=3, seed=8)
    draw = np.random.default_rng(8)
    order = [i for _ in range(3) for i in draw.permutation(len(vectors)).tolist()]
    expected = plain_ftrl(vectors, labels, 3, order, 1.5, 0.7, 0.05, 0.2)
    assert any(w == 0.0 for w in expected.values()) and any(w for w in expected.values())
    for (f, k), w in expected.items():
        assert (bias[k] if f < 0 else weights[f, k]) == pytest.approx(w, abs=1e-9)


def test_url_weights(spark):
    rng = random.Random(2)
    rows = [(f"http://{rng.choice('abc')}{rng.randrange(9)}.net/{rng.choice(['x', 'casino', 'news'])}/{rng.randrange(30)}",
             rng.random() < 0.4) for _ in range(120)]
    frame = spark.createDataFrame(rows + rows[:40], "url string, blocked boolean")
    model = url_filter.train(frame, steps=5, bits=8)
    host, path = url_filter.url_parts(F.col("url"))
    seen = frame.select(url_filter.url_features(host, path, bits=8).alias("f"), "blocked").collect()
    weights, squares = [0.0] * 257, [0.0] * 257
    for _ in range(5):
        gradient = [1e-4 * w for w in weights[:256]] + [0.0]
        for r in seen:
            norm = math.sqrt(max(1, len(r.f)))
            chance = 1 / (1 + math.exp(-(sum(weights[f] for f in r.f) / norm + weights[256])))
            for f in r.f:
                gradient[f] += (chance - r.blocked) / norm / len(seen)
            gradient[256] += (chance - r.blocked) / len(seen)
        touched = {f for r in seen for f in r.f} | {256}
        for f in touched:
            squares[f] += gradient[f] ** 2
            weights[f] -= 2.0 * gradient[f] / (math.sqrt(squares[f]) + 1e-9)
    assert model.weights == pytest.approx(weights[:256], abs=1e-6) and model.bias == pytest.approx(weights[256], abs=1e-6)


def test_url_verdicts_on_pages_not_learned_from(spark):
    """Pages that a rule decides, half learned, half held out: the model finds the rules' verdicts."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    part = F.crc32(F.col("url")) % 2
    model = url_filter.train(url_filter.labels_from_rules(pages.where(part == 0), URL_RULES))
    rest = pages.where(part == 1)
    host, path = url_filter.url_parts(F.col("url"))
    truth = rest.select("page_id", url_filter.matching_rule(host, path, URL_RULES)[1].alias("truth"))
    found = url_filter.judge(rest, [], model).join(truth, "page_id").where("truth is not null").collect()
    right = sum(r.verdict == r.truth for r in found)
    assert len(found) > 100 and len({r.truth for r in found}) == 2
    assert right / len(found) > 0.97, right / len(found)
