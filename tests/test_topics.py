"""Online LDA without the topics in the driver."""

import random

import numpy as np
import pytest

from quarry.operators import model as J
from quarry.operators import topics as T


def test_special_functions():
    x = np.array([0.2, 1.0, 2.5, 40.0])
    assert np.allclose(T.digamma(x), [-5.289039896592188, -0.5772156649015329, 0.7031566406452432, 3.6763273955325], atol=1e-9)
    assert np.allclose(T.trigamma(x), [26.267377205423436, 1.6449340668482264, 0.49035775610023486, 0.02531510384129], atol=1e-9)
    g = T.gamma_draws(np.arange(40_000), 2)
    assert abs(g.mean() - 1) < 2e-3 and abs(g.var() - 0.01) < 5e-4 and abs(np.corrcoef(g.T)[0, 1]) < 0.02


def test_inference_of_a_batch_is_that_of_each_document():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 9, 30)
    ends = np.append(0, np.cumsum(sizes))
    beta, counts, alpha = rnd.random((ends[-1], 3)), rnd.integers(1, 5, ends[-1]).astype(float), np.array([0.2, 0.4, 0.3])
    start = T.gamma_draws(np.arange(30), 3)
    gamma, stats = T.infer(beta, counts, ends, start, alpha)
    for i in range(30):
        at = slice(ends[i], ends[i + 1])
        g, change = start[i], 1.0
        theta = np.exp(T.expectation(g))
        while change > 1e-3:
            last, norm = g, beta[at] @ theta + 1e-100
            g = theta * (beta[at].T @ (counts[at] / norm)) + alpha
            theta, change = np.exp(T.expectation(g)), np.abs(g - last).mean()
        assert np.allclose(gamma[i], g)
        assert np.allclose(stats[at], theta * beta[at] * (counts[at] / (beta[at] @ theta + 1e-100))[:, None])


@pytest.fixture
def texts(spark):
    rnd = random.Random(4)
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    rows = [(" ".join(rnd.choice(a if i % 2 else b) for _ in range(30)),) for i in range(300)] + [("",), (" \n",)]
    return spark.createDataFrame(rows, "text string")


def test_planted_topics_without_words_in_the_driver(texts, monkeypatch):
    from pyspark.ml import clustering, feature

    monkeypatch.setattr(clustering, "LDA", None)
    monkeypatch.setattr(feature, "CountVectorizer", None)
    out = J.lda_topics(texts, "text", k=2, max_iter=12, share=0.5).orderBy("topic").collect()
    kinds = [{t[0] for t in r["terms"]} for r in out]
    assert [len(r["terms"]) for r in out] == [8, 8] and sorted(map(sorted, kinds)) == [["a"], ["b"]]
    assert all(list(r["termWeights"]) == sorted(r["termWeights"], reverse=True) and sum(r["termWeights"]) < 1 for r in out)


def test_fewer_words_on_demand(texts):
    out = J.lda_topics(texts, "text", k=2, vocab=3, max_iter=1, share=0.5).collect()
    assert {t for r in out for t in r["terms"]} and all(len(r["terms"]) == 3 for r in out)
    whole = J.lda_topics(texts, "text", k=2, max_iter=1, share=0.5, top_terms=100).collect()
    assert all(len(r["terms"]) == 24 and abs(sum(r["termWeights"]) - 1) < 1e-9 for r in whole)
