"""The hybrid search embeds each text once, by the same sums as word by word."""

import re
from collections import Counter

import numpy as np

from lumenfold.operators import retrieval as R
from lumenfold.operators import vectors as N
from lumenfold.plans import q_retrieval
from lumenfold.plans.registry import Tables


def test_texts_are_embedded_once(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(q_retrieval, "exists", lambda *_: False)
    monkeypatch.setattr(N.VectorIndex, "write", lambda vectors, path, carried=(): seen.append(vectors))
    q_retrieval.search_vectors(Tables(spark, sf))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and seen[0].count() == 200


def test_sums_as_word_by_word():
    embedder = R.WordEmbedder(64)
    texts = ["a b a c", "", "한국 드라마 a", " ".join(f"w{i % 700}" for i in range(2000))]
    for t, got in zip(texts, embedder.embed(texts), strict=True):
        v = np.zeros(64)
        for word, n in Counter(re.findall("[0-9a-z가-힣]+", t.lower())).items():
            v += (1 + np.log(n)) * embedder._direction(word)
        norm = np.linalg.norm(v)
        assert np.allclose(got, v / norm if norm else v, rtol=0, atol=1e-12)
