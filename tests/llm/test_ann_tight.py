import numpy as np
import pytest

from siltstone.llm import ann

from .test_ann import brute, recall


@pytest.mark.parametrize("kind", ["tight families", "far from the origin"])
def test_other_rows(spark, kind):
    """In single precision all members of a family were equally near: 0.02 and 0.94 of the true neighbours."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 32))[rng.integers(0, 2, 3000)] + 1e-4 * rng.normal(size=(3000, 32)) if kind == "tight families" else 1000 + rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    assert recall(ann.nearest(df).collect(), brute(list(enumerate(x.tolist())))) >= 0.97


def test_a_beam_as_wide_as_it_takes():
    x = ann._unit(np.random.default_rng(0).normal(size=(3000, 256)))
    near, start = ann.build_graph(x)
    beam = ann.beam_needed(x, near, start, 5, 64)
    found, _ = ann.beam_search(x, near, start, x[::30], beam)
    want = np.argsort(-(x[::30] @ x.T), axis=1)[:, :6]
    assert beam > 64 and np.mean([len(set(f[:6]) & set(w)) / 6 for f, w in zip(found, want, strict=True)]) >= 0.96
