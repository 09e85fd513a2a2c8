import numpy as np

from siltstone.llm import ann


def reached(near, start):
    seen, edge = {start}, [start]
    while edge:
        edge = list({int(t) for e in edge for t in near[e] if t >= 0} - seen)
        seen.update(edge)
    return len(seen)


def test_a_family_around_one_of_its_members():
    """The middle one was the only neighbour of all others: most were out of reach, and beams grew up to the whole shard."""
    rng = np.random.default_rng(0)
    middle = rng.normal(size=64)
    x = ann._unit(np.concatenate([rng.normal(size=(1200, 64)), middle[None], middle + 0.1 * rng.normal(size=(400, 64))]))
    near, start = ann.build_graph(x)
    assert reached(near, start) == len(x) and all(len(set(row[row >= 0])) == (row >= 0).sum() for row in near)
    assert ann.beam_needed(x, near, start, 5, 64) == 64
    found, _ = ann.beam_search(x, near, start, x[1201:], 64)
    want = np.argsort(-(x[1201:] @ x.T), axis=1, kind="stable")[:, :6]
    assert np.mean([len(set(f[:6]) & set(w)) / 6 for f, w in zip(found, want, strict=True)]) >= 0.97


def test_lost_nodes_are_linked():
    x = ann._unit(np.random.default_rng(0).normal(size=(50, 8)))
    near = np.full((50, 4), -1)
    near[:40, :2] = np.stack([np.arange(40)[::-1] // 2, (np.arange(40) + 1) % 40], 1)
    ann.bridge(x, near, 0, 8)
    assert reached(near, 0) == 50
