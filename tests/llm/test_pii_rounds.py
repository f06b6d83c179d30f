"""A label reaches every repeat of a token, however many there are."""

import numpy as np

from siltflow.llm import pii


def test_label_reaches_all_repeats():
    n = 60
    own = np.tile([0.0, -3.5], (n, 1))
    own[0] = [-pii.HELD, pii.HELD]
    edges = np.array([(i, i + 1) for i in range(n - 1)])
    pair = np.broadcast_to(np.array([[0.0, 0.0], [0.0, 4.0]]), (n - 1, 2, 2))
    got = pii.marginals(own, edges, pair)
    assert np.allclose(got, pii.marginals(own, edges, pair, 1000), atol=1e-3)
    assert not np.allclose(got, pii.marginals(own, edges, pair, pii.ROUNDS), atol=1e-3)
