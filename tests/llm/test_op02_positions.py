import numpy as np

from foliospark.llm import op02_language as O


def test_filters_see_every_byte_position():
    net = O.fit(np.zeros((1, O.WINDOW), np.uint8), ["en"])
    x = np.random.default_rng(3).integers(0, 256, (2, O.WINDOW), dtype=np.uint8)
    e = net.embed[x]
    want = np.stack([e[:, p : p + O._WIDE].reshape(2, -1) @ net.filters for p in range(O.WINDOW - O._WIDE + 1)], 1)
    got = O._responses(net, x)[1]
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-4)
