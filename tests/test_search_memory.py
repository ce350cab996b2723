"""A search through the lists holds products of bounded size, whatever the number of queries and rows."""

import numpy as np
import pandas as pd

from sparkloom.operators import cosines, vectors


def test_products_are_bounded(monkeypatch):
    monkeypatch.setattr(cosines, "ROWS", 32)
    monkeypatch.setattr(cosines, "QUERIES", 16)
    draw = np.random.default_rng(2)
    v, sizes = draw.normal(size=(500, 8)), []
    take = cosines.Best.take
    monkeypatch.setattr(cosines.Best, "take", lambda self, rows, key, own, who=None: (sizes.append(len(rows) * len(self.q)), take(self, rows, key, own, who))[1])
    centres = v[:4] / np.sqrt((v[:4] ** 2).sum(1))[:, None]
    batch = pd.DataFrame({"vec_id": np.arange(500), "embedding": list(v), "list": (v @ centres.T).argmax(1)})
    run = vectors._scan(np.arange(0, 500, 5), v[::5], centres, 4, 3)
    got = pd.concat(run([batch[:300], batch[300:]]))
    assert max(sizes) <= 32 * 16 and sizes
    sims = np.round((v[::5] @ v.T) / np.sqrt((v[::5] ** 2).sum(1))[:, None] / np.sqrt((v**2).sum(1))[None, :], 5)
    want = {(i * 5, j) for i, line in enumerate(sims) for j in np.lexsort((np.arange(500), -line))[:3]}
    assert set(zip(got["q_id"], got["vec_id"], strict=True)) == want
