"""The walk of op8: few plans on the driver, and near all that an exact search finds."""

import numpy as np
import pandas as pd

from tessera.llm import neighbours


def test_walk_has_few_steps(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2500, 24))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(2500), "embedding": [v.tolist() for v in x]}))
    made, keep = [], neighbours.checkpoint
    monkeypatch.setattr(neighbours, "checkpoint", lambda rows: made.append(1) or keep(rows))
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, 50).collect()}
    # five of nearest(), five of the graph, two of the walk before its steps
    assert len(made) <= 12 + 8
    want = {(r.query_id, r.vec_id) for r in neighbours.nearest_exact(df, 50).collect()}
    assert len(got) == len(want) == 250 and len(got & want) >= 0.9 * len(want)
