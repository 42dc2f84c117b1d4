import numpy as np

from coweave.llm import packing


def test_packing_goes_on_while_rounds_save_containers(spark, monkeypatch):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(k, int(s)) for k, s in enumerate(rng.integers(20, 45, 600))], "doc_id bigint, n_tokens bigint")
    parts = iter([256, 128, 64, 32, 16, 8, 4, 2] + [1] * 20)  # fewer partitions in every round: each of the first eight can save
    monkeypatch.setattr(packing, "_parts", lambda *_: next(parts))
    p = packing.pack(df, capacity=100)
    assert p.rounds > 5
    pieces = p.pieces.collect()
    assert len(pieces) == 600 and len({r.container for r in pieces}) == p.containers >= p.bound
