import numpy as np

from lectern.llm import embeddings


def hub_rows():
    """A vector with 500 distinct near copies, few of which are near each other, among 1,500 others."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal(64)
    base /= np.linalg.norm(base)
    noise = rng.standard_normal((500, 64))
    noise -= (noise @ base)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = 0.9815
    rows = [base, *(c * base + np.sqrt(1 - c * c) * noise), *rng.standard_normal((1500, 64))]
    order = rng.permutation(len(rows))
    return np.array(rows, np.float32)[order], int(np.flatnonzero(order == 0)[0])


def test_hub_of_many_near_copies(spark):
    """Counts are whole for the hub and for each copy, by all pairs."""
    x, hub = hub_rows()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= embeddings.LEAST_COSINE).sum(1) - 1
    assert want[hub] == 500
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    wrong = [(i, got[i], int(want[i])) for i in range(len(x)) if got[i] != want[i]]
    assert not wrong, (len(wrong), wrong[:5])
