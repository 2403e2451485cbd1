"""Queries go to a part of blocks once, whatever the number of blocks."""

import numpy as np

from netgeo.operators import neighbors
from tests.test_neighbors import brute, rows


def test_a_query_goes_to_a_part_once(spark):
    vectors = np.random.default_rng(5).normal(size=(300, 20))  # no structure: all blocks stay open
    items = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(items, "id bigint, v array<double>")
    index = neighbors.build(df, "id", "v", block_rows=2)
    parts = -(-len(index.blocks) // neighbors.PART)
    q = neighbors.floors(neighbors.unit_vectors(df, "id", "v"), spark.createDataFrame([], neighbors.FOUND), 3)
    sent = q.mapInArrow(neighbors._open(index, 3), neighbors.PAIRS)
    seen = {}
    assert rows(neighbors.topk(index, df, "id", "v", 3, seen)) == brute(items, items, 3)
    assert parts == 3 and sent.count() <= 300 * parts < seen["looked_at"] <= seen["all"]


def test_dense_and_sparse_products_agree(monkeypatch):
    rng = np.random.default_rng(6)

    def some(n):
        m = np.where(rng.random((n, 25)) < 0.6, rng.normal(size=(n, 25)), 0)
        row, dim = np.nonzero(m)
        return m, neighbors.Rows(np.concatenate([[0], np.cumsum((m != 0).sum(axis=1))]), dim * 3, m[row, dim])

    (a, left), (b, right) = some(40), some(17)
    for dense in (0, 1 << 30):
        monkeypatch.setattr(neighbors, "DENSE", dense)
        table = neighbors.Inverted.of(right)
        assert np.allclose(table.times(left), a @ b.T, atol=1e-12)
        assert (table.matrix is not None) == (dense > 0)
    assert np.allclose(left.take(np.array([3, 0, 3])).dense(np.arange(25) * 3), a[[3, 0, 3]])
