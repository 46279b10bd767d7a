import numpy as np
import pytest

from quarry.operators import clusters
from quarry.operators.vectors import distances
from tests.test_density import frame


@pytest.mark.parametrize("metric", [1, 2, 3, "cosine"])
def test_means_of_packed_blocks(spark, monkeypatch, metric):
    """A round is one pass over packed points without a shuffle; sums may be many."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 6))
    v[:100] = v[:100].astype(np.float32)  # a block that is kept in 32 bits beside one that is not
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 50)
    blocks = clusters.packed(frame(spark, range(300), v).coalesce(1), 6)
    assert sorted({len(r.x) for r in blocks.collect()}) == [50 * 6 * 4, 50 * 6 * 8]
    c = np.vstack([v[:4], np.full((1, 6), 1e9)])
    at = distances(v, c, metric).argmin(1)
    for cells in (20_000, 1):
        monkeypatch.setattr(clusters, "DIRECT_CELLS", cells)
        got = clusters.cluster_means(blocks, c, metric)
        assert got.keys() == set(at.tolist())
        for j, mean in got.items():
            assert np.allclose(mean, v[at == j].mean(0))
