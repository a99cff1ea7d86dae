import numpy as np
import pyarrow as pa
import pytest

from assaykit.llm import neardup


@pytest.mark.parametrize("small", [8, 4096])
def test_links_of_a_cell_keep_the_components_of_all_pairs(monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL_CELL", small)
    rng = np.random.default_rng(5)
    parts = len(neardup.PRINT)
    bits = []
    for _ in range(60):  # chains of revisions: neighbours are near, others often are not
        at = rng.integers(0, 2, 64 * parts)
        for _ in range(9):
            bits.append(at)
            at = at.copy()
            at[rng.permutation(64 * parts)[: neardup.WIDE_DISTANCE * 2 // 3]] ^= 1
    bits = np.array(bits)[rng.permutation(len(bits))]
    words = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
    node, n = np.arange(len(bits)), np.full(len(bits), 100)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(bits), np.int32)), pa.array(node), *[pa.array(words[:, i].copy()) for i in range(parts)], pa.array(n)], names=["cell", "node", *neardup.PRINT, "n"])

    def groups(links):
        low = list(range(len(bits)))

        def root(i):
            while low[i] != i:
                i = low[i]
            return i

        for i, j in links:
            a, b = root(i), root(j)
            low[max(a, b)] = min(a, b)
        return [root(i) for i in range(len(bits))]

    near = (bits[:, None] != bits[None]).sum(2) <= neardup.WIDE_DISTANCE
    got = [(u, v) for out in neardup.wide_links([batch]) for u, v in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert groups(got) == groups(np.argwhere(near).tolist()) and len(got) < 2 * len(bits)


def test_grids_grow_with_the_texts():
    few, many = neardup.grid_bits(1000), neardup.grid_bits(10**7)
    assert few.shape[1] == neardup.LEAST_BITS and many.shape[1] > few.shape[1] and len(many) > len(few)
    for bits in (few, many):
        assert 1 - (1 - (1 - neardup.WIDE_SHARE) ** bits.shape[1]) ** len(bits) >= 1 - neardup.WIDE_MISSED
        assert all(len(set(b)) == len(b) for b in bits.tolist())
    assert 10**7 / 2 ** many.shape[1] <= neardup.CELL_TEXTS
