"""Block pairs of open buckets, by the batches in which they come."""

import numpy as np
import pyarrow as pa
import pytest

from intronaut.llm import near_dedup

ROW = pa.schema([("bucket", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("side", pa.int32()), ("outside", pa.bool_()), ("rep", pa.int64()), ("component", pa.int64()), ("n_shingles", pa.int64()), ("fine", pa.binary()), ("bands", pa.list_(pa.int64()))])


def batch(*rows):
    fine = np.zeros(near_dedup.FINE_BITS // 64, np.uint64).tobytes()
    return pa.RecordBatch.from_pylist([{"bucket": b, "low": 0, "high": 0, "side": side, "outside": True, "rep": r, "component": r, "n_shingles": 9, "fine": fine, "bands": [b, -r]} for b, r in rows for side in (0, 1)], schema=ROW)


@pytest.mark.parametrize(
    ("batches", "want"),
    [
        ([batch((5, 1), (5, 2))], {(1, 2)}),
        ([batch((5, 1)), batch((5, 2))], {(1, 2)}),
        ([batch((5, 1), (5, 2)), batch((6, 3), (6, 4))], {(1, 2), (3, 4)}),
        ([batch((5, 1)), batch((5, 2), (6, 3)), batch((6, 4))], {(1, 2), (3, 4)}),
        ([], set()),
    ],
)
def test_sifter_takes_any_batches(batches, want):
    out = list(near_dedup._block_sifter(80)(iter(batches)))
    assert {p for b in out for p in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)} == want
