"""Rows that op6 sends between its steps: bounded by slices times buckets, few enough at size."""

import numpy as np
import pyarrow as pa

from sparkloom.llm import repeats


def test_a_slice_sends_one_row_to_a_bucket():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 100_000, np.uint8).tobytes().decode() for _ in range(100)]
    texts += texts[:30]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([2 * i for i in range(n)], pa.int64()), pa.array(texts)], ["doc_id", "tag", "text"])
    sent = [b.num_rows for b in repeats._send_anchors([batch], 20, 20, 50)]
    assert sum(sent) <= 40


def test_rows_between_buckets_at_size():
    assert repeats.bucket_count(0) == 1
    assert repeats.bucket_count(100_000_000) == 34
    assert repeats.bucket_count(10**10) ** 2 < 200_000


def test_steps_keep_an_anchor_together_and_lose_nothing():
    rng = np.random.default_rng(4)
    many = 9000
    anchor = np.sort(rng.integers(0, 40, many).astype(np.uint64))
    size = np.full(many, 1000, np.uint32)
    sent = {"d_anchor": anchor, "start": np.zeros(many, np.uint32), "size": size, "text": np.zeros(many, np.uint32), "ids": np.zeros(1, np.int64), "tags": np.zeros(1, np.int64), "bytes": np.zeros(int(size.sum()), np.uint8)}
    bucket = repeats._Bucket([sent])
    steps = list(bucket.steps())
    assert len(steps) > 2 and sorted(np.concatenate(steps).tolist()) == list(range(many))
    seen = [set(bucket.anchor[own].tolist()) for own in steps]
    assert sum(map(len, seen)) == len(set().union(*seen))
