"""What a task of the collocations takes up at a time is bounded, whatever the size of the table."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import collocations as C


def test_rows_of_streams_are_short(spark):
    rng = random.Random(3)
    texts = [". ".join(" ".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(25)) for _ in range(400)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "word string, lang string").coalesce(1)
    _, streams, _ = C._length(docs, 2, True, True)
    rows = [r["s"] for r in streams.collect()]
    assert max(map(len, rows)) <= 2 * 256 and all(r[-1] == -1 for r in rows)
    assert sum(x >= 0 for r in rows for x in r) == 400 * 25 * 12
    pairs, more, _ = C._length(streams, 2, False, True)
    assert pairs.agg(F.sum("a")).first()[0] == 400 * 25 * 11
    assert max(len(r["s"]) for r in more.collect()) <= 2 * 256


def test_batches_are_taken_up_in_parts():
    sizes = np.array([5, 0, 900, 3, 3, 3, 3, *[0] * 1200])
    groups = list(C._groups(sizes, 10))
    assert [g for low, n in groups for g in range(low, low + n)] == list(range(len(sizes)))
    assert all(n <= C.PIECE_ROWS and (n == 1 or sizes[low : low + n].sum() <= 10) for low, n in groups)
    rows = pa.RecordBatch.from_arrays([pa.array([[1] * 100_000 for _ in range(30)], pa.list_(pa.int32()))], ["s"])
    parts = list(C._streams(iter([rows, rows.slice(0, 0), rows.slice(3, 2)])))
    assert sum(map(len, parts)) == 32 and max(len(C._flat(s)) for s in parts) <= C.SLOTS


def test_streams_are_cut_and_put_side_by_side():
    rng = np.random.default_rng(4)
    s = C._dense(np.where(rng.random(5000) < 0.1, -1, rng.integers(0, 99, 5000)).astype(np.int32))
    rows = C._cut_rows(s)
    assert np.array_equal(C._flat(rows), s) and all(r[-1] == -1 and len(r) < 2 * C.ROW for r in rows.to_pylist())
    both = C._beside(s, s + 100, rows.offsets.to_numpy().astype(np.int64)).to_pylist()
    assert both == [r + [x + 100 for x in r] for r in rows.to_pylist()]


def test_counts_are_packed():
    for most, size in ((0, 1), (255, 1), (256, 2), (2**16, 4), (2**32 - 1, 4), (2**32, 8), (2**62, 8)):
        counts = np.array([0, most, 1, most], np.int64)
        raw = C._packed(counts)
        assert len(raw) == 1 + 4 * size and np.array_equal(C._unpacked(pa.py_buffer(raw)), counts)
