"""What a worker holds while it works on texts follows the pieces, not the batches or the number of rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from slicewise.llm import arrays, bpe, jaccard, mixing, queries


class Held:
    """Stands for a table; mapInArrow gives the function that a worker would run."""

    columns = ["doc_id", "text"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def peak(run, texts):
    """(MB that the run took at most, its batches) over one batch of the texts."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        out = list(run(iter([batch])))
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_signatures_work_on_small_pieces(monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 1 << 16)
    monkeypatch.setattr(arrays, "_POWERS", {})
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50_000, 300)) for _ in range(3000)]
    most, out = peak(jaccard.signatures(Held(), "doc_id", "text", 5), texts)
    assert sum(len(b) - b.column("n").null_count for b in out) == 3000
    assert most < 60


def test_parity_maps_of_many_short_rows():
    rng = np.random.default_rng(1)
    starts = np.arange(0, 3 * 8001, 3)
    values = rng.integers(-(2**63), 2**63 - 1, starts[-1])
    tracemalloc.start()
    try:
        maps = jaccard.parity_maps(values, starts)
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert most < 30 and maps.shape == (8000, jaccard.MAPS)
    for k in (0, 255, 256, 7999):
        assert (maps[k] == jaccard.parity_maps(values[3 * k : 3 * k + 3], np.array([0, 3]))[0]).all()
    assert jaccard.parity_maps(values[:0], np.zeros(1, np.int64)).shape == (0, jaccard.MAPS)


@pytest.mark.parametrize("values", [[], [5], [5, 5], [3, 5, 5, 5, 4, 3, -7], [1, 2, 3]])
def test_repeated_values(values):
    found, times = jaccard.repeated_values(np.array(values, np.int64))
    want = {v: values.count(v) for v in values if values.count(v) > 1}
    assert found.tolist() == sorted(want) and times.tolist() == [want[v] for v in sorted(want)]


def test_signatures_of_a_text_longer_than_the_held_part(monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 100)
    text = " ".join(f"w{k % 150}" for k in range(400))
    _, out = peak(jaccard.signatures(Held(), "doc_id", "text", 2), ["a b c", text, text, None])
    rows = pa.Table.from_batches(out)
    assert [n for n in rows.column("n").to_pylist() if n is not None] == [2, 150, 150, 0]
    assert sum(x for x in rows.column("times").to_pylist() if x is not None) in (0, 300)


def test_encoder_keeps_small_entries():
    with open(queries.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    values = [f" x{k}".encode() for k in range(20_000)]
    encoder = bpe.Encoder(vocabulary)
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        encoder.learn(values)
        kept = (tracemalloc.get_traced_memory()[0] - before) / len(values)
    finally:
        tracemalloc.stop()
    assert all(encoder.known[v][2] == v for v in values)
    assert kept < 280


def test_schedule_starts_no_workers(spark, monkeypatch):
    made = type(spark).createDataFrame

    def only_arrow(self, data, *a, **b):
        assert isinstance(data, pa.Table)
        return made(self, data, *a, **b)

    monkeypatch.setattr(type(spark), "createDataFrame", only_arrow)
    none = mixing.stored_schedule(spark, {}, {})
    assert none.count() == 0 and none.columns == ["_s", "_k", "phase", "slot", "release", "deadline"]
    assert mixing.stored_schedule(spark, {"a": 2, "b": 1}, {"a": 2, "b": 1}).count() == 3
