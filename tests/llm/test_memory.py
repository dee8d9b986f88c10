"""What a task of an operator holds in Python, measured on large batches without Spark."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import set_join


class Task:
    """In place of a DataFrame: keeps the function that runs over its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, f, schema):  # noqa: N802
        self.f = f
        return self


class Held:
    def __init__(self, value):
        self.value = value


def peak(f, batch):
    """MB that ``f`` takes at most over a batch, and the rows that it gives."""
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in f(iter([batch])))
        return tracemalloc.get_traced_memory()[1] / 1e6, n
    finally:
        tracemalloc.stop()


@pytest.fixture
def rule():
    set_join.shingles(pa.array(["some words to fill the caches of powers with"]), 5)
    return set_join.Rule(5, 8, 10)


def test_sets_of_a_large_batch(rule):
    words = np.random.default_rng(1).integers(0, 10**6, (256, 2400)).astype(str)
    text = pa.array([" ".join(w) for w in words.tolist()])
    n = len(text)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), text], names=["doc_id", "h", "text"])
    assert batch.nbytes > 4_000_000
    task = Task()
    set_join._sets(task, rule, Held(np.zeros(1 << set_join.BUCKET_BITS, np.uint8)))
    mb, rows = peak(task.f, batch)
    assert rows == n and mb < 60


def test_keys_of_a_large_batch(rule):
    n = 1024
    heads = np.random.default_rng(2).integers(0, 1 << 62, (n, 53))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([255] * n), pa.array(heads.tolist(), pa.list_(pa.int64()))], names=["cls", "n", "head"])
    task = Task()
    set_join._keys(task, rule, 256)
    mb, rows = peak(task.f, batch)
    assert rows == n * (53 * 52 // 2 + 52) and mb < 20


def test_keys_do_not_depend_on_how_heads_are_cut(rule, monkeypatch):
    heads = np.random.default_rng(3).integers(0, 1 << 62, (50, 9))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([40] * 50), pa.array(heads.tolist(), pa.list_(pa.int64()))], names=["cls", "n", "head"])
    task, got = Task(), []
    for size in (7, 1000):
        monkeypatch.setattr(set_join, "HEADS", size)
        set_join._keys(task, rule, 45)
        got.append(sorted((r["key"], r["cls"]) for b in task.f(iter([batch])) for r in b.to_pylist()))
    assert got[0] == got[1] and len(got[0]) == 50 * (9 * 8 // 2 + 9)
