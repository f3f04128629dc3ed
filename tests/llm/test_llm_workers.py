"""Python workers give memory back when a task ends."""

import pyarrow as pa
import pytest

from pagewright.llm import workers


def test_batches_pass_and_memory_goes_back_after_the_last(monkeypatch):
    calls = []
    monkeypatch.setattr(workers, "give_back", lambda: calls.append("back"))

    def run(batches):
        for batch in batches:
            calls.append(batch.num_rows)
            yield batch

    made = [pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (0, 3)]
    assert list(workers.lean(run)(iter(made))) == made
    assert calls == [0, 3, "back"]


def test_an_error_passes_and_memory_goes_back(monkeypatch):
    calls = []
    monkeypatch.setattr(workers, "give_back", lambda: calls.append("back"))

    def run(batches):
        raise ValueError("no batch")
        yield

    with pytest.raises(ValueError, match="no batch"):
        list(workers.lean(run)(iter([])))
    assert calls == ["back"]


def test_give_back_runs_here():
    workers.give_back()
