import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.llm.tables import SF, awkward


@pytest.fixture(scope="session")
def folders(tmp_path_factory):
    bench = pa.table({"item_id": pa.array([1, 2, None, 4], pa.int64()), "text": [" ".join(f"word{i}" for i in range(5, 30)), None, "one two", "!!"]})
    labels = pa.table({"doc_id": pa.array([*range(20), None], pa.int64()), "quality": pa.array([i % 2 for i in range(20)] + [1], pa.int32()), "toxic": pa.array([0] * 21, pa.int32())})
    out = {}
    for name, docs in (("awkward", awkward()), ("empty", awkward().slice(0, 0))):
        d = tmp_path_factory.mktemp(name)
        pq.write_table(docs, d / "documents.parquet")
        pq.write_table(bench if name == "awkward" else bench.slice(0, 0), d / "benchmark.parquet")
        pq.write_table(labels if name == "awkward" else labels.slice(0, 0), d / "labels.parquet")
        out[name] = str(d)
    out["driver"] = SF
    return out
