"""Models as plug-ins: an embedder, a vision or a language model is a class whose objects turn a list of inputs into a list of outputs.

A provider is registered under a name and made in each task, so that a model is loaded where it is used; inputs arrive in Arrow batches.  No
model is part of this package: ``hashed`` is a stand-in for tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Provider(Protocol):
    def __call__(self, inputs: list) -> list: ...


PROVIDERS: dict[str, Callable[[], Provider]] = {}


def provider(name: str) -> Callable:
    def put(make: Callable[[], Provider]) -> Callable[[], Provider]:
        PROVIDERS[name] = make
        return make

    return put


@provider("hashed")
def _hashed() -> Provider:
    """Eight numbers of a text's digest."""
    return lambda texts: [[b / 255 for b in hashlib.sha256((t or "").encode()).digest()[:8]] for t in texts]


def apply(docs: DataFrame, name: str, column: str, out: str, kind: str, key: str = "doc_id") -> DataFrame:
    """(key, out, model): what provider ``name`` gives for each value of ``column``; ``kind`` is the output's type in SQL.  An unknown name
    raises at once.  One output for each input is demanded."""
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name!r}; there are {sorted(PROVIDERS)}")
    make, key_type = PROVIDERS[name], docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            got = model(b.column(1).to_pylist())
            if len(got) != b.num_rows:
                raise ValueError(f"provider {name!r} gave {len(got)} outputs for {b.num_rows} inputs")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got), pa.array([name] * b.num_rows)], names=[key, out, "model"])

    return docs.select(key, column).mapInArrow(run, f"{key} {key_type}, {out} {kind}, model string")
