"""A field of JSON objects that arrive token by token, decoded as far as it has come; what is not decoded yet is kept across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELTAS = "run long, seq long, delta string"
_STATE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("rest", T.StringType()), T.StructField("phase", T.IntegerType())])


class _Reader(StatefulProcessor):
    """Of one run: the last token read, the characters left over, and whether the field is open."""

    def __init__(self, field: str):
        self.field = field

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("reader", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from gneiss.operators.control import FieldReader

        seen, rest, phase = self.kept.get() if self.kept.exists() else (-(1 << 63), "", 0)
        reader, out = FieldReader(self.field, rest, phase), []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            if r.seq > seen:
                seen = int(r.seq)
                if delta := reader.feed(r.token):
                    out.append((key[0], seen, delta))
        self.kept.update((seen, reader.rest, reader.phase))
        yield pd.DataFrame(out, columns=["run", "seq", "delta"]).astype({"run": "int64", "seq": "int64"})

    def close(self) -> None:
        pass


def field_deltas(tokens: DataFrame, field: str) -> DataFrame:
    """(run, seq, delta) of a stream of tokens (run, seq, token): what each adds to the field; tokens that add nothing give no row.

    Tokens of a run come in order; one whose seq is not above the last one is a repeat.  A run of any length keeps only what is not decoded yet.
    Null tokens add nothing, rows without run or seq are left out.  Needs the RocksDB state store (``replay.with_state``).
    """
    known = tokens.where("run IS NOT NULL AND seq IS NOT NULL")
    return known.groupBy("run").transformWithStateInPandas(_Reader(field), DELTAS, "Append", "None")
