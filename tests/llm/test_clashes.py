"""Columns with the names that the operators use for themselves come back unchanged."""

import pytest
from pyspark.sql import functions as F

from gneiss.llm import mixing, sharding, substring
from tests.llm.tables import PASSAGE

NAMES = ["__key", "__part", "__n", "__row", "__id", "__crc", "__starts", "__cut", "__domain", "__lang", "__source", "__tokens", "__place", "__epochs", "__copies", "__turn", "__Row", "kept_x"]


def docs(spark, names):
    rows = [(i, PASSAGE if i % 3 == 0 else f"text {i} " + "w " * i, "en", f"src{i % 2}") for i in range(12)] + [(None, None, None, None), (3, PASSAGE, "en", "src1")]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for n in names:
        out = out.withColumn(n, F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return out


def extra(df, names):
    return sorted(tuple(r) for r in df.select(*[F.coalesce(n, F.lit("?")) for n in names]).collect())


@pytest.mark.parametrize("names", [NAMES[:8], NAMES[8:16], ["__Row", "__ID", "kept_x", "__TURN"]], ids=["first", "second", "case"])
@pytest.mark.parametrize("operator", ["shard", "remove_repeats", "mix", "repeated"])
def test_own_names(spark, operator, names):
    df = docs(spark, names)
    plain = docs(spark, [])
    run = {"shard": lambda d: sharding.shard(d, 3), "remove_repeats": substring.remove_repeats, "mix": mixing.mix, "repeated": mixing.repeated}[operator]
    out, want = run(df), run(plain)
    results = [c for c in want.columns if c not in plain.columns]
    mine = [n for n in names if n.lower() not in {c.lower() for c in results}]
    assert extra(out, [*mine]) == extra(df, mine) if operator != "repeated" else set(extra(out, mine)) <= set(extra(df, mine))
    assert sorted(map(str, out.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_equal_rows_beside_a_column_row(spark):
    """Rows equal in id and text that no shard can take alone get a number of their own, whatever else is called so."""
    df = spark.range(900).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same row").alias("text"), F.col("id").cast("string").alias("__row"))
    got = sharding.shard(df, 4).collect()
    assert sorted(int(r["__row"]) for r in got) == list(range(900)) and len({r.shard for r in got}) == 4
