"""The licence scan against plain Python."""

import pytest
from pyspark.sql import functions as F

from gneiss.llm import licenses as L
from tests.llm.tables import rows_of

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""
GPL = """ This program is free software: you can redistribute it and/or modify
 it under the terms of the GNU General Public License as published by
 the Free Software Foundation, either version 3 of the License, or"""
MPL = """This Source Code Form is subject to the terms of the
Mozilla Public License, v. 2.0."""


@pytest.fixture(scope="module")
def model(spark, folders):
    return L.train(spark.read.parquet(f"{folders['driver']}/documents.parquet"))


def judge(paragraph, model):
    p = model.probabilities(paragraph)
    k = int(p.argmax())
    like = round(L.similarity(set(L.tokens(paragraph)), k), 9)
    return L.CLASSES[k] != L.UNKNOWN and p[k] >= L.THRESHOLD and like >= L.SIMILARITY, round(float(p[k]), 9), like, L.CLASSES[k]


def slow(text, model):
    """What the query says of a text."""
    found = []
    for ps in L.paragraphs_of(text):
        judged = [(*judge(p, model)[:2], -k, *judge(p, model)[2:]) for k, p in enumerate(ps)]
        found.append(max(judged))
    ok = [c for c in found if c[0]]
    starts = sum(c[0] and (i == 0 or not found[i - 1][0] or found[i - 1][4] != c[4]) for i, c in enumerate(found))
    best = max(((c[1], c[3], c[4]) for c in ok), default=(None, None, None))
    return len(found), starts, ",".join(sorted({c[4] for c in ok})), best[2], best[0], best[1]


def same(got, want):
    assert got[:4] == want[:4], (got, want)
    assert all(a is b is None or abs(a - b) < 2e-6 for a, b in zip(got[4:], want[4:], strict=True)), (got, want)


@pytest.mark.parametrize("which", ["awkward", "driver"])
def test_rows_of_the_query(spark, folders, which, model):
    rows = rows_of(folders[which])
    mine = model if which == "driver" else L.train(spark.read.parquet(f"{folders[which]}/documents.parquet"))
    got = sorted(map(tuple, L.op2_license_scan(spark, folders[which]).collect()), key=str)
    want = sorted(((d, *slow(t, mine)) for d, t in rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[1:5] and str(r[1:5]))), sorted(want, key=lambda r: (str(r[0]), str(r[1:5]))), strict=True):
        assert g[0] == w[0]
        same(g[1:], w[1:])
    if which == "driver":
        assert sum(g[2] > 0 for g in got) > 3


LINES = [
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "the pilot renewed his licence", "nothing here", "All rights reserved.", "xq licensed under the GNU General Public License version 3 zz",
    "Released under Apache 2.0.", "Released under the MPL 2.0.", "Apache-2.0", "BSD-3-Clause", "Distributed under the BSD terms", "Available under the MIT terms", "MIT-Lizenz", "Alle Rechte vorbehalten",
]
FAMILIES = ["mit", "cc-by-nc", "", "", "proprietary", "gpl", "apache", "mpl", "apache", "bsd", "bsd", "mit", "mit", "proprietary"]


def test_statements(spark, model):
    """Short statements, wrapped ones, a long text, nulls, and columns whose names the scan uses."""
    long = "filler words of a long text " * 60_000 + "\n" + LINES[0] + "\n" + "x" * 100_000
    cases = [*LINES, MIT, BSD, GPL, MPL, "code();\n\n" + MIT.replace("\n", "\r\n") + "\n\nmore", long, None, "", " \n\n ", "\n\n".join([MIT, LINES[1]])]
    want = [*FAMILIES, "mit", "bsd", "gpl", "mpl", "mit", "mit", "", "", "", "cc-by-nc,mit"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "doc_id long, text string").withColumn("__licences", F.lit(1))
    out = L.scan(df, model).select("doc_id", F.expr("array_join(array_sort(array_distinct(transform(filter(__licences, c -> c.confirmed), c -> c.family))), ',')").alias("f"))
    got = {r.doc_id: r.f for r in out.collect()}
    assert [got[i] for i in range(len(cases))] == want
    assert model.held_out_accuracy > 0.6


def test_gate_loses_no_statement(model):
    """Paragraphs without a gate word reach no template, so the classifier's answer for them is never confirmed."""
    import random

    r = random.Random(2)
    gate, words = set(L.gate()), sorted({w for f in L._template_words() for t in f for w in t})
    outside = [w for w in words if w not in gate]
    for _ in range(2000):
        p = " ".join(r.choice(outside) for _ in range(r.randint(1, 60)))
        assert not judge(p, model)[0]
    everything = " ".join(outside)
    assert max(L.similarity(set(outside), k) for k in range(len(L.CLASSES))) < L.SIMILARITY and not judge(everything, model)[0]
    assert all(L.paragraphs_of(t) for ts in L.TEMPLATES.values() for t in ts)
