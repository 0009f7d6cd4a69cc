"""Licence scan: a trained paragraph classifier, as column expressions only.

A paragraph is a run of 1 to WINDOW lines: a line alone, or with the lines after it as a wrapped statement has them (each but the last
at most WRAP characters long, none blank).  Paragraphs are classified by logistic regression over hashed word 1- and 2-grams, one
class per licence family and one for everything else ("unknown").  Probabilities are calibrated by a temperature fitted on
templates that the fitted weights have not seen, and below THRESHOLD the answer is unknown.  A family's prediction is confirmed only
if the paragraph's words also hold SIMILARITY of the weight of one of the family's templates.

The last rule decides which paragraphs need the classifier at all: gate() gives words of which any confirmed paragraph must hold one,
because the rest of each template is too light.  Paragraphs without a gate word could only be unknown, and are left out; no confirmed
one is lost, as a test shows against classifying every paragraph.

Training runs once on the driver over paragraphs made from the templates below and over bounded negatives (TRAIN_NEGATIVES lines of whole
texts without a gate word, and invented ones with gate words), and needs no label of the corpus.  The scan is one projection:
no shuffle, no join, no Python.
"""

from __future__ import annotations

import json
import random
import re
from functools import cache
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm._store import table

FEATURES, THRESHOLD, SIMILARITY, TRAIN_NEGATIVES, UNKNOWN = 2048, 0.6, 0.6, 400, "unknown"
WINDOW, WRAP = 4, 120
#: Words that say little: with numbers, they weigh LIGHT in the comparison with templates, others 1.
LIGHT, LIGHT_WORDS = 0.2, set("a all alle an and any as at be by can for from im in is it its la los may no not of on or sin that the this to und under unter use with without you der die das dieses".split())

#: Short statements of each family, in our own or common wording.
TEMPLATES = {
    "mit": [
        "released under the mit license", "licensed under the mit license", "this project is available under the terms of the mit license see the license file", "spdx license identifier mit",
        "mit lizenz", "dieses projekt steht unter der mit lizenz", "available under the mit terms",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    ],
    "apache": [
        "licensed under the apache license version 2 0", "released under the apache license 2 0", "this file is distributed under the apache software license version 2 0", "spdx license identifier apache 2 0",
        "apache 2 0",
        "you may not use this file except in compliance with the apache license you may obtain a copy of the license at www apache org licenses license 2 0",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license", "released under the gnu gpl v3", "distributed under the terms of the gnu general public license version 2 or later", "spdx license identifier gpl 3 0 or later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2 1", "released under the lgpl", "this library is free software under the gnu lesser general public license", "spdx license identifier lgpl 3 0",
    ],
    "bsd": [
        "released under the bsd 3 clause license", "licensed under the bsd license", "distributed under the two clause bsd license", "distributed under the bsd terms", "spdx license identifier bsd 3 clause",
        "bsd 3 clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license version 2 0", "licensed under the mozilla public license 2 0", "released under the mpl 2 0", "spdx license identifier mpl 2 0",
    ],
    "cc-by": [
        "licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "available under the creative commons attribution license", "text released under cc by 3 0",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "text is available under the creative commons attribution sharealike license",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "for noncommercial use under the creative commons attribution noncommercial license", "shared under cc by nc sa 4 0",
    ],
    "public-domain": [
        "this work is dedicated to the public domain", "released into the public domain", "licensed under cc0 1 0 universal", "no rights reserved cc0 public domain dedication", "this is free and unencumbered software released into the public domain",
    ],
    "proprietary": [
        "alle rechte vorbehalten", "todos los derechos reservados",
        "all rights reserved", "copyright the author all rights reserved", "proprietary and confidential unauthorized copying of this file is prohibited", "no part of this publication may be reproduced without prior written permission of the publisher",
    ],
}
#: Texts with cue words that state no licence.
OTHERWISE = [
    "the driver showed a licence to the officer", "the pilot has a licence and renewed it in march", "a fishing license costs ten dollars a year", "the shop lost its liquor license last week",
    "copyright law protects authors for many years", "the court discussed copyright and patents", "the teacher gave us permission to leave early", "permission was denied by the committee",
    "the warranty covers parts and labour for two years", "he was arrested on a warrant", "the apache helicopter landed near the village", "students at mit built a robot", "she studied at mit and moved to boston",
    "the public library is open to all residents", "the general public was not admitted", "the company will redistribute profits among workers", "the mozilla browser was updated", "license plates are made of metal",
    "the attribution of the painting is disputed", "a commercial licence is needed to drive a lorry", "the reserved seats were all taken", "version 2 0 of the plan was published", "the domain of the function is the real line",
    "creative people gather at the commons every friday", "the clause in the contract was void", "free software is discussed at the meetup", "they were granted asylum free of charge",
]
CLASSES = [*TEMPLATES, UNKNOWN]


def tokens(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def features(text: str) -> list[int]:
    """Hashed distinct 1- and 2-grams, as the column expression gives them."""
    w = tokens(text)
    grams = dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])
    return sorted({_signed(xxhash.xxh64_intdigest(g, 42)) % FEATURES for g in grams})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _made(seed: int = 5) -> list[tuple[str, int, int]]:
    """(paragraph, class, template), varied: words dropped or put in, and strange words before and after.  The template's number
    counts within its class; invented paragraphs have 0."""
    r = random.Random(seed)
    parts = "an be co da el fi go hu in ja ko le mi no or pa qu re so ti un va we xi yo zu".split()
    strange = lambda: "".join(r.choice(parts) for _ in range(r.randint(2, 4)))
    out = []
    for k, family in enumerate(CLASSES):
        for n, base in enumerate(TEMPLATES.get(family, OTHERWISE)):
            for _ in range(24 if family != UNKNOWN else 12):
                w = [x for x in tokens(base) if r.random() > 0.04]
                if r.random() < 0.5:
                    w = [strange() for _ in range(r.randint(0, 8))] + w
                if r.random() < 0.5:
                    w += [strange() for _ in range(r.randint(0, 8))]
                if r.random() < 0.3 and len(w) > 3:
                    w.insert(r.randrange(len(w)), r.choice(["2019", "2021", "project", "library", "text", "the", "data"]))
                out.append((" ".join(w), k, n))
    single = sorted({*gate(), *"license licence licensed copyright permission apache mit gnu public general version creative commons attribution free rights reserved domain".split()})
    for _ in range(400):  # single words of templates among strange ones state nothing
        w = [strange() for _ in range(r.randint(4, 20))]
        w.insert(r.randrange(len(w)), r.choice(single))
        out.append((" ".join(w), len(CLASSES) - 1, 0))
    return out


class Model:
    """Weights (FEATURES x classes, and biases), already divided by the temperature.

    Weights fitted without the second, fifth ... template of each class and without every fifth other paragraph give the temperature
    and ``held_out_accuracy`` on those; the weights kept are fitted on all.
    """

    def __init__(self, samples: list[tuple[str, int, int]], epochs: int = 12, rate: float = 0.5, seed: int = 3):
        data = [(np.array([FEATURES, *features(t)]), y) for t, y, _ in samples]
        away = np.array([n % 3 == 1 or i % 5 == 0 for i, (_, _, n) in enumerate(samples)])
        w = self._fit([d for d, out in zip(data, away, strict=True) if not out], epochs, rate, seed)
        held = [d for d, out in zip(data, away, strict=True) if out]
        logits, ys = np.array([w[at].sum(0) for at, _ in held]), np.array([y for _, y in held])

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(1, keepdims=True)
            return float(-(z[np.arange(len(ys)), ys] - np.log(np.exp(z).sum(1))).mean())

        self.temperature = min((0.5 * 1.15**i for i in range(24)), key=loss)
        self.held_out_accuracy = float((logits.argmax(1) == ys).mean())
        self.w = np.round(self._fit(data, epochs, rate, seed) / self.temperature, 4)

    @staticmethod
    def _fit(data: list[tuple[np.ndarray, int]], epochs: int, rate: float, seed: int) -> np.ndarray:
        r, k = np.random.default_rng(seed), len(CLASSES)
        w, sq = np.zeros((FEATURES + 1, k)), np.full((FEATURES + 1, k), 1e-3)
        for _ in range(epochs):
            for i in r.permutation(len(data)):
                at, y = data[i]
                z = w[at].sum(0)
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                g = p + 1e-4 * w[at]
                sq[at] += g**2
                w[at] -= rate * g / np.sqrt(sq[at])
        return w

    def probabilities(self, text: str) -> np.ndarray:
        z = self.w[[FEATURES, *features(text)]].sum(0)
        p = np.exp(z - z.max())
        return p / p.sum()


def train(docs: DataFrame, negatives: int = TRAIN_NEGATIVES) -> Model:
    """A model from the templates and from lines of docs (text, whole) of 20 to 400 characters without gate words; at most ``negatives``
    are collected, the first in the order of their hash."""
    lines = docs.select(F.explode(F.split(F.lower("text"), "\n")).alias("p")).where(F.length("p").between(20, 400)).select(F.xxhash64("p").alias("h"), "p")
    some = lines.where(~F.col("p").rlike(gate_pattern())).orderBy("h", "p").limit(negatives).collect()
    return Model([*_made(), *((r["p"], len(CLASSES) - 1, 0) for r in some)])


def weight(word: str) -> float:
    return LIGHT if word in LIGHT_WORDS or word.isdigit() else 1.0


@cache
def _template_words() -> list[list[list[str]]]:
    return [[sorted(set(tokens(t))) for t in TEMPLATES.get(c, [])] for c in CLASSES]


@cache
def gate() -> tuple[str, ...]:
    """Words of which a paragraph must hold one to reach SIMILARITY with any template: without them each template weighs too little.
    The shortest templates choose first, and of a template's words the heaviest, then those already chosen, then the longest."""
    chosen: set[str] = set()
    for words in sorted((w for family in _template_words() for w in family), key=lambda w: (len(w), w)):
        left = {w: weight(w) for w in words if w not in chosen}
        total = sum(map(weight, words))
        for w in sorted(left, key=lambda w: (-weight(w), -len(w), w)):
            if sum(left.values()) < SIMILARITY * total - 1e-9:
                break
            chosen.add(w)
            del left[w]
    return tuple(sorted(chosen))


def gate_pattern() -> str:
    """Over lower-cased text; words with the same first letter share a branch, so few are tried at a place."""
    branches = (f"{first}(?:{'|'.join(w[1:] for w in some)})" for first, some in groupby(gate(), key=lambda w: w[0]))
    return f"(?<![a-z0-9])(?:{'|'.join(branches)})(?![a-z0-9])"


def similarity(words: set[str], family: int) -> float:
    """How much of a template of the family, by weight, the words hold at best."""
    return max((sum(map(weight, words & set(t))) / sum(map(weight, t)) for t in _template_words()[family]), default=0.0)


def paragraphs_of(text: str | None) -> list[list[str]]:
    """In plain Python: for each line from which a paragraph with a gate word starts, its paragraphs, shortest first."""
    lines, found = (text or "").lower().split("\n"), re.compile(gate_pattern()).search
    out = []
    for i in range(len(lines)):
        some = [lines[i]]
        for k in range(i + 1, min(i + WINDOW, len(lines))):
            if len(lines[k - 1]) > WRAP or not tokens(lines[k - 1]) or not tokens(lines[k]):
                break
            some.append(some[-1] + " " + lines[k])
        some = [p for p in some if found(p)]
        if some:
            out.append(some)
    return out


def paragraphs(text: Column) -> Column:
    """For each line from which a paragraph with a gate word starts, the array of its paragraphs, lower-cased and shortest first; an empty
    array for null."""
    one = lambda x, f: F.flatten(F.transform(F.array(x), f))
    low = F.lower(F.coalesce(text, F.lit("")))

    def starts(lines: Column) -> Column:
        # of each line: has a gate word, can be followed, is blank; each step works on the array of the one before it, so nothing is computed twice
        marks = F.transform(lines, lambda p: F.struct(p.rlike(gate_pattern()).alias("cue"), (F.length(p) <= WRAP).alias("wraps"), (~p.rlike("[a-z0-9]")).alias("blank")))
        return one(marks, lambda m: among(lines, m))

    def among(lines: Column, marks: Column) -> Column:
        at = lambda i, k: F.get(marks, i + k)

        def windows(i: Column) -> Column:
            options, cue, goes = [], None, None
            for k in range(WINDOW):
                m = at(i, F.lit(k))
                cue = m["cue"] if cue is None else cue | m["cue"]
                if k:
                    before = at(i, F.lit(k - 1))
                    step = (i + k < F.size(lines)) & before["wraps"] & ~before["blank"] & ~m["blank"]
                    goes = step if goes is None else goes & step
                ok = cue if goes is None else cue & goes
                options.append(F.when(F.coalesce(ok, F.lit(False)), F.concat_ws(" ", F.slice(lines, i + 1, k + 1))))
            return F.filter(F.array(*options), lambda p: p.isNotNull())

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), windows), lambda ps: F.size(ps) > 0)

    none = F.array().cast("array<array<string>>")
    return F.when(low.rlike(gate_pattern()), one(F.split(low, "\n"), starts)).otherwise(none)


def classify(paragraph: Column, model: Model) -> Column:
    """struct(family, probability, similarity) of a paragraph."""
    k = len(CLASSES)
    weights = F.split(F.lit(",".join(f"{x:g}" for x in model.w.ravel())), ",").cast("array<double>")  # folded to one constant
    # each step works on the result of the one before it, so nothing is computed once per class or per word
    one = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    shape = [[[{"w": w, "x": round(weight(w) / sum(map(weight, t)), 12)} for w in t] for t in family] for family in _template_words()]
    templates = F.from_json(F.lit(json.dumps(shape)), "array<array<array<struct<w:string,x:double>>>>")

    def logits(words: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
        grams = F.array_distinct(F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))))
        slots = F.array_distinct(F.concat(F.array(F.lit(FEATURES).cast("long")), F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(FEATURES)))))
        return F.aggregate(slots, F.array(*[F.lit(0.0)] * k), lambda acc, s: F.zip_with(acc, F.slice(weights, (s * k + 1).cast("int"), k), lambda x, y: x + y))

    def settle(words: Column, z: Column) -> Column:
        best = F.array_position(z, F.array_max(z)).cast("int")
        prob = 1 / one(F.array_max(z), lambda top: F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
        share = lambda distinct: F.array_max(F.transform(F.element_at(templates, best), lambda t: F.round(F.aggregate(t, F.lit(0.0), lambda a, y: a + F.when(F.array_contains(distinct, y["w"]), y["x"]).otherwise(0.0)), 9)))
        like = F.coalesce(one(F.array_distinct(words), share), F.lit(0.0))
        return F.struct(F.element_at(F.array(*map(F.lit, CLASSES)), best).alias("family"), prob.alias("probability"), like.alias("similarity"))

    words = F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+"), lambda w: w != "")
    return one(words, lambda ws: one(logits(ws), lambda z: settle(ws, z)))


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``__licences``: array of (family, probability, similarity, confirmed), in order, for each line from which a paragraph with a
    gate word starts: of its paragraphs the confirmed one of the highest probability, else the likeliest; the shortest on ties.

    A family is confirmed if its probability reaches THRESHOLD and a template's weight SIMILARITY; else the paragraph is unknown.
    Null, empty and blank texts, and texts without a gate word, give an empty array; a text is scanned whole, whatever its length.  Equal rows
    have equal answers, an empty table gives an empty one, and a column named __licences is replaced.
    """
    sure = lambda c: (c["family"] != UNKNOWN) & (c["probability"] >= THRESHOLD) & (c["similarity"] >= SIMILARITY)

    def best(ps: Column) -> Column:
        judged = F.transform(ps, lambda p, k: F.struct(F.lit(False).alias("confirmed"), classify(p, model).alias("c"), (-k).alias("k")))
        return F.array_max(F.transform(judged, lambda j: F.struct(sure(j["c"]).alias("confirmed"), F.round(j["c"]["probability"], 9).alias("probability"), j["k"].alias("k"), j["c"]["similarity"].alias("similarity"), j["c"]["family"].alias("family"))))

    found = F.transform(paragraphs(F.col(text_col)), best)
    return docs.withColumn("__licences", F.transform(found, lambda c: F.struct(c["family"].alias("family"), c["probability"].alias("probability"), c["similarity"].alias("similarity"), c["confirmed"].alias("confirmed"))))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its lines that start a paragraph with a gate word, the licence statements (runs of such lines confirmed for
    one family), their families, and the surest one.  A null or empty text has none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, train(docs))
    ok = F.filter("__licences", lambda c: c["confirmed"])
    key = lambda c: F.when(c["confirmed"], c["family"])
    statements = F.size(F.filter("__licences", lambda c, i: c["confirmed"] & ((i == 0) | ~key(c).eqNullSafe(key(F.get("__licences", i - 1))))))
    best = F.array_max(F.transform(ok, lambda c: F.struct(c["probability"], c["similarity"], c["family"])))
    return out.select(
        "doc_id", F.size("__licences").alias("n_candidates"), statements.alias("n_licences"), F.array_join(F.array_sort(F.array_distinct(F.transform(ok, lambda c: c["family"]))), ",").alias("families"),
        best["family"].alias("family"), F.round(best["probability"], 6).alias("probability"), F.round(best["similarity"], 6).alias("similarity"),
    )
