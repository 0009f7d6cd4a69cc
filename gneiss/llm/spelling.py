"""Spelling variants: words one edit apart are found by letter-parity bands.

A word's mask holds the parity of each letter's count.  One edit flips at most two bits, so of three bands of the mask one is equal.
Words of at most one character's difference in length that share a band, and their first or last half, are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm._store import discard, materialise, table

RUN, BANDS, BITS = r"[A-Za-zÀ-ÿ]+", 3, 21
LEAST_LENGTH, LEAST_COUNT, TIMES, SLIP = 6, 5, 5, 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a bucket up to which all of it is compared; the words of a larger one meet by what is left when a character is deleted.
CROWDED = 64


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts; a run whose hash with the document's id is a multiple of SLIP loses a character.

    A null text has no runs; a null id is hashed as the empty string.  Repeated rows count again.  An empty table gives an empty one.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), F.lit(0))).alias("r"))
    # lower() would change accented letters, too
    lower = F.when(F.octet_length("r") == F.length("r"), F.lower("r")).otherwise(F.translate("r", UPPER, LOWER))
    runs = runs.select("d", lower.alias("r")).select("r", F.crc32(F.concat("d", F.lit(":"), "r")).alias("h"))
    at = (F.col("h") % F.length("r")).cast("int")
    slipped = F.concat(F.substring(F.col("r"), F.lit(1), at), F.substring(F.col("r"), at + 2, F.length("r")))
    return runs.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("r")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def mask(word: Column) -> Column:
    """The parity of the counts of each of 63 classes of characters, 21 to a band."""
    letters = F.transform(F.split(word, ""), lambda c: F.ascii(c))
    bit = lambda c: (c % BANDS) * BITS + F.floor(c / BANDS).cast("int") % BITS
    return F.aggregate(letters, F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))))


def deletions(word: Column) -> Column:
    """The word and what is left of it without one character: two words one edit apart share one of these."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def one_edit(a: Column, b: Column) -> Column:
    """Whether exactly one inserted, deleted or replaced code point makes b of a; a is not longer than b."""
    return (a != b) & (F.length(b) - F.length(a) <= 1) & (F.levenshtein(a, b, 1) == 1)


def near_pairs(found: DataFrame) -> DataFrame:
    """(a, b), once: the words of found (word, a distinct column) that are one edit apart.

    A band's bucket is split by the words' first half or last half (the edit is in one of them) and by length (from the shorter word to the
    same and the next length).  Where more than CROWDED words are left, they meet by a deletion instead, of which a word has one more than characters, and
    which no more than the alphabet times the length can share; so no bucket is compared in pairs when it is large.
    """
    w = found.select("word", mask(F.col("word")).alias("m"), F.length("word").alias("len"))
    # the shorter word of a pair tells how long a half is: a word is asked for by its own half and offered by those of the lengths below
    sides = []
    for end, cut in (("first", lambda n: F.substring(F.col("word"), F.lit(1), n)), ("last", lambda n: F.call_function("right", F.col("word"), n))):
        own = F.floor(F.col("len") / 2).cast("int")
        less = F.floor((F.col("len") - 1) / 2).cast("int")
        sides += [F.struct(F.lit(end).alias("end"), F.col("len").alias("at"), cut(own).alias("half"), F.lit(True).alias("asks"))]
        sides += [F.struct(F.lit(end).alias("end"), (F.col("len") - 1).alias("at"), cut(less).alias("half"), F.lit(False).alias("asks"))]
    band = lambda k: F.shiftright(F.col("m"), k * BITS).bitwiseAND((1 << BITS) - 1)
    keyed = w.select("word", "m", "len", F.explode(F.array(*sides)).alias("s")).select("word", "len", "s.*", F.posexplode(F.array(*(band(k) for k in range(BANDS)))).alias("k", "bits"))
    keyed = materialise(keyed.select("word", "len", "asks", F.xxhash64("k", "bits", "end", "at", "half").alias("key")), "bands")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.max("asks").alias("some")).where("some and size > 1").select("key", "size")
    rows = keyed.join(sizes, "key").select("word", "len", "asks", "key", (F.col("size") > CROWDED).alias("crowded"))
    rows = rows.select("word", "asks", "key", F.explode(F.when(F.col("crowded"), F.transform(deletions(F.col("word")), lambda x: F.xxhash64(x))).otherwise(F.array(F.lit(0).cast("long")))).alias("part"))
    asked, offered = rows.where("asks").select(F.col("word").alias("a"), "key", "part"), rows.select(F.col("word").alias("b"), F.col("asks").alias("same"), "key", "part")
    # of two words of one length both ask, and the smaller one does
    met = asked.join(offered, ["key", "part"]).where((~F.col("same") | (F.col("a") < F.col("b"))) & one_edit(F.col("a"), F.col("b")))
    out = materialise(met.select("a", "b").distinct(), "near")
    discard(keyed)
    return out


def group(found: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with their counts (word, n).

    A word's form is the near word of largest n, of equals the first in code-point order, if that n is at least TIMES its own; its root is
    what the forms lead to.  Counts grow along forms, so there are no cycles, and each round halves what is left of the longest chain.
    """
    found = materialise(found, "words")
    pairs = near_pairs(found)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.join(found.select(F.col("word").alias("b"), "n"), "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "b")).alias("best"))
    out = found.join(best.withColumnRenamed("a", "word"), "word", "left")
    taken = -F.col("best.less") >= TIMES * F.col("n")
    out = materialise(out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.b")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "forms")
    step = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("on"))
        step = materialise(step.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        if step.where("moved").limit(1).count() == 0:
            break
        step = step.select("word", "root")
    return out.join(step.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least LEAST_LENGTH characters and LEAST_COUNT occurrences with their forms and roots."""
    return group(words(table(spark, sf_dir, "documents")).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT)))


#: crc32 is not among DuckDB's functions: its table of 256 entries is made by its rule, and a run's bytes are folded over it.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
once AS (SELECT d, r, count(*) AS n FROM runs GROUP BY d, r),
hashed AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(d || ':' || r) + 1), lambda i: CAST('0x' || substr(hex(encode(d || ':' || r)), 2 * i - 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, crc.t[1 + (xor(a, b) & 255)])), 4294967295) AS h FROM once, crc),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
cuts AS (SELECT word, i, CASE WHEN i = 0 THEN word ELSE substr(word, 1, i - 1) || substr(word, i + 1) END AS c FROM (SELECT word, unnest(range(0, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT DISTINCT a.word AS word, b.word AS other FROM cuts a JOIN cuts b USING (c) WHERE a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
best AS (SELECT p.word, count(*) AS n_near, max(w.n) AS m, arg_min(other, (-w.n, other)) AS o FROM pairs p JOIN w ON w.word = p.other GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN o END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
led AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT led.word, forms.form, k + 1 FROM led JOIN forms ON forms.word = led.root WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(root, k) AS root FROM led GROUP BY word) l USING (word)
"""
