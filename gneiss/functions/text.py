"""Text functions as column expressions: tokens, identities, quality, classification, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
PII = {
    "aadhaar": r"\b\d{4}\s?\d{4}\s?\d{4}\b",
    "credit_card": r"\b(?:\d[ -]*?){13,16}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "pan": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "phone_in": r"(?:\+91[\-\s]?)?[6-9]\d{9}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}
LEVELS = ["public", "internal", "confidential", "restricted"]
MARKERS = {
    "restricted": r"\brestricted\b|\bstrictly confidential\b|\bsecret\b",
    "confidential": r"\bconfidential\b|\bprivileged\b|\bnda\b|\bdo not distribute\b|\binternal use only\b",
    "public": r"\bpress release\b|\bpublic disclosure\b",
}
JUNK = r"(accept all cookies|cookie policy|subscribe now|sign up|log in|advertisement|follow us on|share this|you might also like|trending now|buy now|click here|sponsored|promoted content|enable javascript|please wait|fetching data|loading\.\.\.)"
STOP_WORDS = (
    "a an the and or but if then than that this these those of in on at to for with without from by as is are was were be been being it its it's not no nor so such "
    "we you they he she i our your their his her which who whom what when where why how all any both each few more most other some only own same too very can will just don should "
    "now about into over under again further once here there"
).split()
#: Not within a word, of any alphabet.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
HONORIFICS = ["mr", "mrs", "ms", "dr", "prof", "shri", "smt"]


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTS, PLAIN)


def tokens(c: Column) -> Column:
    """Runs of letters and digits, folded; empty for null."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def search_terms(c: Column, most: int = 16) -> Column:
    """The first terms of over two characters of a question."""
    return F.slice(F.filter(tokens(c), lambda w: F.length(w) > 2), 1, most)


def document_id(scope: Column, text: Column) -> Column:
    """Content identity: 32 hexadecimal digits of sha256(scope:sha256(content))."""
    return F.substring(F.sha2(F.concat_ws(":", scope, F.sha2(F.coalesce(text, F.lit("")), 256)), 256), 1, 32)


def chunk_id(doc: Column, ordinal: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", doc, ordinal.cast("string"), text), 256), 1, 32)


def score_parts(c: Column, least: int = 200) -> dict[str, Column]:
    """The four penalties of an extracted text."""
    t = F.coalesce(c, F.lit(""))
    n = F.length(t)
    plain = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", ""))
    bad = n - F.length(F.translate(t, "�\x00", ""))
    words = F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")
    average = F.length(F.regexp_replace(t, r"\s", "")) / F.size(words)
    return {"low_alphanumeric_ratio": plain / n < 0.75, "replacement_chars_present": bad / n > 0.001, "no_word_boundaries": average > 18, "suspiciously_short": n < least}


def score_text(c: Column, least: int = 200) -> Column:
    """Extraction quality from 0 to 1; 0 for null and empty texts."""
    p = score_parts(c, least)
    cost = {"low_alphanumeric_ratio": 0.35, "replacement_chars_present": 0.35, "no_word_boundaries": 0.25, "suspiciously_short": 0.20}
    total = F.lit(1.0)
    for k, x in cost.items():
        total = total - F.when(p[k], x).otherwise(0.0)
    return F.when(F.length(F.coalesce(c, F.lit(""))) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(total, 3)))


def score_warnings(c: Column, least: int = 200) -> Column:
    """The names of the penalties, joined by commas."""
    p = score_parts(c, least)
    return F.when(F.length(F.coalesce(c, F.lit(""))) == 0, "empty_extraction").otherwise(F.concat_ws(",", *[F.when(x, k) for k, x in p.items()]))


def pii_tags(c: Column, most: int = 200_000) -> Column:
    """Sorted kinds of personal data in the first ``most`` characters, joined by commas."""
    head = F.substring(F.coalesce(c, F.lit("")), 1, most)
    return F.concat_ws(",", *[F.when(head.rlike(p), k) for k, p in PII.items()])


def classify(c: Column, name: Column | None = None, most: int = 20_000) -> Column:
    """The sensitivity level: internal at first, and never lowered by a marker; personal data lifts it to confidential."""
    head = F.lower(F.concat_ws("\n", F.coalesce(name if name is not None else F.lit(""), F.lit("")), F.substring(F.coalesce(c, F.lit("")), 1, most)))
    return F.when(head.rlike(MARKERS["restricted"]), "restricted").when(head.rlike(MARKERS["confidential"]) | (pii_tags(c) != ""), "confidential").otherwise("internal")


def clean_text(c: Column) -> Column:
    """Lines of a page's text without tags, short lines and interface phrases."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n|\r", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "<[^>]+>", "")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    good = F.filter(lines, lambda x: (F.length(x) >= 3) & ~((F.length(x) < 120) & F.lower(x).rlike(JUNK)))
    return F.array_join(good, "\n")


def junk_ratio(c: Column) -> Column:
    """The share of lines below 45 characters; 1 without lines."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(lines) == 0, 1.0).otherwise(F.size(F.filter(lines, lambda x: F.length(x) < 45)) / F.size(lines))


def flat(c: Column) -> Column:
    """White space collapsed to single blanks."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _last(text: Column, what: str) -> Column:
    """0-based place of the last ``what`` in text, -1 if it has none."""
    at = F.locate(what[::-1], F.reverse(text))
    return F.when(at == 0, -1).otherwise(F.length(text) - at - len(what) + 1)


def snippet(c: Column, most: int = 220) -> Column:
    """An excerpt that ends with a sentence, else with a word."""
    t = flat(c)
    w = F.substring(t, 1, most)
    out = F.when(F.length(t) <= most, t)
    for mark in (". ", "! ", "? "):
        out = out.when(_last(w, mark) > most * 0.4, F.trim(F.substr(w, F.lit(1), _last(w, mark) + 1)))
    return out.otherwise(F.concat(F.trim(F.when(_last(w, " ") > 0, F.substr(w, F.lit(1), _last(w, " "))).otherwise(w)), F.lit("…")))


def autotitle(c: Column) -> Column:
    """A title from a first prompt."""
    title = F.regexp_replace(F.substring(flat(c), 1, 60), "[ ,.;:-]+$", "")
    return F.when(title == "", "New chat").otherwise(title)


def urls(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(https?://[^\s]+)"), F.lit(1))


def sentences(c: Column) -> Column:
    """Split after . ! ? before a capital of A-Z or a Devanagari letter."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"([.!?])\s+([A-Zऀ-ॿ])", "$1\u0001$2"), "\u0001"), lambda s: F.trim(s) != "")


def keyword_tokens(c: Column) -> Column:
    """Words of at least four letters that are no stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z][a-z\-']{2,}"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS))


def title_entities(c: Column, most: int | None = 10) -> Column:
    """The first runs of one to four capitalised words; all without ``most``."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(BEFORE + r"([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){0,3})" + AFTER), F.lit(1))
    return found if most is None else F.slice(found, 1, most)


def fingerprint(c: Column) -> Column:
    """A digest of the lower-cased text with white space collapsed."""
    return F.md5(F.lower(flat(c)))


def normal_name(c: Column) -> Column:
    """A person's name: lower case, without dots, commas and honorifics."""
    parts = F.split(F.regexp_replace(F.lower(flat(c)), "[.,]", ""), r"\s+")
    return F.array_join(F.filter(parts, lambda w: (w != "") & ~w.isin(HONORIFICS)), " ")


def family_key(name: Column) -> Column:
    """A file's name without its extension and stacked version or date endings."""
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[A-Za-z0-9]{1,5}$", "")
    stem = flat(F.translate(stem, "_", " "))
    ending = r"(?i)([\s\-]*(\(\d+\)|v\.?\s?\d+(\.\d+)*|final|draft|copy|latest|\d{4}[-.]\d{1,2}[-.]\d{1,2}|\d{1,2}\s?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*(\s?\d{2,4})?))+$"
    return F.lower(F.trim(F.regexp_replace(stem, ending, "")))


def parse_time(c: Column) -> Column:
    """A feed's time stamp in one of the usual forms, in UTC; null otherwise."""
    t = F.trim(c)
    forms = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    # RFC 2822: the week day is left out, which the parser doesn't take
    mail = F.regexp_replace(F.regexp_replace(t, "^[A-Za-z]{3}, ", ""), " GMT$", " +0000")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms], F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def recency(ts: Column, now: Column, hours: int) -> Column:
    """1 just now, falling to 0 at the end of the window; 1 in the future, 0 if unknown."""
    age = F.unix_timestamp(now) - F.unix_timestamp(ts)
    return F.when(ts.isNull(), 0.0).when(age < 0, 1.0).when(age > hours * 3600, 0.0).otherwise(1.0 - age / (hours * 3600))


def cut_prose(c: Column, budget: int) -> Column:
    """The beginning of a text, at a paragraph, sentence or line end if one lies beyond 66 % of the budget."""
    w = F.substring(c, 1, budget)
    out = F.when(F.length(c) <= budget, c)
    for mark in ("\n\n", ". ", "\n"):
        out = out.when(_last(w, mark) > budget * 0.66, F.rtrim(F.substr(w, F.lit(1), _last(w, mark))))
    return out.otherwise(F.rtrim(w))


# Fixed values, which must match for right results: the words and stop words of word clouds.
CLOUD_WORD = r"[A-Za-z][A-Za-z'\-]{1,}[A-Za-z]|[A-Za-z]{2,}"
CLOUD_STOP_WORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot "
    "could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he "
    "he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me "
    "more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's "
    "should shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've "
    "this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which "
    "while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves also like just get "
    "got one two three said says say new using use used via etc within across per without upon towards among "
).split()
