r"""Quality rules by distribution divergence (operator 2), DataFrame functions only.

For each document: base counts (words, symbols, repeated lines, words in
repeated 3-word windows), a histogram of character classes and one of the
common words of its language.  The references are the same histograms summed
over all documents of the language that pass the base rules.  Two
Jensen-Shannon distances (base 2, square root) compare document and
reference.  Guards: a distance counts only for texts with at least
``MIN_CHARS`` characters (``MIN_WORDS`` words for common words), and only if
the language's reference has as much.  From the squared word distance the
part that chance gives a text of that many words, ``SLOTS / (8 n ln 2)``, is
taken off first.

``base_failed``: fewer than 50 words, or more than half of the words lie in
repeated 3-word windows.  ``kept``: not base_failed, and no counted distance
is above its limit.

Null and empty texts have zero counts, null distances, and fail the base.  A
null or unknown language has no common words; its class reference is that of
all documents with the same (possibly null) language.  Repeated rows are
judged alike; an empty table gives an empty result.  All input columns stay
inside the struct ``row``, so names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
# Common words of each language, most frequent first.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it"],
    "fr": ["le", "la", "de", "des", "les", "et", "un", "que"],
    "de": ["der", "die", "das", "und", "ein", "mit", "den", "von"],
    "es": ["el", "la", "de", "que", "y", "en", "los", "del"],
}
SLOTS = 8
#: Character classes, each cut out of what the ones before have left; the rest is the last class.
CLASSES = [("lower", "[a-z]+"), ("space", WS), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("letter", r"[\p{L}\p{M}]+"), ("punct", r"[.,;:'\"()\-]+")]
N_CLASSES = len(CLASSES) + 1
MIN_CHARS, MIN_WORDS = 200, 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.24


def _common(lang: Column) -> Column:
    out = F.when(F.lit(False), F.array(*[F.lit("")] * SLOTS))
    for code, words in COMMON.items():
        out = out.when(lang == code, F.array(*map(F.lit, words)))
    return out


def rule_features(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: Iterable[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, all if None), ``lang_ref``, base counts, ``n_chars_text``, c0.. and w0..; no shuffle."""
    names = list(docs.columns if keep is None else keep)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"),
                     F.col(lang_col).cast("string").alias("lang_ref"))
    df = df.withColumn("words", F.filter(F.split("t", WS), lambda w: w != ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rest = F.col("t")
    for k, (_name, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"r{k}", F.regexp_replace(rest, pattern, ""))
        rest = F.col(f"r{k}")
    df = df.withColumn("n_words", F.size("words").cast("long"))
    # hashes of 3-word windows; the last two starts have no window
    df = df.withColumn("win", F.when(F.col("n_words") >= 3, F.slice(
        F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), F.lit(1), F.size("words") - 2)))
    some = F.size(F.array_distinct("win")) < F.size("win")
    df = df.withColumn("sorted", F.when(some, F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("sorted", lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"]))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(at, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    df = df.withColumn("common", _common(F.col("lang_ref")))
    df = df.withColumn("hits", F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: F.array_contains("common", w)))
    size = [F.length("t"), *[F.length(f"r{k}") for k in range(len(CLASSES))]]
    classes = [(size[k] - size[k + 1]).cast("long").alias(f"c{k}") for k in range(len(CLASSES))] + [size[-1].cast("long").alias(f"c{len(CLASSES)}")]
    n_hits = F.size("hits")
    words = [F.coalesce(n_hits - F.size(F.array_remove("hits", F.get("common", F.lit(k)))), F.lit(0)).cast("long").alias(f"w{k}") for k in range(SLOTS)]
    others = F.when(F.col("common").isNull(), F.lit(0)).otherwise(F.size("words") - n_hits).cast("long").alias(f"w{SLOTS}")
    symbols = F.length("r0") - F.length(F.translate("r0", "#*$%&|<>", ""))
    return df.select(
        "row", "lang_ref", "n_words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length("t").cast("long").alias("n_chars_text"), *classes, *words, others)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(features: DataFrame) -> DataFrame:
    """One row per language with the summed histograms of rows that pass the base (added up before the shuffle)."""
    names = [f"c{k}" for k in range(N_CLASSES)] + [f"w{k}" for k in range(SLOTS + 1)]
    return features.groupBy(F.col("lang_ref").alias("lang_key")).agg(*[F.sum(F.when(~base_failed(), F.col(n)).otherwise(0)).alias(f"ref_{n}") for n in names])


def _total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two equally long count arrays; null if either is empty."""
    share = lambda h: F.transform(h, lambda x: x / _total(h))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m) / 2).otherwise(0.0)
    parts = F.zip_with(share(p), share(q), lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    return F.when((_total(p) > 0) & (_total(q) > 0), F.sqrt(F.greatest(_total(parts), F.lit(0.0))))


def judge(features: DataFrame, refs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """``row`` and the base counts with ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``."""
    df = features.join(refs, F.col("lang_ref").eqNullSafe(F.col("lang_key")), "left")
    counts = lambda pre, n: F.array(*[F.col(f"{pre}{k}").cast("double") for k in range(n)])
    c, cr, w, wr = counts("c", N_CLASSES), counts("ref_c", N_CLASSES), counts("w", SLOTS + 1), counts("ref_w", SLOTS + 1)
    enough = lambda q, n: _total(q) >= n
    df = df.withColumn("class_distance", F.when((F.col("n_chars_text") >= MIN_CHARS) & enough(cr, MIN_CHARS), js_distance(c, cr)))
    df = df.withColumn("word_distance", F.when((F.col("n_words") >= MIN_WORDS) & enough(wr, MIN_WORDS), js_distance(w, wr)))
    failed = base_failed()
    chance = F.lit(SLOTS / (8 * math.log(2))) / F.col("n_words")
    far = F.coalesce(F.col("class_distance") > max_class, F.lit(False)) | F.coalesce(F.col("word_distance") * F.col("word_distance") - chance > max_word * max_word, F.lit(False))
    return df.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance",
                     failed.alias("base_failed"), (~failed & ~far).alias("kept"))
