"""Quality rules by distribution divergence, in DataFrame expressions only.

Each language has two reference histograms, summed over all its documents: of character classes, and of its most
common words and all others. A document is held against those of its language by Jensen-Shannon distance (the root of
the divergence in bits, 0 to 1). Short texts have ragged histograms, so each distance is used from a least length on.
Histograms are computed within a row; only the references' counts are shuffled, combined beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, cut

COMMON = 32
MIN_WORDS, MAX_REPEATED = 50, 50
#: Largest distances that are kept, and the words from which on they count.
MAX_CLASS, CLASS_FROM = 0.29, 50
MAX_WORDS, WORDS_FROM = 0.32, 100
#: References are broadcast for at most so many languages (a few KB each), else joined by shuffle.
BROADCAST_LANGUAGES = 2000
SYMBOLS = "#*$%&|<>"
#: Characters that aren't capitals, digits or sentence marks: counting a class is dropping the runs of all others.
_NOT_CAPITALS, _NOT_DIGITS, _NOT_MARKS = r"\P{Lu}+", r"\P{Nd}+", r"[^.,;:?'\"()-]+"
_NOT_SYMBOLS = f"[^{SYMBOLS}]+"
#: Classes of characters of words: capitals, digits, sentence marks, symbols, and the rest.
N_CLASSES = 5
#: For at most so many languages, words are first held against one set of the common words of all of them.
SET_LANGUAGES = 64


def _left(text: Column, dropped: str) -> Column:
    """Number of characters of text outside the runs that match dropped."""
    return F.char_length(F.regexp_replace(text, dropped, ""))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of the three-word windows, in order."""
    n = F.size(words)
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])))


def repeated_words(window: Column, words: Column) -> Column:
    """Number of words that lie in a window found twice or more: windows with the same hash are compared by their words."""
    placed = F.sort_array(F.transform(window, lambda h, i: F.struct(h.alias("h"), *[words[i + k].alias(f"w{k}") for k in range(3)], i.alias("i"))))
    # Neighbours in the sorted order with the same words are repeats; other windows of the same hash don't part them.
    same = lambda x, y: (x["h"] == y["h"]) & (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"])
    starts = lambda p: F.sort_array(F.filter(F.transform(p, lambda x, k: F.when(same(x, F.get(p, k - 1)) | same(x, F.get(p, k + 1)), x["i"])), lambda i: i.isNotNull()))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    fold = lambda p: F.aggregate(starts(p), zero, lambda a, s: F.struct((a["n"] + s + 3 - F.greatest(a["end"], s)).alias("n"), (s + 3).alias("end")), lambda a: a["n"])
    some = F.element_at(F.transform(F.array(placed), fold), 1)  # binds placed, so that it is computed once
    return F.when(F.size(F.array_distinct(window)) == F.size(window), F.lit(0)).otherwise(some).cast("long")


def base_features(df: DataFrame) -> DataFrame:
    """df(text, ...) with words and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    df = df.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.char_length(F.array_join("words", "")).cast("long"))
    df = df.withColumn("n_symbols", _left(text, _NOT_SYMBOLS).cast("long"))
    df = df.withColumn("n_dup_lines", F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long"))
    # A column of its own, so that the hashes are computed once.
    df = df.withColumn("_windows", window_hashes(F.col("words")))
    df = df.withColumn("n_repeat_words", repeated_words(F.col("_windows"), F.col("words"))).drop("_windows")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def class_counts(text: Column, word_chars: Column, n_symbols: Column) -> Column:
    """Array of the numbers of characters of each class."""
    known = F.array(_left(text, _NOT_CAPITALS), _left(text, _NOT_DIGITS), _left(text, _NOT_MARKS), n_symbols.cast("int"))
    return F.transform(F.array(known), lambda a: F.transform(F.concat(a, F.array(word_chars.cast("int") - F.aggregate(a, F.lit(0), lambda s, x: s + x))), lambda x: x.cast("double")))[0]


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, each of which has a positive sum."""
    share = lambda a: F.transform(F.array(a), lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda s, y: s + y)))[0]
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(share(p), share(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, y: s + y), F.lit(0.0)))


def references(df: DataFrame, common: int = COMMON) -> DataFrame:
    """One row (ref, ref_words, ref_counts, ref_classes) for each lang of df(lang, text), and one with ref null for all texts.

    ref_counts holds the counts of ref_words and of all other words; ties in frequency go by code point.
    """
    texts = df.select("lang", "text").where("text is not null")
    counts = texts.select("lang", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w")).groupBy("lang", "w").count()
    counts = cut(counts)
    every = counts.where("lang is not null").unionByName(counts.groupBy("w").agg(F.sum("count").alias("count")).select(F.lit(None).cast("string").alias("lang"), "w", "count"))
    top = every.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "w"))).where(F.col("k") <= common)
    lists = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "w", "count"))).alias("t"))
    totals = every.groupBy("lang").agg(F.sum("count").alias("n"))
    # A text's characters but spaces lie in its words, so the words' counts have those of the classes too.
    per_word = every.select("lang", "count", class_counts(F.col("w"), F.char_length("w"), _left(F.col("w"), _NOT_SYMBOLS)).alias("c"))
    classes = per_word.groupBy("lang").agg(F.array(*[F.sum(F.col("c")[i] * F.col("count")) for i in range(N_CLASSES)]).alias("ref_classes"))
    words = F.transform("t", lambda x: x["w"])
    own = F.transform("t", lambda x: x["count"].cast("double"))
    rest = F.col("n") - F.aggregate(own, F.lit(0.0), lambda s, y: s + y)
    same = lambda a, b: a["lang"].eqNullSafe(b["lang"])
    out = lists.join(totals, same(lists, totals)).select(lists["lang"], words.alias("ref_words"), F.concat(own, F.array(rest)).alias("ref_counts"))
    return out.join(classes, same(out, classes)).select(out["lang"].alias("ref"), "ref_words", "ref_counts", "ref_classes")


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_class: float = MAX_CLASS, max_words: float = MAX_WORDS) -> DataFrame:
    """One row for each row of df: doc_id, the base counts, base_failed, class_distance, word_distance, kept.

    A null text counts as empty, which fails the base rules. A document without a language is held against the
    reference of all texts. Distances are null below their least length, and then don't count. An empty table gives no
    rows.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    refs = cut(references(rows))
    langs = refs.count()
    few = langs <= BROADCAST_LANGUAGES
    feats = rows.join(F.broadcast(refs) if few else refs, F.col("lang").eqNullSafe(F.col("ref")), "left")
    feats = base_features(feats)
    words = F.col("words")
    if langs <= SET_LANGUAGES:
        common = sorted({w for r in refs.select("ref_words").collect() for w in r["ref_words"]})
        words = F.filter(words, lambda w: w.isin(common))
    matched = F.filter(words, lambda w: F.array_contains("ref_words", w))
    own = F.transform(F.array(matched), lambda m: F.concat(F.transform("ref_words", lambda r: (F.size(m) - F.size(F.array_remove(m, r))).cast("double")), F.array((F.col("n_words") - F.size(m)).cast("double"))))[0]
    feats = feats.withColumn("class_distance", F.when(F.col("n_words") >= CLASS_FROM, js_distance(class_counts(F.coalesce("text", F.lit("")), F.col("word_chars"), F.col("n_symbols")), F.col("ref_classes"))))
    feats = feats.withColumn("word_distance", F.when((F.col("n_words") >= WORDS_FROM) & ~F.col("base_failed"), js_distance(own, F.col("ref_counts"))))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class) | (F.coalesce("word_distance", F.lit(0.0)) > max_words)
    return feats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"))
