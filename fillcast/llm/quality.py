"""Line-first quality rules: clean line by line, then reject documents that lose too much."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillcast.llm.common import WORD

WINDOW_WORDS = 8


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document rule."""

    #: A line of this many words or more must end a sentence somewhere.
    sentence_words: int = 12
    #: Symbols in 100 words from which a line is symbol noise.
    symbols_per_100_words: int = 50
    #: A line with separators and at most this many words for each of them is a menu.
    menu_words_per_separator: int = 3
    #: Characters lost, in percent of all characters in lines with a word, beyond which a document is rejected.
    max_lost_percent: int = 50


#: Sentence ends, menu separators, menu lines and boilerplate phrases (fixed values, lower case).
SENTENCE_END = "[.!?:;…。！？]"
SEPARATOR = "[|»›•·]"
MENU_LINE = (
    r"(?i)^\s*(home|menu|about( us)?|contact( us)?|login|log in|sign (in|up)|register|search|share|next|previous|back to top"
    r"|read more|skip to content)\s*$")
BOILERPLATE = [
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies",
    "accept cookies", "enable javascript", "lorem ipsum", "subscribe to our newsletter", "copyright ©", "copyright (c)", "powered by"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_symbols_of(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))


def n_word_chars_of(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def line_facts(line: Column) -> Column:
    """What the rules ask of a line, each taken once; words are counted only where a rule looks at them."""
    symbols, separators, ends = n_symbols_of(line), F.regexp_count(line, F.lit(SEPARATOR)), line.rlike(SENTENCE_END)
    words = F.when(~ends | (symbols > 0) | (separators > 1), F.regexp_count(line, F.lit(WORD))).otherwise(0)
    return F.struct(
        words.alias("words"), symbols.alias("symbols"), separators.alias("separators"), ends.alias("ends"),
        line.rlike(MENU_LINE).alias("menu"), F.lower(line).alias("low"))


def line_fails(facts: Column, rules: LineRules) -> Column:
    """True if any of the punctuation, navigation and boilerplate rules rejects the line."""
    x = {k: facts[k] for k in ("words", "symbols", "separators", "ends", "menu", "low")}
    punctuation = (~x["ends"] & (x["words"] >= rules.sentence_words)) | ((x["symbols"] > 0) & (x["symbols"] * 100 > x["words"] * rules.symbols_per_100_words))
    navigation = ((x["separators"] >= 2) & (x["words"] <= x["separators"] * (rules.menu_words_per_separator + 1))) | x["menu"]
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | x["low"].contains(phrase)
    return punctuation | navigation | boilerplate


def window_hashes(hashes: Column, width: int) -> Column:
    """A hash of each window of `width` words, from the words' hashes.

    Elements are read one by one: `slice` would copy the whole array each time.
    """
    n = F.size(hashes)
    return F.when(n < width, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])))


def score_documents(docs: DataFrame, text: str = "text", rules: LineRules | None = None) -> DataFrame:
    """Documents with base counts, `clean_text`, `lost_percent`, `base_failed` and `kept`.

    Base counts look at the whole text: `n_words`, `word_chars` (code points in words), `n_symbols`,
    `n_dup_lines` (lines with a word that equal an earlier line), `n_repeat_words`. `base_failed` is fewer
    than 20 words or over 30 % repeated words. Then the line rules run on each line; lines without a word
    stay and weigh nothing. `kept` is false for `base_failed` documents and for those whose failed lines hold
    more than `max_lost_percent` of the characters. NULL and empty texts have no words and fail. Input
    columns named like a result are replaced. No row is shuffled.
    """
    rules = rules or LineRules()
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "lost_percent", "base_failed", "kept"]
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop(*[c for c in results if c != text]).withColumns({
        "__words": words_of(t), "__lines": F.split(t, "\n", -1)})
    rows = rows.withColumn("__each", F.transform("__words", lambda w: F.xxhash64(w)))
    # A projection of its own for each step: the next ones use its columns more than once.
    rows = rows.withColumns({
        "__hashes": window_hashes(F.col("__each"), WINDOW_WORDS),
        "__worded": F.filter("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "__fails": F.transform(F.transform("__lines", line_facts), lambda x: line_fails(x, rules))})
    rows = rows.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__hashes")) < F.size("__hashes"),
        F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("__sorted")
    again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("__starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        F.coalesce(F.col("__starts"), F.array().cast("array<int>")),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("to")),
        lambda a, p: F.struct(
            (a["n"] + p + WINDOW_WORDS - F.greatest(p, a["to"])).cast("long").alias("n"), (p + WINDOW_WORDS).alias("to")),
        lambda a: a["n"])
    lost = F.aggregate(
        F.zip_with("__lines", "__fails", lambda x, f: F.when(f, n_word_chars_of(x)).otherwise(0)),
        F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": n_symbols_of(t).cast("long"),
        "n_dup_lines": (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"),
        "n_repeat_words": covered,
        "__lost": lost,
        "clean_text": F.array_join(F.transform(F.filter(
            F.arrays_zip("__lines", "__fails"), lambda z: ~z["__fails"]), lambda z: z["__lines"]), "\n")})
    rows = rows.withColumns({
        "lost_percent": F.when(F.col("word_chars") > 0, F.col("__lost") * 100.0 / F.col("word_chars")).otherwise(0.0),
        "base_failed": (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("__lost") * 100 <= F.col("word_chars") * rules.max_lost_percent)).drop(
        "__words", "__each", "__lines", "__hashes", "__worded", "__fails", "__sorted", "__starts", "__lost")
