"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillcast.llm.common import ascii_lower
from fillcast.llm.quality import words_of
from fillcast.operators.ordered import stored

MIN_CHARS = 12
#: Words in the dictionary (the most widespread of the corpus) and labelled findings the forest is fitted on.
DICTIONARY_WORDS = 1000
SAMPLE_FINDINGS = 20_000
TREES, DEPTH, SEED = 30, 7, 11
THRESHOLD = 0.5
NEIGHBOUR_BUCKETS = 16

#: Words that stand before a secret, and formats of known issuers (fixed values).
KEYWORDS = ["password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "api-key", "access_key", "auth", "credential"]
ISSUED = "^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[0-9A-Za-z_-]{35}$|^sk_live_[0-9A-Za-z]{24,}$"
HARMLESS = (
    "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$|^[0-9+(). -]+$|^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    "|^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$|^[a-z]{2}[0-9]{2}[0-9A-Z]{11,30}$")

_EDGE = "\"'`(),;.[]{}<>!?*#$%&|"
FEATURES = [
    "f_length", "f_classes", "f_changes", "f_digit_letter", "f_letter_digit", "f_case_change", "f_distinct", "f_digits", "f_upper",
    "f_hex", "f_dictionary", "f_path", "f_url", "f_at", "f_issued", "f_harmless", "f_assigned", "f_keyword_here", "f_keyword_before"]


_KEYWORD = "(?:" + "|".join(KEYWORDS) + ")"
_VALUE = """(?:(?<=")[^"]+|(?<=')[^']+|[^"'&,;{}<>\\s]+)"""
_NAMED = f"""(?i)([A-Za-z0-9_.-]*{_KEYWORD})["']?[=:]+>?["'(]*({_VALUE})"""
_LOGIN = "://[^/?#:@]*:([^/?#]+)@"
_INSIDE = f"""[=:]+["']?([A-Za-z0-9+_.~%-][A-Za-z0-9+/_.=~%-]{{{MIN_CHARS - 1},}})"""
_ISSUED_INSIDE = "(?<![A-Za-z0-9])(?:" + ISSUED.replace("^", "").replace("$", "(?![A-Za-z0-9])") + ")"
_DIGITS = "[0-9].*[0-9]"


def _values_of(word: Column, before: Column, before2: Column) -> Column:
    """Structs (value, name) of a word; `name` is the keyword a value is assigned to, else empty."""
    value = lambda c, name: F.struct(c.alias("value"), name.alias("name"))
    none = F.lit("")
    all_of = lambda pattern, group: F.regexp_extract_all(word, F.lit(pattern), F.lit(group))
    named = F.transform(all_of(_NAMED, 0), lambda m: value(F.regexp_extract(m, _NAMED, 2), ascii_lower(F.regexp_extract(m, _NAMED, 1))))
    login = F.transform(all_of(_LOGIN, 1), lambda v: value(v, F.lit("password")))
    sign = before.isin("=", ":", ":=", "=>")
    key = F.regexp_extract(F.when(sign, before2).otherwise(before), f"(?i)([A-Za-z0-9_.-]*{_KEYWORD})[\"'`]?[=:]*>?$", 1)
    after_key = F.when((F.length(key) > 0) & (sign | before.rlike("[=:]>?$")), F.array(
        value(F.regexp_extract(word, f"^[\"'`(]*({_VALUE})", 1), ascii_lower(key)))).otherwise(F.array())
    issued = F.transform(all_of(_ISSUED_INSIDE, 0), lambda v: value(v, none))
    inside = F.transform(F.filter(all_of(_INSIDE, 1), lambda v: v.rlike(_DIGITS)), lambda v: value(v, none))
    stripped = F.btrim(word, F.lit(_EDGE))
    whole = F.when(stripped.contains("://"), F.regexp_extract(stripped, "([^/]*)/?$", 1)).otherwise(
        F.btrim(F.regexp_replace(stripped, "^[A-Za-z_.-]{1,40}[=:]+", ""), F.lit(_EDGE)))
    long = (F.length(word) >= MIN_CHARS) & word.rlike(_DIGITS) & word.rlike(f"[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}")
    whole = F.when(long, F.array(value(whole, none))).otherwise(F.array())
    trimmed = lambda c: F.transform(c, lambda x: value(F.btrim(x["value"], F.lit(_EDGE)), x["name"]))
    kind = "array<struct<value:string,name:string>>"
    sure = F.filter(F.concat(login.cast(kind), named.cast(kind), after_key.cast(kind)), lambda x: F.length(x["value"]) > 0)
    rest = F.concat(trimmed(F.concat(issued.cast(kind), inside.cast(kind))), whole.cast(kind))
    known = F.transform(sure, lambda x: F.btrim(x["value"], F.lit(_EDGE)))
    return F.array_distinct(F.concat(sure, F.filter(rest, lambda x: ~F.array_contains(known, F.btrim(x["value"], F.lit(_EDGE))))))


def find_candidates(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows (kept columns, position, word, before, before2, after, value, name), several for a word with several values.

    Candidates are issuers' formats anywhere in a word; values assigned to a keyword, in the word or the words before
    it, whatever their length and characters (`name` is that keyword); passwords of user:password@; and long words,
    or long values in them, with two digits. A quoted value ends with its word.
    `position` counts words from 0. NULL and empty texts have none. All columns of the input are kept unless
    `keep` says otherwise; those named like a result are replaced.
    """
    results = ["position", "word", "before", "before2", "after", "value", "name"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in results]
    rows = docs.select(*names, words_of(F.coalesce(F.col(text), F.lit(""))).alias("__w"))
    word = lambda i: F.coalesce(F.get("__w", i), F.lit(""))
    # A cheap test first; which values a word has is decided once for each word that passes.
    able = F.filter(
        F.sequence(F.lit(0), F.size("__w") - 1),
        lambda i: ((F.length(word(i)) >= MIN_CHARS) & (word(i).rlike(_DIGITS) | word(i).rlike(_ISSUED_INSIDE)))
        | word(i).rlike("[=:]") | word(i - 1).rlike("[=:]>?$"))
    found = F.when(F.size("__w") > 0, F.transform(able, lambda i: F.struct(
        i.cast("long").alias("position"), word(i).alias("word"),
        word(i - 1).alias("before"), word(i - 2).alias("before2"), word(i + 1).alias("after"))))
    rows = rows.withColumn("__f", F.explode(found)).select(*names, "__f.*")
    rows = rows.withColumn("__v", F.explode(_values_of(F.col("word"), F.col("before"), F.col("before2"))))
    return rows.select(*names, "position", "word", "before", "before2", "after", "__v.value", "__v.name")


def corpus_dictionary(docs: DataFrame, text: str = "text", n: int = DICTIONARY_WORDS) -> list[str]:
    """The n words of three letters or more found in most documents; ties in word order."""
    words = F.array_distinct(F.filter(
        F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[^\x00-\x60\x7B-\x7F]+"), F.lit(0)), lambda w: F.length(w) >= 3))
    top = docs.select(F.explode(words).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(n)
    return [r["w"] for r in top.collect()]


def _count(value: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)))


def _bare(word: Column) -> Column:
    return ascii_lower(F.btrim(word, F.lit(_EDGE + "=:")))


def add_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """Add FEATURES and hashed neighbours. `dictionary` has at most DICTIONARY_WORDS words."""
    v = F.col("value")
    size = F.greatest(F.length(v), F.lit(1)).cast("double")
    named = F.length("name") > 0
    key = F.when(named, F.col("name")).otherwise(ascii_lower(F.regexp_extract("word", "([A-Za-z_-]+)[=:]", 1)))
    keyword = F.array(*[F.lit(k) for k in KEYWORDS])
    runs = F.regexp_extract_all(ascii_lower(v), F.lit(r"[^\x00-\x60\x7B-\x7F]{3,}"), F.lit(0))
    listed = F.array(*[F.lit(w) for w in dictionary]).cast("array<string>")
    known = F.aggregate(F.filter(runs, lambda w: F.array_contains(listed, w)), F.lit(0), lambda s, w: s + F.length(w))
    flag = lambda c: c.cast("double")
    rows = found.withColumns({
        "f_length": size, "f_classes": sum(flag(v.rlike(p)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")),
        "f_changes": (_count(v, "[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+") - 1) / size,
        "f_digit_letter": _count(v, "(?<=[0-9])[A-Za-z]") / size, "f_letter_digit": _count(v, "(?<=[A-Za-z])[0-9]") / size,
        "f_case_change": _count(v, "(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]") / size,
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / size, "f_digits": _count(v, "[0-9]") / size,
        "f_upper": _count(v, "[A-Z]") / size, "f_hex": flag(v.rlike("^[0-9a-fA-F]+$")), "f_dictionary": known / size,
        "f_path": flag(F.col("word").rlike(r"[^/]/[^/]|\\|\.[a-z]{2,4}$")), "f_url": flag(F.col("word").contains("://") & ~named),
        "f_at": flag(F.col("word").contains("@")), "f_issued": flag(v.rlike(ISSUED)), "f_harmless": flag(v.rlike(HARMLESS)),
        "f_assigned": flag(named | F.col("word").rlike("[A-Za-z][=:]") | F.col("before").isin("=", ":", ":=", "=>") | F.col("before").rlike("[=:]$")),
        "f_keyword_here": flag(F.array_contains(keyword, key) | (named & key.rlike(f"(^|[^a-z]){_KEYWORD}$"))),
        "f_keyword_before": flag(F.array_contains(keyword, _bare(F.col("before"))) | F.array_contains(keyword, _bare(F.col("before2"))))})
    bucket = {"before": F.when(F.length(key) > 0, key).otherwise(_bare(F.col("before"))), "after": _bare(F.col("after"))}
    hashed = {f"f_{side}_{k}": flag(F.pmod(F.hash(c), F.lit(NEIGHBOUR_BUCKETS)) == k) for side, c in bucket.items() for k in range(NEIGHBOUR_BUCKETS)}
    return rows.withColumns(hashed)


def rule_labels(found: DataFrame) -> DataFrame:
    """Findings with `label` where strict rules are sure; the rest gets none and is dropped.

    Stands in for reviewed findings when there are none: 1 for issuers' formats and for values of eight or more
    hex or mixed characters assigned to a keyword; 0 for harmless formats, urls and values without either.
    """
    f = F.col
    secret = (f("f_issued") == 1) | ((f("f_assigned") == 1) & ((f("f_keyword_here") == 1) | (f("f_keyword_before") == 1)) & (f("f_length") >= 8) & (f("f_harmless") == 0) & (f("f_url") == 0))
    plain = (f("f_harmless") == 1) | (f("f_url") == 1) | ((f("f_assigned") == 0) & (f("f_keyword_before") == 0) & (f("f_keyword_here") == 0))
    return found.withColumn("label", F.when(secret, 1.0).when(plain, 0.0)).filter("label IS NOT NULL")


def scan_secrets(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """Findings with `score`, the forest's probability, and `is_secret` (from 0.5 on).

    `labelled` has candidates of `find_candidates` with a 0/1 `label`; without it `rule_labels` labels the
    candidates themselves. At most SAMPLE_FINDINGS of them, by order of a hash of their value, fit the forest.
    If all have one label, that label is every score; with no labelled finding the score is 0. The dictionary
    counts all documents. Repeated rows give repeated findings.
    """
    names = [id_col] if keep is None else keep
    dictionary = corpus_dictionary(docs, text)
    found = stored(find_candidates(docs, text, names))
    featured = add_features(found, dictionary)
    sample = rule_labels(featured) if labelled is None else add_features(labelled, dictionary)
    hashed = [f"f_{s}_{k}" for s in ("before", "after") for k in range(NEIGHBOUR_BUCKETS)]
    inputs = [*FEATURES, *hashed]
    sample = stored(sample.select(*inputs, "label", "value").orderBy(F.xxhash64("value"), "value", *FEATURES).limit(SAMPLE_FINDINGS))
    kinds = sample.agg(F.min("label"), F.max("label")).first()
    results = ["position", "word", "value", "score", "is_secret"]
    if kinds[0] is None or kinds[0] == kinds[1]:
        scored = found.withColumn("score", F.lit(float(kinds[0] or 0.0)))
    else:
        assembler = VectorAssembler(inputCols=inputs, outputCol="__features")
        forest = RandomForestClassifier(
            featuresCol="__features", labelCol="label", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__y",
            numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32, minInstancesPerNode=2)
        model = forest.fit(assembler.transform(sample).select("__features", "label"))
        scored = model.transform(assembler.transform(featured)).withColumn("score", vector_to_array("__p")[1])
    return scored.withColumn("is_secret", F.col("score") >= THRESHOLD).select(*names, *results)
