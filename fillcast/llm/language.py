"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of excerpts of its labelled texts. A text is lower-cased,
its white space made single, and cut into pieces; every piece is compressed with every dictionary, and the language
whose dictionary leaves the fewest bytes in all wins. Pieces are compressed on their own, so a long text doesn't become
its own dictionary. The matcher is greedy and takes matches of three bytes on: the letters of one syllable already tell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillcast.llm.common import with_text_columns

#: Bounds of what a dictionary is made from: rows of a language, characters of a row, bytes of the dictionary.
SAMPLE_ROWS, EXCERPT_CHARS, DICTIONARY_BYTES = 512, 512, 65_536
#: Dictionaries are broadcast, so there may be so many languages; more raise an error.
MOST_LANGUAGES = 1_000
#: Bytes of a text compressed at once.
PIECE_BYTES = 1_000
#: A prediction is accepted if the runner-up needs more bytes by this share.
LEAST_MARGIN = 0.01

UNKNOWN = "und"

_MATCHER = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 5, "min_match": 3, "target_length": 32, "strategy": zstandard.STRATEGY_GREEDY}


def held_out(id_col: str = "doc_id") -> Column:
    """A third of the ids, by crc32 of the id as text; NULL reads as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def plain(text: str) -> bytes:
    """Lower case, single spaces, UTF-8: what is compressed."""
    return " ".join(text.lower().split()).encode("utf-8", "replace")


@dataclass(frozen=True)
class LanguageDictionaries:
    """Languages, the most labelled first, and the raw content of their dictionaries."""

    names: tuple[str, ...]
    contents: tuple[bytes, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        params = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **_MATCHER)
        out = []
        for content in self.contents:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params))
        return out


def compressed_sizes(body: bytes, compressors: list[zstandard.ZstdCompressor], piece: int = PIECE_BYTES) -> list[int]:
    """Bytes that a whole text needs with each dictionary, piece by piece."""
    pieces = [body[i:i + piece] for i in range(0, len(body), piece)] or [b""]
    return [sum(len(c.compress(p)) for p in pieces) for c in compressors]


def verdict(sizes: list[int], least_margin: float = LEAST_MARGIN) -> tuple[int, float, float, bool]:
    """The winner's place (ties: the most labelled), its score, its margin, and whether the margin is wide enough.

    Each byte more halves a language's odds; the score is the winner's share of them.
    """
    s = np.array(sizes, np.float64)
    best = int(np.argmin(s))
    score = float(1.0 / np.exp2(np.maximum(s[best] - s, -1000.0)).sum())
    second = np.delete(s, best).min() if len(s) > 1 else np.inf
    margin = 1.0 if second == np.inf else float((second - s[best]) / second)
    return best, score, margin, margin >= least_margin


def train_languages(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
    rows: int = SAMPLE_ROWS, chars: int = EXCERPT_CHARS, size: int = DICTIONARY_BYTES,
) -> LanguageDictionaries:
    """Dictionaries from at most `rows` labelled, not held-out texts of each language, an excerpt of each.

    Rows are taken by the smallest hashes of their texts, so equal texts count once and the choice doesn't depend on
    partitions. Labels are counted first; only rows under a threshold that leaves a few times `rows` of a language
    are shuffled. Rows of NULL language or without a letter teach nothing.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~held_out(id_col)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    found = counts.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not found:
        return LanguageDictionaries((), ())
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4.0 * rows / r["n"])) for r in found], "lang string, share double")
    hashed = known.withColumn("h", F.xxhash64("text")).join(F.broadcast(share), "lang")
    low = hashed.filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    start = F.pmod(F.shiftrightunsigned("h", 30), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    excerpts = low.groupBy("lang", "h").agg(F.min(F.substring("text", start, F.lit(chars))).alias("x"))
    first = excerpts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= rows)
    joined = first.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]), " ").alias("x"))
    bodies = {r["lang"]: plain(r["x"])[:size] for r in joined.collect()}  # rows x chars of a language at most
    names = [r["lang"] for r in found if bodies.get(r["lang"])]
    return LanguageDictionaries(tuple(names), tuple(bodies[n] for n in names))


def identify_languages(
    docs: DataFrame, known: LanguageDictionaries, text: str = "text", keep: list[str] | None = None,
    piece: int = PIECE_BYTES, least_margin: float = LEAST_MARGIN,
) -> DataFrame:
    """Documents with lang_pred, score (0 to 1), margin and accepted, from whole texts.

    NULL texts and texts without a letter, and all texts if no language was learned, get `und`, score 0 and no
    acceptance. `accepted` is false where the margin is narrow; the prediction is given all the same. Input columns
    named like a result are replaced. No row is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known.names, known.contents))
    fields = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    names = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in fields}]

    def start():
        own = LanguageDictionaries(*shared.value)
        compressors = own.compressors()

        def compute(texts: list[bytes]) -> list[pa.Array]:
            rows = []
            for raw in texts:
                if not raw or not own.names:
                    rows.append((UNKNOWN, 0.0, 0.0, False))
                    continue
                best, score, margin, accepted = verdict(compressed_sizes(plain(raw.decode("utf-8", "replace")), compressors, piece), least_margin)
                rows.append((own.names[best], score, margin, accepted))
            columns = zip(*rows, strict=True)
            return [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]

        return compute

    lettered = F.when(F.col(f"`{text}`").rlike(r"\p{L}"), F.col(f"`{text}`"))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), lettered.alias("__lettered"))
    return with_text_columns(inner, "__lettered", fields, start, ["__row"]).select("__row.*", *[f.name for f in fields])
