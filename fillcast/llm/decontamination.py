"""Benchmark decontamination with a broadcast set of normalised test n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillcast.llm.common import with_text_columns
from fillcast.operators.ordered import stored

WINDOW_WORDS = 10
#: Windows in one broadcast set. Larger benchmarks are scanned for in several sets, one after the other.
SET_WINDOWS = 500_000
#: Windows of one item that reach the driver in one piece.
PIECE_WINDOWS = 20_000

_word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
]
_SPANS = pa.list_(pa.list_(pa.int64()))


@dataclass
class WindowSet:
    """Windows as tuples of word numbers, by length, with the items that hold them."""

    words: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, dict[tuple[int, ...], list[str]]] = field(default_factory=dict)
    size: int = 0

    def add(self, item: str, tokens: list[bytes], width: int) -> None:
        n = min(width, len(tokens))
        ids = [self.words.setdefault(w, len(self.words)) for w in tokens]
        of_length = self.windows.setdefault(n, {})
        for i in range(len(ids) - n + 1):
            items = of_length.setdefault(tuple(ids[i:i + n]), [])
            if item not in items[-1:]:
                items.append(item)
            self.size += 1


def _pieces(benchmark: DataFrame, id_col: str, text: str, width: int, windows: int) -> DataFrame:
    """The words of each item, in pieces of at most `windows` windows that overlap by `width` - 1 words."""
    def run(batches):
        for batch in batches:
            items, pieces = [], []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = _word.findall((body or "").encode().lower())
                for at in range(0, max(1, len(tokens) - width + 1) if tokens else 0, windows):
                    items.append(item or "")
                    pieces.append(b" ".join(tokens[at:at + windows + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())], names=["item", "words"])

    return benchmark.select(F.col(id_col).cast("string"), F.col(text)).mapInArrow(run, "item string, words binary")


def window_sets(benchmark: DataFrame, id_col: str, text: str, width: int, limit: int) -> Iterator[WindowSet]:
    """The benchmark as sets of at most `limit` windows; pieces of bounded length pass the driver one by one."""
    current = WindowSet()
    for item, words in _pieces(benchmark, id_col, text, width, min(limit, PIECE_WINDOWS)).toLocalIterator():
        tokens = bytes(words).split(b" ")
        if current.size and current.size + max(1, len(tokens) - width + 1) > limit:
            yield current
            current = WindowSet()
        current.add(item, tokens, width)
    if current.size:
        yield current


def _scan(found: WindowSet, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges that equal a window, and the items of those windows."""
    get = found.words.get
    ids = [get(w, -1) for w in tokens]
    known = (np.array(ids, dtype=np.int64) >= 0).view(np.int8)
    edges = np.flatnonzero(np.diff(known, prepend=0, append=0))
    hits, items = [], set()
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        for n, windows in found.windows.items():
            for i in range(begin, end - n + 1):
                at = windows.get(tuple(ids[i:i + n]))
                if at is not None:
                    hits.append((i, i + n))
                    items.update(at)
    return hits, items


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _scanned(docs: DataFrame, found: WindowSet, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def start():
        own = shared.value

        def compute(texts: list[bytes]) -> list[pa.Array]:
            counts, spans, items = [], [], []
            for body in texts:
                tokens = _word.findall(body.lower())
                hits, of = _scan(own, tokens) if own.size and tokens else ([], set())
                counts.append(len(tokens))
                spans.append(_merge(hits))
                items.append(sorted(of))
            return [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]

        return compute

    return with_text_columns(docs, text, _FIELDS, start)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WINDOW_WORDS, limit: int = SET_WINDOWS, keep: list[str] | None = None,
) -> DataFrame:
    """Documents with `n_words`, `hit_spans` (word ranges [from, to), merged), `n_hit`, `items`, `contaminated`.

    Words are runs of ASCII letters and digits and of other code points, A-Z lower-cased. A window is
    `width` consecutive words of an item; an item of fewer words, but not none, is one window. Hash hits
    are verified, since the set holds the windows themselves. The broadcast set has at most `limit`
    windows; longer items are cut into pieces that overlap by `width` - 1 words, and a larger benchmark
    becomes several sets, scanned for in turn without a shuffle.
    NULL and empty texts have no words; items without words and an empty benchmark hit nothing; a NULL
    item id is listed as an empty string. Input columns named like a result are replaced.
    """
    results = ["n_words", "hit_spans", "items", "n_hit", "contaminated"]
    source = docs.select(*dict.fromkeys([*keep, text])) if keep is not None else docs
    marked = source.drop(*[c for c in results if c != text])
    nothing = {"hit_spans": F.array().cast("array<array<bigint>>"), "items": F.array().cast("array<string>")}
    sets = window_sets(benchmark, item_id, item_text, width, limit)
    found, following, scanned = next(sets, WindowSet()), next(sets, None), 0
    while found is not None:
        before = {f"__{c}": marked[c] if scanned else v for c, v in nothing.items()}
        marked = _scanned(marked.withColumns(before), found, text)
        if scanned or following is not None:
            marked = marked.withColumns({
                "hit_spans": _merged_spans(F.concat("__hit_spans", "hit_spans")),
                "items": F.array_sort(F.array_union("__items", "items"))})
        marked = marked.drop("__hit_spans", "__items")
        if following is not None:
            marked = stored(marked)  # this set's broadcast is not needed again
        found, following, scanned = following, next(sets, None) if following is not None else None, scanned + 1
    if keep is not None and text not in keep:
        marked = marked.drop(text)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + (x[1] - x[0]))
    return marked.withColumns({"n_hit": n_hit, "contaminated": F.size("hit_spans") > 0})


def _merged_spans(spans):
    """Union of word ranges that come from several sets."""
    empty = F.array().cast("array<array<bigint>>")

    def step(done, x):
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (x[0] <= F.coalesce(last[1], F.lit(-1)))
        joined = F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.array(last[0], F.greatest(last[1], x[1]))))
        return F.when(touches, joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, step)


def remove_spans(docs: DataFrame, text: str = "text", spans: str = "hit_spans", out: str = "clean_text") -> DataFrame:
    """Cut the marked words, with what lies between them, out of each text."""
    names = [c for c in docs.columns if c != out]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out, T.StringType())])
    at, where = names.index(text), names.index(spans)

    def run(batches):
        for batch in batches:
            cleaned = []
            for body, ranges in zip(batch.column(at).to_pylist(), batch.column(where).to_pylist(), strict=True):
                raw = (body or "").encode()
                found = [m.span() for m in _word.finditer(raw.lower())]  # A-Z only: offsets stay those of the text
                parts, last = [], 0
                for a, b in ranges or []:
                    parts.append(raw[last:found[a][0]])
                    last = found[b - 1][1]
                cleaned.append((b"".join(parts) + raw[last:]).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cleaned, pa.string())], names=[*names, out])

    return docs.select(*names).mapInArrow(run, schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows, with their own columns, that hold no window of the benchmark."""
    marked = find_contamination(docs.withColumn("__row", F.struct(*docs.columns)), benchmark, text, keep=["__row"])
    return marked.filter(~F.col("contaminated")).select("__row.*")
