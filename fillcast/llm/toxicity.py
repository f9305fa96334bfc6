"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillcast.llm.common import as_bytes, with_text_columns
from fillcast.operators.ordered import stored

#: Bounds of the sample of labelled rows the model is fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 24 << 20
SAMPLE_PARTS = 12
THRESHOLD = 0.7

_PREFIXES = range(3, 8)
_LEVELS = 7
_MIN_DOCS = 3
_CHUNK = 64
#: Chunks that the chain's fit looks at together, and texts whose words a task counts together.
_BLOCK, _TEXTS = 1024, 128
_CACHE = 300_000
_token = re.compile(r"\w+")


@dataclass
class ToxicityModel:
    """Evidence level by word and word prefix, the chain's weights, and the document calibration."""

    words: dict[str, int] = field(default_factory=dict)
    prefixes: dict[str, int] = field(default_factory=dict)
    emission: np.ndarray = field(default_factory=lambda: np.full(_LEVELS, -12.0))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def level(self, word: str) -> int:
        """0 for no evidence, up to the strongest of the word and its prefixes."""
        best = self.words.get(word, 0)
        for n in _PREFIXES:
            if n <= len(word):
                best = max(best, self.prefixes.get(word[:n], 0))
        return best


def _features(word: str) -> list[str]:
    return [word[:n] for n in _PREFIXES if n <= len(word)]


def _level_of(toxic: int, clean: int, n_toxic: int, n_clean: int) -> int:
    """Quantised log-odds of finding the feature in toxic against other documents."""
    if toxic < _MIN_DOCS:
        return 0
    odds = math.log((toxic + 0.1) / (n_toxic + 0.2)) - math.log((clean + 0.5) / (n_clean + 1.0))
    shrunk = odds * toxic / (toxic + 2.0)
    return int(min(_LEVELS - 1, max(0.0, shrunk - 1.0)))


def fit_toxicity(sample: DataFrame, id_col: str = "doc_id") -> ToxicityModel:
    """Fit on a sample with an id, a text `__t` and a label `__y`; it is read three times, so store it.

    Labels are by document, so tokens get theirs from a distance: document frequencies grade words and
    prefixes, and in a toxic document the tokens of its strongest grade are the toxic ones, if the grade is
    over 1; all other tokens are clean. The chain is fitted on these tokens, whole texts in chunks.

    Texts are read and words counted in tasks. The driver gets the graded words and a byte a token.
    """
    model = ToxicityModel()
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("__y"), F.lit(0))).first()
    n_clean = n - n_toxic
    if not n_toxic or not n_clean:
        return model
    # Looser than `_level_of`, which grades what is left: a grade needs shrunk log-odds of 2.
    odds = F.log((F.col("toxic") + 0.1) / (n_toxic + 0.2)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    counted = _document_counts(sample).groupBy("prefix", "feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    graded = counted.filter((F.col("toxic") >= _MIN_DOCS) & (odds * F.col("toxic") / (F.col("toxic") + 2.0) > 1.9))
    for r in graded.collect():
        level = _level_of(r["toxic"], r["clean"], n_toxic, n_clean)
        if level:
            (model.prefixes if r["prefix"] else model.words)[r["feature"]] = level
    rows = sorted(_token_levels(sample, model, id_col).collect(), key=lambda r: r[id_col])
    labels = np.array([r["__y"] for r in rows], dtype=np.int8)
    levels = [np.frombuffer(r["__levels"], dtype=np.int8) for r in rows]
    marks = []
    for own, y in zip(levels, labels.tolist(), strict=True):
        top = int(own.max()) if y and own.size else 0
        marks.append(((own == top) & (top > 1)).astype(np.int8))
    _fit_chain(model, levels, marks)
    _fit_documents(model, levels, labels)
    return model


def _document_counts(sample: DataFrame) -> DataFrame:
    """Rows (prefix, feature, toxic, clean): how many toxic and other texts of a part hold a word, or a prefix of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS):
                batch = whole.slice(at, _TEXTS)
                counts = (Counter(), Counter())
                for raw, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                    kinds = set(_token.findall(raw.decode("utf-8", "replace").lower()))
                    counts[y].update((False, w) for w in kinds)
                    counts[y].update((True, f) for f in {f for w in kinds for f in _features(w)})
                found = [*(counts[0] | counts[1])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for k, _ in found], pa.bool_()), pa.array([f for _, f in found], pa.string()),
                    pa.array([counts[1][f] for f in found], pa.int64()), pa.array([counts[0][f] for f in found], pa.int64()),
                ], names=["prefix", "feature", "toxic", "clean"])

    return sample.select("__t", "__y").mapInArrow(run, "prefix boolean, feature string, toxic long, clean long")


def _token_levels(sample: DataFrame, model: ToxicityModel, id_col: str) -> DataFrame:
    """The sample's ids and labels with `__levels`: the evidence level of each token of the text, a byte each."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def start():
        level = shared.value.level

        def compute(texts: list[bytes]) -> list[pa.Array]:
            own = (_token.findall(raw.decode("utf-8", "replace").lower()) for raw in texts)
            return [pa.array([bytes(map(level, words)) for words in own], pa.binary())]

        return compute

    return with_text_columns(sample, "__t", [T.StructField("__levels", T.BinaryType())], start, keep=[id_col, "__y"])


def _chunks(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pieces = [p[i:i + _CHUNK] for p in parts for i in range(0, len(p), _CHUNK)]
    out = np.zeros((len(pieces), _CHUNK), dtype=np.int8)
    mask = np.zeros((len(pieces), _CHUNK), dtype=bool)
    for k, p in enumerate(pieces):
        out[k, :len(p)] = p
        mask[k, :len(p)] = True
    return out, mask


def _fit_chain(model: ToxicityModel, levels: list[np.ndarray], marks: list[np.ndarray], rounds: int = 40) -> None:
    """Maximum likelihood with a small ridge, by gradient steps with per-weight scaling."""
    x, mask = _chunks(levels)
    y, _ = _chunks(marks)
    # Chunks without any evidence are alike but for their length: keep each length once, with its count.
    plain = ~x.any(axis=1) & ~y.any(axis=1)
    lengths, counts = np.unique(mask[plain].sum(axis=1), return_counts=True)
    x = np.concatenate([x[~plain], np.zeros((len(lengths), _CHUNK), np.int8)])
    y = np.concatenate([y[~plain], np.zeros((len(lengths), _CHUNK), np.int8)])
    mask = np.concatenate([mask[~plain], np.arange(_CHUNK)[None, :] < lengths[:, None]])
    weight = np.concatenate([np.ones(int((~plain).sum())), counts.astype(float)])
    w = np.concatenate([np.linspace(-6, 3, _LEVELS), np.zeros(4)])
    first, second = np.zeros_like(w), np.zeros_like(w)
    n = float((mask.sum(axis=1) * weight).sum())
    seen = np.zeros_like(w)
    real = mask & (y == 1)
    for k in range(_LEVELS):
        seen[k] = weight @ (real & (x == k)).sum(axis=1)
    both = mask[:, 1:] & mask[:, :-1]
    for a in (0, 1):
        for b in (0, 1):
            seen[_LEVELS + 2 * a + b] = weight @ (both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum(axis=1)
    for step in range(1, rounds + 1):
        expected = np.zeros_like(w)
        for i in range(0, len(x), _BLOCK):
            expected += _expected(w, x[i:i + _BLOCK], mask[i:i + _BLOCK], weight[i:i + _BLOCK])
        ridge = np.concatenate([0.5 * w[:_LEVELS], 5.0 * w[_LEVELS:]])
        grad = (seen - expected - ridge) / n
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        w += 0.3 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
    model.emission, model.transition = w[:_LEVELS], w[_LEVELS:].reshape(2, 2)


def _expected(w: np.ndarray, x: np.ndarray, mask: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What the chain with weights `w` expects of toxic tokens by level and of pairs of states, over some chunks."""
    e = np.zeros((*x.shape, 2))
    e[..., 1] = w[:_LEVELS][x]
    e[~mask] = 0.0
    e = np.exp(e)
    t = np.exp(w[_LEVELS:].reshape(2, 2))
    fwd, back = np.zeros_like(e), np.ones_like(e)
    fwd[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, _CHUNK):
        z = (fwd[:, i - 1] @ t) * e[:, i]
        z /= z.sum(axis=1, keepdims=True)
        fwd[:, i] = np.where(mask[:, i, None], z, fwd[:, i - 1])
    for i in range(_CHUNK - 2, -1, -1):
        z = (e[:, i + 1] * back[:, i + 1]) @ t.T
        z /= z.sum(axis=1, keepdims=True)
        back[:, i] = np.where(mask[:, i + 1, None], z, 1.0)
    p = fwd * back
    p /= p.sum(axis=2, keepdims=True)
    expected = np.zeros_like(w)
    on = weight[:, None] * p[..., 1] * mask
    for k in range(_LEVELS):
        expected[k] = on[x == k].sum()
    both = mask[:, 1:] & mask[:, :-1]
    pair = fwd[:, :-1, :, None] * t[None, None] * (e[:, 1:] * back[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    expected[_LEVELS:] = (pair * (weight[:, None] * both)[:, :, None, None]).sum(axis=(0, 1)).reshape(-1)
    return expected


def marginals(model: ToxicityModel, at: list[int], levels: list[int], n: int) -> list[float]:
    """Probability of the toxic state at each token with evidence (positions `at`) in a text of n tokens.

    Tokens without evidence all have the same weights, so a run of them is a power of one 2 by 2 matrix.
    """
    t = np.exp(model.transition)
    plain = t * np.exp(np.array([0.0, model.emission[0]]))[None, :]
    values, vectors = np.linalg.eig(plain)
    inverse = np.linalg.inv(vectors)
    values = values / np.abs(values).max()

    def run(k: int) -> np.ndarray:
        return ((vectors * values ** k) @ inverse).real

    start = np.exp(np.array([0.0, model.emission[0]]))
    fwd, state, last = [], None, -1
    for pos, level in zip(at, levels, strict=True):
        e = np.exp(np.array([0.0, model.emission[level]]))
        gap = pos - last - 1
        if state is None:
            state = e if gap == 0 else ((start @ run(gap - 1)) @ t) * e
        else:
            state = ((state @ run(gap)) @ t) * e
        state = state / state.sum()
        fwd.append(state)
        last = pos
    back, after = run(n - 1 - last) @ np.ones(2), []
    for k in range(len(at) - 1, -1, -1):
        after.append(back / back.sum())
        if k:
            e = np.exp(np.array([0.0, model.emission[levels[k]]]))
            back = run(at[k] - at[k - 1] - 1) @ (t @ (e * back))
            back = back / back.sum()
    out = []
    for f, b in zip(fwd, reversed(after), strict=True):
        p = f * b
        out.append(float(p[1] / p.sum()))
    return out


def _summary(ps: list[float]) -> tuple[float, float]:
    """Log-odds of at least one toxic token, and the log of the expected number of them."""
    none = sum(math.log(max(1e-12, 1.0 - p)) for p in ps)
    some = max(1e-9, 1.0 - math.exp(none))
    return min(12.0, max(-12.0, math.log(some) - none)), math.log1p(sum(ps))


def _fit_documents(model: ToxicityModel, levels: list[np.ndarray], labels: np.ndarray) -> None:
    """Logistic regression of the label on the two summaries, by Newton steps with a ridge."""
    rows = []
    for own in levels:
        at = np.flatnonzero(own)
        ps = marginals(model, at.tolist(), own[at].tolist(), len(own)) if at.size else []
        rows.append((1.0, *_summary(ps)))
    x, y, w = np.array(rows), labels.astype(float), np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * 0.01 + 1e-9 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * len(y) * 0.01 @ w)
    model.document = (float(w[0]), float(w[1]), float(w[2]))


def document_score(model: ToxicityModel, ps: list[float]) -> float:
    a, b, c = model.document
    u, v = _summary(ps)
    return 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, a + b * u + c * v))))


def held_out(id_col: str = "doc_id") -> Column:
    """A third of the ids, by crc32 of the id as text; NULL reads as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def training_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES,
) -> DataFrame:
    """At most `rows` labelled, not held-out texts (`__t`, with `__y`) of at most `size` bytes together, by order of a hash of the id.

    An id that repeats gives one text, that with the smallest hash. The driver looks at ids, hashes and
    lengths only; no text comes to it.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(
        F.max(label).cast("int").alias("__y"))
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(id_col, F.struct(F.xxhash64(body).alias("__h"), F.octet_length(body).alias("__n")).alias("__own"))
    one = sized.groupBy(id_col).agg(F.min("__own").alias("__own")).select(id_col, "__own.*")
    first = one.join(known, id_col).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(rows).collect()
    left, wanted = size, []
    for r in first:
        if r["__n"] <= left:
            left -= r["__n"]
            wanted.append((r[id_col], r["__h"], r["__y"]))
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = F.broadcast(spark.createDataFrame(wanted, f"`{id_col}` {kind}, __h long, __y int"))  # at most `rows` rows
    found = docs.select(id_col, body.alias("__t"), F.xxhash64(body).alias("__h")).join(chosen, [id_col, "__h"])
    return found.repartition(SAMPLE_PARTS, id_col).groupBy(id_col).agg(F.min("__t").alias("__t"), F.first("__y").alias("__y"))


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES,
) -> list[tuple[str, int]]:
    """The texts and labels of the training sample, in order of their ids; to look at: the fit leaves texts in tasks."""
    found = training_sample(docs, labels, id_col, text, label, rows, size).collect()
    return [(r["__t"], r["__y"]) for r in sorted(found, key=lambda r: r[id_col])]


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with `score` (0 to 1), `predicted` (1 from the threshold on) and `toxic_spans`.

    Spans are character ranges [from, to) of the tokens whose toxic state has a marginal over one half. NULL
    and empty texts have no evidence and get the score of such texts. Input columns named like a result are
    replaced. Only the text is looked at; no row is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own, cache = shared.value, {}

        def level(word: str) -> int:
            if len(cache) >= _CACHE:
                cache.clear()
            found = cache[word] = own.level(word)
            return found

        empty = document_score(own, [])

        def compute(texts: list[bytes]) -> list[pa.Array]:
            scores, spans = [], []
            for raw in texts:
                body = raw.decode("utf-8", "replace")
                lower = body.lower()
                words = _token.findall(lower)
                get = cache.get
                levels = [g if (g := get(w)) is not None else level(w) for w in words]
                at = [i for i, g in enumerate(levels) if g] if any(levels) else []
                if not at:
                    scores.append(empty)
                    spans.append([])
                    continue
                ps = marginals(own, at, [levels[i] for i in at], len(words))
                scores.append(document_score(own, ps))
                flagged = {i for i, p in zip(at, ps, strict=True) if p > 0.5}
                # Lower-casing may change the number of characters; offsets are then those of the lower-cased text.
                spans.append([[*m.span()] for i, m in enumerate(_token.finditer(lower)) if i in flagged] if flagged else [])
            return [
                pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                pa.array(spans, pa.list_(pa.list_(pa.int64())))]

        return compute

    fields = [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("toxic_spans", T.ArrayType(T.ArrayType(T.LongType())))]
    return with_text_columns(docs, text, fields, start, keep)


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    return fit_toxicity(stored(training_sample(docs, labels, id_col, text, label)), id_col)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with their own columns, that the model does not call toxic."""
    model = train_toxicity(docs, labels, id_col, text)
    scored = score_toxicity(docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__body")), model, "__body", keep=["__row"])
    return scored.filter("predicted = 0").select("__row.*")
