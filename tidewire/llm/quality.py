"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its potentials come from binned features of the line and of the lines
before and after it (character classes, length, words, repetition), and from the label of its
neighbour. Forward-backward gives each line's probability of being good; their mean, weighted by
line length, is turned into a document score by a logistic curve fitted on the training documents.

Only documents carry labels, so training alternates: lines of good documents are good, lines of bad
documents are bad where the current field finds them worse than the lines of good documents, and
at least the worst one is. The field is fitted on a bounded sample: ``max_docs`` labelled rows,
chosen by hash, and of a text with more than ``max_lines`` lines that many, in stretches of
``STRETCH`` spread evenly from its first line to its last. Scoring is one map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import as_bytes, col, free_name

FEATURES = 12
BINS = 8
#: Consecutive lines that are kept together where a long text is sampled.
STRETCH = 25

_LETTER, _UPPER, _DIGIT, _STOP, _SPACE, _SYMBOL = range(6)


def _classes() -> np.ndarray:
    """The character class of every byte; bytes beyond ASCII count as letters."""
    out = np.full(256, _SYMBOL, np.uint8)
    out[128:] = _LETTER
    for b in range(128):
        c = chr(b)
        if c.isupper():
            out[b] = _UPPER
        elif c.isalpha():
            out[b] = _LETTER
        elif c.isdigit():
            out[b] = _DIGIT
        elif c in ".,;:'\"()-?":
            out[b] = _STOP
        elif c.isspace():
            out[b] = _SPACE
    return out


CLASS = _classes()


def line_features(text: bytes, lines: list[bytes]) -> np.ndarray:
    """One row of FEATURES numbers per line."""
    n = len(lines)
    sizes = np.fromiter(map(len, lines), np.int64, n)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    kinds = CLASS[np.frombuffer(text, np.uint8)]
    counts = np.zeros((n, 6))
    for k in range(6):
        upto = np.concatenate([[0], np.cumsum(kinds == k)])
        counts[:, k] = upto[starts + sizes] - upto[starts]
    words = [x.split() for x in lines]
    n_words = np.fromiter(map(len, words), np.int64, n)
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, n)
    repeated = np.fromiter((sum(map(bytes.__eq__, w, w[1:])) for w in words), np.int64, n)
    seen: set[bytes] = set()
    again = np.zeros(n)
    for i, x in enumerate(lines):
        again[i] = x in seen
        seen.add(x)
    long = np.maximum(sizes, 1)
    letters = counts[:, _LETTER] + counts[:, _UPPER]
    some = np.maximum(n_words, 1)
    return np.stack(
        [
            np.log1p(sizes),
            letters / long,
            counts[:, _UPPER] / np.maximum(letters, 1),
            counts[:, _DIGIT] / long,
            counts[:, _STOP] / long,
            counts[:, _SYMBOL] / long,
            counts[:, _SPACE] / long,
            np.log1p(n_words),
            letters / some,
            distinct / some,
            repeated / some,
            again,
        ],
        1,
    ).astype(np.float32)


def split_lines(text: bytes) -> list[bytes]:
    return text.split(b"\n")


@dataclass(frozen=True, eq=False)
class Model:
    """Bin edges, emission weights (own, before, after), transitions, calibration."""

    edges: np.ndarray  # FEATURES x (BINS - 1)
    weights: np.ndarray  # 3 x FEATURES x BINS, log-odds of good
    transition: np.ndarray  # 2 x 2
    slope: float
    offset: float


def binned(features: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack(
        [np.searchsorted(edges[k], features[:, k], "right") for k in range(FEATURES)], 1
    ).astype(np.int64)


def _shifted(bins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the lines before and after; -1 beyond the ends of a document."""
    before = np.full_like(bins, -1)
    after = np.full_like(bins, -1)
    if len(bins):
        before[1:], after[:-1] = bins[:-1], bins[1:]
        ends = np.cumsum(sizes)
        before[ends - sizes] = -1
        after[ends - 1] = -1
    return before, after


def emissions(bins: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-odds of good per line, without its neighbours' labels."""
    out = np.zeros(len(bins))
    for w, b in zip(weights, (bins, *_shifted(bins, sizes))):
        padded = np.concatenate([w, np.zeros((FEATURES, 1))], 1)
        for k in range(FEATURES):
            out += padded[k, b[:, k]]
    return out


def forward_backward(
    odds: np.ndarray, sizes: np.ndarray, transition: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of good per line, pair marginals per line and its predecessor, log normalisers.

    Documents advance side by side, longest first, one line per step.
    """
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    long = sizes[order]
    steps = int(long[0]) if len(long) else 0
    open_ = np.searchsorted(-long, -np.arange(steps), "left") if steps else []
    emit = np.stack([np.zeros(len(odds)), odds], 1)
    alpha = np.zeros((len(odds), 2))
    beta = np.zeros((len(odds), 2))
    for t in range(steps):
        at = first[: open_[t]] + t
        if t:
            a = alpha[at - 1]
            alpha[at] = emit[at] + np.logaddexp(
                a[:, :1] + transition[0], a[:, 1:] + transition[1]
            )
        else:
            alpha[at] = emit[at]
    for t in range(steps - 1, 0, -1):
        at = first[: open_[t]] + t
        b = beta[at] + emit[at]
        beta[at - 1] = np.logaddexp(
            b[:, :1] + transition[:, 0], b[:, 1:] + transition[:, 1]
        )
    norm = np.zeros(len(sizes))
    full = long > 0
    tops = first[full] + long[full] - 1
    norm[order[full]] = np.logaddexp(alpha[tops, 0], alpha[tops, 1])
    each = np.repeat(norm, sizes)
    good = np.exp(alpha[:, 1] + beta[:, 1] - each)
    pairs = np.zeros((len(odds), 2, 2))
    inner = np.ones(len(odds), bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    at = np.flatnonzero(inner)
    if len(at):
        pairs[at] = np.exp(
            alpha[at - 1][:, :, None]
            + transition[None]
            + (emit[at] + beta[at])[:, None, :]
            - each[at][:, None, None]
        )
    return good, pairs, norm


def _fit_field(bins, sizes, labels, weights, transition, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the penalised likelihood of the line labels."""
    shapes = (bins, *_shifted(bins, sizes))
    n = max(len(bins), 1)
    flat = np.concatenate([weights.ravel(), transition.ravel()])
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    inner = np.ones(len(bins), bool)
    inner[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    for step in range(1, rounds + 1):
        w = flat[:-4].reshape(weights.shape)
        t = flat[-4:].reshape(2, 2)
        good, pairs, _ = forward_backward(emissions(bins, sizes, w), sizes, t)
        wrong = good - labels
        grad = np.zeros_like(weights)
        for j, b in enumerate(shapes):
            for k in range(FEATURES):
                grad[j, k] = np.bincount(b[:, k] + 1, wrong, BINS + 1)[1:]
        g = np.concatenate([grad.ravel(), (pairs.sum(0) - seen).ravel()]) / n + 1e-4 * flat
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        flat = flat - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return flat[:-4].reshape(weights.shape), flat[-4:].reshape(2, 2)


def _weighted(good: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean of the marginals of each document, weighted by line length (at least one each)."""
    w = lengths + 1.0
    upto = np.concatenate([[0], np.cumsum(good * w)])
    mass = np.concatenate([[0], np.cumsum(w)])
    ends = np.cumsum(sizes)
    return (upto[ends] - upto[ends - sizes]) / np.maximum(mass[ends] - mass[ends - sizes], 1.0)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 5.0 / (np.abs(d).max() + 1e-9))
        a, b = a - d[0], b - d[1]
    return float(a), float(b)


def fit(features: list[np.ndarray], labels: np.ndarray, rounds: int = 60, passes: int = 3) -> Model:
    """The field and its calibration from line features and labels of documents."""
    flat = np.concatenate(features) if features else np.zeros((0, FEATURES), np.float32)
    edges = np.zeros((FEATURES, BINS - 1), np.float32)
    weights, transition = np.zeros((3, FEATURES, BINS)), np.zeros((2, 2))
    share = float(labels.mean()) if len(labels) else 1.0
    if len(set(labels.tolist())) < 2:
        return Model(edges, weights, transition, 0.0, 6.0 if share >= 0.5 else -6.0)
    for k in range(FEATURES):
        edges[k] = np.quantile(np.unique(flat[:, k]), np.arange(1, BINS) / BINS)
    bins = binned(flat, edges)
    sizes = np.array([len(f) for f in features])
    each = np.repeat(labels, sizes)
    lengths = np.expm1(flat[:, 0].astype(np.float64))
    lines = each.copy()
    for _ in range(passes):
        weights, transition = _fit_field(bins, sizes, lines, weights, transition, rounds)
        good, _, _ = forward_backward(emissions(bins, sizes, weights), sizes, transition)
        bar = np.quantile(good[each == 1], 0.1)
        lines = np.where((each == 0) & (good < min(bar, 0.9)), 0, 1)
        starts = np.cumsum(sizes) - sizes
        for d in np.flatnonzero(labels == 0):
            own = slice(starts[d], starts[d] + sizes[d])
            lines[own][good[own].argmin()] = 0
    weights, transition = _fit_field(bins, sizes, lines, weights, transition, rounds)
    good, _, _ = forward_backward(emissions(bins, sizes, weights), sizes, transition)
    slope, offset = _calibrate(_weighted(good, lengths, sizes), labels)
    return Model(edges, weights, transition, slope, offset)


def spread_lines(n: int, max_lines: int) -> np.ndarray:
    """Numbers of at most ``max_lines`` of ``n`` lines: all, or stretches over the whole text."""
    if n <= max_lines:
        return np.arange(n)
    length = min(STRETCH, max_lines)
    starts = np.linspace(0, n - length, max_lines // length).astype(np.int64)
    return np.unique(starts[:, None] + np.arange(length))


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    label: str = "quality",
    max_docs: int = 3000,
    max_lines: int = 500,
) -> Model:
    """A model from at most ``max_docs`` labelled rows, the smallest by hash of their id.

    Rows with a null label or id, and labels without a document, teach nothing; a null text is an
    empty one. With labels of one kind only, or none, the model gives a constant score.
    """
    marked = labels.select(
        col(labels, label_id).alias("picked"), col(labels, label).cast("int").alias("label")
    ).where("picked IS NOT NULL AND label IN (0, 1)")
    picks = marked.orderBy(F.xxhash64("picked"), "picked", "label").limit(max_docs)
    # At most max_docs ids, so broadcasting them is safe.
    rows = docs.select(col(docs, doc_id).alias("id"), col(docs, text).cast("string").alias("text"))
    chosen = rows.join(F.broadcast(picks), F.col("id") == F.col("picked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for t in as_bytes(b.column(1)):
                lines = split_lines(t or b"")
                features = line_features(t or b"", lines)
                made.append(features[spread_lines(len(lines), max_lines)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(made, pa.binary())], names=["id", "label", "features"]
            )

    id_type = rows.schema["id"].dataType.simpleString()
    found = chosen.select("id", "text", "label").mapInArrow(run, f"id {id_type}, label int, features binary")
    # Repeated rows of one id could exceed the bound; it holds for rows, too.
    held = found.orderBy(F.xxhash64("id"), "features").limit(max_docs).collect()
    features = [np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES) for r in held]
    return fit(features, np.array([r["label"] for r in held], np.int64))


def score_texts(texts: list[bytes], model: Model) -> tuple[list[float], list[list[float]]]:
    """Document scores and the marginals of their lines."""
    split = [split_lines(t) for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    if not len(sizes):
        return [], []
    flat = np.concatenate([line_features(t, x) for t, x in zip(texts, split)])
    odds = emissions(binned(flat, model.edges), sizes, model.weights)
    good, _, _ = forward_backward(odds, sizes, model.transition)
    mean = _weighted(good, np.expm1(flat[:, 0].astype(np.float64)), sizes)
    score = 1 / (1 + np.exp(-np.clip(model.slope * mean + model.offset, -30, 30)))
    ends = np.cumsum(sizes)
    return score.tolist(), [good[e - n : e].tolist() for e, n in zip(ends, sizes)]


def _slices(texts: list[bytes], size: int = 4_000_000) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    n = 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """All columns of ``docs`` and a struct ``score, lines`` (the marginal of good per line).

    The second result is the struct's name. A null text is scored as an empty one, which has a
    single empty line. Repeated rows get equal scores. Only the text enters a score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = free_name(docs.columns, "quality")

    @F.arrow_udf("score double, lines array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores, lines = [], []
            for s in _slices([t or b"" for t in as_bytes(texts)]):
                a, b = score_texts(s, sent.value)
                scores += a
                lines += b
            yield pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), pa.array(lines, pa.list_(pa.float64()))],
                names=["score", "lines"],
            )

    body: Column = col(docs, text).cast("string")
    return docs.withColumn(name, of(body)), name
