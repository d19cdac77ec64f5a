"""Quality classifier by co-training.

Two views of a document that share nothing: its words (hashed words and word shapes as shares of all, repetition, length of
words) and its metadata (language, source, sizes in characters, bytes and lines).  Each view has a logistic model.  Over
ROUNDS rounds each model labels the unlabelled documents it is confident of, and hands them to the other one, with the label
of the first round in which it was confident.  Of each kind it is confident of its most certain documents: each round
SHARE more of as many as the kind has in the pool by its share of the labelled rows, and none below a score beyond which more
than 1 - CONFIDENT of the labelled rows held back from fitting are of the other kind.  Both are shares, so they hold alike at
every size.  All unlabelled documents are the pool: a round counts the pool's scores in a fixed number of bins, then takes
steps down a quadratic bound of the loss, with gradients and curvatures summed over the whole pool, kind by kind.  Of each
kind what was handed weighs as much as its labelled rows at most, and less by the errors, on rows held back, of the view that
hands it against those of the view that gets it; a label that the latter is sure to be wrong teaches nothing.  On the rows
held back each view's log-odds are calibrated and the two are combined by logistic regression.  The combined score covers all documents; those with a score of
at least KEEP stay.

Only labelled rows are bounded: of rows with a label the LABELLED with the least hash of doc_id and content are gathered as
feature vectors of some 250 numbers, and those beyond are scored but neither fitted nor handed.  Vectors of all documents are
checkpointed once, half-precision numbers of 470 bytes each.  Memory is linear in a single text.

Cases: null text, language or source count as empty; an empty text has features of its own kind (no words); a doc_id
with several labels has their least, and several rows of a labelled doc_id are labelled rows each; null labels are ignored;
with labels of one kind only, or none, every document has that kind's share as its score (1 if there are none), so that
nothing goes unjudged; repeated rows have equal scores; an empty table gives no rows; other columns are kept by
filter_documents and ignored by score.
"""

from __future__ import annotations

import math
import sys
import types
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ship, slices, text_or_empty
from .shingles import _powers, mix

LABELLED, ROUNDS, STEPS = 6000, 3, 2
CONFIDENT, SHARE, PRIOR = 0.99, 0.15, 10
KEEP = 0.5
#: Log-odds are within LIMIT to either side; bins in which the pool's are counted.
LIMIT, BINS = 30.0, 2400
KNOTS = (0.1, 0.3, 0.5, 0.7, 0.9, 0.97)
#: Bins of hashed word shapes, words, languages and sources; numbers before them in either view.
SHAPES, WORDS, LANG_BINS, SOURCE_BINS = 128, 96, 16, 32
N_WORDS, N_SIZES = 5, 5
N_TEXT = N_WORDS + SHAPES + WORDS
SCORED = "doc_id long, score double, text_score double, metadata_score double, keep boolean"
VECTORS = "doc_id long, tid long, x binary"
#: Slices of a batch hold so many bytes: each sign of a text takes some 80 bytes while its words are hashed.
SLICE = 1 << 20

_cache = sys.modules.setdefault("_quality_tables", types.ModuleType("_quality_tables")).__dict__


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is white space, and its class in a word's shape: lower 1, upper 2, digit 3, other
    letter 4, any other sign for itself."""
    if "classes" not in _cache:
        signs = [chr(i) for i in range(0x110000)]
        kinds = [1 if c.islower() else 2 if c.isupper() else 3 if c.isnumeric() else 4 if c.isalpha() else 16 + i for i, c in enumerate(signs)]
        _cache["classes"] = np.array([c.isspace() for c in signs]), np.array(kinds, np.uint64)
    return _cache["classes"]


def _hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the stretches first..last of values."""
    up, down = _powers(len(values) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((values + np.uint64(1)) * up[: len(values)])))
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def text_view(texts: list[str]) -> np.ndarray:
    """A row of N_TEXT numbers for each text: whether it has no words, distinct words (as share and by logarithms), words
    that repeat the one before, log of the mean length; then roots of the shares of shapes and of words in their bins.

    Words are runs without white space.  A shape is a word with each run of signs of one class written once.
    """
    space, kinds = _classes()
    points = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    inside = np.concatenate(([False], ~space[points], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    n = len(texts)
    out = np.zeros((n, N_TEXT))
    out[:, 0] = 1
    if not len(first):
        return out
    doc = np.searchsorted(starts, first, side="right") - 1
    word = _hashes(points.astype(np.uint64), first, last)
    kind = kinds[points]
    new = np.concatenate(([True], kind[1:] != kind[:-1]))
    new[first] = True
    new &= inside[1:-1]
    place = np.cumsum(new) - 1
    ends = np.append(place[first][1:], int(new.sum()))
    shape = _hashes(kind[new], place[first], ends)
    count = np.bincount(doc, minlength=n).astype(float)
    some = count > 0
    total = np.maximum(count, 1)
    ranked = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (word >> np.uint64(20)))
    distinct = np.bincount((ranked[np.concatenate(([True], ranked[1:] != ranked[:-1]))] >> np.uint64(44)).astype(np.int64), minlength=n)
    again = np.bincount(doc[1:], weights=(word[1:] == word[:-1]) & (doc[1:] == doc[:-1]), minlength=n)
    out[:, 0] = ~some
    out[:, 1] = distinct / total
    out[:, 2] = np.where(some, np.log(distinct + 1) / np.log(total + 1), 0)
    out[:, 3] = again / total
    out[:, 4] = np.log1p(np.bincount(doc, weights=last - first, minlength=n) / total)
    for values, bins, at in ((shape, SHAPES, N_WORDS), (word, WORDS, N_WORDS + SHAPES)):
        found = np.bincount(doc * bins + (values % np.uint64(bins)).astype(np.int64), minlength=n * bins).reshape(n, bins)
        out[:, at : at + bins] = np.sqrt(found / total[:, None])
    return out


def sizes(text: str) -> list[float]:
    chars, size, lines = len(text), len(text.encode("utf-8", "surrogatepass")), text.count("\n") + 1
    return [math.log1p(chars), math.log1p(size), size / max(chars, 1), math.log1p(lines), math.log1p(chars / lines)]


def packed(texts: list[str], langs: list[str], sources: list[str]) -> list[bytes]:
    """Each document's text view and sizes in half precision, then its bins of language and source."""
    numbers = np.concatenate([text_view(texts), np.array([sizes(t) for t in texts]).reshape(-1, N_SIZES)], axis=1).astype("<f2")
    return [row.tobytes() + bytes((zlib.crc32(a.encode()) % LANG_BINS, zlib.crc32(s.encode()) % SOURCE_BINS)) for row, a, s in zip(numbers, langs, sources, strict=True)]


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Rows of N_TEXT numbers, N_SIZES numbers, and a column for each bin of language and source."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 2 * (N_TEXT + N_SIZES) + 2)
    numbers = np.ascontiguousarray(raw[:, :-2]).view("<f2").astype(float)
    bins = np.zeros((len(rows), LANG_BINS + SOURCE_BINS))
    bins[np.arange(len(rows)), raw[:, -2]] = 1
    bins[np.arange(len(rows)), LANG_BINS + raw[:, -1].astype(int)] = 1
    return np.concatenate([numbers, bins], axis=1)


@dataclass
class View:
    """A logistic model over standardised columns; the first ``dense`` of them have hinges at quantiles besides."""

    columns: slice
    dense: int
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def expand(self, x: np.ndarray) -> np.ndarray:
        """The model's columns of rows, a constant first."""
        own = x[:, self.columns]
        d = own[:, : self.dense]
        hinges = np.maximum(d[:, :, None] - self.knots[None], 0).reshape(len(x), self.dense * len(KNOTS))
        full = np.concatenate([own, hinges], axis=1)
        return np.concatenate([np.ones((len(x), 1)), np.clip((full - self.mean) / self.scale, -8, 8)], axis=1)

    def prepare(self, x: np.ndarray) -> View:
        self.knots = np.quantile(x[:, self.columns][:, : self.dense], KNOTS, axis=0).T.reshape(self.dense, len(KNOTS))
        self.mean, self.scale = np.zeros(1), np.full(1, 1e9)  # nothing is clipped
        full = self.expand(x)[:, 1:] * 1e9
        self.mean, self.scale = full.mean(0), np.maximum(full.std(0), 0.02)
        return self

    def logit(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.clip(self.expand(x) @ (self.weights if weights is None else weights), -LIMIT, LIMIT)


def _curve(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def parts(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the logistic loss of rows x (a constant among their columns) with labels y, and the curvature of the
    closest quadratic that bounds the loss from above and touches it at w: a step to its least never raises the loss."""
    z = np.maximum(np.abs(x @ w), 1e-6)
    return x.T @ (_curve(x @ w) - y), (x.T * (np.tanh(z / 2) / (2 * z))) @ x


def step(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """w after a step to the bound's least, with a ridge on all but the first weight."""
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    return w - np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * w)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Weights of rows x, whose first column is a constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        new = step(w, *parts(x, y, w))
        done = np.abs(new - w).max() < 1e-5
        w = new
        if done:
            break
    return w


@dataclass
class Model:
    constant: float | None = None
    text: View | None = None
    metadata: View | None = None
    text_scale: np.ndarray = field(default_factory=lambda: np.zeros(2))
    metadata_scale: np.ndarray = field(default_factory=lambda: np.zeros(2))
    join: np.ndarray = field(default_factory=lambda: np.zeros(3))
    #: For each round, how many documents of the kinds 0 and 1 the text model and then the metadata model had been handed.
    handed: tuple = ()

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text and metadata scores."""
        if self.constant is not None:
            return (np.full(len(x), self.constant),) * 3
        a = self.text_scale[0] + self.text_scale[1] * self.text.logit(x)
        b = self.metadata_scale[0] + self.metadata_scale[1] * self.metadata.logit(x)
        return _curve(self.join[0] + self.join[1] * a + self.join[2] * b), _curve(a), _curve(b)


@dataclass
class Past:
    """A view's weights at the start of a round, and how far below and above 0 its log-odds are where it is confident of the
    kinds 0 and 1."""

    weights: np.ndarray
    least: tuple[float, float]
    #: The same by the rows held back alone, whatever the share.
    sure: tuple[float, float]
    #: The share of wrong labels among rows held back that it is confident of, by kind, drawn to that of all rows that it
    #: takes to be of the kind as PRIOR rows would.
    errors: tuple[float, float]


def binned(z: np.ndarray) -> np.ndarray:
    """How many log-odds lie in each of BINS bins."""
    return np.bincount(np.clip(((z + LIMIT) * (BINS / (2 * LIMIT))).astype(int), 0, BINS - 1), minlength=BINS).astype(float)


def confident(z: np.ndarray, y: np.ndarray, counts: np.ndarray, share: float) -> list[tuple[float, float]]:
    """``least``, ``sure`` and ``errors`` of Past; z: the log-odds of rows held back, y: their
    labels, counts: binned() of the pool, share: of each kind's number there, by the labels."""
    out = []
    for kind, sign in ((0, -1), (1, 1)):
        edges = np.arange(BINS) * (2 * LIMIT / BINS) - LIMIT
        beyond = np.cumsum(counts[::-sign])[::-1]  # of a bin and those that are more certain
        within = np.flatnonzero(beyond <= share * beyond[0] * np.mean(y == kind))
        least = edges[within[0]] if len(within) else math.inf
        order = np.argsort(-sign * z, kind="stable")
        score, right = sign * z[order], y[order] == kind
        last = np.append(score[1:] != score[:-1], True)  # equal scores go together
        good = np.flatnonzero(last & (np.cumsum(right) >= CONFIDENT * np.arange(1, len(order) + 1)))
        sure = score[good[-1]] if len(good) else np.nextafter(score[0], math.inf)
        sure = max(sure, np.nextafter(0, 1))
        beyond = right[score >= max(least, sure)]
        out.append((float(max(least, sure)), float(sure), (np.count_nonzero(~beyond) + PRIOR * error(right[score > 0])) / (len(beyond) + PRIOR)))
    return list(zip(*out, strict=True))


def error(right: np.ndarray) -> float:
    """The share of wrong ones, as (wrong + 1) / (rows + 2)."""
    return (np.count_nonzero(~right) + 1) / (len(right) + 2)


def given(view: View, past: list[Past], x: np.ndarray) -> np.ndarray:
    """The label that a view hands over with each row: that of its first weights that were confident of it, else NaN.  A row
    of which the view that gets it is sure to be of the other kind teaches nothing: refused() has those."""
    out = np.full(len(x), np.nan)
    rows = view.expand(x)
    for was in past:
        z, free = np.clip(rows @ was.weights, -LIMIT, LIMIT), np.isnan(out)
        out[free & (-z >= was.least[0])] = 0
        out[free & (z >= was.least[1])] = 1
    return out


def refused(view: View, last: Past, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows whose handed label the view that gets them is sure to be wrong, as of the round's start."""
    z = np.clip(view.expand(x) @ last.weights, -LIMIT, LIMIT)
    return ((label == 1) & (-z >= last.sure[0])) | ((label == 0) & (z >= last.sure[1]))


def pool_counts(views: list[View], x: np.ndarray) -> list[np.ndarray]:
    """binned() of either view's log-odds of pool rows."""
    return [binned(view.logit(x)) for view in views]


def pool_sums(views: list[View], past: list[list[Past]], x: np.ndarray) -> list[np.ndarray]:
    """For each view and kind 0, 1: the number, gradient and Hessian of pool rows that the other view hands to it, flat."""
    out = []
    for i, view in enumerate(views):
        label = given(views[1 - i], past[1 - i], x)
        label[refused(view, past[i][-1], x, label)] = np.nan
        for kind in (0.0, 1.0):
            rows = view.expand(x[label == kind])
            gradient, hessian = parts(rows, np.full(len(rows), kind), view.weights)
            out.append(np.concatenate([[len(rows)], gradient, hessian[np.triu_indices(len(gradient))]]))
    return out


def _split(flat: np.ndarray, views: list[View]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    out, at = [], 0
    for view in views:
        d = len(view.weights)
        for _ in (0, 1):
            n, gradient = flat[at], flat[at + 1 : at + 1 + d]
            hessian = np.zeros((d, d))
            hessian[np.triu_indices(d)] = flat[at + 1 + d : at + 1 + d + d * (d + 1) // 2]
            out.append((n, gradient, hessian + np.triu(hessian, 1).T))
            at += 1 + d + d * (d + 1) // 2
    return out


def co_train(x: np.ndarray, y: np.ndarray, pool, rounds: int = ROUNDS) -> Model:
    """x, y: labelled rows (every third is held back to calibrate); pool(views, past) gives pool_sums() over the pool, flat, and
    pool(views, None) pool_counts()."""
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 1.0)
    held = np.arange(len(y)) % 3 == 2
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    own, label = x[~held], y[~held]
    views = [View(slice(0, N_TEXT), 0), View(slice(N_TEXT, None), N_SIZES)]
    for view in views:
        view.prepare(own)
        view.weights = logistic(view.expand(own), label)
    rows = [view.expand(own) for view in views]
    kinds = [(label == 0).sum(), (label == 1).sum()]
    past: list[list[Past]] = [[], []]
    handed = []
    for round_ in range(rounds if held.any() else 0):
        counts = pool(views, None).reshape(2, BINS)
        for i, view in enumerate(views):
            past[i].append(Past(view.weights, *confident(view.logit(x[held]), y[held], counts[i], SHARE * (round_ + 1))))
        # What is handed weighs the less the surer of its own is the view that gets it.
        own_errors = [error((view.logit(x[held]) > 0) == (y[held] == 1)) for view in views]
        trust = [[e**2 / (e**2 + other**2) for other in past[1 - i][-1].errors] for i, e in enumerate(own_errors)]
        for _ in range(STEPS):
            sums = _split(pool(views, past), views)
            for i, view in enumerate(views):
                gradient, hessian = parts(rows[i], label, view.weights)
                for kind in (0, 1):
                    n, g, h = sums[2 * i + kind]
                    share = trust[i][kind] * min(1.0, kinds[kind] / max(n, 1.0))
                    gradient, hessian = gradient + share * g, hessian + share * h
                view.weights = step(view.weights, gradient, hessian)
        handed.append(tuple(int(s[0]) for s in sums))
    model = Model(text=views[0], metadata=views[1], handed=tuple(handed))
    if not held.any():
        held = ~held
    a, b = views[0].logit(x[held]), views[1].logit(x[held])
    one = np.ones(len(a))
    model.text_scale = logistic(np.stack([one, a], axis=1), y[held])
    model.metadata_scale = logistic(np.stack([one, b], axis=1), y[held])
    both = [one, model.text_scale[0] + model.text_scale[1] * a, model.metadata_scale[0] + model.metadata_scale[1] * b]
    model.join = logistic(np.stack(both, axis=1), y[held])
    return model


def _vectors(batches):
    for batch in slices(batches, SLICE):
        doc, tid, *fields = batch.columns
        yield pa.RecordBatch.from_arrays([doc, tid, pa.array(packed(*(c.to_pylist() for c in fields)), pa.binary())], names=["doc_id", "tid", "x"])


def _prepared(docs: DataFrame) -> DataFrame:
    fields = [text_or_empty(c).alias(c) for c in ("text", "lang", "source")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *fields).select("doc_id", F.xxhash64("text", "lang", "source").alias("tid"), "text", "lang", "source")


def vectors(docs: DataFrame) -> DataFrame:
    """VECTORS: a row for each document; tid is a hash of its content."""
    ship(docs.sparkSession)
    return _prepared(docs).mapInArrow(_vectors, VECTORS)


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """VECTORS and y, the label or null, checkpointed."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min(F.col("quality").cast("int")).alias("y"))
    found = vectors(docs)
    return checkpointed(found.join(known, found["doc_id"] == known["__id"], "left").drop("__id"))


def _pool(found: DataFrame):
    """pool_counts() and pool_sums() over unlabelled rows of with_labels(): a row of sums for each task, added up over two levels.

    Tasks are no more than twice the cluster's cores, so the sums that are shuffled do not grow with the data.
    """
    spark = found.sparkSession
    ship(spark)
    rows = found.where("y is null").select("x").coalesce(max(2, 2 * spark.sparkContext.defaultParallelism))

    def run(views: list[View], past: list[list[Past]] | None) -> np.ndarray:
        size = 2 * BINS if past is None else sum(2 * (1 + d + d * (d + 1) // 2) for d in (len(v.weights) for v in views))

        def of(batches):
            total = np.zeros(size)
            for batch in slices(batches, 4 << 20):
                x = unpacked(batch.column(0).to_pylist())
                total += np.concatenate(pool_counts(views, x) if past is None else pool_sums(views, past, x))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        def add(batches):
            total = np.zeros(size)
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    total += np.frombuffer(s)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        level = rows.mapInArrow(of, "s binary").repartition(max(1, math.isqrt(2 * spark.sparkContext.defaultParallelism)))
        whole = level.mapInArrow(add, "s binary").coalesce(1).mapInArrow(add, "s binary").collect()  # one row
        return sum((np.frombuffer(r["s"]) for r in whole), np.zeros(size))

    return run


def fit_vectors(found: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """The model from with_labels(): at most ``labelled`` labelled rows and all unlabelled ones."""
    order = F.xxhash64("doc_id", "tid", F.lit(7))
    known = found.where("y is not null")
    total = known.count()
    # Each task hands its own least rows to the driver: rows that cannot be among the sample are left out beforehand.
    share = (1.2 * labelled + 500) / max(total, 1)
    while True:
        near = known.where(order <= int((min(share, 1.0) - 0.5) * 2**64 - 1)) if share < 1 else known
        sample = near.orderBy(order, "doc_id", "tid").limit(labelled).select("x", "y").collect()
        if share >= 1 or len(sample) == labelled:
            break
        share *= 2
    if not sample:
        return Model(constant=1.0)
    return co_train(unpacked([bytes(r["x"]) for r in sample]), np.array([r["y"] for r in sample], dtype=float), _pool(found), rounds)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    return fit_vectors(with_labels(docs, labels), labelled, rounds)


def _scored(model: Model):
    def run(batches):
        for batch in slices(batches, 4 << 20):
            score, text, metadata = (np.round(s, 9) for s in model.scores(unpacked(batch.column("x").to_pylist())))
            arrays = [batch.column("doc_id"), pa.array(score), pa.array(text), pa.array(metadata), pa.array(score >= KEEP)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "text_score", "metadata_score", "keep"])

    return run


def score_vectors(found: DataFrame, model: Model) -> DataFrame:
    """SCORED of rows of vectors() or with_labels()."""
    ship(found.sparkSession)
    return found.select("doc_id", "x").mapInArrow(_scored(model), SCORED)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """SCORED: a row for each document."""
    return score_vectors(vectors(docs), model)


def filter_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those that the model rejects; columns as they were.

    Texts are hashed again here: vectors that are kept would have to be joined to the texts, which would shuffle them all.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def keeps(text, lang, source):
        import pandas as pd

        out, at, sizes_ = [], 0, text.str.len().cumsum().to_numpy()
        while at < len(text):  # so many signs at a time
            stop = max(at + 1, int(np.searchsorted(sizes_, (sizes_[at - 1] if at else 0) + SLICE)))
            x = unpacked(packed(*(list(c[at:stop]) for c in (text, lang, source))))
            out.append(np.round(model.scores(x)[0], 9) >= KEEP)
            at = stop
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(keeps(text_or_empty(), text_or_empty("lang"), text_or_empty("source")))
