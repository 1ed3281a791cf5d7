"""Toxicity by a classifier chain: linear models in sequence, each fed the probabilities of those before it.

The categories are label columns, in chain order. Features are the words of a document and the beginnings of its words,
hashed; those that separate a category best are chosen from counts over the labelled sample. Later models train on
out-of-fold probabilities of earlier categories, so that they meet them as they will at prediction.

The labelled rows that are fitted on are at most SAMPLE_ROWS, those of least xxhash64(doc_id); every document is scored,
over its whole text, by models of a size that depends on FEATURES only.

Nulls and ties: rows whose label is null in any category are not trained on; a null text has no features; a null doc_id
is scored as any other; rows that repeat are scored each; of those that share a doc_id one text and one label, the least,
are trained on. Without labelled rows of both
kinds a category's probability is its smoothed rate, (n1 + 0.5) / (n + 1). Only doc_id, text and the label columns are
read, so other columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, byte_class, mix64, segments, table, text_buffer, word_spans

#: Label columns in chain order, and the value that means the category holds.
CATEGORIES = (("quality", 0), ("toxic", 1))
#: Labelled rows used for fitting, at most.
SAMPLE_ROWS = 10_000
FEATURES = 700
FOLDS = 5
#: Bytes of the beginnings of words that are features besides the words.
BEGINNINGS = (4, 5, 6, 7, 8)
LEAST_DOCS = 4
CUT = 0.5


def text_features(part: np.ndarray, offsets: np.ndarray, hasher: SpanHasher, inside: np.ndarray):
    """Yields (hash, row) of words and of beginnings of longer words, with repeats."""
    start, end, row = word_spans(part, offsets, inside)
    if len(start):
        sums = hasher.prefix(part)
        yield hasher.of(sums, start, end), row
        for k in BEGINNINGS:
            long = end - start > k
            yield mix64(hasher.of(sums, start[long], start[long] + k) + np.uint64(k)), row[long]


def feature_counts(sample: DataFrame, categories: list[str]) -> DataFrame:
    """(feature, n, n0, n1, ...): documents of the sample with the feature, and those of each category."""

    def count(batches):
        hasher, inside = SpanHasher(), byte_class("alnum")
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            marks = [np.asarray(c) for c in batch.columns[1:]]
            for low, high in segments(offsets):
                found = list(text_features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], hasher, inside))
                if not found:
                    continue
                h, row = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[new], row[new]
                names, at = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(np.bincount(at)), *(pa.array(np.bincount(at, m[low:high][row]).astype(np.int64)) for m in marks)],
                    ["feature", "n", *(f"n{i}" for i in range(len(marks)))],
                )

    schema = "feature long, n long, " + ", ".join(f"n{i} long" for i in range(len(categories)))
    counts = sample.select("text", *categories).mapInArrow(count, schema)
    return counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *(f"n{i}" for i in range(len(categories))))])


def document_features(docs: DataFrame, features: np.ndarray, extra: list[str]) -> DataFrame:
    """extra and has: the places, in features (sorted hashes), of what a document has."""
    schema = docs.select(*extra).schema.simpleString()[len("struct<") : -1]

    def look(batches):
        for batch in batches:
            for low, _high, has in look_up(batch.column(0), features):
                yield pa.RecordBatch.from_arrays([*(c.slice(low, len(has)) for c in batch.columns[1:]), pa.array(has, pa.list_(pa.int32()))], [*extra, "has"])

    return docs.select("text", *extra).mapInArrow(look, schema.replace(",", ", ") + ", has array<int>")


def look_up(texts: pa.Array, features: np.ndarray):
    """(first row, last row, places of features by row) for slices of a column of texts."""
    hasher, inside = SpanHasher(), byte_class("alnum")
    maybe = np.zeros(1 << 16, bool)
    maybe[(features & np.uint64(0xFFFF)).astype(np.int64)] = True
    data, offsets = text_buffer(texts)
    for low, high in segments(offsets):
        pairs = [np.zeros(0, np.int64)]
        for h, row in text_features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], hasher, inside):
            some = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
            if len(some) and len(features):
                at = np.minimum(np.searchsorted(features, h[some]), len(features) - 1)
                good = features[at] == h[some]
                pairs.append(row[some[good]] * len(features) + at[good])
        pairs = np.unique(np.concatenate(pairs))
        cut = np.searchsorted(pairs, np.arange(high - low + 1) * max(len(features), 1))
        places = (pairs % max(len(features), 1)).astype(np.int32)
        yield low, high, [places[i:j] for i, j in zip(cut, cut[1:], strict=False)]


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 0.2, steps: int = 200) -> np.ndarray:
    """Weights of a logistic regression; x's last column is all ones. Accelerated gradient steps of fixed number.

    The rarer kind weighs the square root of the ratio more, so that its few rows move the cut toward the middle.
    """
    n, w = len(y), np.zeros(x.shape[1])
    if not n or y.min() == y.max():
        w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
        return w
    ratio = np.sqrt((n - y.sum()) / y.sum())
    heavy = np.where(y == 1, max(ratio, 1), max(1 / ratio, 1)).astype(x.dtype)
    v, t = np.ones(x.shape[1], x.dtype), 0.0
    for _ in range(12):  # the largest curvature, by power iteration
        v = x.T @ ((x @ v) * heavy)
        t = float(np.linalg.norm(v))
        v /= t
    rate, z, k = 1 / (t / 4 + l2), w.copy(), 1.0
    for _ in range(steps):
        g = (x.T @ ((probability(x, z) - y) * heavy).astype(x.dtype)).astype(np.float64)
        g[:-1] += l2 * z[:-1]
        after = z - rate * g
        k, last = (1 + np.sqrt(1 + 4 * k * k)) / 2, k
        z, w = after + (last - 1) / k * (after - w), after
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -30, 30)))


class Chain:
    """features: sorted hashes; weights: for each category, of the features, of the categories but the last (0 from its own on), and the intercept."""

    def __init__(self, names: list[str], features: np.ndarray, weights: list[np.ndarray], fitted: bool = True):
        self.names, self.features, self.weights, self.fitted = names, features, weights, fitted

    def predict(self, has: list[np.ndarray]) -> np.ndarray:
        n, size = len(has), len(self.features)
        row = np.repeat(np.arange(n), [len(x) for x in has])
        at = np.concatenate(has) if n else np.zeros(0, np.int64)
        out = np.zeros((n, len(self.names)))
        for c, w in enumerate(self.weights):
            z = np.bincount(row, w[at], n) + out[:, :c] @ w[size : size + c] + w[-1]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_chain(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, folds: int = FOLDS) -> Chain:
    names = [c for c, _ in categories]
    marked = labels.select("doc_id", *[(F.col(c) == v).cast("int").alias(c) for c, v in categories]).dropna()
    # One label and one text for each id, so that the bound holds after the join, too.
    once = marked.groupBy("doc_id").agg(F.min(F.struct(*names)).alias("m")).select("doc_id", "m.*")
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows of numbers
    sample = sample.groupBy("doc_id", *names).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    from .common import Kept

    kept = Kept(docs.sparkSession)
    sample = kept.keep(sample, "labelled")
    totals = sample.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    counts = kept.keep(feature_counts(sample, names).where(f"n >= {LEAST_DOCS}"), "counts")
    picked = set()
    for i, c in enumerate(names):
        n, n1 = totals["n"] or 0, totals[c] or 0
        if 0 < n1 < n:
            rate = F.col("n") / n
            score = F.abs(F.col(f"n{i}") / n1 - (F.col("n") - F.col(f"n{i}")) / (n - n1)) / F.sqrt(rate * (1 - rate) + 1e-9)
            picked |= {r[0] for r in counts.orderBy(F.desc(score), "feature").limit(features).select("feature").collect()}
    hashes = np.sort(np.array(sorted(picked), np.int64).view(np.uint64))
    rows = sorted(document_features(sample, hashes, ["doc_id", *names]).collect())
    kept.drop(sample, counts)
    # Columns: features, the probabilities of earlier categories (0 until they are known), ones.
    size = len(hashes)
    x = np.zeros((len(rows), size + len(names)), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r["has"]] = 1
    fold = mix64(np.array([r["doc_id"] for r in rows], np.int64).view(np.uint64)) % np.uint64(folds) if rows else np.zeros(0)
    weights = []
    for place, c in enumerate(names):
        y = np.array([r[c] for r in rows], np.float64)
        weights.append(fit_linear(x, y))
        if c != names[-1]:
            unseen = np.zeros(len(rows), np.float32)
            for k in range(folds):
                own = fold == k
                unseen[own] = probability(x[own], fit_linear(x[~own], y[~own]))
            x[:, size + place] = unseen
    return Chain(names, hashes, weights, bool(rows) and 0 < sum(r[names[-1]] for r in rows) < len(rows))


def score(docs: DataFrame, chain: Chain, cut: float = CUT) -> DataFrame:
    """doc_id, p_<category> of each, and rejected: whether the chain's last category is at least as likely as cut.

    Without labelled rows of both kinds in that category nothing is rejected.
    """

    def predict(batches):
        for batch in batches:
            for low, high, has in look_up(batch.column(1), chain.features):
                p = chain.predict(has)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array(p[:, c].round(6)) for c in range(len(chain.names))), pa.array((p[:, -1] >= cut) & chain.fitted)], ["doc_id", *(f"p_{c}" for c in chain.names), "rejected"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, " + "".join(f"p_{c} double, " for c in chain.names) + "rejected boolean")


def without_toxic(docs: DataFrame, chain: Chain, cut: float = CUT) -> DataFrame:
    """The rows of docs that the chain doesn't reject, in the same pass over their texts; all, if it knows only one kind."""
    if not chain.fitted:
        return docs
    cols, at = docs.columns, docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            good = [p < cut for low, high, has in look_up(batch.column(at), chain.features) for p in chain.predict(has)[:, -1]]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema).select(*cols)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_chain(docs, table(spark, sf_dir, "labels")))
