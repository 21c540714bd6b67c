"""Document quality from a linear-chain conditional random field over lines.

Each line with a word is good or bad; what speaks for either are numbers of the line and of its two neighbours. The
score of a document is the mean of its lines' forward-backward marginals of being good, weighted by length, put on
the scale of the labels by a logistic curve.

Labels are of documents only. At first every line has its document's label; then, twice, lines of bad documents that
the field takes for good become good, unless none would be left bad. At most `most` labelled documents train the
field, those whose ids have the least hashes, and of these, in that order, as many as have `most_lines` lines together;
their lines' numbers, not their texts, come to the driver.

Cases: null, empty or blank text has no lines and scores as the mean of training labels; without labels of both kinds every
document scores that mean, and 0.5 without any; repeated rows get equal scores; a null doc_id is scored and never
trains; of several labels for one doc_id the least counts; an empty table gives no rows; other columns pass through,
and where one has the name of the result, the result's name gets underscores.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.llm import chain_field
from chronopanel.llm.chain_field import ChainField
from chronopanel.llm.line_features import NAMES, lines_of
from chronopanel.llm.rows import free_name, with_verdict
from chronopanel.llm.scratch import drop_table, write_table

#: Labelled documents that train the field, at most.
MOST_TRAINED = 2000
#: Lines that these have together, at most: each is some 90 bytes on the driver.
MOST_LINES = 400_000
#: Score from which a document is kept.
LEAST_SCORE = 0.3
NUMBERS = T.StructType([T.StructField("lines", T.BinaryType()), T.StructField("sizes", T.BinaryType())])


@dataclass(frozen=True)
class QualityModel:
    """field: of the lines, None if it couldn't be fitted; slope and shift: of the logistic curve over the mean's log odds; mean: of training labels."""

    field: ChainField | None
    slope: float
    shift: float
    mean: float

    def scores(self, lines: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.full(len(firsts) - 1, self.mean)
        full = np.diff(firsts) > 0
        if self.field is not None and full.any():
            odds = _log_odds(chain_field.good_marginals(self.field, lines, firsts), firsts, sizes)
            out[full] = 1 / (1 + np.exp(-(self.slope * odds[full] + self.shift)))
        return out


def _log_odds(good: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean of each document's marginals; 0 without lines."""
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    n = len(firsts) - 1
    whole = np.bincount(owner, sizes, n)
    mean = np.divide(np.bincount(owner, good * sizes, n), whole, out=np.full(n, 0.5), where=whole > 0)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a weak pull to slope 1 and shift 0."""
    theta, design = np.array([1.0, 0.0]), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (y - p) - 0.5 * (theta - [1.0, 0.0])
        curve = (design * (p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(2)
        theta = theta + np.linalg.solve(curve, gradient)
    return float(theta[0]), float(theta[1])


def fit_model(documents: Sequence[tuple[np.ndarray, np.ndarray, int]], rounds: int = 2) -> QualityModel:
    """documents: numbers of the lines, their sizes, and the label, 0 or 1."""
    labels = np.array([y for _, _, y in documents], float)
    mean = float(labels.mean()) if len(labels) else 0.5
    kept = [(x, s, y) for x, s, y in documents if len(x)]
    y = np.array([d[2] for d in kept], float)
    if not len(y) or y.min() == y.max():
        return QualityModel(None, 1.0, 0.0, mean)
    lines, sizes = np.concatenate([d[0] for d in kept]).astype(float), np.concatenate([d[1] for d in kept])
    counts = np.array([len(d[0]) for d in kept])
    firsts = np.concatenate([[0], np.cumsum(counts)])
    weights = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    weights = weights / np.sqrt(counts)  # many lines of one document say much the same
    states = np.repeat(y, counts)
    of_bad = np.repeat(y == 0, counts)
    owner = np.repeat(np.arange(len(y)), counts)
    field = chain_field.fit(lines, firsts, states, weights)
    for _ in range(rounds):
        good = chain_field.good_marginals(field, lines, firsts)
        new = np.where(of_bad, good > 0.5, states).astype(float)
        none_bad = np.bincount(owner, (new == 0) * sizes, len(y)) == 0
        new[of_bad & none_bad[owner]] = 0
        states = new
        field = chain_field.fit(lines, firsts, states, weights, field, steps=120)
    odds = _log_odds(chain_field.good_marginals(field, lines, firsts), firsts, sizes)
    return QualityModel(field, *_logistic(odds, y), mean)


def _numbers(texts: pa.Array) -> pa.Array:
    lines, sizes = [], []
    for _, _, x, firsts, size in lines_of(texts):
        for s, e in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            lines.append(x[s:e].tobytes())
            sizes.append(size[s:e].tobytes())
    return pa.StructArray.from_arrays([pa.array(lines, pa.binary()), pa.array(sizes, pa.binary())], names=["lines", "sizes"])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED, most_lines: int = MOST_LINES, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """Fit on the documents that labels (doc_id, label) name, at most `most`, and `most_lines` lines."""
    marked = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("of_doc")).agg((F.min(label) > 0).cast("int").alias("y"))
    chosen = F.broadcast(marked.orderBy(F.xxhash64("of_doc"), "of_doc").limit(most))  # `most` rows of two numbers
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("said")).join(chosen, F.col("doc") == F.col("of_doc"))
    found = with_verdict(texts, _numbers, ["said"], NUMBERS, "k", keep=["doc", "y"]).groupBy("doc").agg(F.min("y").alias("y"), F.min("k").alias("k"))
    found = write_table(found.select("doc", "y", "k.*", (F.octet_length("k.sizes") / 8).alias("n_lines")))
    until = Window.orderBy(F.xxhash64("doc"), "doc").rowsBetween(Window.unboundedPreceding, 0)  # over `most` rows
    fit = found.select("doc", F.sum("n_lines").over(until).alias("so_far")).where(F.col("so_far") <= most_lines).select("doc")
    rows = sorted(found.join(F.broadcast(fit), "doc", "left_semi").select("doc", "y", "lines", "sizes").collect())
    drop_table(found)
    return fit_model([(np.frombuffer(r.lines, np.float32).reshape(-1, len(NAMES)), np.frombuffer(r.sizes, float), r.y) for r in rows])


def _scores(sent, texts: pa.Array) -> pa.Array:
    made = [sent.value.scores(x, firsts, sizes) for _, _, x, firsts, sizes in lines_of(texts)]
    return pa.array(np.concatenate(made) if made else np.zeros(0), pa.float64())


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: Sequence[str] | None = None, name: str = "score") -> DataFrame:
    """docs with a double column `name`: the higher, the likelier label 1."""
    keep = list(docs.columns if keep is None else keep)
    name = free_name(docs.select(*(f"`{c}`" for c in keep)), name)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_verdict(docs, partial(_scores, sent), [text], T.DoubleType(), name, keep=keep)


def is_kept(score: Column, least: float = LEAST_SCORE) -> Column:
    return score >= least


def keep_good(docs: DataFrame, model: QualityModel, least: float = LEAST_SCORE, text: str = "text") -> DataFrame:
    """docs without those that score below `least`."""
    name = free_name(docs, "score")
    return score(docs, model, text, name=name).where(is_kept(F.col(name), least)).drop(name)
