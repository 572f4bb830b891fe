"""Quality classifier: a sparse rule ensemble.

Boosted shallow trees over text statistics give paths; every path is a
conjunctive rule; a lasso logistic regression keeps few of them; the kept
rules are compiled into one Spark column expression. Only the fit, on a
bounded sample of labelled rows, happens on the driver; statistics and scores
are built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit may read at most.
SAMPLE_ROWS = 12_000


def statistics(text: str = "text") -> dict[str, Column]:
    """Statistics of a text; a NULL text counts as empty. All are finite."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    chars, words = F.length(t), F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")
    n, k = F.greatest(chars, F.lit(1)), F.size(words)

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / n

    def repeats(items: Column) -> Column:
        return 1.0 - F.size(F.array_distinct(items)) / F.size(items)

    return {
        "log_chars": F.log1p(chars.cast("double")),
        "mean_word": chars / F.greatest(k, F.lit(1)),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{N}"),
        "punctuation": share(r"[^\p{L}\p{N}\s]"),
        "sentence_marks": share(r"[.!?](?:\s|$)"),
        "commas": share(","),
        "odd_symbols": share(r"[#$%&*@^~_=+<>{}\[\]\\]"),
        "mark_runs": share(r"[^\p{L}\p{N}\s]{2,}"),
        "bangs": share("!!"),
        "bars": share(r"\|"),
        "links": share(r"https?:|www\."),
        "lines": share("\n"),
        "doubled_words": share(r"(?<!\S)(\S+)\s+\1(?!\S)"),
        "word_repeats": repeats(words),
        "line_repeats": repeats(F.split(t, "\n")),
    }


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules are tuples of ``(statistic, above, threshold)``; all must hold."""

    bias: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def score(self, columns: dict[str, Column] | None = None) -> Column:
        """The ensemble as one expression over columns named like the statistics."""
        at = columns or {}
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = None
            for name, above, threshold in conditions:
                c = at.get(name, F.col(name))
                one = c > F.lit(threshold) if above else c <= F.lit(threshold)
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _tree(x, g, h, cuts, depth, path, found, out, rows):
    """Grow one tree on gradients; add the path of every node but the root to ``found``."""
    G, H = g[rows].sum(), h[rows].sum()
    if path:
        found.add(tuple(sorted(path)))
    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            bins = np.searchsorted(cuts[f], x[rows, f], side="left")
            gs = np.bincount(bins, g[rows], len(cuts[f]) + 1).cumsum()[:-1]
            hs = np.bincount(bins, h[rows], len(cuts[f]) + 1).cumsum()[:-1]
            ns = np.bincount(bins, minlength=len(cuts[f]) + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
            gain[(ns < 10) | (len(rows) - ns < 10)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    _, f, i = best
    if f is None:
        out[rows] = -G / (H + 1)
        return
    left = x[rows, f] <= cuts[f][i]
    _tree(x, g, h, cuts, depth - 1, path | {(f, False, float(cuts[f][i]))}, found, out, rows[left])
    _tree(x, g, h, cuts, depth - 1, path | {(f, True, float(cuts[f][i]))}, found, out, rows[~left])


def _paths(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int) -> list:
    random, found = np.random.default_rng(seed), set()
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 66)[1:-1], method="lower"))
        cuts.append(values[values < x[:, f].max()])
    margin = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(random.random(len(y)) < 0.7)
        step = np.zeros(len(y))
        _tree(x, p - y, p * (1 - p), cuts, depth, frozenset(), found, step, rows)
        margin += 0.3 * step
    return sorted(found)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal steps; no penalty on the bias."""
    n = len(y)
    z = np.hstack([np.ones((n, 1)), z])
    norm, v = 0.0, np.ones(z.shape[1])
    for _ in range(30):
        v = z.T @ (z @ v)
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 * n / max(norm, 1e-9)
    w = ahead = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(rounds):
        grad = z.T @ (1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30))) - y) / n
        new = ahead - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit_rules(
    x: np.ndarray,
    y: np.ndarray,
    names: list[str],
    trees: int = 30,
    depth: int = 3,
    penalty: float = 2e-4,
    seed: int = 7,
) -> RuleEnsemble:
    """Fit on a matrix of statistics. Without rows of both classes the score is the
    smoothed share of class 1 everywhere."""
    x, y = np.nan_to_num(np.asarray(x, float).reshape(-1, len(names))), np.asarray(y, float)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    paths = _paths(x, y, trees, depth, seed)

    def holds(path):
        return np.logical_and.reduce([(x[:, f] > c) if above else (x[:, f] <= c) for f, above, c in path])

    z = np.array([holds(p) for p in paths], float).T
    bias, w = _lasso(z, y, penalty, 400)
    rules = tuple(
        (tuple((names[f], above, c) for f, above, c in p), float(v)) for p, v in zip(paths, w, strict=True) if v
    )
    return RuleEnsemble(bias, rules)


def train(
    documents: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = SAMPLE_ROWS,
) -> RuleEnsemble:
    """Fit on at most ``rows`` labelled documents, picked by a hash of their id. Rows
    with a NULL id or label are left out; of several labels of one id the largest
    counts. No label at all gives a score of one half."""
    chosen = (
        labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id).alias("_id"))
        .agg(F.max(label).cast("double").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    columns = statistics(text)
    found = (
        documents.select(id, text)
        .join(F.broadcast(chosen), F.col(id) == F.col("_id"))  # at most ``rows`` small rows
        .select("_y", *[c.cast("double").alias(n) for n, c in columns.items()])
        .toPandas()
        .sort_values(["_y", *columns])
    )
    return fit_rules(found[list(columns)].to_numpy(), found["_y"].to_numpy(), list(columns))


def score_quality(
    documents: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = 0.3
) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Every row is scored by its whole text; a NULL or empty text has the statistics
    of the empty one. Row order, repeated rows and other columns play no part;
    columns named ``score`` or ``predicted`` are replaced.
    """
    names = {n for conditions, _ in model.rules for n, _, _ in conditions}
    columns = {n: c for n, c in statistics(text).items() if n in names}
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    with_statistics = documents.select(
        *[F.col(f"`{c}`") for c in kept],
        # The explode keeps each statistic from being put into every rule that asks for it.
        F.explode(
            F.array(F.struct(F.lit(0).alias("_"), *[c.cast("double").alias(n) for n, c in columns.items()]))
        ).alias("_statistics"),
    )
    return with_statistics.withColumn(
        "score", model.score({n: F.col(f"_statistics.{n}") for n in names})
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("_statistics")
