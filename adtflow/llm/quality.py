"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees are grown on a bounded sample of labelled rows, every path from a root becomes a rule (a
conjunction of thresholds on statistics), an L1-penalised logistic regression keeps few of them, and what is
kept is compiled to one Spark column expression. Scoring is a scan: no shuffle, no Python.

Defined results: null text counts as empty and gets a score like any other text; all statistics are ratios that
are 0 for an empty text. Rows with a null label or null id are left out of the fit. Repeated label rows each
count. With no labels, or labels of one kind, the score is the constant smoothed share of label 1. An empty
table gives an empty result. Extra columns are kept as they are; the score's columns replace columns of the
same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows are fitted on: those with the smallest hash of their id.
MAX_FIT_ROWS = 20_000
#: Rows with crc32(doc_id) mod HOLD_OUT = 0 are never learnt from.
HOLD_OUT = 5

_SYMBOLS = r"[#$%&*|~^=<>{}\[\]@_+\\/]"


def statistics(text: Column) -> dict[str, Column]:
    """Whole-text statistics by name; each is linear in the text's length and 0 for an empty text."""
    n = F.length(text).cast("double")
    words = F.regexp_count(text, F.lit(r"\S+")).cast("double")

    def per(count: Column, of: Column) -> Column:
        return F.coalesce(count.cast("double") / F.nullif(of, F.lit(0.0)), F.lit(0.0))

    lines = F.split(text, "\n")
    return {
        "log_chars": F.log1p(n),
        "symbols": per(F.regexp_count(text, F.lit(_SYMBOLS)), n),
        "capitals": per(F.regexp_count(text, F.lit(r"\p{Lu}")), n),
        "digits": per(F.regexp_count(text, F.lit(r"\p{Nd}")), n),
        "stops": per(F.regexp_count(text, F.lit(r"[.!?]")), words),
        "shouts": per(F.regexp_count(text, F.lit(r"[!?]{2,}")), words),
        "bars": per(F.regexp_count(text, F.lit(r" [|] ")), words),
        "word_chars": per(n, words),
        "wide_bytes": per(F.octet_length(text).cast("double") - n, n),
        "line_chars": per(n, F.size(lines).cast("double")),
        "repeated_lines": 1.0 - per(F.size(F.array_distinct(lines)), F.size(lines).cast("double")),
    }


FEATURES = (
    "log_chars", "symbols", "capitals", "digits", "stops", "shouts", "bars", "word_chars", "wide_bytes", "line_chars",
    "repeated_lines",
)


@dataclass
class RuleModel:
    """weights[i] counts where every (feature, above, threshold) of rules[i] holds."""

    intercept: float
    rules: list[tuple[tuple[str, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, stats: dict[str, Column]) -> Column:
        """The compiled model: 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for name, above, threshold in rule:
                test = stats[name] > F.lit(threshold) if above else stats[name] <= F.lit(threshold)
                holds = test if holds is None else holds & test
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(x: np.ndarray, rule) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for name, above, threshold in rule:
        column = x[:, FEATURES.index(name)]
        ok &= column > threshold if above else column <= threshold
    return ok


def _grow(x, y, weight, cuts, rng, depth, path, out):
    """Grow one tree by gain of squared error over quantile cuts; each node's path goes to ``out``."""
    if depth == 0 or len(y) < 20 or (weight * y).sum() in (0.0, weight.sum()):
        return
    best = (1e-9, None, None)
    total, mass = (weight * y).sum(), weight.sum()
    for f in rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False):
        at = np.searchsorted(cuts[f], x[:, f], side="left")
        m = np.bincount(at, weights=weight, minlength=len(cuts[f]) + 1).cumsum()[:-1]
        s = np.bincount(at, weights=weight * y, minlength=len(cuts[f]) + 1).cumsum()[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s**2 / m + (total - s) ** 2 / (mass - m) - total**2 / mass
        gain[(m <= 0.005 * mass) | (m >= 0.995 * mass) | ~np.isfinite(gain)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), f, float(cuts[f][int(gain.argmax())]))
    if best[1] is None:
        return
    _, f, threshold = best
    for above in (False, True):
        rows = x[:, f] > threshold if above else x[:, f] <= threshold
        rule = (*path, (FEATURES[f], above, threshold))
        out.append(rule)
        _grow(x[rows], y[rows], weight[rows], cuts, rng, depth - 1, rule, out)


def _canonical(rule):
    """The tightest bound of each feature and side, in a fixed order: equal rules become equal tuples."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, above, threshold in rule:
        pick = max if above else min
        bounds[name, above] = pick(bounds.get((name, above), threshold), threshold)
    return tuple((n, a, t) for (n, a), t in sorted(bounds.items()))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression under an L1 penalty by accelerated proximal gradient; the intercept is free."""
    n = len(y)
    v = np.ones(z.shape[1]) / math.sqrt(max(1, z.shape[1]))
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 4.0 * n / max(float(np.linalg.norm(z @ v) ** 2) + n, 1.0)
    b0 = math.log((y.sum() + 1) / (n - y.sum() + 1))
    w, u, b, c, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), b0, b0, 1.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(c + z @ u))) - y) / n
        nw = u - step * (z.T @ g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = c - step * g.sum()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Fit on rows of FEATURES and 0/1 labels. Deterministic for the same rows in the same order."""
    share = (float(y.sum()) + 1) / (len(y) + 2)
    if len(y) < 20 or y.min() == y.max():
        return RuleModel(math.log(share / (1 - share)))
    rng, out = np.random.default_rng(seed), []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 99))) for f in range(x.shape[1])]
    even = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(trees):
        weight = rng.poisson(0.7, len(y)).astype(float) * even
        _grow(x, y, weight, cuts, rng, depth, (), out)
    rules = list(dict.fromkeys(_canonical(r) for r in out))
    z = np.column_stack([_holds(x, r) for r in rules]).astype(float)
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold on the same rows count once
    first = sorted(first)
    rules, z = [rules[i] for i in first], z[:, first]
    _, w = _lasso(z, y.astype(float), penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    if not len(kept):
        return RuleModel(math.log(share / (1 - share)))
    b, w = _lasso(z[:, kept], y.astype(float), penalty / 10)  # the chosen rules again, with less shrinkage
    return RuleModel(float(b), [rules[i] for i in kept], [float(a) for a in w])


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out; one without an id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``max_rows`` rows outside the held-out fold: those of smallest id hash.

    Bounded: only their ids are broadcast and only their FEATURES (11 doubles) reach the driver, of at most
    ``max_rows`` rows too where ids repeat.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .select("doc_id", F.col(label).cast("double").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_y")
        .limit(max_rows)
    )
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t")).join(F.broadcast(chosen), "doc_id")
    stats = statistics(F.col("_t"))
    made = rows.select("doc_id", "_y", F.xxhash64("_t").alias("_of"), *[stats[f].alias(f) for f in FEATURES])
    got = made.orderBy(F.xxhash64("doc_id"), "doc_id", "_y", "_of").limit(max_rows).toPandas()
    got = got.sort_values(["doc_id", "_y", *FEATURES], kind="stable")
    return got[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), got["_y"].to_numpy(float)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> RuleModel:
    x, y = training_rows(docs, labels, label, max_rows)
    return fit(x, y) if len(y) else RuleModel(0.0)


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if score >= threshold). Reads nothing but the text."""
    return _scored(docs, model, threshold, text).drop("_row")


def accepted(docs: DataFrame, model: RuleModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    # A filter is pushed only below deterministic columns; _row keeps it above the statistics, so they are computed once.
    return _scored(docs, model, threshold, text).where((F.col("predicted") == 1) & (F.col("_row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _scored(docs: DataFrame, model: RuleModel, threshold: float, text: str) -> DataFrame:
    stats = statistics(F.col("_t"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    named = docs.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    with_stats = named.select(*kept, F.struct(*[stats[f].alias(f) for f in FEATURES]).alias("_s"), F.monotonically_increasing_id().alias("_row"))
    scored = with_stats.select(*kept, "_row", model.score({f: F.col("_s")[f] for f in FEATURES}).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
