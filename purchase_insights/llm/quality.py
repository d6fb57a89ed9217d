"""Quality by a sparse ensemble of rules.

Small trees over statistics of the text are grown in numpy on a bounded sample of
labelled rows; every path from a root is a conjunctive rule; a lasso logistic
regression keeps few of them, and these are compiled into one Spark column.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purchase_insights.llm.sampling import sample_ids, unused_name, with_texts

#: A rule: conditions (statistic, above, threshold), all of which hold.
Rule = tuple[tuple[str, bool, float], ...]


class Model(NamedTuple):
    rules: list[tuple[Rule, float]]
    bias: float


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; a missing one counts as empty. Shares are of its characters."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text)
    words = F.split(F.translate(text, "\n\t", "  "), " ")
    lines = F.split(text, "\n")

    def share(without: Column) -> Column:
        return (chars - F.char_length(without)) / F.greatest(chars, F.lit(1))

    return {
        "n_chars": chars.cast("double"),
        "n_words": F.size(words).cast("double"),
        "word_chars": chars / F.size(words),
        "new_words": F.size(F.array_distinct(words)) / F.size(words),
        "n_lines": F.size(lines).cast("double"),
        "new_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "upper": share(F.regexp_replace(text, r"\p{Lu}+", "")),
        "symbols": share(F.regexp_replace(text, r"[#$%&*+=<>^~@\\{}\[\]_/]+", "")),
        "digits": share(F.regexp_replace(text, "[0-9]+", "")),
        "shouts": share(F.replace(text, F.lit("!"))),
        "bars": share(F.replace(text, F.lit("|"))),
        "stops": share(F.replace(text, F.lit("."))),
    }


def train(docs: DataFrame, labels: DataFrame, n_rows: int = 20_000, trees: int = 40, depth: int = 3) -> Model:
    """Fit on at most ``n_rows`` rows of ``docs`` labelled in ``labels`` (doc_id, quality 0 or 1).

    The sample is picked by a hash of doc_id; a repeated one counts once. Without labelled rows, or with one kind
    only, the model has no rules and the score is the labels' share of 1 (0.5 if none).
    """
    picked = sample_ids(labels.where("quality IS NOT NULL").select("doc_id", "quality"), n_rows)
    columns = statistics(F.col("text"))
    sample = with_texts(picked, docs)
    measured = sample.select("doc_id", "quality", *(column.alias(name) for name, column in columns.items()))
    rows = measured.toArrow().sort_by("doc_id")  # the same model however rows are split
    y = rows["quality"].to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return Model([], 0.0 if len(y) == 0 else 6.0 * (2 * y[0] - 1))
    x = np.column_stack([rows[name].to_numpy() for name in columns])
    names, rng = list(columns), np.random.default_rng(7)
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        chosen = rng.integers(0, len(y), min(len(y), 4000))
        allowed = rng.choice(len(names), size=max(3, len(names) // 2), replace=False)
        rules |= dict.fromkeys(_paths(x[chosen], y[chosen], names, allowed, depth, ()))
    listed = sorted(rules)
    holds = np.column_stack([_holds(rule, x, names) for rule in listed]).astype(float)
    weights, bias = _lasso(holds, y)
    return Model([(rule, float(w)) for rule, w in zip(listed, weights) if w], float(bias))


def _paths(x: np.ndarray, y: np.ndarray, names: list[str], allowed: np.ndarray, depth: int, path: Rule) -> list[Rule]:
    """Rules of a tree that is grown by the Gini gain, of inner nodes and leaves."""
    found = [path] if path else []
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return found
    best = (1e-4 * len(y), None, 0.0)
    impurity = len(y) * y.mean() * (1 - y.mean())
    for k in allowed:
        order = np.argsort(x[:, k], kind="stable")
        values, ones = x[order, k], np.cumsum(y[order])
        at = np.flatnonzero(values[1:] > values[:-1])
        at = at[(at >= 4) & (at < len(y) - 5)]
        if len(at) == 0:
            continue
        n_low, low = at + 1, ones[at]
        n_high, high = len(y) - n_low, ones[-1] - low
        gain = impurity - low * (1 - low / n_low) - high * (1 - high / n_high)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (gain[i], k, float((values[at[i]] + values[at[i] + 1]) / 2))
    if best[1] is None:
        return found
    below = x[:, best[1]] <= best[2]
    for side, above in ((below, False), (~below, True)):
        found += _paths(x[side], y[side], names, allowed, depth - 1, (*path, (names[best[1]], above, best[2])))
    return found


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    return np.logical_and.reduce([(x[:, names.index(n)] > t) == above for n, above, t in rule])


def _lasso(holds: np.ndarray, y: np.ndarray, penalty: float = 2e-3, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps."""
    design = np.column_stack([holds, np.ones(len(y))])
    rate = 4 * len(y) / max(np.linalg.norm(design, 2) ** 2, 1e-9)
    theta = ahead = np.zeros(design.shape[1])
    for step in range(steps):
        slope = design.T @ (1 / (1 + np.exp(-np.clip(design @ ahead, -50, 50))) - y) / len(y)
        after = ahead - rate * slope
        after[:-1] = np.sign(after[:-1]) * np.maximum(np.abs(after[:-1]) - rate * penalty, 0)
        ahead = after + step / (step + 3) * (after - theta)
        theta = after
    return theta[:-1], theta[-1]


def _scored(docs: DataFrame, model: Model, score_name: str) -> DataFrame:
    """``docs`` and a column with the score.

    The statistics that rules use are the one row of a generator, which the optimizer
    doesn't look through: it would put each of them into every condition on it.
    """
    used = {name for rule, _ in model.rules for name, _, _ in rule}
    prefix = unused_name("stat_", docs)
    stats = statistics(F.col("text")).items()
    columns = [column.alias(prefix + name) for name, column in stats if name in used]
    kept = docs.columns

    def compiled(rule: Rule, weight: float) -> Column:
        stats = ((F.col(prefix + name), above, threshold) for name, above, threshold in rule)
        conditions = (stat > threshold if above else stat <= threshold for stat, above, threshold in stats)
        return F.when(reduce(Column.__and__, conditions), weight).otherwise(0.0)

    z = reduce(Column.__add__, (compiled(rule, weight) for rule, weight in model.rules), F.lit(model.bias))
    measured = docs.select(*kept, F.inline(F.array(F.struct(*columns)))) if columns else docs
    return measured.select(*kept, (1 / (1 + F.exp(-z))).alias(score_name))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5) of each whole text.

    Everything is computed in Spark expressions. A missing text is scored as an empty
    one; repeated rows are repeated; other columns are ignored.
    """
    scored = _scored(docs.select(F.col("doc_id").cast("bigint"), "text"), model, "score").select("doc_id", "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score 0.5 or more."""
    name = unused_name("score", docs)
    return _scored(docs, model, name).where(F.col(name) >= 0.5).select(*docs.columns)
