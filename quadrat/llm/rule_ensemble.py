"""Quality classifier: a sparse rule ensemble over statistics of a text.

Small trees are grown on the residuals of a boosted logistic model; every path from a root to a node becomes a conjunctive
rule; an L1-penalised logistic regression weighs rules and clipped linear terms; what is left with a weight is compiled into
one Spark column expression, which scores all documents. The classifier is fitted on the driver, from a bounded sample of
labelled rows (``max_labelled``, those of the smallest hashed ids); statistics and scores are computed for every whole text.

Defined results: a null text is an empty one, and gets a score too; rows that are labelled twice count once if they agree
and not at all if they don't; with one class only, or none, every score is the prior; repeated rows give repeated results,
and the fit takes one row of each id, that of the smallest statistics; texts of any length are read whole; an empty table gives
no rows; columns other than the id and the text are ignored, and may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("n_words", "mean_word", "unique_share", "top_share", "symbol_share", "upper_share", "digit_share", "pipe_share", "bang_share", "punct_share", "stop_share", "line_words", "dup_line_share", "long_word_share", "repeat_pair_share", "letter_share")
MAX_LABELLED = 10_000
N_TREES = 40
DEPTH = 3
MIN_LEAF = 5
SHRINK = 0.3
PENALTY = 0.002
SHARE_OF_ROWS = 0.7
ITERATIONS = 600
THRESHOLD = 0.7
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, DIGIT, SYMBOL, LETTER = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[#$%&*<>@^~=+\\{}\[\]]"), re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")


def statistics(text: str | None) -> tuple[float, ...]:
    """The features of one text; shares are of its words or of its characters."""
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), max(1, len(text))
    if not n:
        return (0.0,) * len(FEATURES)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(map(str.__eq__, words, words[1:]))
    short = sum(len(w) <= 3 for w in words)
    return (
        float(min(n, 2000)), sum(map(len, words)) / n, len(counts) / n, max(counts.values()) / n,
        len(SYMBOL.findall(text)) / chars, len(UPPER.findall(text)) / chars, len(DIGIT.findall(text)) / chars,
        text.count("|") / n, text.count("!") / n, sum(map(text.count, ".,;:?")) / n,
        short / n, n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) > 14 for w in words) / n, repeats / n, len(LETTER.findall(text)) / chars,
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and a column for each feature."""

    def run(batches):
        for b in batches:
            columns = list(zip(*map(statistics, b.column(1).to_pylist()), strict=True)) or [[]] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in columns)], ["i", *FEATURES])

    own = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"))
    kind = own.schema["i"].dataType.simpleString()
    return own.mapInArrow(run, f"i {kind}, " + ", ".join(f"{f} double" for f in FEATURES)).withColumnRenamed("i", id_col)


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold), in order


def best_split(x: np.ndarray, r: np.ndarray, h: np.ndarray, min_leaf: int) -> tuple[float, int, float] | None:
    """The split of the largest gain over the columns: (gain, feature, threshold)."""
    best = None
    whole = r.sum() ** 2 / (h.sum() + 1e-6)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, rs, hs = x[order, j], np.cumsum(r[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= min_leaf) & (at + 1 <= len(v) - min_leaf)]
        if not len(at):
            continue
        gain = rs[at] ** 2 / (hs[at] + 1e-6) + (rs[-1] - rs[at]) ** 2 / (hs[-1] - hs[at] + 1e-6) - whole
        k = int(np.argmax(gain))
        if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), j, float((v[at[k]] + v[at[k] + 1]) / 2))
    return best


def grow(x: np.ndarray, r: np.ndarray, h: np.ndarray, depth: int, path: Rule = (), rules: list[Rule] | None = None) -> tuple[list[Rule], list[tuple[Rule, float]]]:
    """Paths to all nodes below the root, and the leaves with their values."""
    rules = [] if rules is None else rules
    split = best_split(x, r, h, MIN_LEAF) if depth and len(r) >= 2 * MIN_LEAF else None
    if split is None:
        return rules, [(path, float(r.sum() / (h.sum() + 1.0)))]
    _, j, t = split
    leaves = []
    for above in (False, True):
        rows = (x[:, j] > t) == above
        own = (*path, (j, above, t))
        rules.append(own)
        leaves += grow(x[rows], r[rows], h[rows], depth - 1, own, rules)[1]
    return rules, leaves


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) == above
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, iterations: int = ITERATIONS) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradients; the intercept is free."""
    n, p = a.shape
    step = 4 / (float(np.linalg.eigvalsh(a.T @ a)[-1]) / n + 1)
    w, b = np.zeros(p), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(iterations):
        e = sigmoid(a @ vw + vb) - y
        u = vw - step * (a.T @ e) / n
        nw = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)
        nb = vb - step * e.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]
    linear: tuple[tuple[int, float, float, float], ...]  # feature, lower, upper, weight of the clipped value

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            z += w * holds(rule, x)
        for j, lo, hi, w in self.linear:
            z += w * np.clip(x[:, j], lo, hi)
        return z

    def column(self) -> Column:
        """The score as a Spark expression over the feature columns."""
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            test = F.lit(True)
            for j, above, t in rule:
                test = test & (F.col(FEATURES[j]) > t if above else F.col(FEATURES[j]) <= t)
            z = z + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        for j, lo, hi, w in self.linear:
            z = z + F.least(F.greatest(F.col(FEATURES[j]), F.lit(lo)), F.lit(hi)) * w
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = N_TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """Grow trees, take their paths as rules, and weigh them by the lasso."""
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(set(y.tolist())) < 2:
        return RuleEnsemble(prior, (), ())
    rng = np.random.default_rng(7)
    rules: dict[tuple, Rule] = {}
    score = np.full(len(y), prior)
    for _ in range(n_trees):
        rows = np.flatnonzero(rng.random(len(y)) < SHARE_OF_ROWS)
        features = np.sort(rng.permutation(x.shape[1])[: max(4, x.shape[1] * 2 // 3)])
        p = sigmoid(score)
        found, leaves = grow(x[np.ix_(rows, features)], (y - p)[rows], (p * (1 - p))[rows], depth)
        own = lambda rule: tuple((int(features[j]), above, t) for j, above, t in rule)  # noqa: B023, E731
        for rule in map(own, found):
            on = holds(rule, x)
            if 0 < on.sum() < len(on):
                rules.setdefault(min(on.tobytes(), (~on).tobytes()), rule)  # rules that split the rows alike count once
        for path, value in leaves:
            score += SHRINK * value * holds(own(path), x)
    columns, scales = [], []
    for rule in rules.values():
        on = holds(rule, x).astype(float)
        s = max(on.std(), 0.05)
        columns.append((on - on.mean()) / s)
        scales.append((on.mean(), s))
    linear = []
    for j in range(x.shape[1]):
        lo, hi = np.quantile(x[:, j], [0.025, 0.975])
        v = np.clip(x[:, j], lo, hi)
        if v.std() > 1e-9:
            columns.append(0.4 * (v - v.mean()) / v.std())
            linear.append((j, float(lo), float(hi)))
            scales.append((v.mean(), v.std() / 0.4))
    b, w = lasso_logistic(np.stack(columns, 1), y, penalty)
    b -= sum(w[k] * m / s for k, (m, s) in enumerate(scales))
    w = [w[k] / s for k, (_, s) in enumerate(scales)]
    n = len(rules)
    kept = tuple((rule, float(w[k])) for k, rule in enumerate(rules.values()) if w[k])
    return RuleEnsemble(float(b), kept, tuple((*x, float(w[n + k])) for k, x in enumerate(linear) if w[n + k]))


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2, divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` labelled documents that aren't held out, in order of their hashed ids."""
    agreed = labels.groupBy(F.col(id_col).alias("lid")).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2 and lid is not null")
    own = agreed.where(~held_out("lid")).orderBy(F.xxhash64("lid"), "lid").limit(limit).select("lid", "y")
    marked = docs.join(F.broadcast(own), docs[id_col] == own["lid"])  # at most ``limit`` rows of two numbers
    stats = with_statistics(marked.select(F.col("lid").alias("i"), F.col(text).alias("t")), "i", "t")
    rows = stats.join(F.broadcast(own), F.col("i") == F.col("lid")).select("lid", "y", *FEATURES)
    rows = rows.groupBy("lid").agg(F.min(F.struct("y", *FEATURES)).alias("x")).select("lid", "x.*").toPandas().sort_values("lid")
    return rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: its id, held_out, score (0 to 1; higher: label 1 likelier) and predicted."""
    x, y = training_rows(docs, labels, id_col, text, label, max_labelled)
    model = fit(x, y) if len(y) else RuleEnsemble(0.0, (), ())
    scored = with_statistics(docs, id_col, text).withColumn("score", model.column())
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
