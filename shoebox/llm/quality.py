"""Document quality by a sparse rule ensemble.

Statistics of the text feed small boosted trees; each path of a tree,
from the root to any node, is a rule: a conjunction of comparisons.  A
logistic model with a lasso penalty weighs the rules, most of which get
no weight; the others are compiled into one Column expression over the
statistics, all with DataFrame functions.

Fitting sees a bounded sample of labelled rows, a parameter: at most
``SAMPLE`` rows, those whose ids hash lowest.  It happens on the driver
over ``SAMPLE`` rows of about twenty numbers.

Edge cases: a null text counts as empty; empty texts get the score of
their statistics, which are 0; labels that are null or neither 0 nor 1
are no labels, an id with both labels counts once for each, and of
several texts of an id that which hashes lowest is learned from; with
labels of one kind only, or none, every score is the share of label 1
(0.5 without labels); an empty table gives no rows; repeated rows give
repeated results; very long texts are read whole; other columns of the
input are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Split, Tree, fit
from .common import fresh, held_out
from .lines import SPACE

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 12_000
#: Score from which a document is predicted to be good.
GOOD = 0.7
#: Penalty on the weights of the rules.
PENALTY = 0.002

FEATURES = (
    "words", "mean_word", "symbols", "marks", "digits", "capitals", "shouts", "distinct", "repeats",
    "lines", "same_lines", "line_words", "ends", "pipes", "stops", "spaces", "doubled", "letters",
)


# One letter stands for a run of small ones, so that the counts of all else read a short text.
SMALL = r"[\p{L}&&[^\p{Lu}]]+"
BLANKS = r"[\x20\x09-\x0D]"


def statistics(rows: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """The frame with helper columns, and the FEATURES of a text column as expressions over them.

    Helpers come in steps, so that each value is computed once; a null text counts as empty.
    """
    reduced, parts, lines, marks, n, m, others, chars, upper = names = fresh(rows, "reduced", "parts", "lines", "marks", "n", "m", "others", "chars", "upper")
    t = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumns({reduced: F.regexp_replace(t, SMALL, "a"), parts: F.split(t, SPACE, -1), lines: F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))})
    # Parts at the ends may be empty: they are no words.
    empty = (F.col(parts)[0] == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    blanks, distinct = fresh(rows, "blanks", "distinct")
    rows = rows.withColumns({
        marks: F.regexp_replace(reduced, r"[\p{L}\x20\x09-\x0D]+", ""), n: (F.size(parts) - empty).cast("double"), m: F.size(lines).cast("double"),
        blanks: F.regexp_count(reduced, F.lit(BLANKS)).cast("double"), upper: F.regexp_count(reduced, F.lit(r"\p{Lu}")).cast("double"),
        distinct: (F.size(F.array_distinct(parts)) - (empty > 0).cast("int")).cast("double"),
    })
    one, size = F.lit(1.0), F.length(t).cast("double")
    rows = rows.withColumns({others: F.length(marks).cast("double"), chars: size - F.col(blanks)})
    c, w, k = F.greatest(F.col(chars), one), F.greatest(F.col(n), one), F.greatest(F.col(m), one)
    letters = F.col(chars) - F.col(others)
    drop = lambda chosen: F.regexp_count(marks, F.lit(chosen)).cast("double")
    made = {
        "words": F.col(n),
        "mean_word": c / w,
        "symbols": drop(r"[#*$%&|<>{}~^=\\@_]") / c,
        "marks": drop("[.,;:!?]") / w,
        "digits": drop("[0-9]") / c,
        "capitals": F.col(upper) / F.greatest(letters, one),
        "shouts": drop("!") / w,
        "distinct": F.col(distinct) / w,
        "repeats": F.sqrt(w) * (1 - F.col(distinct) / w),
        "lines": k,
        "same_lines": 1 - F.size(F.array_distinct(lines)) / k,
        "line_words": w / k,
        "ends": F.regexp_count(reduced, F.lit(r"(?md)[.!?\x22')][\x20\x09\x0B-\x0D]*$")) / k,
        "pipes": drop(r"\|") / w,
        "stops": drop(r"\.") / w,
        "spaces": F.col(blanks) / w,
        "doubled": F.regexp_count(reduced, F.lit(r"([!?*#$%&])\1")).cast("double") / w,
        "letters": letters / c,
    }
    held = fresh(rows, *FEATURES)
    rows = rows.withColumns({h: made[f] for h, f in zip(held, FEATURES)}).drop(*names, blanks, distinct)
    return rows, {f: F.col(h) for f, h in zip(FEATURES, held)}


Rule = tuple[tuple[int, bool, float], ...]  # feature, whether over the threshold, threshold


def paths(tree: Tree, so_far: Rule = ()) -> list[Rule]:
    if not isinstance(tree, Split):
        return []
    out = []
    for over, child in ((False, tree.low), (True, tree.high)):
        rule = (*so_far, (tree.feature, over, round(tree.threshold, 9)))
        out += [rule, *paths(child, rule)]
    return out


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for feature, over, threshold in rule:
        ok &= (x[:, feature] > threshold) == over
    return ok


def lasso(z: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with a penalty on the weights' absolute values, by accelerated proximal gradients."""
    n, k = z.shape
    total = w.sum()
    rate = 4.0 / max(np.linalg.norm(np.sqrt(w / total)[:, None] * np.hstack((np.ones((n, 1)), z)), 2) ** 2, 1e-9)
    bias, beta, bias_was, beta_was = 0.0, np.zeros(k), 0.0, np.zeros(k)
    for step in range(1, steps + 1):
        push = (step - 1) / (step + 2)
        b, v = bias + push * (bias - bias_was), beta + push * (beta - beta_was)
        error = w * (1 / (1 + np.exp(-(b + z @ v))) - y) / total
        bias_was, beta_was = bias, beta
        bias = b - rate * error.sum()
        v = v - rate * (z.T @ error)
        beta = np.sign(v) * np.maximum(np.abs(v) - rate * penalty, 0)
    return bias, beta


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for feature, over, threshold in rule:
                x = stats[FEATURES[feature]]
                holds = holds & (x > threshold if over else x <= threshold)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, rounds: int = 24, penalty: float = PENALTY) -> RuleModel:
    if len(np.unique(y)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return RuleModel(float(np.log(share / (1 - share))), ())
    # Both labels weigh the same, as one of them may be rare.
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    trees: Boosted = fit(x, y, rounds=rounds, depth=3, rate=0.3, weights=w)
    rules, columns, seen = [], [], set()
    for tree in trees.trees:
        for rule in paths(tree):
            column = applies(rule, x)
            mark = column.tobytes()
            if mark in seen or (~column).tobytes() in seen or column.all() or not column.any():
                continue
            seen.add(mark)
            rules.append(rule)
            columns.append(column)
    z = np.array(columns, float).T
    bias, beta = lasso(z, y, w, penalty)
    return RuleModel(float(bias), tuple((r, float(b)) for r, b in zip(rules, beta) if b))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """A model of labels 0 and 1 from rows that aren't held out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("y").alias("low"), F.max("y").alias("high")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most SAMPLE rows of three numbers are sent to each executor.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    # One text of each id, so that ids that repeat neither outweigh others nor outgrow the driver.
    rows = rows.withColumn("at", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows, stats = statistics(rows, "text")
    first = rows.groupBy("doc_id").agg(F.min(F.struct("at", F.array(*stats.values()).alias("x"), "low", "high")).alias("v"))
    found = first.select("doc_id", "v.x", "v.low", "v.high").collect()  # SAMPLE rows at most
    found.sort(key=lambda r: r["doc_id"])
    pairs = [(r["x"], y) for r in found for y in sorted({r["low"], r["high"]})]
    x = np.array([x for x, _ in pairs]).reshape(len(pairs), len(FEATURES))
    return fit_rules(np.round(x, 9), np.array([y for _, y in pairs], float))


def scored(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of each row."""
    rows, stats = statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    rows = rows.select("doc_id", model.score(stats).alias("score"))
    return rows.select("doc_id", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows predicted to be good, with all their columns."""
    rows, stats = statistics(docs, text_col)
    score, place = fresh(rows, "score", "place")
    # The row's place keeps the optimizer from copying the statistics into the filter, once for each use.
    rows = rows.select(*docs.columns, model.score(stats).alias(score), F.monotonically_increasing_id().alias(place))
    return rows.where((F.col(score) >= GOOD) & (F.col(place) >= 0)).select(*docs.columns)
