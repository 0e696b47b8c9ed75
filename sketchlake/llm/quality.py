"""Quality rules whose cutoffs have a proven bound on false rejection.

Base features are counted over every whole text. The rules compare ratios of
them with cutoffs from fixed grids. The cutoffs of a stratum come from its own labelled
documents, dealt by a hash of the id into two holdouts. The first one chooses a path of
rule sets, from no rule to ever stricter ones: each step makes one rule stricter, the one
that loses the fewest good documents for bad ones worth it. The second one certifies: along the path, the
hypothesis that more than ``alpha`` of the stratum's good documents would be rejected, by all
rules together, is tested by the exact binomial tail, up to the first step where it
can't be rejected (fixed-sequence testing needs no correction along a path that doesn't depend on the data tested);
across strata the level is shared out (Bonferroni). So with probability 1 - delta no
stratum loses more than alpha of its good documents. Of the certified rule sets the one with the best
balance of bad against good rejections is taken, the more lenient on ties; a stratum with
too few labels to certify any has no rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchlake.llm import kernels as K
from sketchlake.llm.runtime import checkpoint, lean, ship

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(codes: np.ndarray) -> int:
    """Words in three-word windows that the text has twice or more."""
    if len(codes) < 4:
        return 0
    three = K.windows(codes, 3)
    order = np.argsort(three, kind="stable")
    same = three[order][1:] == three[order][:-1]
    if not same.any():
        return 0
    often = np.zeros(len(three), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for i in range(3):
        covered[i : i + len(three)] |= often
    return int(covered.sum())


def _repeated_lines(data: np.ndarray, letters: K.Alphabet) -> int:
    lines = [x for x in data.tobytes().split(b"\n") if x.strip(b"\x20\x09\x0b\x0c\x0d")]
    return len(lines) - len(set(lines))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list[np.ndarray]] = [[] for _ in FEATURES]
        for group in K.groups(batch.column("row").field("text")):
            found = K.words(group, K.PLAIN)
            inside = K.PLAIN.word[group.bytes]
            point = np.concatenate(([0], np.cumsum(inside & ((group.bytes & 0xC0) != 0x80))))
            symbol = np.concatenate(([0], np.cumsum(_SYMBOL[group.bytes])))
            per_text = [(found.hash[a:b], group.bytes[x:y]) for a, b, x, y in zip(found.bounds, found.bounds[1:], group.offsets, group.offsets[1:], strict=False)]
            columns[0].append(np.diff(found.bounds))
            columns[1].append(np.diff(point[group.offsets]))
            columns[2].append(np.diff(symbol[group.offsets]))
            columns[3].append(np.array([_repeated_lines(d, K.PLAIN) for _, d in per_text], np.int64))
            columns[4].append(np.array([_repeated(c) for c, _ in per_text], np.int64))
        arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], ["row", *FEATURES])


def base_features(docs: DataFrame) -> DataFrame:
    """``row`` (the document's own columns) and the base features, ``base_failed`` included. A null text counts as empty."""
    ship(docs.sparkSession)
    schema = T.StructType().add("row", docs.schema)
    for name in FEATURES:
        schema = schema.add(name, "long")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return packed.mapInArrow(lean(_features), schema).withColumn("base_failed", failed)


@dataclass(frozen=True)
class Rule:
    """Rejects where the value lies beyond a cutoff; steps go from lenient to strict, upwards rules having falling cutoffs."""

    name: str
    steps: tuple[float, ...]
    upper: bool = True

    def value(self) -> Column:
        words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
        return {
            "symbols_per_word": F.col("n_symbols") / words,
            "word_length": F.col("word_chars") / words,
            "short_words": F.col("word_chars") / words,
            "repeated_words": F.col("n_repeat_words") / words,
            "repeated_lines": F.col("n_dup_lines") / words,
        }[self.name]

    def beyond(self, cutoff: Column | float) -> Column:
        return self.value() > cutoff if self.upper else self.value() < cutoff


RULES = (
    Rule("symbols_per_word", (5.0, 3.0, 2.5, 2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05)),
    Rule("word_length", (40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0)),
    Rule("short_words", (1.0, 1.5, 2.0, 2.5), upper=False),
    Rule("repeated_words", (0.49, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05)),
    Rule("repeated_lines", (0.5, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.007, 0.005, 0.003)),
)


@dataclass(frozen=True)
class Policy:
    """alpha: share of good documents that all rules together may reject in a stratum; delta: chance that this fails anywhere.

    ``price``: bad rejections that one good rejection must bring.
    """

    alpha: float = 0.05
    delta: float = 0.05
    price: float = 10.0
    rules: tuple[Rule, ...] = field(default=RULES)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly up to rounding.

    Terms are summed downwards from k; those more than fifty standard deviations below are less than the smallest number.
    """
    if k >= n:
        return 1.0
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    down = np.arange(k, max(0, min(k, math.ceil(n * p)) - math.ceil(50 * math.sqrt(n * p * (1 - p))) - 50), -1, dtype=np.float64)
    terms = np.concatenate(([0.0], np.cumsum(np.log(down / (n - down + 1) * ((1 - p) / p)))))
    return float(min(1.0, math.exp(top + terms.max()) * np.exp(terms - terms.max()).sum()))


def certified(good: int, rejected: list[int], alpha: float, delta: float) -> int:
    """How many steps of the path, from the lenient end, are certified; a count over alpha fails without its tail."""
    for i, k in enumerate(rejected):
        if good == 0 or k > alpha * good or binomial_tail(k, good, alpha) > delta:
            return i
    return len(rejected)


def least_good(policy: Policy) -> int:
    """Good documents that a stratum's second holdout needs for any step to be certified, even if it stood alone."""
    return math.ceil(math.log(policy.delta) / math.log1p(-policy.alpha))


def choose_path(kept: np.ndarray, good: np.ndarray, bad: np.ndarray, policy: Policy) -> list[tuple[int, ...]]:
    """Rule sets as numbers of steps taken by each rule, ever stricter.

    Row by row, ``kept`` says how many steps of each rule, from the lenient end, keep the documents of a
    cell, ``good`` and ``bad`` how many there are. A step may pass over some of a grid. Ties go to the earlier rule, then the lenient step.
    """
    state, path = [0] * len(policy.rules), []
    left = np.ones(len(kept), bool)
    while True:
        best = None
        for r, rule in enumerate(policy.rules):
            lost, caught = (np.cumsum(np.bincount(kept[left, r], w[left], len(rule.steps) + 1)) for w in (good, bad))
            for i in range(state[r], len(rule.steps)):
                if caught[i] > policy.price * lost[i] and (best is None or (lost[i], -caught[i]) < best[:2]):
                    best = (lost[i], -caught[i], r, i + 1)
        if best is None:
            return path
        state[best[2]] = best[3]
        left &= kept[:, best[2]] >= best[3]
        path.append(tuple(state))


def certified_rules(kept: np.ndarray, count: np.ndarray, quality: np.ndarray, second: np.ndarray, policy: Policy, level: float) -> dict[str, float]:
    """The cutoffs of one stratum, by rule, from its cells: ``count`` documents each, of a quality and holdout."""
    weight = lambda q, h: np.where((quality == q) & (second == h), count, 0)
    path = choose_path(kept, weight(1, False), weight(0, False), policy)
    rejects = [(kept < np.array(state)).any(1) for state in path]
    lost, caught = ([int(weight(q, True)[r].sum()) for r in rejects] for q in (1, 0))
    steps = certified(int(weight(1, True).sum()), lost, policy.alpha, level)
    best = max(range(steps), key=lambda i: (caught[i] - policy.price * lost[i], -i), default=None)
    if best is None or caught[best] - policy.price * lost[best] <= 0:
        return {}
    return {rule.name: rule.steps[n - 1] for rule, n in zip(policy.rules, path[best], strict=True) if n}


def _certify(policy: Policy, level: float):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        kept = cells[[rule.name for rule in policy.rules]].to_numpy(np.int64)
        found = certified_rules(kept, cells["n"].to_numpy(), cells["quality"].to_numpy(), cells["second"].to_numpy(bool), policy, level)
        return pd.DataFrame({"stratum": [cells["stratum"].iloc[0]] * len(found), "rule": list(found), "cutoff": list(found.values())})

    return run


def calibrate(features: DataFrame, labels: DataFrame, policy: Policy = Policy()) -> tuple[dict[str, dict[str, float]], list[str]]:
    """Cutoffs by stratum and rule (an absent rule or stratum is off), and the strata that were tested, each from its own labels.

    ``features`` has doc_id, stratum and the base features; ``labels`` doc_id and
    quality (1 good, 0 bad; others are ignored; a document with contradicting labels counts as each).
    Documents that stand alike on all grids are counted as one cell first, so a stratum has at most as many cells as the grids'
    product, whatever its labels. Strata with fewer good documents in the second holdout than ``least_good`` can't be certified: their rules stay off, they don't share
    the level, and nothing of them comes to the driver.
    """
    ship(features.sparkSession)
    holdout = features.where("not base_failed").join(labels.where("quality in (0, 1)").select("doc_id", "quality").distinct(), "doc_id")
    keeps = [sum((F.when(rule.beyond(c), 0).otherwise(1) for c in rule.steps), F.lit(0)).alias(rule.name) for rule in policy.rules]
    second = F.pmod(F.xxhash64("doc_id", F.lit("holdout")), F.lit(2)) == 1
    names = [rule.name for rule in policy.rules]
    cells = holdout.select("stratum", "quality", second.alias("second"), *keeps).groupBy("stratum", "quality", "second", *names).agg(F.count("*").alias("n"))
    cells = checkpoint(cells)
    good = F.sum(F.when((F.col("quality") == 1) & F.col("second"), F.col("n")).otherwise(0)).alias("good")
    enough = cells.groupBy("stratum").agg(good).where(F.col("good") >= least_good(policy)).select("stratum")
    tested = sorted(r["stratum"] for r in enough.collect())  # each has least_good labels
    cutoffs: dict[str, dict[str, float]] = {}
    found = cells.where(F.col("stratum").isin(tested)).groupBy("stratum").applyInPandas(_certify(policy, policy.delta / max(1, len(tested))), "stratum string, rule string, cutoff double")
    for row in found.collect():  # a few rows for each stratum tested
        cutoffs.setdefault(row["stratum"], {})[row["rule"]] = row["cutoff"]
    return cutoffs, tested


def with_verdict(features: DataFrame, cutoffs: dict[str, dict[str, float]], policy: Policy = Policy()) -> DataFrame:
    """The features with ``kept``: false where ``base_failed`` or beyond a cutoff of the row's stratum.

    The cutoffs are broadcast, a row per stratum; each stratum has at least ``least_good`` labelled documents.
    """
    names = [rule.name for rule in policy.rules]
    rows = [(s, *[chosen.get(n) for n in names]) for s, chosen in cutoffs.items()]
    table = features.sparkSession.createDataFrame(rows, ", ".join(["stratum string", *[f"_cut_{n} double" for n in names]]))
    ok = ~F.col("base_failed")
    for rule in policy.rules:
        ok = ok & ~F.coalesce(rule.beyond(F.col(f"_cut_{rule.name}")), F.lit(False))
    return features.join(F.broadcast(table), "stratum", "left").select(*[F.col(f"`{c}`") for c in features.columns], ok.alias("kept"))


def judge(features: DataFrame, labels: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The features with ``kept``: false where ``base_failed``, else the verdict of the calibrated rules.

    ``features`` has doc_id, stratum (null counts as "") and the base
    features. Without labels all rules are off. Empty features give no rows.
    """
    features = features.withColumn("stratum", F.coalesce(F.col("stratum"), F.lit("")))
    cutoffs, _ = calibrate(features, labels, policy)
    return with_verdict(features, cutoffs, policy)
