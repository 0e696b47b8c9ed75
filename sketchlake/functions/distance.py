"""Similarity and identity formulas over pair features, as columns.

Features of a pair: xny (shared contexts), n_diff_obj (those whose objects
differ), n_diff_section (differing bases in them), n_mut2 (those with more than
one), x_ctx and y_ctx (distinct contexts of either side).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases of a context, the smoothing term, the naive scale, and the sketch size that the models were fitted at.
CONTEXT_BASES = 22.0
EPSILON = 1e-8
NAIVE_SCALE = 0.1544286
MODEL_SKETCH_SIZE = 10000

#: Fixed values of the context mixture model: weights of (xny, n_diff_section, n_mut2, n_diff_obj) in three denominators, then
#: intercept, the four features, the three reciprocals, and for each reciprocal its products with the first three features.
MOE_DENOMINATORS = (
    (1.0, 0.131595734232788, 1.54251229924664, 0.116283436444129),
    (1.0, 0.456844692517648, 1.44359887460418, 0.493945860006579),
    (1.0, 1.89001465044101, -1.98206480156227, -1.98562980351413),
)
MOE_COEFFICIENTS = (
    -62.5912401461314, -4.63056017218561e-07, -5.94542251217161e-06, -1.88405508374364e-05, 1.6482753400726e-05,
    -121.674835624081, -15.908243723878, 135.912637012686,
    84.3989913963196, 16.1882290423456, 119.887931220681,
    -21.4985877863572, -18.6403364210245, -12.3458956197811,
    -0.305038962888618, 2.98700710443235, -6.58634757454746,
)
#: The same for distances under MOE_NEAR.
MOE_NEAR = 0.05
MOE_NEAR_DENOMINATORS = (
    (1.0, 3.7812662079919, -2.0909314246215, -2.20498028081056),
    (1.0, -1.12941374204415, -0.326323026533379, 1.27424829228824),
    (1.0, -2.38787095655157, 1.29218756210116, 2.71081179958469),
)
MOE_NEAR_COEFFICIENTS = (
    -1.05834423005556, -4.11681306702505e-08, -1.83412193040086e-05, 3.68710040747636e-05, 5.22422757620718e-06,
    30.5002312286384, -150.963243575499, 121.876576325283,
    0.221420061509286, 0.563241174219071, 0.539838644833922,
    1.19759583508643, 0.0691552803067527, -1.28306951996752,
    -0.359874242747578, -0.00075252953123542, -0.525360651962046,
)
#: Fixed values of the alignment-fraction model: as above with x_ctx as fifth feature, and products with the first four.
AF_DENOMINATORS = (
    (2.36775520439829, 2.17036643548818, -0.0977124271437818, -0.251063182363729, 2.19491057829433),
    (1.41850238263675, 2.15224961402778, -2.18587619877498, -2.21943802445092, 0.418474287083788),
    (0.990424249133548, 0.502163745411501, 5.7787290524088, 0.626839640715682, 0.638706160147675),
)
AF_COEFFICIENTS = (
    0.127498260534708, -1.51730137145957e-06, 9.48114616179122e-05, -0.000257916039708839, -7.85253629216324e-05, 1.96482915215685e-06,
    -1475.58996322769, 26.4698377745167, 529.387641078915,
    42.0602258298213, 92.3637001980455, -306.00755719743, -86.3482066935661,
    2.16630645286942, -0.674746089642152, 48.1147600903939, 3.39101087242059,
    -15.5481688297158, -26.7068442368566, 18.5142668221724, 20.4430437567379,
)


def _total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def object_distance(a: Column, b: Column) -> Column:
    """How many two-bit bases of two objects differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x55555555)))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def jaccard(xny: Column, x: Column, y: Column) -> Column:
    return xny / (x + y - xny)


def mash_distance(xny: Column, x: Column, y: Column, k: float = CONTEXT_BASES) -> Column:
    j = jaccard(xny, x, y)
    return F.when(xny > 0, clamp(-F.log(2 * j / (1 + j)) / k)).otherwise(F.lit(1.0))


def containment_distance(xny: Column, x: Column, y: Column, k: float = CONTEXT_BASES) -> Column:
    return F.when((xny > 0) & (F.least(x, y) > 0), clamp(-F.log(xny / F.least(x, y)) / k)).otherwise(F.lit(1.0))


def naive_distance(xny: Column, n_diff_obj: Column, n_diff_section: Column) -> Column:
    ratio = (n_diff_section + EPSILON) / (n_diff_obj + EPSILON)
    last = 1 - F.pow(1 - n_diff_obj / (xny + n_diff_obj), ratio)
    return F.when(xny == 0, F.lit(1.0)).otherwise(F.greatest(last, F.lit(0.0)) * NAIVE_SCALE)


def _rational(features: Sequence[Column], denominators: Sequence[Sequence[float]], coefficients: Sequence[float], crossed: int) -> Column:
    inverse = [1 / (_total([f * w for f, w in zip(features, weights, strict=True)]) + EPSILON) for weights in denominators]
    n = len(features)
    terms = [F.lit(coefficients[0])] + [f * c for f, c in zip(features, coefficients[1:], strict=False)]
    terms += [v * c for v, c in zip(inverse, coefficients[n + 1 :], strict=False)]
    rest = coefficients[n + 1 + len(inverse) :]
    terms += [f * c * v for i, v in enumerate(inverse) for f, c in zip(features[:crossed], rest[crossed * i :], strict=False)]
    return _total(terms)


def mixture_far(xny: Column, n_diff_obj: Column, n_diff_section: Column, n_mut2: Column, sketch_size: int = MODEL_SKETCH_SIZE) -> Column:
    """The mixture model's estimate for distant pairs."""
    scale = MODEL_SKETCH_SIZE / sketch_size
    return _rational([f * scale for f in (xny, n_diff_section, n_mut2, n_diff_obj)], MOE_DENOMINATORS, MOE_COEFFICIENTS, 3)


def mixture_distance(xny: Column, n_diff_obj: Column, n_diff_section: Column, n_mut2: Column, sketch_size: int = MODEL_SKETCH_SIZE, far: Column | None = None) -> Column:
    """The context mixture model; counts are scaled from ``sketch_size`` to the size it was fitted at.

    ``far`` is ``mixture_far`` of the same, where a projection has it already; it is used twice here.
    """
    scale = MODEL_SKETCH_SIZE / sketch_size
    features = [f * scale for f in (xny, n_diff_section, n_mut2, n_diff_obj)]
    far = mixture_far(xny, n_diff_obj, n_diff_section, n_mut2, sketch_size) if far is None else far
    near = _rational(features, MOE_NEAR_DENOMINATORS, MOE_NEAR_COEFFICIENTS, 3)
    return F.when(xny <= 0, F.lit(1.0)).when(n_diff_obj <= 0, F.lit(0.0)).otherwise(F.greatest(F.when(far < MOE_NEAR, near).otherwise(far), F.lit(0.0)))


def aligned_fraction_model(xny: Column, n_diff_obj: Column, n_diff_section: Column, n_mut2: Column, x_ctx: Column, sketch_size: int = MODEL_SKETCH_SIZE) -> Column:
    scale = MODEL_SKETCH_SIZE / sketch_size
    return _rational([f * scale for f in (xny, n_diff_section, n_mut2, n_diff_obj, x_ctx)], AF_DENOMINATORS, AF_COEFFICIENTS, 4)


def metric_and(*distances: Column) -> Column:
    """The largest distance if all are valid (not null), else null."""
    valid = reduce(lambda a, b: a & b, [d.isNotNull() for d in distances])
    return F.when(valid, F.greatest(*distances) if len(distances) > 1 else distances[0])


def metric_or(*distances: Column) -> Column:
    """The smallest valid distance."""
    return F.least(*distances) if len(distances) > 1 else distances[0]


def metric_expression(text: str, metrics: dict[str, Column], limit: int = 4) -> Column:
    """``a``, ``a&b`` or ``a|b`` over named distances; the operators don't mix."""
    if "&" in text and "|" in text:
        raise ValueError("a metric expression has either & or |")
    sign = "&" if "&" in text else "|"
    names = [n.strip() for n in text.split(sign)]
    if len(names) > limit or any(n not in metrics for n in names):
        raise ValueError(f"up to {limit} of {sorted(metrics)}: {text!r}")
    return (metric_and if sign == "&" else metric_or)(*[metrics[n] for n in names])


def density_fraction(xny: Column, threshold: Column, other_threshold: Column, estimate: Column, hash_bits: int) -> Column:
    """Alignment fraction of a side by its estimated number of contexts, at the smaller of both density thresholds."""
    common = (F.least(threshold, other_threshold).cast("double") + 1.0) / F.lit(float(2**hash_bits))
    return clamp(xny / common / estimate)


def latent_breadth(breadth: Column, depth: Column, steps: int = 48) -> Column:
    """The zero-inflated Poisson breadth: pi with pi (1 - exp(-depth / pi)) = breadth, by bisection in [breadth, 1]."""
    seen = lambda pi: F.when(depth / pi > 700.0, pi).otherwise(pi * (1 - F.exp(-depth / pi)))
    start = F.struct(breadth.cast("double").alias("lo"), F.lit(1.0).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) * 0.5
        low = seen(mid) < breadth
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) * 0.5)
    return (
        F.when(breadth <= 0, F.lit(0.0))
        .when(breadth >= 1, F.lit(1.0))
        .when(depth <= 0, breadth)
        .when(breadth <= seen(breadth) + 1e-12, breadth)
        .when(breadth >= seen(F.lit(1.0)) - 1e-12, F.lit(1.0))
        .otherwise(found)
    )


def containment_identity(fraction: Column, k: float = CONTEXT_BASES) -> Column:
    return F.when(fraction > 0, clamp(1 + F.log(F.least(fraction, F.lit(1.0))) / k)).otherwise(F.lit(0.0))


def confidence(raw: Column, calibrated: Column, fraction: Column) -> Column:
    drop = raw - calibrated
    return F.when((fraction < 0.5) | ((raw >= 0.95) & (drop > 0.02)), "low").when(F.abs(drop) > 0.01, "medium").otherwise("high")


def effective_depth(median: Column, mean: Column, latent: Column, cutoff: float = 20.0, exponent: float = 1.05) -> Column:
    return F.when(median >= cutoff, median).when(mean <= 0, F.lit(0.0)).when(latent <= 0, mean).otherwise(mean / F.pow(latent, F.lit(exponent)))
