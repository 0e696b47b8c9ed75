"""Registered queries of the engine's operators over the driver's tables, with the SQL each must agree with.

The tables stand in for sketches: a supplier is a sample, a part a context and
the ordered quantity its object; an order is a read. Nations and regions are the
taxonomy. Reads differ from the references in a share of their objects that depends on the supplier's nation (``reads``).
Cuts are taken from the table at hand (``edge_cut``, ``tenth_largest``), so that both sides of each occur at every scale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchlake.functions import distance as D
from sketchlake.functions.hashing import hash_contexts
from sketchlake.operators import calibrate as C
from sketchlake.operators import call_model as M
from sketchlake.operators import clusters as G
from sketchlake.operators import composite as V
from sketchlake.operators import pairs as P
from sketchlake.operators import readwise as R
from sketchlake.operators import setops as S
from sketchlake.operators import sketch as K
from sketchlake.operators import taxonomy as T
from sketchlake.session import checkpoint

SIZE = 200
DENSITY = 1 << 42
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def r9(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


# --- shared frames and their SQL ---------------------------------------------------------------------------------


_LINE = ("l_suppkey", "l_partkey", "l_quantity")


def raw(spark, d):
    return K.entries(_t(spark, d, "lineitem"), *_LINE)


def clean(spark, d):
    return K.drop_conflicts(raw(spark, d))


def sk(spark, d, k=SIZE):
    return K.build_rows(K.hashed(_t(spark, d, "lineitem"), *_LINE), k)


def samples(spark, d):
    return _t(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("gid"))


def reads(spark, d):
    """Orders as reads. Lines of a nation's suppliers have their objects altered by the nation's number: in none, every second one or all, in one to three bases that references don't use."""
    c = F.col
    kind = F.pmod(c("s_nationkey"), F.lit(5))
    mask = F.when(kind == 0, 0).when(kind == 1, 64 * F.pmod(7 * c("l_suppkey") + c("l_orderkey"), F.lit(2))).when(kind == 2, 64).when(kind == 3, 320).otherwise(1344).cast("int")
    lines = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), c("l_suppkey") == c("s_suppkey"))
    rows = lines.select(c("l_orderkey").cast("long").alias("unit"), c("l_partkey").cast("long").alias("ctx"), c("l_quantity").cast("int").bitwiseXOR(mask).alias("obj")).dropna()
    return hash_contexts(rows, "ctx").select("unit", "hctx", "obj")


_HASH = """h0 AS (SELECT l_suppkey::BIGINT AS gid, l_orderkey::BIGINT AS unit, l_quantity::INTEGER AS obj,
  (xor(l_partkey::UHUGEINT, 11400714819323198485::UHUGEINT) + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM lineitem),
h1 AS (SELECT gid, unit, obj, (xor(x, x >> 30) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM h0),
h2 AS (SELECT gid, unit, obj, (xor(x, x >> 27) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM h1),
rows0 AS (SELECT gid, unit, obj, (xor(x, x >> 31) >> 20)::BIGINT AS hctx FROM h2),
ent AS (SELECT gid, hctx, obj, count(*) AS cnt FROM rows0 GROUP BY gid, hctx, obj),
clean AS (SELECT * FROM ent QUALIFY count(*) OVER (PARTITION BY gid, hctx) = 1),
sk AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY gid ORDER BY hctx, obj) <= 200)"""
_DIST = "bit_count((xor({a}, {b}) | (xor({a}, {b}) >> 1)) & 1431655765)"


def W(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([_HASH, *more]) + "\n" + body


def _features_sql(q: str, r: str, on: str, name: str = "pf", grouped: bool = False) -> str:
    d = _DIST.format(a="q.obj", b="r.obj")
    base = f"SELECT q.gid AS qry, r.gid AS ref, q.hctx, min({d}) AS d FROM {q} q JOIN {r} r ON q.hctx = r.hctx AND {on} GROUP BY 1, 2, 3" if grouped else f"SELECT q.gid AS qry, r.gid AS ref, q.hctx, {d} AS d FROM {q} q JOIN {r} r ON q.hctx = r.hctx AND {on}"
    return f"""m_{name} AS ({base}),
x_{name} AS (SELECT gid, count(DISTINCT hctx) AS n_ctx FROM {q} GROUP BY gid), y_{name} AS (SELECT gid, count(DISTINCT hctx) AS n_ctx FROM {r} GROUP BY gid),
{name} AS (SELECT p.*, x.n_ctx AS x_ctx, y.n_ctx AS y_ctx, p.xny / x.n_ctx AS af_qry, p.xny / y.n_ctx AS af_ref FROM (
  SELECT qry, ref, count(*) AS xny, count(*) FILTER (WHERE d > 0) AS n_diff_obj, sum(d)::BIGINT AS n_diff_section, count(*) FILTER (WHERE d > 1) AS n_mut2 FROM m_{name} GROUP BY 1, 2) p
  JOIN x_{name} x ON x.gid = p.qry JOIN y_{name} y ON y.gid = p.ref)"""


_PF = _features_sql("sk", "sk", "r.gid < q.gid")
_MASH = "CASE WHEN xny > 0 THEN least(greatest(-ln(2 * (xny / (x_ctx + y_ctx - xny)) / (1 + xny / (x_ctx + y_ctx - xny))) / 22.0, 0), 1) ELSE 1.0 END"
_AAF = "CASE WHEN xny > 0 THEN least(greatest(-ln(xny / least(x_ctx, y_ctx)) / 22.0, 0), 1) ELSE 1.0 END"
_NAIVE = "greatest(1 - pow(1 - n_diff_obj / (xny + n_diff_obj), (n_diff_section + 1e-8) / (n_diff_obj + 1e-8)), 0) * 0.1544286"


def _rational_sql(features, denominators, coefficients, crossed) -> str:
    inv = ["(1 / (" + " + ".join(f"{f} * ({w!r}::DOUBLE)" for f, w in zip(features, ws, strict=True)) + " + 1e-8))" for ws in denominators]
    n = len(features)
    terms = [f"({coefficients[0]!r}::DOUBLE)"] + [f"{f} * ({c!r}::DOUBLE)" for f, c in zip(features, coefficients[1:], strict=False)]
    terms += [f"{v} * ({c!r}::DOUBLE)" for v, c in zip(inv, coefficients[n + 1 :], strict=False)]
    rest = coefficients[n + 4 :]
    terms += [f"{f} * ({c!r}::DOUBLE) * {v}" for i, v in enumerate(inv) for f, c in zip(features[:crossed], rest[crossed * i :], strict=False)]
    return "(" + " + ".join(terms) + ")"


_SCALED = [f"({f} * 50.0::DOUBLE)" for f in ("xny", "n_diff_section", "n_mut2", "n_diff_obj")]
_FAR = _rational_sql(_SCALED, D.MOE_DENOMINATORS, D.MOE_COEFFICIENTS, 3)
_NEAR = _rational_sql(_SCALED, D.MOE_NEAR_DENOMINATORS, D.MOE_NEAR_COEFFICIENTS, 3)
_MOE = f"CASE WHEN n_diff_obj <= 0 THEN 0.0 ELSE greatest(CASE WHEN {_FAR} < 0.05 THEN {_NEAR} ELSE {_FAR} END, 0) END"
_AF = _rational_sql([*_SCALED, "(x_ctx * 50.0::DOUBLE)"], D.AF_DENOMINATORS, D.AF_COEFFICIENTS, 4)


def pf(spark, d):
    s = sk(spark, d)
    return P.features(P.matches(s, s, triangle=True), P.context_counts(s))


# --- sketches ----------------------------------------------------------------------------------------------------

_COLS = ("gid", "hctx", "obj")
query("sketch_distinct", W("SELECT gid, hctx, obj FROM ent"))(lambda s, d: raw(s, d).select(*_COLS))
query("sketch_counts", W("SELECT gid, hctx, obj, cnt FROM ent"))(lambda s, d: raw(s, d))
query("conflict_removal", W("SELECT gid, hctx, obj, cnt FROM clean"))(lambda s, d: clean(s, d))
query("bottomk_hash", W("SELECT gid, hctx, obj, cnt FROM sk"))(lambda s, d: sk(s, d))
query("density_threshold_sketch", W(f"SELECT gid, hctx, obj FROM clean WHERE hctx <= {DENSITY}"))(lambda s, d: K.below_density(clean(s, d), DENSITY).select(*_COLS))
query("min_count_filter", W("SELECT gid, hctx, obj, cnt FROM ent WHERE cnt >= 2"))(lambda s, d: K.min_count(raw(s, d), 2))
query(
    "weighted_percentile_cutoff",
    W(
        "SELECT g.gid, coalesce(c.cutoff, 1)::BIGINT AS cutoff FROM (SELECT DISTINCT gid FROM ent) g LEFT JOIN (SELECT gid, min(cnt) AS cutoff FROM r WHERE up >= greatest(ceil(0.97 * tot), 1) GROUP BY gid) c USING (gid)",
        "r AS (SELECT gid, cnt, sum(sum(cnt)) OVER (PARTITION BY gid ORDER BY cnt) AS up, sum(sum(cnt)) OVER (PARTITION BY gid) AS tot FROM ent GROUP BY gid, cnt)",
    ),
)(lambda s, d: K.percentile_cutoffs(raw(s, d), 0.97))
query(
    "count_filtered_sketch",
    W(
        "SELECT e.gid, e.hctx, e.obj, e.cnt FROM ent e JOIN (SELECT gid, min(cnt) AS cutoff FROM r WHERE up >= ceil(0.97 * tot) GROUP BY gid) c USING (gid) WHERE e.cnt >= least(c.cutoff, 2)",
        "r AS (SELECT gid, cnt, sum(sum(cnt)) OVER (PARTITION BY gid ORDER BY cnt) AS up, sum(sum(cnt)) OVER (PARTITION BY gid) AS tot FROM ent GROUP BY gid, cnt)",
    ),
)(lambda s, d: K.filter_counts(raw(s, d), K.percentile_cutoffs(raw(s, d), 0.97, cap=2)))
_DENS = """thr AS (SELECT gid, CASE WHEN count(*) <= 200 THEN 17592186044415 ELSE max(hctx) FILTER (WHERE rn <= 200) END AS threshold
  FROM (SELECT gid, hctx, row_number() OVER (PARTITION BY gid ORDER BY hctx, obj) AS rn FROM clean) GROUP BY gid),
dens AS (SELECT t.gid, t.threshold, (SELECT count(DISTINCT hctx) FROM ent e WHERE e.gid = t.gid AND e.hctx <= t.threshold) AS observed_pre,
  (SELECT count(*) FROM clean e WHERE e.gid = t.gid AND e.hctx <= t.threshold) AS observed_post FROM thr t)"""
_EST = "(CASE WHEN {o} = 0 OR threshold >= 17592186044415 THEN {o} ELSE floor({o} * 17592186044416.0::DOUBLE / (threshold::DOUBLE + 1) + 0.5) END)::BIGINT"
query(
    "ctx_density_estimate", W(f"SELECT gid, threshold, observed_pre, {_EST.format(o='observed_pre')} AS estimate_pre, observed_post, {_EST.format(o='observed_post')} AS estimate_post FROM dens", _DENS)
)(lambda s, d: K.context_densities(raw(s, d), SIZE))
query(
    "density_summary", W("SELECT count(*) AS n_samples, min(threshold) AS min_threshold, arg_min(gid, (threshold, gid)) AS min_gid, max(threshold) AS max_threshold, arg_min(gid, (-threshold, gid)) AS max_gid FROM dens", _DENS)
)(lambda s, d: K.density_summary(K.context_densities(raw(s, d), SIZE)))
_META = """meta AS (SELECT l_suppkey::BIGINT AS gid, sum(len)::BIGINT AS total_bp, count(*) AS n_records, floor(median(len))::BIGINT AS median_bp,
  CASE WHEN count(*) > 1 AND avg(len) > 0 THEN stddev_pop(len) / avg(len) ELSE 0 END AS len_cv,
  CASE WHEN l_suppkey % 2 = 0 THEN max(len) / sum(len) ELSE 0.0 END AS asm_level, l_suppkey % 2 = 0 AS is_fasta FROM (SELECT l_suppkey, l_extendedprice::BIGINT AS len FROM lineitem) GROUP BY l_suppkey)"""


def metadata(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("len", F.round("l_extendedprice").cast("long"))
    return K.input_metadata(rows, "l_suppkey", "len", F.col("gid") % 2 == 0)


query("sample_metadata", ("WITH " + _META + " SELECT gid, total_bp, n_records, median_bp, round(len_cv, 9) AS len_cv, round(asm_level, 9) AS asm_level, is_fasta FROM meta").replace("l_extendedprice::BIGINT", "round(l_extendedprice)::BIGINT"))(
    lambda s, d: metadata(s, d).withColumns({"len_cv": r9("len_cv"), "asm_level": r9("asm_level")})
)
query("sample_annotation", "SELECT s_suppkey::BIGINT AS gid, s_name || ' ' || n_name AS annotation FROM supplier JOIN nation ON s_nationkey = n_nationkey")(
    lambda s, d: K.annotation(_t(s, d, "supplier").join(_t(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), "s_suppkey", "s_suppkey", F.concat_ws(" ", "s_name", "n_name"))
)
query("inspect_samples", W("SELECT s.s_suppkey::BIGINT AS gid, coalesce(e.n, 0) AS n_entries, coalesce(e.c, 0) AS n_ctx FROM supplier s LEFT JOIN (SELECT gid, count(*) AS n, count(DISTINCT hctx) AS c FROM ent GROUP BY gid) e ON e.gid = s.s_suppkey"))(
    lambda s, d: K.sizes(raw(s, d), samples(s, d))
)
query("inspect_content", W("SELECT gid, lower(lpad(to_hex(hctx), 11, '0')) AS ctx_hex, lower(lpad(to_hex(obj), 5, '0')) AS obj_hex FROM sk"))(
    lambda s, d: sk(s, d).select("gid", F.lower(F.lpad(F.hex("hctx"), 11, "0")).alias("ctx_hex"), F.lower(F.lpad(F.hex("obj"), 5, "0")).alias("obj_hex"))
)
query("sorted_index", W("SELECT hctx, count(*) AS n_entries, count(DISTINCT gid) AS n_samples, min(gid) AS first_gid, count(DISTINCT gid) = 1 AS marker FROM ent GROUP BY hctx"))(lambda s, d: K.context_index(raw(s, d)))
query("sample_index", W("SELECT gid, count(*) AS n_ctx, count(*) FILTER (WHERE k > 1) AS n_conflict FROM (SELECT gid, hctx, count(*) AS k FROM ent GROUP BY 1, 2) GROUP BY gid"))(lambda s, d: K.sample_index(raw(s, d)))
query("count_histogram", W("SELECT gid, cnt, count(*) AS n FROM ent GROUP BY gid, cnt"))(lambda s, d: K.count_histogram(raw(s, d)))

# --- pairs -------------------------------------------------------------------------------------------------------

_INTS = ("qry", "ref", "xny", "n_diff_obj", "n_diff_section", "n_mut2", "x_ctx", "y_ctx")
_ILIST = ", ".join(_INTS)
query("pair_features", W(f"SELECT {_ILIST} FROM pf", _PF))(lambda s, d: pf(s, d).select(*_INTS))


def conflict_features(s, d):
    e = K.bottom_k(raw(s, d), SIZE)
    return P.features(P.matches(e, e, triangle=True, conflicts=True), P.context_counts(e)).select(*_INTS)


_BK = "bk AS (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY gid ORDER BY hctx, obj) <= 200)"
query("pair_features_conflict_min", W(f"SELECT {_ILIST} FROM cf", _BK, _features_sql("bk", "bk", "r.gid < q.gid", "cf", True)))(conflict_features)


def ignoring(s, d):
    return P.list_features(K.bottom_k(raw(s, d), SIZE), others=True, conflicts=True).select(*_INTS)


query("ignore_conflict_features", W(f"SELECT {_ILIST} FROM cf", _BK, "bc AS (SELECT * FROM bk QUALIFY count(*) OVER (PARTITION BY gid, hctx) = 1)", _features_sql("bk", "bc", "r.gid <> q.gid", "cf", True)))(ignoring)
query("align_fractions", W("SELECT qry, ref, round(af_qry, 9) AS af_qry, round(af_ref, 9) AS af_ref FROM pf", _PF))(lambda s, d: pf(s, d).select("qry", "ref", r9("af_qry").alias("af_qry"), r9("af_ref").alias("af_ref")))


def density_af(s, d):
    den = K.context_densities(raw(s, d), SIZE)
    q, r = (den.select(F.col("gid").alias(n), F.col("threshold").alias(f"t_{n}"), F.col("estimate_post").alias(f"e_{n}")) for n in ("qry", "ref"))
    j = pf(s, d).join(q, "qry").join(r, "ref")
    return j.select("qry", "ref", r9(D.density_fraction(F.col("xny"), F.col("t_qry"), F.col("t_ref"), F.col("e_qry"), 44)).alias("af_qry"), r9(D.density_fraction(F.col("xny"), F.col("t_ref"), F.col("t_qry"), F.col("e_ref"), 44)).alias("af_ref"))


_DAF = "round(least(greatest(xny / ((least(a.threshold, b.threshold)::DOUBLE + 1) / 17592186044416.0::DOUBLE) / {e}.est, 0), 1), 9)"
query("density_af", W(f"SELECT qry, ref, {_DAF.format(e='a')} AS af_qry, {_DAF.format(e='b')} AS af_ref FROM pf JOIN de a ON a.gid = qry JOIN de b ON b.gid = ref", _PF, _DENS, f"de AS (SELECT gid, threshold, {_EST.format(o='observed_post')} AS est FROM dens)"))(density_af)


def metric(name):
    return lambda s, d: pf(s, d).select("qry", "ref", F.round(P.metric_columns(SIZE)[name], 7).alias("distance"))


def mixture(pairs):
    counts = [F.col(c) for c in ("xny", "n_diff_obj", "n_diff_section", "n_mut2")]
    return pairs.withColumn("_far", D.mixture_far(*counts, SIZE)).withColumn("distance", D.mixture_distance(*counts, SIZE, F.col("_far")))


query("mash_distance", W(f"SELECT qry, ref, round({_MASH}, 7) AS distance FROM pf", _PF))(metric("mash"))
query("aaf_distance", W(f"SELECT qry, ref, round({_AAF}, 7) AS distance FROM pf", _PF))(metric("aaf"))
query("naive_distance", W(f"SELECT qry, ref, round({_NAIVE}, 7) AS distance FROM pf", _PF))(metric("ctx-naive"))
query("ctx_moe_distance", W(f"SELECT qry, ref, round({_MOE}, 6) AS distance FROM pf", _PF))(lambda s, d: mixture(pf(s, d)).select("qry", "ref", F.round("distance", 6).alias("distance")))
query("blastn_af", W(f"SELECT qry, ref, round({_AF}, 5) AS af FROM pf", _PF))(
    lambda s, d: pf(s, d).select("qry", "ref", F.round(D.aligned_fraction_model(F.col("xny"), F.col("n_diff_obj"), F.col("n_diff_section"), F.col("n_mut2"), F.col("x_ctx"), SIZE), 5).alias("af"))
)
for _name, _expr, _sql in (("metric_expr_and", "mash&aaf&ctx-naive", f"greatest({_MASH}, {_AAF}, {_NAIVE})"), ("metric_expr_or", "mash|aaf|ctx-naive", f"least({_MASH}, {_AAF}, {_NAIVE})")):
    query(_name, W(f"SELECT qry, ref, round({_sql}, 7) AS distance FROM pf", _PF))(lambda s, d, e=_expr: pf(s, d).select("qry", "ref", F.round(D.metric_expression(e, P.metric_columns(SIZE)), 7).alias("distance")))


def topn(s, d):
    k = sk(s, d)
    both = P.features(P.matches(k, k).where("qry <> ref"), P.context_counts(k))
    rounded = both.withColumn("ani", F.round(1 - P.metric_columns(SIZE)["mash"], 9)).withColumn("max_af", r9(F.greatest("af_qry", "af_ref"))).where("max_af >= 0.2 and xny >= 3")
    return S.rank_in_group(rounded, "qry", F.desc("ani"), F.desc("max_af"), F.asc("ref")).where("rank <= 5").select("qry", F.col("rank").cast("long").alias("rank"), "ref", "xny", "ani", "max_af")


query(
    "topn_per_query",
    W(
        "SELECT qry, row_number() OVER (PARTITION BY qry ORDER BY ani DESC, max_af DESC, ref) AS rank, ref, xny, ani, max_af FROM s WHERE max_af >= 0.2 AND xny >= 3 QUALIFY rank <= 5",
        _features_sql("sk", "sk", "r.gid <> q.gid"), f"s AS (SELECT qry, ref, xny, round(1 - {_MASH}, 9) AS ani, round(greatest(af_qry, af_ref), 9) AS max_af FROM pf)",
    ),
)(topn)
query("matrix_triangle", W(f"SELECT qry, ref, xny, round({_AAF}, 7) AS distance FROM pf", _PF))(lambda s, d: pf(s, d).select("qry", "ref", "xny", F.round(P.metric_columns(SIZE)["aaf"], 7).alias("distance")))


def matrix(s, d):
    return P.full_matrix(P.triangle_features(checkpoint(sk(s, d).select(*_COLS))), samples(s, d), F.round(P.metric_columns(SIZE)["mash"], 7))


query(
    "matrix_full_long",
    W(
        "SELECT a.s_suppkey::BIGINT AS row, b.s_suppkey::BIGINT AS col, CASE WHEN a.s_suppkey = b.s_suppkey THEN 0.0 ELSE coalesce(m.distance, 1.0) END::DOUBLE AS distance FROM supplier a CROSS JOIN supplier b LEFT JOIN m ON m.qry = greatest(a.s_suppkey, b.s_suppkey) AND m.ref = least(a.s_suppkey, b.s_suppkey)",
        _PF, f"m AS (SELECT qry, ref, round({_MASH}, 7) AS distance FROM pf)",
    ),
)(matrix)
def edge_cut(pairs, distance, share=0.01):
    """The distance, in steps of 1e-5, below which a share of the pairs lies (one pair at least), from a histogram of steps."""
    steps = pairs.select(F.floor(F.round(distance, 7) * 100000).alias("step")).groupBy("step").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("step"))  # 100,000 rows at most
    reached = steps.withColumn("reached", upto >= F.greatest(F.lit(1.0), F.lit(share) * F.sum("n").over(Window.partitionBy())))
    return ((reached.where("reached").agg(F.min("step")).first()[0] or 0) + 1) / 100000


def tenth_largest(rows, name):
    found = rows.select(name).orderBy(F.desc(name)).limit(10).collect()
    return found[-1][0] if found else 0


def edge_rows(s, d):
    pairs = checkpoint(pf(s, d))
    return P.edges(pairs, "mash", SIZE, edge_cut(pairs, P.metric_columns(SIZE)["mash"]), 3)


_CUT = f"""cu AS (SELECT (min(step) FILTER (WHERE upto >= greatest(1, 0.01 * n)) + 1) / 100000.0::DOUBLE AS cut FROM (
  SELECT step, sum(count(*)) OVER (ORDER BY step) AS upto, sum(count(*)) OVER () AS n FROM (SELECT floor(round({_MASH}, 7) * 100000)::BIGINT AS step FROM pf) GROUP BY step))"""
_EDGES = f"{_CUT},\ned AS (SELECT qry AS a, ref AS b, {_MASH} AS distance, xny, greatest(af_qry, af_ref) AS max_af FROM pf WHERE {_MASH} < (SELECT cut FROM cu) AND xny >= 3)"
query("sparse_edges", W("SELECT a, b, round(distance, 7) AS distance, xny, round(max_af, 9) AS max_af FROM ed", _PF, _EDGES))(lambda s, d: edge_rows(s, d).select("a", "b", F.round("distance", 7).alias("distance"), "xny", r9("max_af").alias("max_af")))
query(
    "indexed_candidates",
    W(
        "SELECT q.gid AS qry, r.gid AS ref, count(*) AS votes FROM u q JOIN u r ON q.hctx = r.hctx AND r.gid < q.gid GROUP BY 1, 2 HAVING count(*) >= 2",
        "u AS (SELECT DISTINCT gid, hctx FROM sk WHERE hctx IN (SELECT hctx FROM sk GROUP BY hctx HAVING count(DISTINCT gid) <= 256))",
    ),
)(lambda s, d: P.candidates(sk(s, d), 256, 2))
query("indexed_candidates_exact", W("SELECT q.gid AS qry, r.gid AS ref, count(*) AS votes FROM sk q JOIN sk r ON q.hctx = r.hctx AND r.gid < q.gid GROUP BY 1, 2"))(lambda s, d: P.candidates(sk(s, d)))
_TENTH = "(SELECT min(xny) FROM (SELECT xny FROM pf ORDER BY xny DESC LIMIT 10))"


def nominated(s, d):
    """Pairs with as many votes as the tenth best, or more."""
    votes = checkpoint(P.candidates(sk(s, d)))
    return P.verified(votes.where(F.col("votes") >= tenth_largest(votes, "votes")), sk(s, d)).select(*_INTS)


query("nominated_pair_features", W(f"SELECT {_ILIST} FROM pf WHERE xny >= {_TENTH}", _PF))(nominated)
_COMP = """node AS (SELECT s_suppkey::BIGINT AS gid FROM supplier),
bi AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
reach AS (SELECT gid, gid AS other FROM node UNION SELECT r.gid, bi.b FROM reach r JOIN bi ON bi.a = r.other),
comp AS (SELECT gid, min(other) AS component FROM reach GROUP BY gid)"""
query("connected_components", W("SELECT gid, component FROM comp", _PF, _EDGES, _COMP))(lambda s, d: G.components(samples(s, d), edge_rows(s, d)))


def quality(s, d):
    n = sk(s, d).groupBy("gid").agg(F.count("*").alias("n_entries"))
    return samples(s, d).join(metadata(s, d), "gid", "left").join(n, "gid", "left").fillna(0, ["total_bp", "n_records", "median_bp", "n_entries"]).select("gid", *G.QUALITY)


query(
    "representatives",
    W(
        "SELECT c.gid, c.component, count(*) OVER (PARTITION BY c.component) AS size, first_value(c.gid) OVER (PARTITION BY c.component ORDER BY m.is_fasta DESC, m.asm_level DESC, m.total_bp DESC, m.n_records ASC, m.median_bp DESC, m.len_cv ASC, c.gid) AS representative FROM comp c JOIN meta m ON m.gid = c.gid",
        _PF, _EDGES, _COMP, _META.replace("l_extendedprice::BIGINT", "round(l_extendedprice)::BIGINT"),
    ),
)(lambda s, d: G.representatives(quality(s, d), edge_rows(s, d)))
_ORDERED = [
    _PF, _EDGES, _META.replace("l_extendedprice::BIGINT", "round(l_extendedprice)::BIGINT"),
    """ql AS (SELECT s_suppkey::BIGINT AS gid, coalesce(total_bp, 0) AS total_bp, is_fasta, asm_level, coalesce(m.n_records, 0) AS n_records, coalesce(median_bp, 0) AS median_bp, len_cv, coalesce(e.n, 0) AS n_entries,
  coalesce(total_bp, 0) > 0 AS ok FROM supplier LEFT JOIN meta m ON m.gid = s_suppkey LEFT JOIN (SELECT gid, count(*) AS n FROM sk GROUP BY gid) e ON e.gid = s_suppkey)""",
    """pl AS (SELECT *, row_number() OVER (ORDER BY ok DESC, CASE WHEN ok THEN is_fasta END DESC, CASE WHEN ok THEN asm_level END DESC NULLS LAST, CASE WHEN ok THEN total_bp END DESC,
  CASE WHEN ok AND n_records > 0 THEN n_records END ASC NULLS LAST, CASE WHEN ok THEN median_bp END DESC, CASE WHEN ok THEN len_cv END ASC NULLS LAST, n_entries DESC, gid) AS place FROM ql)""",
    "nb AS (SELECT x.place, list(y.place) AS near FROM (SELECT a, b FROM ed UNION SELECT b, a FROM ed) t JOIN pl x ON x.gid = t.a JOIN pl y ON y.gid = t.b GROUP BY 1)",
    "al AS (SELECT pl.place, coalesce(near, []) AS near FROM pl LEFT JOIN nb USING (place))",
    "gr AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT al.place, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, al.place) END FROM gr JOIN al ON al.place = gr.i + 1)",
    "kp AS (SELECT unnest(kept) AS place FROM (SELECT kept FROM gr ORDER BY i DESC LIMIT 1))",
    """gd AS (SELECT p.gid, r.gid AS representative FROM (SELECT al.place, CASE WHEN al.place IN (SELECT place FROM kp) THEN al.place ELSE (SELECT min(n) FROM (SELECT unnest(al.near) AS n) WHERE n IN (SELECT place FROM kp)) END AS rep FROM al) t
  JOIN pl p ON p.place = t.place JOIN pl r ON r.place = t.rep)""",
]
query("greedy_dedup", W("SELECT gid, representative, gid <> representative AS removed FROM gd", *_ORDERED))(lambda s, d: G.greedy(quality(s, d), edge_rows(s, d)))
_CLIQUES = [
    "fl AS (SELECT 0::BIGINT AS i, []::BIGINT[][] AS cl UNION ALL SELECT al.place, CASE WHEN q IS NULL OR q = 0 THEN list_append(cl, [al.place]) ELSE list_transform(cl, lambda x, j: CASE WHEN j = q THEN list_append(x, al.place) ELSE x END) END"
    " FROM (SELECT fl.*, al.place, list_position(list_transform(cl, lambda x: list_has_all(near, x)), true) AS q FROM fl JOIN al ON al.place = fl.i + 1) al)",
    "fc AS (SELECT unnest(cl) AS c FROM (SELECT cl FROM fl ORDER BY i DESC LIMIT 1))",
]
query("full_linkage_dedup", W("SELECT p.gid, r.gid AS representative, p.gid <> r.gid AS removed FROM (SELECT unnest(c) AS place, c[1] AS rep FROM fc) t JOIN pl p ON p.place = t.place JOIN pl r ON r.place = t.rep", *_ORDERED, *_CLIQUES))(
    lambda s, d: G.full_linkage(quality(s, d), checkpoint(edge_rows(s, d)))
)
_RULE = "CASE WHEN x.gid = y.gid THEN 'representative' WHEN x.ok <> y.ok THEN 'metadata' " + " ".join(f"WHEN x.ok AND x.{c} <> y.{c} THEN '{c}'" for c in ("is_fasta", "asm_level", "total_bp", "n_records", "median_bp", "len_cv")) + " WHEN x.n_entries <> y.n_entries THEN 'n_entries' ELSE 'gid' END"
query(
    "dedup_plan",
    W(
        f"SELECT gd.gid, 'cluster_' || lpad(n::VARCHAR, 6, '0') AS cluster, cluster_size, gd.representative, gd.gid = gd.representative AS kept, {_RULE} AS rule FROM gd JOIN cz USING (representative) JOIN ql x ON x.gid = gd.gid JOIN ql y ON y.gid = gd.representative",
        *_ORDERED, "cz AS (SELECT representative, count(*) AS cluster_size, row_number() OVER (ORDER BY min(gid)) AS n FROM gd GROUP BY representative)",
    ),
)(lambda s, d: G.dedup_plan(quality(s, d), G.greedy(quality(s, d), edge_rows(s, d))))


def markers_after_dedup(s, d):
    """Every kept sample, also one without markers."""
    kept = checkpoint(G.greedy(quality(s, d), edge_rows(s, d)).where("not removed").select("gid"))
    n = S.context_markers(S.keep(sk(s, d), kept)).groupBy("gid").agg(F.count("*").alias("n_markers"))
    return kept.join(n, "gid", "left").fillna(0, ["n_markers"])


query(
    "predicted_markers_after_dedup",
    W(
        "SELECT k.gid, coalesce(n, 0) AS n_markers FROM ks k LEFT JOIN (SELECT gid, count(*) AS n FROM km WHERE hctx IN (SELECT hctx FROM km GROUP BY hctx HAVING count(DISTINCT gid) = 1) GROUP BY gid) c USING (gid)",
        *_ORDERED, "ks AS (SELECT gid FROM gd WHERE gid = representative)", "km AS (SELECT sk.* FROM sk JOIN ks USING (gid))",
    ),
)(markers_after_dedup)

# --- set operations ------------------------------------------------------------------------------------------------

_PAN = "pan AS (SELECT DISTINCT hctx, obj FROM sk WHERE gid % 3 = 0)"


def pan(s, d):
    return S.union_pan(sk(s, d).where("gid % 3 = 0"))


query("set_union", W("SELECT DISTINCT hctx, obj FROM sk"))(lambda s, d: S.union_pan(sk(s, d)))
query("unique_union", W("SELECT hctx, obj FROM sk GROUP BY hctx, obj HAVING count(*) = 1"))(lambda s, d: S.unique_pan(sk(s, d)))
query("markerdb", W("SELECT min(gid) AS gid, hctx, obj FROM sk GROUP BY hctx, obj HAVING count(*) = 1"))(lambda s, d: S.markers(sk(s, d)))
query("ctx_markerdb", W("SELECT gid, hctx, obj FROM tw WHERE hctx IN (SELECT hctx FROM tw GROUP BY hctx HAVING count(DISTINCT gid) <= 1)", "tw AS (SELECT * FROM ent WHERE cnt >= 2)"))(lambda s, d: S.context_markers(K.min_count(raw(s, d), 2)))
query(
    "pairwise_ctx_markerdb",
    W(
        "SELECT gid, hctx, obj FROM sk WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.gid = sk.gid AND dr.hctx = sk.hctx)", _PF,
        f"nr AS (SELECT qry, ref FROM pf WHERE xny >= {_TENTH})", "sh AS (SELECT m.qry, m.ref, m.hctx FROM m_pf m JOIN nr USING (qry, ref))", "dr AS (SELECT qry AS gid, hctx FROM sh UNION SELECT ref, hctx FROM sh)",
    ),
)(lambda s, d: S.pairwise_context_markers(sk(s, d), tenth_largest(P.candidates(sk(s, d)), "votes")))
_MK = "mk0 AS (SELECT s.s_suppkey::BIGINT AS gid, coalesce(m.n, 0) AS n_markers FROM supplier s LEFT JOIN (SELECT gid, count(*) AS n FROM (SELECT min(gid) AS gid FROM sk GROUP BY hctx, obj HAVING count(*) = 1) GROUP BY gid) m ON m.gid = s.s_suppkey)"


def few_markers(s, d):
    """Samples with fewer markers than the samples' mean, which is a whole number."""
    found = checkpoint(S.markers(sk(s, d)))
    return S.small_markers(samples(s, d), found, found.count() // max(1, samples(s, d).count()))


query("small_marker_report", W("SELECT gid, n_markers FROM mk0 WHERE n_markers < (SELECT sum(n_markers) // count(*) FROM mk0)", _MK))(few_markers)
query("intersect_pan", W("SELECT gid, hctx, obj FROM sk SEMI JOIN pan USING (hctx, obj)", _PAN))(lambda s, d: S.intersect(sk(s, d), pan(s, d)))
query("subtract_pan", W("SELECT gid, hctx, obj FROM sk ANTI JOIN pan USING (hctx, obj)", _PAN))(lambda s, d: S.subtract(sk(s, d), pan(s, d)))
query("downsample", W("SELECT gid, hctx, obj FROM sk QUALIFY row_number() OVER (PARTITION BY gid ORDER BY hctx, obj) <= 50"))(lambda s, d: S.downsample(sk(s, d), 50, SIZE).select(*_COLS))
query("append", W("SELECT gid, hctx, obj FROM sk UNION ALL SELECT gid + (SELECT max(gid) + 1 FROM sk), hctx, obj FROM sk WHERE gid % 2 = 0"))(lambda s, d: S.append(sk(s, d).select(*_COLS), sk(s, d).where("gid % 2 = 0").select(*_COLS)))


def listed(s, d):
    return _t(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").cast("long").alias("gid"))


query("keep_samples", W("SELECT gid, hctx, obj FROM sk WHERE gid IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)"))(lambda s, d: S.keep(sk(s, d), listed(s, d), samples(s, d)).select(*_COLS))
query("remove_samples", W("SELECT gid, hctx, obj FROM sk WHERE gid NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)"))(lambda s, d: S.remove(sk(s, d), listed(s, d), samples(s, d)).select(*_COLS))
query("group_samples", W("SELECT DISTINCT s_nationkey::BIGINT AS taxid, hctx, obj FROM sk JOIN supplier ON s_suppkey = gid WHERE s_nationkey <> 0"))(
    lambda s, d: S.group_samples(sk(s, d), _t(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("gid"), F.col("s_nationkey").cast("long").alias("taxid")))
)

# --- read profiling ------------------------------------------------------------------------------------------------

_READS = """rd AS (SELECT DISTINCT unit, hctx, xor(obj, CASE s_nationkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 64 * ((7 * gid + unit) % 2) WHEN 2 THEN 64 WHEN 3 THEN 320 ELSE 1344 END)::INTEGER AS obj
  FROM rows0 JOIN supplier ON s_suppkey = gid)"""
_CAND = f"""{_READS},
cd AS (SELECT q.unit, q.hctx, r.gid, min({_DIST.format(a="q.obj", b="r.obj")}) AS d FROM rd q JOIN sk r ON q.hctx = r.hctx GROUP BY 1, 2, 3),
mk AS (SELECT *, min(d) OVER w AS best, count(*) OVER w AS n_candidates FROM cd WINDOW w AS (PARTITION BY unit, hctx)),
mb AS (SELECT *, count(*) FILTER (WHERE d = best) OVER (PARTITION BY unit, hctx) AS n_best FROM mk),
as_all AS (SELECT *, 1 AS inc FROM mb), as_best AS (SELECT *, 1 AS inc FROM mb WHERE d = best), as_unique AS (SELECT *, 1 AS inc FROM mb WHERE d = best AND n_best = 1),
as_split AS (SELECT *, ((1024 + n_best // 2) // n_best)::BIGINT AS inc FROM mb WHERE d = best)"""
_SUPPORT = "SELECT gid, count(*) AS hits, count(DISTINCT unit) AS units, count(DISTINCT hctx) AS ctx_hit, count(*) FILTER (WHERE d > 0) AS hits_diff, sum(d)::BIGINT AS hits_section, count(*) FILTER (WHERE d > 1) AS hits_mut2 FROM {a} GROUP BY gid"


def assigned(s, d, mode, marked=True):
    """The sketch is written once, as both joins read it."""
    return R.matched(reads(s, d), checkpoint(sk(s, d)), mode, marked)


def supported(s, d, mode):
    """All candidates are joined again rather than written; the nearest are few."""
    return R.support(assigned(s, d, mode, marked=False) if mode == "all" else checkpoint(assigned(s, d, mode).select("unit", "hctx", "gid", "d")))


for _name, _mode, _view in (("best_diff_all", "all", "as_all"), ("best_diff", "best-diff", "as_best"), ("best_diff_unique", "best-diff-unique", "as_unique"), ("best_diff_split", "best-diff-split", "as_split")):
    query(_name, W(_SUPPORT.format(a=_view), _CAND))(lambda s, d, m=_mode: supported(s, d, m))


def _cov_sql(view: str, name: str) -> str:
    return f"{name} AS (SELECT gid, hctx, least(sum(inc), 268435455)::BIGINT AS cov, least(min(d), 14)::INTEGER AS diff, max(inc)::BIGINT AS weight FROM {view} GROUP BY gid, hctx)"


_COV = _cov_sql("as_split", "cv")
_UCOV = _cov_sql("as_unique", "cu")


def split_cov(s, d):
    """The narrow waist of all profiles, written once: what follows reads it several times."""
    return checkpoint(R.covered(reads(s, d), checkpoint(sk(s, d)), "best-diff-split"))


query("ref_coverage", W("SELECT gid, hctx, cov, diff, weight FROM cv", _CAND, _COV))(split_cov)
query("best_features", W("SELECT gid, count(*) AS xny, count(*) FILTER (WHERE diff > 0) AS n_diff_obj, sum(diff)::BIGINT AS n_diff_section, count(*) FILTER (WHERE diff > 1) AS n_mut2 FROM cv GROUP BY gid", _CAND, _COV))(lambda s, d: R.features(split_cov(s, d)))


def _depth_sql(cov: str, ref: str, scale: int, name: str) -> str:
    return f"""t_{name} AS (SELECT gid, count(DISTINCT hctx) AS total FROM {ref} GROUP BY gid),
b_{name} AS (SELECT t.gid, t.total, coalesce(c.s, 0) AS s, coalesce(c.q, 0) AS q, coalesce(c.hit, 0) AS hit FROM t_{name} t LEFT JOIN (
  SELECT gid, sum(cov / {scale}.0::DOUBLE) AS s, sum((cov / {scale}.0::DOUBLE) * (cov / {scale}.0::DOUBLE)) AS q, sum(least(weight / {scale}.0::DOUBLE, 1)) AS hit FROM {cov} GROUP BY gid) c USING (gid)),
{name} AS (SELECT gid, total, hit / total AS breadth, s / total AS mean_depth, CASE WHEN hit > 0 THEN s / hit ELSE 0 END AS hit_mean_depth, greatest(q / total - (s / total) * (s / total), 0) AS variance,
  CASE WHEN s > 0 THEN sqrt(greatest(q / total - (s / total) * (s / total), 0)) / (s / total) ELSE 0 END AS depth_cv, 1 - hit / total AS zero_fraction, (s / total) / sum(s / total) OVER () AS relative_depth FROM b_{name})"""


_DEPTHS = ("breadth", "mean_depth", "hit_mean_depth", "variance", "depth_cv", "zero_fraction", "relative_depth")
_DLIST = ", ".join(f"round({c}, 7) AS {c}" for c in _DEPTHS)
_DP = _depth_sql("cv", "sk", 1024, "dp")


def depths(s, d, cov=None):
    cov = split_cov(s, d) if cov is None else cov
    return R.depth(cov, R.totals(sk(s, d)), R.SPLIT_SCALE)


def _rounded(rows, keys):
    return rows.select(*keys, *[F.round(c, 7).alias(c) for c in _DEPTHS])


query("depth_abundance", W(f"SELECT gid, total, {_DLIST} FROM dp", _CAND, _COV, _DP))(lambda s, d: _rounded(depths(s, d), ["gid", "total"]))


def marker_depths(s, d):
    ref = sk(s, d)
    only = R.marker_contexts(ref)
    return _rounded(R.depth(split_cov(s, d).join(only, "hctx", "left_semi"), R.totals(ref.join(only, "hctx", "left_semi")), R.SPLIT_SCALE), ["gid", "total"])


query(
    "marker_depth_abundance",
    W(f"SELECT gid, total, {_DLIST} FROM md", _CAND, _COV, "mc AS (SELECT hctx FROM sk GROUP BY hctx HAVING count(DISTINCT gid) = 1)", "mr AS (SELECT * FROM sk SEMI JOIN mc USING (hctx))", "mcv AS (SELECT * FROM cv SEMI JOIN mc USING (hctx))", _depth_sql("mcv", "mr", 1024, "md")),
)(marker_depths)
_TOP = """pr AS (SELECT gid, hctx, cov, diff, weight, diff * (cov / 1024.0::DOUBLE) AS product FROM cv WHERE cov > 0),
tf AS (SELECT gid, sort_p[len(sort_p) - least(greatest(ceil(len(sort_p) * 0.25), 1), len(sort_p))::BIGINT + 1] AS threshold, sort_d[(len(sort_d) - 1) // 2 + 1]::INTEGER AS median_diff, sort_c[(len(sort_c) - 1) // 2 + 1] AS median_cov
  FROM (SELECT gid, list_sort(list(product)) AS sort_p, list_sort(list(diff)) AS sort_d, list_sort(list(cov / 1024.0::DOUBLE)) AS sort_c FROM pr GROUP BY gid))"""
query("topfrac_thresholds", W("SELECT gid, threshold, median_diff, median_cov FROM tf", _CAND, _COV, _TOP))(lambda s, d: R.top_fraction(split_cov(s, d), 0.25, R.SPLIT_SCALE).select("gid", "threshold", "median_diff", "median_cov"))
query(
    "topfrac_median",
    W(
        "SELECT gid, count(*) AS xny, count(*) FILTER (WHERE f > 0) AS n_diff_obj, sum(f)::BIGINT AS n_diff_section, count(*) FILTER (WHERE f > 1) AS n_mut2 FROM (SELECT p.gid, CASE WHEN product > 0 AND product >= threshold THEN median_diff ELSE diff END AS f FROM pr p JOIN tf USING (gid)) GROUP BY gid",
        _CAND, _COV, _TOP,
    ),
)(lambda s, d: R.features(R.filter_top_fraction(split_cov(s, d), 0.25, R.SPLIT_SCALE)))
query(
    "topfrac_reject",
    W("SELECT gid, count(*) AS xny, count(*) FILTER (WHERE diff > 0) AS n_diff_obj, sum(diff)::BIGINT AS n_diff_section, count(*) FILTER (WHERE diff > 1) AS n_mut2 FROM pr JOIN tf USING (gid) WHERE NOT (product > 0 AND product >= threshold) OR diff = 0 GROUP BY gid", _CAND, _COV, _TOP),
)(lambda s, d: R.features(R.filter_top_fraction(split_cov(s, d), 0.25, R.SPLIT_SCALE, median=False)))
query("product_nb_filter")(lambda s, d: R.filter_product_nb(split_cov(s, d), R.totals(sk(s, d)), 0.5, R.SPLIT_SCALE).groupBy("gid").agg(F.count("*").alias("n"), F.sum(F.col("rejected").cast("long")).alias("n_rejected")))


def scored(s, d):
    cov = split_cov(s, d)
    return R.score_contexts(cov, depths(s, d, cov), 2.0, R.SPLIT_SCALE)


query("context_filter_scores")(
    lambda s, d: scored(s, d).groupBy("gid").agg(F.round(F.avg("fake_probability"), 9).alias("fake"), *[F.sum(F.col(f"reject_{m}").cast("long")).alias(m) for m in ("poisson_diff", "poisson_depth", "poisson_product")])
)


def _zip_sql(dp: str) -> str:
    """The latent breadth by bisection, a row per reference of a depth table."""
    return f"""b48_{dp} AS (SELECT gid, breadth, mean_depth, breadth::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM {dp} WHERE breadth > 0 AND breadth < 1 UNION ALL
  SELECT gid, breadth, mean_depth, CASE WHEN low THEN mid ELSE lo END, CASE WHEN low THEN hi ELSE mid END, i + 1 FROM (
    SELECT *, (CASE WHEN mean_depth / mid > 700 THEN mid ELSE mid * (1 - exp(-mean_depth / mid)) END) < breadth AS low FROM (SELECT *, (lo + hi) / 2 AS mid FROM b48_{dp})) WHERE i < 48),
zip_{dp} AS (SELECT t.gid, CASE WHEN t.breadth <= 0 THEN 0 WHEN t.breadth >= 1 THEN 1 WHEN t.mean_depth <= 0 THEN t.breadth
  WHEN t.breadth <= t.breadth * (1 - exp(-t.mean_depth / t.breadth)) + 1e-12 THEN t.breadth WHEN t.breadth >= 1 - exp(-t.mean_depth) - 1e-12 THEN 1 ELSE (z.lo + z.hi) / 2 END AS latent
  FROM {dp} t LEFT JOIN b48_{dp} z ON z.gid = t.gid AND z.i = 48)"""


def latent(s, d, cov=None):
    rows = depths(s, d, cov).withColumn("latent_af", D.latent_breadth(F.col("breadth"), F.col("mean_depth")))
    return rows.withColumn("latent_ani", D.containment_identity(F.col("latent_af")))


query("zip_af", W("SELECT gid, round(latent, 7) AS latent_af FROM zip_dp", _CAND, _COV, _DP, _zip_sql("dp")))(lambda s, d: latent(s, d).select("gid", F.round("latent_af", 7).alias("latent_af")))
query(
    "effective_depth",
    W(
        "SELECT dp.gid, round(CASE WHEN median_cov >= 20 THEN median_cov WHEN mean_depth <= 0 THEN 0 WHEN latent <= 0 THEN mean_depth ELSE mean_depth / pow(latent, 1.05) END, 7) AS effective FROM dp JOIN tf USING (gid) JOIN zip_dp USING (gid)",
        _CAND, _COV, _DP, _TOP, _zip_sql("dp"),
    ),
)(lambda s, d: effective(s, d))


def effective(s, d):
    cov = split_cov(s, d)
    rows = latent(s, d, cov).join(R.top_fraction(cov, 0.25, R.SPLIT_SCALE), "gid")
    return rows.select("gid", F.round(D.effective_depth(F.col("median_cov"), F.col("mean_depth"), F.col("latent_af")), 7).alias("effective"))


def profile(s, d, mode="best-diff-split", found=None, total=None):
    """``found``: candidates, and ``total``: contexts of references, where several profiles share them."""
    scale = R.SPLIT_SCALE if mode == "best-diff-split" else 1
    cov = checkpoint(R.coverage(assigned(s, d, mode) if found is None else R.assign(found, mode)))
    rows = R.depth(cov, R.totals(sk(s, d)) if total is None else total, scale).join(R.features(cov), "gid", "left").fillna(0, ["xny", "n_diff_obj", "n_diff_section", "n_mut2"])
    ani = 1 - D.naive_distance(F.col("xny"), F.col("n_diff_obj"), F.col("n_diff_section"))
    return rows.withColumn("ani", F.when(F.col("xny") > 0, F.round(ani, 9)).otherwise(F.lit(0.0))).withColumn("min_af", F.col("xny") / F.col("total"))


_NAIVE0 = f"CASE WHEN coalesce(f.xny, 0) = 0 THEN 0.0 ELSE round(1 - ({_NAIVE}), 9) END"


def _profile_sql(cov: str, dp: str, name: str) -> str:
    return f"""{name} AS (SELECT p.*, coalesce(f.xny, 0) AS xny, {_NAIVE0} AS ani, coalesce(f.xny, 0) / p.total AS min_af FROM {dp} p LEFT JOIN (
  SELECT gid, count(*) AS xny, count(*) FILTER (WHERE diff > 0) AS n_diff_obj, sum(diff)::BIGINT AS n_diff_section FROM {cov} GROUP BY gid) f USING (gid))"""


_PROFILE = _profile_sql("cv", "dp", "po")


def called(s, d):
    rows = profile(s, d)
    call = R.default_call(F.col("breadth"), F.col("relative_depth"), F.col("xny"), F.col("xny"), F.col("ani"), F.col("total"), F.col("gid") % 4 == 0)
    return rows.withColumn("call", call)


_CALL = """cl AS (SELECT *, CASE WHEN gid % 4 = 0 THEN
  CASE WHEN breadth >= 0.6 AND xny >= greatest(30, ceil(total * 0.03)) AND ani >= 0.96 THEN 'major' WHEN breadth >= 0.35 AND xny >= greatest(20, ceil(total * 0.02)) AND ani >= 0.95 THEN 'screening' ELSE 'weak' END
  ELSE CASE WHEN breadth >= 0.5 AND relative_depth >= 1e-4 AND xny >= least(total, greatest(100, ceil(total / 100))) AND ani >= 0.95 THEN 'major'
  WHEN breadth >= 0.5 AND relative_depth >= 1e-5 AND xny >= least(total, greatest(100, ceil(total / 100))) AND ani >= 0.95 THEN 'low_abundance' ELSE 'weak' END END AS call FROM po)"""
query("default_calls", W("SELECT gid, call, xny, ani FROM cl", _CAND, _COV, _DP, _PROFILE, _CALL))(lambda s, d: called(s, d).select("gid", "call", "xny", "ani"))
query("normalized_abundance", W("SELECT gid, round(relative_depth / sum(relative_depth) OVER (), 9) AS share FROM cl WHERE call IN ('major', 'low_abundance')", _CAND, _COV, _DP, _PROFILE, _CALL))(
    lambda s, d: R.normalised(called(s, d).where("call in ('major', 'low_abundance')"), "relative_depth", "share").select("gid", r9("share").alias("share"))
)


def _sidecar(s, d):
    """The unique profile taken from the split pass's candidates; equals a separate unique pass."""
    return R.support(checkpoint(assigned(s, d, "best-diff-split").where("n_best = 1")))


query("unique_sidecar", W(_SUPPORT.format(a="as_unique"), _CAND))(_sidecar)
query(
    "read_track", W("SELECT unit, count(DISTINCT hctx) AS n_ctx, count(DISTINCT gid) AS n_refs, min(gid) AS first_ref, max(gid) AS last_ref FROM as_best GROUP BY unit", _CAND)
)(lambda s, d: R.track(assigned(s, d, "best-diff"), max_refs=1 << 30).select("unit", "n_ctx", "n_refs", F.array_min("refs").alias("first_ref"), F.array_max("refs").alias("last_ref")))


def lineages(s, d):
    n, r = _t(s, d, "nation"), _t(s, d, "region")
    path = F.concat_ws("|", "r_name", "n_name", "s_name")
    j = _t(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("s_suppkey").cast("long").alias("gid"), path.alias("path"), F.col("n_nationkey").cast("string").alias("taxid"), "r_name", "n_name", "s_name")


_LIN = "ln AS (SELECT s_suppkey::BIGINT AS gid, r_name, n_name, s_name, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
query(
    "lca",
    W(
        "SELECT unit, (CASE WHEN count(DISTINCT s_name) = 1 THEN 3 WHEN count(DISTINCT n_name) = 1 THEN 2 WHEN count(DISTINCT r_name) = 1 THEN 1 ELSE 0 END)::BIGINT AS depth, CASE WHEN count(DISTINCT s_name) = 1 THEN 'class' WHEN count(DISTINCT n_name) = 1 THEN 'phylum' WHEN count(DISTINCT r_name) = 1 THEN 'superkingdom' ELSE 'root' END AS rank, CASE WHEN count(DISTINCT s_name) = 1 THEN min(s_name) WHEN count(DISTINCT n_name) = 1 THEN min(n_name) WHEN count(DISTINCT r_name) = 1 THEN min(r_name) ELSE 'NA' END AS name FROM as_unique JOIN ln USING (gid) GROUP BY unit",
        _CAND, _LIN,
    ),
)(lambda s, d: T.lca(assigned(s, d, "best-diff-unique").select("unit", "gid").distinct().join(lineages(s, d), "gid"), "unit", "path"))


def unknown(s, d):
    sketch, den = K.build_with_densities(K.hashed(_t(s, d, "lineitem"), *_LINE), SIZE)
    out = R.unknown_fraction(sketch, reads(s, d), den.select("gid", ((F.col("threshold").cast("double") + 1) / float(1 << 44)).alias("density")), 1.0)
    return out.select("contexts", "observed", F.round("present", 4).alias("present"), F.round("unknown", 7).alias("unknown"))


query(
    "unknown_fraction",
    W(
        "SELECT t.contexts, b.observed, round(b.present, 4) AS present, round(greatest(1 - b.present / t.contexts, 0), 7) AS unknown FROM (SELECT count(*) AS observed, sum(1 / least(1.0, density)) AS present FROM (SELECT unit, hctx, max((threshold::DOUBLE + 1) / 17592186044416.0::DOUBLE) AS density FROM cd JOIN thr USING (gid) GROUP BY 1, 2)) b, (SELECT count(*) AS contexts FROM (SELECT DISTINCT unit, hctx FROM rows0)) t",
        _CAND, _DENS,
    ),
)(unknown)


def cami(s, d):
    lin = lineages(s, d)
    rows = lin.select("gid", F.explode(F.array(F.struct(F.col("r_name").alias("taxid"), F.lit("superkingdom").alias("rank"), F.col("r_name").alias("taxpath")), F.struct(F.col("n_name").alias("taxid"), F.lit("phylum").alias("rank"), F.concat_ws("|", "r_name", "n_name").alias("taxpath")))).alias("t")).select("gid", "t.*")
    out = T.profile(depths(s, d).select("gid", F.col("relative_depth").alias("abundance")), rows)
    return out.select("taxid", "rank", "taxpath", F.round("percentage", 6).alias("percentage"))


query(
    "cami_profile",
    W(
        "SELECT taxid, rank, taxpath, round(100 * sum(relative_depth) / sum(sum(relative_depth)) OVER (PARTITION BY rank), 6) AS percentage FROM (SELECT r_name AS taxid, 'superkingdom' AS rank, r_name AS taxpath, relative_depth FROM dp JOIN ln USING (gid) WHERE relative_depth > 0 UNION ALL SELECT n_name, 'phylum', r_name || '|' || n_name, relative_depth FROM dp JOIN ln USING (gid) WHERE relative_depth > 0) GROUP BY taxid, rank, taxpath",
        _CAND, _COV, _DP, _LIN,
    ),
)(cami)


def keyed(s, d):
    refs = lineages(s, d).select("gid", F.when(F.col("gid") % 3 == 0, F.col("s_name")).when(F.col("gid") % 3 == 1, F.concat(F.lit("/db/x/"), F.col("s_name"))).otherwise(F.concat(F.lit("asm_GCF_"), F.lpad(F.col("gid").cast("string"), 9, "0"), F.lit(".1_x"))).alias("name"), F.lit("note").alias("annotation"))
    by_name = lineages(s, d).select(F.col("s_name").alias("ref_key"), F.col("n_name").alias("taxid"))
    by_accession = lineages(s, d).select(F.concat(F.lit("GCF_"), F.lpad(F.col("gid").cast("string"), 9, "0"), F.lit(".1")).alias("ref_key"), F.col("r_name").alias("taxid"))
    return T.match_keys(refs, by_name.union(by_accession)).select("gid", "taxid")


query("taxonomy_key_fallback", "WITH " + _LIN + " SELECT gid, CASE WHEN gid % 3 = 2 THEN r_name ELSE n_name END AS taxid FROM ln")(keyed)
query("ambiguity_edges", W("SELECT gid, count(*) AS n_edges, count(*) FILTER (WHERE d = best) AS n_selected, sum(n_best)::BIGINT AS best_sum FROM mb WHERE n_candidates > 1 GROUP BY gid", _CAND))(
    lambda s, d: R.ambiguity_edges(assigned(s, d, "all")).groupBy("gid").agg(F.count("*").alias("n_edges"), F.sum(F.col("selected").cast("long")).alias("n_selected"), F.sum("n_best").alias("best_sum"))
)


def ambiguous_shares(s, d):
    ref = checkpoint(sk(s, d))
    depth = R.depth(checkpoint(R.covered(reads(s, d), ref, "best-diff-split")), R.totals(ref), R.SPLIT_SCALE)
    return C.context_em(reads(s, d), ref, depth.select("gid", F.col("relative_depth").alias("share")), iterations=4)


_EM = ["ee AS (SELECT unit, hctx, gid, exp(-greatest(d - best, 0)::DOUBLE) AS lk FROM mb WHERE n_candidates > 1)", "s0 AS (SELECT gid, greatest(relative_depth, 1e-12) / sum(greatest(relative_depth, 1e-12)) OVER () AS share FROM dp)"]
for _i in range(4):
    _EM.append(f"c{_i} AS (SELECT gid, sum(w / whole) AS n FROM (SELECT ee.gid, share * lk AS w, sum(share * lk) OVER (PARTITION BY unit, hctx) AS whole FROM ee JOIN s{_i} USING (gid)) WHERE whole > 0 GROUP BY gid)")
    _EM.append(f"s{_i + 1} AS (SELECT gid, coalesce(n, 0) / (SELECT sum(n) FROM c{_i}) AS share FROM s{_i} LEFT JOIN c{_i} USING (gid))")
query("edge_em", W("SELECT gid, round(share, 6) AS share FROM s4", _CAND, _COV, _DP, *_EM))(
    lambda s, d: ambiguous_shares(s, d).select("gid", F.round("share", 6).alias("share"))
)
query(
    "density_blocks",
    W(
        "SELECT block, least(coalesce(nx, n + 1), n + 1) - start AS reads FROM bl, (SELECT max(i) AS n FROM rc) WHERE start <= n",
        "rc AS (SELECT unit, row_number() OVER (ORDER BY unit) AS i, n, sum(n) OVER (ORDER BY unit) AS upto FROM (SELECT unit, count(DISTINCT hctx) AS n FROM rows0 GROUP BY unit))",
        "jp AS (SELECT a.i, b.i + 1 AS nx FROM (SELECT i, upto - n + 100 AS goal FROM rc) a ASOF LEFT JOIN rc b ON a.goal <= b.upto)",
        "bl AS (SELECT 0::BIGINT AS block, 1::BIGINT AS start, (SELECT nx FROM jp WHERE i = 1) AS nx UNION ALL SELECT block + 1, bl.nx, jp.nx FROM bl JOIN jp ON jp.i = bl.nx)",
    ),
)(lambda s, d: R.density_blocks(reads(s, d).select(F.lit(0).cast("long").alias("sample"), "unit", "hctx").distinct().groupBy("sample", F.col("unit").alias("read_ord")).agg(F.count("*").alias("n_ctx")), 100).groupBy("block").agg(F.count("*").alias("reads")))

# --- calibrated calls ----------------------------------------------------------------------------------------------


def calibrated_rows(s, d, mode, found=None, total=None):
    rows = profile(s, d, mode, found, total).join(lineages(s, d).select("gid", "taxid"), "gid")
    rows = rows.withColumns({"normalized_depth": F.col("relative_depth"), "latent_af": D.latent_breadth(F.col("breadth"), F.col("mean_depth"))})
    return rows.withColumn("latent_ani", D.containment_identity(F.col("latent_af")))


_ID = "CASE WHEN latent > 0 THEN least(greatest(1 + ln(least(latent, 1)) / 22.0, 0), 1) ELSE 0 END"
_MEAS = {"ani": "ani", "xny": "xny::DOUBLE", "min_af": "min_af", "breadth": "breadth", "mean_depth": "mean_depth", "hit_mean_depth": "hit_mean_depth", "depth_cv": "depth_cv", "normalized_depth": "relative_depth", "latent_af": "latent::DOUBLE", "latent_ani": _ID}


def _tax_sql(view: str, p: str, dp: str) -> str:
    cols = ", ".join(f"max({e}) AS {p}_{m}" for m, e in _MEAS.items())
    return f"tx_{p} AS (SELECT n_nationkey::VARCHAR AS taxid, count(*) AS {p}_rows, max((xny >= 10 AND ani >= 0.95 AND min_af >= 0.05)::INTEGER) AS {p}_direct, {cols}, min(depth_cv) AS {p}_depth_cv_min FROM {view} JOIN ln USING (gid) JOIN zip_{dp} USING (gid) GROUP BY 1)"


_JOINED = ",\n".join(
    [
        _CAND, _COV, _UCOV, _DP, _depth_sql("cu", "sk", 1, "du"), _PROFILE, _profile_sql("cu", "du", "pu"), _LIN, _zip_sql("du"), _zip_sql("dp"), _tax_sql("pu", "u", "du"), _tax_sql("po", "s", "dp"),
        "jf AS (SELECT coalesce(u.taxid, s.taxid) AS taxid, " + ", ".join(f"coalesce({p}_{m}, 0) AS {p}_{m}" for p in "us" for m in ("rows", "direct", *_MEAS, "depth_cv_min")) + " FROM tx_u u FULL JOIN tx_s s ON u.taxid = s.taxid)",
    ]
)


def joined(s, d):
    ref = checkpoint(sk(s, d))
    found, total = checkpoint(R.candidates(reads(s, d), ref)), checkpoint(R.totals(ref))
    return checkpoint(C.joined(*[calibrated_rows(s, d, mode, found, total) for mode in ("best-diff-unique", "best-diff-split")]))


_JF = [f"{p}_{m}" for p in "us" for m in ("ani", "xny", "min_af", "breadth", "mean_depth", "depth_cv", "depth_cv_min")]
query(
    "joined_features",
    W("SELECT taxid, u_rows, s_rows, " + ", ".join(f"round({c}, 7) AS {c}" for c in _JF) + ", round(CASE WHEN u_xny <> 0 THEN s_xny / u_xny ELSE 0 END, 7) AS xny_ratio, round(CASE WHEN u_breadth <> 0 THEN s_breadth / u_breadth ELSE 0 END, 7) AS breadth_ratio, round(s_ani - u_ani, 7) AS ani_delta FROM jf", _JOINED),
)(lambda s, d: joined(s, d).select("taxid", "u_rows", "s_rows", *[F.round(c, 7).alias(c) for c in [*_JF, "xny_ratio", "breadth_ratio", "ani_delta"]]))


def predicted(s, d, features=None):
    """Joined features of species with their names and the probability that the package's trained model gives them."""
    names = lineages(s, d).select("taxid", F.concat_ws(" ", "r_name", "n_name").alias("name")).distinct()
    return (joined(s, d) if features is None else features).join(names, "taxid").withColumn("probability", F.round(M.probability(M.bundled()), 6))


def gated(s, d, threshold=0.35):
    return C.adaptive_gate(predicted(s, d), threshold)


_GATE = """na AS (SELECT DISTINCT n_nationkey::VARCHAR AS taxid, split_part(r_name, ' ', 1) AS genus FROM ln),
jr AS (SELECT *, CASE WHEN u_xny <> 0 THEN s_xny / u_xny ELSE 0 END AS xny_ratio, CASE WHEN u_breadth <> 0 THEN s_breadth / u_breadth ELSE 0 END AS breadth_ratio, s_ani - u_ani AS ani_delta FROM jf),
g0 AS (SELECT jr.*, na.genus, round(<probability>, 6) AS probability FROM jr JOIN na USING (taxid)),
g1 AS (SELECT *, u_xny >= 10 AND u_ani >= 0.95 AND u_min_af >= 0.05 AS base, probability >= 0.35 AS gate, s_xny >= 50 AND s_ani >= 0.95 AND s_min_af >= 0.05 AND s_breadth >= 0.05 AS strict,
  s_xny * greatest(s_breadth, 1e-6) * greatest(s_ani, 0) * greatest(probability, 0.01) AS score FROM g0),
sc AS (SELECT coalesce(sum(s_normalized_depth) FILTER (WHERE base), 0) AS bm, coalesce(sum(s_normalized_depth) FILTER (WHERE gate AND NOT base), 0) AS em, count(*) FILTER (WHERE base) AS nb, count(*) FILTER (WHERE gate) AS ng, coalesce(median(u_min_af) FILTER (WHERE base), 0) AS uaf FROM g1),
g2 AS (SELECT g1.*, em / (bm + 1e-12) AS mr, ng / greatest(nb, 1) AS cr, nb, ng, uaf,
  (gate AND strict AND NOT base) AND row_number() OVER (PARTITION BY genus, gate AND strict AND NOT base ORDER BY score DESC, taxid) <= 2 AS rescue,
  (probability >= 0.2 AND strict AND NOT base) AND row_number() OVER (PARTITION BY genus, probability >= 0.2 AND strict AND NOT base ORDER BY score DESC, taxid) <= 1 AS lowx FROM g1, sc),
g3 AS (SELECT *, CASE WHEN mr < 0.005 THEN CASE WHEN uaf < 0.45 AND bool_or(lowx) OVER () THEN 'base_low_extra_split_rescue' ELSE 'base' END WHEN mr >= 0.2 AND cr >= 1.2 THEN CASE WHEN uaf < 0.35 THEN 'probability_high_extra_low_uaf_tail025' ELSE 'rescue' END WHEN ng <= nb AND mr < 0.03 THEN 'strict_plain' ELSE 'probability' END AS mode FROM g2),
g4 AS (SELECT *, CASE mode WHEN 'base' THEN base WHEN 'base_low_extra_split_rescue' THEN base OR lowx WHEN 'rescue' THEN base OR rescue WHEN 'strict_plain' THEN base OR (strict AND u_xny >= 50 AND u_ani >= 0.93) WHEN 'probability' THEN gate ELSE probability >= 0.25 END AS adaptive,
  mode = 'probability_high_extra_low_uaf_tail025' AND probability >= 0.25 AND NOT (base OR rescue) AS tail_added FROM g3),
g5 AS (SELECT *, s_xny >= 300 AND s_ani >= 0.948 AND s_ani < 0.9505 AND s_min_af >= 0.05 AND s_breadth >= 0.2 AND s_hit_mean_depth >= 1.4 AND probability >= 0.2 AND u_ani >= 0.92 AND NOT adaptive AS nm FROM g4),
gt AS (SELECT *, adaptive OR (nm AND row_number() OVER (PARTITION BY genus, nm ORDER BY probability * s_xny * greatest(s_breadth, 1e-6) * greatest(s_hit_mean_depth, 1) DESC, taxid) <= 1) AS called FROM g5)""".replace("<probability>", M.probability_sql(M.bundled()))
query("call_probability", W("SELECT taxid, probability FROM g0", _JOINED, _GATE))(lambda s, d: predicted(s, d).select("taxid", "probability"))
_PANEL = "(CASE WHEN tail_added THEN s_mean_depth ELSE greatest(s_mean_depth / greatest(s_latent_af, 1e-6), u_mean_depth / greatest(u_latent_af, 1e-6)) END)"


def filtered_calls(rows):
    """The support filter with its cuts at the size of these sketches: the calls' mean of unique contexts."""
    least = rows.where("called").agg(F.coalesce(F.avg("u_xny"), F.lit(0.0)).alias("m")).first()["m"]
    return C.adaptive_filter(rows, median=25.0, least=least).select("taxid", "called")


query("adaptive_gate", W("SELECT taxid, genus, mode, tail_added, called FROM gt", _JOINED, _GATE))(lambda s, d: gated(s, d).select("taxid", "genus", "mode", "tail_added", "called"))
query("panel_abundance", W(f"SELECT taxid, round({_PANEL}, 6) AS raw, round(CASE WHEN s_hit_mean_depth > 0 THEN s_hit_mean_depth ELSE {_PANEL} END, 6) AS exact FROM gt", _JOINED, _GATE))(
    lambda s, d: gated(s, d).select("taxid", F.round(C.panel_abundance(), 6).alias("raw"), F.round(C.exact_hit_abundance(C.panel_abundance()), 6).alias("exact"))
)
query("adaptive_call_filter", W("SELECT taxid, called AND (md < 25 OR CASE WHEN s_xny > 0 AND u_xny > 0 THEN least(s_xny, u_xny) ELSE greatest(s_xny, u_xny) END >= mu) AS called FROM gt, (SELECT coalesce(median(greatest(s_xny, u_xny)) FILTER (WHERE called), 0) AS md, coalesce(avg(u_xny) FILTER (WHERE called), 0) AS mu FROM gt)", _JOINED, _GATE))(
    lambda s, d: filtered_calls(checkpoint(gated(s, d)))
)
query(
    "ani_floor", W(f"SELECT taxid, round(CASE WHEN called AND {_PANEL} > 0 AND (CASE WHEN s_latent_ani <= 0 AND u_latent_ani > 0 THEN u_latent_ani ELSE s_latent_ani END) < 0.985 THEN 0 ELSE greatest({_PANEL}, 0) END, 6) AS raw FROM gt", _JOINED, _GATE)
)(lambda s, d: gated(s, d).select("taxid", F.round(C.ani_floor(C.panel_abundance(), 0.985), 6).alias("raw")))
_BR = "least(greatest(s_breadth, u_breadth, 0), 1 - 1e-12)"
query(
    "sparse_depth_cap", W(f"SELECT taxid, round(CASE WHEN called AND {_PANEL} > 0 AND {_BR} <= 0.9 AND {_PANEL} / greatest(-ln(1 - {_BR}), 1e-12) >= 1.0 THEN least({_PANEL}, -ln(1 - {_BR})) ELSE greatest({_PANEL}, 0) END, 6) AS raw FROM gt", _JOINED, _GATE)
)(lambda s, d: gated(s, d).select("taxid", F.round(C.sparse_depth_cap(C.panel_abundance(), 0.9, 1.0), 6).alias("raw")))
query(
    "genus_blend",
    W(
        "SELECT taxid, round(CASE WHEN act AND count(*) OVER w > 1 AND sum(p * q) OVER w > 0 THEN 0.7 * p + 0.3 * (p * q) / (sum(p * q) OVER w) * (sum(p) OVER w) ELSE greatest(p, 0) END, 6) AS blended FROM b WINDOW w AS (PARTITION BY genus, act)",
        _JOINED, _GATE, f"b AS (SELECT taxid, genus, {_PANEL} AS p, least(greatest(s_xny / 1000.0, 0), 1) AS q, called AND {_PANEL} > 0 AS act FROM gt)",
    ),
)(lambda s, d: C.genus_blend(gated(s, d).withColumn("raw", C.panel_abundance()), "raw", 0.3).select("taxid", F.round("blended", 6).alias("blended")))
query("presence_scores", W("SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM (SELECT count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM (SELECT s_suppkey % 3 <> 0 AS p, s_acctbal > 2000 AS t FROM supplier))"))(
    lambda s, d: C.presence_scores(samples(s, d).where("gid % 3 <> 0"), _t(s, d, "supplier").where("s_acctbal > 2000").select(F.col("s_suppkey").cast("long").alias("gid")), "gid").select("tp", "fp", "fn", *[r9(c).alias(c) for c in ("precision", "recall", "f1")])
)
query(
    "profile_agreement",
    "WITH a AS (SELECT l_suppkey AS g, sum(l_quantity) AS x, count(*)::DOUBLE * 25 AS y FROM lineitem GROUP BY 1), r AS (SELECT *, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2) AS rx, (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2) AS ry FROM a) SELECT round(avg(abs(x - y)), 6) AS mae, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, round(sum(abs(x - y)), 6) AS l1, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r",
)(lambda s, d: C.agreement(_t(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("x"), (F.count("*").cast("double") * 25).alias("y")), "x", "y").select(*[F.round(c, 6).alias(c) for c in ("mae", "rmse", "l1")], r9("pearson").alias("pearson"), r9("spearman").alias("spearman")))

# --- abundance vectors ---------------------------------------------------------------------------------------------

_SHARE = """sh AS (SELECT q.gid AS qry, r.gid AS ref, q.cnt * q.obj AS cnt FROM sk q JOIN sk r ON q.hctx = r.hctx),
ab AS (SELECT qry, ref, len(l) AS n, list_sum(l)::DOUBLE / len(l) AS mean, coalesce(list_sum(l[floor(len(l) * 0.98)::BIGINT + 1:ceil(len(l) * 0.99)::BIGINT]), 0)::DOUBLE / floor(len(l) * 0.99 - floor(len(l) * 0.98) + 1) AS range_mean, l[len(l) // 2 + 1] AS median, l[-1] AS max
  FROM (SELECT qry, ref, list_sort(list(cnt)) AS l FROM sh GROUP BY 1, 2 HAVING count(*) >= 6))"""


def composite(s, d):
    k = checkpoint(sk(s, d))
    return V.species_abundance(k.withColumn("cnt", F.col("cnt") * F.col("obj")), k)


def searched(s, d, measure):
    vectors = checkpoint(V.to_vectors(composite(s, d)))
    return V.search(vectors, vectors, measure)


query("composite_abundance", W("SELECT qry, ref, n, round(mean, 6) AS mean, round(range_mean, 6) AS range_mean, median, max FROM ab", _SHARE))(lambda s, d: composite(s, d).select("qry", "ref", "n", F.round("mean", 6).alias("mean"), F.round("range_mean", 6).alias("range_mean"), "median", "max"))
_VEC = "vc AS (SELECT qry AS sample, ref AS dim, (range_mean - 1) * 100 / (sum(range_mean) OVER w - count(*) OVER w) AS pct FROM ab WHERE median > 1 AND n > 7 WINDOW w AS (PARTITION BY qry))"
_SEARCH = {
    "cosine": "SELECT x.sample AS qry, y.sample AS ref, round(sum(x.pct * y.pct) / (any_value(a.n) * any_value(b.n)), 7) AS value FROM vc x JOIN vc y USING (dim) JOIN nm a ON a.sample = x.sample JOIN nm b ON b.sample = y.sample GROUP BY 1, 2",
    "l1": "SELECT x.sample AS qry, y.sample AS ref, round(sum(abs(x.pct - y.pct)) + 200 - sum(x.pct) - sum(y.pct), 7) AS value FROM vc x JOIN vc y USING (dim) GROUP BY 1, 2",
    "l2": "SELECT x.sample AS qry, y.sample AS ref, round(sqrt(sum((x.pct - y.pct) * (x.pct - y.pct))), 7) AS value FROM vc x JOIN vc y USING (dim) GROUP BY 1, 2",
}
for _measure, _body in _SEARCH.items():
    query(f"{_measure}_search", W(_body, _SHARE, _VEC, "nm AS (SELECT sample, sqrt(sum(pct * pct)) AS n FROM vc GROUP BY sample)"))(
        lambda s, d, m=_measure: searched(s, d, m).select("qry", "ref", (F.round("value", 7) + 0.0).alias("value"))
    )

# --- sequences, models and grids -----------------------------------------------------------------------------------


def sequence_sketch(s, d):
    """Every text as a sequence; the kernel keeps contexts under a density of 1/64, then the sketch is built."""
    from sketchlake.sources.sequences import entries, windows

    docs = _t(s, d, "documents").select(F.col("doc_id").alias("gid"), F.lit(0).alias("record_ord"), "text")
    bases = docs.withColumn("seq", _bases(F.col("text"))).drop("text")
    return K.build(entries(windows(bases, threshold=1 << 38)), SIZE)


def _bases(text: Column) -> Column:
    """Each byte as four bases: hexadecimal digits are pairs of bases."""
    seq = F.hex(F.encode(text, "UTF-8"))
    for digit in "0123456789ABCDEF":
        pair = "ACGT"[int(digit, 16) >> 2] + "ACGT"[int(digit, 16) & 3]
        seq = F.replace(seq, F.lit(digit), F.lit(pair.lower()))
    return F.upper(seq)


query("sequence_sketch_documents")(sequence_sketch)


def qc(s, d):
    from sketchlake.functions.reads_qc import count_ranges

    return count_ranges(raw(s, d).withColumn("cnt", F.col("cnt") * (1 + F.col("obj") % 7)))


query("reads_qc_range")(qc)


def recalibrated(s, d):
    """Boosted trees fitted by Spark to all pairs, whose label is another measure of the same pairs, the mixture model's."""
    from sketchlake.functions import trees

    pairs = P.triangle_features(checkpoint(sk(s, d).select(*_COLS)))
    measured = lambda rows: rows.withColumns({"ani": 1 - P.metric_columns(SIZE)["ctx-naive"], "af_ref": F.col("xny") / F.col("y_ctx")})
    # Pairs with the same counts have the same inputs and label; they are fitted as one row with their number.
    alike = checkpoint(pairs.groupBy("xny", "n_diff_obj", "n_diff_section", "n_mut2", "y_ctx").agg(F.count("*").alias("times")))
    model = M.fit_regression(mixture(measured(alike)).withColumn("label", 1 - F.col("distance")).withColumns(trees.feature_columns()), trees.FEATURES, "label", rounds=10, times="times")
    pairs = measured(pairs)
    return trees.recalibrate(pairs, model).select("qry", "ref", F.round("calibrated_ani", 6).alias("calibrated_ani"), D.confidence(F.col("ani"), F.col("calibrated_ani"), F.col("af_ref")).alias("confidence"))


query("tree_recalibration")(recalibrated)
_GRID = [round(0.05 * i, 2) for i in range(1, 20)]
query(
    "threshold_grid",
    "WITH a AS (SELECT s_acctbal / 10000 AS score, (s_suppkey % 3 <> 0)::INTEGER AS label FROM supplier), g AS (SELECT unnest([" + ", ".join(map(str, _GRID)) + "])::DOUBLE AS threshold), m AS (SELECT threshold, coalesce(sum(label) FILTER (WHERE score >= threshold), 0)::BIGINT AS tp, count(*) FILTER (WHERE score >= threshold) AS called, sum(label) AS p FROM g, a GROUP BY threshold) SELECT threshold, tp, called, round(CASE WHEN called > 0 THEN tp / called ELSE 0 END, 9) AS precision, round(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 9) AS recall, round(CASE WHEN called + p > 0 THEN 2 * tp / (called + p) ELSE 0 END, 9) AS f1 FROM m",
)(lambda s, d: C.threshold_grid(_t(s, d, "supplier").select((F.col("s_acctbal") / 10000).alias("score"), (F.col("s_suppkey") % 3 != 0).cast("int").alias("label")), "score", "label", _GRID).select("threshold", "tp", "called", *[r9(c).alias(c) for c in ("precision", "recall", "f1")]))
query(
    "candidate_rescue_emitted",
    W(
        "SELECT taxid, r AS rescued, called OR r AS called, round(CASE WHEN r THEN 2 * greatest(s_normalized_depth, u_normalized_depth) ELSE 0 END, 7) AS rescue_mass FROM (SELECT *, NOT called AND greatest(s_latent_ani, u_latent_ani) >= 0.9 AND greatest(s_xny, u_xny) >= 100 AND greatest(s_breadth, u_breadth) >= 0.01 AND greatest(s_min_af, u_min_af) >= 0.7 AS r FROM gt)",
        _JOINED, _GATE,
    ),
)(lambda s, d: C.candidate_rescue(gated(s, d), "emitted").select("taxid", "rescued", "called", F.round("rescue_mass", 7).alias("rescue_mass")))
query(
    "candidate_rescue_split",
    W(
        "SELECT taxid, k AND row_number() OVER (PARTITION BY genus, k ORDER BY greatest(s_mean_depth, 0) * greatest(s_breadth, 1e-6) * greatest(s_ani, 0) * greatest(s_xny, 1) DESC, taxid) <= 1 AS rescued FROM (SELECT *, NOT called AND probability >= 0 AND s_xny >= 30 AND s_ani >= 0.9 AND s_min_af >= 0.6 AND s_breadth >= 0.25 AND s_mean_depth >= 1 AS k FROM gt)",
        _JOINED, _GATE,
    ),
)(lambda s, d: C.candidate_rescue(gated(s, d), "split", cuts={"probability": 0.0, "s_xny": 30.0, "s_ani": 0.9}).select("taxid", "rescued"))
query(
    "guarded_allocator",
    W(
        "SELECT taxid, round(CASE WHEN (SELECT sum(p) FILTER (WHERE act AND many) / sum(p) FILTER (WHERE act) FROM b2) >= 0.37501510201405147 AND act AND count(*) OVER w > 1 AND sum(p * q) OVER w > 0 THEN 0.98 * p + 0.02 * (p * q) / (sum(p * q) OVER w) * (sum(p) OVER w) ELSE greatest(p, 0) END, 6) AS allocated FROM b2 WINDOW w AS (PARTITION BY genus, act)",
        _JOINED, _GATE, f"b AS (SELECT taxid, genus, {_PANEL} AS p, greatest(s_hit_mean_depth * s_breadth, u_hit_mean_depth * u_breadth) AS q, called AND {_PANEL} > 0 AS act FROM gt)", "b2 AS (SELECT *, count(*) OVER (PARTITION BY genus, act) > 1 AS many FROM b)",
    ),
)(lambda s, d: C.guarded_allocator(gated(s, d).withColumn("raw", C.panel_abundance()), "raw").select("taxid", F.round("allocated", 6).alias("allocated")))
query("exact_pass_decision", W("SELECT round(x, 9) AS extra, x <= 0.1 AS rerun FROM (SELECT count(*) FILTER (WHERE called AND NOT base) / greatest(count(*) FILTER (WHERE called), 1) AS x FROM gt)", _JOINED, _GATE))(
    lambda s, d: C.exact_pass_decision(gated(s, d), False).select(r9("extra").alias("extra"), "rerun")
)
