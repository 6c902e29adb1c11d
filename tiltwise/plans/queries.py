"""Registered queries of the estimation operators, with the same results in SQL.

Inputs come from ``lineitem`` by integer arithmetic, so both engines see the same rows: outcome y, prediction p, features x1
to x4, a weight w, and ext, which says whether a row belongs to the external population.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, normal_cdf
from ..operators import distributed, optimizers, sampling
from ..operators.measures import auroc, estimation_fields, max_smd, measures, smd, smd_sets, weight_divergence, weighting_fields
from ..operators.prediagnostics import overlap, pre_diagnostics
from ..operators.profile import profile_frame
from ..operators.summary import block_means, summarise, summary_fields, top_features, union_sections
from ..operators.transform import fit_transform, normalise
from ..sources.tables import read_means, read_table, results_table
from .estimate import EstimatorSettings, different_rows, estimate_external, estimate_internal, flagship, solve_whole

FEATURES = ["x1", "x2", "x3", "x4"]
FIXTURE_SQL = """fixture as (
    select case when (l_orderkey*31 + l_partkey*7 + l_linenumber*17) % 100 < 20 + l_quantity then 1 else 0 end as y,
           (20 + l_quantity) / 100 as p,
           case when (l_orderkey*7919 + l_linenumber*104729) % 50 < l_quantity then 1 else 0 end as ext,
           l_quantity / 50 as x1, l_discount as x2,
           case when l_returnflag = 'R' then 1 else 0 end as x3,
           case when l_linestatus = 'O' then 1 else 0 end as x4,
           1 + (l_orderkey*7919 + l_linenumber*104729) % 5 as w
    from lineitem
)"""


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729
    draw = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber") * 17) % 100
    flag = lambda c: F.when(c, 1).otherwise(0)
    return read_table(spark, sf_dir, "lineitem").select(
        flag(draw < 20 + F.col("l_quantity")).alias("y"), ((20 + F.col("l_quantity")) / 100).alias("p"), flag(key % 50 < F.col("l_quantity")).alias("ext"),
        (F.col("l_quantity") / 50).alias("x1"), F.col("l_discount").alias("x2"), flag(F.col("l_returnflag") == "R").alias("x3"), flag(F.col("l_linestatus") == "O").alias("x4"), (1 + key % 5).alias("w"),
    )


def internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir).where("ext = 0")


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir).where("ext = 1")


def in_sql(body: str) -> str:
    return f"with {FIXTURE_SQL}\n{body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(col(c), digits).alias(c) if t in ("double", "float") else col(c) for c, t in df.dtypes])


def long_means(df: DataFrame, names: list[str]) -> DataFrame:
    """``feature, mean`` of the named columns: one aggregate, then unpivoted."""
    one = df.agg(*[F.avg(col(n)).alias(f"m{i}") for i, n in enumerate(names)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.round(f"m{i}", 6).alias("mean")) for i, n in enumerate(names)])).alias("m")).select("m.*")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# Transforms ---------------------------------------------------------------------------------------------------------------


def _mean_sql(terms: dict[str, str], where: str = "ext = 0") -> str:
    return in_sql("\nunion all\n".join(f"select '{n}' as feature, round(avg({e}), 6) as mean from fixture where {where}" for n, e in terms.items()))


_STRATA = ((1, "y", "I(y)"), (0, "(1 - y)", "I(1 - y)"))
_SQUARED = ("x1", "x2")
_TABLE1 = {"Y": "y"} | {f"{n}:y{y}": f"{s} * {e}" for y, s, _ in _STRATA for n, e in [*((x, x) for x in FEATURES), *((f"({x}^2)", f"{x} * {x}") for x in _SQUARED)]}
_PLAIN = {x: x for x in FEATURES} | {f"({x}^2)": f"{x} * {x}" for x in _SQUARED} | {"y": "y"}
_FLAT = {"y": "y"} | {f"{label}:{n}": f"{s} * {e}" for _, s, label in _STRATA for n, e in [*((x, x) for x in FEATURES), *((f"I({x}^2)", f"{x} * {x}") for x in _SQUARED)]}
_V1 = _FLAT | {f"{label}:{n}:x3": f"{s} * {n} * x3" for _, s, label in _STRATA for n in ("x1", "x2", "x4")}
_V0 = _FLAT | {f"{label}:{n}:{v}": f"{s} * {e} * {v}" for _, s, label in _STRATA for v in ("x3",) for n, e in [("x1", "x1"), ("x2", "x2"), ("x4", "x4"), ("I(x1^2)", "x1 * x1"), ("I(x2^2)", "x2 * x2")]}
_V1_TWO = _FLAT | {f"{label}:{a}:{b}": f"{s} * {a} * {b}" for _, s, label in _STRATA for a, b in (("x1", "x3"), ("x2", "x3"), ("x4", "x3"), ("x2", "x1"), ("x4", "x1"))}


def _transformed(kind: str, balance: bool = True, interactions: tuple[str, ...] = ()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = internal(spark, sf_dir).select("y", *FEATURES)
        spec = fit_transform(df, kind, "y", FEATURES, balance, interactions)
        return long_means(spec.apply(df), spec.names)

    return run


for _name, _sql, _args in (
    ("t1_table1", _TABLE1, ("Table 1",)),
    ("t1_nobalance", _PLAIN, ("Table 1", False)),
    ("t1_flat", _FLAT, ("flat",)),
    ("t1_inter_v1", _V1, ("Interaction", True, ("x3",))),
    ("t1_inter_v1_two", _V1_TWO, ("Interaction", True, ("x3", "x1"))),
    ("t1_inter_v0", _V0, ("Interaction v0", True, ("x3",))),
):
    query(_mean_sql(_sql), _name)(_transformed(*_args))


#: A factor with missing values, and one with a level that only external rows have: such rows are left out.
_FACTORED = """factored as (
    select *, l_quantity / 50 as x1, case when (l_orderkey * 7 + l_linenumber) % 11 = 0 then null else l_returnflag end as flag, 's' || (l_linenumber % 4)::varchar as size,
           case when (l_orderkey*7919 + l_linenumber*104729) % 50 < l_quantity then 1 else 0 end as ext,
           case when (l_orderkey*31 + l_partkey*7 + l_linenumber*17) % 100 < 20 + l_quantity then 1 else 0 end as y
    from lineitem
), used as (select *, case ext when 0 then 'internal' else 'external' end as side from factored where size <> 's3' and flag is not null)"""
_LEVELS = {"flagA": "(flag = 'A')::int", "flagN": "(flag = 'N')::int", "flagR": "(flag = 'R')::int", "sizes0": "(size = 's0')::int", "sizes1": "(size = 's1')::int", "sizes2": "(size = 's2')::int"}
_CONTRASTS = {"y": "y"} | {
    f"{label}:{n}": f"{s} * {e}" for _, s, label in _STRATA
    for n, e in [("x1", "x1"), *_LEVELS.items(), ("I(x1^2)", "x1 * x1"), *((f"{n}:x1", f"{e} * x1") for n, e in _LEVELS.items() if n not in ("flagA", "sizes0"))]
}


@query(f"with {_FACTORED}\n" + "\nunion all\n".join(f"select side, '{n}' as feature, round(avg({e}), 6) as mean from used group by side" for n, e in _CONTRASTS.items()))
def t1_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a model formula with factors: levels of the internal rows, whole rows on both sides."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    flag = F.when((key * 7 + line) % 11 != 0, F.col("l_returnflag")).alias("flag")
    y = F.when((key * 31 + F.col("l_partkey") * 7 + line * 17) % 100 < 20 + F.col("l_quantity"), 1).otherwise(0).alias("y")
    ext = F.when((key * 7919 + line * 104729) % 50 < F.col("l_quantity"), 1).otherwise(0).alias("ext")
    rows = read_table(spark, sf_dir, "lineitem").select(y, ext, (F.col("l_quantity") / 50).alias("x1"), flag, F.concat(F.lit("s"), (line % 4).cast("string")).alias("size"))
    own = rows.where("ext = 0 and size <> 's3'").drop("ext")
    spec = fit_transform(own, "Interaction", "y", ["x1", "flag", "size"], interactions=("x1",), contrasts=True)
    sides = None
    for side, df in (("internal", own), ("external", rows.where("ext = 1"))):
        part = long_means(spec.apply(df), spec.names).select(F.lit(side).alias("side"), "*")
        sides = part if sides is None else sides.unionByName(part)
    return sides


@query(in_sql("select " + ", ".join(f'round({e}, 6) as "{n}"' for n, e in _TABLE1.items()) + " from (select cast(y as double) as y, x1, x2, cast(x3 as double) as x3, cast(x4 as double) as x4 from fixture where ext = 0)"))
def t1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = internal(spark, sf_dir).select("y", *FEATURES)
    return rounded(fit_transform(df, "Table 1", "y", FEATURES).apply(df))


@query("""with parts as (select o_orderstatus, o_orderpriority, o_totalprice from orders),
codes as (select o_orderpriority, dense_rank() over (order by o_orderpriority) - 1 as code from (select distinct o_orderpriority from parts))
select round(avg(code), 6) as mean_code, round(avg(code * code), 6) as mean_square from parts join codes using (o_orderpriority)""")
def t1_factor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), F.col("o_orderpriority").alias("priority"))
    spec = fit_transform(df, "Table 1", "y", ["priority"], outcome_balance=False)
    m = spec.apply(df).agg(F.avg("priority").alias("a"), F.avg(col("(priority^2)")).alias("b"))
    return m.select(F.round("a", 6).alias("mean_code"), F.round("b", 6).alias("mean_square"))


@query(in_sql("\nunion all\n".join(f"select '{x}' as feature, round(avg({x}), 6) as mean, round(stddev_samp({x}), 6) as sd from fixture where ext = 0" for x in FEATURES)))
def norm_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, moments = normalise(internal(spark, sf_dir).select(*FEATURES), {})
    return spark.createDataFrame([(c, round(m, 6), round(s, 6)) for c, (m, s) in moments.items()], "feature string, mean double, sd double")


@query(in_sql("select " + ", ".join(f"round(({x} - avg({x}) over ()) / stddev_samp({x}) over (), 5) as {x}" for x in FEATURES) + " from fixture where ext = 0"))
def norm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, _, _ = normalise(internal(spark, sf_dir).select(*FEATURES, F.lit(1.0).alias("constant")), {})
    return rounded(scaled, 5)


# Profiles -----------------------------------------------------------------------------------------------------------------

_PROFILED = [*FEATURES, "y", "ext"]


@query(in_sql("\nunion all\n".join(f"select '{x}' as feature, cast(least(3, count(distinct {x})) as integer) as arity, count(*) filter ({x} = (select max({x}) from fixture where ext = 0)) as at_high from fixture where ext = 0" for x in _PROFILED)))
def prof_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_frame(internal(spark, sf_dir), _PROFILED).select("feature", "arity", "at_high")


@query(in_sql("\nunion all\n".join(f"select '{x}' as feature, cast(min({x}) as double) as low, cast(max({x}) as double) as high, round(avg({x}), 6) as mean, round(stddev_samp({x}), 6) as sd from fixture where ext = 0" for x in _PROFILED)))
def prof_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile_frame(internal(spark, sf_dir), _PROFILED).select("feature", "low", "high", "mean", "sd"))


@query(in_sql("select 'x1' as feature, count(*) as n, count(*) filter (x1 > 0.9) as missing, false as zero_one from fixture union all select 'x3', count(*), 0, true from fixture"))
def prof_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir).select(F.when(F.col("x1") <= 0.9, F.col("x1")).alias("x1"), "x3")
    return profile_frame(df).select("feature", "n", "missing", "zero_one")


# Pre-diagnostics ----------------------------------------------------------------------------------------------------------


def _mu(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, float]:
    row = external(spark, sf_dir).agg(*[F.avg(c).alias(c) for c in names or FEATURES]).first()
    return row.asDict()


def _status(spark: SparkSession, pre, *fields: str) -> DataFrame:
    return spark.createDataFrame([(f, str(pre.log[f]).lower() if isinstance(pre.log[f], bool) else str(pre.log[f])) for f in fields], "field string, value string")


@query("select * from (values ('missingInMu', 'true'), ('missingInZ', 'true'), ('nOverlapFeatures', '3'), ('preDiagnosisStatus', 'Failure')) t(field, value)")
def pd_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = {c: v for c, v in _mu(spark, sf_dir).items() if c != "x4"} | {"other": 0.5}
    return _status(spark, pre_diagnostics(internal(spark, sf_dir).select(*FEATURES), mu), "missingInMu", "missingInZ", "nOverlapFeatures", "preDiagnosisStatus")


@query("""select coalesce(z.f, m.f) as feature, m.f is null as in_z_only, z.f is null as in_mu_only
    from (select distinct 'x' || l_linenumber as f from lineitem where l_linenumber <= 4) z full join (select distinct 'x' || l_linenumber as f from lineitem where l_linenumber >= 3) m on z.f = m.f
    where z.f is null or m.f is null""")
def pd_name_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of one side (line numbers, here) that have no mean, and means of features that the other side has not."""
    lines = read_table(spark, sf_dir, "lineitem").select(F.concat(F.lit("x"), "l_linenumber").alias("feature"), "l_linenumber", "l_discount")
    names = [r["feature"] for r in lines.where("l_linenumber <= 4").select("feature").distinct().orderBy("feature").collect()]
    mu = read_means(lines.where("l_linenumber >= 3").groupBy("feature").agg(F.avg("l_discount").alias("mu")))
    z_only, mu_only, _ = overlap(names, mu)
    return spark.createDataFrame([(c, True, False) for c in z_only] + [(c, False, True) for c in mu_only], "feature string, in_z_only boolean, in_mu_only boolean")


@query("select * from (values ('naInZ', 'true', 'Failure'), ('naInMu', 'true', 'Failure')) t(field, value, status)")
def pd_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = _mu(spark, sf_dir)
    z = internal(spark, sf_dir).select(*FEATURES)
    one = pre_diagnostics(z.withColumn("x1", F.when(F.col("x1") <= 0.9, F.col("x1"))), mu)
    two = pre_diagnostics(z, mu | {"x2": float("nan")})
    return spark.createDataFrame([("naInZ", str(one.log["naInZ"]).lower(), one.status), ("naInMu", str(two.log["naInMu"]).lower(), two.status)], "field string, value string, status string")


@query(in_sql("select 'x3' as dropped, (select count(*) from fixture where ext = 0 and x3 = 0) as n_rows, 'x1,x2,x4' as represented"))
def pd_degenerate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = internal(spark, sf_dir).select(*FEATURES)
    pre = pre_diagnostics(z, _mu(spark, sf_dir) | {"x3": 0.0})
    kept = z.where(pre.keep).count()
    return spark.createDataFrame([("x3", kept, ",".join(pre.represented))], "dropped string, n_rows long, represented string")


@query(in_sql("""select 'rare' as feature, proxy > 0.000625 as skewed, 'Failure' as status from (
    select (1 - 0.5) * (1 - 0.5) / (n - n1 * f) + 0.5 * 0.5 / (n1 * f) as proxy from (
        select count(*) as n, count(*) filter (p >= 0.66 and x2 >= 0.09) as n1, least(20000 / count(*), 1) as f from fixture where ext = 0))"""))
def pd_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = internal(spark, sf_dir).select("x1", F.when((F.col("p") >= 0.66) & (F.col("x2") >= 0.09), 1).otherwise(0).alias("rare"))
    pre = pre_diagnostics(z, {"x1": _mu(spark, sf_dir)["x1"], "rare": 0.5})
    return spark.createDataFrame([(f, True, pre.status) for f in pre.highly_skewed], "feature string, skewed boolean, status string")


@query("select * from (values (0.005, 'false', 'Success'), (0.011, 'true', 'Failure')) t(mu, incompatible, status)".replace("0.005", "cast(0.005 as double)").replace("0.011", "cast(0.011 as double)"))
def pd_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = internal(spark, sf_dir).select("x1", "x2", F.lit(0).alias("constant"))
    mu = _mu(spark, sf_dir, ["x1", "x2"])
    rows = []
    for m in (0.005, 0.011):
        pre = pre_diagnostics(z, mu | {"constant": m})
        rows.append((m, str(pre.log["incompatableUnaryVariable"]).lower(), pre.status))
    return spark.createDataFrame(rows, "mu double, incompatible string, status string")


@query(in_sql("select 'x1' as feature, 'x1, mu=1.5, min=' || cast(min(x1) as varchar) || ', max=' || cast(max(x1) as varchar) as representative, 'Failure' as status from fixture where ext = 0"))
def pd_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = internal(spark, sf_dir).select(*FEATURES)
    pre = pre_diagnostics(z, {"x4": 0.5, "x3": 0.3, "x2": 0.05, "x1": 1.5})
    return spark.createDataFrame([(pre.out_of_range[0], pre.log["outOfRangeRepresentative"], pre.status)], "feature string, representative string, status string")


@query("select 'Few samples n=' || cast(count(*) as varchar) || ', p=2' as description, 'Failure' as status from region")
def pd_fewsamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("a"), (F.col("r_regionkey") * F.col("r_regionkey")).alias("b"))
    pre = pre_diagnostics(z, {"a": 2.0, "b": 6.0})
    return spark.createDataFrame([(pre.log["fewSamplesDescription"], pre.status)], "description string, status string")


@query("select * from (values " + ", ".join(f"({i}, '{f}', {n}, {t})" for i, (f, n, t) in enumerate([("preDiagnosisStatus", "null", "'Success'"), ("missingInMu", "0.0", "null"), ("missingInZ", "0.0", "null"), ("nOverlapFeatures", "4.0", "null"), ("naInZ", "0.0", "null"), ("naInMu", "0.0", "null"), ("highlySkewedBinary", "0.0", "null"), ("highSkewRepresentative", "null", "null"), ("incompatableUnaryVariable", "0.0", "null"), ("incompatibleUnaryRepresentative", "null", "null"), ("outOfRange", "0.0", "null"), ("outOfRangeRepresentative", "null", "null"), ("fewSamples", "0.0", "null"), ("fewSamplesDescription", "null", "null")])) + ") t(position, field, value_num, value_str)")
def pd_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pre_diagnostics(internal(spark, sf_dir).select(*FEATURES), _mu(spark, sf_dir)).frame(spark)


# Measures -----------------------------------------------------------------------------------------------------------------


def _auroc_sql(weight: str) -> str:
    return f"""points as (select p, sum(case when y = 1 then {weight} else 0 end) as pos, sum(case when y = 1 then 0 else {weight} end) as neg from fixture where ext = 0 group by p),
    area as (select sum(pos * below) / (sum(pos) * sum(neg)) as auroc from (select pos, neg, sum(neg) over (order by p) - neg / 2.0 as below from points))"""


_LOGLIK = "case when (y = 0 and p = 0) or (y = 1 and p = 1) then 0 else y * ln(p) + (1 - y) * ln(1 - p) end"


def _measure_sql(weight: str) -> str:
    return f"""with {FIXTURE_SQL}, {_auroc_sql(weight)}
select count(*) as n, sum(y)::bigint as n_outcome, round(any_value(auroc), 6) as auroc, round(sum({weight} * (y - p) * (y - p)) / sum({weight}), 6) as brier, round(sum({weight} * p) / sum({weight}), 6) as mean_prediction,
       round(sum({weight} * y) / sum({weight}), 6) as observed_risk, round(sum({weight} * {_LOGLIK}) / sum({weight}), 6) as log_likelihood from fixture, area where ext = 0"""


@query(f"with {FIXTURE_SQL}, {_auroc_sql('1')} select round(auroc, 6) as auroc from area")
def m_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(auroc(internal(spark, sf_dir), F.col("y"), F.col("p")))


@query(f"with {FIXTURE_SQL}, {_auroc_sql('w')} select round(auroc, 6) as auroc from area")
def m_wauroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(auroc(internal(spark, sf_dir), F.col("y"), F.col("p"), F.col("w")))


@query(_measure_sql("w"))
def m_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures(internal(spark, sf_dir), w="w"))


@query(_measure_sql("1"))
def m_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures(internal(spark, sf_dir)))


for _name, _measure in (("m_brier", "brier"), ("m_loglik", "log_likelihood"), ("m_calib_pred", "mean_prediction"), ("m_calib_obs", "observed_risk")):
    query(f"select {_measure} from ({_measure_sql('w')})", _name)(lambda spark, sf_dir, _measure=_measure: rounded(measures(internal(spark, sf_dir), w="w").select(_measure)))


@query(in_sql("""select x3 as by_x3, round(sum(pos * below) / (sum(pos) * sum(neg)), 6) as auroc from (
    select x3, pos, sum(neg) over (partition by x3 order by p) - neg / 2.0 as below, neg from (
        select x3, p, sum(case when y = 1 then w else 0 end) as pos, sum(case when y = 1 then 0 else w end) as neg from fixture group by x3, p)) group by x3"""))
def m_auroc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(auroc(fixture(spark, sf_dir).withColumnRenamed("x3", "by_x3"), F.col("y"), F.col("p"), F.col("w"), by=["by_x3"]))


# Post-diagnostics ---------------------------------------------------------------------------------------------------------

_DIVERGE = "from (select count(*) as n, sum(w) as s, max(w) as top, sum(w * w) as s2, sum(w * ln(w)) as sl from fixture where ext = 0)"
for _name, _sql, _measure in (("post_maxw", "cast(top as double)", "max_weight"), ("post_chi2", "round(n * s2 / (s * s) - 1, 6)", "chi2_to_uniform"), ("post_kl", "round(ln(n) + sl / s - ln(s), 6)", "kl")):
    query(in_sql(f"select {_sql} as {_measure} {_DIVERGE}"), _name)(lambda spark, sf_dir, _measure=_measure: rounded(weight_divergence(internal(spark, sf_dir), F.col("w").cast("double")).select(_measure)))

_SIDES = "(select sum(w * {x}) / sum(w) as m1, sum(w * {x} * {x}) / sum(w) as s1 from fixture where ext = 0), (select avg({x}) as m0, avg({x} * {x}) as s0 from fixture where ext = 1)"
_SMD_BIN = "select '{x}' as feature, abs(m1 - m0) / sqrt(m0 * (1 - m0) + m1 * (1 - m1)) as smd from " + _SIDES
_SMD_CONT = "select '{x}' as feature, abs(m1 - m0) / sqrt(s0 - m0 * m0 + s1 - m1 * m1) as smd from " + _SIDES


def _two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, float], list[tuple[str, ...]]]:
    own = internal(spark, sf_dir)
    spec = fit_transform(own.select("y", *FEATURES), "Table 1", "y", FEATURES, outcome_balance=False)
    return spec.apply(own, keep=["w"]), spec.means(external(spark, sf_dir)), smd_sets(spec)


@query(in_sql("select feature, round(smd, 6) as smd from (" + " union all ".join(_SMD_BIN.format(x=x) for x in ("x3", "x4", "y")) + ")"))
def post_smd_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, mu, sets = _two_sides(spark, sf_dir)
    return rounded(smd(z, mu, [s for s in sets if len(s) == 1], F.col("w")))


@query(in_sql("select feature, round(smd, 6) as smd from (" + " union all ".join(_SMD_CONT.format(x=x) for x in ("x1", "x2")) + ")"))
def post_smd_cont(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, mu, sets = _two_sides(spark, sf_dir)
    return rounded(smd(z, mu, [s for s in sets if len(s) == 2], F.col("w")))


@query(in_sql("select 'size' as feature, round(abs(m1 - m0) / sqrt(2 * (s1 - m1)), 6) as smd from (select sum(w * x1 * 50) / sum(w) as m1, sum(w * x1 * 50 * x1 * 50) / sum(w) as s1 from fixture where ext = 0), (select avg(x1 * 50) as m0 from fixture where ext = 1)"))
def post_smd_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.col("x1") * 50).alias("size")
    mu = external(spark, sf_dir).agg(F.avg(size).alias("size")).first().asDict()
    return rounded(smd(internal(spark, sf_dir).select(size, "w"), mu, [("size",)], F.col("w")))


@query(in_sql("select round(max(smd), 6) as max_smd from (" + " union all ".join([*(_SMD_BIN.format(x=x) for x in ("x3", "x4", "y")), *(_SMD_CONT.format(x=x) for x in ("x1", "x2"))]) + ")"))
def post_smd_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, mu, sets = _two_sides(spark, sf_dir)
    return spark.createDataFrame([(round(max_smd(z, mu, sets, F.col("w")), 6),)], "max_smd double")


# Optimizers ---------------------------------------------------------------------------------------------------------------

_EG = ["x1", "x2", "x4"]


def _eg_sql(steps: int, alpha: float = 0.5, beta: float = 0.9) -> str:
    mu = "mu as (select " + ", ".join(f"avg({x}) as {x}" for x in _EG) + " from fixture where ext = 1)"
    parts = [mu, "theta0 as (select " + ", ".join(f"0.0::double as t_{x}, 0.0::double as u_{x}" for x in _EG) + ")"]
    for i in range(1, steps + 1):
        score = " + ".join(f"f.{x} * t.t_{x}" for x in _EG)
        parts.append(f"means{i} as (select " + ", ".join(f"sum(exp(-({score})) * f.{x}) / sum(exp(-({score}))) as {x}" for x in _EG) + f" from fixture f, theta{i - 1} t where f.ext = 0)")
        parts.append(f"theta{i} as (select " + ", ".join(f"t.t_{x} + {alpha} * ({beta} * t.u_{x} + m.{x} - mu.{x}) as t_{x}, {beta} * t.u_{x} + m.{x} - mu.{x} as u_{x}" for x in _EG) + f" from theta{i - 1} t, means{i} m, mu)")
    rows = " union all ".join(f"select '{x}' as feature, round(t_{x}, 6) as theta from theta{steps}" for x in _EG)
    return f"with {FIXTURE_SQL}, {', '.join(parts)} {rows}"


@query(_eg_sql(3))
def eg_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    theta = distributed.gradient_tilt(internal(spark, sf_dir).select(*_EG), _mu(spark, sf_dir, _EG), _EG, 0.5, 3)
    return spark.createDataFrame([(c, round(float(t), 6)) for c, t in zip(_EG, theta, strict=True)], "feature string, theta double")


def _fixture_problem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, float]]:
    own = internal(spark, sf_dir).select("y", *FEATURES)
    spec = fit_transform(own, "Table 1", "y", FEATURES)
    return spec.apply(own), spec.means(external(spark, sf_dir))


_TILT = ["y", "x2", "x3"]


def _newton_sql(steps: int = 8, base: str = "1.0") -> str:
    """CTEs for the multipliers ``t1, t2, t3`` of the entropy problem on three features: Newton steps, three by three in full."""
    f = _TILT
    parts = ["mu as materialized (select " + ", ".join(f"avg({c}) as u{i}" for i, c in enumerate(f, 1)) + " from fixture where ext = 1)", "t0 as (select 0.0::double as t1, 0.0::double as t2, 0.0::double as t3)"]
    for k in range(1, steps + 1):
        e = f"{base} * exp(-(" + " + ".join(f"t{i} * {c}" for i, c in enumerate(f, 1)) + "))"
        sums = [f"sum({e} * {c}) / sum({e}) as m{i}" for i, c in enumerate(f, 1)]
        sums += [f"sum({e} * {f[i]} * {f[j]}) / sum({e}) as h{i + 1}{j + 1}" for i in range(3) for j in range(i, 3)]
        parts.append(f"s{k} as materialized (select any_value(t1) as t1, any_value(t2) as t2, any_value(t3) as t3, {', '.join(sums)} from fixture, t{k - 1} where ext = 0)")
        parts.append(f"c{k} as materialized (select *, " + ", ".join(f"h{i}{j} - m{i} * m{j} as v{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j) + ", m1 - u1 as g1, m2 - u2 as g2, m3 - u3 as g3 from " + f"s{k}, mu)")
        det = "(v11 * (v22 * v33 - v23 * v23) - v12 * (v12 * v33 - v13 * v23) + v13 * (v12 * v23 - v13 * v22))"
        rows = ("(v22 * v33 - v23 * v23) * g1 + (v13 * v23 - v12 * v33) * g2 + (v12 * v23 - v13 * v22) * g3", "(v13 * v23 - v12 * v33) * g1 + (v11 * v33 - v13 * v13) * g2 + (v12 * v13 - v11 * v23) * g3",
                "(v12 * v23 - v13 * v22) * g1 + (v12 * v13 - v11 * v23) * g2 + (v11 * v22 - v12 * v12) * g3")
        parts.append(f"t{k} as materialized (select " + ", ".join(f"t{i} + ({r}) / {det} as t{i}" for i, r in enumerate(rows, 1)) + f" from c{k})")
    return ", ".join([FIXTURE_SQL, *parts]) + f", tilted as materialized (select f.*, {base} * exp(-({' + '.join(f't{i} * {c}' for i, c in enumerate(f, 1))})) as e from fixture f, t{steps} where ext = 0)"


def _tilt_sql(digits: int, base: str = "1.0", extra: str = "") -> str:
    """What a solution says: of columns that were matched and of others, its largest weight and its divergence."""
    means = " union all ".join(f"select 'mean {c}' as measure, sum(e * {c}) / sum(e) as value from tilted" for c in ("y", "x2", "x3", "x1", "x4", "p"))
    return f"""with {_newton_sql(base=base)} select {extra}measure, round(value, {digits}) as value from ({means} union all select 'max weight', max(e) * count(*) / sum(e) from tilted
        union all select 'kl', ln(count(*)) + sum(e * ln(e)) / sum(e) - ln(sum(e)) from tilted)"""


def _solution(table: DataFrame, digits: int, w: str = "w") -> DataFrame:
    """The same of a table with ``_count`` and a weight for each row counted."""
    weight = F.col(w) * F.col("_count")
    total = F.sum(weight)
    parts = [(f"mean {c}", F.sum(weight * F.col(c)) / total) for c in ("y", "x2", "x3", "x1", "x4", "p")]
    parts += [("max weight", F.max(w) * F.sum("_count") / total), ("kl", F.log(F.sum("_count")) + F.sum(weight * F.log(w)) / total - F.log(total))]
    row = table.agg(*[e.alias(f"v{i}") for i, (_, e) in enumerate(parts)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.round(f"v{i}", digits).alias("value")) for i, (n, _) in enumerate(parts)])).alias("r")).select("r.*")


def _tilt_problem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, float]]:
    """All columns of the internal rows, of which three are matched."""
    return internal(spark, sf_dir).select("y", "p", *FEATURES), _mu(spark, sf_dir, _TILT)


@query(_tilt_sql(3))
def eg_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-MSE at its default tolerances; its limit is the tilt that Newton steps find."""
    z, mu = _tilt_problem(spark, sf_dir)
    return _solution(solve_whole(z, mu, optimizers.TunedExponentiatedGradient()).weights, 3)


@query(_tilt_sql(3))
def eg_converged_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same settings as passes over the table, with nothing collected but sums; the rates are tried in the same passes."""
    z, mu = _tilt_problem(spark, sf_dir)
    return _solution(solve_whole(z, mu, optimizers.TunedExponentiatedGradient(), max_local=0).weights, 3)


@query(_tilt_sql(3, "w", "run, ") + " cross join (values ('on the driver'), ('as passes'), ('newton')) t(run)")
def eg_initial_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that start from the column ``w``: W-MSE on the driver and as passes, and Newton steps, have the same limit."""
    z, mu = different_rows(internal(spark, sf_dir).select("y", "p", "w", *FEATURES)), _mu(spark, sf_dir, _TILT)
    runs = {"on the driver": (optimizers.TunedExponentiatedGradient(), 50_000), "as passes": (optimizers.TunedExponentiatedGradient(), 0), "newton": (None, 0)}
    out = None
    for run, (optimizer, most) in runs.items():
        part = _solution(solve_whole(z, mu, optimizer, most, name="found", w0="w", count="_count").weights, 3, "found").select(F.lit(run).alias("run"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(_tilt_sql(6))
def dual_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newton steps over the whole table, no optimizer on the driver."""
    z, mu = _tilt_problem(spark, sf_dir)
    return _solution(solve_whole(z, mu).weights, 6)


@query(_tilt_sql(3))
def sgd_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dual SGD with samples as large as the table, down to an error of 1e-8."""
    z, mu = _tilt_problem(spark, sf_dir)
    return _solution(solve_whole(z, mu, optimizers.DualSGD(batch=1 << 40, improve_th=1e-8, n_iter=3000)).weights, 3)


@query(_tilt_sql(2))
def sgd_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dual SGD over the table, whose samples are partitions of stored rows: a quarter of them in each step."""
    z, mu = _tilt_problem(spark, sf_dir)
    quarter = -(-z.count() // 4)
    return _solution(solve_whole(z, mu, optimizers.DualSGD(epsilons=(0.3,), n_tune_iter=10, batch=quarter, improve_th=1e-6, n_iter=400), max_local=0).weights, 2)


@query("select measure, status from (values ('no weights', 'Failure')) t(measure, status)")
def solve_out_of_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means that no weights have: the status says so and there are no weights."""
    z, _ = _tilt_problem(spark, sf_dir)
    found = solve_whole(z, {"y": 7.0, "x2": 5.0})
    return spark.createDataFrame([("weights" if found.table else "no weights", found.status)], "measure string, status string")


_BALL = 5.0  # lambda; the ball of its dual has the radius 1 / 5


def _ball_sql(steps: int = 40) -> str:
    z = [f"(({c} - b{i}) / d{i})" for i, c in enumerate(_TILT, 1)]
    base = "base as materialized (select " + ", ".join(f"avg({c}) as b{i}, stddev_samp({c}) as d{i}" for i, c in enumerate(_TILT, 1)) + " from fixture where ext = 0)"
    mu = "mu as materialized (select " + ", ".join(f"(avg({c}) - any_value(b{i})) / any_value(d{i}) as u{i}" for i, c in enumerate(_TILT, 1)) + " from fixture, base where ext = 1)"
    parts = [FIXTURE_SQL, base, mu, "rows as materialized (select " + ", ".join(f"{e} as z{i}" for i, e in enumerate(z, 1)) + " from fixture, base where ext = 0)", "t0 as (select 0.0::double as t1, 0.0::double as t2, 0.0::double as t3)"]
    for k in range(1, steps + 1):
        e = "exp(-(t1 * z1 + t2 * z2 + t3 * z3))"
        parts.append(f"s{k} as materialized (select " + ", ".join(f"any_value(t{i}) + 0.8 * (sum({e} * z{i}) / sum({e}) - any_value(u{i})) as n{i}" for i in (1, 2, 3)) + f" from rows, mu, t{k - 1})")
        parts.append(f"t{k} as materialized (select " + ", ".join(f"n{i} / greatest(1, sqrt(n1 * n1 + n2 * n2 + n3 * n3) * {_BALL}) as t{i}" for i in (1, 2, 3)) + f" from s{k})")
    rows = " union all ".join(f"select '{c}' as feature, round(t{i}, 5) as nu from t{steps}" for i, c in enumerate(_TILT, 1))
    return f"with {', '.join(parts)} {rows}"


@query(_ball_sql())
def dual_lambda_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipliers of the dual problem held within the ball of lambda, which binds here."""
    z, mu = _tilt_problem(spark, sf_dir)
    found = solve_whole(z, mu, optimizers.ConvexOptimizer(lam=_BALL), max_local=0)
    return spark.createDataFrame([(c, round(v, 5)) for c, v in found.nu.items()], "feature string, nu double")


def _chi2_solution(table: DataFrame, features: list[str]) -> DataFrame:
    n = F.sum("_count")
    parts = [(f"mean {c}", F.sum(F.col("_count") * F.col("w") * F.col(c)) / n) for c in features]
    parts += [("min weight", F.min("w")), ("max weight", F.max("w")), ("chi2", F.sum(F.col("_count") * F.col("w") * F.col("w")) / n - 1), ("share at 0", F.sum(F.when(F.col("w") <= 0, F.col("_count")).otherwise(0)) / n)]
    row = table.agg(*[e.alias(f"v{i}") for i, (_, e) in enumerate(parts)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.round(f"v{i}", 6).alias("value")) for i, (k, _) in enumerate(parts)])).alias("r")).select("r.*")


_CHI2 = optimizers.ConvexOptimizer(lam=0.0, divergence="chi2", method="primal")


@query(in_sql("""select measure, round(value, 6) as value from (
    select unnest(['mean x2', 'mean x3', 'min weight', 'max weight', 'chi2', 'share at 0']) as measure, unnest([sum(w * x2) / count(*), sum(w * x3) / count(*), min(w), max(w), sum(w * w) / count(*) - 1, 0]) as value from (
        select x2, x3, 1 + ((x2 - m2) * (v33 * g2 - v23 * g3) + (x3 - m3) * (v22 * g3 - v23 * g2)) / (v22 * v33 - v23 * v23) as w from fixture, (
            select avg(x2) filter (ext = 0) as m2, avg(x3) filter (ext = 0) as m3, avg(x2) filter (ext = 1) - avg(x2) filter (ext = 0) as g2, avg(x3) filter (ext = 1) - avg(x3) filter (ext = 0) as g3,
                   var_pop(x2) filter (ext = 0) as v22, var_pop(x3) filter (ext = 0) as v33, covar_pop(x2, x3) filter (ext = 0) as v23 from fixture)
        where ext = 0))"""))
def chi2_primal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square weights with equal means, where no weight is at 0: linear in the features, so SQL has a closed form."""
    found = solve_whole(internal(spark, sf_dir).select("x2", "x3"), _mu(spark, sf_dir, ["x2", "x3"]), _CHI2, max_local=0)
    return _chi2_solution(found.weights, ["x2", "x3"])


#: Weights max(0, a + b x1): of all thresholds below which weights are 0, the one that agrees with its own line.
@query(in_sql("""select measure, round(value, 6) as value from (
    select unnest(['mean x1', 'min weight', 'max weight', 'chi2', 'share at 0']) as measure, unnest([sum(w * x1) / count(*), min(w), max(w), sum(w * w) / count(*) - 1, count(*) filter (w <= 0) / count(*)]) as value
    from (select x1, greatest(0, a + b * x1) as w from fixture, line where ext = 0))""").replace("\nselect measure", """, points as (
    select x1, count(*)::double as c from fixture where ext = 0 group by x1
), goal as (
    select sum(c) as n, sum(c * x1) / sum(c) + 0.25 as mu from points
), sums as (
    select x1 as t, lag(x1) over (order by x1) as before, sum(c) over o as n0, sum(c * x1) over o as n1, sum(c * x1 * x1) over o as n2 from points window o as (order by x1 rows between current row and unbounded following)
), lines as (
    select t, before, (n * mu - n * n1 / n0) / nullif(n2 - n1 * n1 / n0, 0) as b, n0, n1, n from sums, goal
), line as (
    select (n - b * n1) / n0 as a, b from lines where (n - b * n1) / n0 + b * t > 0 and (before is null or (n - b * n1) / n0 + b * before <= 0) order by t limit 1
)
select measure""", 1))
def chi2_at_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the mean asked for is so far off that many weights are 0."""
    z = internal(spark, sf_dir).select("x1")
    mean = z.agg(F.avg("x1")).first()[0]
    return _chi2_solution(solve_whole(z, {"x1": mean + 0.25}, _CHI2, max_local=0).weights, ["x1"])


#: One 0/1 feature: the entropy weights have multiplier log(odds / target odds) / width, held within 1 / lambda; the chi-square mean moves by at most (n - 1) / (2 lambda) deviations.
@query(in_sql("""select divergence, distance, round(mean, 6) as mean from (
    select 'entropy' as divergence, m * exp(-nu * width) / (1 - m + m * exp(-nu * width)) as mean from (
        select *, 1 / sd as width, greatest(-0.2, least(0.2, ln(m * (1 - u) / ((1 - m) * u)) * sd)) as nu from sides)
    union all select 'chi2', m + sd * sign(u - m) * least(abs(u - m) / sd, (n - 1) / (2 * 5.0 * n)) from sides), (values ('l1'), ('l2')) d(distance)""").replace("\nselect divergence", """, sides as (
    select avg(y) filter (ext = 0) as m, avg(y) filter (ext = 1) as u, stddev_samp(y) filter (ext = 0) as sd, count(*) filter (ext = 0) as n from fixture)
select divergence""", 1))
def primal_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, mu = internal(spark, sf_dir).select("y"), _mu(spark, sf_dir, ["y"])
    n = z.count()
    rows = []
    for divergence in ("entropy", "chi2"):
        for distance in ("l1", "l2"):
            lam = 5.0 * (1 if divergence == "entropy" else n)
            found = solve_whole(z, mu, optimizers.ConvexOptimizer(lam, divergence=divergence, distance=distance, method="primal"), max_local=0)
            mean = found.weights.agg(F.sum(F.col("_count") * F.col("w") * F.col("y")) / F.sum("_count")).first()[0]
            rows.append((divergence, distance, round(mean, 6)))
    return spark.createDataFrame(rows, "divergence string, distance string, mean double")


@query(in_sql(" union all ".join(f"select '{c}' as feature, round(avg({c}), 2) as mean from fixture where ext = 1" for c in _TILT)))
def adam_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adam finds weights that need not be a tilt, but their means are the external ones."""
    z, mu = internal(spark, sf_dir).select(*_TILT), _mu(spark, sf_dir, _TILT)
    found = solve_whole(z, mu, optimizers.AdamSoftmax()).weights
    weight = F.col("w") * F.col("_count")
    row = found.agg(*[(F.sum(weight * F.col(c)) / F.sum(weight)).alias(c) for c in _TILT])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 2).alias("mean")) for c in _TILT])).alias("r")).select("r.*")


@query(in_sql("select count(*) as groups, sum(n)::bigint as n from (select x1, x2, x3, x4, y, count(*) as n from fixture where ext = 0 group by all)"))
def row_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = distributed.compress(internal(spark, sf_dir).select(*FEATURES, "y"))
    return small.agg(F.count(F.lit(1)).alias("groups"), F.sum("_count").alias("n"))


# Sampling and summaries ---------------------------------------------------------------------------------------------------


@query(in_sql("""select n_max, cast(case when n1 < n_max / 2.0 then least(n_max - n1, n0) when n0 < n_max / 2.0 then n0 else n_max / 2.0 end as bigint) as n0,
    cast(case when n1 < n_max / 2.0 then n1 when n0 < n_max / 2.0 then least(n_max - n0, n1) else n_max / 2.0 end as bigint) as n1
    from (select count(*) filter (y = 1) as n1, count(*) filter (y = 0) as n0 from fixture where ext = 0), (values (1000), (20000), (25000)) t(n_max)"""))
def smp_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = internal(spark, sf_dir).agg(F.count(F.when(F.col("y") == 1, 1)).alias("n1"), F.count(F.when(F.col("y") == 0, 1)).alias("n0")).first()
    rows = [(m, *sampling.stratified_sizes(row["n0"], row["n1"], m)) for m in (1000, 20000, 25000)]
    return spark.createDataFrame(rows, "n_max int, n0 long, n1 long")


def _stored(df: DataFrame) -> DataFrame:
    return sampling.with_row_id(df).persist()


#: Draws are random, so SQL has what they estimate: sizes, the share of rows that n draws meet, and the mean of a feature.
@query(in_sql("select rep::integer as rep, count(*) as size, round(1 - exp(-1), 1) as met, round(avg(x1), 1) as mean from fixture, range(3) t(rep) where ext = 0 group by rep"))
def smp_boot_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored(internal(spark, sf_dir))
    n = rows.count()
    drawn = sampling.bootstrap(rows, n, 3)
    return drawn.groupBy("rep").agg(F.sum("mult").alias("size"), F.round(F.countDistinct("row_id") / n, 1).alias("met"), F.round(F.sum(F.col("x1") * F.col("mult")) / n, 1).alias("mean"))


@query(in_sql("select rep::integer as rep, count(*) // 2 as size, count(*) // 2 as different, round(avg(x1), 1) as mean from fixture, range(3) t(rep) where ext = 0 group by rep"))
def smp_norepl_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored(internal(spark, sf_dir))
    drawn = sampling.subset(rows, rows.count() // 2, 3)
    return drawn.groupBy("rep").agg(F.sum("mult").alias("size"), F.countDistinct("row_id").alias("different"), F.round(F.avg("x1"), 1).alias("mean"))


@query(in_sql("""select rep::integer as rep, y, cast(any_value(case when n1 < m / 2.0 then case y when 1 then n1 else least(m - n1, n0) end else m // 2 end) as bigint) as size, round(avg(x1), 1) as mean
    from fixture, range(2) t(rep), (select count(*) * 8 // 10 // 2 * 2 as m, count(*) filter (y = 1) as n1, count(*) filter (y = 0) as n0 from fixture where ext = 0) where ext = 0 group by rep, y"""))
def smp_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = internal(spark, sf_dir).persist()
    drawn = sampling.stratified(rows, "y", rows.count() * 8 // 10 // 2 * 2, 2)
    return drawn.groupBy("rep", "y").agg(F.sum("mult").alias("size"), F.round(F.sum(F.col("x1") * F.col("mult")) / F.sum("mult"), 1).alias("mean"))


@query("with l as (select quality from labels) select quality, count(*) * case when quality = 1 and n1 < n0 / 2.0 then n0 // n1 else 1 end as n from (select 1 - quality as quality from l), (select count(*) filter (quality = 0) as n1, count(*) filter (quality = 1) as n0 from l) group by quality, n0, n1")
def up_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = read_table(spark, sf_dir, "labels").select((1 - F.col("quality")).alias("quality"))
    return sampling.upsample(labelled, "quality").groupBy("quality").agg(F.count("*").alias("n"))


_REPS = "reps as (select (l_orderkey % 40)::integer as rep, l_returnflag as metric, avg(l_discount) as value from lineitem group by all)"


@query(f"""with {_REPS} select metric, round(exp(avg(ln(1 + value)) - 1.96 * stddev_samp(ln(1 + value))) - 1, 6) as lower, round(quantile_cont(value, 0.5), 6) as median,
    round(exp(avg(ln(1 + value)) + 1.96 * stddev_samp(ln(1 + value))) - 1, 6) as upper, round(stddev_samp(value), 6) as sd, count(value) as n from reps group by metric""")
def bs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = read_table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 40).cast("int").alias("rep"), F.col("l_returnflag").alias("metric")).agg(F.avg("l_discount").alias("value"))
    return rounded(summarise(reps))


@query(in_sql("select 'a' as section, 'n' as field, count(*)::double as value_num, null::varchar as value_str from fixture union all select 'b', 'y', round(avg(y), 6), null from fixture"))
def res_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir)
    one = df.agg(F.count("*").cast("double").alias("value")).select(F.lit("n").alias("field"), "value")
    two = df.agg(F.round(F.avg("y"), 6).alias("value")).select(F.lit("y").alias("field"), "value")
    return union_sections({"a": one, "b": two})


@query(in_sql("""select field, round(max(value) filter (side = 0), 6) as internal, round(max(value) filter (side = 1), 6) as external from (
    select ext as side, unnest(['p', 'y']) as field, unnest([avg(p), avg(y)]) as value from fixture group by ext union all select 0, 'x1', avg(x1) from fixture where ext = 0) group by field"""))
def res_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two runs side by side, where one has a field that the other has not."""
    df = fixture(spark, sf_dir)

    def means(ext: int, *names: str) -> DataFrame:
        row = df.where(F.col("ext") == ext).agg(*[F.avg(c).alias(c) for c in names])
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in names])).alias("r")).select("r.*")

    return rounded(results_table({"internal": means(0, "p", "y", "x1"), "external": means(1, "p", "y")}))


@query("select (l_orderkey - 1) // 500 as block, round(avg(l_quantity), 6) as l_quantity, round(avg(l_tax), 6) as l_tax from lineitem where l_orderkey > 0 group by all")
def log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a log over blocks of iterations."""
    log = read_table(spark, sf_dir, "lineitem").where("l_orderkey > 0").select("l_orderkey", "l_quantity", "l_tax")
    return rounded(block_means(log, 500, "l_orderkey"))


@query("select p_name as feature, round(s, 6) as coefficient from (select any_value(p_name) as p_name, sum(l_discount - l_tax) as s from lineitem join part on p_partkey = l_partkey group by p_partkey) order by abs(s) desc, p_name limit 10")
def top_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the ten largest by size, of either sign.

    Sums are rounded before they are ordered, so equal ones are in the order of their names however they were added up.
    """
    parts = read_table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.min("p_name").alias("p_name"), F.count("*").alias("n"))
    sums = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_discount") - F.col("l_tax")).alias("coefficient"))
    named = sums.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("feature"), F.round(F.col("coefficient") * F.col("n"), 9).alias("coefficient"))
    return rounded(top_features(named, 10))


@query("select count(*) as n, count(distinct o_orderkey) as different, sum(o_orderkey)::bigint as keys, round(sum(o_totalprice), 2) as price, true as moved from orders")
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows come back, each once, in an order that is not that of their keys."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    mixed = sampling.shuffle(orders, 7, "o_orderkey").withColumn("at", F.monotonically_increasing_id())
    sums = mixed.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("different"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("price"), (F.abs(F.corr("at", "o_orderkey")) < 0.1).alias("moved"))
    return sums


#: The distribution function by a series that SQL sums: 1/2 + density (x + x^3/3 + x^5/15 + ...).
@query("""with recursive xs as (select distinct round(l_discount * 40 - 2, 3) as x from lineitem), terms(x, k, term, total) as (
    select x, 0, x, x from xs union all select x, k + 1, term * x * x / (2 * k + 3), total + term * x * x / (2 * k + 3) from terms where k < 60)
    select x, round(0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * total, 9) as cdf from terms where k = 60""")
def normal_cdf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = read_table(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") * 40 - 2, 3).alias("x")).distinct()
    return xs.select("x", F.round(normal_cdf("x"), 9).alias("cdf"))


_CORE = ["AUROC", "Brier score", "Global calibration mean prediction", "Global calibration observed risk"]
_WEIGHTING = ["Opt err", "n iter", "n outcome", "Max Weighted SMD"]
_METRICS = {"estimation": _CORE, "weighting": _WEIGHTING}


@query("with named as (select unnest(['estimation', 'weighting']) as kind, unnest([" + ", ".join(f"{m}" for m in _METRICS.values()) + """]) as metrics),
    reps as (select kind, (l_orderkey % 40)::integer as rep, metrics[l_linenumber % 4 + 1] as metric, avg(l_discount) as value from lineitem, named group by all),
    sums as (select kind, metric, avg(value) as mean, avg(ln(1 + value)) as m, stddev_samp(ln(1 + value)) as se, quantile_cont(value, 0.5) as median, stddev_samp(value) as sd from reps group by all),
    fields as (select kind, unnest([metric, '95% lower ' || metric, 'Median    ' || metric, '95% upper ' || metric, metric || ' sd']) as field, unnest([mean, exp(m - 1.96 * se) - 1, median, exp(m + 1.96 * se) - 1, sd]) as value from sums)
    select kind, field, round(value, 6) as value from fields""")
def res_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the two lists (but the number of repetitions), each with its value, from repetitions of their metrics."""
    lines = read_table(spark, sf_dir, "lineitem")
    out = None
    for kind, metrics, fields in (("estimation", _CORE, estimation_fields()), ("weighting", _WEIGHTING, weighting_fields())):
        metric = F.element_at(F.array(*map(F.lit, metrics)), F.col("l_linenumber") % 4 + 1).alias("metric")
        reps = lines.groupBy((F.col("l_orderkey") % 40).cast("int").alias("rep"), metric).agg(F.avg("l_discount").alias("value"))
        part = summary_fields(reps).where(F.col("field").isin(fields)).select(F.lit(kind).alias("kind"), "field", F.round("value", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


#: Fields of the pre-diagnosis, in their order.
_PRE = "preDiagnosisStatus missingInMu missingInZ nOverlapFeatures naInZ naInMu highlySkewedBinary highSkewRepresentative incompatableUnaryVariable incompatibleUnaryRepresentative outOfRange outOfRangeRepresentative fewSamples fewSamplesDescription".split()


@query("select * from (values " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(_PRE)) + ") t(position, field)")
def res_prediagnostic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a diagnosis that was made, in their order."""
    made = pre_diagnostics(internal(spark, sf_dir).select(*FEATURES), _mu(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(made.log)), "position int, field string")


# End to end ---------------------------------------------------------------------------------------------------------------


def _estimate(spark: SparkSession, sf_dir: str, settings: EstimatorSettings):
    own = internal(spark, sf_dir)
    spec = fit_transform(own.select("y", *FEATURES), "Table 1", "y", FEATURES)
    return estimate_external(spec.apply(own.withColumn("_y", F.col("y")), keep=["_y", "p"]), spec.means(external(spark, sf_dir)), settings, y="_y", spec=spec)


#: Means of the features decide Brier score and calibration here, so estimates must be what the external rows say.
_TRUTH = "truth as (select avg(y) as risk, avg(p) as prediction, avg((y - p) * (y - p)) as brier, avg(y) filter (ext = 1) as r1, avg(p) filter (ext = 1) as p1, avg((y - p) * (y - p)) filter (ext = 1) as b1 from fixture)"


@query(f"with {FIXTURE_SQL}, {_TRUTH} select mode, status, case when status = 'Success' then round(r1, 2) end as risk, case when status = 'Success' then round(b1, 2) end as brier from truth, (values ('bootstrap', 'Success'), ('not converged', 'NULL-WSMD'), ('stratified', 'Success'), ('warm start', 'Success')) t(mode, status)")
def est_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    slack = optimizers.TunedExponentiatedGradient(max_success_mse=5e-4)
    cases = {
        "bootstrap": EstimatorSettings(slack, n_repetitions=2, max_wsmd=0.2),
        "stratified": EstimatorSettings(slack, n_max=5000, n_repetitions=2, max_wsmd=0.2),
        "warm start": EstimatorSettings(slack, n_repetitions=1, max_wsmd=0.2, warm_steps=2),
        "not converged": EstimatorSettings(optimizers.TunedExponentiatedGradient(n_tune_iter=2, n_iter=5), n_repetitions=1),
    }
    rows = []
    for mode, settings in cases.items():
        out = _estimate(spark, sf_dir, settings)
        found = {r["field"]: r["value"] for r in out.estimation.collect()} if out.estimation else {}
        rows.append((mode, out.status, *(round(found[f], 2) if f in found else None for f in ("Global calibration observed risk", "Brier score"))))
    return spark.createDataFrame(rows, "mode string, status string, risk double, brier double")


@query(f"""with {FIXTURE_SQL}, {_TRUTH} select 'Success' as status, unnest(['Brier score', 'Global calibration mean prediction', 'Global calibration observed risk']) as field, round(unnest([b1, p1, r1]), 2) as value from truth""")
def est_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All settings as they are by default: tolerance 1e-5, largest weighted SMD 0.05."""
    out = _estimate(spark, sf_dir, EstimatorSettings())
    wanted = ["Brier score", "Global calibration mean prediction", "Global calibration observed risk"]
    return out.estimation.where(F.col("field").isin(wanted)).select(F.lit(out.status).alias("status"), "field", F.round("value", 2).alias("value"))


class EveryRow:
    """A sampler: one repetition, with every row once."""

    def draw(self, rows: DataFrame, n: int) -> DataFrame:
        return rows.select(F.lit(0).alias("rep"), F.lit(1).cast("long").alias("mult"), "*")


#: The weights' limit by Newton steps, and all measures under it.
@query(f"""with {_newton_sql()}, points as (select p, sum(e) filter (y = 1) as pos, coalesce(sum(e) filter (y = 0), 0) as neg from tilted group by p),
    area as (select sum(coalesce(pos, 0) * (below - neg / 2)) / (sum(pos) * sum(neg)) as a from (select *, sum(neg) over (order by p) as below from points)),
    found as (select unnest(['AUROC', 'Brier score', 'Global calibration mean prediction', 'Global calibration observed risk', 'n', 'n outcome', 'Max weight', 'kl']) as field,
        unnest([any_value(a), sum(e * (y - p) * (y - p)) / sum(e), sum(e * p) / sum(e), sum(e * y) / sum(e), count(*), sum(y), max(e) * count(*) / sum(e), ln(count(*)) + sum(e * ln(e)) / sum(e) - ln(sum(e))]) as value from tilted, area)
    select run, 'Success' as status, field, round(value, 3) as value from found, (values ('in a task'), ('as passes')) t(run)""")
def est_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An estimation end to end with a sampler of its own, so that nothing is drawn: in one task, and as passes over a table."""
    z = internal(spark, sf_dir).select(F.col("y").alias("_outcome"), "p", *_TILT)
    out = None
    for run, most in (("in a task", 10_000_000), ("as passes", 0)):
        found = estimate_external(z, _mu(spark, sf_dir, _TILT), EstimatorSettings(n_max=10_000_000, sampler=EveryRow(), max_task_rows=most), y="_outcome")
        fields = found.estimation.unionByName(found.weighting).unionByName(found.extra)
        wanted = ["AUROC", "Brier score", "Global calibration mean prediction", "Global calibration observed risk", "n", "n outcome", "Max weight", "kl"]
        part = fields.where(F.col("field").isin(wanted)).select(F.lit(run).alias("run"), F.lit(found.status).alias("status"), "field", F.round("value", 3).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def est_end2end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimate(spark, sf_dir, EstimatorSettings(optimizers.TunedExponentiatedGradient(max_success_mse=5e-4), n_repetitions=4, max_wsmd=0.2)).results


#: The four measures and counts to six digits.  Resamples are random: medians to two digits, limits to a fiftieth, deviations to three digits, as formulas say.
@query(f"""with {FIXTURE_SQL}, own as (select * from fixture where ext = 0), ranked as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as r from own),
    area as (select (sum(r) filter (y = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0) as a, n1, n0 from ranked, (select count(*) filter (y = 1)::double as n1, count(*) filter (y = 0)::double as n0 from own) group by n1, n0),
    plain as (select unnest(['AUROC', 'Brier score', 'Global calibration mean prediction', 'Global calibration observed risk']) as m, unnest([any_value(a), avg((y - p) * (y - p)), avg(p), avg(y)]) as v, count(*) as n,
        unnest([sqrt(any_value(a * (1 - a) + (n1 - 1) * (a / (2 - a) - a * a) + (n0 - 1) * (2 * a * a / (1 + a) - a * a)) / any_value(n1 * n0)), stddev_samp((y - p) * (y - p)) / sqrt(count(*)), stddev_samp(p) / sqrt(count(*)), stddev_samp(y) / sqrt(count(*))]) as se from own, area)
    select m as field, round(v, 6) as value from plain union all select '95% lower ' || m, round((v - 1.96 * se) * 50) / 50 from plain union all select '95% upper ' || m, round((v + 1.96 * se) * 50) / 50 from plain
        union all select 'Median    ' || m, round(v, 2) from plain union all select m || ' sd', round(se, 3) from plain union all select 'n', count(*)::double from own union all select 'n outcome', sum(y)::double from own""")
def int_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = estimate_internal(internal(spark, sf_dir), n_boot=1000)
    name, value = F.col("field"), F.col("value")
    digits = F.when(name.startswith("95%"), F.round(value * 50) / 50).when(name.startswith("Median"), F.round(value, 2)).when(name.endswith(" sd"), F.round(value, 3))
    return found.select("field", digits.otherwise(F.round(value, 6)).alias("value"))


@query(f"""with {FIXTURE_SQL} select metric, round(i, 3) as internal, round(e, 3) as estimated, round(e, 3) as external from (
    select unnest(['Brier score', 'Global calibration mean prediction', 'Global calibration observed risk']) as metric, unnest([avg((y - p) * (y - p)) filter (ext = 0), avg(p) filter (ext = 0), avg(y) filter (ext = 0)]) as i,
        unnest([avg((y - p) * (y - p)) filter (ext = 1), avg(p) filter (ext = 1), avg(y) filter (ext = 1)]) as e from fixture)""")
def est_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and calibration follow from the matched means, so the estimate must agree with the external truth."""
    found = flagship(spark, fixture(spark, sf_dir), FEATURES).where("metric <> 'AUROC'")
    return rounded(found.select("metric", "internal", "estimated", "external"), 3)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, fixture(spark, sf_dir), FEATURES)

