"""The catalogue: queries over the driver tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql as Q
from .functions import codes, kernels
from .operators import cluster, counts, features, metrics, select
from .plans import mining
from .sources import series as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            SQL[name or f.__name__] = oracle
        return f

    return add


SHORT = range(2, 6)
UP_TO_5 = [2, 3, 4, 5]
ALL_TO_31 = list(range(2, 32))
EMB = [2, 3, 4, 5, 6]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.view(spark, sf_dir, "events")


def _event_support(spark: SparkSession, sf_dir: str, minsup: float = 2.0) -> DataFrame:
    return counts.corpus_support(counts.series_counts(_events(spark, sf_dir), SHORT), minsup)


def _dictionary(mined: mining.Mined) -> DataFrame:
    return mined.dictionary.select(F.col("rank").cast("int").alias("rank"), "code", "length", "support", "qualifying_series")


# --- encoding ---------------------------------------------------------------------------------------------------------


@query(Q.series("events") + Q.PD + " select sid as series_id, pos::int as pos, pd::int as pd from pd")
def pd_encode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent distances by array functions."""
    return counts.distances(src.view(spark, sf_dir, "events", 1).select("series_id", "x"))


@query(Q.series("embeddings") + Q.PD + " select sid as series_id, pos::int as pos, pd::int as pd from pd")
def pd_encode_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent distances by the linear kernel."""
    return src.view(spark, sf_dir, "embeddings").select("series_id", F.posexplode(kernels.parent_distance_linear("x")).alias("pos", "pd"))


@query(Q.series("events") + Q.LIM + " select sid as series_id, pos::bigint as pos, lim::int as lim from lim")
def distinct_limits_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.distinct_limits(src.view_rows(spark, sf_dir, "events"))


@query(Q.series("suppliers") + Q.LIM + " select sid as series_id, pos::int as pos, lim::int as lim from lim")
def distinct_limits_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.view(spark, sf_dir, "suppliers", 1).select("series_id", F.posexplode(kernels.linear_limits(F.col("x"))).alias("pos", "lim"))


@query(Q.series("events") + Q.LIM + ", h as (select l.m::int as length, (select count(*) from lim where lim >= l.m)::bigint as windows from range(2, 9) l(m)) select * from h")
def valid_windows_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.valid_windows(counts.distinct_limits(src.view_rows(spark, sf_dir, "events")), 8)


# --- counting ---------------------------------------------------------------------------------------------------------

_COUNTS = f" select sid as series_id, m::int as length, {Q.TEXT} as code, c::double as cnt from k"


@query(Q.counts("events", UP_TO_5) + _COUNTS)
def series_counts_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.series_counts(_events(spark, sf_dir), SHORT).drop("bin")


@query(Q.counts("events", UP_TO_5, "native") + _COUNTS)
def series_counts_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.series_counts(_events(spark, sf_dir), SHORT, "native").drop("bin")


@query(Q.counts("events", UP_TO_5) + _COUNTS)
def series_counts_scratch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window encoded by itself, by array functions: has to equal series_counts_strict."""
    return counts.windows_of(_events(spark, sf_dir), SHORT, scratch=True).groupBy("series_id", "length", "code").agg(F.count("*").cast("double").alias("cnt"))


@query(Q.counts("suppliers", [2, 3, 4, 5, 6]) + _COUNTS)
def series_counts_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.series_counts(src.view(spark, sf_dir, "suppliers"), range(2, 7)).drop("bin")


@query(Q.counts("events", UP_TO_5) + f", e as (select m, code, sum(c)::bigint as windows from k group by all) select m::int as length, {Q.TEXT} as code, windows, (windows * (windows - 1) // 2)::bigint as pairs from e")
def pairwise_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.equal_pairs(counts.series_counts(_events(spark, sf_dir), SHORT))


@query(Q.support("events", UP_TO_5) + f" select m::int as length, {Q.TEXT} as code, support, qualifying from d")
def corpus_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_support(spark, sf_dir)


@query(Q.support("events", UP_TO_5) + " select m::int as length, count(*)::bigint as observed, count(*) filter (where qualifying > 0)::bigint as eligible, max(support) as maximum_support from d group by m")
def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.stage_stats(_event_support(spark, sf_dir))


@query(Q.support("events", UP_TO_5) + " select m::int as length, count(*)::bigint as observed, count(*) filter (where support >= 100)::bigint as eligible, sum(support) as mass from d group by m")
def by_length_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.mass_by_length(_event_support(spark, sf_dir), 100.0)


@query(Q.series("events") + Q.PD + Q.windows([2, 3, 4]) + f" select sid as series_id, m::int as length, {Q.TEXT} as code, least(3, st * 4 // (n - m + 1))::int as bin, count(*)::double as cnt from c group by all")
def binned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.series_counts(_events(spark, sf_dir), range(2, 5), bins=4)


@query(
    Q.series("events") + Q.PD + Q.windows([2, 3, 4], "native") + f" select sid as series_id, m::int as length, {Q.TEXT} as code, round(sum(exp(-2.0 * (n - st - m) / n)), 6) as weight from c group by all"
)
def decayed_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.series_counts(_events(spark, sf_dir), range(2, 5), "native", decay=2.0).select("series_id", "length", "code", F.round("cnt", 6).alias("weight"))


LOOKUP = ("0,1", "0,0,1", "0,1,1,1", "0,0,0,0,0", "0,1,0,1")


@query(Q.counts("events", UP_TO_5) + f" select sid as series_id, {Q.TEXT} as code, c::double as cnt from k where {Q.TEXT} in ({', '.join(repr(x) for x in LOOKUP)})")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of given patterns only; the lengths come from the dictionary."""
    wanted = spark.createDataFrame([(x,) for x in LOOKUP], "code string")
    lengths = {x.count(",") + 1 for x in LOOKUP}
    return counts.series_counts(_events(spark, sf_dir), lengths, wanted=wanted).select("series_id", "code", "cnt")


@query(Q.counts("events", [3, 4, 5], "native") + f" select sid as series_id, m::int as length, {Q.TEXT} as code, c::double as support from k where c >= 4")
def single_series_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series mined by itself: patterns of lengths 3 to 5 with support 4 in it, ties allowed."""
    each = counts.series_counts(_events(spark, sf_dir), range(3, 6), "native")
    return each.where("cnt >= 4").select("series_id", "length", "code", F.col("cnt").alias("support"))


# --- mining and selection ---------------------------------------------------------------------------------------------


@query(Q.best("events", ALL_TO_31, 30) + Q.DICTIONARY)
def topk_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(mining.mine(_events(spark, sf_dir), 30))


@query(Q.best("events", [3, 6, 8], 30) + Q.DICTIONARY)
def topk_native_lengths_3_6_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(mining.mine(_events(spark, sf_dir), 30, lengths=[3, 6, 8]))


@query(Q.best("events", list(range(2, 12)), 30) + Q.DICTIONARY)
def topk_levelwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(mining.mine_levelwise(src.view_rows(spark, sf_dir, "events"), 30))


@query(Q.best("suppliers", [2, 3, 4, 5, 6, 7], 50) + Q.DICTIONARY)
def topk_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(mining.mine(src.view(spark, sf_dir, "suppliers", 64), 50))


@query(Q.best("orders", ALL_TO_31, 30) + Q.DICTIONARY)
def topk_ragged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(mining.mine(src.view(spark, sf_dir, "orders"), 30))


def _threshold(minsup: int) -> None:
    @query(Q.best("events", list(range(2, 21)), 0, minsup) + Q.DICTIONARY, f"threshold_minsup_{minsup}")
    def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _dictionary(mining.mine(src.view(spark, sf_dir, "events", 4096), 0, float(minsup)))


for _minsup in (5, 10, 25):
    _threshold(_minsup)

_CHOSEN = f" select {Q.TEXT} as code, m::int as length, support from "


def _chosen(df: DataFrame) -> DataFrame:
    return df.select("code", "length", "support")


@query(Q.support("events", UP_TO_5) + _CHOSEN + f"(select * from d where support >= 50 {Q.BEST} limit 20)")
def topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(select.choose(_event_support(spark, sf_dir), "global", 20, 50))


_PLACED = "(select *, row_number() over (partition by {by} order by support desc, m, code) as place from d where support >= 50)"


@query(Q.support("events", UP_TO_5) + _CHOSEN + _PLACED.format(by="m") + " where place <= 3")
def topk_per_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(select.choose(_event_support(spark, sf_dir), "per_length", 3, 50))


@query(Q.support("events", UP_TO_5) + _CHOSEN + _PLACED.format(by="m <= 3") + " where place <= case when m <= 3 then 4 else 6 end")
def topk_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(select.choose(_event_support(spark, sf_dir), "grouped", 10, 50, {2: 0, 3: 0, 4: 1, 5: 1}, {0: 4, 1: 6}))


@query(Q.support("events", UP_TO_5) + _CHOSEN + "d where support >= 50")
def all_observed_minsup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(select.choose(_event_support(spark, sf_dir), "all_observed", minsup=50))


def _prefix_sql(percents: tuple[int, ...]) -> str:
    each = [f"select * from ({Q.counts('embeddings', UP_TO_5, percent=p)} select {p}::int as percent, m::int as length, count(distinct code)::bigint as patterns, sum(c)::bigint as windows from k group by m)" for p in percents]
    return " union all ".join(each)


@query(_prefix_sql((20, 40, 60, 80, 100)))
def prefix_scaling_20_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns and windows of the first 20 to 100 percent of each series."""
    base, out = src.view(spark, sf_dir, "embeddings"), None
    for p in (20, 40, 60, 80, 100):
        support = counts.corpus_support(counts.series_counts(src.prefixes(base, p), SHORT))
        one = support.groupBy("length").agg(F.count("*").alias("patterns"), F.sum("support").cast("long").alias("windows"))
        one = one.select(F.lit(p).alias("percent"), "length", "patterns", "windows")
        out = one if out is None else out.unionByName(one)
    return out


# --- features and reports ---------------------------------------------------------------------------------------------


def _cells(spark: SparkSession, sf_dir: str, budget: int = 12) -> tuple[DataFrame, DataFrame]:
    series = src.view(spark, sf_dir, "embeddings")
    mined = mining.mine(series, budget, lengths=EMB)
    names = _dictionary(mined)
    return features.matrix(series, names, mined.counts), names


#: The first budget lengths of EMB are all that can matter, and there are fewer lengths than the budget.
_CELLS = Q.cells("embeddings", EMB, 12)


@query(_CELLS + " select sid as series_id, rank::int as rank, cnt from f")
def feature_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)[0].select("series_id", "rank", "cnt")


@query(_CELLS + " select sid as series_id, rank::int as rank, round(case when stddev_pop(cnt) over (partition by rank) > 0 then (cnt - avg(cnt) over (partition by rank)) / stddev_pop(cnt) over (partition by rank) else 0 end, 6) + 0.0 as z from f")
def feature_matrix_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.scaled(_cells(spark, sf_dir)[0]).select("series_id", "rank", (F.round("z", 6) + 0.0).alias("z"))


@query(
    _CELLS
    + f""", u as (select rank, string_agg(cnt::varchar, ',' order by sid) as col, min(cnt) as lo, max(cnt) as hi from f group by rank), z as (select sid, max(cnt) as top from f group by sid)
    select (select count(*) from t)::bigint as patterns,
      (select count(*) from t where list_sum(code) = 0 or {Q.TEXT} = '0' || repeat(',1', m - 1))::bigint as monotone_patterns, (select sum(m) from t)::bigint as code_units,
      (select count(distinct col) from u)::bigint as unique_columns, (select count(*) from u where lo = hi)::bigint as constant_columns, round((select avg((top = 0)::int) from z), 9) as zero_row_fraction"""
)
def feature_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.diagnostics(*_cells(spark, sf_dir)).withColumn("zero_row_fraction", F.round("zero_row_fraction", 9))


@query(Q.support("events", UP_TO_5) + f" select {Q.TEXT} as code, (list_sum(code) = 0 or {Q.TEXT} = '0' || repeat(',1', m - 1)) as monotone from d")
def monotone_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_support(spark, sf_dir).select("code", codes.is_monotone(codes.code_array(F.col("code"))).alias("monotone"))


@query(Q.support("events", UP_TO_5) + f" select {Q.TEXT} as code, 'ct_' || substr(sha256('[' || array_to_string(code, ', ') || ']'), 1, 20) as pattern_id from d")
def pattern_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_support(spark, sf_dir).select("code", codes.pattern_id(F.col("code")).alias("pattern_id"))


@query(
    _CELLS
    + """, o as (select rank, avg(cnt) as overall from f group by rank)
    select f.rank::int as rank, label, count(*)::bigint as n, sum(cnt) as support, count(*) filter (where cnt > 0)::bigint as present, round(avg(cnt), 6) as mean, round(stddev_pop(cnt), 6) as std,
      median(cnt) as median, round(count(*) filter (where cnt > 0) / count(*), 6) as presence, round(avg(cnt) / any_value(overall), 6) as ratio
    from f join o using (rank) group by f.rank, label"""
)
def class_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = features.class_stats(_cells(spark, sf_dir)[0])
    r = lambda n: F.round(n, 6).alias(n)
    return c.select("rank", "label", "n", "support", "present", r("mean"), r("std"), "median", r("presence"), r("ratio"))


@query(_CELLS + Q.ETA + " select rank::int as rank, support, present::bigint as present, round(mean, 6) as mean, round(std, 6) as std, tv = 0 as constant, round(eta_squared, 6) as eta_squared, strongest::int as strongest from eta")
def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = features.contrast(_cells(spark, sf_dir)[0])
    return c.select("rank", "support", "present", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "constant", F.round("eta_squared", 6).alias("eta_squared"), F.col("strongest").cast("int").alias("strongest"))


@query(_CELLS + Q.ETA + " select rank::int as rank, contrast_rank::int as contrast_rank from er")
def contrast_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.contrast_rank(features.contrast(_cells(spark, sf_dir)[0])).select("rank", F.col("contrast_rank").cast("int").alias("contrast_rank"))


@query(_CELLS + Q.ETA + " select rank::int as rank, concat_ws('+', case when rank <= 4 then 'frequency' end, case when contrast_rank <= 4 then 'posthoc_label_contrast' end) as reason from er where rank <= 4 or contrast_rank <= 4")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.representatives(features.contrast(_cells(spark, sf_dir)[0]), 4, 4).select("rank", "reason")


_LADDER = (5, 10, 20)


def _ladder(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    """Dictionaries of several budgets from one count."""
    able = counts.eligible(_event_support(spark, sf_dir))
    return {b: select.ranked(select.best(able, b)).select("rank", "code") for b in _LADDER}


_RANKED = Q.support("events", UP_TO_5) + f", t as (select row_number() over ({Q.BEST}) as rank, {Q.TEXT} as code from d where qualifying > 0)"


@query(_RANKED + " select code, case when rank <= 10 then rank end::int as old_rank, case when rank <= 20 then rank end::int as new_rank, case when rank <= 10 then 'kept' else 'added' end as change from t where rank <= 20")
def budget_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ladder(spark, sf_dir)
    return features.changes(d[10], d[20])


@query(_RANKED + ", b as (select unnest([5, 10, 20]) as budget) select code, min(budget)::int as first_budget, array_to_string(list(budget order by budget), ',') as budgets from t join b on rank <= budget group by code")
def pattern_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for budget, d in _ladder(spark, sf_dir).items():
        one = d.select("code", F.lit(budget).alias("budget"))
        out = one if out is None else out.unionByName(one)
    return features.catalogue(out)


@query(_RANKED + ", a as (select rank, code from t where rank <= 10) select code, rank::int as small_rank, rank::int as large_rank, true as same from a")
def budget_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smaller dictionary and the first places of a larger one, each mined by itself: the same patterns at the same places."""
    small, large = (_dictionary(mining.mine(_events(spark, sf_dir), b, lengths=SHORT)).select("rank", "code") for b in (10, 20))
    both = small.withColumnRenamed("rank", "small_rank").join(large.where("rank <= 10").withColumnRenamed("rank", "large_rank"), "code", "full")
    return both.withColumn("same", F.col("small_rank").eqNullSafe(F.col("large_rank")))


_EXAMPLES = Q.best("events", [3, 4], 8) + """, h as (select t.rank, c.sid, count(*) as cnt, min(c.st) as st, any_value(c.m) as m from c join t on t.code = c.code group by t.rank, c.sid)
, p as (select *, row_number() over (partition by rank order by cnt desc, sid) as place from h)"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _events(spark, sf_dir)
    names = _dictionary(mining.mine(series, 8, lengths=[3, 4]))
    return features.examples(series, counts.occurrences(series, counts.codes_of(names)), names, 3)


@query(_EXAMPLES + " select rank::int as rank, place::int as place, sid as series_id, cnt::bigint as cnt, st::int as st from p where place <= 3")
def occurrence_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select("rank", "place", "series_id", "cnt", "st")


@query(
    _EXAMPLES
    + """, v as (select p.rank, p.place, s.pos, rank() over (partition by p.rank, p.place order by s.v) as r from p join s on s.sid = p.sid and s.pos between p.st and p.st + p.m - 1 where place <= 3)
    select rank::int as rank, place::int as place, array_to_string(list(r order by pos), ',') as ranks from v group by all"""
)
def ordinal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select("rank", "place", F.array_join(codes.ordinal_ranks(F.col("win")).cast("array<string>"), ",").alias("ranks"))


@query(
    Q.series("events")
    + Q.PD
    + Q.windows([3])
    + f""", g as (select sid, {Q.TEXT} as code, st - lag(st) over (partition by sid, code order by st) as gap from c)
    , q as (select sid, code, count(*) as k, sum(gap) as a, sum(gap * gap) as b from g where gap is not null group by all)
    select sid as series_id, code, k::bigint as gaps, a::bigint as gap_sum, b::bigint as gap_squares, round(sqrt(greatest(0, b / k - (a / k) ** 2)) / (a / k), 6) as cv from q"""
)
def occurrence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.gaps(_events(spark, sf_dir), 3).withColumn("cv", F.round("cv", 6))


# --- evaluation -------------------------------------------------------------------------------------------------------

_METRICS = """with d as (select label as i, (embedding[1] > 0)::int + 2 * (embedding[2] > 0)::int as j from embeddings)
, n as (select i, j, count(*)::double as n from d group by all), a as (select i, sum(n) as a from n group by i), b as (select j, sum(n) as b from n group by j), t as (select sum(n) as t from n)
, x as (select (select sum(n / t * ln(t * n / (a * b))) from n join a using (i) join b using (j), t) as mi, (select -sum(a / t * ln(a / t)) from a, t) as hc, (select -sum(b / t * ln(b / t)) from b, t) as hk,
  (select sum(n * (n - 1) / 2) from n) as same, (select sum(a * (a - 1) / 2) from a) as pa, (select sum(b * (b - 1) / 2) from b) as pb, (select t * (t - 1) / 2 from t) as every)
select round(mi / sqrt(hc * hk), 6) as nmi, round(mi / hc, 6) as homogeneity, round((same - pa * pb / every) / ((pa + pb) / 2 - pa * pb / every), 6) as ari from x"""


@query(_METRICS)
def cluster_metrics_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a clustering by the signs of two values."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    sign = lambda i: (F.element_at("embedding", i) > 0).cast("int")
    m = metrics.cluster_metrics(table.select("label", (sign(1) + 2 * sign(2)).alias("cluster")))
    return m.select(*(F.round(c, 6).alias(c) for c in ("nmi", "homogeneity", "ari")))


_RESULTS = [("A", d, r, not (d == "Car" and r == 2), 0.1 * r + 0.01 * len(d)) for d in ("Beef", "Car", "Pig") for r in range(3)] + [("B", d, r, True, None if (d, r) == ("Beef", 1) else 0.2 * r) for d in ("Beef", "Car") for r in range(3)]
_RUNS = [("x", 64, m, r, e, s * m, h) for m in (8, 16, 32) for r in range(2) for e, s, h in (("by growth", 0.1, f"o{m if m < 32 else r}"), ("by hash", 0.4, f"o{m if m < 32 else r}")) if not (m == 16 and r == 1 and e == "by hash")]


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else repr(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


@query(
    f"""with r(study, dataset, rep, ok, nmi) as (values {_values(_RESULTS)})
    , p as (select study, dataset, count(*) as k, count(distinct rep) as r, count(nmi) as v, avg(nmi) as m from r where ok group by all)
    select study, count(*)::bigint as datasets, case when min(v) = 3 then round(avg(m), 6) end as mean from p where k = 3 and r = 3 group by study"""
)
def macro_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(_RESULTS, "study string, dataset string, repeat int, valid boolean, nmi double")
    return metrics.macro_means(df, ["study"], "nmi", 3).withColumn("mean", F.round("mean", 6))


@query(
    f"""with r(source, n, length, rep, engine, seconds, output) as (values {_values(_RUNS)})
    , p as (select a.source, a.n, a.length, a.rep, a.seconds as f, b.seconds as s, a.output as o, a.output = b.output as ok from r a left join r b on (a.source, a.n, a.length, a.rep) = (b.source, b.n, b.length, b.rep) and b.engine = 'by hash' where a.engine = 'by growth')
    , t as (select source, n, length, count(*) filter (where ok) as matched, count(distinct o) filter (where ok) as outs, avg(f) filter (where ok) as f, avg(s) filter (where ok) as s from p group by all)
    select source, n::int as n, length::int as length, matched::bigint as matched, case when outs > 1 then 'unstable' when matched = 2 then 'complete' else 'incomplete' end as status,
      case when outs <= 1 and matched = 2 then round(f, 6) end as fast_mean, case when outs <= 1 and matched = 2 then round(s, 6) end as slow_mean, case when outs <= 1 and matched = 2 then round(s / f, 6) end as speedup from t"""
)
def speedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(_RUNS, "source string, n int, length int, repeat int, engine string, seconds double, output string")
    m = metrics.speedups(df, 2, "by hash", "by growth")
    return m.select("source", "n", "length", "matched", "status", *(F.round(c, 6).alias(c) for c in ("fast_mean", "slow_mean", "speedup")))


@query(
    """select count(*)::bigint as n, count(distinct label)::bigint as classes, min(len(embedding))::int as shortest, max(len(embedding))::int as longest,
    case when min(len(embedding)) = max(len(embedding)) and min(len(embedding)) >= 2 and count(distinct label) > 1 and count(distinct label) < count(*) then 'ready' else 'excluded' end as status, '' as reason from embeddings"""
)
def dataset_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dataset_checks(src.view(spark, sf_dir, "embeddings"))


@query("select d.label::int as label, count(*)::bigint as n, sum(len(embedding))::bigint as points from embeddings d group by label")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.view(spark, sf_dir, "embeddings")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.sum("n").alias("points"))


@query(
    """with s as (select f.f as family, i.i as series_id, p.p as pos from (values ('monotone'), ('periodic')) f(f), range(3) i(i), range(100) p(p))
    , h as (select q.q as slot, row_number() over (order by (q.q * 7) % 1009, q.q) - 1 as ord from range(32) q(q)), shape as (select ord as place, slot as v from h)
    select family, series_id, pos::int as pos, case when family = 'monotone' then pos::double else ((select v from shape where place = pos % 32) * 4 + pos // 32)::double end as value from s"""
)
def synthetic_monotone_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for family in ("monotone", "periodic"):
        one = src.synthetic(spark, family, 3, 100).select(F.lit(family).alias("family"), "series_id", F.posexplode("x").alias("pos", "value"))
        out = one if out is None else out.unionByName(one)
    return out


# --- what SQL can't say -----------------------------------------------------------------------------------------------


@query(
    Q.support("events", UP_TO_5)
    + f""", e as (select {Q.TEXT} as code, m, unnest(code)::int as d, generate_subscripts(code, 1)::int - 1 as i from d), l as (select code, m, i, case when d > 0 then i - d else -1 end as b from e)
    , r as (select a.code, a.m, a.i, a.b, coalesce(min(z.i), any_value(a.m)) as z, arg_min(z.b, z.i) as zb from l a left join l z on z.code = a.code and z.i > a.i and z.b < a.i group by all)
    , p as (select code, i, b, z, case when z < m and zb = b then z else b end as parent from r)
    select code, max(i) filter (where parent = -1)::int as root, array_to_string(list(parent order by i), ',') as parents,
      array_to_string(list((select count(*) - 1 from p k where k.code = p.code and k.b < p.i and p.i < k.z) order by i), ',') as depth from p group by code"""
)
def ct_tree_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, parents and depths of all patterns' trees."""
    trees = _event_support(spark, sf_dir).select("code", kernels.tree_of(codes.code_array(F.col("code"))).alias("t"))
    text = lambda c: F.array_join(F.col(f"t.{c}").cast("array<string>"), ",").alias(c)
    return trees.select("code", "t.root", text("parents"), text("depth"))


@query("select sid as series_id, pos::int as pos, printf('%.9g', v)::double as value from (" + Q.SERIES["suppliers"] + ")")
def quantize_9g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.quantized(src.view(spark, sf_dir, "suppliers", 1)).select("series_id", F.posexplode("x").alias("pos", "value"))


@query(
    _CELLS
    + """, z as (select sid, label, case when stddev_pop(cnt) over (partition by rank) > 0 then (cnt - avg(cnt) over (partition by rank)) / stddev_pop(cnt) over (partition by rank) else 0 end as z from f)
    select sid as series_id, label::int as label, count(*)::bigint as dims, round(sum(z * z), 5) as norm from z group by sid, label"""
)
def pca_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All principal components of the scaled features: a rotation, which keeps every series' norm."""
    cells, names = _cells(spark, sf_dir)
    p = cluster.components(cells, names.count())
    return p.select("series_id", "label", F.size("features").cast("long").alias("dims"), F.round(F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v), 5).alias("norm"))


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = features.scaled(_cells(spark, sf_dir)[0]).drop("cnt").withColumnRenamed("z", "cnt")
    return cluster.kmeans(features.vectors(z), 10).select("series_id", "label", "cluster")


@query()
def raw_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.kmeans(cluster.raw_vectors(src.view(spark, sf_dir, "embeddings")), 10).select("series_id", "label", "cluster")


from . import studies  # noqa: E402, F401  the rest of the catalogue
