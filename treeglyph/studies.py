"""More of the catalogue: features of the best thirty, long lengths, budgets against each other, jobs and their results, sources and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sql as Q
from .functions import codes
from .operators import counts, features, metrics, select
from .plans import mining, presets
from .queries import SHORT, UP_TO_5, _dictionary, _event_support, _events, query
from .sources import series as src

# --- mining -----------------------------------------------------------------------------------------------------------

#: Support can't grow with length: where no pattern of the last of these lengths qualifies, or can enter the best, none that is longer does.
UP_TO_10, UP_TO_14 = list(range(2, 11)), list(range(2, 15))


@query(Q.cells("embeddings", UP_TO_10, 30) + " select sid as series_id, rank::int as rank, cnt from f")
def features_k30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mining with a budget of 30 among all lengths, and the whole matrix."""
    series = src.view(spark, sf_dir, "embeddings")
    return mining.mine(series, 30).features(series).select("series_id", "rank", "cnt")


@query(Q.best("suppliers", UP_TO_14, 0, 3) + Q.DICTIONARY)
def lengths_to_256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns of lengths to 256 that a series has three times."""
    return _dictionary(mining.mine(src.view(spark, sf_dir, "suppliers", 256), 0, 3.0, lengths=range(2, 257)))


_PERIODIC = """with h as (select q.q as slot, row_number() over (order by (q.q * 7) % 1009, q.q) - 1 as ord from range(32) q(q))
, s as (select i.i as sid, p.p as pos, ((select slot from h where ord = p.p % 32) * 10 + p.p // 32)::double as v, 300 as n from range(2) i(i), range(300) p(p))"""


@query(_PERIODIC + Q.PD + Q.windows([2, 8, 64, 200, 256]) + f", k as (select code, m, sid, count(*) as c from c group by all) select m::int as length, count(distinct code)::bigint as patterns, sum(c)::bigint as windows from k where c >= 2 group by m")
def long_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths to 256 of series in which long patterns do come again."""
    series = src.synthetic(spark, "periodic", 2, 300)
    found = mining.mine(series, 0, 2.0, lengths=[2, 8, 64, 200, 256]).dictionary
    return found.groupBy("length").agg(F.count("*").alias("patterns"), F.sum("support").cast("long").alias("windows"))


@query(Q.support("events", UP_TO_5) + f" select row_number() over (order by support desc, code)::int as place, {Q.TEXT} as code, support from d where m = 4 order by support desc, code limit 7")
def best_of_one_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = counts.best_of_length(_event_support(spark, sf_dir), 4, 7)
    return select.ranked(best).select(F.col("rank").cast("int").alias("place"), "code", "support")


@query(
    Q.counts("events", [2, 3, 4, 5, 6], "native")
    + f""", f as (select sid, code, m, c from k where c >= 4), b as (select a.sid, a.code, a.m, a.c, (select count(*) from f z where z.sid = a.sid and z.c = a.c and z.m = a.m + 1 and z.code[1:a.m] = a.code) as further from f a)
    select sid as series_id, {Q.TEXT} as code, c::double as support, m::int as hi, (select min(z.m) from f z where z.sid = b.sid and z.c = b.c and b.code[1:z.m] = z.code)::int as lo from b where further = 0"""
)
def series_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series mined by itself: frequent patterns as intervals of lengths with the same support."""
    each = counts.series_counts(_events(spark, sf_dir), range(2, 7), "native").withColumnRenamed("cnt", "support")
    return counts.intervals(each, 4.0).select("series_id", "code", "support", "hi", "lo")


@query(Q.series("events") + Q.PD + Q.windows([2, 3, 4], "native") + f" select sid as series_id, m::int as length, {Q.TEXT} as code, round(sum(exp(-2.0 * (n - st - m) / n)), 6) as weight from c group by all")
def decayed_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.decayed_by_mass(_events(spark, sf_dir), range(2, 5), 2.0).select("series_id", "length", "code", F.round("cnt", 6).alias("weight"))


@query(
    Q.series("events")
    + Q.PD
    + Q.windows([2, 3, 4])
    + f""", g as (select sid, code, least(3, st * 4 // (n - m + 1)) as bin, count(*) as k from c group by all), a as (select sid, code from g group by all)
    select a.sid as series_id, {Q.TEXT.replace('code', 'a.code')} as code, string_agg(coalesce(g.k, 0)::bigint::varchar, ',' order by b.bin) as bins
    from a cross join range(4) b(bin) left join g on g.sid = a.sid and g.code = a.code and g.bin = b.bin group by a.sid, a.code"""
)
def bin_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all position bins of a series and code, in one row."""
    v = counts.bin_vectors(counts.series_counts(_events(spark, sf_dir), range(2, 5), bins=4), 4)
    return v.select("series_id", "code", F.array_join(F.col("values").cast("array<long>").cast("array<string>"), ",").alias("bins"))


@query(
    Q.series("events") + Q.PD + Q.windows([4, 5])
    + f" select a.sid as series_id, a.m::int as length, {Q.TEXT.replace('code', 'a.code')} as code, count(*)::bigint as pairs, sum(b.st - a.st)::bigint as distance from c a join c b on a.sid = b.sid and a.m = b.m and a.code = b.code and a.st < b.st group by a.sid, a.m, a.code"
)
def pair_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a series held against each other, pair by pair."""
    pairs = counts.pair_links(counts.windows_of(_events(spark, sf_dir), [4, 5]), within=True)
    return pairs.groupBy(F.col("a.series_id").alias("series_id"), "length", "code").agg(F.count("*").alias("pairs"), F.sum(F.col("a.st") - F.col("b.st")).cast("long").alias("distance"))


@query(Q.support("events", UP_TO_5) + f" select row_number() over (order by qualifying desc, support desc, m, code)::int as place, {Q.TEXT} as code, qualifying from d order by qualifying desc, support desc, m, code limit 9")
def topk_by_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = select.by_coverage(_event_support(spark, sf_dir), 9)
    place = F.row_number().over(Window.orderBy(F.desc("qualifying"), *select.order()))
    return best.select(place.alias("place"), "code", "qualifying")


@query(
    Q.series("events") + Q.PD + Q.windows([4], "native")
    + f", g as (select sid, {Q.TEXT} as code, count(*) as cnt, min(st) as st from c group by all), p as (select *, row_number() over (partition by sid order by cnt desc, st) as place from g) select sid as series_id, place::int as place, code, cnt::bigint as cnt, st::int as st from p where place <= 3"
)
def series_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent patterns of one length in each series; earlier ones first."""
    return counts.best_of_series(counts.windows_of(_events(spark, sf_dir), [4], "native"), 3)


@query(Q.best("embeddings", UP_TO_10, 20, 1) + Q.DICTIONARY)
def topk_any_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty of all that occurs."""
    return _dictionary(mining.mine(src.view(spark, sf_dir, "embeddings"), 20, 1.0))


# --- budgets against each other ---------------------------------------------------------------------------------------

_BUDGETS = (5, 10, 20)
_RANKED = Q.support("events", UP_TO_5) + f", t as (select row_number() over ({Q.BEST}) as rank, * from d where qualifying > 0)"


def _of_budgets(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    return {b: _dictionary(mining.mine(_events(spark, sf_dir), b, lengths=SHORT)) for b in _BUDGETS}


@query(
    _RANKED
    + """, b(f, t) as (values (5, 10), (10, 20)) select f::int as from_budget, b.t::int as to_budget, (b.t - f)::bigint as added, 0::bigint as removed, count(*)::bigint as shared,
    true as smaller_is_subset, true as exact_prefix from b join t on rank <= f group by f, b.t"""
)
def budget_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for b, d in _of_budgets(spark, sf_dir).items():
        one = d.select(F.lit(b).alias("budget"), "rank", "code")
        rows = one if rows is None else rows.unionByName(one)
    return features.budget_steps(rows, list(_BUDGETS))


@query(_RANKED + f" select {Q.TEXT.replace('code', 't.code')} as code, (select count(distinct sid) from s)::bigint as series, 0::bigint as differing, t.support from t where rank <= 10")
def budget_shared_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of patterns that two budgets share, mined and counted for each by itself."""
    series = _events(spark, sf_dir)
    cells = []
    for b in (10, 20):
        found = mining.mine(series, b, lengths=SHORT)
        cells.append(found.features(series).join(found.dictionary.select("rank", "code"), "rank"))
    return features.shared_columns(*cells)


@query(_RANKED + f" select {Q.TEXT} as code from t where rank <= 20 intersect select {Q.TEXT} as code from d where m = 3")
def dictionary_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_three = counts.series_counts(_events(spark, sf_dir), [3]).select("code").distinct()
    return _of_budgets(spark, sf_dir)[20].select("code").intersect(of_three)


@query(_RANKED + f", ww as (select {Q.TEXT} as code from t where rank <= 6), ee as (select sid, {Q.TEXT} as code, c from k) select ee.sid as series_id, code, c::double as cnt from ee join ww using (code)")
def wanted_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the patterns of a saved dictionary only; the lengths are those that it has."""
    wanted = _of_budgets(spark, sf_dir)[10].where("rank <= 6").select("code")
    return counts.series_counts(_events(spark, sf_dir), range(2, 32), wanted=wanted).select("series_id", "code", "cnt")


@query(
    """with k as (select unnest([5, 12, 40])::int as needed), t(dim) as (values (0), (12), (30))
    select needed, dim::int as dim, case when dim = 0 then 'no_features' when dim < needed then 'insufficient_features' else 'ok' end as status from k cross join t"""
)
def feature_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clustering asks of a dictionary, by its size and by what is needed: of an empty one, of twelve patterns and of thirty."""
    from .operators.cluster import feature_status_of

    mined = mining.mine(src.view(spark, sf_dir, "embeddings"), 30)
    sizes = None
    for k in (0, 12, 30):
        one = mined.dictionary.where(F.col("rank") <= k).agg(F.count("*").cast("int").alias("dim"))
        sizes = one if sizes is None else sizes.unionByName(one)
    needed = F.explode(F.array(F.lit(5), F.lit(12), F.lit(40)))
    return sizes.withColumn("needed", needed).select("needed", "dim", feature_status_of(F.col("dim"), F.col("needed")).alias("status"))


# --- jobs and results -------------------------------------------------------------------------------------------------

_RESULT_ROWS = "select event_type as study, 'd' || (user_id % 5) as dataset, (event_id % 3)::int as repeat, min(event_id) as job, count(*) as n, avg(value) as score from events group by all"


def _result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    keys = F.col("event_type").alias("study"), F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("dataset"), (F.col("event_id") % 3).cast("int").alias("repeat")
    return e.groupBy(*keys).agg(F.min("event_id").alias("job"), F.count("*").alias("n"), F.avg("value").alias("score"))


@query(
    f"""with r as ({_RESULT_ROWS}), p as (select study, dataset, count(*) as k, count(distinct repeat) as r, count(score) as v, avg(score) as m from r where n % 7 <> 0 group by all)
    select study, count(*)::bigint as datasets, case when min(v) = 3 then round(avg(m), 6) end as mean from p where k = 3 and r = 3 group by study"""
)
def macro_means_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over datasets of means over repeats, of results that come from a table."""
    rows = _result_rows(spark, sf_dir).withColumn("valid", F.col("n") % 7 != 0)
    return metrics.macro_means(rows, ["study"], "score", 3).withColumn("mean", F.round("mean", 6))


@query(
    """with r as (select o_orderpriority as source, (o_custkey % 4)::int as n, year(o_orderdate)::int as length, (o_orderkey % 2)::int as repeat, o_orderstatus as engine, avg(o_totalprice) as seconds, 'x' || (count(*) % 2) as output from orders group by all)
    , p as (select a.source, a.n, a.length, a.repeat, a.seconds as f, b.seconds as s, a.output as o, a.output = b.output as ok from r a left join r b on (a.source, a.n, a.length, a.repeat) = (b.source, b.n, b.length, b.repeat) and b.engine = 'O' where a.engine = 'F')
    , x as (select distinct source, n, length from r where engine in ('F', 'O')), t as (select source, n, length, count(*) filter (where ok) as matched, count(distinct o) filter (where ok) as outs, avg(f) filter (where ok) as f, avg(s) filter (where ok) as s from p group by all)
    select x.source, x.n, x.length, coalesce(matched, 0)::bigint as matched, case when outs > 1 then 'unstable' when matched = 2 then 'complete' else 'incomplete' end as status, case when outs <= 1 and matched = 2 then round(s / f, 6) end as speedup from x left join t on (x.source, x.n, x.length) = (t.source, t.n, t.length)"""
)
def speedups_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of matched runs, of runs that come from a table."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus in ('F', 'O')")
    keys = F.col("o_orderpriority").alias("source"), (F.col("o_custkey") % 4).cast("int").alias("n"), F.year("o_orderdate").alias("length"), (F.col("o_orderkey") % 2).cast("int").alias("repeat"), F.col("o_orderstatus").alias("engine")
    runs = o.groupBy(*keys).agg(F.avg("o_totalprice").alias("seconds"), F.concat(F.lit("x"), (F.count("*") % 2).cast("string")).alias("output"))
    return metrics.speedups(runs, 2, "O", "F").select("source", "n", "length", "matched", "status", F.round("speedup", 6).alias("speedup"))


_JOBS = f"""with r as ({_RESULT_ROWS}), j as (select study, dataset, repeat, case when repeat = 2 and dataset = 'd1' then 'failed' else 'complete' end as status, 30 as budget from r)
, q as (select study, dataset, repeat, case when n % 5 = 0 then 'timeout' else 'ok' end as status, case when n % 11 = 0 then 12 else 30 end as dim, case when n % 6 = 0 then null else score end as score from r where not (study = 'view' and dataset = 'd2'))
, v as (select j.*, coalesce(j.status = 'complete' and q.status = 'ok' and q.score is not null and q.dim = j.budget, false) as valid, q.score from j left join q using (study, dataset, repeat))"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _result_rows(spark, sf_dir)
    jobs = rows.select("study", "dataset", "repeat", F.when((F.col("repeat") == 2) & (F.col("dataset") == "d1"), "failed").otherwise("complete").alias("status"), F.lit(30).alias("budget"))
    n = F.col("n")
    results = rows.where("not (study = 'view' and dataset = 'd2')").select(
        "study", "dataset", "repeat", F.when(n % 5 == 0, "timeout").otherwise("ok").alias("status"), F.when(n % 11 == 0, 12).otherwise(30).alias("dim"), F.when(n % 6 != 0, F.col("score")).alias("score")
    )
    return metrics.valid_jobs(jobs, results, ["study", "dataset", "repeat"], ["score"], "budget", "dim")


@query(_JOBS + " select study, dataset, repeat, status, budget::int as budget, valid, case when valid then round(score, 6) end as score from v")
def jobs_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs, each with its result where that may be used."""
    return _jobs(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(
    _JOBS
    + """ select grouping_id(study, repeat)::int as slice, study, repeat, count(*)::bigint as rows, count(distinct dataset)::bigint as datasets, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std
    from v where valid group by cube (study, repeat)"""
)
def slice_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.slices(_jobs(spark, sf_dir), ["study", "repeat"], "score")
    return found.select("slice", "study", "repeat", "rows", "datasets", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_PRINT = "sha256(concat_ws(chr(31), '=' || {n}, '=' || {job}))"


@query(
    f"""with r as ({_RESULT_ROWS}), t as (select study, dataset, repeat, {_PRINT.format(n='n', job='job')} as fingerprint from r), s as (
      select study, dataset, repeat, case when repeat = 1 then 'old' else {_PRINT.format(n='n', job='job')} end as fingerprint, job as result from r where dataset <> 'd3'
      union all select study, dataset, repeat, 'twice', 0 from r where dataset = 'd4' and repeat = 0)
    , g as (select study, dataset, repeat, count(*) as n, min(fingerprint) as saved, min(result) as result from s group by all)
    , p as (select t.*, case when g.n is null then 'run' when g.n > 1 then 'ambiguous' when g.saved = t.fingerprint then 'reuse' else 'changed' end as plan, g.result from t left join g using (study, dataset, repeat))
    select study, dataset, repeat, fingerprint, plan, case when plan = 'reuse' then result end::bigint as result from p"""
)
def reuse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs' results are there already, by all that names a job and the fingerprint of its input and settings."""
    rows = _result_rows(spark, sf_dir)
    keys = ["study", "dataset", "repeat"]
    targets = rows.select(*keys, metrics.fingerprint("n", "job").alias("fingerprint"))
    saved = rows.where("dataset <> 'd3'").select(*keys, F.when(F.col("repeat") == 1, "old").otherwise(metrics.fingerprint("n", "job")).alias("fingerprint"), F.col("job").alias("result"))
    twice = rows.where("dataset = 'd4' and repeat = 0").select(*keys, F.lit("twice").alias("fingerprint"), F.lit(0).cast("long").alias("result"))
    return metrics.reusable(targets, saved.unionByName(twice), keys)


@query("with d as (select distinct event_type as dataset from events) select dataset, budget::int as budget, seed::int as seed, dataset || '/' || budget || '/' || seed as path from d, (values (5), (30)) b(budget), range(3) s(seed)")
def job_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each dataset and setting."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("dataset")).distinct()
    return metrics.grid(d, {"budget": [5, 30], "seed": [0, 1, 2]}).withColumn("path", F.concat_ws("/", "dataset", F.col("budget").cast("string"), F.col("seed").cast("string")))


@query(
    """with d as (select distinct event_type as dataset from events), b as (select unnest([10, 20, 30, 40, 50]) as budget)
    select dataset, budget::int as budget, 2.0::double as minsup, 100::int as percent, s.s::int as seed from d, b, range(5) s(s)"""
)
def study_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All settings of a named study."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("dataset")).distinct()
    return presets.conditions(d, "topk").withColumn("minsup", F.col("minsup").cast("double"))


# --- sources and samples ----------------------------------------------------------------------------------------------


@query(
    """with s as (select vec_id as source, len(embedding) as n from embeddings), e as (select source, n, p, (n * p // 100)::bigint as size from s, (values (5), (6), (10), (50), (100), (150)) x(p))
    select source, p::int as percent, size, case when row_number() over (partition by source, size order by p) > 1 then 'duplicate prefix size after rounding' when size > n then 'n exceeds the source length' when size < 8 then 'n < L' end as reason from e"""
)
def prefix_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix sizes of a study, and why some aren't run."""
    sources = src.view(spark, sf_dir, "embeddings").select(F.col("series_id").alias("source"), "n")
    return metrics.prefix_conditions(sources, 8, [5, 6, 10, 50, 100, 150])


@query(
    """with s as (select label % 3 as dataset, label, case when vec_id % 97 = 0 then 9 else len(embedding) end as n from embeddings)
    , a as (select dataset, count(*) as n, count(distinct label) as classes, min(n) as lo, max(n) as hi from s group by dataset)
    select dataset::int as dataset, n::bigint as n, classes::bigint as classes, lo::int as shortest, hi::int as longest, case when lo = hi then 'ready' else 'excluded' end as status, case when lo <> hi then 'unequal length' else '' end as reason from a"""
)
def datasets_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several data sets in one pass; a few series are cut short."""
    s = src.view(spark, sf_dir, "embeddings")
    short = F.when(F.col("series_id") % 97 == 0, F.slice("x", F.lit(1), F.lit(9))).otherwise(F.col("x"))
    return metrics.dataset_checks(s.withColumn("x", short).withColumn("dataset", (F.col("label") % 3).cast("int")), "dataset")


@query("select vec_id as series_id, label::int as label from embeddings order by md5(vec_id || ':7'), vec_id limit 20")
def seeded_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.subset(src.view(spark, sf_dir, "embeddings"), 20, 7).select("series_id", "label")


@query(
    """with r as (select vec_id, embedding, row_number() over (order by vec_id) - 1 as r, count(*) over () as n from embeddings), i as (select distinct i.i * (n - 1) // (least(24, n) - 1) as r from (select max(n) as n from r), range(24) i(i))
    select vec_id as series_id, generate_subscripts(embedding[1:48], 1)::int - 1 as pos, unnest(embedding[1:48])::double as value from r join i using (r)"""
)
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 series from the first to the last, 48 points each."""
    return src.excerpt(src.view(spark, sf_dir, "embeddings"), 24, 48).select("series_id", F.posexplode("x").alias("pos", "value"))


@query("select vec_id as series_id, generate_subscripts(embedding, 1)::int - 1 as pos, round(unnest(embedding)::double, 4) + 0.0 as value, (round(unnest(embedding)::double, 4) + 0.0)::float::double as single from embeddings")
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in text, of double and of single precision."""
    text = src.view(spark, sf_dir, "embeddings").select("series_id", F.array_join(F.transform("x", lambda v: (F.round(v, 4) + 0.0).cast("string")), " \n\t").alias("text"))
    both = text.select("series_id", F.arrays_zip(src.parse_numbers(F.col("text")).alias("value"), src.parse_numbers(F.col("text"), single=True).alias("single")).alias("z"))
    return both.select("series_id", F.posexplode("z").alias("pos", "z")).select("series_id", "pos", "z.value", "z.single")


@query("select case when vec_id % 3 = 0 then 'test' else 'train' end as part, vec_id // 3 as series_id, label::int as label, len(embedding)::bigint as n from embeddings where vec_id % 3 < 2")
def train_and_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts of a data set as one; ids come in both."""
    s = src.view(spark, sf_dir, "embeddings")
    own = lambda k: s.where(F.col("series_id") % 3 == k).withColumn("series_id", F.floor(F.col("series_id") / 3))
    return src.train_and_test(own(1), own(0)).select("part", "series_id", "label", "n")


@query("select vec_id as series_id, 'c' || label as label, generate_subscripts(embedding, 1)::int - 1 as pos, round(unnest(embedding)::double, 3) + 0.0 as value from embeddings")
def ts_archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled series from the lines of an archive, with its header and comments."""
    s = src.view(spark, sf_dir, "embeddings")
    values = F.array_join(F.transform("x", lambda v: F.round(v, 3).cast("string")), ",")
    data = s.select("series_id", F.concat(values, F.lit(":c"), F.col("label").cast("string")).alias("line"))
    head = [(None, x) for x in ("# a comment", "@problemName x", "@univariate true", "@equalLength true", "@classLabel true c0 c1", "@data", "")]
    lines = spark.createDataFrame(head, "series_id long, line string").unionByName(data)
    return src.parse_ts(lines).select("series_id", "label", F.posexplode("x").alias("pos", "value"))


@query(
    """with s as (select i.i as series_id, p.p as item, md5(p.p || ':' || i.i || ':' || 3) as h from range(4) i(i), range(50) p(p))
    select series_id, (row_number() over (partition by series_id order by h, item) - 1)::int as pos, item::double as value from s"""
)
def random_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutations by seed."""
    return src.synthetic(spark, "random", 4, 50, 3).select("series_id", F.posexplode("x").alias("pos", "value"))


@query(Q.best("embeddings", [2, 3, 4], 6) + f" select row_number() over (order by support desc, m, code)::int as rank, {Q.TEXT} as code, (m % 2 = 0) as even, (support / sum(support) over ()) > 0.1 as frequent from t")
def ranked_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary as a table that other questions can be asked of."""
    d = _dictionary(mining.mine(src.view(spark, sf_dir, "embeddings"), 6, lengths=[2, 3, 4]))
    share = F.col("support") / F.sum("support").over(Window.partitionBy())
    return d.select("rank", "code", (F.size(codes.code_array(F.col("code"))) % 2 == 0).alias("even"), (share > 0.1).alias("frequent"))
