"""The same questions in DuckDB SQL, put together from common table expressions that share nothing with the Spark plans."""

from __future__ import annotations

INF = 999_999_999

_ORDERED = "row_number() over (partition by {id} order by {order}) - 1 as pos, {value}::double as v, count(*) over (partition by {id}) as n from {table}"
SERIES = {
    "events": "select user_id as sid, " + _ORDERED.format(id="user_id", order="ts, event_id", value="value", table="events"),
    "orders": "select o_custkey as sid, " + _ORDERED.format(id="o_custkey", order="o_orderdate, o_orderkey", value="o_totalprice", table="orders"),
    "suppliers": "select l_suppkey as sid, " + _ORDERED.format(id="l_suppkey", order="l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice", value="l_extendedprice", table="lineitem"),
    "embeddings": "select vec_id as sid, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as v, len(embedding) as n from embeddings",
}


def series(view: str, percent: int | None = None) -> str:
    cut = "" if percent is None else f" where pos < greatest(2, n * {percent} // 100)"
    n = "n" if percent is None else f"greatest(2, n * {percent} // 100) as n"
    return f"with s as (select sid, pos, v, {n} from ({SERIES[view]}){cut})"


#: Parent distances, and how many values from each place on are distinct.
PD = f", pd as (select a.sid, a.pos, coalesce(a.pos - max(b.pos), {INF}) as pd from s a left join s b on a.sid = b.sid and b.pos < a.pos and b.v <= a.v group by a.sid, a.pos)"
LIM = """, nx as (select sid, pos, n, coalesce(lead(pos) over (partition by sid, v order by pos), n) as nx from s)
, lim as (select sid, pos, n, min(nx) over (partition by sid order by pos rows between current row and unbounded following) - pos as lim from nx)"""


def windows(lengths: list[int], ties: str = "strict") -> str:
    """w: the windows that count; c: their codes as lists."""
    ok = "l.lim >= m.m" if ties == "strict" else "l.pos + m.m <= l.n"
    each = ", ".join(f"({m})" for m in lengths)
    return f"""{LIM}, w as (select l.sid, l.pos as st, m.m, l.n from lim l, (values {each}) m(m) where {ok})
, c as (select w.sid, w.st, w.m, w.n, list(case when p.pd <= p.pos - w.st then p.pd else 0 end order by p.pos) as code
  from w join pd p on p.sid = w.sid and p.pos between w.st and w.st + w.m - 1 group by all)"""


def counts(view: str, lengths: list[int], ties: str = "strict", percent: int | None = None) -> str:
    """k: code, m, sid, c."""
    return series(view, percent) + PD + windows(lengths, ties) + ", k as (select code, m, sid, count(*) as c from c group by all)"


def support(view: str, lengths: list[int], minsup: float = 2.0, ties: str = "strict") -> str:
    """d: code, m, support, qualifying."""
    return counts(view, lengths, ties) + f", d as (select code, m, sum(c)::double as support, count(*) filter (where c >= {minsup})::bigint as qualifying from k group by all)"


TEXT = "array_to_string(code, ',')"
BEST = "order by support desc, m, code"


def best(view: str, lengths: list[int], budget: int, minsup: float = 2.0) -> str:
    """t: the dictionary with ranks."""
    limit = f" limit {budget}" if budget else ""
    return support(view, lengths, minsup) + f", t as (select row_number() over ({BEST}) as rank, * from d where qualifying > 0 {BEST}{limit})"


DICTIONARY = f" select rank::int as rank, {TEXT} as code, m::int as length, support, qualifying as qualifying_series from t"


def cells(view: str, lengths: list[int], budget: int, label: bool = True) -> str:
    """f: sid, rank, cnt, label of every series and pattern."""
    who = "select vec_id as sid, label from embeddings" if label else "select distinct sid, null as label from s"
    return best(view, lengths, budget) + f", f as (select q.sid, t.rank, coalesce(k.c, 0)::double as cnt, q.label from ({who}) q cross join t left join k on k.sid = q.sid and k.code = t.code)"


#: eta: by rank the contrast statistics and their rank.
ETA = """, g as (select rank, label, count(*) as n, avg(cnt) as mean from f group by all)
, o as (select rank, sum(cnt) as support, count(*) filter (where cnt > 0) as present, avg(cnt) as mean, stddev_pop(cnt) as std, sum(cnt * cnt) - sum(cnt) * sum(cnt) / count(*) as tv from f group by rank)
, eta as (select o.*, case when o.tv = 0 then 0 else least(1, greatest(0, (select sum(g.n * (g.mean - o.mean) ** 2) from g where g.rank = o.rank) / o.tv)) end as eta_squared,
  (select arg_min(g.label, (-g.mean, g.label)) from g where g.rank = o.rank) as strongest from o)
, er as (select *, row_number() over (order by round(eta_squared, 9) desc, rank) as contrast_rank from eta)"""
