"""Every registered query of the frame operators over whole tables, with the same in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from .. import storage
from ..frame import Frame, concat
from ..functions import strings

from ..sources import readers, writers
from ..streaming import windowed

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, sf_dir, name) -> Frame:
    return Frame(readers.read_parquet(spark, f"{sf_dir}/{name}.parquet"))


def rounded(frame: Frame, *columns, digits: int = 4):
    df = frame.df
    return df.withColumns({c: F.round(c, digits) for c in columns})


def r(c, digits=4):
    return f"round({c}, {digits})"


# -- flagship


def flagship(spark, sf_dir):
    line = t(spark, sf_dir, "lineitem").where("l_shipdate", "<", datetime.datetime(1998, 9, 2))
    line = line.with_column("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = line.group_by(["l_returnflag", "l_linestatus"], [("l_quantity", "sum"), ("revenue", "sum"), ("l_discount", "mean"), ("l_orderkey", "count")])
    return rounded(out.sort("l_returnflag", "l_linestatus"), "l_quantity_Sum", "revenue_Sum", "l_discount_Mean", digits=2)


query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as "l_quantity_Sum", round(sum(l_extendedprice * (1 - l_discount)), 2) as "revenue_Sum",
  round(avg(l_discount), 2) as "l_discount_Mean", count(*)::double as "l_orderkey_Count" from lineitem where l_shipdate < timestamp '1998-09-02' group by 1, 2""")(flagship)


# -- projection, filters, row selection


@query("select o_orderkey, o_totalprice from orders")
def select_columns(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").df


@query("select p_partkey, p_name, p_type, p_retailprice from part")
def drop_columns(spark, d):
    return t(spark, d, "part").drop("p_brand", "p_size", "no_such_column").df


@query("select n_nationkey as id, n_name as nation, n_regionkey from nation")
def rename_columns(spark, d):
    return t(spark, d, "nation").rename({"n_nationkey": "id", "n_name": "nation", "absent": "x"}).df


@query("select o_orderkey, round(o_totalprice * 2, 4) as doubled from orders")
def with_computed_column(spark, d):
    return t(spark, d, "orders").with_column("doubled", F.round(F.col("o_totalprice") * 2, 4)).select("o_orderkey", "doubled").df


@query("select p_partkey, p_size::double as p_size from part")
def replace_one_column(spark, d):
    return t(spark, d, "part").replace_column("p_size", F.col("p_size").cast("double")).select("p_partkey", "p_size").df


@query("select event_id, user_id, value from events where value > 50 and event_type = 'purchase'")
def filter_compare(spark, d):
    return t(spark, d, "events").where("value", ">", 50).where("event_type", "==", "purchase").select("event_id", "user_id", "value").df


@query("select o_orderkey from orders where o_totalprice <= 100000 or o_orderstatus <> 'F'")
def filter_expression(spark, d):
    return t(spark, d, "orders").where((F.col("o_totalprice") <= 100000) | (F.col("o_orderstatus") != "F")).select("o_orderkey").df


@query("select event_id, value from events where value is not null and value > 90 and value % 2 < 1")
def filter_row_function(spark, d):
    return t(spark, d, "events").select("event_id", "value").filter_rows(lambda row: row["value"] is not None and row["value"] > 90 and row["value"] % 2 < 1).df


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders order by place limit 100")
def sort_top_k(spark, d):
    top = t(spark, d, "orders").select("o_orderkey", "o_totalprice").top_k(100, "-o_totalprice", tie_break=["o_orderkey"])
    return top.with_position(["-o_totalprice", "o_orderkey"], "place").df


@query("select o_orderkey, o_orderstatus, row_number() over (order by o_orderstatus, o_totalprice desc, o_orderkey) as place from orders")
def sort_many_keys(spark, d):
    return t(spark, d, "orders").with_position(["o_orderstatus", "-o_totalprice", "o_orderkey"], "place").select("o_orderkey", "o_orderstatus", "place").df


@query("select * from customer order by c_custkey limit 25")
def head_rows(spark, d):
    return t(spark, d, "customer").head(25, "c_custkey").df


@query("select * from customer order by c_custkey desc limit 25")
def tail_rows(spark, d):
    return t(spark, d, "customer").tail(25, "c_custkey").df


@query("select event_id, ts from events order by event_id limit 40 offset 10")
def slice_of_rows(spark, d):
    return t(spark, d, "events").slice_rows(10, 50, "event_id").select("event_id", "ts").df


@query("select * from orders order by o_orderkey limit 1 offset 7")
def one_row(spark, d):
    return t(spark, d, "orders").row(7, "o_orderkey").df


@query("select * from orders order by md5('3|' || o_orderkey), o_orderkey limit 500")
def sample_rows(spark, d):
    return t(spark, d, "orders").sample(500, "o_orderkey", seed=3).df


@query("""with p as (select *, row_number() over (order by md5('3|' || o_orderkey), o_orderkey) - 1 as place, count(*) over () as n from orders),
  draws as (select ('0x' || substring(md5('3|draw|' || i), 1, 15))::bigint as h from range(500) x(i)) select p.* exclude (place, n) from p join draws on place = h % n""")
def sample_with_replacement(spark, d):
    return t(spark, d, "orders").sample(500, "o_orderkey", seed=3, replace=True).df


@query("select distinct event_type as value from events")
def unique_values(spark, d):
    return t(spark, d, "events").unique("event_type").df


@query("select count(distinct user_id)::double as nunique, count(distinct event_type)::double as types from events")
def count_distinct(spark, d):
    f = t(spark, d, "events")
    return f.statistics("user_id", "nunique").df.crossJoin(f.statistics("event_type", "nunique").df.withColumnRenamed("nunique", "types"))


@query("select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def drop_duplicates_subset(spark, d):
    return t(spark, d, "events").drop_duplicates(["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type").df


@query("select distinct l_returnflag, l_linestatus from lineitem")
def drop_duplicates_all(spark, d):
    return t(spark, d, "lineitem").select("l_returnflag", "l_linestatus").drop_duplicates().df


@query("""select 'o_orderkey' as "column", 'bigint' as type, count(o_orderkey) as present, count(*) - count(o_orderkey) as missing from orders
  union all select 'o_totalprice', 'double', count(o_totalprice), count(*) - count(o_totalprice) from orders union all select 'o_orderstatus', 'string', count(o_orderstatus), count(*) - count(o_orderstatus) from orders""")
def frame_info(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").info().df


# -- joins


def _some(spark, d):
    """All customers, and all orders under keys moved by 100: the first customers have no order, the last orders no customer."""
    c = t(spark, d, "customer").rename({"c_custkey": "key", "c_name": "name"}).select("key", "name", "c_acctbal")
    o = t(spark, d, "orders").with_column("key", F.col("o_custkey") + 100).rename({"o_orderpriority": "name"}).select("key", "name", "o_orderkey")
    return c, o


_C = "(select c_custkey as key, c_name as name, c_acctbal from customer) c"
_O = "(select o_custkey + 100 as key, o_orderpriority as name, o_orderkey from orders) o"
_BOTH = "c.key as key, c.name as name, c_acctbal, o.key as key_right, o.name as name_right, o_orderkey"


@query(f"select {_BOTH} from {_C} join {_O} on c.key = o.key")
def join_inner(spark, d):
    c, o = _some(spark, d)
    return c.join(o, "key").df


@query(f"select {_BOTH} from {_C} left join {_O} on c.key = o.key")
def join_left(spark, d):
    c, o = _some(spark, d)
    return c.join(o, "key", "left").df


@query(f"select c.key as key, c.name as name, c_acctbal, coalesce(o.key, 0) as key_right, coalesce(o.name, '') as name_right, coalesce(o_orderkey, 0) as o_orderkey from {_C} left join {_O} on c.key = o.key")
def join_left_filled(spark, d):
    c, o = _some(spark, d)
    return c.join(o, "key", "left", fill=True).df


@query(f"select o.key as key, o.name as name, o_orderkey, c.key as key_right, c.name as name_right, c_acctbal from {_O} left join {_C} on c.key = o.key")
def join_right(spark, d):
    c, o = _some(spark, d)
    return c.join(o, "key", "right").df


@query(f"select {_BOTH} from {_C} full join {_O} on c.key = o.key")
def join_outer(spark, d):
    c, o = _some(spark, d)
    return c.join(o, "key", "outer").df


@query("select * from nation, region")
def join_cross(spark, d):
    return t(spark, d, "nation").join(t(spark, d, "region"), None, "cross").df


@query("select a.event_id, a.user_id, a.event_type, b.event_id as event_id_right, b.user_id as user_id_right, b.event_type as event_type_right from events a join events b on a.user_id = b.user_id and a.event_type = b.event_type")
def join_two_keys(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "event_type")
    return e.join(e.clone(), ["user_id", "event_type"]).df


@query(f"select c.* from {_C} where key in (select o_custkey + 100 from orders)")
def join_semi(spark, d):
    c, o = _some(spark, d)
    return c.join(o, "key", "semi").select("key", "name", "c_acctbal").df


@query(f"select c.* from {_C} where not exists (select 1 from orders where o_custkey + 100 = key)")
def join_anti(spark, d):
    c, o = _some(spark, d)
    return c.join(o, "key", "anti").select("key", "name", "c_acctbal").df


@query("select l_orderkey, l_partkey, l_quantity, p_partkey as p_partkey, p_brand from lineitem join part on l_partkey = p_partkey")
def join_salted(spark, d):
    left = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    right = t(spark, d, "part").select("p_partkey", "p_brand").with_column("l_partkey", F.col("p_partkey"))
    return left.salted_join(right, "l_partkey").drop("l_partkey_right").df


_MERGE = "c.key as id, c.name as name, c_acctbal, o.name as name_y, o_orderkey"


def _merging(spark, d, how, **kw):
    c, o = _some(spark, d)
    return c.rename({"key": "id"}).merge(o, how, "id", "key", **kw).df


@query(f"select {_MERGE} from {_C} join {_O} on c.key = o.key")
def merge_inner(spark, d):
    return _merging(spark, d, "inner")


@query(f"select {_MERGE} from {_C} left join {_O} on c.key = o.key")
def merge_left(spark, d):
    return _merging(spark, d, "left")


@query(f"select o.key as key, o.name as name, o_orderkey, c.name as name_y, c_acctbal from {_O} left join {_C} on c.key = o.key")
def merge_right(spark, d):
    return _merging(spark, d, "right")


@query(f"select coalesce(c.key, o.key) as id, c.name as name, c_acctbal, o.name as name_y, o_orderkey from {_C} full join {_O} on c.key = o.key")
def merge_outer(spark, d):
    return _merging(spark, d, "outer")


@query("select r.r_regionkey, r.r_name, q.r_regionkey as r_regionkey_right, q.r_name as r_name_right from region r, region q")
def merge_cross(spark, d):
    return t(spark, d, "region").merge(t(spark, d, "region"), "cross").df


@query("""select r_name, n_name, count(*)::double as "o_orderkey_Count", round(sum(o_totalprice), 2) as "o_totalprice_Sum" from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def join_chain(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").merge(t(spark, d, "customer").select("c_custkey", "c_nationkey"), "inner", "o_custkey", "c_custkey")
    n = t(spark, d, "nation").merge(t(spark, d, "region"), "inner", "n_regionkey", "r_regionkey")
    out = o.merge(n, "inner", "c_nationkey", "n_nationkey").group_by(["r_name", "n_name"], [("o_orderkey", "count"), ("o_totalprice", "sum")])
    return rounded(out, "o_totalprice_Sum", digits=2)


# -- aggregation


@query("""select event_type, round(sum(value), 4) as "value_Sum", round(avg(value), 4) as "value_Mean", count(*)::double as "value_Count", min(value) as "value_Min", max(value) as "value_Max" from events group by 1""")
def group_by_all_functions(spark, d):
    out = t(spark, d, "events").group_by("event_type", [("value", f) for f in ("sum", "mean", "count", "min", "max")])
    return rounded(out, "value_Sum", "value_Mean")


@query("""select o_orderpriority, o_orderstatus, round(avg(o_totalprice), 2) as "o_totalprice_Mean" from orders group by 1, 2 having count(*) > 100""")
def group_by_having(spark, d):
    out = t(spark, d, "orders").group_by(["o_orderpriority", "o_orderstatus"], [("o_totalprice", "mean"), ("o_orderkey", "count")], having=F.col("o_orderkey_Count") > 100)
    return rounded(out.drop("o_orderkey_Count"), "o_totalprice_Mean", digits=2)


@query("""select l_returnflag, l_linestatus, count(*)::double as "l_orderkey_Count" from lineitem group by rollup (l_returnflag, l_linestatus)""")
def rollup_counts(spark, d):
    return t(spark, d, "lineitem").rollup(["l_returnflag", "l_linestatus"], [("l_orderkey", "count")]).df


@query("""select l_returnflag, l_linestatus, count(*)::double as "l_orderkey_Count" from lineitem group by cube (l_returnflag, l_linestatus)""")
def cube_counts(spark, d):
    return t(spark, d, "lineitem").cube(["l_returnflag", "l_linestatus"], [("l_orderkey", "count")]).df


@query("""select round(sum(value), 3) as sum, round(avg(value), 4) as mean, min(value) as min, max(value) as max, count(value)::double as count, round(var_samp(value), 3) as variance,
  round(stddev_samp(value), 4) as std, round(median(value), 4) as median, round(quantile_cont(value, 0.37), 4) as "quantile_0_37" from events""")
def column_statistics(spark, d):
    out = t(spark, d, "events").statistics("value", "sum", "mean", "min", "max", "count", "variance", "std", "median", "quantile:0.37")
    return rounded(Frame(rounded(out, "sum", "variance", digits=3)), "mean", "std", "median", "quantile_0_37")


@query("""with c as (select round(corr(l_quantity, l_extendedprice), 4) as a, round(corr(l_quantity, l_discount), 4) as b, round(corr(l_extendedprice, l_discount), 4) as e from lineitem)
  select 'l_quantity' as col_a, 'l_quantity' as col_b, 1.0::double as corr from c union all select 'l_quantity', 'l_extendedprice', a from c union all select 'l_quantity', 'l_discount', b from c
  union all select 'l_extendedprice', 'l_quantity', a from c union all select 'l_extendedprice', 'l_extendedprice', 1.0 from c union all select 'l_extendedprice', 'l_discount', e from c
  union all select 'l_discount', 'l_quantity', b from c union all select 'l_discount', 'l_extendedprice', e from c union all select 'l_discount', 'l_discount', 1.0 from c""")
def correlation_matrix(spark, d):
    return rounded(t(spark, d, "lineitem").corr_matrix(["l_quantity", "l_extendedprice", "l_discount"]), "corr")


@query("select o_orderpriority as value, count(*)::double as count from orders group by 1")
def value_counts(spark, d):
    return t(spark, d, "orders").value_counts("o_orderpriority").df


@query("select event_type as value, round(count(*)::double / (select count(*) from events), 6) as count from events group by 1")
def value_counts_normalized(spark, d):
    return rounded(t(spark, d, "events").value_counts("event_type", normalize=True), "count", digits=6)


@query("""select 'p_size' as "column", count(p_size)::double as count, round(avg(p_size), 4) as mean, round(stddev_pop(p_size), 4) as std, min(p_size)::double as min, max(p_size)::double as max from part
  union all select 'p_retailprice', count(p_retailprice), round(avg(p_retailprice), 4), round(stddev_pop(p_retailprice), 4), min(p_retailprice), max(p_retailprice) from part
  union all select 'p_brand', count(p_brand), null, null, null, null from part""")
def describe_population(spark, d):
    return rounded(t(spark, d, "part").select("p_size", "p_retailprice", "p_brand").describe(), "mean", "std")


_SUM = "select '{0}' as \"column\", count({0})::double as count, round(avg({0}), 4) as mean, round(stddev_samp({0}), 4) as std, min({0})::double as min, max({0})::double as max, round(median({0}), 4) as median, round(quantile_cont({0}, 0.25), 4) as q25, round(quantile_cont({0}, 0.75), 4) as q75 from part"


@query(" union all ".join(_SUM.format(c) for c in ("p_size", "p_retailprice")))
def describe_sample(spark, d):
    return rounded(t(spark, d, "part").summary(["p_size", "p_retailprice"]), "mean", "std", "median", "q25", "q75")


@query("select event_id, round(value / sum(value) over (partition by event_type), 8) as share from events")
def share_of_group(spark, d):
    return rounded(t(spark, d, "events").share_of_group("event_type", "value").select("event_id", "share"), "share", digits=8)


@query("select event_type, round(max(value) - min(value), 4) as spread from events group by 1")
def group_function(spark, d):
    return rounded(t(spark, d, "events").group_apply("event_type", "value", lambda s: s.max() - s.min(), "spread"), "spread")


# -- ordered


def _window_query(name, make, sql, single=False):
    """single: compared as single-precision numbers, since averages over powers of two are ties of any
    decimal rounding."""

    def run(spark, d):
        out = make(t(spark, d, "events").select("event_id", "ts", "user_id", "value")).select("event_id", "x")
        return out.df.withColumn("x", F.col("x").cast("float").cast("double")) if single else rounded(out, "x", digits=7)

    run.__name__ = name
    value = f"({sql})::float::double" if single else f"round(({sql})::double, 7)"
    query(f"select event_id, {value} as x from events")(run)


_W = "over (order by ts, event_id rows between {} and current row)"
_BY = ["ts", "event_id"]
for _a, _f in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_pop")):
    _window_query(f"rolling_{_a}", lambda f, a=_a: f.rolling("value", 7, a, _BY, name="x"), f"{_f}(value) " + _W.format("6 preceding"))
for _a, _f in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")):
    _window_query(f"expanding_{_a}", lambda f, a=_a: f.expanding("value", a, _BY, name="x"), f"{_f}(value) " + _W.format("unbounded preceding"), _a == "mean")
_window_query("rolling_partitioned", lambda f: f.rolling("value", 3, "mean", _BY, partition_by="user_id", name="x"), "avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row)")
_window_query("expanding_partitioned", lambda f: f.expanding("value", "sum", _BY, partition_by="user_id", name="x"), "sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)")
_window_query("shift_back", lambda f: f.shift("value", 2, _BY, name="x"), "lag(value, 2) over (order by ts, event_id)")
_window_query("shift_forward", lambda f: f.shift("value", -3, _BY, name="x"), "lead(value, 3) over (order by ts, event_id)")
_window_query("difference_from_lag", lambda f: f.diff("value", 1, _BY, name="x"), "value - lag(value) over (order by ts, event_id)")
_window_query("percent_change", lambda f: f.pct_change("value", 1, _BY, name="x"), "(value - lag(value) over (order by ts, event_id)) / nullif(lag(value) over (order by ts, event_id), 0)")
_R, _P = "rank() over (order by user_id)", "count(*) over (partition by user_id)"
for _m, _s in {"average": f"{_R} + ({_P} - 1) / 2.0", "min": _R, "max": f"{_R} + {_P} - 1", "dense": "dense_rank() over (order by user_id)", "first": "row_number() over (order by user_id, ts, event_id)"}.items():
    _window_query(f"rank_{_m}", lambda f, m=_m: f.rank("user_id", m, order_by=_BY, name="x"), _s)
_window_query("rank_partitioned", lambda f: f.with_column("v", F.floor("value")).rank("v", "average", partition_by="user_id", name="x"), "rank() over (partition by user_id order by floor(value)) + (count(*) over (partition by user_id, floor(value)) - 1) / 2.0")
_window_query("percentile_rank", lambda f: f.percentile_rank("user_id", "min", name="x"), "percent_rank() over (order by user_id)")


# -- missing data


def _gaps(spark, d):
    return t(spark, d, "events").with_column("value", F.when(F.col("value") > 50, F.col("value"))).select("event_id", "ts", "value", "event_type")


_G = "(select event_id, ts, event_type, case when value > 50 then value end as value from events)"


@query(f"select event_id, value is null as value_isna, value is not null as value_notna from {_G}")
def missing_flags(spark, d):
    return _gaps(spark, d).isna("value").notna("value").select("event_id", "value_isna", "value_notna").df


@query("select l_orderkey, l_quantity, l_linenumber = 1 as flag from (select l_orderkey, l_quantity, l_linenumber from lineitem) where l_linenumber <> 0")
def missing_compat(spark, d):
    f = t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber").dropna(["l_linenumber"], compat=True)
    return Frame(f.df.withColumn("z", F.col("l_linenumber") - 1)).isna("z", compat=True, name="flag").select("l_orderkey", "l_quantity", "flag").df


@query(f"select event_id, coalesce(value, -1.0) as value from {_G}")
def fill_constant(spark, d):
    return _gaps(spark, d).fillna("value", value=-1.0).select("event_id", "value").df


@query(f"select event_id, coalesce(last_value(value ignore nulls) over (order by ts, event_id rows between unbounded preceding and current row), 0.0) as value from {_G}")
def fill_forward(spark, d):
    return _gaps(spark, d).fillna("value", "ffill", order_by=_BY).select("event_id", "value").df


@query(f"select event_id, coalesce(first_value(value ignore nulls) over (order by ts, event_id rows between current row and unbounded following), 0.0) as value from {_G}")
def fill_backward(spark, d):
    return _gaps(spark, d).fillna("value", "bfill", order_by=_BY).select("event_id", "value").df


@query(f"""with a as (select *, row_number() over (order by ts, event_id) as i from {_G}), b as (select *, case when value is not null then i end as own from a),
  c as (select event_id, value, i, last_value(value ignore nulls) over p as pv, last_value(own ignore nulls) over p as pi, first_value(value ignore nulls) over n as nv, first_value(own ignore nulls) over n as ni
  from b window p as (order by i rows between unbounded preceding and current row), n as (order by i rows between current row and unbounded following))
  select event_id, round(coalesce(value, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv, nv, 0.0), 7) as value from c""")
def fill_interpolate(spark, d):
    return rounded(_gaps(spark, d).fillna("value", "interpolate", order_by=_BY).select("event_id", "value"), "value", digits=7)


@query(f"select event_id, value from {_G} where value is not null")
def drop_missing_any(spark, d):
    return _gaps(spark, d).select("event_id", "value").dropna().df


@query(f"select event_id, value, kind from (select event_id, value, case when event_type <> 'click' then event_type end as kind from {_G}) where value is not null or kind is not null")
def drop_missing_all(spark, d):
    f = _gaps(spark, d).with_column("kind", F.when(F.col("event_type") != "click", F.col("event_type"))).select("event_id", "value", "kind")
    return f.dropna(["value", "kind", "no_such"], how="all").df


# -- strings

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"""select doc_id, md5(translate(text, '{_UP}', '{_LOW}')) as low, md5(translate(text, '{_LOW}', '{_UP}')) as up, strlen(text)::bigint as bytes, contains(text, 'the') as has_the,
  md5(replace(text, 'an', '<AN>')) as replaced, substring(text, 4, 9) as cut, starts_with(text, 'The') as starts, ends_with(text, '.') as ends, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) as trimmed from documents""")
def string_functions(spark, d):
    f = t(spark, d, "documents")
    for name, args, to in (("lower", (), "low"), ("upper", (), "up"), ("len", (), "bytes"), ("contains", ("the",), "has_the"), ("replace", ("an", "<AN>"), "replaced"), ("slice", (3, 12), "cut"), ("starts_with", ("The",), "starts"), ("ends_with", (".",), "ends"), ("trim", (), "trimmed")):
        f = getattr(f.str("text"), name)(*args, to=to)
    return f.df.select("doc_id", "cut", "bytes", "has_the", "starts", "ends", *[F.md5(F.encode(c, "UTF-8")).alias(c) for c in ("low", "up", "replaced", "trimmed")])


@query("select p_partkey, coalesce(string_split(p_type, ' ')[1], '') as part_0, coalesce(string_split(p_type, ' ')[2], '') as part_1, coalesce(string_split(p_type, ' ')[3], '') as part_2 from part")
def string_split(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_type").split_columns("p_type", " ", parts=3).drop("p_type").df


@query("select doc_id, hex(encode(text)[1:5]) as head from documents")
def string_slice_bytes(spark, d):
    return t(spark, d, "documents").df.select("doc_id", F.hex(strings.slice_text(F.col("text"), 0, 5, "byte")).alias("head"))


# -- reshape and combine


@query("""select o_orderpriority, round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2) as "F", round(sum(o_totalprice) filter (o_orderstatus = 'O'), 2) as "O", round(sum(o_totalprice) filter (o_orderstatus = 'P'), 2) as "P" from orders group by 1""")
def pivot_sum(spark, d):
    return rounded(t(spark, d, "orders").pivot("o_orderpriority", "o_orderstatus", "o_totalprice"), "F", "O", "P", digits=2)


@query("""select o_orderpriority, count(*) filter (o_orderstatus = 'F')::double as "F", count(*) filter (o_orderstatus = 'O')::double as "O", count(*) filter (o_orderstatus = 'P')::double as "P" from orders group by 1""")
def pivot_count(spark, d):
    f = t(spark, d, "orders").pivot("o_orderpriority", "o_orderstatus", "o_totalprice", "count", ["F", "O", "P"])
    return f.df.fillna(0.0)


@query("select o_orderstatus, " + ", ".join(f"round({f}(o_totalprice) filter (o_orderpriority like '{k}-%'), 2) as {n}_{k}" for n, f in (("mean", "avg"), ("max", "max")) for k in range(1, 6)) + " from orders group by 1")
def pivot_mean_max(spark, d):
    f = t(spark, d, "orders")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    a, b = (f.pivot("o_orderstatus", "o_orderpriority", "o_totalprice", g, names).df.toDF("o_orderstatus", *[f"{g}_{k[0]}" for k in names]) for g in ("mean", "max"))
    return rounded(Frame(a.join(b, "o_orderstatus")), *[f"{g}_{k[0]}" for g in ("mean", "max") for k in names], digits=2)


@query("""select event_type, round(sum(value) filter (user_id % 2 = 0), 4) as "false", round(sum(value) filter (user_id % 2 = 1), 4) as "true" from events group by 1""")
def unstack_sum(spark, d):
    f = t(spark, d, "events").with_column("odd", F.col("user_id") % 2 == 1).unstack("event_type", "odd", "value")
    return rounded(f, "false", "true")


@query("select p_partkey, p_brand, 'p_size' as variable, p_size::double as value from part union all select p_partkey, p_brand, 'p_retailprice', p_retailprice from part")
def melt_columns(spark, d):
    return t(spark, d, "part").melt(["p_partkey", "p_brand"], ["p_size", "p_retailprice"]).df


@query("select s_suppkey, 's_nationkey' as variable, s_nationkey::double as value from supplier union all select s_suppkey, 's_acctbal', s_acctbal from supplier")
def stack_columns(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").stack("s_suppkey").df


@query("""select 'r_regionkey' as "column", max(r_regionkey) filter (i = 1)::double as row_0, max(r_regionkey) filter (i = 2)::double as row_1, max(r_regionkey) filter (i = 3)::double as row_2, max(r_regionkey) filter (i = 4)::double as row_3, max(r_regionkey) filter (i = 5)::double as row_4
  from (select r_regionkey, row_number() over (order by r_name) as i from region)""")
def transpose_rows(spark, d):
    return t(spark, d, "region").transpose("r_name", ["r_regionkey"]).df


@query("select null::double as c_acctbal, s_acctbal as acctbal, s_name as name from supplier union all by name select c_acctbal, null::double as acctbal, c_name as name from customer")
def concat_vertical(spark, d):
    s = t(spark, d, "supplier").rename({"s_acctbal": "acctbal", "s_name": "name"}).select("acctbal", "name")
    c = t(spark, d, "customer").rename({"c_name": "name"}).select("c_acctbal", "name")
    return concat(s, c).df


@query("select a.s_suppkey, a.s_acctbal, b.s_suppkey as s_suppkey_right, b.low from (select s_suppkey, s_acctbal, row_number() over (order by s_suppkey) as i from supplier) a join (select s_suppkey, s_acctbal as low, row_number() over (order by s_acctbal, s_suppkey) as i from supplier) b on a.i = b.i")
def concat_horizontal(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return s.concat_columns(s.rename({"s_acctbal": "low"}), ["s_suppkey"], ["low", "s_suppkey"]).df


@query("select s_acctbal, s_name from supplier union all select s_acctbal, s_name from supplier where s_acctbal > 0")
def append_rows(spark, d):
    s = t(spark, d, "supplier").select("s_name", "s_acctbal")
    return s.append(s.where("s_acctbal", ">", 0)).df


@query("""select c.c_custkey, coalesce(o.p, c.c_mktsegment) as c_mktsegment, coalesce(o.o_totalprice, c.c_acctbal) as c_acctbal from customer c left join
  (select o_custkey, o_orderpriority as p, o_totalprice from orders where o_orderstatus = 'P' qualify row_number() over (partition by o_custkey order by o_orderkey) = 1) o on c_custkey = o_custkey""")
def update_by_key(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    o = t(spark, d, "orders").where("o_orderstatus", "==", "P").rename({"o_custkey": "c_custkey", "o_orderpriority": "c_mktsegment", "o_totalprice": "c_acctbal"}).select("c_custkey", "c_mktsegment", "c_acctbal", "o_orderkey")
    return c.update(o, "c_custkey", order_by="o_orderkey").df


@query("select o_custkey as k from orders union select c_custkey from customer")
def set_union(spark, d):
    return t(spark, d, "orders").df.select(F.col("o_custkey").alias("k")).transform(lambda a: Frame(a).union_distinct(Frame(t(spark, d, "customer").df.select(F.col("c_custkey").alias("k")))).df)


@query("select o_custkey as k from orders intersect select c_custkey from customer where c_acctbal > 0")
def set_intersect(spark, d):
    c = Frame(t(spark, d, "customer").where("c_acctbal", ">", 0).df.select(F.col("c_custkey").alias("k")))
    return Frame(t(spark, d, "orders").df.select(F.col("o_custkey").alias("k"))).intersect(c).df


@query("select c_custkey as k from customer except all select o_custkey from orders where o_totalprice > 200000")
def set_difference(spark, d):
    o = Frame(t(spark, d, "orders").where("o_totalprice", ">", 200000).df.select(F.col("o_custkey").alias("k")))
    return Frame(t(spark, d, "customer").df.select(F.col("c_custkey").alias("k"))).difference(o).df


# -- functions of the user


@query("select event_id, round(value * 1.5 + 1, 4) as map_result from events")
def map_double(spark, d):
    return rounded(t(spark, d, "events").select("event_id", "value").map_column("value", lambda x: x * 1.5 + 1).drop("value"), "map_result")


@query("select p_partkey, p_size * 3::bigint as a, p_size::double / 4 as b, p_size > 25 as c from part")
def map_types(spark, d):
    f = t(spark, d, "part").select("p_partkey", "p_size").map_column("p_size", lambda x: x * 3, "bigint", "a").map_column("p_size", lambda x: x / 4, "double", "b")
    return f.map_column("p_size", lambda x: x > 25, "boolean", "c").drop("p_size").df


@query("select l_orderkey, l_partkey, trunc(l_quantity * l_extendedprice)::bigint as apply_result from lineitem")
def apply_rows(spark, d):
    f = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    return f.apply_rows(lambda row: row["l_quantity"] * row["l_extendedprice"], "bigint").select("l_orderkey", "l_partkey", "apply_result").df


@query("select max(p_size) as p_size, max(p_retailprice) as p_retailprice from part")
def apply_columns(spark, d):
    return t(spark, d, "part").select("p_size", "p_retailprice").apply_columns(F.max).df


# -- sources and sinks: written, read again and compared


def _folder(spark, tag):
    import uuid

    return f"{storage.shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query("select p_partkey, p_name, p_size, p_retailprice from part")
def csv_round_trip(spark, d):
    path = _folder(spark, "csv")
    t(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").write_csv(path)
    return readers.read_csv(spark, path)


@query("select doc_id, text, lang from documents")
def csv_quoted_round_trip(spark, d):
    path, docs = _folder(spark, "csv"), t(spark, d, "documents").select("doc_id", "text", "lang")
    docs.write_csv(path, sep=";")
    return readers.read_csv(spark, path, sep=";", multiline=True, schema=dict(docs.df.dtypes))


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def json_round_trip(spark, d):
    path = _folder(spark, "json")
    t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write_json(path)
    return readers.read_json(spark, path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def parquet_round_trip(spark, d):
    path = _folder(spark, "parquet")
    t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write_parquet(path, partition_by=["o_orderstatus"])
    return readers.read_parquet(spark, path)


@query("select n_nationkey, n_name, n_regionkey from nation")
def arrow_round_trip(spark, d):
    return readers.from_arrow(spark, t(spark, d, "nation").to_arrow())


@query("select n_nationkey, n_name, n_regionkey from nation")
def csv_from_text(spark, d):
    return readers.csv_from_text(spark, t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").to_csv(sep="|"), sep="|")


@query("select n_nationkey, case when n_regionkey > 0 then n_name end as n_name, n_regionkey + 0.5 as half from nation")
def json_array_from_text(spark, d):
    f = t(spark, d, "nation").with_column("n_name", F.when(F.col("n_regionkey") > 0, F.col("n_name"))).with_column("half", F.col("n_regionkey") + F.lit(0.5))
    return readers.json_from_text(spark, f.select("n_nationkey", "n_name", "half").to_json(layout="array"), "array")


@query("select r_regionkey, r_name from region")
def json_columns_from_text(spark, d):
    return readers.json_from_text(spark, t(spark, d, "region").select("r_regionkey", "r_name").to_json(layout="columns"), "columns")


@query("select * from (values (1, 'x', null), (2, null, '2'), (3, 'y', '3,y,z'), (4, 'w', null)) v(a, b, bad)")
def csv_ragged_rows_collected(spark, d):
    return readers.csv_from_text(spark, "a,b\n1,  x \n\n2\n3,y,z\n4,w\n", mode="collect", corrupt_column="bad", trim=True, multiline=False).withColumn("a", F.col("a").cast("int"))


@query("select concat_ws(',', n_nationkey, n_name, n_regionkey) as line from nation")
def csv_text(spark, d):
    return writers.csv_lines(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").df)


@query("""select time_bucket(interval '1 day', ts) as window_start, time_bucket(interval '1 day', ts) + interval '1 day' as window_end, event_type, count(*)::double as "value_Count", round(sum(value), 4) as "value_Sum" from events group by 1, 2, 3""")
def window_of_time(spark, d):
    return rounded(Frame(windowed(t(spark, d, "events").df, "ts", "1 day", ["event_type"], [("value", "count"), ("value", "sum")])), "value_Sum")


@query("select event_type, count(*)::double as \"value_Count\", round(sum(value), 4) as \"value_Sum\" from events group by 1")
def stream_group_by(spark, d):
    """The table read as a stream of files until its end, grouped, and its last state."""
    import uuid

    schema = t(spark, d, "events").df.schema
    stream = Frame(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)).group_by("event_type", [("value", "count"), ("value", "sum")])
    name = f"stream_{uuid.uuid4().hex}"
    stream.df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", _folder(spark, "stream")).start().awaitTermination()
    return rounded(Frame(spark.table(name)), "value_Sum")


