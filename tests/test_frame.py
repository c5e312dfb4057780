import math

import pytest

from tabulark import Frame, concat
from tabulark.errors import ColumnNotFound, FrameError, InvalidOption, OrderRequired, ParseFailure, SchemaMismatch
from tabulark.operators import aggregate, ordered
from tabulark.plans.catalog import QUERIES
from tabulark.sources import readers


def frame(spark, rows, schema):
    return Frame(readers.from_rows(spark, rows, schema))


def test_missing_column_suggests(spark):
    f = frame(spark, [("a", 1)], "name string, age bigint")
    with pytest.raises(ColumnNotFound, match="did you mean 'name'"):
        f.select("nme")
    with pytest.raises(InvalidOption):
        f.drop("name", "age")
    with pytest.raises(OrderRequired):
        f.head(1, None)


def test_variance_of_one_row_and_none(spark):
    assert frame(spark, [(5.0,)], "x double").variance("x") == 0.0
    assert frame(spark, [], "x double").sum("x") is None
    assert frame(spark, [], "x double").variance("x") is None


def test_constant_column_has_no_correlation(spark):
    f = frame(spark, [(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert {(r.col_a, r.col_b): r.corr for r in f.corr_matrix().collect()} == {("a", "a"): 1.0, ("a", "b"): 0.0, ("b", "a"): 0.0, ("b", "b"): 1.0}


def test_nan_sorts_last_and_is_missing(spark):
    f = frame(spark, [(1, float("nan")), (2, 3.0), (3, -1.0)], "id bigint, x double")
    assert [r.id for r in f.sort("x").collect()] == [3, 2, 1]
    assert [r.id for r in f.where("x", ">", 0).collect()] == [2]
    assert f.dropna(["x"]).shape == (2, 2)


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_blocks_agree_with_one_window(spark, block):
    rows = [(i, float(i * i % 7)) for i in range(1, 18)]
    df = readers.from_rows(spark, rows, "i bigint, x double")
    run = ordered.expanding(df, "x", "sum", "i", name="s", block=block).orderBy("i").collect()
    total, want = 0.0, []
    for _, x in rows:
        total += x
        want.append(total)
    assert [r.s for r in run] == want
    made = ordered._halo(df, "i", 2, lambda w: ordered.F.sum("x").over(w.rowsBetween(-2, 0)), "s", block=block)
    assert [r.s for r in made.orderBy("i").collect()] == [sum(x for _, x in rows[max(0, k - 2) : k + 1]) for k in range(len(rows))]
    ahead = ordered._halo(df, "i", 2, lambda w: ordered.F.lead("x", 2).over(w), "s", forward=True, block=block)
    assert [r.s for r in ahead.orderBy("i").collect()] == [x for _, x in rows[2:]] + [None, None]
    gaps = df.withColumn("x", ordered.F.when(ordered.F.col("i") % 5 == 0, ordered.F.col("x")))
    near = ordered.neighbours(gaps, "x", "i", block=block).orderBy("i").collect()
    assert [r.__getitem__("__pi") for r in near] == [i - i % 5 or None for i in range(1, 18)]
    assert [r.__getitem__("__ni") for r in near] == [i if i % 5 == 0 else i + 5 - i % 5 if i <= 15 else None for i in range(1, 18)]


def test_fills_at_the_ends(spark):
    f = frame(spark, [(1, None), (2, 2.0), (3, None), (4, 6.0), (5, None)], "i bigint, x double")
    of = lambda m: [r.x for r in f.fillna("x", m, order_by="i").sort("i").collect()]
    assert of("ffill") == [0.0, 2.0, 2.0, 6.0, 6.0]
    assert of("bfill") == [2.0, 2.0, 6.0, 6.0, 0.0]
    assert of("interpolate") == [2.0, 2.0, 4.0, 6.0, 6.0]
    assert [r.x for r in frame(spark, [(1, None)], "i bigint, x double").fillna("x", "interpolate", order_by="i").collect()] == [0.0]


def test_percent_change_from_zero_is_missing(spark):
    f = frame(spark, [(1, 0.0), (2, 5.0), (3, 10.0)], "i bigint, x double")
    assert [r.x_pct_change for r in f.pct_change("x", 1, "i").sort("i").collect()] == [None, None, 1.0]
    assert frame(spark, [(3.0,)], "x double").percentile_rank("x").collect()[0].x_percentile_rank == 0.5


def test_joins_with_clashes_nulls_and_repeats(spark):
    a = frame(spark, [(1, "x"), (1, "y"), (None, "z")], "k bigint, v string")
    b = frame(spark, [(1, "p"), (1, "q"), (None, "r")], "k bigint, v string")
    j = a.join(b, "k")
    assert j.columns == ["k", "v", "k_right", "v_right"] and len(j) == 4
    assert len(a.join(b, "k", "outer")) == 6
    assert a.merge(b, "outer", "k", "k").columns == ["k", "v", "v_y"]
    assert len(a.salted_join(b, "k", 3)) == 4


def test_copies_of_a_salted_join_are_not_broadcast(spark, tmp_path):
    spark.range(5000).selectExpr("id as k", "id % 7 as v").write.parquet(str(tmp_path / "b"))
    b = Frame(readers.read_parquet(spark, str(tmp_path / "b")))
    j = frame(spark, [(k % 3, k) for k in range(100)], "k bigint, n bigint").salted_join(b, "k")
    plan = j.df._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(tuple(r) for r in j.collect()) == sorted((k % 3, k, k % 3, k % 3) for k in range(100))


def test_concat_promotes_and_sorts_columns(spark):
    c = concat(frame(spark, [(1, 2)], "b bigint, a bigint"), frame(spark, [(2.5, "s")], "b double, c string"), fill=True)
    assert c.columns == ["a", "b", "c"]
    assert sorted(tuple(r) for r in c.collect()) == [(0, 2.5, "s"), (2, 1.0, "")]
    with pytest.raises(SchemaMismatch):
        frame(spark, [(1,)], "a bigint").append(frame(spark, [(1,)], "b bigint"))


def test_csv_inference_modes_and_headers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿id,ok,score,zip,note\r\n1,yes,1.5,x1,"a, ""b""\nc"\r\n\r\n2,no,,y2,é\r\n'.encode())
    df = readers.read_csv(spark, str(p), multiline=True)
    assert df.dtypes == [("id", "bigint"), ("ok", "boolean"), ("score", "double"), ("zip", "string"), ("note", "string")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, True, 1.5, "x1", 'a, "b"\nc'), (2, False, None, "y2", "é")]
    assert readers.read_csv(spark, str(p), multiline=True, empty="compat").where("id = 2").first().score == 0.0
    assert readers.read_csv(spark, str(p), header=False, multiline=True).columns == [f"col{i}" for i in range(5)]
    (tmp_path / "b.csv").write_text("n\n1\nx\n")
    with pytest.raises(ParseFailure):
        readers.read_csv(spark, str(tmp_path / "b.csv"), mode="strict", schema={"n": "bigint"})


@pytest.mark.parametrize("first, lang", [(10**18, "en"), (0, "no"), (5, "1")])
def test_csv_keeps_odd_texts_keys_and_types(spark, tmp_path, first, lang):
    texts = [" a", "a ", "\n", "a\r\n", "\t;\t", "", None, '"', '";"', 'a;"', "\\", '\\"', "\0", "\0;\0", "#", "a\rb"]
    want = [(first + k, x, None if k == 2 and lang == "en" else lang) for k, x in enumerate(texts)]
    want = want[:2] if not first else want
    readers.from_rows(spark, want, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["csv_quoted_round_trip"](spark, str(tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string")]
    assert sorted(tuple(r) for r in df.collect()) == want


def test_csv_infers_whole_numbers_as_far_as_they_go(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"a,b\n{2**63 - 1},{2**63}\n{-2**63},1\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("a", "bigint"), ("b", "double")]
    assert sorted(r.a for r in df.collect()) == [-(2**63), 2**63 - 1]


def test_json_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"}, {"a": 2}]')
    assert sorted(tuple(r) for r in readers.read_json(spark, str(tmp_path / "a.json"), "array").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "c.json").write_text('{"a": [1, 2], "b": ["x", "y"]}')
    assert sorted(tuple(r) for r in readers.read_json(spark, str(tmp_path / "c.json"), "columns").collect()) == [(1, "x"), (2, "y")]
    (tmp_path / "d.json").write_text('{"a": [1, 2], "b": ["x"]}')
    with pytest.raises(FrameError):
        readers.read_json(spark, str(tmp_path / "d.json"), "columns")


def test_text_out(spark):
    f = frame(spark, [(1, 'a"b,c'), (2, None)], "id bigint, s string")
    assert f.to_csv(order_by=["id"]) == 'id,s\n1,"a""b,c"\n2,\n'
    assert f.to_json(layout="columns", order_by=["id"]) == '{"id": [1, 2], "s": ["a\\"b,c", null]}'


def test_streams_refuse_a_global_order(spark, tmp_path):
    s = Frame(readers.stream_csv(spark, str(tmp_path), "a bigint, b bigint"))
    with pytest.raises(FrameError):
        s.rolling("a", 3, "sum", "b")


def test_filters_and_columns_reach_the_scan(spark):
    df = Frame(spark.read.parquet("/root/testdata/sf0.001/orders.parquet")).where("o_totalprice", ">", 1000).select("o_orderkey").df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "o_comment" not in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_rank_needs_no_single_partition_window(spark):
    df = Frame(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).rank("user_id").df
    assert df.count() > 0 and all(not math.isnan(r[0]) for r in df.select("user_id_rank").limit(5).collect())


@pytest.mark.parametrize("most", [0, 300, 10**6])
def test_quantiles_are_exact_whatever_the_number_of_values(spark, most):
    import random

    r = random.Random(4)
    xs = [r.gauss(0, 1) for _ in range(4000)] + [0.25] * 2000  # a third are one value
    df = readers.from_rows(spark, [(x,) for x in xs] + [(None,)], "x double")
    qs = [0.0, 0.1, 0.37, 0.5, 0.6, 0.61, 0.9999, 1.0]
    got = df.agg(*[c.alias(f"q{i}") for i, c in enumerate(aggregate.exact_quantiles(df, "x", qs, most))]).first()
    xs.sort()
    for q, x in zip(qs, got):
        at = q * (len(xs) - 1)
        k = min(int(at), len(xs) - 2)
        assert abs(x - (xs[k] + (xs[k + 1] - xs[k]) * (at - k))) < 1e-12


def test_share_of_null_and_zero_groups(spark):
    f = frame(spark, [("a", 1.0), ("a", 3.0), (None, 2.0), ("z", 0.0)], "k string, x double").share_of_group("k", "x")
    assert {(r.k, r.x): r.share for r in f.collect()} == {("a", 1.0): 0.25, ("a", 3.0): 0.75, (None, 2.0): 1.0, ("z", 0.0): None}


def test_named_joins_and_the_bound_of_the_cross_join(spark):
    a, b = frame(spark, [(1, "x"), (2, "y")], "k bigint, v string"), frame(spark, [(2, "p"), (3, "q")], "k bigint, w string")
    assert [len(f) for f in (a.inner_join(b, "k"), a.left_join(b, "k"), a.right_join(b, "k"), a.outer_join(b, "k"))] == [1, 2, 2, 3]
    assert len(a.cross_join(b)) == 4 and len(a.cross_join(b, None)) == 4
    with pytest.raises(InvalidOption):
        a.cross_join(b, 3)


def test_categories_and_arrow_types(spark):
    from tabulark.sources import writers

    df = readers.from_rows(spark, [(i, "ab"[i % 2], f"t{i}") for i in range(100)], "i bigint, few string, many string")
    assert readers.categorical(df) == ["few"]
    assert [str(f.type) for f in writers.arrow_schema(df)] == ["int64", "string", "string"]


def test_updates_that_keep_what_is_there(spark):
    a = frame(spark, [(1, None, 5.0), (2, "y", 6.0)], "k bigint, v string, x double")
    b = frame(spark, [(1, "p", 7.0), (2, "q", 8.0)], "k bigint, v string, x double")
    assert sorted(tuple(r) for r in a.update(b, "k", overwrite=False, order_by="v").collect()) == [(1, "p", 5.0), (2, "y", 6.0)]


def test_split_of_unknown_width(spark):
    f = frame(spark, [(1, "a b"), (2, "a"), (3, "a b c d")], "i bigint, s string").split_columns("s", " ", "s")
    assert f.columns == ["i", "s", "s_0", "s_1", "s_2", "s_3"] and {r.s_3 for r in f.collect()} == {"", "d"}


@pytest.mark.parametrize(("method", "want"), [("min", 1.0), ("max", 2.0), ("average", 1.5)])
def test_percentile_ranks_of_ties(spark, method, want):
    f = frame(spark, [(1.0,), (2.0,), (2.0,), (3.0,)], "x double").percentile_rank("x", method)
    got = sorted(r.x_percentile_rank for r in f.collect())
    assert got[1] == got[2] == want / 3
