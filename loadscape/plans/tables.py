"""Queries on table functions: predicates, renaming, chains, expansions, functions per row, column and group, named strategies."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.functions.features import fold
from loadscape.operators import strategies
from loadscape.plans.registry import query
from loadscape.sources.tables import meters, profiles, readings, table, with_tables


@query(with_tables("readings") + "SELECT row_id FROM readings WHERE value >= 10 AND value <= 60 AND kind <> 'error'")
def p19_predicate_string(spark, sf_dir):
    """A predicate given as text; it reaches the scan."""
    return readings(spark, sf_dir).where("value >= 10 and value <= 60 and kind <> 'error'").select("row_id")


@query("SELECT c_custkey AS meter, c_mktsegment AS segment, c_name AS name, c_acctbal AS yearly FROM customer")
def p21_renamed_and_reordered(spark, sf_dir):
    """A column moved to the second place, others renamed and dropped."""
    c = table(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "meter", "c_mktsegment": "segment", "c_name": "name", "c_acctbal": "yearly"})
    c = c.select("meter", "segment", *[n for n in c.columns if n not in ("meter", "segment")])
    return c.drop(*[n for n in c.columns if n.startswith("c_")])


def _daily(df):
    return df.groupBy("meter_id", F.to_date("ts").alias("date")).agg(F.sum("value").alias("total"), F.max("value").alias("peak"))


def _busy(df, least):
    return df.where(F.col("total") >= least)


@query(with_tables("readings") + """, d AS (SELECT meter_id, CAST(ts AS DATE) AS date, sum(value) AS total, max(value) AS peak FROM readings GROUP BY 1, 2)
SELECT meter_id, date, round(peak / total, 6) AS share, month(date) AS month, dayofweek(date) IN (0, 6) AS weekend FROM d WHERE total >= 60""")
def p23_chained_functions(spark, sf_dir):
    """Table functions one after another, then columns assigned together (P22)."""
    d = readings(spark, sf_dir).transform(_daily).transform(_busy, 60)
    d = d.withColumns({"share": F.round(F.col("peak") / F.col("total"), 6), "month": F.month("date"), "weekend": F.dayofweek("date").isin(1, 7)})
    return d.select("meter_id", "date", "share", "month", "weekend")


@query("SELECT DISTINCT '(''' || o_custkey || ''', ' || year(o_orderdate) || ')' AS flat, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def p28_flat_ids(spark, sf_dir):
    """Pairs of meter and year as one text, and the year read back from it."""
    o = table(spark, sf_dir, "orders")
    flat = F.concat(F.lit("('"), F.col("o_custkey").cast("string"), F.lit("', "), F.year("o_orderdate").cast("string"), F.lit(")"))
    return o.select(flat.alias("flat")).distinct().withColumn("year", F.substring("flat", -5, 4).cast("int"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def o1_sorted(spark, sf_dir):
    """All rows by value downwards, ties by key: dealt by range, then sorted in each part."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query(with_tables("slots") + ", c AS (SELECT profile_id, CAST(slot // 16 AS INT) AS row, slot % 16 AS k, value FROM slots) SELECT profile_id, row, round(sum(value), 6) AS total, round(max(value) FILTER (k = 0), 6) AS first FROM c GROUP BY 1, 2 UNION ALL SELECT profile_id, 4, round(sum(value), 6), round(max(value) FILTER (slot = 0), 6) FROM slots WHERE slot < 16 GROUP BY 1")
def o21_concatenated_arrays(spark, sf_dir):
    """One-, two- and three-dimensional arrays as rows of 16: four pieces of each profile, and once more its first."""
    p = profiles(spark, sf_dir)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("vals", i * 16 + 1, F.lit(16)))
    rows = p.select("profile_id", F.posexplode(F.concat(pieces, F.array(F.slice("vals", 1, 16)))).alias("row", "v"))
    return rows.select("profile_id", "row", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("v")[0], 6).alias("first"))


@query("SELECT CAST(o_orderkey % 7 AS INT) AS chunk, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def o23_chunks(spark, sf_dir):
    """Work dealt into seven chunks by key; each is one group that a task can take (D14: tiles are dealt the same way)."""
    chunk = F.pmod("o_orderkey", F.lit(7)).cast("int").alias("chunk")
    return table(spark, sf_dir, "orders").groupBy(chunk).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query(with_tables("readings") + "SELECT row_id, CASE kind WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE '?' END AS code FROM readings")
def u1_mapped_column(spark, sf_dir):
    """A mapping applied to a column, as an expression."""
    codes = F.create_map(*map(F.lit, ("click", "c", "view", "v")))
    return readings(spark, sf_dir).select("row_id", F.coalesce(F.try_element_at(codes, "kind"), F.lit("?")).alias("code"))


@query(with_tables("meters") + "SELECT meter_id, CASE WHEN yearly < 0 THEN 'feeds in' WHEN location_id = 0 THEN 'home' ELSE lower(segment) END AS kind FROM meters")
def u2_function_of_the_row(spark, sf_dir):
    """A function of several columns of a row."""
    kind = lambda row: F.when(row["yearly"] < 0, "feeds in").when(row["location_id"] == 0, "home").otherwise(F.lower(row["segment"]))
    return meters(spark, sf_dir).withColumn("row", F.struct("yearly", "location_id", "segment")).select("meter_id", kind(F.col("row")).alias("kind"))


@query(with_tables("readings") + ", m AS (SELECT meter_id, median(value) AS m FROM readings GROUP BY 1) SELECT meter_id, round(avg(abs(value - m)), 6) AS spread FROM readings JOIN m USING (meter_id) GROUP BY 1")
def u3_own_aggregate(spark, sf_dir):
    """An aggregate of one's own, from built-in ones: the mean distance from the median."""
    r = readings(spark, sf_dir)
    middle = r.groupBy("meter_id").agg(F.median("value").alias("m"))
    return r.join(middle, "meter_id").groupBy("meter_id").agg(F.round(F.avg(F.abs(F.col("value") - F.col("m"))), 6).alias("spread"))


def _detrended(pdf: pd.DataFrame) -> pd.DataFrame:
    x, y = pdf["row_id"].to_numpy(float), pdf["value"].to_numpy(float)
    gap = x - x.mean()
    slope = gap @ (y - y.mean()) / (gap @ gap) if len(x) > 1 else 0.0
    return pd.DataFrame({"row_id": pdf["row_id"], "rest": np.round(y - y.mean() - slope * gap, 5)})


@query(with_tables("readings") + """, f AS (SELECT meter_id, avg(row_id) AS mx, avg(value) AS my, coalesce(covar_pop(value, row_id) / nullif(var_pop(row_id), 0), 0) AS b FROM readings GROUP BY 1)
SELECT row_id, round(value - my - b * (row_id - mx), 5) AS rest FROM readings JOIN f USING (meter_id)""")
def u4_function_per_group(spark, sf_dir):
    """A table function applied to each meter's readings, which are as many as its hours: values less their own trend."""
    return readings(spark, sf_dir).select("meter_id", "row_id", "value").groupBy("meter_id").applyInPandas(_detrended, "row_id bigint, rest double")


@query("SELECT o_orderkey, CAST(k AS INT) AS day, CAST(o_orderdate AS DATE) + CAST(k AS INT) AS date FROM orders, (SELECT unnest(range(5)) AS k) WHERE k <= o_orderkey % 5")
def u5_rows_from_a_row(spark, sf_dir):
    """One row becomes as many as it asks for."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 5).cast("int"))).alias("day"))
    return o.select("o_orderkey", "day", F.date_add("d", F.col("day")).alias("date"))


_D = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(with_tables("profiles") + ", p AS (SELECT q.profile_id AS query, o.profile_id AS other, sqrt(" + _D.format(a="q.vals", b="o.vals") + ") AS e, " + _D.format(a="list_sort(q.vals)", b="list_sort(o.vals)") + """ / len(q.vals) AS w FROM profiles q JOIN profiles o ON o.profile_id <> q.profile_id WHERE q.profile_id % 20 = 0)
SELECT 'euclidean' AS metric, query, arg_min(other, (round(e, 9), other)) AS nearest FROM p GROUP BY 2 UNION ALL SELECT 'wasserstein', query, arg_min(other, (round(w, 9), other)) FROM p GROUP BY 2""")
def u6_metrics_by_name(spark, sf_dir):
    """The nearest profile to each query profile (ids divisible by 20) by two metrics chosen by name (U8)."""
    p = profiles(spark, sf_dir)
    found = (strategies.nearest_by(p, p.where("profile_id % 20 = 0"), "profile_id", "vals", m, 1).select(F.lit(m).alias("metric"), "query", F.col("other").alias("nearest")) for m in ("euclidean", "wasserstein"))
    return reduce(DataFrame.unionByName, found)


@query()
def u7_estimators_by_name(spark, sf_dir):
    """(method, clusters, rows): labels and centres of two clusterings behind one interface."""
    p = profiles(spark, sf_dir).withColumn("vals", fold(F.col("vals"), 16))
    out = []
    for name, fit in strategies.ESTIMATORS.items():
        found = fit(p, "profile_id", "vals", 4)
        out.append(found.labels.join(found.centers, "cluster").agg(F.lit(name).alias("method"), F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("rows")))
    return reduce(DataFrame.unionByName, out)


@query(with_tables("readings") + """, t AS (SELECT meter_id, sum(value) AS t FROM readings GROUP BY 1 HAVING sum(value) <= 3200) SELECT row_id, round(value / t, 6) AS share FROM readings JOIN t USING (meter_id) WHERE t <> 0""")
def u9_built_step_by_step(spark, sf_dir):
    """A preprocessing built step by step and then applied."""
    steps = strategies.Preprocessing("meter_id", "value").clip().at_most(3200.0).as_share()
    return steps.apply(readings(spark, sf_dir)).where("value is not null").select("row_id", F.round("value", 6).alias("share"))
