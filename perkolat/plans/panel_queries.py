"""Queries on panels, checked joins, guards, resampling and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkolat.functions import columns as C
from perkolat.operators import matching, panels, resampling, stats

from .base import NETWORKS, R, query


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {R('arg_min(l_extendedprice, l_orderkey * 100 + l_linenumber)')} AS first, {R('avg(l_extendedprice)')} AS mean, {R('stddev_samp(l_extendedprice)')} AS sd, {R('min(l_extendedprice)')} AS least, {R('max(l_extendedprice)')} AS greatest, round(sum(l_extendedprice), 2) + 0.0 AS total FROM lineitem GROUP BY ALL")
def replicate_rollup(t):
    out = panels.rolled_up(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", F.struct("l_orderkey", "l_linenumber"))
    return out.withColumn("total", F.round("total", 2) + 0.0)


@query("SELECT p_brand, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes, count(*) AS n FROM part GROUP BY 1")
def distinct_counts(t):
    return t.part.groupBy("p_brand").agg(F.count_distinct("p_type").alias("types"), F.count_distinct("p_size").alias("sizes"), F.count("*").alias("n"))


@query(f"SELECT p_brand, {R('min(p_retailprice)')} AS least, {R('quantile_cont(p_retailprice, 0.5)')} AS median, {R('avg(p_retailprice)')} AS mean, {R('max(p_retailprice)')} AS greatest FROM part GROUP BY 1")
def distribution_summary(t):
    return panels.summary(t.part, ["p_brand"], "p_retailprice")


METRICS = ["l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT l_linestatus, '{m}' AS metric, {R(f'avg({m}) FILTER (l_returnflag = ' + chr(39) + 'N' + chr(39) + f') - avg({m}) FILTER (l_returnflag = ' + chr(39) + 'A' + chr(39) + ')')} AS delta, {R(f'abs(avg({m}) FILTER (l_returnflag = ' + chr(39) + 'N' + chr(39) + f') - avg({m}) FILTER (l_returnflag = ' + chr(39) + 'A' + chr(39) + '))')} AS size FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1" for m in METRICS))
def delta_audit(t):
    return panels.delta_audit(t.lineitem, ["l_linestatus"], "l_returnflag", "A", "N", METRICS)


@query(f"SELECT * FROM (SELECT l_partkey, {R('max(l_tax) FILTER (l_returnflag = ' + chr(39) + 'A' + chr(39) + ')')} AS one, {R('max(l_tax) FILTER (l_returnflag = ' + chr(39) + 'R' + chr(39) + ')')} AS two, {R('max(l_tax) FILTER (l_returnflag = ' + chr(39) + 'A' + chr(39) + ') - max(l_tax) FILTER (l_returnflag = ' + chr(39) + 'R' + chr(39) + ')')} AS difference FROM lineitem GROUP BY 1) WHERE one IS NOT NULL AND two IS NOT NULL")
def paired_conditions(t):
    return panels.paired(t.lineitem, ["l_partkey"], "l_returnflag", "A", "R", "l_tax")


@query(f"WITH {NETWORKS} " + " UNION ALL ".join(f"SELECT city, '{v}' AS variable, {R(v)} AS value FROM nets WHERE {v} IS NOT NULL" for v in ("pc_obs", "pc_cebh", "pc_derived")))
def long_panel(t):
    return panels.long_panel(t.networks(), ["city"], ["pc_obs", "pc_cebh", "pc_derived"])


@query(f"SELECT user_id, arg_min(event_type, event_id) AS event_type, {R('arg_min(value, event_id) FILTER (value IS NOT NULL)')} AS value FROM events GROUP BY 1")
def first_present(t):
    return panels.first_present(t.events, ["user_id"], F.col("event_id"), ["event_type", "value"])


@query(f"SELECT o_orderkey, c_mktsegment, {R('c_acctbal')} AS c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def many_to_one_join(t):
    right = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return panels.many_to_one(t.orders.select("o_orderkey", "o_custkey"), right, ["o_custkey"]).select("o_orderkey", "c_mktsegment", "c_acctbal")


@query("SELECT c_nationkey AS key, c_name AS name_x, n_name AS name_y, c_custkey AS id FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def name_collision_join(t):
    left = t.customer.select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return panels.suffixed_join(left, t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), ["key"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(DISTINCT {c}) AS distinct, count({c}) >= 20 AND count(DISTINCT {c}) >= 3 AS admissible FROM lineitem" for c in ("l_quantity", "l_tax", "l_linestatus", "l_returnflag")).replace("AS distinct", 'AS "distinct"'))
def feature_admissibility(t):
    return panels.admissible(t.lineitem, ["l_quantity", "l_tax", "l_linestatus", "l_returnflag"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE regexp_matches(o_orderpriority, 'URGENT|HIGH|LOW') GROUP BY 1")
def status_regex(t):
    return t.orders.where(F.col("o_orderpriority").rlike("URGENT|HIGH|LOW")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_linestatus, count(*) FILTER (abs(l_discount - 0.05) <= 1e-8 + 1e-5 * 0.05) AS close, count(*) AS n FROM lineitem GROUP BY 1")
def tolerance_equality(t):
    return t.lineitem.groupBy("l_linestatus").agg(F.count_if(C.is_close(F.col("l_discount"), F.lit(0.05))).alias("close"), F.count("*").alias("n"))


@query(f"SELECT p_partkey, {R('CASE WHEN abs(p_size - 25) >= 1e-12 THEN p_retailprice / (p_size - 25) END')} AS safe, {R('CASE WHEN p_size - 25 <> 0 THEN p_retailprice / (p_size - 25) END')} AS if_set, {R('CASE WHEN p_size - 25 > 0 THEN p_retailprice / (p_size - 25) END')} AS if_positive FROM part")
def guarded_division(t):
    a, b = F.col("p_retailprice"), (F.col("p_size") - 25).cast("double")
    return t.part.select("p_partkey", C.safe_divide(a, b).alias("safe"), C.divided_if_set(a, b).alias("if_set"), C.divided_if_positive(a, b).alias("if_positive"))


@query(f"SELECT c_custkey, {R('CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END')} AS log_balance, {R('least(greatest(c_acctbal, 0), 5000)')} AS clipped FROM customer")
def log_clip(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", C.log10_positive(b).alias("log_balance"), C.clipped(b, 0.0, 5000.0).alias("clipped"))


@query(f"""WITH {NETWORKS}, v AS (SELECT city, abs(pc_cebh - pc_obs) AS e1, abs(pc_derived - pc_obs) AS e2 FROM nets)
SELECT city, CASE WHEN e2 < 0.5 * e1 THEN 'strong' WHEN e2 < e1 THEN 'moderate' ELSE 'none' END AS verdict FROM v""")
def verdicts(t):
    e1, e2 = F.abs(F.col("pc_cebh") - F.col("pc_obs")), F.abs(F.col("pc_derived") - F.col("pc_obs"))
    return t.networks().select("city", F.when(e2 < 0.5 * e1, "strong").when(e2 < e1, "moderate").otherwise("none").alias("verdict"))


@query("SELECT o_orderpriority, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderpriority)::INT AS place FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def enumerated_order(t):
    return panels.enumerated(t.orders.select("o_orderpriority").distinct(), "o_orderpriority", ["5-LOW", "1-URGENT"], ["o_orderpriority"])


RANKED = ", ".join(f"rank() OVER (PARTITION BY domain ORDER BY {c}) + (count(*) OVER (PARTITION BY domain, {c}) - 1) / 2 AS r_{c}" for c in ("pc_obs", "pc_cebh", "pc_derived"))


@query(f"WITH {NETWORKS}, r AS (SELECT domain, {RANKED} FROM nets) SELECT domain, count(*) AS n, {R('CASE WHEN stddev_pop(r_pc_cebh) > 0 THEN corr(r_pc_obs, r_pc_cebh) END')} AS cebh, {R('CASE WHEN stddev_pop(r_pc_derived) > 0 THEN corr(r_pc_obs, r_pc_derived) END')} AS derived FROM r GROUP BY 1")
def rank_fidelity(t):
    r = t.networks()
    for c in ("pc_obs", "pc_cebh", "pc_derived"):
        r = stats.ranked(r, ["domain"], c, f"r_{c}")
    of = lambda c: F.when(F.stddev_pop(f"r_{c}") > 0, F.corr("r_pc_obs", f"r_{c}"))
    return r.groupBy("domain").agg(F.count("*").alias("n"), of("pc_cebh").alias("cebh"), of("pc_derived").alias("derived"))


@query(f"WITH {NETWORKS}, o AS (SELECT avg(pc_cebh - pc_obs) AS offset_ FROM nets) SELECT domain, {R('avg(abs(pc_cebh - pc_obs))')} AS before, {R('avg(abs(pc_cebh - offset_ - pc_obs))')} AS after FROM nets, o GROUP BY 1")
def offset_correction(t):
    n = t.networks()
    o = n.agg(F.avg(F.col("pc_cebh") - F.col("pc_obs")).alias("offset"))
    e = F.col("pc_cebh") - F.col("pc_obs")
    return n.join(F.broadcast(o)).groupBy("domain").agg(F.avg(F.abs(e)).alias("before"), F.avg(F.abs(e - F.col("offset"))).alias("after"))  # one row


PERMUTED = f"""WITH {NETWORKS}, ea AS (SELECT rep, city AS key, pc_obs AS x, mean_degree AS y FROM nets, (SELECT unnest(range(1, 101)) AS rep)),
a AS (SELECT rep, x, row_number() OVER (PARTITION BY rep ORDER BY key) AS i FROM ea), b AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY md5('7|' || rep || '|' || key), key) AS i FROM ea),
pm AS (SELECT rep, x, y FROM a JOIN b USING (rep, i))"""


@query(f"{PERMUTED}, d AS (SELECT corr(x, y) AS rs FROM pm GROUP BY rep), r AS (SELECT corr(pc_obs, mean_degree) AS r FROM nets) SELECT {R('max(r)')} AS r, {R('avg((round(abs(rs), 9) >= round(abs(r), 9))::INT)')} AS p FROM d, r")
def permutation_p(t):
    return resampling.permutation_p(t.networks(), "city", "pc_obs", "mean_degree", 100, 7)


@query(f"{PERMUTED}, d AS (SELECT regr_r2(y, x) AS rs FROM pm GROUP BY rep), r AS (SELECT regr_r2(mean_degree, pc_obs) AS r2 FROM nets) SELECT {R('max(r2)')} AS r2, {R('avg(rs)')} AS mean_r2, {R('(sum((round(rs, 9) >= round(r2, 9))::INT) + 1) / (count(*) + 1)')} AS p FROM d, r")
def permutation_baseline(t):
    return resampling.permutation_baseline(t.networks(), "city", "pc_obs", "mean_degree", 100, 7)


@query(f"""WITH {NETWORKS}, o AS (SELECT pc_obs AS x, kappa AS y, row_number() OVER (ORDER BY city) - 1 AS i, count(*) OVER () AS n FROM nets),
dr AS (SELECT rep, ('0x' || substr(md5('3|' || rep || '|' || j), 1, 12))::BIGINT % n AS i FROM (SELECT max(n) AS n FROM o), (SELECT unnest(range(1, 201)) AS rep), (SELECT unnest(range(1, (SELECT max(n) FROM o) + 1)) AS j)),
b AS (SELECT rep, x, y, rank() OVER (PARTITION BY rep ORDER BY x) + (count(*) OVER (PARTITION BY rep, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY rep ORDER BY y) + (count(*) OVER (PARTITION BY rep, y) - 1) / 2 AS ry FROM dr JOIN o USING (i)),
c AS (SELECT corr(rx, ry) AS rho FROM b GROUP BY rep HAVING count(DISTINCT x) > 2 AND count(DISTINCT y) > 2) SELECT count(*) AS reps, {R('quantile_cont(rho, 0.025)')} AS ci_low, {R('quantile_cont(rho, 0.975)')} AS ci_high FROM c""")
def bootstrap_spearman(t):
    return resampling.bootstrap_spearman(t.networks(), "city", "pc_obs", "kappa", 200, 3)


@query(f"""WITH f AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y, ('0x' || substr(md5('2|' || p_partkey), 1, 8))::BIGINT % 5 AS fold FROM part),
l AS (SELECT g.fold, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM (SELECT DISTINCT fold FROM f) g JOIN f ON f.fold <> g.fold GROUP BY 1) SELECT p_partkey, fold, {R('s * x + i')} AS pred FROM f JOIN l USING (fold)""")
def kfold_line(t):
    own = t.part.select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return resampling.kfold_line(own, "p_partkey", "x", "y", 5, 2).select("p_partkey", "fold", "pred")


@query(f"""WITH m AS (SELECT l_returnflag, var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m) SELECT l_returnflag, round(my - b1 * m1 - b2 * m2, 4) + 0.0 AS b0, round(b1, 4) + 0.0 AS b1, round(b2, 4) + 0.0 AS b2 FROM b""")
def ols_plane(t):
    out = resampling.plane(t.lineitem, ["l_returnflag"], "l_quantity", "l_discount", "l_extendedprice")
    return out.select("l_returnflag", *[(F.round(c, 4) + 0.0).alias(c) for c in ("b0", "b1", "b2")])


@query()
def blocked_name_match(t):
    """Customers' names against suppliers' of their nation, with balances for coordinates; no SQL has the similarity."""
    place = lambda df, p, key: df.select(F.col(key), F.col(f"{p}_nationkey").alias("block"), F.col(f"{p}_name").alias("name"), (F.col(f"{p}_acctbal") % 180).alias("lon"), (F.col(f"{p}_acctbal") % 80).alias("lat"))
    return matching.blocked_name_match(place(t.customer, "c", "c_custkey").withColumnRenamed("c_custkey", "id"), place(t.supplier, "s", "s_suppkey").withColumnRenamed("s_suppkey", "centre"))
