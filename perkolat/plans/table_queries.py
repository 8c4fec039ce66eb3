"""Queries on aggregates, statistics and keyed records."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkolat.functions import columns as C
from perkolat.operators import records, stats

from .base import NETWORKS, R, query


@query(f"SELECT o_orderpriority, count(o_totalprice) AS n, {R('avg(o_totalprice)')} AS mean, {R('avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*))')} AS ci_low, {R('avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(*))')} AS ci_high FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def mean_ci95(t):
    return t.orders.where("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(*C.mean_ci(F.col("o_totalprice")))


@query(f"WITH c AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT o_orderpriority, count(*) AS customers, {R('avg(v)')} AS mean FROM c GROUP BY 1")
def two_level_mean(t):
    c = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    return c.groupBy("o_orderpriority").agg(F.count("*").alias("customers"), F.avg("v").alias("mean"))


@query(f"SELECT l_returnflag, {R('sum(l_extendedprice) / greatest(sum(l_quantity), 1)')} AS price_per_unit FROM lineitem GROUP BY 1")
def ratio_of_sums(t):
    return t.lineitem.groupBy("l_returnflag").agg(C.ratio_of_sums(F.col("l_extendedprice"), F.col("l_quantity")).alias("price_per_unit"))


@query(f"SELECT event_type, count(*) AS n, count(value) AS present, {R('sum(CASE WHEN value > 0.5 THEN 1 ELSE 0 END) / count(*)')} AS share FROM events GROUP BY 1")
def boolean_share(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("present"), C.share(F.col("value") > 0.5).alias("share"))


@query(f"SELECT l_returnflag, {R('avg(l_quantity) FILTER (l_linestatus = ' + chr(39) + 'F' + chr(39) + ')')} AS quantity_f, {R('avg(l_quantity) FILTER (l_linestatus = ' + chr(39) + 'O' + chr(39) + ')')} AS quantity_o FROM lineitem GROUP BY 1")
def pivot_mean(t):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity")).withColumnsRenamed({"F": "quantity_f", "O": "quantity_o"})


LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


def latest_events(t):
    return records.latest(t.events, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])


@query(f"SELECT user_id, event_type, event_id, {R('value')} AS value FROM ({LATEST})")
def latest_per_key(t):
    return latest_events(t).select("user_id", "event_type", "event_id", "value")


@query(f"""SELECT user_id, {R("max(value) FILTER (event_type = 'click')")} AS click, {R("max(value) FILTER (event_type = 'purchase')")} AS purchase, {R("max(value) FILTER (event_type = 'view')")} AS view FROM ({LATEST}) GROUP BY user_id""")
def pivot_first_latest(t):
    kinds = ["click", "purchase", "view"]
    return latest_events(t).groupBy("user_id").pivot("event_type", kinds).agg(F.first("value")).select("user_id", *kinds)


@query(f"SELECT p_brand, p_partkey, {R('p_retailprice')} AS p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def best_per_group(t):
    return records.latest(t.part, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")]).select("p_brand", "p_partkey", "p_retailprice")


RANKS = "SELECT *, rank() OVER (PARTITION BY {g} ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2 AS rx, rank() OVER (PARTITION BY {g} ORDER BY {y}) + (count(*) OVER (PARTITION BY {g}, {y}) - 1) / 2 AS ry FROM {t}"


@query(f"SELECT l_returnflag, count(*) AS n, {R('corr(l_quantity, l_extendedprice)')} AS r FROM lineitem GROUP BY 1")
def pearson(t):
    return stats.pearson(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")


@query(f"""WITH {NETWORKS}, c AS (SELECT domain, count(*) AS n, corr(pc_obs, mean_degree) AS r FROM nets GROUP BY 1), th AS (SELECT c.*, asin(abs(r)) + (pi() / 2 - asin(abs(r))) * (i + 0.5) / 20000 AS t, pi() / 2 * (i + 0.5) / 20000 AS u FROM c, (SELECT unnest(range(20000)) AS i))
SELECT domain, n, {R('r')} AS r, {R('CASE WHEN n > 2 THEN sum(pow(cos(t), n - 3)) * (pi() / 2 - asin(abs(r))) / (sum(pow(cos(u), n - 3)) * pi() / 2) END')} AS p FROM th GROUP BY domain, n, r""")
def pearson_p(t):
    return stats.correlation_p(stats.pearson(t.networks(), ["domain"], "pc_obs", "mean_degree"), "r")


@query(f"SELECT o_orderpriority, count(*) AS n, {R('corr(rx, ry)')} AS rho FROM ({RANKS.format(g='o_orderpriority', x='o_totalprice', y='o_custkey', t='orders')}) GROUP BY 1")
def spearman(t):
    return stats.spearman(t.orders, ["o_orderpriority"], "o_totalprice", "o_custkey")


@query(f"""WITH {NETWORKS}, q AS (SELECT u.domain, count(*) / 2 AS n0, sum(sign(u.pc_obs - v.pc_obs) * sign(u.mean_degree - v.mean_degree)) / 2 AS s, sum((u.pc_obs = v.pc_obs)::INT) / 2 AS tx, sum((u.mean_degree = v.mean_degree)::INT) / 2 AS ty FROM nets u JOIN nets v ON u.domain = v.domain AND u.city <> v.city GROUP BY 1)
SELECT domain, count(*) AS n, {R('max(s / sqrt((n0 - tx) * (n0 - ty)))')} AS tau FROM nets LEFT JOIN q USING (domain) GROUP BY domain""")
def kendall(t):
    return stats.kendall(t.networks(), ["domain"], "pc_obs", "mean_degree")


@query(f"""WITH r AS (SELECT o_orderstatus, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2 AS x, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2 AS y,
rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_orderkey) - 1) / 2 AS z FROM orders), g AS (SELECT o_orderstatus, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r GROUP BY 1)
SELECT o_orderstatus, n, {R('(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))')} AS rho FROM g""")
def partial_spearman(t):
    return stats.partial_spearman(t.orders, ["o_orderstatus"], "o_totalprice", "o_custkey", "o_orderkey")


@query(f"SELECT l_linestatus, count(*) AS n, {R('regr_slope(l_extendedprice, l_quantity)')} AS slope, {R('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, {R('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem GROUP BY 1")
def ols_line(t):
    return stats.ols(t.lineitem, ["l_linestatus"], "l_quantity", "l_extendedprice")


@query(f"WITH {NETWORKS} SELECT domain, {R('1 - sum(pow(pc_derived - pc_obs, 2)) / nullif(var_pop(pc_obs) * count(*), 0)')} AS r2, {R('avg(abs(pc_derived - pc_obs))')} AS mae, {R('sqrt(avg(pow(pc_derived - pc_obs, 2)))')} AS rmse, {R('avg(pc_derived - pc_obs)')} AS bias FROM nets GROUP BY 1")
def r2_mae_rmse(t):
    return stats.fit_metrics(t.networks(), ["domain"], "pc_obs", "pc_derived")


@query(f"""WITH {NETWORKS}, o AS (SELECT g.domain, regr_slope(v.pc_obs, v.pc_derived) AS s, regr_intercept(v.pc_obs, v.pc_derived) AS i FROM (SELECT DISTINCT domain FROM nets) g JOIN nets v ON v.domain <> g.domain GROUP BY 1)
SELECT city, {R('s * pc_derived + i')} AS pred FROM nets JOIN o USING (domain)""")
def leave_group_out_ols(t):
    return stats.leave_group_out(t.networks(), "domain", "pc_derived", "pc_obs").select("city", "pred")


@query("WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part) SELECT p_partkey, CASE WHEN p_retailprice <= a THEN 1 WHEN p_retailprice <= b THEN 2 WHEN p_retailprice <= c THEN 3 ELSE 4 END AS band FROM part, q")
def quartile_bands(t):
    return stats.quartile_bands(t.part.select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "band")


@query(f"""WITH s AS (SELECT avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2 FROM customer)
SELECT c_custkey, {R('(c_acctbal - m1) / s1 - (c_nationkey - m2) / s2')} AS index FROM customer, s""")
def composite_zindex(t):
    return stats.z_index(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal"], ["c_nationkey"]).select("c_custkey", "index")


@query(f"""WITH h AS (SELECT l_extendedprice AS v, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1)
SELECT {R('max(abs(x - y))')} AS ks FROM (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS x, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS y FROM h)""")
def ks_distance(t):
    return stats.ks(t.lineitem, "l_returnflag", "l_extendedprice", "A", "R")


EDGE = ", ".join(str(i / 8) for i in range(1, 8))


@query(f"""WITH q AS (SELECT quantile_cont(l_extendedprice, [{EDGE}]) AS q FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_returnflag, len(list_filter(q, lambda e: e <= l_extendedprice)) AS bin FROM lineitem, q WHERE l_returnflag IN ('A', 'N')),
n AS (SELECT bin, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS b FROM b GROUP BY 1)
SELECT {R('sum(abs(x - y)) / 2')} AS tvd FROM (SELECT a / sum(a) OVER () AS x, b / sum(b) OVER () AS y FROM n)""")
def length_bin_tvd_fixed(t):
    return stats.length_bin_tvd(t.lineitem, "l_returnflag", "l_extendedprice", "A", "N")


@query(f"""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [{EDGE}]) AS q FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1),
b AS (SELECT l_returnflag, len(list_filter(q, lambda e: e <= l_extendedprice)) AS bin FROM lineitem JOIN q USING (l_returnflag)),
n AS (SELECT bin, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS b FROM b GROUP BY 1)
SELECT {R('sum(abs(x - y)) / 2')} AS tvd FROM (SELECT a / sum(a) OVER () AS x, b / sum(b) OVER () AS y FROM n)""")
def length_bin_tvd_rebinned(t):
    return stats.length_bin_tvd(t.lineitem, "l_returnflag", "l_extendedprice", "A", "N", rebinned=True)


@query(f"""WITH o AS (SELECT c_mktsegment AS g, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i FROM customer), s AS (SELECT g, count(*) AS n FROM o GROUP BY 1),
dr AS (SELECT g, n, rep, unnest(range(1, n + 1)) AS j FROM s, (SELECT unnest(range(1, 101)) AS rep)),
m AS (SELECT dr.g, rep, avg(v) AS mean FROM dr JOIN o ON o.g = dr.g AND o.i = ('0x' || substr(md5('9|' || dr.g || '|' || rep || '|' || j), 1, 12))::BIGINT % n GROUP BY ALL)
SELECT g AS c_mktsegment, {R('(SELECT avg(v) FROM o WHERE o.g = m.g)')} AS mean, {R('quantile_cont(mean, 0.025)')} AS ci_low, {R('quantile_cont(mean, 0.975)')} AS ci_high FROM m GROUP BY g""")
def bootstrap_mean_ci(t):
    return stats.bootstrap_mean(t.customer, ["c_mktsegment"], "c_acctbal", "c_custkey", 100, 9)


@query("SELECT o_custkey, o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_anti_join(t):
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.pending(t.orders.select("o_custkey", "o_orderkey"), done, ["o_orderkey"])


@query("SELECT c_nationkey AS nationkey, c_name AS name, NULL::VARCHAR AS extra FROM customer UNION ALL SELECT s_nationkey, s_name, 'supplier' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AND s_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def append_unique(t):
    old = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"))
    new = t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"), F.lit("supplier").alias("extra"))
    return records.append_unique(old, new, ["nationkey"])


@query(f"""WITH o AS (SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer), n AS (SELECT o_custkey AS k, sum(o_totalprice) AS bal, 'ordered' AS seg FROM orders GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, {R('CASE WHEN n.k IS NOT NULL THEN n.bal ELSE o.bal END')} AS bal, CASE WHEN n.k IS NOT NULL THEN n.seg ELSE o.seg END AS seg FROM o FULL JOIN n ON o.k = n.k""")
def manifest_upsert(t):
    old = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    new = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("bal"), F.lit("ordered").alias("seg"))
    return records.upsert(old, new, "k", ["bal", "seg"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS data_type, count(*) AS n_rows, count({c}) AS non_null, substr(min_by({c}::VARCHAR, p_partkey) FILTER ({c} IS NOT NULL), 1, 80) AS example FROM part" for c, k in (("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"))))
def column_dictionary(t):
    df = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return records.column_dictionary(df, F.col("p_partkey")).select("column_name", "data_type", "n_rows", "non_null", "example")


@query("""WITH p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS feature, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part),
d AS (SELECT p_partkey, trim(feature) AS feature, min(i) AS i FROM p WHERE trim(feature) <> '' GROUP BY ALL)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY i))::INT AS place, feature FROM d""")
def feature_list_explode(t):
    return records.feature_list(t.part, ["p_partkey"], "p_name", " ")


NAMES = """SELECT 'Zürich–Öst, Greater-City of ' || n_name || ' Área (Préfecture)' AS raw FROM nation UNION SELECT c_mktsegment FROM customer"""


@query(f"""SELECT raw, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(raw)), '[,._/\\-()''’]', ' ', 'g'),
'\\b(city|municipality|metropolitan|area|greater|province|prefecture|district)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS name, trim(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM ({NAMES})""")
def name_normalise(t):
    raw = t.nation.select(F.concat(F.lit("Zürich–Öst, Greater-City of "), "n_name", F.lit(" Área (Préfecture)")).alias("raw")).unionByName(t.customer.select(F.col("c_mktsegment").alias("raw"))).distinct()
    return raw.select("raw", C.normalised_name(F.col("raw")).alias("name"), C.slug(F.col("raw")).alias("slug"))


@query("SELECT n_name, list_sum(list_transform(range(1, len(n_name) + 1), lambda i: i * unicode(lower(n_name)[i])))::BIGINT AS seed FROM nation")
def position_seed(t):
    return t.nation.select("n_name", C.position_seed(F.col("n_name")).alias("seed"))


@query(f"""WITH s AS (SELECT l_returnflag AS g, l_linestatus AS class, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), p AS (SELECT g, q / sum(q) OVER (PARTITION BY g) AS p, count(*) OVER (PARTITION BY g) AS k FROM s)
SELECT g, {R('CASE WHEN max(k) > 1 THEN sum(-p * ln(p)) / ln(max(k)) ELSE 0 END')} AS entropy, {R('max(p)')} AS dominance FROM p GROUP BY g""")
def category_entropy(t):
    from pyspark.sql import Window

    w = Window.partitionBy("g")
    s = t.lineitem.groupBy(F.col("l_returnflag").alias("g"), "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    p = s.select("g", (F.col("q") / F.sum("q").over(w)).alias("p"), F.count("*").over(w).alias("k"))
    return p.groupBy("g").agg(F.when(F.max("k") > 1, F.sum(-F.col("p") * F.log("p")) / F.log(F.max("k"))).otherwise(0.0).alias("entropy"), F.max("p").alias("dominance"))
