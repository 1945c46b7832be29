"""Queries of samplers, label rules and gates that stand alone, each with the SQL that another engine checks it by."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, graph, labels, meta, normalize, sampling
from .queries import EST, NODE, PANEL_Z, C, cells, counts, dl_sql, estimable, graph_sql, h, is_a, knn, panels, query, scores, table

# Pooling


@query(f"select k, delta, case when k < 5 then 'INSUFFICIENT_PATIENTS' when delta > 0 and z > 1.6448536269514722 then 'SUPPORTED' else 'NOT_SUPPORTED' end as status, case when k >= 5 then delta > 0 and z > 1.6448536269514722 end as supported from ({dl_sql(f'select 1 as one, delta, se from ({EST})', 'one')})", "k *delta status supported")
def pooled_decision(spark, sf_dir):
    return meta.protocol_decision(meta.with_tails(meta.dersimonian_laird(estimable(spark, sf_dir)))).select("k", "delta", "status", "supported")


@query("""
with r as (select value, event_type = 'purchase' as arm, row_number() over (partition by event_type = 'purchase' order by event_id) - 1 as i, count(*) over (partition by event_type = 'purchase') as n from events where event_type in ('purchase', 'view') and value is not null),
d as (select b.range as replicate, r.arm, cast('0x' || substr(md5('0:bootstrap-cliff:' || b.range || ':' || cast(r.arm as varchar) || ':' || r.i), 1, 8) as bigint) % r.n as at from range(50) b cross join r),
x as (select replicate, d.arm, r.value from d join r on r.arm = d.arm and r.i = d.at),
k as (select replicate, arm, rank() over (partition by replicate order by value) + (count(*) over (partition by replicate, value) - 1) / 2.0 as rk from x),
u as (select replicate, 2 * (sum(rk) filter (where arm) - count(*) filter (where arm) * (count(*) filter (where arm) + 1) / 2.0) / (count(*) filter (where arm) * count(*) filter (where not arm)) - 1 as delta from k group by replicate)
select count(*) as b, avg(delta) as mean, quantile_cont(delta, 0.025) as ci_lo, quantile_cont(delta, 0.975) as ci_hi from u
""", "b *mean *ci_lo *ci_hi")
def bootstrap_cliff_interval(spark, sf_dir):
    rows = scores(spark, sf_dir)
    return meta.interval(meta.bootstrap_cliff(rows, "event_id", "value", is_a(), 50))


# Samplers


@query(f"select u, v, weight from {graph_sql(15)} order by {h('edges', 'u || chr(58) || v')}, u, v limit 400", "u v *weight")
def edge_sample(spark, sf_dir):
    return sampling.sampled_edges(knn(spark, sf_dir, 15), 400)


@query("""
with d as (select vec_id, j.range + 1 as axis, (cast('0x' || substr(md5('0:null-1:' || vec_id || ':' || (j.range + 1)), 1, 13) as bigint) + 0.5) / 4503599627370496 as a, (cast('0x' || substr(md5('0:null-2:' || vec_id || ':' || (j.range + 1)), 1, 13) as bigint) + 0.5) / 4503599627370496 as b from embeddings cross join range(4) j)
select vec_id, axis, sqrt(-2 * ln(a)) * cos(2 * pi() * b) as x from d
""", "vec_id axis *x")
def gaussian_null(spark, sf_dir):
    e = sampling.gaussian_null(cells(spark, sf_dir), "vec_id", 4)
    return e.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", (F.col("i") + 1).alias("axis"), "x")


@query(f"""
with m as (select p_partkey as gene, p_retailprice as level from part), k as (select p_partkey as gene from part where p_size = 7), q as (select quantile_cont(level, [i / 25.0 for i in range(1, 25)]) as e from m),
b as (select gene, len(list_filter(e, lambda x: x <= level)) as bin from m, q),
r as (select gene, bin, row_number() over (partition by bin order by {h('controls', 'gene')}, gene) as r from b where gene not in (select gene from k) and bin in (select bin from b join k using (gene)))
select gene, bin from r where r <= 20
""", "gene bin")
def control_genes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("level"), "p_size")
    return sampling.control_genes(p, "gene", "level", p.where("p_size = 7").select("gene"), per_bin=20)


@query("select distinct o_custkey as barcode from orders where o_custkey not in (select s_suppkey from supplier) and o_custkey not in (select c_custkey from customer where c_acctbal < 0)", "barcode")
def barcode_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("barcode")).distinct()
    rest = labels.without_specimens(o, "barcode", table(spark, sf_dir, "supplier").select("s_suppkey"))
    return labels.without_specimens(rest, "barcode", table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey"))


# Counts and embeddings


@query(f"select c.cell, c.gene, ln(1 + c.value * 10000.0 / greatest(l.l, 1)) as value from {C} c join (select cell, sum(value) as l from {C} group by cell) l using (cell)", "cell gene *value")
def log_cp10k(spark, sf_dir):
    return normalize.log_normalised_lenient(counts(spark, sf_dir))


@query("""
with l as (select vec_id, unnest(range(1, len(embedding) + 1)) as axis, unnest(embedding) as x from embeddings), s as (select axis, avg(cast(x as double)) as m, stddev_pop(cast(x as double)) as sd from l group by axis)
select vec_id, axis, coalesce((x - m) / nullif(sd, 0), 0) as z from l join s using (axis)
""", "vec_id axis *z")
def standardised_axes(spark, sf_dir):
    e = normalize.standardised_axes(cells(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id", "embedding")
    return e.select("vec_id", F.posexplode("embedding").alias("i", "z")).select("vec_id", (F.col("i") + 1).alias("axis"), "z")


# Labels


CLUSTER_SCORES = PANEL_Z + "k as (select cell % 11 as cluster, panel, avg(score) as score from g group by all)"


@query(f"{CLUSTER_SCORES} select cluster, panel, score from k", "cluster panel *score")
def cluster_panels(spark, sf_dir):
    return _cluster_scores(spark, sf_dir)


def _cluster_scores(spark, sf_dir):
    v = normalize.log_normalised(counts(spark, sf_dir), 1e6, 5)
    one = v.select("cell").distinct()
    return labels.cluster_panel_scores(labels.panel_means(v, panels(spark, sf_dir), one), one.withColumn("cluster", F.col("cell") % 11))


@query(f"{CLUSTER_SCORES}, a as (select cluster, max(score) filter (where panel in ('alpha', 'beta')) as i, max(score) filter (where panel = 'gamma') as o from k group by cluster) select cluster, case when cluster = 3 then 'fixed' when i - o >= 0.1 then 'immune' else 'other' end as label from a", "cluster label")
def cluster_override(spark, sf_dir):
    return labels.cluster_override(_cluster_scores(spark, sf_dir), {"3": "fixed"}, ["alpha", "beta"])


@query("select o_orderkey, case when o_orderstatus = 'F' then 'malignant' else 'immune' end as pool from orders where (o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')) or (o_orderstatus = 'O' and o_orderpriority = '5-LOW')", "o_orderkey pool")
def label_pools(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "malignant").when(F.col("o_orderstatus") == "O", "normal")
    return labels.pools(table(spark, sf_dir, "orders").withColumn("status", status), "status", "o_orderpriority", ["1-URGENT", "2-HIGH"], ["5-LOW"]).select("o_orderkey", "pool")


@query("select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey", "c_custkey n_name")
def strict_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return labels.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey", "n_name", strict=True).select("c_custkey", "n_name")


@query("""
with w as (select p_brand || '-' || k.range as sample from (select distinct p_brand from part) cross join range(1, 51) k), f as (select w.sample, count(p_partkey) as n, min(w.sample || '/' || p_partkey) filter (where p_partkey is not null) as source from w left join part on w.sample = p_brand || '-' || p_size group by w.sample)
select sample, case when n = 1 then source end as source, case when n = 0 then 'missing' when n > 1 then 'ambiguous' else 'ok' end as status from f
""", "sample source status")
def matched_sources(spark, sf_dir):
    """Files named by brand, size and part: which brand and size has just one."""
    p = table(spark, sf_dir, "part")
    wanted = p.select("p_brand").distinct().select(F.explode(F.sequence(F.lit(1), F.lit(50))).alias("k"), "p_brand").select(F.concat_ws("-", "p_brand", F.col("k").cast("string")).alias("sample"))
    return labels.matched_sources(wanted, p.select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_partkey").cast("string")).alias("source")), "^([^/]*)/")


# Gates


COVERAGE = "with l as (select distinct 's' || user_id % 10 as sample, user_id from events where event_type = 'view'), r as (select distinct user_id from events where event_type = 'purchase')"


@query(f"{COVERAGE} select count(distinct sample) as n_samples, count(*) as n_labels, count(r.user_id) as n_exact, count(*) - count(r.user_id) as n_bad_absent from l left join r on r.user_id = l.user_id", "n_samples n_labels n_exact n_bad_absent")
def whole_source(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("sample", F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")))
    wanted = e.where("event_type = 'view'").select("sample", F.concat_ws("_", "sample", F.col("user_id").cast("string")).alias("barcode"))
    return gates.whole_source(labels.coverage(wanted, e.where("event_type = 'purchase'").select("sample", F.col("user_id").cast("string").alias("barcode"))))


@query("select count(*) as n_rows, count(*) filter (where s_suppkey is null or c_custkey is null) as n_bad_missing, count(*) filter (where abs(s_acctbal - c_acctbal) > 0.5 * greatest(abs(s_acctbal), abs(c_acctbal))) as n_bad_acctbal from supplier full outer join customer on s_suppkey = c_custkey", "n_rows n_bad_missing n_bad_acctbal")
def tables_agree(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("acctbal"))
    return gates.tables_agree(s, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("acctbal")), "k", ["acctbal"], 0.5)


@query("select o_orderkey, 'specimen' as unit, false as donor_verified from orders", "o_orderkey unit donor_verified")
def donor_unit(spark, sf_dir):
    return gates.donor_unit(table(spark, sf_dir, "orders").select("o_orderkey"), None)


# Curvature that is measured once


def _sampled(seed: int) -> str:
    return f"(with f as {graph_sql(15)}, p as (select * from f order by md5('{seed}:edges:' || u || ':' || v), u, v limit 400), i as (select u as n from f union all select v from f), s as (select u as n, weight as x from p union all select v, weight from p) {NODE})"


def _summary(spark, sf_dir, seed: int):
    e = knn(spark, sf_dir, 15)
    return graph.node_summary(cells(spark, sf_dir).select(F.col("vec_id").alias("id")), e, sampling.sampled_edges(e, 400, seed).withColumnRenamed("weight", "kappa"))


@query(f"select id, avg(kappa) as kappa, count(*) as n_runs from ({' union all '.join(f'select * from {_sampled(s)}' for s in range(3))}) where kappa is not null group by id", "id *kappa n_runs")
def across_seeds(spark, sf_dir):
    return graph.across_seeds(_summary(spark, sf_dir, 0).unionByName(_summary(spark, sf_dir, 1)).unionByName(_summary(spark, sf_dir, 2)))


ARMS = f"select m.id, case when label % 2 = 1 then 'a' else 'b' end as arm, kappa from {_sampled(0)} m join embeddings on vec_id = m.id where status = 'measured'"


@query(f"with r as ({ARMS}) select * from r where (select count(*) filter (where arm = 'a') >= 30 and count(*) filter (where arm = 'b') >= 30 from r)", "id arm *kappa")
def frozen_geometry(spark, sf_dir):
    """A contrast over curvature that was measured before the arms were known."""
    mask = cells(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    return graph.contrast_from(_summary(spark, sf_dir, 0), mask, F.col("label") % 2 == 1, F.col("label") % 2 == 0)
