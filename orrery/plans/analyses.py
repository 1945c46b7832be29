"""Whole analyses as queries. Those over Forman curvature have SQL; transport, eigenproblems and models have none, and are held
against small cases in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, normalize, ward
from ..session import pinned
from . import composites
from .queries import CLIFF, CONTRASTS, FORMAN, NODE, S, cells, counts, dl_sql, h, knn_sql, odd, query, table


def points(spark, sf_dir):
    """Cells with a patient."""
    return cells(spark, sf_dir).withColumn("patient", F.col("vec_id") % 6)


# Forman curvature of the cells that the sampler takes, in the words of the effects' own SQL.
SAMPLED = f"""
with s as (select vec_id, vec_id % 6 as patient, label % 2 = 1 as a from embeddings),
t as (select *, row_number() over (partition by patient, a order by {h('stratified-sample', 'vec_id')}, vec_id) as r from s where patient in (select patient from s group by patient having count(*) filter (where a) >= 10 and count(*) filter (where not a) >= 10)),
k as (select * from t where r <= 60), x as (select *, row_number() over (order by {h('surplus', 'vec_id')}, vec_id) as pos from k where r > 10)
select vec_id, patient, a from k where r <= 10 union all select vec_id, patient, a from x where pos <= (select case when count(*) <= 3500 then count(*) else 3500 - count(*) filter (where r <= 10) end from k)
"""
CHOSEN = f"(select e.* from embeddings e join ({SAMPLED}) c on c.vec_id = e.vec_id)"
CURVED = f"(with f as {FORMAN}, i as (select u as n from f union all select v from f), s as (select u as n, forman as x from f union all select v, forman from f) {NODE})".replace(knn_sql(15), knn_sql(15).replace("embeddings a", f"{CHOSEN} a").replace("embeddings b", f"{CHOSEN} b")).replace("from embeddings n", f"from {CHOSEN} n")
ROWS = f"(select c.patient as user_id, m.id as event_id, case when c.a then 'purchase' else 'view' end as event_type, m.kappa as value from {CURVED} m join ({SAMPLED}) c on c.vec_id = m.id where m.status = 'measured')"


@query(dl_sql(f"select 1 as one, delta, se from ({CONTRASTS.replace(CLIFF, CLIFF.replace(S, ROWS)).replace(S, ROWS)}) where ok and se_estimable", "one"), "k *delta *se *ci_lo *ci_hi *z *q df *tau2 *i2 *delta_fe *hk_se")
def meta_forman(spark, sf_dir):
    """The flagship analysis, from the sampler to the pooled effect, with a curvature that SQL can say."""
    out = composites.patient_meta(points(spark, sf_dir), "vec_id", "embedding", "patient", odd(), kind="forman", replicates=10)
    return out.select("k", "delta", "se", "ci_lo", "ci_hi", "z", "q", "df", "tau2", "i2", "delta_fe", "hk_se")


@query()
def dual_label_variants(spark, sf_dir):
    """Cells marked malignant by one rule and immune by another, some by both."""
    p = points(spark, sf_dir)
    marks = p.where("label % 2 = 1 or vec_id % 10 = 0").select(F.col("vec_id").alias("barcode"), F.lit("malignant").alias("label")).unionByName(p.where("label % 2 = 0").select(F.col("vec_id").alias("barcode"), F.lit("immune").alias("label")))
    return composites.dual_label_variants(p, "vec_id", "embedding", "patient", marks).select("variant", "k", "delta", "se", "boot_lo", "boot_hi", "status")


@query()
def label_validation(spark, sf_dir):
    schemes = {"odd": odd(), "low": F.col("label") < 4, "third": F.when(F.col("label") % 3 < 2, F.col("label") % 3 == 0)}
    return composites.label_validation(points(spark, sf_dir), "vec_id", "embedding", schemes)[1]


@query()
def batch_embeddings(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("depth", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x)))
    return composites.embeddings_against(p, "vec_id", "embedding", "patient", "depth", odd())[1]


def _arms(spark, sf_dir):
    return counts(spark, sf_dir).select("cell").distinct().withColumn("is_a", F.col("cell") % 2 == 0)


@query()
def parameter_grid(spark, sf_dir):
    """A grid of eight points; the reference's 72 are the operator's defaults."""
    grid, _, _ = composites.parameter_grid(counts(spark, sf_dir), _arms(spark, sf_dir), [100, 200], [5, 10], [10], [0.25, 0.5])
    return grid


@query()
def panel_curvature(spark, sf_dir):
    v = pinned(normalize.log_normalised(counts(spark, sf_dir), 1e6, 5), "values")
    return composites.curvature_of_panels(v, _arms(spark, sf_dir), 200, 5, 10)


@query()
def pseudotime_curvature(spark, sf_dir):
    return composites.curvature_along_pseudotime(cells(spark, sf_dir), "vec_id", "embedding", 0, "label")[1]


@query()
def subclone_extremes(spark, sf_dir):
    p = points(spark, sf_dir)
    nodes, _ = composites.node_curvature(p, "vec_id", "embedding", n_edges=4000)
    clones = ward.subclones(p, "patient", "vec_id", "embedding").select(F.col("vec_id").alias("id"), "patient", "subclone")
    return composites.extreme_subclones(pinned(nodes.where("status = 'measured'").select("id", "kappa").join(clones, "id"), "clones"))


@query("""
with r as (select vec_id % 6 as patient, label as clone, cast(embedding[1] as double) as x from embeddings), m as (select patient, clone, avg(x) as m, count(*) as n from r group by all having count(*) >= 5),
e as (select patient, count(*) as n_subclones, arg_max(clone, m) as highest, arg_min(clone, m) as lowest, max(m) as mean_highest, min(m) as mean_lowest from m group by patient having count(*) > 1)
select e.*, (select avg(sign(a.x - b.x)) from r a, r b where a.patient = e.patient and b.patient = e.patient and a.clone = e.highest and b.clone = e.lowest) as delta from e
""", "patient n_subclones highest lowest *mean_highest *mean_lowest *delta")
def extreme_groups_of_patients(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("x", F.get("embedding", F.lit(0)).cast("double"))
    return composites.extreme_subclones(p, "patient", "label", "x", 5)


@query()
def feature_sets(spark, sf_dir):
    """The label by curvature alone, by degree and curvature, and by parts of the embedding."""
    p = cells(spark, sf_dir)
    nodes, _ = composites.node_curvature(p, "vec_id", "embedding", n_edges=4000)
    x = F.col("embedding").cast("array<double>")
    rows = pinned(p.join(nodes.where("status = 'measured'").select(F.col("id").alias("vec_id"), "kappa", "degree"), "vec_id").select("vec_id", odd().alias("y"), F.array("kappa").alias("curvature"), F.array("kappa", F.col("degree").cast("double")).alias("graph"), F.slice(x, 1, 10).alias("head"), x.alias("embedding"), F.concat(x, F.array("kappa")).alias("both"), F.array(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v))).alias("depth")), "features")
    return composites.feature_sets(rows, "y", "vec_id", {c: c for c in rows.columns[2:]})


@query()
def three_way_labels(spark, sf_dir):
    """Proliferating, resting and other cells against each other."""
    p = points(spark, sf_dir).withColumn("score", F.get("embedding", F.lit(1)).cast("double"))
    named = labels.cycling_label(p, "score").select("vec_id", F.coalesce("label", F.lit("other")).alias("state"))
    nodes, _ = composites.node_curvature(p, "vec_id", "embedding", n_edges=4000)
    rows = pinned(nodes.where("status = 'measured'").select(F.col("id").alias("vec_id"), "kappa").join(named, "vec_id"), "states")
    return composites.pairwise(rows, "state", "kappa")


@query("""
with r as (select p_partkey as id, p_brand as g, cast(p_retailprice as double) as x from part)
select a.g as one, b.g as two, count(distinct a.id) as n1, count(distinct b.id) as n2, avg(sign(a.x - b.x)) as delta from r a join r b on a.g < b.g group by all
""", "one two n1 n2 *delta")
def pairwise_contrasts(spark, sf_dir):
    return composites.pairwise(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")


@query()
def response_by_arm(spark, sf_dir):
    """Patients' mean curvature against their response, within treatment arms and over all."""
    p = cells(spark, sf_dir).withColumn("patient", F.col("vec_id") % 40)
    nodes, _ = composites.node_curvature(p, "vec_id", "embedding", n_edges=4000)
    return composites.response(nodes, p.select(F.col("vec_id").alias("id"), "patient", (F.col("patient") % 3).cast("string").alias("arm"), (F.col("patient") % 2 == 0).alias("responded")))


@query()
def depth_reruns(spark, sf_dir):
    """The contrast within quintiles of depth and of the distance to neighbours, with bootstrapped intervals."""
    p = cells(spark, sf_dir).withColumn("depth", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x)))
    return composites.stratified_reruns(p, "vec_id", "embedding", "depth", odd())
