"""Named queries over the test tables, each with the SQL that another engine checks it by.

Roles of the tables: events give each user (patient) scores of purchases (arm a) and views (arm b); lineitem gives counts
of parts (genes) in suppliers (cells) and contacts between bins; embeddings are cells with labels; customers' nations and
regions are donors and cohorts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..operators import batches, communities, curvature, delaunay, diffusion, effects, gates, graph, labels, meta, ml, models, normalize, ranks, sampling, ward
from ..session import pinned
from . import composites

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLACES = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to PLACES digits, so that sums in another order compare equal; no negative zero."""
    return df.select(*((F.round(c.name, PLACES) + 0.0).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema))


def query(sql: str | None = None, columns: str = "", is_rounded: bool = False) -> Callable[[Query], Query]:
    """Register a query; columns lists the SQL's, those to round with a *. is_rounded: the query rounds its doubles itself."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f if is_rounded else lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            shown = ", ".join(f"round(cast({c[1:]} as double), {PLACES}) + 0.0 as {c[1:]}" if c[0] == "*" else c for c in columns.split())
            ORACLES[f.__name__] = f"select {shown} from ({sql})"
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, event_type, value of purchases and views."""
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view")).select("user_id", "event_id", "event_type", "value")


def is_a() -> Column:
    return F.col("event_type") == "purchase"


def is_b() -> Column:
    return F.col("event_type") == "view"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def contacts(spark: SparkSession, sf_dir: str, bins: int = 60) -> DataFrame:
    i, j = F.pmod("l_partkey", F.lit(bins)), F.pmod("l_suppkey", F.lit(bins))
    chrom = F.concat(F.lit("chr"), F.pmod("l_orderkey", F.lit(3)).cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(chrom.alias("chrom"), F.least(i, j).alias("i"), F.greatest(i, j).alias("j")).agg(F.count("*").alias("count"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def knn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return graph.knn_graph(cells(spark, sf_dir), "vec_id", "embedding", k)


def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, cohort: users as customers of nations' regions."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("user_id"), F.col("n_regionkey").alias("cohort"))


# SQL building blocks

S = "(select user_id, event_id, event_type, value from events where event_type in ('purchase', 'view') and user_id is not null and value is not null)"
CLIFF = f"""
select user_id, n1, n2, delta,
    case when n1 < 2 or n2 < 2 then 'non_estimable_small_group'
         when z10 <= 0 and z01 <= 0 and (abs(delta) >= 1 or delta = 0) then 'non_estimable_degenerate_projection'
         when z10 <= 0 and z01 <= 0 then 'non_estimable_zero_projection_variance' else 'ok' end as status,
    case when n1 >= 2 and n2 >= 2 and not (z10 <= 0 and z01 <= 0) then sqrt(z10 / n1 + z01 / n2) end as se, m1, m2
from (select user_id, count(*) filter (where a) as n1, count(*) filter (where not a) as n2, avg(g) filter (where a) as delta,
        var_samp(g) filter (where a) as z10, var_samp(g) filter (where not a) as z01, avg(value) filter (where a) as m1, avg(value) filter (where not a) as m2
    from (select x.user_id, x.event_id, x.value, x.event_type = 'purchase' as a, avg(sign(x.value - y.value)) as g
        from {S} x join {S} y on x.user_id = y.user_id and x.event_type <> y.event_type group by all)
    group by user_id)
"""
CONTRASTS = f"""
select s.user_id as patient_id, s.c1 >= 10 and s.c2 >= 10 as ok, s.c1 as n1, s.c2 as n2, case when not (s.c1 >= 10 and s.c2 >= 10) then 'below_min_cells' end as reason,
    case when s.c1 >= 10 and s.c2 >= 10 then s.m1 end as mean_a, case when s.c1 >= 10 and s.c2 >= 10 then s.m2 end as mean_b,
    case when s.c1 >= 10 and s.c2 >= 10 then c.delta end as delta, case when s.c1 >= 10 and s.c2 >= 10 then c.se end as se,
    case when s.c1 >= 10 and s.c2 >= 10 then c.status end as status, case when s.c1 >= 10 and s.c2 >= 10 then c.status = 'ok' end as se_estimable
from (select user_id, count(*) filter (where event_type = 'purchase') as c1, count(*) filter (where event_type = 'view') as c2,
        avg(value) filter (where event_type = 'purchase') as m1, avg(value) filter (where event_type = 'view') as m2 from {S} group by user_id) s
left join ({CLIFF}) c on s.user_id = c.user_id
"""
CONTRAST_COLUMNS = "patient_id ok n1 n2 reason *mean_a *mean_b *delta *se status se_estimable"


def dl_sql(rows: str, key: str) -> str:
    """DerSimonian-Laird of rows (key, delta, se), pairwise Q."""
    return f"""
with e as (select {key} as g, delta as d, se as s, 1 / (se * se) as w from ({rows})),
f as (select g, count(*) as k, sum(w) as sw, sum(w * w) as sww, sum(w * d) / sum(w) as delta_fe from e group by g),
pairs as (select a.g, sum(a.w * b.w * (a.d - b.d) * (a.d - b.d)) / 2 as p from e a join e b on a.g = b.g group by a.g),
t as (select f.*, p / sw as q0, case when k > 1 and sw - sww / sw > 0 then greatest(0, (p / sw - (k - 1)) / (sw - sww / sw)) else 0 end as tau2_used from f join pairs using (g)),
r as (select t.g, k, q0, tau2_used, delta_fe, sum(d / (s * s + tau2_used)) / sum(1 / (s * s + tau2_used)) as delta, sqrt(1 / sum(1 / (s * s + tau2_used))) as se, sum(1 / (s * s + tau2_used)) as sws
    from e join t using (g) group by all),
h as (select r.g, sum((d - r.delta) * (d - r.delta) / (s * s + tau2_used)) as r2 from e join r using (g) group by r.g)
select g as {key}, k, delta, se, delta - 1.96 * se as ci_lo, delta + 1.96 * se as ci_hi, delta / se as z, case when k > 1 then q0 end as q, k - 1 as df,
    case when k > 1 then tau2_used end as tau2, case when k > 1 then case when q0 > 0 then greatest(0, (q0 - (k - 1)) / q0) * 100 else 0 end end as i2, delta_fe,
    case when k > 1 then sqrt(greatest(1, r2 / (k - 1)) / sws) end as hk_se
from r join h using (g)
"""


DL_COLUMNS = "k *delta *se *ci_lo *ci_hi *z *q df *tau2 *i2 *delta_fe *hk_se"
EST = f"select * from ({CONTRASTS}) where ok and se_estimable"
COHORT = "select c_custkey as user_id, n_regionkey as cohort from customer join nation on c_nationkey = n_nationkey"


def estimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.estimable(pinned(effects.per_patient_contrasts(scores(spark, sf_dir), "user_id", "value", is_a()), "contrasts"))


# Effects and pooling


@query(f"select user_id, n1, n2, delta, se, status from ({CLIFF})", "user_id n1 n2 *delta *se status")
def cliff_delta(spark, sf_dir):
    return effects.cliff_delta(scores(spark, sf_dir), ["user_id"], "value", is_a())


@query(CONTRASTS, CONTRAST_COLUMNS)
def cliff_per_patient(spark, sf_dir):
    return effects.per_patient_contrasts(scores(spark, sf_dir), "user_id", "value", is_a())


@query(dl_sql(f"select 1 as one, delta, se from ({EST})", "one"), DL_COLUMNS)
def dl_meta(spark, sf_dir):
    return meta.dersimonian_laird(meta.check_effects(estimable(spark, sf_dir)))


@query(dl_sql(f"select cohort, delta, se from ({EST}) join ({COHORT}) on patient_id = user_id", "cohort"), "cohort " + DL_COLUMNS)
def dl_by_cohort(spark, sf_dir):
    return meta.dersimonian_laird(estimable(spark, sf_dir).join(donors(spark, sf_dir), F.col("patient_id") == F.col("user_id")), ["cohort"])


@query(dl_sql(f"select 1 as one, delta, se from ({dl_sql(f'select cohort, delta, se from ({EST}) join ({COHORT}) on patient_id = user_id', 'cohort')})", "one"), DL_COLUMNS)
def cohort_as_study(spark, sf_dir):
    first = meta.dersimonian_laird(estimable(spark, sf_dir).join(donors(spark, sf_dir), F.col("patient_id") == F.col("user_id")), ["cohort"])
    return meta.dersimonian_laird(first.select("cohort", "delta", "se"))


@query()
def dl_tails(spark, sf_dir):
    return meta.with_tails(meta.dersimonian_laird(estimable(spark, sf_dir)))


@query()
def protocol_decision(spark, sf_dir):
    return meta.protocol_decision(meta.with_tails(meta.dersimonian_laird(estimable(spark, sf_dir)))).select("k", "delta", "one_sided_p", "status", "supported")


@query(dl_sql(f"""
with n as (select row_number() over (order by patient_id) - 1 as i, delta, se, count(*) over () as k from ({EST})),
d as (select b.range as replicate, cast('0x' || substr(md5('0:bootstrap-dl:' || b.range || ':' || j.range), 1, 8) as bigint) % n.k as i
    from range(200) b, (select max(k) as k from n) n, range(10000) j where j.range < n.k)
select replicate, delta, se from d join n using (i)""", "replicate"), "replicate *delta")
def bootstrap_dl(spark, sf_dir):
    return meta.bootstrap_pooled(estimable(spark, sf_dir), "patient_id", 200)


@query(f"select count(*) filter (where delta > 0) as n_positive, count(*) filter (where delta < 0) as n_negative, count(*) filter (where delta = 0) as n_zero, count(delta) as n_total, count(*) filter (where delta > 0) / count(delta) as fraction_positive from ({EST})", "n_positive n_negative n_zero n_total *fraction_positive")
def direction_counts(spark, sf_dir):
    return effects.directions(estimable(spark, sf_dir))


@query(f"select count(*) filter (where sign(delta) = sign(p.pooled)) as n_same, count(*) as n_total from ({EST}), (select delta as pooled from ({dl_sql(f'select 1 as one, delta, se from ({EST})', 'one')})) p", "n_same n_total")
def same_direction(spark, sf_dir):
    rows = estimable(spark, sf_dir)
    return effects.same_direction(rows, meta.dersimonian_laird(rows))


@query(f"select avg(sign(x.value - y.value)) as delta, count(distinct x.event_id) as n1, count(distinct y.event_id) as n2 from {S} x, {S} y where x.event_type = 'purchase' and y.event_type = 'view'", "n1 n2 *delta")
def naive_pooled(spark, sf_dir):
    return effects.cliff_delta(scores(spark, sf_dir), [], "value", is_a()).select("n1", "n2", "delta")


MWU = f"""
with r as (select value, event_type = 'purchase' as a, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as rk, count(*) over (partition by value) as t from {S}),
s as (select count(*) filter (where a) as n1, count(*) filter (where not a) as n2, sum(rk) filter (where a) as ra, sum(cast(t as double) * t - 1) as ties from r)
select n1, n2, ra - n1 * (n1 + 1) / 2.0 as u, ties, (ra - n1 * (n1 + 1) / 2.0) / (n1 * n2) as auc, 2 * (ra - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1 as delta from s
"""


@query(MWU, "n1 n2 *u *ties *auc *delta")
def mwu_u(spark, sf_dir):
    return effects.mann_whitney(scores(spark, sf_dir), [], "value", is_a())


@query()
def mwu_p(spark, sf_dir):
    from ..functions import tails

    return effects.mann_whitney(scores(spark, sf_dir), ["user_id"], "value", is_a()).withColumn("p", tails.mann_whitney_two_sided("u", "n1", "n2", "ties")).select("user_id", "n1", "n2", "u", "p")


WELCH = "select {g} count(value) filter (where a) as n1, count(value) filter (where not a) as n2, avg(value) filter (where a) as mean1, avg(value) filter (where not a) as mean2, var_samp(value) filter (where a) / count(value) filter (where a) as v1, var_samp(value) filter (where not a) / count(value) filter (where not a) as v2 from (select *, event_type = 'purchase' as a from " + S + ") {by}"


@query(f"select user_id, n1, n2, mean1, mean2, (mean1 - mean2) / nullif(sqrt(v1 + v2), 0) as t, (v1 + v2) * (v1 + v2) / nullif(v1 * v1 / nullif(n1 - 1, 0) + v2 * v2 / nullif(n2 - 1, 0), 0) as df from ({WELCH.format(g='user_id,', by='group by user_id')})", "user_id n1 n2 *mean1 *mean2 *t *df")
def welch_stats(spark, sf_dir):
    return effects.welch(scores(spark, sf_dir), ["user_id"], "value", is_a())


@query("""
with r as (select event_type as g, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as rk, count(*) over (partition by value) as t from events where value is not null and event_type is not null),
s as (select g, sum(rk) as s, count(*) as n from r group by g), k as (select sum(n) as n, sum(s * s / n) as q, count(*) - 1 as df from s)
select (12 / (cast(n as double) * (n + 1)) * q - 3 * (n + 1)) / (1 - (select sum(cast(t as double) * t - 1) from r) / (cast(n as double) * n * n - n)) as h, df, cast(n as bigint) as n from k
""", "*h df n")
def kruskal_h(spark, sf_dir):
    return effects.kruskal(table(spark, sf_dir, "events"), "event_type", "value")


@query("""
with d as (select l_returnflag, round(l_discount * 100) - round(l_tax * 100) as d from lineitem), r as (
    select l_returnflag, d, rank() over (partition by l_returnflag order by abs(d)) + (count(*) over (partition by l_returnflag, abs(d)) - 1) / 2.0 as rk, count(*) over (partition by l_returnflag, abs(d)) as t from d where d <> 0)
select l_returnflag, count(*) as n, coalesce(sum(rk) filter (where d > 0), 0) as w_plus, coalesce(sum(rk) filter (where d < 0), 0) as w_minus, sum(cast(t as double) * t - 1) as ties from r group by l_returnflag
""", "l_returnflag n *w_plus *w_minus *ties")
def wilcoxon_w(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.round(F.col("l_discount") * 100).alias("one"), F.round(F.col("l_tax") * 100).alias("two"))
    return effects.wilcoxon(rows, ["l_returnflag"], "one", "two")


@query("select corr(cast(n_chars as double), cast(length(lang) + ascii(right(source, 1)) as double)) as r, count(*) as n from documents", "*r n")
def pearson(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("n_chars", (F.length("lang") + F.ascii(F.substring("source", -1, 1))).alias("y"))
    return effects.pearson(rows, "n_chars", "y")


@query("""
with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part)
select corr(a, b) as rho, count(*) as n from r
""", "*rho n")
def spearman(spark, sf_dir):
    return effects.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice")


@query("select value, n, mid_rank from (select p_size as value, count(*) as n, sum(count(*)) over (order by p_size) - count(*) + (count(*) + 1) / 2.0 as mid_rank from part group by p_size)", "value n *mid_rank")
def mid_ranks(spark, sf_dir):
    return ranks.mid_ranks(table(spark, sf_dir, "part").select(F.col("p_size").alias("value")), "value")


@query(f"""
with d as (select user_id % 5 as arm, value, event_type = 'purchase' as a from {S}), r as (
    select *, rank() over (partition by arm order by value) + (count(*) over (partition by arm, value) - 1) / 2.0 as rk from d),
s as (select arm, count(*) filter (where a) as n_r, count(*) filter (where not a) as n_nr, avg(value) filter (where a) as mean_r, avg(value) filter (where not a) as mean_nr, sum(rk) filter (where a) as ra from r group by arm),
u as (select *, ra - n_r * (n_r + 1) / 2.0 as u, (ra - n_r * (n_r + 1) / 2.0) / (n_r * n_nr) as auc from s)
select arm, n_r, n_nr, mean_r, mean_nr, u, auc as auc_r, 1 - auc as auc_nr, greatest(auc, 1 - auc) as auc_best, case when auc >= 0.5 then 'R>NR' else 'NR>R' end as direction from u
""", "arm n_r n_nr *mean_r *mean_nr *u *auc_r *auc_nr *auc_best direction")
def arm_auc(spark, sf_dir):
    return effects.arm_auc(scores(spark, sf_dir).withColumn("arm", F.col("user_id") % 5), "arm", "value", is_a())


@query("""
with g as (select p_brand, p_size % 5 as size_class, avg(p_retailprice) as delta from part group by all), t as (select avg(delta) as grand, var_pop(delta) as v, count(*) as n from g)
select 'p_brand' as axis, sum(c * (m - grand) * (m - grand)) / max(n) / max(v) as fraction from (select avg(delta) as m, count(*) as c from g group by p_brand), t
union all select 'size_class', sum(c * (m - grand) * (m - grand)) / max(n) / max(v) from (select avg(delta) as m, count(*) as c from g group by size_class), t
""", "axis *fraction")
def variance_by_axis(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 5).alias("size_class")).agg(F.avg("p_retailprice").alias("delta"))
    return meta.variance_by_axis(g, ["p_brand", "size_class"], "delta")


@query("""
select n, n_positive / n as share, median, case when n_positive / n > 0.80 and abs(median) > 0.30 then 'stable' when n_positive / n < 0.50 or abs(median) < 0.10 then 'fragile' else 'partly fragile' end as verdict
from (select count(d) as n, count(*) filter (where d > 0) as n_positive, median(d) as median from (select p_brand, p_size % 4 as k, avg(p_retailprice) / 1000 - 1.2 as d from part group by all))
""", "n *share *median verdict")
def sign_stability(spark, sf_dir):
    runs = table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 4).alias("k")).agg((F.avg("p_retailprice") / 1000 - 1.2).alias("delta"))
    return meta.stability(runs)


@query("""
with e as (select p_brand as cohort, p_size % 6 as m, avg(p_retailprice) / 1000 - 1.45 as d from part group by all),
w as (select cohort, avg(d) filter (where m = 0) as original, avg(d) filter (where m = 1) as corrected, avg(d) filter (where m between 2 and 4) as random, avg(d) filter (where m = 5) as depth from e group by cohort)
select *, (abs(original) - abs(corrected)) / abs(original) as drop, case when sign(original) <> sign(corrected) then 'KILLED' when (abs(original) - abs(corrected)) / abs(original) >= 0.5 then 'WEAKENED' when abs(random) > 0.2 then 'NULL-MATCHED' when abs(depth) > 0.2 and sign(depth) = sign(original) then 'DEPTH-CONFOUNDED' else 'SURVIVES' end as verdict from w
""", "cohort *original *corrected *random *depth *drop verdict")
def batch_verdict(spark, sf_dir):
    e = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cohort"), (F.col("p_size") % 6).alias("m")).agg((F.avg("p_retailprice") / 1000 - 1.45).alias("delta"))
    names = F.when(F.col("m") == 0, "original").when(F.col("m") == 1, "corrected").when(F.col("m") == 5, "depth").otherwise("random")
    return meta.batch_verdict(e.withColumn("method", names), ["cohort"])


@query(f"with r as (select avg(delta) as mean, stddev_samp(delta) as std, quantile_cont(delta, 0.025) as lo, quantile_cont(delta, 0.975) as hi from ({EST})) select 0.1 as value, mean, std, lo, hi, (0.1 - mean) / std as z, 0.1 between lo and hi as inside from r", "*value *mean *std *lo *hi *z inside")
def against_random(spark, sf_dir):
    return meta.against_random(spark.createDataFrame([(0.1,)], "delta double"), estimable(spark, sf_dir))


@query("""
select case when n_classified < 3 then 'inconclusive' when neg > 0 then 'annotation_dependent_sign_reversal' when pos = 3 then 'robust_all_positive' else 'robust_in_direction_with_null_schemes' end as verdict, n_classified, 3 as n_expected, delta_min, delta_max from (
    select count(kind) as n_classified, count(*) filter (where kind = 'negative') as neg, count(*) filter (where kind = 'positive') as pos, min(delta) as delta_min, max(delta) as delta_max from (
        select delta, case when not ok then null when delta < -0.05 and p < 0.05 then 'negative' when delta > 0.05 and p < 0.05 then 'positive' else 'null' end as kind from (
            select l_returnflag as scheme, avg(l_quantity) / 100 as delta, avg(l_discount) as p, count(*) > 100 as ok from lineitem where l_returnflag in ('A', 'N', 'R') group by 1)))
""", "verdict n_classified n_expected *delta_min *delta_max")
def label_verdict(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("scheme")).agg((F.avg("l_quantity") / 100).alias("delta"), F.avg("l_discount").alias("p"), (F.count("*") > 100).alias("ok"))
    return meta.label_verdict(e, ["A", "N", "R"])


# Sampling


def h(stage: str, ident: str, seed: int = 0) -> str:
    return f"md5('{seed}:{stage}:' || {ident})"


@query(f"""
with s as (select *, count(*) filter (where event_type = 'purchase') over (partition by user_id) as na, count(*) filter (where event_type = 'view') over (partition by user_id) as nb from {S}),
t as (select *, row_number() over (partition by user_id, event_type order by {h('stratified-sample', 'event_id')}, event_id) as r from s where na >= 10 and nb >= 10),
k as (select *, case when event_type = 'purchase' then 'a' else 'b' end as arm from t where r <= 20),
x as (select *, row_number() over (order by {h('surplus', 'event_id')}, event_id) as pos from k where r > 10)
select user_id as patient, event_id as id, arm from k where r <= 10
union all select user_id, event_id, arm from x where pos <= (select case when count(*) <= 25 * count(distinct user_id) then count(*) else 25 * count(distinct user_id) - count(*) filter (where r <= 10) end from k)
""", "patient id arm")
def stratified_minima(spark, sf_dir):
    """A total of 25 cells a patient that has enough, between the minima (20) and the caps (40)."""
    rows = scores(spark, sf_dir)
    patients = labels.qualifying(rows, "user_id", is_a(), is_b(), 10).where("qualifies").count()
    return sampling.stratified_minima_first(rows, "user_id", "event_id", is_a(), is_b(), 10, 20, 25 * patients)



@query("select user_id as patient, count(*) filter (where event_type = 'purchase') as n_a, count(*) filter (where event_type = 'view') as n_b, count(*) filter (where event_type = 'purchase') >= 10 and count(*) filter (where event_type = 'view') >= 10 as qualifies, case when not (count(*) filter (where event_type = 'purchase') >= 10 and count(*) filter (where event_type = 'view') >= 10) then 'below_min_per_group' end as reason from events group by user_id", "patient n_a n_b qualifies reason")
def sampling_audit(spark, sf_dir):
    return sampling.sampling_audit(table(spark, sf_dir, "events"), "user_id", is_a(), is_b())


@query(f"with a as (select event_id, case when event_type = 'purchase' then 'a' else 'b' end as arm from {S}), r as (select *, row_number() over (partition by arm order by {h('balanced', 'event_id')}, event_id) as r from a), m as (select least(500, min(c)) as m from (select count(*) as c from a group by arm)) select event_id, arm from r, m where r <= m", "event_id arm")
def balanced_sample(spark, sf_dir):
    return sampling.balanced_arms(scores(spark, sf_dir).where("value is not null and user_id is not null"), "event_id", is_a(), 500).select("event_id", "arm")


@query(f"""
with s as (select floor(2000 / count(distinct user_id)) as share from {S}), r as (select *, row_number() over (partition by user_id order by {h('even', 'event_id')}, event_id) as r from {S}),
e as (select event_id from r, s where r <= share), x as (select event_id, row_number() over (order by {h('top-up', 'event_id')}, event_id) as pos from r, s where r > share)
select event_id from e union all select event_id from x where pos <= (select 2000 - count(*) from e)
""", "event_id")
def even_with_topup(spark, sf_dir):
    return sampling.even_with_top_up(scores(spark, sf_dir).where("value is not null and user_id is not null"), "user_id", "event_id", 2000).select("event_id")


@query(f"with r as (select *, row_number() over (partition by user_id, event_type order by {h('stratum', 'event_id')}, event_id) as r from {S}) select event_id from r where r <= 15 order by {h('global', 'event_id')}, event_id limit 1000", "event_id")
def capped_then_global(spark, sf_dir):
    return sampling.capped_then_global(scores(spark, sf_dir).where("value is not null and user_id is not null"), ["user_id", "event_type"], "event_id", 15, 1000).select("event_id")


@query(f"with r as (select event_id, event_type, row_number() over (partition by event_type order by {h('arms', 'event_id')}, event_id) as r from events) select event_id, event_type from r where r <= 300", "event_id event_type")
def independent_arms(spark, sf_dir):
    return sampling.independent_arms(table(spark, sf_dir, "events"), "event_type", "event_id", 300).select("event_id", "event_type")


@query(f"with r as (select event_id, event_type, row_number() over (partition by event_type order by {h('quota', 'event_id')}, event_id) as r from events where event_type in ('purchase', 'view', 'click')) select event_id, event_type from r where r <= case when event_type = 'click' then 200 else 400 end", "event_id event_type")
def label_quota(spark, sf_dir):
    return sampling.by_quota(table(spark, sf_dir, "events"), "event_type", "event_id", {"purchase": 400, "view": 400, "click": 200}).select("event_id", "event_type")


@query("select r.range as panel, p_partkey as gene from part, range(5) r qualify row_number() over (partition by r.range order by md5('0:panel:' || r.range || ':' || p_partkey), p_partkey) <= 50", "panel gene")
def random_panels(spark, sf_dir):
    return sampling.random_panels(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene")), "gene", 50, 5)


# Counts


C = "(select l_suppkey as cell, l_partkey as gene, sum(l_quantity) as value from lineitem group by all)"


@query(f"select cell, sum(value) as library, count(*) filter (where value > 0) as n_genes, sum(case when gene % 50 = 0 then value else 0 end) * 100 / sum(value) as pct_mito from {C} group by cell", "cell *library n_genes *pct_mito")
def cell_qc(spark, sf_dir):
    named = counts(spark, sf_dir).withColumn("gene", F.when(F.col("gene") % 50 == 0, F.concat(F.lit("mt-"), F.col("gene"))).otherwise(F.col("gene").cast("string")))
    return normalize.cell_summary(named)


@query(f"select gene, count(distinct cell) as n_cells from {C} where value > 0 group by gene having count(distinct cell) >= 5", "gene n_cells")
def gene_detection(spark, sf_dir):
    return normalize.detected_genes(counts(spark, sf_dir), 5)


@query(f"with s as (select cell, sum(value) as l, count(*) filter (where value > 0) as g from {C} group by cell) select count(*) as n_rows, count(distinct cell) as n_cells, sum(value) as total from {C} where cell in (select cell from s where g >= 100 and l >= 3000)", "n_rows n_cells *total")
def good_cells(spark, sf_dir):
    return normalize.good_cells(counts(spark, sf_dir), 100, 3000).agg(F.count("*").alias("n_rows"), F.count_distinct("cell").alias("n_cells"), F.sum("value").alias("total"))


LOGN = f"select c.cell, c.gene, ln(1 + c.value * 1000000.0 / l.l) as value from {C} c join (select cell, sum(value) as l from {C} group by cell) l using (cell) where gene in (select gene from {C} where value > 0 group by gene having count(distinct cell) >= 5)"


@query(LOGN, "cell gene *value")
def log_cpm(spark, sf_dir):
    return normalize.log_normalised(counts(spark, sf_dir), 1e6, 5)


@query(f"select c.cell, c.gene, ln(1 + c.value * m / l.l) as value from {C} c join (select cell, sum(value) as l from {C} group by cell) l using (cell), (select median(l) as m from (select sum(value) as l from {C} group by cell))", "cell gene *value")
def log_median_library(spark, sf_dir):
    return normalize.log_normalised(counts(spark, sf_dir), None)


MOMENTS = f"select gene, sum(value) / n as mean, greatest(sum(value * value) / n - (sum(value) / n) * (sum(value) / n), 0) as var from ({LOGN}), (select count(distinct cell) as n from ({LOGN})) group by gene, n"


@query(MOMENTS, "gene *mean *var")
def gene_variance(spark, sf_dir):
    return normalize.gene_moments(normalize.log_normalised(counts(spark, sf_dir), 1e6, 5))


@query(f"select gene, mean, var from (select gene, mean, round(var, 9) as v9, var from ({MOMENTS})) order by v9 desc, gene limit 200", "gene *mean *var")
def hvg_topk(spark, sf_dir):
    return normalize.variable_genes(normalize.log_normalised(counts(spark, sf_dir), 1e6, 5), 200)


@query(f"""
with v as ({LOGN}), c as (select distinct cell from v), d as (select c.cell, g.gene, coalesce(v.value, 0) as value from c cross join (select distinct gene from v) g left join v on v.cell = c.cell and v.gene = g.gene),
s as (select gene, avg(value) as m, stddev_pop(value) as sd from d group by gene)
select cell, gene, least(greatest(case when sd > 1e-12 * abs(m) then (value - m) / sd else 0 end, -2), 2) as value from d join s using (gene)
""", "cell gene *value", is_rounded=True)
def gene_scaled(spark, sf_dir):
    return normalize.scaled(normalize.log_normalised(counts(spark, sf_dir), 1e6, 5), 2.0, places=PLACES)


@query(f"""
with m as (select gene, mean, var / mean as d from ({MOMENTS}) where mean > 0), q as (select quantile_cont(mean, [i / 20.0 for i in range(1, 20)]) as e from m),
b as (select gene, d, len(list_filter(e, lambda x: x <= mean)) as bin from m, q), c as (select bin, median(d) as c from b group by bin),
s as (select bin, c, median(abs(d - c)) as s from b join c using (bin) group by all)
select gene, coalesce((d - c) / nullif(s, 0), 0) as dispersion from b join s using (bin)
""", "gene *dispersion")
def dispersion_cell_ranger(spark, sf_dir):
    return normalize.dispersed_genes(normalize.log_normalised(counts(spark, sf_dir), 1e6, 5), None, "cell_ranger")


@query(f"""
with m as (select gene, ln(1 + mean) as m, ln(var / mean) as d from ({MOMENTS}) where mean > 0 and var > 0), r as (select min(m) as lo, max(m) as hi from m),
b as (select gene, d, least(coalesce(floor((m - lo) / nullif((hi - lo) / 20, 0)), 0), 19) as bin from m, r), s as (select bin, avg(d) as c, stddev_samp(d) as s from b group by bin)
select gene, case when s is null then 1 else coalesce((d - c) / nullif(s, 0), 0) end as dispersion from b join s using (bin)
""", "gene *dispersion")
def dispersion_seurat(spark, sf_dir):
    return normalize.dispersed_genes(normalize.log_normalised(counts(spark, sf_dir), 1e6, 5), None, "seurat")


@query(f"select cell, ln(1 + sum(value)) as depth from {C} group by cell", "cell *depth")
def depth_embedding(spark, sf_dir):
    return normalize.depth_embedding(counts(spark, sf_dir)).select("cell", F.get("embedding", F.lit(0)).alias("depth"))


SMOOTH = """
with g as (select p_brand as arm, p_partkey as start, p_retailprice as value, row_number() over (partition by p_brand order by p_partkey) as i, count(*) over (partition by p_brand) as n, first(p_retailprice) over (partition by p_brand order by p_partkey) as f, last(p_retailprice) over (partition by p_brand order by p_partkey rows between unbounded preceding and unbounded following) as l from part),
w as (select *, least(100, n) as w from g),
k as (select arm, start, i, n, w, k.range as k, i + (w % 2) - (w - 1) // 2 + k.range as at from w, range(100) k where k.range < w and not (w % 2 = 1 and i = n))
select k.arm, k.start, avg(case when k.at < 1 then e.f when k.at > k.n then e.l else v.value end) as smooth from k join (select distinct arm, f, l from g) e using (arm) left join g v on v.arm = k.arm and v.i = k.at group by all
"""


@query(f"select arm, start, smooth + 1e-9 as smooth from ({SMOOTH})", "arm start *smooth")
def arm_moving_average(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("arm"), F.col("p_partkey").alias("start"), F.col("p_retailprice").alias("value"))
    return normalize.moving_average(rows, ["arm"], "start", "value").select("arm", "start", (F.col("smooth") + 1e-9).alias("smooth"))


@query("select p_partkey, avg(p_retailprice) over (partition by p_brand order by p_partkey rows between 4 preceding and 5 following) + 1e-9 as smooth from part", "p_partkey *smooth")
def rolling_mean(spark, sf_dir):
    out = normalize.rolling_mean(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_retailprice", 10)
    return out.select("p_partkey", (F.col("smooth") + 1e-9).alias("smooth"))


@query("select coalesce(s_suppkey, c_custkey) as bin, s_acctbal as x_1, c_acctbal as x_2 from supplier full outer join customer on s_suppkey = c_custkey", "bin *x_1 *x_2")
def both_maps(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bin"), F.col("s_acctbal").alias("x"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bin"), F.col("c_acctbal").alias("x"))
    return labels.both_maps(s, c, "bin", "x")


@query("select c_custkey, coalesce(n_name, 'none') as n_name from customer left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey", "c_custkey n_name")
def default_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return labels.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey", "n_name", "none").select("c_custkey", "n_name")


@query("select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as r from lineitem) where r = 1", "l_orderkey l_linenumber l_partkey")
def first_of_each(spark, sf_dir):
    return labels.first_of(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select o_orderkey from orders where o_custkey not in (select s_suppkey from supplier)", "o_orderkey")
def excluded_specimens(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "specimen")
    return labels.without_specimens(o, "specimen", table(spark, sf_dir, "supplier").select("s_suppkey")).select("o_orderkey")


@query("select c_name as name, c_custkey as source_at, row_number() over (order by c_acctbal desc, c_custkey) as target_at from customer", "name source_at target_at")
def axis_permutation(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    placed = c.withColumn("at", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("bigint"))  # the test's other axis
    return labels.permutation(c.select(F.col("c_name").alias("k"), F.col("c_custkey").alias("at")), placed.select(F.col("c_name").alias("k"), "at"), "k", "at")


# Labels


@query("with q as (select quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) as e from orders) select bin, count(*) as n, min(o_totalprice) as lo, max(o_totalprice) as hi from (select o_totalprice, len(list_filter(e, lambda x: x <= o_totalprice)) as bin from orders, q) group by bin", "bin n *lo *hi")
def quintile_bins(spark, sf_dir):
    return labels.quantile_bin(table(spark, sf_dir, "orders"), "o_totalprice", 5, "bin").groupBy("bin").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("with q as (select quantile_cont(o_totalprice, 0.33) as lo, quantile_cont(o_totalprice, 0.67) as hi from orders) select o_orderkey, case when o_totalprice >= hi then 'high' when o_totalprice <= lo then 'low' else 'mid' end as label from orders, q", "o_orderkey label")
def tertile_labels(spark, sf_dir):
    return labels.tertile_label(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "label")


@query("select o_orderkey, case when z > 1 then 'proliferating' when z < 0 then 'resting' end as label from (select o_orderkey, (o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over () as z from orders)", "o_orderkey label")
def cycling_labels(spark, sf_dir):
    return labels.cycling_label(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "label")


PANELS = [("alpha", 0, 0), ("beta", 1, 1), ("gamma", 2, 2)]


def panels(spark, sf_dir):
    m = spark.createDataFrame(PANELS, "panel string, ord int, rest int")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_partkey") % 40).cast("int").alias("rest")).join(m, "rest").select("panel", "ord", "gene")


PANEL_Z = f"""
with v as ({LOGN}), p as (select case p_partkey % 40 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as panel, p_partkey % 40 as ord, p_partkey as gene from part where p_partkey % 40 < 3 and p_partkey in (select gene from v)),
z as (select panel, ord, count(*) as size from p group by all), s as (select cell, panel, sum(value) as s from v join p using (gene) group by all),
g as (select c.cell, z.panel, z.ord, coalesce(s, 0) / size as score from (select distinct cell from v) c cross join z left join s on s.cell = c.cell and s.panel = z.panel),
t as (select *, coalesce((score - avg(score) over (partition by panel)) / nullif(stddev_samp(score) over (partition by panel), 0), 0) as zs from g),
"""


@query(PANEL_Z + """
r as (select *, row_number() over (partition by cell order by zs desc, ord) as r from t),
b as (select cell, max(panel) filter (where r = 1) as panel, max(zs) filter (where r = 1) as top, max(zs) filter (where r = 2) as second from r group by cell)
select cell, case when top >= 0.5 and top - second >= 0.25 then panel else 'Unknown' end as label, top, second from b
""", "cell label *top *second")
def panel_zscore_argmax(spark, sf_dir):
    v = normalize.log_normalised(counts(spark, sf_dir), 1e6, 5)
    return labels.panel_label(v, panels(spark, sf_dir), v.select("cell").distinct())


@query(PANEL_Z + "k as (select cell, cell % 7 as community, panel, ord, zs from t), m as (select community, panel, min(ord) as ord, avg(zs) as m from k group by all), b as (select community, max(m) as m, arg_max(panel, m) as panel from m group by community) select distinct k.cell, k.community, case when b.m > 0.1 then b.panel else 'Unknown' end as label from k join b using (community)", "cell community label")
def community_labels(spark, sf_dir):
    v = normalize.log_normalised(counts(spark, sf_dir), 1e6, 5)
    one = v.select("cell").distinct()
    z = labels.z_score(labels.panel_means(v, panels(spark, sf_dir), one), "score", "z", 1, ["panel"]).select("cell", "panel", "ord", F.col("z").alias("score"))
    return labels.community_label(z, one.withColumn("community", F.col("cell") % 7)).select("cell", "community", "label")


def dual(spark, sf_dir, rule):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error")).select(F.floor(F.col("event_id") / 3).cast("string").alias("b"), F.when(F.col("event_type") == "signup", "malignant").otherwise("immune").alias("l"))
    return labels.dual_labels(e, "b", "l", rule)


def dual_sql(pick: str, where: str = "") -> str:
    return f"select barcode, case when lo <> hi then {pick} else lo end as label, lo <> hi as dual from (select cast(event_id // 3 as varchar) as barcode, min(l) as lo, max(l) as hi from (select event_id, case event_type when 'signup' then 'malignant' else 'immune' end as l from events where event_type in ('signup', 'error') and event_id is not null) group by 1) {where}"


@query(dual_sql("null", "where lo = hi"), "barcode label dual")
def dual_label_excluded(spark, sf_dir):
    return dual(spark, sf_dir, "excluded")


@query(dual_sql("'malignant'"), "barcode label dual")
def dual_label_mal(spark, sf_dir):
    return dual(spark, sf_dir, "dual_mal")


@query(dual_sql("'immune'"), "barcode label dual")
def dual_label_comp(spark, sf_dir):
    return dual(spark, sf_dir, "dual_immune")


@query("select event_id, coalesce(s, 0) as size, case when s >= 10 then 'expanded' when s is null or s = 1 then 'non_expanded' else 'other' end as clonality from (select event_id, case when event_type <> 'view' then count(*) over (partition by case when event_type <> 'view' then user_id || event_type end) end as s from events)", "event_id size clonality")
def clonality_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("clone", F.when(F.col("event_type") != "view", F.concat(F.col("user_id").cast("string"), F.col("event_type"))))
    return labels.clonality(e, "event_id", "clone")


@query("select p_partkey from part where greatest(p_size, p_retailprice / 40) >= 30 and p_size < 40", "p_partkey")
def gated_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("b", F.col("p_retailprice") / 40).withColumn("a", F.col("p_size").cast("double"))
    return labels.gated(p, ["a", "b"], "p_size", 30, 40).select("p_partkey")


@query("select cast(c_custkey as varchar) as barcode, l.label from customer left join (select cast(o_custkey as varchar) as barcode, min(o_orderpriority) as label from orders group by 1) l on l.barcode = cast(c_custkey as varchar)", "barcode label")
def align_labels_left(spark, sf_dir):
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("barcode"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("barcode")).agg(F.min("o_orderpriority").alias("label"))
    return labels.align_labels(b, o.join(b, "barcode", "left_semi"))


@query("""
with l as (select distinct 's' || user_id % 10 as sample, cast(user_id as varchar) as b from events where event_type = 'view'), r as (select distinct 's' || user_id % 10 as sample, cast(user_id as varchar) as b from events where event_type = 'purchase')
select l.sample, count(*) as n_labels, coalesce(max(n.n), 0) as n_raw, count(r.b) as n_exact, count(*) - count(r.b) as n_absent from l left join r on r.sample = l.sample and r.b = l.b left join (select sample, count(*) as n from r group by sample) n on n.sample = l.sample group by l.sample
""", "sample n_labels n_raw n_exact n_absent")
def coverage_table(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("sample", F.concat(F.lit("s"), (F.col("user_id") % 10).cast("string")))
    wanted = e.where("event_type = 'view'").select("sample", F.concat_ws("_", "sample", F.col("user_id").cast("string")).alias("barcode"))
    return labels.coverage(wanted, e.where("event_type = 'purchase'").select("sample", F.col("user_id").cast("string").alias("barcode")))


@query("select n_name as specimen, r_name as donor, n_name is not null and r_name is not null as covered from nation full outer join region on n_regionkey = r_regionkey", "specimen donor covered")
def specimen_crosswalk(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    d = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("specimen"), F.col("r_name").alias("donor"))
    return labels.crosswalk(n.select(F.col("n_name").alias("specimen")), d)


@query("select o.o_orderkey, o.o_custkey % 50 as cluster, o.o_custkey % 9 as sample, b.c is not null as is_tumour from orders o left join (select distinct s_nationkey % 9 as s, s_suppkey % 50 as c from supplier) b on b.s = o.o_custkey % 9 and b.c = o.o_custkey % 50", "o_orderkey cluster sample is_tumour")
def tumour_blocks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 9).alias("sample"), (F.col("o_custkey") % 50).alias("cluster"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 9).cast("bigint").alias("sample"), (F.col("s_suppkey") % 50).alias("cluster"))
    return labels.block_members(o, b)


@query("select count(*) filter (where t is not null) as n_shared, count(*) filter (where t is null) as n_outside from (select distinct o_custkey as k from orders) o left join (select c_custkey as t from customer) on t = k", "n_shared n_outside")
def barcode_containment(spark, sf_dir):
    return labels.containment(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("select p_partkey as gene, p_brand as chrom, p_size as start, p_brand || case when p_size < 25 then 'p' else 'q' end as arm from part", "gene chrom start arm")
def gene_arms(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("chrom"), F.col("p_size").alias("start"))
    return labels.gene_arms(p, p.select("chrom").distinct().withColumn("centromere", F.lit(25)))


@query("select event_type, count(*) as n from events where event_type is not null group by 1", "event_type n")
def value_counts(spark, sf_dir):
    return labels.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'error') as error, count(*) filter (where event_type = 'purchase') as purchase from events group by user_id", "user_id click error purchase")
def label_crosstab(spark, sf_dir):
    return labels.crosstab(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "error", "purchase"])


@query("select p_brand, avg(p_retailprice) filter (where p_size % 3 = 0) as s0, avg(p_retailprice) filter (where p_size % 3 = 1) as s1, avg(p_retailprice) filter (where p_size % 3 = 2) as s2 from part group by p_brand", "p_brand *s0 *s1 *s2")
def pivot_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("s", F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string")))
    return labels.grid(p, "p_brand", "s", ["s0", "s1", "s2"], "p_retailprice")


@query("select user_id, count(*) filter (where event_type = 'purchase') as n_a, count(*) filter (where event_type = 'view') as n_b, count(*) filter (where event_type = 'purchase') >= 10 and count(*) filter (where event_type = 'view') >= 10 as qualifies from events where user_id is not null group by user_id", "user_id n_a n_b qualifies")
def patient_qualify(spark, sf_dir):
    return labels.qualifying(table(spark, sf_dir, "events"), "user_id", is_a(), is_b(), 10)


@query("select p_partkey from part where p_size >= 10 and p_size < 20 and p_retailprice >= 900 and p_retailprice < 1500", "p_partkey")
def spatial_tile(spark, sf_dir):
    return labels.in_tile(table(spark, sf_dir, "part"), "p_size", "p_retailprice", 10, 20, 900, 1500).select("p_partkey")


@query("select p_partkey from part, (select (min(p_size) + max(p_size)) / 2.0 as cx, (min(p_retailprice) + max(p_retailprice)) / 2.0 as cy from part) where abs(p_size - cx) < 12 and abs(p_retailprice - cy) < 300 and abs(p_size - cx) < 300 and abs(p_retailprice - cy) < 12", "p_partkey")
def spatial_centre(spark, sf_dir):
    return labels.in_centre(table(spark, sf_dir, "part"), "p_size", "p_retailprice", 12).select("p_partkey")


@query("select l_partkey as gene from lineitem group by 1 having count(distinct l_returnflag) = (select count(distinct l_returnflag) from lineitem)", "gene")
def shared_genes(spark, sf_dir):
    return labels.shared_genes(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("file"), F.col("l_partkey").alias("gene")))


@query("select n, sum(c) as total from (select 'a' as n, count(*) as c from orders where o_orderstatus = 'F' union all select 'b', count(*) from orders where o_orderstatus <> 'F') group by n", "n *total")
def mega_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    both = o.where("o_orderstatus = 'F'").withColumn("n", F.lit("a")).unionByName(o.where("o_orderstatus <> 'F'").withColumn("n", F.lit("b")))
    return both.groupBy("n").agg(F.count("*").cast("double").alias("total"))


@query("select max_brand, min_brand from (select arg_max(p_brand, m) as max_brand, arg_min(p_brand, m) as min_brand from (select p_brand, avg(p_retailprice) as m from part group by 1))", "max_brand min_brand")
def extreme_groups(spark, sf_dir):
    m = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    return m.agg(F.max_by("p_brand", "m").alias("max_brand"), F.min_by("p_brand", "m").alias("min_brand"))


@query("select o_custkey, string_agg(p || ':' || n, ',' order by n desc, p) as top from (select o_custkey, o_orderpriority as p, count(*) as n, row_number() over (partition by o_custkey order by count(*) desc, o_orderpriority) as r from orders group by 1, 2) where r <= 3 group by 1", "o_custkey top")
def top_arms(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("o_orderpriority").alias("p")))), 1, 3)
    return n.groupBy("o_custkey").agg(F.array_join(F.transform(top, lambda x: F.concat(x["p"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias("top"))


@query("select o_orderkey, ln(1 + o_totalprice) as l, exp(ln(1 + o_totalprice)) - 1 as back, least(greatest(o_totalprice - 150000, -10000), 10000) as clipped, try_cast(o_orderpriority as double) as num from orders", "o_orderkey *l *back *clipped *num")
def scalar_functions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", scalars.ln1p(F.col("o_totalprice")).alias("l"), scalars.expm1(scalars.ln1p(F.col("o_totalprice"))).alias("back"), scalars.clip(F.col("o_totalprice") - 150000, 10000.0).alias("clipped"), scalars.to_number(F.col("o_orderpriority")).alias("num"))


# Gates


@query("""
with e as (select cast(user_id as varchar) as barcode, event_type as sample, cast(user_id % 7 as varchar) as patient, event_type as label from events), b as (select barcode, count(distinct sample) as s, count(distinct patient) as p, count(distinct label) as l from e where barcode is not null group by 1)
select (select count(*) from e) as n_rows, (select count(*) from e where barcode is null or sample is null or patient is null or label is null) as n_bad_null, count(*) as n_barcodes, count(*) filter (where s > 1) as n_bad_sample, count(*) filter (where p > 1) as n_bad_patient, count(*) filter (where l > 1) as n_bad_label from b
""", "n_rows n_bad_null n_barcodes n_bad_sample n_bad_patient n_bad_label")
def label_identity_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("barcode"), F.col("event_type").alias("sample"), (F.col("user_id") % 7).cast("string").alias("patient"), F.col("event_type").alias("label"))
    return gates.label_identity(e)


@query("select count(*) as n_rows, count(*) filter (where value is null or isnan(value) or isinf(value)) as n_bad_value from events", "n_rows n_bad_value")
def marker_score_gate(spark, sf_dir):
    return gates.marker_scores(table(spark, sf_dir, "events"), ["value"])


@query("select count(*) filter (where a is not null and b is not null) as n_common, count(*) filter (where b is null) as n_bad_left, count(*) filter (where a is null) as n_bad_right from (select distinct c_custkey as a from customer) full outer join (select distinct o_custkey as b from orders) on a = b", "n_common n_bad_left n_bad_right")
def set_equality_gate(spark, sf_dir):
    return gates.same_sets(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


# Graphs


def knn_sql(k: int) -> str:
    return f"(select i, j, d, r from (select a.vec_id as i, b.vec_id as j, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (cast(z[1] as double) - cast(z[2] as double)) * (cast(z[1] as double) - cast(z[2] as double))))) as d, row_number() over (partition by a.vec_id order by d, b.vec_id) as r from embeddings a join embeddings b on a.vec_id <> b.vec_id) where r <= {k})"


def graph_sql(k: int) -> str:
    return f"(select least(i, j) as u, greatest(i, j) as v, min(d) as weight from {knn_sql(k)} group by all)"


@query(knn_sql(5), "i j *d r")
def knn_neighbours(spark, sf_dir):
    return graph.neighbours(cells(spark, sf_dir), "vec_id", "embedding", 5)


@query(graph_sql(15), "u v *weight")
def knn_graph(spark, sf_dir):
    return knn(spark, sf_dir, 15)


@query(f"select i, avg(d) as mean_d from {knn_sql(15)} group by i", "i *mean_d")
def mean_knn_distance(spark, sf_dir):
    return graph.mean_neighbour_distance(graph.neighbours(cells(spark, sf_dir), "vec_id", "embedding", 15))


FORMAN = f"""
(with e as {graph_sql(15)}, i as (select u as n, u, v, weight from e union all select v, u, v, weight from e)
select a.u, a.v, a.weight, 2 * a.weight - coalesce(sum(case when (b.u, b.v) <> (a.u, a.v) then a.weight / sqrt(a.weight * b.weight) end), 0) as forman from i a join i b on a.n = b.n group by a.u, a.v, a.weight)
"""


@query(FORMAN, "u v *weight *forman")
def forman_edges(spark, sf_dir):
    return graph.forman(knn(spark, sf_dir, 15))


NODE = """select n.vec_id as id, k.kappa, coalesce(d.degree, 0) as degree, coalesce(k.m, 0) as n_incident_measured, coalesce(k.m, 0) / nullif(d.degree, 0) as coverage_fraction, case when k.m > 0 then 'measured' else 'not_sampled' end as status
from embeddings n left join (select n, count(*) as degree from i group by n) d on d.n = n.vec_id left join (select n, avg(x) as kappa, count(*) as m from s group by n) k on k.n = n.vec_id"""


@query(f"with f as {FORMAN}, i as (select u as n from f union all select v from f), s as (select u as n, forman as x from f union all select v, forman from f) {NODE}", "id *kappa degree n_incident_measured *coverage_fraction status")
def forman_node_mean(spark, sf_dir):
    e = graph.forman(knn(spark, sf_dir, 15))
    return graph.node_summary(cells(spark, sf_dir).select(F.col("vec_id").alias("id")), e, e.select("u", "v", F.col("forman").alias("kappa")))


@query(f"with f as {graph_sql(15)}, p as (select * from f order by md5('0:edges:' || u || ':' || v), u, v limit 400), i as (select u as n from f union all select v from f), s as (select u as n, weight as x from p union all select v, weight from p) {NODE}", "id *kappa degree n_incident_measured *coverage_fraction status")
def node_degree_coverage(spark, sf_dir):
    e = knn(spark, sf_dir, 15)
    return graph.node_summary(cells(spark, sf_dir).select(F.col("vec_id").alias("id")), e, sampling.sampled_edges(e, 400).withColumnRenamed("weight", "kappa"))


CONTACTS = "(select 'chr' || l_orderkey % 3 as chrom, least(l_partkey % 60, l_suppkey % 60) as i, greatest(l_partkey % 60, l_suppkey % 60) as j, count(*) as count from lineitem group by all)"
OE = f"(select c.*, j - i as dist, e.expected, c.count / nullif(e.expected, 0) as oe from {CONTACTS} c join (select chrom, j - i as dist, median(count) as expected from {CONTACTS} where count > 0 group by all) e on e.chrom = c.chrom and e.dist = c.j - c.i)"


@query(f"select chrom, i, j, count, dist, expected, oe from {OE}", "chrom i j count dist *expected *oe")
def contact_oe(spark, sf_dir):
    return graph.observed_over_expected(contacts(spark, sf_dir)).select("chrom", "i", "j", "count", "dist", "expected", "oe")


@query(f"""
with b as (select chrom, count(*) as bins from (select chrom, i as x from {CONTACTS} where count > 0 union select chrom, j from {CONTACTS} where count > 0) group by chrom),
r as (select o.*, bins, row_number() over (partition by o.chrom order by oe desc, i, j) as r from {OE} o join b on b.chrom = o.chrom where dist >= 2 and oe >= 1.2)
select chrom, i as u, j as v, oe, count as obs, 1 / ln(1 + count) as weight from r where r <= 3 * bins
""", "chrom u v *oe obs *weight")
def contact_topk(spark, sf_dir):
    return graph.contact_graph(contacts(spark, sf_dir), 1.2)


@query(f"""
with e as {graph_sql(8)}, i as (select u as n, v as o from e union all select v, u from e), d as (select n, count(*) as degree from i group by n),
t as (select a.n, count(*) / 2 as t from i a join i b on a.n = b.n and a.o <> b.o join i c on c.n = a.o and c.o = b.o group by a.n)
select d.n as node, degree, coalesce(coalesce(t, 0) / nullif(degree * (degree - 1) / 2.0, 0), 0) as coefficient from d left join t on t.n = d.n
""", "node degree *coefficient")
def graph_clustering(spark, sf_dir):
    return graph.clustering(knn(spark, sf_dir, 8))


def shops(spark, sf_dir):
    return graph.knn_graph(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal")).alias("x")), "id", "x", 1)


SHOPS = "(select least(i, j) as u, greatest(i, j) as v from (select a.s_suppkey as i, b.s_suppkey as j, row_number() over (partition by a.s_suppkey order by abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) as r from supplier a join supplier b on a.s_suppkey <> b.s_suppkey) where r <= 1 group by all)"


@query(f"with recursive e as (select u as a, v as b from {SHOPS} union select v, u from {SHOPS}), reach as (select s_suppkey as id, s_suppkey as c from supplier union select e.b, reach.c from reach join e on e.a = reach.id) select id, min(c) as component from reach group by id", "id component")
def connected_components(spark, sf_dir):
    return graph.components(shops(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


@query(f"""
with recursive e as (select u, v from {graph_sql(8)}), i as (select u as n, v as o from e union all select v, u from e), d as (select n, count(*) as degree from i group by n),
t as (select a.n, count(*) / 2 as t from i a join i b on a.n = b.n and a.o <> b.o join i c on c.n = a.o and c.o = b.o group by a.n),
c as (select sum(coalesce(coalesce(t, 0) / nullif(degree * (degree - 1) / 2.0, 0), 0)) as s from d left join t on t.n = d.n),
reach as (select vec_id as id, vec_id as c from embeddings union select i.o, reach.c from reach join i on i.n = reach.id)
select (select count(*) from embeddings) as n_nodes, (select count(*) from e) as n_edges, 2.0 * (select count(*) from e) / (select count(*) from embeddings) as mean_degree, (select s from c) / (select count(*) from embeddings) as mean_clustering, (select count(distinct m) from (select id, min(c) as m from reach group by id)) as n_components
""", "n_nodes n_edges *mean_degree *mean_clustering n_components")
def graph_summary(spark, sf_dir):
    return graph.graph_summary(cells(spark, sf_dir).select(F.col("vec_id").alias("id")), pinned(knn(spark, sf_dir, 8), "edges"))


# Classifiers

LABELLED = "(select vec_id as id, label % 2 = 1 as y, embedding[1] as score from embeddings)"


def labelled(spark, sf_dir):
    return cells(spark, sf_dir).select(F.col("vec_id").alias("id"), (F.col("label") % 2 == 1).alias("y"), F.get("embedding", F.lit(0)).cast("double").alias("score"), F.col("embedding").cast("array<double>").alias("features"))


@query(f"with r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from {LABELLED}) select (sum(r) filter (where y) - count(*) filter (where y) * (count(*) filter (where y) + 1) / 2.0) / (count(*) filter (where y) * count(*) filter (where not y)) as auc from r", "*auc")
def roc_auc(spark, sf_dir):
    return ml.roc_auc(labelled(spark, sf_dir), "y", "score")


@query(f"with v as (select score, count(*) as n, count(*) filter (where y) as p from {LABELLED} group by score), c as (select p, sum(p) over w as cp, sum(n) over w as cn from v window w as (order by score desc)) select sum(p * cp / cn) / sum(p) as ap from c", "*ap")
def average_precision(spark, sf_dir):
    return ml.average_precision(labelled(spark, sf_dir), "y", "score")


@query(f"with p as (select y, score >= 0 as yes from {LABELLED}) select avg(case when y = yes then 1.0 else 0 end) as accuracy, 2.0 * count(*) filter (where y and yes) / nullif(2 * count(*) filter (where y and yes) + count(*) filter (where y <> yes), 0) as f1 from p", "*accuracy *f1")
def accuracy_f1(spark, sf_dir):
    return ml.accuracy_f1(labelled(spark, sf_dir), "y", "score", 0.0)


@query(f"select id, y, row_number() over (partition by y order by {h('split-3', 'id')}, id) <= ceil(count(*) over (partition by y) * 0.2) as test from {LABELLED}", "id y test")
def stratified_split(spark, sf_dir):
    return ml.stratified_split(labelled(spark, sf_dir), "y", "id", 0.2, 3).select("id", "y", "test")


@query()
def logistic_auc(spark, sf_dir):
    return ml.repeated_auc(labelled(spark, sf_dir), "y", "id", "features")


@query()
def leave_one_out(spark, sf_dir):
    return ml.leave_one_group_out(labelled(spark, sf_dir).withColumn("cohort", F.col("id") % 3), "cohort", "y", "features")


# Whole analyses


def _points(spark, sf_dir):
    return cells(spark, sf_dir).withColumn("patient", F.col("vec_id") % 6)


def odd() -> Column:
    return F.col("label") % 2 == 1


@query()
def meta_flagship(spark, sf_dir):
    return composites.patient_meta(_points(spark, sf_dir), "vec_id", "embedding", "patient", odd())


@query()
def ollivier_edges(spark, sf_dir):
    e = pinned(knn(spark, sf_dir, 10), "edges")
    return curvature.ollivier_edges(e, sampling.sampled_edges(e, 4000))


@query()
def ollivier_node(spark, sf_dir):
    return composites.node_curvature(cells(spark, sf_dir), "vec_id", "embedding")[0]


@query()
def two_group_contrast(spark, sf_dir):
    return composites.two_group(cells(spark, sf_dir), "vec_id", "embedding", odd())


@query()
def forman_ollivier_correlation(spark, sf_dir):
    return composites.forman_against_ollivier(pinned(knn(spark, sf_dir, 15), "edges"))


@query()
def bakry_emery(spark, sf_dir):
    nodes = cells(spark, sf_dir).select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("group"))
    return composites.curvature_dimension(pinned(knn(spark, sf_dir, 10), "edges"), nodes)


@query()
def depth_stratified(spark, sf_dir):
    nodes = composites.node_curvature(cells(spark, sf_dir), "vec_id", "embedding")[0]
    depth = cells(spark, sf_dir).select(F.col("vec_id").alias("id"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x)).alias("depth"), "label")
    return composites.by_depth(nodes, depth, odd())


@query()
def spatial_dual_graph(spark, sf_dir):
    p = cells(spark, sf_dir).withColumn("place", F.slice("embedding", 1, 2))
    return composites.dual_graph(p, "vec_id", "place", "embedding", odd())


@query()
def ward_subclones(spark, sf_dir):
    return ward.subclones(_points(spark, sf_dir), "patient", "vec_id", "embedding")


@query()
def subclone_kruskal(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("score", F.get("embedding", F.lit(0)).cast("double"))
    return composites.subclone_contrast(p, "patient", "vec_id", "embedding", "score")


@query()
def contact_curvature(spark, sf_dir):
    return composites.contact_curvature(contacts(spark, sf_dir, 30), 1.1)


@query()
def louvain_communities(spark, sf_dir):
    return communities.communities(knn(spark, sf_dir, 10))


@query()
def delaunay_graph(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return delaunay.delaunay_graph(s.withColumn("x", F.col("s_nationkey") + F.col("s_suppkey") / 1000.0), "s_suppkey", "x", "s_acctbal")


@query()
def pseudotime(spark, sf_dir):
    return diffusion.pseudotime(cells(spark, sf_dir), "vec_id", "embedding", 0)


@query()
def batch_correction(spark, sf_dir):
    out = batches.batch_corrected(_points(spark, sf_dir), "vec_id", "patient", "embedding")
    return out.select("id", F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))


@query()
def kmeans_batches(spark, sf_dir):
    return normalize.pseudo_batches(cells(spark, sf_dir), "embedding", 8).groupBy("batch").agg(F.count("*").alias("n"))


@query()
def mixed_effects(spark, sf_dir):
    return spark.createDataFrame([models.mixed_effect(scores(spark, sf_dir), "user_id", "value", is_a())])


@query()
def response_logit(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n_cells"), (F.max("user_id") % 2).alias("responder"))
    out = models.logit(d, "responder", ["mean_value", "n_cells"])
    return spark.createDataFrame([(out["log_likelihood"], out["log_likelihood_null"], out["llr_p"], out["n"])], "log_likelihood double, log_likelihood_null double, llr_p double, n long")


@query()
def pca_embedding(spark, sf_dir):
    out = composites.from_counts(counts(spark, sf_dir), 50, 10)
    return out.select("cell", F.sqrt(F.aggregate("pcs", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))


@query(f"""
with v as ({LOGN}), g as (select p_partkey as gene, p_brand as arm, row_number() over (partition by p_brand order by p_partkey) as i, count(*) over (partition by p_brand) as n from part where p_partkey in (select gene from v)),
d as (select c.cell, g.gene, g.arm, g.i, g.n, coalesce(v.value, 0) as value from (select distinct cell from v) c cross join g left join v on v.cell = c.cell and v.gene = g.gene),
b as (select gene, avg(value) as base from d where cell % 4 = 0 group by gene),
x as (select cell, arm, list(least(greatest(value - base, -3), 3) order by i) as xs, any_value(n) as n, least(any_value(n), 100) as w from d join b using (gene) group by cell, arm),
o as (select cell, arm, list_transform(range(1, n - w % 2 + 1), lambda k: list_avg(list_transform(range(k + w % 2 - (w - 1) // 2, k + w % 2 + w // 2 + 1), lambda j: xs[least(greatest(j, 1), n)]))) as smooth from x)
select cell, arm, list_avg(smooth) as score from o
""", "cell arm *score")
def arm_copy_number(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("arm"), F.col("p_partkey").alias("start"))
    v = normalize.log_normalised(counts(spark, sf_dir), 1e6, 5)
    return normalize.arm_scores(v, p, v.where("cell % 4 = 0").select("cell").distinct())


SIGNATURE = f"""
with v as ({LOGN}), p as (select case p_partkey % 40 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as panel, p_partkey % 40 as ord, p_partkey as gene from part where p_partkey % 40 < 3),
m as (select gene, round(mean, 9) as mean from ({MOMENTS})), q as (select quantile_cont(mean, [i / 25.0 for i in range(1, 25)]) as e from m),
b as (select gene, len(list_filter(e, lambda x: x <= mean)) as bin from m, q),
k as (select panel, gene, row_number() over (partition by panel, bin order by {h('controls', 'gene')}, gene) as r from (
    select w.panel, b.gene, b.bin from (select distinct panel, bin from p join b using (gene)) w join b using (bin) where not exists (select 1 from p where p.panel = w.panel and p.gene = b.gene))),
s as (select panel, ord, gene, 1 as own from p where gene in (select gene from v) union all select k.panel, o.ord, gene, 0 from k join (select distinct panel, ord from p) o using (panel) where r <= 50),
z as (select panel, ord, own, count(*) as size from s group by all),
f as (select c.cell, z.panel, z.ord, z.own, coalesce(t.s, 0) / z.size as score from (select distinct cell from v) c cross join z left join (select cell, panel, own, sum(value) as s from v join s using (gene) group by all) t on t.cell = c.cell and t.panel = z.panel and t.own = z.own),
d as (select cell, panel, ord, max(score) filter (where own = 1) - coalesce(max(score) filter (where own = 0), 0) as score from f group by all),
r as (select *, row_number() over (partition by cell order by score desc, ord) as r from d),
t as (select cell, max(panel) filter (where r = 1) as panel, max(score) filter (where r = 1) as top, max(score) filter (where r = 2) as second from r group by cell)
select cell, case when top > 0 and top - second >= 0.05 then panel else 'Unknown' end as label, top, second from t
"""


@query(SIGNATURE, "cell label *top *second")
def signature_labels(spark, sf_dir):
    v = normalize.log_normalised(counts(spark, sf_dir), 1e6, 5)
    p = panels(spark, sf_dir)
    level = normalize.gene_moments(v).select("gene", F.round("mean", 9).alias("mean"))
    controls = None
    for name, _, _ in PANELS:
        one = sampling.control_genes(level, "gene", "mean", p.where(F.col("panel") == name)).select(F.lit(name).alias("panel"), "gene")
        controls = one if controls is None else controls.unionByName(one)
    return labels.signature_label(labels.signature_scores(v, p, v.select("cell").distinct(), controls))


@query()
def bootstrap_cliff(spark, sf_dir):
    return meta.interval(meta.bootstrap_cliff(scores(spark, sf_dir), "event_id", "value", is_a()))


@query()
def bootstrap_cliff_counts(spark, sf_dir):
    return meta.interval(meta.bootstrap_cliff_counts(scores(spark, sf_dir), "value", is_a()))


@query("select user_id as patient, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) filter (where event_type = 'purchase') as n_a, count(*) filter (where event_type = 'view') as n_b from events where ts is not null group by all", "patient day n_a n_b")
def arm_counts_by_day(spark, sf_dir):
    from ..streaming.patients import arm_counts

    out = arm_counts(table(spark, sf_dir, "events"), "user_id", "ts", is_a(), is_b())
    return out.select("patient", F.date_format("start", "yyyy-MM-dd").alias("day"), "n_a", "n_b")
