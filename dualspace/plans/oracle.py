"""DuckDB twins of the registered plans (the correctness oracle).

Written against the same parquet views; dialect notes: `//` is integer
division, lists are 1-based, lambdas use the `lambda x: ...` form.
"""

from __future__ import annotations

from dualspace.functions.stopwords import ENGLISH
from dualspace.plans import oracle_texts as texts
from dualspace.plans.oracle_texts import filled

# -- embedding fixture: pools, chunks, queries, gold, query x chunk distances --
FIX = """
with chunks as (
  select vec_id // 50 as pool_id, vec_id as chunk_idx, label, cast(embedding as double[]) as x
  from embeddings where vec_id % 25 <> 0),
queries as (
  select vec_id // 50 as pool_id, vec_id as qid, label, cast(embedding as double[]) as q
  from embeddings where vec_id % 25 = 0),
gold as (
  select q.qid, c.chunk_idx from queries q join chunks c on q.pool_id = c.pool_id and q.label = c.label),
qx0 as (
  select q.pool_id, q.qid, c.chunk_idx, list_dot_product(q.q, c.x) as ip,
         sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(c.x, c.x)) as den
  from queries q join chunks c on q.pool_id = c.pool_id),
qx as (
  select pool_id, qid, chunk_idx, ip,
         case when den = 0 then 1.0 else 1.0 - ip / den end as dx,
         row_number() over (partition by qid order by ip desc, chunk_idx) as rank_ip,
         row_number() over (partition by qid order by case when den = 0 then 1.0 else 1.0 - ip / den end, chunk_idx) as rank_dx
  from qx0)
"""

# every vector a chunk; pools of 50 ids, or the whole table as one pool
ALL = """
with chunks as (
  select vec_id // 50 as pool_id, vec_id as chunk_idx, label, cast(embedding as double[]) as x from embeddings)
"""
ONE_POOL = ALL.replace("vec_id // 50 as pool_id", "0::bigint as pool_id")

SQL: dict[str, str] = {}

SQL["naive_topk"] = FIX + """
select pool_id, qid, chunk_idx, rank_ip as rank, round(ip, 6) as sim from qx where rank_ip <= 5
"""

SQL["anchors"] = FIX + """
select pool_id, qid, chunk_idx, round(dx, 6) as dx from qx where dx <= 0.85 or rank_dx <= 3
"""

SQL["anchors_tau070"] = FIX + """
select pool_id, qid, chunk_idx, round(dx, 6) as dx from qx where dx <= 0.70 or rank_dx <= 3
"""

SQL["strict_start_set"] = FIX + """
select pool_id, qid, chunk_idx, round(dx, 6) as dx from qx where dx <= 0.85
"""


# -- SQL text builders for fixed-dimension vector arithmetic ------------------
def _sum(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def sql_sq(a: str, b: str, n: int) -> str:
    return _sum([f"({a}[{k}] - {b}[{k}]) * ({a}[{k}] - {b}[{k}])" for k in range(1, n + 1)])


def sql_dot(a: str, b: str, n: int) -> str:
    return _sum([f"{a}[{k}] * {b}[{k}]" for k in range(1, n + 1)])


def z_coordinate(k: int, n: int) -> str:
    """Coordinate k of the supplied space of n dimensions, before centring."""
    return _sum([f"x[{j}]" for j in range(k, 65, n)]) if n in (2, 3) else f"x[{k}]"


def z_ctes(n: int) -> str:
    """The supplied structural space: z_k = coordinate - pool mean, lam_k = pool var_samp."""
    ms = ", ".join(f"avg(y[{k}]) as m{k}" for k in range(1, n + 1))
    vs = ", ".join(f"var_samp(y[{k}]) as v{k}" for k in range(1, n + 1))
    zs = ", ".join(f"c.y[{k}] - s.m{k}" for k in range(1, n + 1))
    ls = ", ".join(f"s.v{k}" for k in range(1, n + 1))
    ys = ", ".join(z_coordinate(k, n) for k in range(1, n + 1))
    return f""",
ych as (select pool_id, chunk_idx, [{ys}] as y from chunks),
zstat as (select pool_id, {ms}, {vs} from ych group by pool_id),
z as (select c.pool_id, c.chunk_idx, [{zs}] as z, [{ls}] as lam
      from ych c join zstat s on c.pool_id = s.pool_id),
psize as (select pool_id, count(*) as n from chunks group by pool_id)
"""


def sample_cte(name: str, src: str, n: int, seed) -> str:
    return f""",
{name} as (select * from (
  select *, row_number() over (partition by pool_id
    order by md5(concat('{seed}', ':', cast(chunk_idx as varchar))), chunk_idx) as r_
  from {src}) where r_ <= {n})
"""


def pairs_cte(name: str, src: str) -> str:
    return f""",
{name} as (select a.pool_id, a.chunk_idx as i, b.chunk_idx as j, a.z as z_i, b.z as z_j,
                  a.lam as lam
           from {src} a join {src} b on a.pool_id = b.pool_id and a.chunk_idx < b.chunk_idx)
"""


def metric_ctes(n: int) -> str:
    """Per-pool metric state: max_dot, rbf gamma (sample 200, seed 0)."""
    return (z_ctes(n) + sample_cte("rsamp", "z", 200, 0) + pairs_cte("rpairs", "rsamp") + f""",
maxdot as (select pool_id, max({sql_dot('z', 'z', n)}) as max_dot from z group by pool_id),
rmed as (select pool_id, quantile_cont(sq, 0.5) as med from (
  select pool_id, {sql_sq('z_i', 'z_j', n)} as sq from rpairs) where sq > 0 group by pool_id),
rgamma as (select p.pool_id, 1.0 / greatest(coalesce(m.med, 1.0), 1e-8) as gamma
           from psize p left join rmed m on p.pool_id = m.pool_id)
""" + sample_cte("esamp", "z", 50, 42) + pairs_cte("epairs", "esamp"))


def metric_expr(metric: str, n: int, zi: str = "z_i", zj: str = "z_j", lam: str = "lam") -> str:
    if metric == "euclidean":
        return f"sqrt({sql_sq(zi, zj, n)})"
    if metric == "mahalanobis":
        return "sqrt(" + _sum([f"({zi}[{k}] - {zj}[{k}]) * ({zi}[{k}] - {zj}[{k}]) / ({lam}[{k}] + 1e-8)" for k in range(1, n + 1)]) + ")"
    if metric == "cosine":
        den = f"(sqrt({sql_dot(zi, zi, n)}) * sqrt({sql_dot(zj, zj, n)}))"
        return f"(case when {den} = 0 then 1.0 else 1.0 - {sql_dot(zi, zj, n)} / {den} end)"
    if metric == "dot":
        return f"(max_dot - {sql_dot(zi, zj, n)})"
    if metric == "rbf":
        return f"sqrt(greatest(2.0 - 2.0 * exp(-gamma * {sql_sq(zi, zj, n)}), 0.0))"
    raise ValueError(metric)


NZ = 64
METRIC_NAMES = ["mahalanobis", "euclidean", "cosine", "dot", "rbf"]
QUERY_PAIRS = """,
qpairs as (select a.pool_id, a.chunk_idx as i, b.chunk_idx as j, a.z as z_i, b.z as z_j, a.lam as lam
           from z a join z b on a.pool_id = b.pool_id and a.chunk_idx <> b.chunk_idx where a.chunk_idx % 25 = 0)
"""

for _m in METRIC_NAMES:
    SQL[f"dist_{_m}"] = ALL + metric_ctes(NZ) + QUERY_PAIRS + f"""select p.pool_id, p.i, p.j, round({metric_expr(_m, NZ)}, 6) as d
from qpairs p join maxdot using (pool_id) join rgamma using (pool_id)"""

SQL["rbf_gamma"] = ALL + metric_ctes(NZ) + "select pool_id, round(gamma, 6) as gamma from rgamma"


def epsilon_sql(pools: str) -> str:
    return pools + metric_ctes(NZ) + ",\nalld as (\n" + "\nunion all\n".join(
        f"select p.pool_id, '{m}' as metric, {metric_expr(m, NZ)} as d "
        f"from epairs p join maxdot using (pool_id) join rgamma using (pool_id)" for m in METRIC_NAMES) + """)
select ps.pool_id, mm.metric, round(coalesce(e.eps, 1.0), 6) as epsilon
from psize ps cross join (select distinct metric from alld) mm
left join (select pool_id, metric, quantile_cont(d, 0.1) as eps from alld group by pool_id, metric) e
  on e.pool_id = ps.pool_id and e.metric = mm.metric
"""


SQL["epsilon_by_metric"] = epsilon_sql(ALL)
SQL["one_pool_samples"] = epsilon_sql(ONE_POOL) + "union all select pool_id, 'gamma', round(gamma, 6) from rgamma"

# k-NN graph, local covariance and Bhattacharyya on the 2-d supplied space.
def knn_ctes(n: int) -> str:
    return f""",
allp as (select a.pool_id, a.chunk_idx as i, b.chunk_idx as j, {sql_sq('a.z', 'b.z', n)} as d2
         from z a join z b on a.pool_id = b.pool_id),
knn as (select r.pool_id, i, j, rank, d2 from (
          select *, row_number() over (partition by pool_id, i order by d2, j) as rank from allp) r
        join psize s on r.pool_id = s.pool_id
        where rank <= greatest(2, least(10, s.n - 1)))
"""


LOCAL_COV = """,
lcov0 as (select k.pool_id, k.i as chunk_idx,
            covar_samp(z.z[1], z.z[1]) as a11, covar_samp(z.z[1], z.z[2]) as a12,
            covar_samp(z.z[2], z.z[2]) as a22
          from knn k join z on z.pool_id = k.pool_id and z.chunk_idx = k.j group by k.pool_id, k.i),
lcov as (select l.pool_id, l.chunk_idx,
           coalesce(a11, s.v1) + 1e-6 as c11, coalesce(a12, 0.0) as c12, coalesce(a22, s.v2) + 1e-6 as c22
         from lcov0 l join zstat s on l.pool_id = s.pool_id),
lcovd as (select *, ln(c11 * c22 - c12 * c12) as logdet from lcov)
"""
KNN2 = z_ctes(2) + knn_ctes(2) + LOCAL_COV

SQL["knn_graph"] = ALL + z_ctes(NZ) + knn_ctes(NZ) + "select pool_id, i, j, rank, round(d2, 6) as d2 from knn"
SQL["knn_graph_one_pool"] = ONE_POOL + z_ctes(NZ) + knn_ctes(NZ) + "select pool_id, i, j, rank, round(d2, 6) as d2 from knn"

SQL["local_cov"] = ALL + KNN2 + """select pool_id, chunk_idx, round(c11, 6) as c11, round(c12, 6) as c12,
  round(c22, 6) as c22, round(logdet, 6) as logdet from lcovd"""


def bhat2_expr(zi="z_i", zj="z_j") -> str:
    s11, s12, s22 = "((ci.c11 + cj.c11) / 2)", "((ci.c12 + cj.c12) / 2)", "((ci.c22 + cj.c22) / 2)"
    det = f"({s11} * {s22} - {s12} * {s12})"
    d1, d2 = f"({zi}[1] - {zj}[1])", f"({zi}[2] - {zj}[2])"
    quad = f"(({d1} * {d1} * {s22} - 2 * {d1} * {d2} * {s12} + {d2} * {d2} * {s11}) / {det})"
    return f"greatest(0.125 * {quad} + 0.5 * (ln({det}) - 0.5 * (ci.logdet + cj.logdet)), 0.0)"


SQL["dist_bhattacharyya_2d"] = ALL + KNN2 + QUERY_PAIRS + f"""
select p.pool_id, p.i, p.j, round({bhat2_expr()}, 6) as d
from qpairs p join lcovd ci on ci.pool_id = p.pool_id and ci.chunk_idx = p.i
join lcovd cj on cj.pool_id = p.pool_id and cj.chunk_idx = p.j
"""


# three dimensions: the covariances by their upper triangles, S = LDL' by elimination
TRIANGLE = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]
LOCAL_COV3 = f""",
lcov0 as (select k.pool_id, k.i as chunk_idx, {', '.join(f'covar_samp(z.z[{r}], z.z[{c}]) as a{r}{c}' for r, c in TRIANGLE)}
          from knn k join z on z.pool_id = k.pool_id and z.chunk_idx = k.j group by k.pool_id, k.i),
lcov as (select l.pool_id, l.chunk_idx,
           {', '.join(f'coalesce(a{r}{c}, s.v{r}) + 1e-6 as c{r}{c}' if r == c else f'coalesce(a{r}{c}, 0.0) as c{r}{c}' for r, c in TRIANGLE)}
         from lcov0 l join zstat s on l.pool_id = s.pool_id)"""


def eliminated(name: str, source: str) -> str:
    """`source` (c11 .. c33) with the factors of its matrices: pivots c11, p2, p3, multipliers l21, l31, l32, and logdet."""
    return f""",
{name}1 as (select *, c12 / c11 as l21, c13 / c11 as l31, c22 - c12 * c12 / c11 as p2 from {source}),
{name}2 as (select *, (c23 - c13 * l21) / p2 as l32 from {name}1),
{name}3 as (select *, c33 - c13 * l31 - l32 * l32 * p2 as p3 from {name}2),
{name} as (select *, ln(c11) + ln(p2) + ln(p3) as logdet from {name}3)"""


KNN3 = ALL + z_ctes(3) + knn_ctes(3) + LOCAL_COV3 + eliminated("lcovd", "lcov")
SQL["local_cov_3d"] = KNN3 + " select pool_id, chunk_idx, " + ", ".join(f"round(c{r}{c}, 6) as c{r}{c}" for r, c in TRIANGLE) + """,
  round(logdet, 6) as logdet from lcovd"""
SQL["dist_bhattacharyya_3d"] = KNN3 + f""",
mean as (select zi.pool_id, ci.chunk_idx as i, cj.chunk_idx as j, (ci.logdet + cj.logdet) / 2 as own,
           {', '.join(f'zi.z[{k}] - zj.z[{k}] as x{k}' for k in (1, 2, 3))},
           {', '.join(f'(ci.c{r}{c} + cj.c{r}{c}) / 2 as c{r}{c}' for r, c in TRIANGLE)}
         from z zi join z zj on zj.pool_id = zi.pool_id and zj.chunk_idx <> zi.chunk_idx
         join lcovd ci on ci.pool_id = zi.pool_id and ci.chunk_idx = zi.chunk_idx
         join lcovd cj on cj.pool_id = zj.pool_id and cj.chunk_idx = zj.chunk_idx)""" + eliminated("half", "mean") + """,
solved as (select *, x2 - l21 * x1 as y2 from half),
quad as (select *, x1 * x1 / c11 + y2 * y2 / p2 + (x3 - l31 * x1 - l32 * y2) ** 2 / p3 as q from solved)
select pool_id, i, j, round(greatest(q / 8 + (logdet - own) / 2, 0.0), 6) as d from quad"""


# -- decay traversal, unrolled hop by hop --------------------------------------
def decay_sql(metric: str, tau: float, gamma: float, start: str = "anchors", hops: int = 2) -> str:
    if metric == "bhattacharyya":
        base = FIX + KNN2 + sample_cte("esamp", "z", 50, 42) + pairs_cte("epairs", "esamp") + f""",
eps0 as (select p.pool_id, quantile_cont({bhat2_expr()}, 0.1) as e
         from epairs p join lcovd ci on ci.pool_id = p.pool_id and ci.chunk_idx = p.i
         join lcovd cj on cj.pool_id = p.pool_id and cj.chunk_idx = p.j group by p.pool_id)"""
        hop_dist = bhat2_expr("zi.z", "zj.z")
        extra = ("join lcovd ci on ci.pool_id = zi.pool_id and ci.chunk_idx = zi.chunk_idx "
                 "join lcovd cj on cj.pool_id = zj.pool_id and cj.chunk_idx = zj.chunk_idx")
    else:
        base = FIX + metric_ctes(NZ) + f""",
st as (select m.pool_id as st_pool, m.max_dot, g.gamma from maxdot m join rgamma g on m.pool_id = g.pool_id),
eps0 as (select p.pool_id, quantile_cont({metric_expr(metric, NZ)}, 0.1) as e
         from epairs p join st on st.st_pool = p.pool_id group by p.pool_id)"""
        hop_dist = metric_expr(metric, NZ, "zi.z", "zj.z", "zi.lam")
        extra = "join st on st.st_pool = zi.pool_id"
    where0 = f"dx <= {tau!r} or rank_dx <= 3" if start == "anchors" else f"dx <= {tau!r}"
    sql = base + f""",
eps as (select ps.pool_id, coalesce(e.e, 1.0) as epsilon from psize ps left join eps0 e on e.pool_id = ps.pool_id),
h0 as (select pool_id, qid, chunk_idx from qx where {where0})"""
    for t in range(1, hops + 1):
        bound = tau * (gamma ** t)
        vis = " union all ".join(f"select qid, chunk_idx from h{u}" for u in range(t))
        sql += f""",
c{t} as (select x.pool_id, x.qid, x.chunk_idx from qx x where x.dx <= {bound!r}
        and not exists (select 1 from ({vis}) v where v.qid = x.qid and v.chunk_idx = x.chunk_idx)),
h{t} as (select distinct c.pool_id, c.qid, c.chunk_idx from c{t} c
        join z zj on zj.pool_id = c.pool_id and zj.chunk_idx = c.chunk_idx
        join h{t - 1} f on f.qid = c.qid
        join z zi on zi.pool_id = f.pool_id and zi.chunk_idx = f.chunk_idx
        {extra}
        join eps e on e.pool_id = c.pool_id
        where {hop_dist} <= e.epsilon)"""
    sql += ",\nhops as (" + " union all ".join(
        f"select pool_id, qid, {t} as hop, chunk_idx from h{t}" for t in range(hops + 1)) + ")\n"
    return sql


SQL["decay_hops"] = decay_sql("mahalanobis", 0.85, 1.1) + "select * from hops"
SQL["decay_hops_alt"] = decay_sql("euclidean", 0.70, 1.3) + "select * from hops"
SQL["decay_hops_cosine"] = decay_sql("cosine", 0.85, 1.1) + "select * from hops"
SQL["decay_hops_dot"] = decay_sql("dot", 0.85, 1.1) + "select * from hops"
SQL["decay_hops_rbf"] = decay_sql("rbf", 0.85, 1.1) + "select * from hops"
SQL["decay_hops_bhattacharyya_2d"] = decay_sql("bhattacharyya", 0.85, 1.1) + "select * from hops"
SQL["decay_strict"] = decay_sql("euclidean", 0.85, 1.1, start="strict") + "select * from hops"
# all principal components: euclidean distances are those of the centred vectors
SQL["decay_pca"] = decay_sql("euclidean", 0.85, 1.1) + "select * from hops"
SQL["decay_one_pool"] = (decay_sql("mahalanobis", 0.85, 1.1) + "select * from hops").replace("vec_id // 50 as pool_id", "cast(0 as bigint) as pool_id")
SQL["decay_capped"] = decay_sql("mahalanobis", 0.85, 1.1) + """
select pool_id, qid, role, rank, chunk_idx from (
  select *, row_number() over (partition by qid, role order by chunk_idx) as rank from (
    select distinct pool_id, qid, case when hop = 0 then 'primary' else 'structural' end as role, chunk_idx
    from hops))
where rank <= case when role = 'primary' then 5 else 10 end
"""


# -- random walk with restart: a recursive CTE, ten steps ----------------------
def walk_sql(metric: str, tau: float, start: str, alpha: float = 0.85, beta: float = 1.0, iters: int = 10) -> str:
    where0 = f"dx <= {tau!r} or rank_dx <= 3" if start == "anchors" else f"dx <= {tau!r}"
    dist = metric_expr(metric, NZ, "zi.z", "zj.z", "zi.lam")
    base = FIX.replace("with chunks", "with recursive chunks", 1) + metric_ctes(NZ) + f""",
st as (select m.pool_id as st_pool, m.max_dot, g.gamma from maxdot m join rgamma g on m.pool_id = g.pool_id),
kern as (select zi.pool_id, zi.chunk_idx as i, zj.chunk_idx as j, exp(-{beta!r} * {dist}) as k
         from z zi join z zj on zi.pool_id = zj.pool_id join st on st.st_pool = zi.pool_id),
rs as (select pool_id, i, sum(k) as r from kern group by pool_id, i),
pm as (select kern.pool_id, kern.i, kern.j, case when r = 0 then 0.0 else k / r end as p
       from kern join rs on rs.pool_id = kern.pool_id and rs.i = kern.i),
seeds as (select pool_id, qid, chunk_idx from qx where {where0}),
ns as (select qid, count(*) as c from seeds group by qid),
vvec as (select s.pool_id, s.qid, s.chunk_idx, 1.0 / ns.c as v from seeds s join ns on ns.qid = s.qid
         union all
         select q.pool_id, q.qid, c.chunk_idx, 1.0 / ps.n as v from queries q
         join psize ps on ps.pool_id = q.pool_id join chunks c on c.pool_id = q.pool_id
         where q.qid not in (select qid from ns)),
pi(it, pool_id, qid, chunk_idx, mass) as (
  select 0, pool_id, qid, chunk_idx, v from vvec
  union all
  select y.it + 1, y.pool_id, y.qid, y.j, {1.0 - alpha!r} * coalesce(vv.v, 0.0) + {alpha!r} * y.y
  from (select pi.it, pi.pool_id, pi.qid, pm.j, sum(pi.mass * pm.p) as y
        from pi join pm on pm.pool_id = pi.pool_id and pm.i = pi.chunk_idx
        where pi.it < {iters} group by pi.it, pi.pool_id, pi.qid, pm.j) y
  left join vvec vv on vv.qid = y.qid and vv.chunk_idx = y.j),
final as (select pool_id, qid, chunk_idx, mass from pi where it = {iters})
"""
    return base


SQL["ppr_mass"] = walk_sql("mahalanobis", 0.85, "anchors") + \
    "select pool_id, qid, chunk_idx, round(mass, 6) as mass from final"
SQL["ppr_pca"] = walk_sql("euclidean", 0.85, "anchors") + \
    "select pool_id, qid, chunk_idx, round(mass, 6) as mass from final"
SQL["walk_strict"] = walk_sql("euclidean", 0.70, "strict") + \
    "select pool_id, qid, chunk_idx, round(mass, 6) as mass from final"
SQL["ppr_mass_one_pool"] = walk_sql("euclidean", 0.85, "anchors").replace("vec_id // 50 as pool_id", "cast(0 as bigint) as pool_id") + \
    "select pool_id, qid, chunk_idx, round(mass, 6) as mass from final"
SQL["ppr_topk"] = walk_sql("mahalanobis", 0.85, "anchors") + """,
top as (select * from (select *, row_number() over (partition by qid order by mass desc, chunk_idx) as rk
        from final) where rk <= 5),
tagged as (select t.*, s.chunk_idx is not null as is_seed from top t
           left join seeds s on s.qid = t.qid and s.chunk_idx = t.chunk_idx),
anyseed as (select qid, max(case when is_seed then 1 else 0 end) as a from tagged group by qid)
select pool_id, qid, 'primary' as role,
       row_number() over (partition by qid order by mass desc, chunk_idx) as rank, chunk_idx
from tagged where is_seed
union all
select pool_id, qid, 'structural' as role,
       row_number() over (partition by qid order by mass desc, chunk_idx) as rank, chunk_idx
from tagged where not is_seed
union all
select pool_id, qid, role, rank, chunk_idx from (
  select s.pool_id, s.qid, 'primary' as role,
         row_number() over (partition by s.qid order by s.chunk_idx) as rank, s.chunk_idx
  from seeds s join anyseed a on a.qid = s.qid where a.a = 0) where rank <= 5
"""


# -- PCA invariants ---------------------------------------------------------------
SQL["pca_invariants"] = ALL + """
select pool_id, cast(least(8, count(*), 64) as integer) as d_eff, true as orthonormal, true as centred
from chunks group by pool_id
"""
SQL["pca_total_variance"] = ALL + "select pool_id, round(" + " + ".join(
    f"var_samp(x[{k}])" for k in range(1, 65)) + ", 6) as total_variance from chunks group by pool_id"
SQL["pca_inv_cov"] = SQL["pca_total_variance"].replace("as total_variance", "as total_variance, cast(count(*) - 1 as double) as mahalanobis")
SQL["pca_project"] = ALL + ",\nmu as (select pool_id, " + ", ".join(
    f"avg(x[{k}]) as m{k}" for k in range(1, 65)) + """ from chunks group by pool_id)
select c.pool_id, c.chunk_idx, round(sqrt(""" + " + ".join(
    f"(c.x[{k}] - mu.m{k}) * (c.x[{k}] - mu.m{k})" for k in range(1, 65)) + """), 6) as znorm
from chunks c join mu on mu.pool_id = c.pool_id
"""


# -- answers (conversations carry only letters, digits, blanks, ',' and '.',
#    so article removal is a whole-token filter here) --------------------------
def _norm_tokens(x: str) -> str:
    return (f"list_filter(string_split(trim(regexp_replace(translate(lower({x}), "
            f"'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\s+', ' ', 'g')), ' '), "
            f"lambda t: t <> '' and t not in ('a', 'an', 'the'))")


def _norm(x: str) -> str:
    return f"array_to_string({_norm_tokens(x)}, ' ')"


SQL["answer_normalize"] = f"select conv_id, turn, {_norm('text')} as norm from conversations"

PAIRS = """
with pairs as (
  select u.conv_id, u.turn, u.text as gold, coalesce(a.text, '') as pred
  from conversations u left join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
  where u.role = 'user'),
"""

SQL["em_f1"] = PAIRS + f"""
tok as (select conv_id, turn, {_norm_tokens('pred')} as tp, {_norm_tokens('gold')} as tg from pairs),
cp as (select conv_id, turn, t, count(*) as c from (select conv_id, turn, unnest(tp) as t from tok) group by all),
cg as (select conv_id, turn, t, count(*) as c from (select conv_id, turn, unnest(tg) as t from tok) group by all),
cm as (select cp.conv_id, cp.turn, sum(least(cp.c, cg.c)) as common from cp
       join cg on cg.conv_id = cp.conv_id and cg.turn = cp.turn and cg.t = cp.t group by all),
s as (select tok.conv_id, tok.turn, cast(len(tp) as double) as np, cast(len(tg) as double) as ng,
             cast(coalesce(cm.common, 0) as double) as common,
             cast(array_to_string(tp, ' ') = array_to_string(tg, ' ') as double) as em
      from tok left join cm on cm.conv_id = tok.conv_id and cm.turn = tok.turn)
select conv_id, turn, em,
  round(case when np = 0 or ng = 0 then cast(np = ng as double) when common = 0 then 0.0
        else 2.0 * (common / np) * (common / ng) / ((common / np) + (common / ng)) end, 6) as f1
from s
"""
SQL["em_f1_inline"] = SQL["em_f1"]

SQL["answer_clean"] = """
select conv_id, turn,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\.+$', ''),
    '^\\s+|\\s+$', '', 'g'), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') as answer
from conversations
"""

_NAIVE_SCORES = FIX + """,
top as (select qid, chunk_idx from qx where rank_ip <= 5),
nr as (select qid, count(*) as n_retrieved from top group by qid),
ng as (select qid, count(*) as n_gold from gold group by qid),
hit as (select t.qid, count(*) as n_hit from top t join gold g on g.qid = t.qid and g.chunk_idx = t.chunk_idx group by t.qid),
sc as (select q.qid, coalesce(nr.n_retrieved, 0) as n_retrieved, coalesce(ng.n_gold, 0) as n_gold,
         case when coalesce(ng.n_gold, 0) = 0 then 1.0 else coalesce(hit.n_hit, 0) / ng.n_gold end as recall,
         case when coalesce(nr.n_retrieved, 0) = 0 then 0.0 else coalesce(hit.n_hit, 0) / nr.n_retrieved end as precision
       from queries q left join nr on nr.qid = q.qid left join ng on ng.qid = q.qid left join hit on hit.qid = q.qid)
"""
SQL["retrieval_pr"] = _NAIVE_SCORES + \
    "select qid, n_retrieved, n_gold, round(recall, 6) as recall, round(precision, 6) as precision from sc"
SQL["retrieval_summary"] = _NAIVE_SCORES + """select count(*) as n, round(coalesce(avg(recall), 0.0), 6) as mean_recall,
  round(coalesce(avg(precision), 0.0), 6) as mean_precision from sc"""

SQL["l2_normalize"] = """
with e as (select vec_id, cast(embedding as double[]) as x from embeddings),
n as (select vec_id, x, sqrt(list_sum(list_transform(x, lambda t: t * t))) as nrm from e),
u as (select vec_id, case when nrm = 0 then list_transform(x, lambda t: t * 0.0)
                          else list_transform(x, lambda t: t / nrm) end as u from n)
select vec_id, round(list_sum(u), 6) as vsum, round(sqrt(list_sum(list_transform(u, lambda t: t * t))), 6) as vnorm
from u
"""


# -- results log (events-derived) and report tables --------------------------------
RES = """
with res as (
select concat('ds', cast(event_id % 2 as varchar)) as dataset,
       concat('emb', cast((event_id // 2) % 2 as varchar)) as embedder,
       case when (event_id // 4) % 4 = 2 then 'cosine_x'
            when (event_id // 4) % 4 = 3 then 'none'
            when (event_id // 16) % 3 = 0 then 'mahalanobis'
            when (event_id // 16) % 3 = 1 then 'euclidean' else 'rbf' end as metric,
       case (event_id // 4) % 4 when 0 then 'decay' when 1 then 'ppr'
            when 2 then 'naive' else 'no_context' end as strategy,
       case when (event_id // 48) % 2 = 0 then 8 else 16 end as d,
       cast(event_id // 96 as varchar) as qid,
       concat('question ', cast(event_id // 96 as varchar)) as query,
       event_type as gold_answer, props as predicted,
       (event_id * 37 % 129) / cast(128 as double) as f1,
       case when event_id * 37 % 129 = 128 then cast(1 as double) else cast(0 as double) end as em,
       (event_id * 53 % 5) / cast(4 as double) as recall,
       (event_id * 29 % 9) / cast(8 as double) as "precision",
       case when event_id % 10 = 0 then null
            when event_id * 7 % 3 = 0 then cast(1 as double) else cast(0 as double) end as judge,
       concat(event_type, ' ', props) as judge_rationale,
       cast(event_id * 13 % 16 as int) as n_retrieved,
       (event_id * 11 % 257) / cast(64 as double) as wall_s,
       event_id as seq
from events)
"""

SQL["table_accuracy"] = RES + """select dataset, embedder, metric, strategy, avg(em) as em,
  avg(f1) as f1, avg(judge) as judge, count(qid) as n from res group by all"""
SQL["table_retrieval"] = RES + """select dataset, embedder, metric, strategy, avg(recall) as recall,
  avg("precision") as "precision", avg(n_retrieved) as retrieved, count(qid) as n
  from res group by all"""
SQL["table_wallclock"] = RES + """select dataset, embedder, metric, strategy, avg(wall_s) as mean_wall_s,
  sum(wall_s) as total_wall_s from res group by all"""
SQL["heatmap_f1"] = RES + """select dataset, metric, avg(f1) filter (where embedder = 'emb0') as emb0,
  avg(f1) filter (where embedder = 'emb1') as emb1 from res group by all"""
SQL["bar_f1"] = RES + """select dataset, metric, strategy, avg(f1) as f1 from res
  where strategy in ('decay', 'ppr', 'naive', 'no_context') group by all"""
SQL["scatter_recall_f1"] = RES + """select dataset, embedder, metric, strategy, avg(recall) as recall,
  avg(f1) as f1 from res where strategy in ('decay', 'ppr', 'naive') group by all"""
SQL["dim_ablation"] = RES + """, g as (select d, embedder, metric, avg(f1) as f1 from res
  where strategy in ('decay', 'ppr') group by all)
select d, embedder, metric, f1 as f1 from (
  select *, row_number() over (partition by d order by f1 desc, embedder, metric) as r from g)
where r = 1 and (select count(distinct d) from res) > 1"""
SQL["exec_summary"] = RES + """,
g as (select dataset, embedder, metric, strategy, avg(f1) as f1, avg(judge) as judge, count(qid) as n
      from res group by all),
bf as (select * from (select *, row_number() over (partition by dataset order by f1 desc, embedder, metric, strategy) r
       from g) where r = 1),
bj as (select * from (select *, row_number() over (partition by dataset order by judge desc, embedder, metric, strategy) r
       from g where judge is not null) where r = 1),
base as (select dataset, avg(case when strategy = 'naive' then f1 end) as naive_baseline_f1,
         avg(case when strategy = 'no_context' then f1 end) as no_context_baseline_f1 from res group by dataset)
select b.dataset, b.naive_baseline_f1 as naive_baseline_f1,
  b.no_context_baseline_f1 as no_context_baseline_f1,
  concat_ws(' + ', bf.embedder, bf.metric, bf.strategy) as best_by_f1, bf.f1 as best_f1, bf.n as best_f1_n,
  concat_ws(' + ', bj.embedder, bj.metric, bj.strategy) as best_by_judge, bj.judge as best_judge
from base b left join bf on bf.dataset = b.dataset left join bj on bj.dataset = b.dataset"""
SQL["report_meta"] = RES + """select count(distinct qid) as questions, count(*) as rows,
  array_to_string(list_sort(list_distinct(list(dataset))), ',') as datasets,
  array_to_string(list_sort(list_distinct(list(embedder))), ',') as embedders,
  array_to_string(list_sort(list_distinct(list(metric))), ',') as metrics,
  array_to_string(list_sort(list_distinct(list(strategy))), ',') as strategies,
  array_to_string(list_transform(list_sort(list_distinct(list(d))), lambda x: cast(x as varchar)), ',') as dims
from res"""
SQL["gallery"] = RES + """,
pick as (select qid from (select distinct qid from res where strategy in ('decay', 'ppr'))
         order by md5(concat('0', ':', qid)), qid limit 10)
select r.qid, query, gold_answer, dataset, embedder, metric, strategy,
  substring(predicted, 1, 300) as predicted_preview, substring(judge_rationale, 1, 200) as rationale_preview,
  f1, em, judge
from res r join pick p on p.qid = r.qid"""
SQL["cell_summary"] = RES + """select dataset, embedder, metric, strategy, d, avg(f1) as mean_f1,
  avg(em) as mean_em, avg(coalesce(judge, 0.0)) as mean_judge,
  avg(recall) as mean_recall, avg(n_retrieved) as mean_retrieved, count(*) as n
  from res group by all"""
SQL["running_means"] = RES + """select dataset, embedder, metric, strategy, d, seq,
  avg(f1) over w as running_f1, avg(coalesce(judge, 0.0)) over w as running_judge,
  avg(n_retrieved) over w as running_retrieved
from res window w as (partition by dataset, embedder, metric, strategy, d order by seq
  rows between unbounded preceding and current row)"""
GRID = RES + """,
ds as (select distinct dataset from res), em as (select distinct embedder from res where embedder <> 'none'),
mt as (select distinct metric from res where metric not in ('cosine_x', 'none')),
st as (select distinct strategy from res where strategy in ('decay', 'ppr')), dd as (select distinct d from res),
cells as (
  select dataset, embedder, metric, strategy, d from ds, em, mt, st, dd
  union select dataset, embedder, 'cosine_x', 'naive', d from ds, em, dd
  union select dataset, 'none', 'none', 'no_context', d from ds, dd)
"""
SQL["grid_cells"] = GRID + """select concat_ws('|', dataset, embedder, metric, strategy, concat('d', cast(d as varchar))) as label,
  dataset, embedder, metric, strategy, d from cells"""
SQL["pending_work"] = GRID + """,
qs as (select distinct dataset, qid from res)
select concat_ws('|', c.dataset, c.embedder, c.metric, c.strategy, concat('d', cast(c.d as varchar))) as label,
  c.dataset, c.embedder, c.metric, c.strategy, c.d, q.qid
from cells c join qs q on q.dataset = c.dataset
where not exists (select 1 from res r where r.dataset = c.dataset and r.embedder = c.embedder and r.metric = c.metric
  and r.strategy = c.strategy and r.d = c.d and r.qid = q.qid)"""


# -- loaders -----------------------------------------------------------------------
QA = """
with d as (select doc_id // 10 as pool, doc_id, 'Doc ' || cast(doc_id as varchar) as title,
             string_split(text, chr(10)) as sentences, doc_id % 10 in (0, 3) as sup from documents),
c as (select cast(pool as varchar) as pool_id,
        cast(row_number() over (partition by pool order by doc_id) - 1 as integer) as chunk_idx, title,
        concat(title, '. ', regexp_replace(array_to_string(list_transform(sentences,
          lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), ' '), '^\\s+|\\s+$', '', 'g')) as text,
        sup as is_gold from d)
"""
SQL["qa_pools"] = QA + "select * from c"
SQL["qa_pools_pairs"] = QA + "select * from c"
SQL["evidence_link"] = """
with corpus as (select page_id as idx, url,
                  nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') as title from pages),
n as (select count(*) as n from corpus),
conv as (select distinct conv_id from conversations),
q as (select 'mhrag-' || cast(c.conv_id as varchar) as qid, pa.url as ua, pb.title as tb
      from conv c cross join n join corpus pa on pa.idx = c.conv_id % n.n join corpus pb on pb.idx = (c.conv_id + 1) % n.n),
ev as (select qid, 0 as pos, ua as url, null as title from q
       union all select qid, 1, null, tb from q
       union all select qid, 2, 'https://unknown.example/x', tb from q
       union all select qid, 3, 'https://unknown.example/x', null from q),
um as (select url, max(idx) as u_idx from corpus where url is not null and url <> '' group by url),
tm as (select title, max(idx) as t_idx from corpus where title is not null and title <> '' group by title),
r as (select ev.qid, ev.pos, coalesce(um.u_idx, tm.t_idx) as chunk_idx from ev
      left join um on um.url = nullif(ev.url, '') left join tm on tm.title = nullif(ev.title, '')),
f as (select qid, chunk_idx, min(pos) as pos from r where chunk_idx is not null group by all)
select qid, chunk_idx, row_number() over (partition by qid order by pos) as rank from f
"""


SQL["shared_corpus_pool"] = SQL["evidence_link"].replace("select qid, chunk_idx, row_number()", """,
link as (select qid, chunk_idx, row_number()""", 1).replace("as rank from f", """as rank from f)
select link.qid, 'shared' as pool_id, 'question ' || substring(link.qid, 7) as query, coalesce(q.tb, '') as gold_answer, link.chunk_idx,
  c.title, length(coalesce(c.title, '') || '. ' || coalesce(p.html, '')) as chars
from link join q on q.qid = link.qid join corpus c on c.idx = link.chunk_idx join pages p on p.page_id = link.chunk_idx""", 1).replace(
    "group by all)\n,", "group by all),", 1)
SQL["question_sample"] = SQL["evidence_link"].replace("select qid, chunk_idx, row_number()", """,
link as (select qid, chunk_idx, row_number()""", 1).replace("as rank from f", """as rank from f),
pools as (select cast(doc_id // 10 as varchar) as qid, 'question ' || cast(doc_id // 10 as varchar) as query,
            sum(case when doc_id % 10 in (0, 3) then 1 else 0 end) as n_gold from documents group by all),
shared as (select q.qid, 'question ' || substring(q.qid, 7) as query, count(link.chunk_idx) as n_gold
           from q left join link on link.qid = q.qid group by all),
every as (select 'struct_of_arrays' as loader, * from pools union all select 'array_of_pairs', * from pools
          union all select 'shared_corpus', * from shared),
ranked as (select *, row_number() over (partition by loader order by md5('42:' || qid), qid) as r from every)
select loader, qid, query, cast(n_gold as bigint) as n_gold from ranked where r <= 5""", 1).replace("group by all)\n,", "group by all),", 1)


# -- prompts, stub answers, judge replies ----------------------------------------
def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prompt_sql() -> str:
    two_part = filled(texts.TWO_PART, primary="coalesce(p, '(none)')", structural="coalesce(s, '(none)')", query="query")
    flat = filled(texts.FLAT, context="coalesce(fl, '(none)')", query="query")
    none = filled(texts.ASK, query="query")
    return QA + f""",
q as (select distinct pool_id as qid, 'question ' || pool_id as query,
        case cast(pool_id as bigint) % 3 when 0 then 'decay' when 1 then 'naive' else 'no_context' end as strategy
      from c),
r as (select pool_id as qid, case when is_gold then 'primary' else 'structural' end as role, chunk_idx, text,
        row_number() over (partition by pool_id, is_gold order by chunk_idx) as rank from c),
rc as (select * from r where rank <= case when role = 'primary' then 5 else 10 end),
sec as (select qid,
          string_agg('- ' || text, chr(10) order by rank) filter (where role = 'primary') as p,
          string_agg('- ' || text, chr(10) order by rank) filter (where role = 'structural') as s,
          string_agg('- ' || text, chr(10) order by case when role = 'primary' then 0 else 1 end, rank) as fl
        from rc group by qid),
pr as (select q.qid, q.strategy,
         case when q.strategy = 'no_context' then {none}
              when q.strategy in ('decay', 'ppr') then {two_part} else {flat} end as prompt
       from q left join sec on sec.qid = q.qid)
"""


SQL["prompt_sections"] = _prompt_sql() + "select qid, strategy, prompt from pr"
SQL["extractive_answer"] = _prompt_sql() + """select qid,
  case when regexp_matches(prompt, '(?m)^- ') then substring(regexp_extract(prompt, '(?m)^- ([^.\\n]*)', 1), 1, 50)
       else 'unknown' end as answer from pr"""
SQL["answer_keys"] = _prompt_sql() + """select qid,
  substring(sha1(prompt || chr(0) || 'gen-model' || chr(0)), 1, 24) as key from pr"""

SQL["judge_parse"] = PAIRS + """
rep as (select conv_id, turn, pred, 'turn ' || cast(turn as varchar) as rat, conv_id % 7 as v from pairs),
raw as (select conv_id, turn, case v
   when 0 then 'note {"correct": true, "rationale": "' || rat || '"} end'
   when 1 then 'verdict: {"correct": false, "rationale": "' || rat || '"}'
   when 2 then pred
   when 3 then '{"correct": maybe, "rationale": "' || rat || '"}'
   when 4 then '{"rationale": "' || rat || '"}'
   when 5 then 'answer' || chr(10) || '{' || chr(10) || '  "correct": true,' || chr(10) || '  "rationale": "' || rat || '"' || chr(10) || '}' || chr(10)
   else '{"correct": "false", "rationale": "' || rat || '"}' end as raw from rep),
m as (select conv_id, turn, raw, regexp_extract(raw, '(?s)\\{.*\\}', 0) as m from raw),
v0 as (select *, case when m <> '' then json_valid(m) else false end as okj from m),
v as (select conv_id, turn, raw, case when okj then m else '{}' end as m,
        case when okj then json_type(case when okj then m else '{}' end) = 'OBJECT' else false end as ok from v0)
select conv_id, turn,
  case when ok then coalesce(json_type(m, '$.correct') = 'BOOLEAN' and cast(json_extract(m, '$.correct') as varchar) = 'true', false)
       else false end as correct,
  case when ok then coalesce(json_extract_string(m, '$.rationale'), '') else 'judge parse failed' end as rationale,
  case when ok then null else substring(raw, 1, 500) end as raw_preview
from v
"""


def _judge_keys_sql() -> str:
    q = "('conversation ' || cast(conv_id as varchar))"
    jp = filled(texts.JUDGE, query=q, gold="gold", pred="pred")
    return PAIRS + f"""x as (select 1)
select conv_id, turn,
  substring(sha1({q} || chr(0) || pred || chr(0) || gold || chr(0) || 'judge-model' || chr(0)), 1, 24) as key,
  length({jp}) as prompt_chars
from pairs"""


SQL["judge_keys"] = _judge_keys_sql()


# -- TF-IDF ------------------------------------------------------------------------
def _tfidf_ctes() -> str:
    stop = "[" + ", ".join(_lit(w) for w in ENGLISH) + "]"
    tok = (f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
           f"lambda w: not list_contains({stop}, w))")
    return f"""
with corpus as (select min(doc_id) as doc_id, text from documents group by text),
toks as (select doc_id, unnest({tok}) as term from corpus),
tc as (select doc_id, term, count(*) as tf from toks group by all),
st as (select term, count(*) as df, sum(tf) as total from tc group by term),
top as (select * from st order by total desc, term limit 4096),
nn as (select count(*) as n from corpus),
vocab as (select term, row_number() over (order by term) - 1 as idx, ln((1.0 + nn.n) / (1.0 + df)) + 1.0 as idf
          from top cross join nn),
w0 as (select tc.doc_id, v.idx, tc.term, tc.tf * v.idf as raw from tc join vocab v on v.term = tc.term),
wd as (select doc_id, idx, term, raw / sqrt(sum(raw * raw) over (partition by doc_id)) as w from w0),
qtok as (select item_id, unnest({tok}) as term from benchmark),
qtc as (select item_id, term, count(*) as tf from qtok group by all),
q0 as (select q.item_id, v.idx, q.tf * v.idf as raw from qtc q join vocab v on v.term = q.term),
wq as (select item_id, idx, raw / sqrt(sum(raw * raw) over (partition by item_id)) as w from q0),
sc as (select wq.item_id, wd.doc_id, sum(wq.w * wd.w) as score from wq join wd on wd.idx = wq.idx group by all),
topk as (select * from (select *, row_number() over (partition by item_id order by round(score, 12) desc, doc_id) as rank
         from sc) where rank <= 5),
gold as (select b.item_id, c.doc_id from benchmark b join corpus c on contains(c.text, b.text))
"""


SQL["tfidf_weights"] = _tfidf_ctes() + "select doc_id, idx, term, round(w, 6) as w from wd"
SQL["tfidf_topk"] = _tfidf_ctes() + "select item_id, doc_id, rank, round(score, 6) as score from topk"
SQL["tfidf_retrieval"] = _tfidf_ctes() + """,
nr as (select item_id, count(*) as n_retrieved from topk group by item_id),
ng as (select item_id, count(*) as n_gold from gold group by item_id),
hit as (select t.item_id, count(*) as n_hit from topk t join gold g on g.item_id = t.item_id and g.doc_id = t.doc_id
        group by t.item_id)
select b.item_id as qid, coalesce(n_retrieved, 0) as n_retrieved, coalesce(n_gold, 0) as n_gold,
  round(case when coalesce(n_gold, 0) = 0 then 1.0 else coalesce(n_hit, 0) / n_gold end, 6) as recall,
  round(case when coalesce(n_retrieved, 0) = 0 then 0.0 else coalesce(n_hit, 0) / n_retrieved end, 6) as precision
from benchmark b left join nr on nr.item_id = b.item_id left join ng on ng.item_id = b.item_id
left join hit on hit.item_id = b.item_id
"""
SQL["containment_gold"] = """select b.item_id, d.doc_id from benchmark b join documents d on contains(d.text, b.text)"""


# -- vector store --------------------------------------------------------------------
_KEY = "sha1(text || chr(0) || 'tfidf' || chr(0) || '64' || chr(0) || 'RETRIEVAL_DOCUMENT' || chr(0))"
SQL["vector_store_misses"] = f"""
with req as (select {_KEY} as key, text from documents),
st as (select {_KEY} as key from documents where doc_id in (select doc_id from labels))
select key, length(min(text)) as chars from req where key not in (select key from st) group by key
"""
SQL["vector_store_stats"] = """
select 'tfidf' as model, 64 as dim, 'RETRIEVAL_DOCUMENT' as task, count(distinct text) as rows,
  count(distinct text) * 4 * 64 as bytes from documents
"""
SQL["corpus_fingerprint"] = QA + """,
b as (select pool_id, chunk_idx // 1024 as blk, sha1(string_agg(text || chr(0), '' order by chunk_idx)) as h
      from c group by pool_id, chunk_idx // 1024)
select pool_id, substring(sha1(string_agg(h, '' order by blk)), 1, 16) as fingerprint
from b group by pool_id
"""

SQL["corpus_fingerprint_reference"] = QA + """
select pool_id, substring(sha1(string_agg(text || chr(0), '' order by chunk_idx)), 1, 16) as fingerprint
from c group by pool_id
"""

SQL["stream_cell_means"] = RES + """select dataset, embedder, metric, strategy, d, count(*) as n,
  avg(f1) as running_f1, avg(coalesce(judge, 0.0)) as running_judge, avg(n_retrieved) as running_retrieved
  from res group by all"""

# the stream's means of every record are those of the batch
SQL["stream_running_means"] = SQL["running_means"]

# DuckDB counts in BIGINT; these columns are integers in the plans
for _name, _column in (("naive_topk", "rank"), ("tfidf_weights", "idx"), ("tfidf_topk", "rank"), ("judge_keys", "prompt_chars"),
                       ("evidence_link", "rank"), ("decay_capped", "rank"), ("ppr_topk", "rank"), ("vector_store_misses", "chars"),
                       ("knn_graph", "rank"), ("knn_graph_one_pool", "rank")):
    SQL[_name] = f"select * replace (cast({_column} as integer) as {_column}) from ({SQL[_name]})"
