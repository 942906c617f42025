"""Equivalent SQL for the queries, in DuckDB's dialect.

Where it matters the SQL takes another route than the Spark job: the Lasso is
solved by accelerated proximal gradient instead of coordinate descent, the
normal tail by Simpson's rule and a continued fraction, diffusion by a Taylor-type series, shortest-path
betweenness by walk counts, and ranking curves by pair counts.
"""

from __future__ import annotations

import math

from edgeloom.functions.hashing import set_salts
from edgeloom.plans.inputs import EVENT_TYPES, LINE_ID, LINE_MEASURES, LINE_SCALE
from edgeloom.plans.queries import FRAMES, STARS_GRID, T_GRID

P = 64
M = P * (P - 1) // 2

# --- shared pieces ----------------------------------------------------------

AR = """ar AS (SELECT vec_id AS row_id, label, (j-1)::INT AS v, list_sum(list_transform(range(1, j+1),
  lambda k: pow(0.8::DOUBLE, j-k) * embedding[k]::DOUBLE)) AS y FROM embeddings, range(1, 65) t(j)),
nn AS (SELECT count(*)::DOUBLE AS n FROM embeddings)"""
CG = AR + """,
cg AS (SELECT a.v AS i, b.v AS j, corr(a.y, b.y) AS c FROM ar a JOIN ar b ON a.row_id=b.row_id AND a.v<b.v GROUP BY 1,2)"""


def graph(cut: float = 0.5) -> str:
    return CG + f""",
g AS (SELECT i, j, abs(c) AS w FROM cg WHERE abs(c) > {cut}),
gw AS (SELECT i, j, round(w, 9) AS w FROM g),
bo AS (SELECT i AS u, j AS v, w FROM gw UNION ALL SELECT j, i, w FROM gw),
nodes AS (SELECT range::INT AS node FROM range({P})),
dg AS (SELECT node, count(u) AS degree FROM nodes LEFT JOIN bo ON u=node GROUP BY node),
hb AS (SELECT node AS hub FROM dg ORDER BY degree DESC, node LIMIT 1)"""


LINE = f"""ln AS (SELECT {LINE_ID.replace("cast(l_quantity as bigint)", "l_quantity::BIGINT")} AS row_id, """ + ", ".join(
    f"{c}::DOUBLE/{s}::DOUBLE AS x{k}" for k, (c, s) in enumerate(zip(LINE_MEASURES, LINE_SCALE))) + """ FROM lineitem)"""
LINE_CHAIN = LINE + """,
l1 AS (SELECT *, x0*0.8::DOUBLE+x1 AS y1 FROM ln), l2 AS (SELECT *, y1*0.8::DOUBLE+x2 AS y2 FROM l1),
lc AS (SELECT row_id, x0 AS y0, y1, y2, y2*0.8::DOUBLE+x3 AS y3 FROM l2),
ll AS (SELECT row_id, k::INT AS v, [y0,y1,y2,y3][k+1] AS y FROM lc, range(4) t(k))"""
EV = "ev AS (SELECT user_id AS row_id, " + ", ".join(
    f"count(*) FILTER (event_type='{t}') AS {t}" for t in EVENT_TYPES) + """ FROM events GROUP BY 1),
el AS (SELECT row_id, k::INT AS v, [click, error, purchase, signup, view][k+1]::DOUBLE AS y FROM ev, range(5) t(k))"""


def ranks(table: str) -> str:
    """Average ranks by counting smaller and equal values."""
    return f"""rk AS (SELECT row_id, v, y, rank() OVER (PARTITION BY v ORDER BY y)
  + (count(*) OVER (PARTITION BY v, y) - 1)/2.0::DOUBLE AS r, count(*) OVER (PARTITION BY v) AS n FROM {table})"""


def ppf(u: str, columns: str, source: str) -> str:
    """Normal quantile: a coarse rational start and three Newton steps on Simpson's rule."""
    phi = "exp(-0.5::DOUBLE*{x}*{x})/sqrt(2*pi())"
    cdf = ("(0.5::DOUBLE + {x}/1200.0::DOUBLE*(list_sum(list_transform(range(0,401), lambda s: "
           "(CASE WHEN s=0 OR s=400 THEN 1 WHEN s%2=1 THEN 4 ELSE 2 END)"
           "*exp(-0.5::DOUBLE*pow({x}*s/400.0::DOUBLE,2))/sqrt(2*pi())))))")
    t = "sqrt(-2*ln(least(u,1-u)))"
    start = (f"sign(u-0.5::DOUBLE)*({t}-(2.515517::DOUBLE+0.802853::DOUBLE*{t}+0.010328::DOUBLE*{t}*{t})/"
             f"(1+1.432788::DOUBLE*{t}+0.189269::DOUBLE*{t}*{t}+0.001308::DOUBLE*{t}*{t}*{t}))")
    out = f"""u0 AS (SELECT DISTINCT {u} AS u FROM {source}), q0 AS (SELECT u, {start} AS x FROM u0)"""
    for k in range(3):
        step = f"x-({cdf.format(x='x')}-u)/({phi.format(x='x')})"
        out += f", q{k+1} AS (SELECT u, {step} AS x FROM q{k})"
    return out


def two_sided(z: str) -> str:
    """``P(|N| >= |z|)``: Simpson's rule on [0, |z|] near the centre, a continued fraction in the tail."""
    centre = (f"1-2*abs({z})/2400.0::DOUBLE*list_sum(list_transform(range(0,801), "
              f"lambda s: (CASE WHEN s=0 OR s=800 THEN 1 WHEN s%2=1 THEN 4 ELSE 2 END)"
              f"*exp(-0.5::DOUBLE*pow(abs({z})*s/800.0::DOUBLE,2))/sqrt(2*pi())))")
    tail = (f"2*exp(-0.5::DOUBLE*pow({z},2))/sqrt(2*pi())/list_reduce(list_transform(range(120,0,-1), lambda k: k::DOUBLE), "
            f"lambda a, k: abs({z})+k/a, abs({z})::DOUBLE)")
    return f"CASE WHEN abs({z})>2.5 THEN {tail} ELSE {centre} END"


def bh(source: str, p: str, alpha: float | None = 0.05, harmonic: bool = False) -> str:
    c = "(SELECT sum(1.0::DOUBLE/k) FROM range(1,(SELECT count(*) FROM {0})+1) t(k))".format(source) if harmonic else "1.0::DOUBLE"
    return f"""o AS (SELECT *, row_number() OVER (ORDER BY {p}) AS rn, count(*) OVER () AS m FROM {source}),
qv AS (SELECT *, least(1.0::DOUBLE, min({p}*m*{c}/rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS q FROM o)"""


LASSO = AR + f""",
cf AS (SELECT a.v AS i, b.v AS j, corr(a.y,b.y) AS c FROM ar a JOIN ar b USING (row_id) GROUP BY 1,2),
gr AS (SELECT i, list(CASE WHEN i=j THEN 1.0::DOUBLE ELSE c END ORDER BY j) AS r FROM cf GROUP BY i),
gm AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM gr),
par AS (SELECT n, sqrt(2*ln(CASE WHEN {P}/sqrt(n)>1 THEN {P}/sqrt(n) ELSE {P} END)/n) AS lam,
  (SELECT 1/max(list_sum(list_transform(r, lambda x: abs(x)))) FROM gr) AS eta FROM nn),
it(k,i,b,w,d) AS (SELECT 0, i, list_transform(range({P}), lambda x: 0.0::DOUBLE), list_transform(range({P}), lambda x: 0.0::DOUBLE), 1.0::DOUBLE FROM gr
 UNION ALL
 SELECT k+1, i, nb, list_transform(range({P}), lambda j: nb[j+1] + (k%100)::DOUBLE/((k%100)+3)*(nb[j+1]-b[j+1])),
  list_max(list_transform(range({P}), lambda j: abs(nb[j+1]-b[j+1]))) FROM (
  SELECT k, i, b, list_transform(range({P}), lambda j: CASE WHEN j=i THEN 0.0::DOUBLE ELSE sign(u[j+1])*greatest(abs(u[j+1])-eta*lam,0.0::DOUBLE) END) AS nb FROM (
   SELECT k, i, b, eta, lam, list_transform(range({P}), lambda j: w[j+1]+eta*(m[i+1][j+1]-list_inner_product(m[j+1],w))) AS u
   FROM it, gm, par WHERE k<1500 AND (k<60 OR d>1e-14)))),
bt AS MATERIALIZED (SELECT i, b FROM it QUALIFY row_number() OVER (PARTITION BY i ORDER BY k DESC)=1),
bl AS MATERIALIZED (SELECT i, j::INT AS j, b[j+1] AS beta FROM bt, range({P}) t(j)),
nd AS MATERIALIZED (SELECT i, 1-2*list_inner_product(b,m[i+1])+list_sum(list_transform(range({P}), lambda j: b[j+1]*list_inner_product(m[j+1],b))) AS tau2,
  len(list_filter(b, lambda x: abs(x)>1e-9))::INT AS nnz FROM bt, gm),
ed AS MATERIALIZED (SELECT a.i, b.i AS j, (-x.beta/a.tau2-y.beta/b.tau2)/2 AS omega, a.tau2*b.tau2 AS variance, a.nnz AS na, b.nnz AS nb
  FROM nd a JOIN nd b ON a.i<b.i JOIN bl x ON x.i=a.i AND x.j=b.i JOIN bl y ON y.i=b.i AND y.j=a.i),
ez AS (SELECT *, sqrt(n)*omega/sqrt(variance) AS z FROM ed, nn),
ep AS (SELECT *, {two_sided('z')} AS p FROM ez)"""


def r(x: str, d: int, name: str) -> str:
    return f"round({x},{d})+0.0::DOUBLE AS {name}"


def rank_hash_sql(x: str, hi: str, lo: str) -> str:
    def mix(salt: str) -> str:
        h0 = f"xor(xor(({x})%2147483648, ((({x})//2147483648)*40503)%2147483648), {salt})"
        h1 = f"((xor({h0}, ({h0})>>15)*73244475)%2147483648)"
        h2 = f"((xor({h1}, ({h1})>>13)*73244475+1013904223)%2147483648)"
        return f"xor({h2}, ({h2})>>16)"
    return f"({mix(hi)}*2147483648+{mix(lo)})"


def subsets(source: str, ids: str, n_sets: int, seed: int, share: str) -> str:
    values = ",".join(f"({s},{hi}::BIGINT,{lo}::BIGINT)" for s, (hi, lo) in
                      ((s, set_salts(seed, s)) for s in range(n_sets)))
    return f"""sl(s,hi,lo) AS (VALUES {values}),
ih AS (SELECT s, {ids} AS row_id, {rank_hash_sql(ids, 'hi', 'lo')} AS h FROM {source}, sl),
sb AS (SELECT s, row_id FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, row_id) AS rn,
  count(*) OVER (PARTITION BY s) AS n FROM ih) WHERE rn <= floor({share}*n))"""


def pair_key(seed: int) -> str:
    hi, lo = set_salts(seed, 0)
    return rank_hash_sql(f"(i::BIGINT*{P}+j)", f"{hi}::BIGINT", f"{lo}::BIGINT")


GRID = f"gd AS (SELECT a.range::INT AS i, b.range::INT AS j FROM range({P}) a, range({P}) b WHERE a.range<b.range)"

# pairs with scores, counted pairwise
PAIRS = CG + """,
pr AS (SELECT i, j, (abs(c)>0.5)::INT AS pred, (j-i=1)::INT AS truth, round(abs(c),9) AS score FROM cg)"""


def curves(keys: str = "") -> str:
    k = f"{keys}," if keys else ""
    on = f"a.{keys}=b.{keys} AND " if keys else ""
    return f"""tot AS (SELECT {k} sum(truth)::DOUBLE AS pos, (count(*)-sum(truth))::DOUBLE AS neg,
  sum(truth*pred)::BIGINT AS tp, sum(pred*(1-truth))::BIGINT AS fp, sum((1-pred)*(1-truth))::BIGINT AS tn,
  sum((1-pred)*truth)::BIGINT AS fn FROM pr {'GROUP BY ' + keys if keys else ''}),
po AS (SELECT * FROM pr WHERE truth=1),
ap1 AS (SELECT {'a.' + keys + ',' if keys else ''} a.i, a.j, count(*)::DOUBLE AS n, sum(b.truth)::DOUBLE AS t,
  sum(CASE WHEN b.truth=0 THEN (CASE WHEN b.score>a.score THEN 0.0 ELSE 0.5 END) ELSE 0 END) AS dummy
  FROM po a JOIN pr b ON {on} b.score>=a.score GROUP BY ALL),
ag AS (SELECT {k} sum(t/n) AS ap, count(*) AS np FROM ap1 {'GROUP BY ' + keys if keys else ''}),
th AS (SELECT {'a.' + keys + ',' if keys else ''} a.score, count(*)::DOUBLE AS n, sum(b.truth)::DOUBLE AS t
  FROM (SELECT DISTINCT {k} score FROM pr) a JOIN pr b ON {on} b.score>=a.score GROUP BY ALL),
f1 AS (SELECT {('th.' + keys + ',') if keys else ''} max(2*t/(n+pos)) AS f1_opt FROM th {'JOIN tot USING (' + keys + ')' if keys else ', tot'} {'GROUP BY 1' if keys else ''}),
au AS (SELECT {'a.' + keys + ',' if keys else ''} sum(CASE WHEN a.score>b.score THEN 1.0::DOUBLE WHEN a.score=b.score THEN 0.5::DOUBLE ELSE 0 END) AS u
  FROM po a JOIN pr b ON {on} b.truth=0 {'GROUP BY 1' if keys else ''})"""


DIV = lambda a, b: f"(CASE WHEN ({b})>0 THEN ({a})::DOUBLE/({b}) ELSE 0.0::DOUBLE END)"
PREC, REC = DIV("tp", "tp+fp"), DIV("tp", "tp+fn")
F1 = DIV(f"2*{PREC}*{REC}", f"{PREC}+{REC}")
MCC = DIV("tp::DOUBLE*tn-fp::DOUBLE*fn", "sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn))")

RES = """rs AS (SELECT o_orderpriority AS method, o_orderstatus AS topology, (o_custkey%5)::INT AS seed_offset,
  'c'||(o_custkey%3) AS config, o_orderkey AS rep, o_totalprice/600000.0::DOUBLE AS mcc,
  (o_orderkey%997)/997.0::DOUBLE AS aupr, (o_custkey%101)/10.0::DOUBLE AS wall_seconds FROM orders)"""
GOLD = f"""go AS (SELECT 'd'||(l_partkey%70) AS tf, 'd'||(l_suppkey%66) AS tg, (l_returnflag<>'N')::INT AS label FROM lineitem),
vr AS (SELECT range::INT AS var_id, 'd'||range AS var_name FROM range({P})),
gp AS (SELECT least(a.var_id,b.var_id) AS i, greatest(a.var_id,b.var_id) AS j FROM go JOIN vr a ON tf=a.var_name JOIN vr b ON tg=b.var_name WHERE label=1)"""
TERMS = f"""tm AS (SELECT 'mod'||k||'_'||(v%k) AS term_id, 'd'||v AS gene FROM range((SELECT max(len(embedding)) FROM embeddings)) t(v), range(2,9) u(k))"""
TIERS = """dt AS (SELECT node, degree, CASE WHEN degree>=mu+2*sd THEN 'hub' WHEN degree>=mu+sd THEN 'high' WHEN degree>=mu THEN 'connected' ELSE 'peripheral' END AS tier
  FROM dg, (SELECT avg(degree) AS mu, stddev_pop(degree) AS sd FROM dg))"""
TESTED = CG + f""",
tz AS (SELECT i, j, round(atanh(c)*sqrt(n-3),9) AS z FROM cg, nn),
tp AS (SELECT i, j, {two_sided('z')} AS p FROM tz),
sgo AS (SELECT *, row_number() OVER (ORDER BY p) AS rn, count(*) OVER () AS m FROM tp),
sg AS (SELECT i, j, p FROM tp WHERE p<=(SELECT max(p) FROM sgo WHERE p*m/rn<=0.05)),
sb2 AS (SELECT i AS u, p FROM sg UNION ALL SELECT j, p FROM sg),
nodes AS (SELECT range::INT AS node FROM range({P}))"""


def heat(edge_source: str, name: str, terms: int = 140) -> str:
    """``exp(-tL) e_hub`` by uniformisation, for a table of directed weighted edges ``u, v, w``."""
    return f"""{name}_d AS (SELECT node, coalesce(sum(w),0)::DOUBLE AS d FROM nodes LEFT JOIN {edge_source} ON u=node GROUP BY node),
{name}_c AS (SELECT 2*max(d) AS c FROM {name}_d),
{name}_r AS (SELECT node AS i, list(CASE WHEN node=n2 THEN 1-d/c ELSE coalesce(w,0)/c END ORDER BY n2) AS r
  FROM (SELECT a.node, b.node AS n2, d, w, c FROM {name}_d a CROSS JOIN nodes b CROSS JOIN {name}_c LEFT JOIN {edge_source} e ON e.u=a.node AND e.v=b.node) GROUP BY node),
{name}_m AS (SELECT list(r ORDER BY i) AS m FROM {name}_r),
{name}_v(k, v) AS (SELECT 0, list_transform(range({P}), lambda x: (x=hub)::INT::DOUBLE) FROM hb
  UNION ALL SELECT k+1, list_transform(range({P}), lambda x: list_inner_product(m[x+1], v)) FROM {name}_v, {name}_m WHERE k<{terms})"""


def heat_signal(name: str, times: list[float]) -> str:
    grid = ",".join(f"({k},{t}::DOUBLE)" for k, t in enumerate(times))
    return f"""{name}_t(t_idx,t) AS (VALUES {grid}),
{name}_s AS (SELECT node, t_idx, sum(exp(-c*t + k*ln(c*t) - lgamma(k+1))*v[node+1]) AS s FROM {name}_v, {name}_c, {name}_t, nodes GROUP BY 1,2)"""


def q(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"


ORACLES: dict[str, str] = {
    "standardize_stats": q(AR, f"SELECT v AS var_id, {r('avg(y)',9,'mean')}, {r('stddev_pop(y)',9,'std')} FROM ar GROUP BY v"),
    "standardized_lines": q(LINE, "SELECT row_id, " + ", ".join(
        r(f"(x{k}-avg(x{k}) OVER ())/stddev_pop(x{k}) OVER ()", 6, f"z{k}") for k in range(4)) + " FROM ln"),
    "gram_matrix": q(AR, f"SELECT a.v AS i, b.v AS j, count(*) AS n, {r('covar_pop(a.y,b.y)*count(*)',6,'c')} FROM ar a JOIN ar b USING (row_id) GROUP BY 1,2"),
    "pearson_edges": q(CG, f"SELECT i, j, {r('c',8,'corr')} FROM cg"),
    "covariance": q(LINE_CHAIN, f"SELECT a.v AS i, b.v AS j, {r('covar_samp(a.y,b.y)',8,'cov_samp')}, {r('covar_pop(a.y,b.y)',8,'cov_pop')} FROM ll a JOIN ll b ON a.row_id=b.row_id AND a.v<b.v GROUP BY 1,2"),
    "partial_corr_lines": q(LINE_CHAIN + """,
c AS (SELECT a.v AS i, b.v AS j, corr(a.y,b.y) AS r FROM ll a JOIN ll b USING (row_id) GROUP BY 1,2),
one AS (SELECT x.i, x.j, z.i AS k, (x.r-y.r*z2.r)/sqrt((1-y.r*y.r)*(1-z2.r*z2.r)) AS r FROM c x JOIN (SELECT DISTINCT i FROM c) z ON z.i<>x.i AND z.i<>x.j
  JOIN c y ON y.i=x.i AND y.j=z.i JOIN c z2 ON z2.i=x.j AND z2.j=z.i WHERE x.i<>x.j)""",
        f"""SELECT x.i, x.j, {r('(x.r-a.r*b.r)/sqrt((1-a.r*a.r)*(1-b.r*b.r))',7,'pcorr')} FROM one x
 JOIN one a ON a.i=x.i AND a.k=x.k AND a.j NOT IN (x.i,x.j,x.k) JOIN one b ON b.i=x.j AND b.k=x.k AND b.j=a.j
 WHERE x.i<x.j AND x.k=(SELECT min(t.k) FROM one t WHERE t.i=x.i AND t.j=x.j)"""),
    "average_rank_events": q(EV + "," + ranks("el"), "SELECT row_id, v AS var_id, y AS value, r AS rank FROM rk"),
    "spearman_edges": q(AR + "," + ranks("ar"), f"SELECT a.v AS i, b.v AS j, {r('corr(a.r,b.r)',8,'rho')} FROM rk a JOIN rk b ON a.row_id=b.row_id AND a.v<b.v GROUP BY 1,2"),
    "top_variance_dims": q(AR, f"SELECT v AS var_id, {r('var_samp(y)',8,'variance')} FROM ar GROUP BY v ORDER BY var_samp(y) DESC, v LIMIT 10"),
    "log2_events": q(EV, f"SELECT row_id, v AS var_id, {r('log2(y+1)',8,'value')} FROM el"),
    "transposed_events": q(EV, "SELECT v::BIGINT AS row_id, row_id::INT AS var_id, y AS value FROM el"),
    "gene_intersection": f"""SELECT w.var_name, w.pos, coalesce(v.var_id,-1)::INT AS var_id FROM (SELECT 'd'||(p_partkey%96) AS var_name, min(p_partkey)::INT AS pos FROM part GROUP BY 1) w
 LEFT JOIN (SELECT range::INT AS var_id, 'd'||range AS var_name FROM range({P})) v USING (var_name)""",
    "anndata_select": q(EV, "SELECT row_id, view::DOUBLE AS view_n, click::DOUBLE AS click_n, signup::DOUBLE AS signup_n FROM ev"),
    "lambda_rules": f"""SELECT label, n, {r(f'sqrt(2*ln(CASE WHEN {P}/sqrt(n)>1 THEN {P}/sqrt(n) ELSE {P} END)/n)',9,'scaled')}, {r('1/sqrt(n)',9,'relaxed')}
 FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1 UNION ALL SELECT -1, count(*) FROM events)""",
    "nodewise_lasso": q(LASSO, f"SELECT i, nnz, {r('tau2',8,'tau2')}, (tau2<=1e-8)::INT AS degenerate FROM nd", True),
    "lasso_coefficients": q(LASSO, f"SELECT i, j, {r('beta',7,'beta')} FROM bl WHERE abs(beta)>1e-7", True),
    "edge_zscores": q(LASSO, f"SELECT i, j, {r('omega',5,'omega')}, {r('variance',7,'variance')}, {r('z',4,'z')} FROM ez", True),
    "edge_zscores_dof": q(LASSO, f"SELECT i, j, {r('omega*n/(((n-na)+(n-nb))/2)',5,'omega')}, {r('z*n/(((n-na)+(n-nb))/2)',4,'z')} FROM ez", True),
    "edge_pvalues": q(LASSO, f"SELECT i, j, {r('p',6,'p_value')} FROM ep", True),
    "fdr_bh": q(LASSO + "," + bh("ep", "p"), f"SELECT i, j, {r('q',6,'q_value')}, (q<=0.05)::INT AS is_edge FROM qv", True),
    "fdr_by": q(LASSO + "," + bh("ep", "p", harmonic=True), f"SELECT i, j, {r('q',6,'q_value')}, (q<=0.05)::INT AS is_edge FROM qv", True),
    "asymptotic_ci": q(LASSO, f"SELECT i, j, {r('omega-1.959963984540054::DOUBLE*sqrt(variance/n)',5,'lower')}, {r('omega+1.959963984540054::DOUBLE*sqrt(variance/n)',5,'upper')} FROM ez", True),
    "inferred_network": q(LASSO + "," + bh("ep", "p"), f"SELECT i, j, {r('omega',5,'omega')}, {r('z',4,'z')}, {r('q',6,'q_value')}, (j-i=1)::INT AS is_true FROM qv WHERE q<=0.05", True),
    "corr_prior": q(CG, f"SELECT i, j, {r('c*c',8,'prior')} FROM cg"),
    "prior_mask": q(CG, f"SELECT i, j, {r('greatest(0.1::DOUBLE, 1-0.95::DOUBLE*c*c)',8,'mask')} FROM cg"),
    "noisy_prior": q(graph() + "," + GRID + f""",
fl AS (SELECT i, j FROM gd ORDER BY {pair_key(7)}, i, j LIMIT {round(0.2 * M)})""",
        "SELECT gd.i, gd.j, (CASE WHEN fl.i IS NULL THEN (g.i IS NOT NULL)::INT ELSE 1-(g.i IS NOT NULL)::INT END)::DOUBLE AS prior FROM gd LEFT JOIN g USING (i,j) LEFT JOIN fl ON fl.i=gd.i AND fl.j=gd.j"),
    "named_prior": q(GRID + """, e AS (SELECT DISTINCT least(l_partkey%80, l_suppkey%80)::INT AS i, greatest(l_partkey%80, l_suppkey%80)::INT AS j FROM lineitem WHERE l_quantity>=50)""",
        "SELECT gd.i, gd.j, (e.i IS NOT NULL)::INT::DOUBLE AS prior FROM gd LEFT JOIN e USING (i,j)"),
    "prior_reindexed": q(CG, f"SELECT (63-j)::INT AS i, (63-i)::INT AS j, {r('c*c',8,'prior')} FROM cg"),
    "evaluate_predictions": q(PAIRS + "," + curves(), f"""SELECT {r('ap/pos',8,'aupr')}, {r('u/(pos*neg)',8,'auroc')}, {r(F1,8,'f1')}, {r('f1_opt',8,'f1_opt')}, {r(MCC,8,'mcc')}, {r(PREC,8,'precision')}, {r(REC,8,'recall')},
  fp+fn AS shd, tp, fp, tn, fn FROM tot, ag, f1, au"""),
    "evaluate_sliced": q(PAIRS + "," + curves(), f"SELECT {r('ap/pos',8,'aupr')}, {r('u/(pos*neg)',8,'auroc')}, {r('f1_opt',8,'f1_opt')} FROM tot, ag, f1, au"),
    "confusion_metrics": q(PAIRS + "," + curves(), f"SELECT tp, fp, tn, fn, fp+fn AS shd, {r(PREC,8,'precision')}, {r(REC,8,'recall')}, {r(F1,8,'f1')}, {r(MCC,8,'mcc')} FROM tot"),
    "confusion_by_label": q(AR + """,
pr AS (SELECT a.label AS key, a.v AS i, b.v AS j, round(abs(corr(a.y,b.y)),9) AS score, (abs(corr(a.y,b.y))>0.5)::INT AS pred, (b.v-a.v=1)::INT AS truth
  FROM ar a JOIN ar b ON a.row_id=b.row_id AND a.v<b.v GROUP BY 1,2,3),""" + curves("key"),
        f"SELECT key, {r('ap/pos',7,'aupr')}, {r('u/(pos*neg)',7,'auroc')}, {r('f1_opt',7,'f1_opt')}, {r(MCC,7,'mcc')}, fp+fn AS shd FROM tot JOIN ag USING (key) JOIN f1 USING (key) JOIN au USING (key)"),
    "benchmark_summary": q(RES, f"SELECT method, topology, count(*) AS n, {r('avg(mcc)',8,'mean')}, {r('stddev_samp(mcc)',8,'std')}, {r('stddev_samp(mcc)/sqrt(count(*))',8,'sem')} FROM rs GROUP BY 1,2"),
    "seed_summary": q(RES, f"SELECT method, count(*) AS n_seeds, {r('avg(m)',8,'mean')}, {r('stddev_samp(m)',8,'std')} FROM (SELECT method, seed_offset, avg(mcc) AS m FROM rs GROUP BY 1,2) GROUP BY 1"),
    "wall_percentiles": q(RES, "SELECT method, " + ", ".join(r(f"quantile_cont(wall_seconds,{v}::DOUBLE)", 6, n) for v, n in ((.25, "p25"), (.5, "median"), (.75, "p75"))) + " FROM rs GROUP BY 1"),
    "radar_normalised": q(RES + ", a AS (SELECT method, avg(mcc) AS m, avg(aupr) AS u FROM rs GROUP BY 1)", f"SELECT method, {r('m/max(m) OVER ()',8,'mcc')}, {r('u/max(u) OVER ()',8,'aupr')} FROM a"),
    "diffusion_scatter": q(RES, f"""SELECT method, config, topology, {r('d',8,'diffusion_spearman_norm')}, {r('s',8,'mcc')} FROM
 (SELECT method, config, topology, avg(aupr) AS d FROM rs GROUP BY 1,2,3) JOIN (SELECT method, config, topology, avg(mcc) AS s FROM rs GROUP BY 1,2,3) USING (method, config, topology)"""),
    "normalised_scores": q(RES, f"SELECT rep, {r('(mcc-aupr)/(1-aupr)',8,'score')} FROM rs"),
    "summary_rebuild": q(RES + ", nw AS (SELECT * FROM rs WHERE rep%2=1)", f"""SELECT 'synthetic' AS benchmark, method, config, seed_offset, rep, {r('mcc',8,'mcc')}, NULL::INT AS extra FROM rs e WHERE rep%2=0
  AND NOT EXISTS (SELECT 1 FROM nw WHERE nw.method=e.method AND nw.config=e.config AND nw.seed_offset=e.seed_offset)
 UNION ALL SELECT 'synthetic', method, config, seed_offset, rep, {r('mcc',8,'mcc')}, 1 FROM nw"""),
    "missing_tasks": q(RES, "SELECT DISTINCT method, topology, config, seed_offset FROM rs EXCEPT SELECT method, topology, config, seed_offset FROM rs WHERE mcc>0.8"),
    "task_grid": q(RES, "SELECT * FROM (SELECT DISTINCT method FROM rs), (SELECT DISTINCT topology FROM rs), (SELECT DISTINCT config FROM rs)"),
    "symmetrize_gold": q(GOLD, "SELECT DISTINCT i, j FROM gp WHERE i<j"),
    "gold_coverage": q(CG + "," + GOLD + ", f AS (SELECT abs(coalesce(c,0)) AS a FROM gp LEFT JOIN cg USING (i,j))",
        f"SELECT (SELECT count(*) FROM go WHERE label=1) AS total_gold, count(*) AS in_gene_set, count(*) FILTER (a>=0.1) AS detectable, {r('count(*) FILTER (a>=0.1)/count(*)::DOUBLE',8,'coverage')}, {r('median(a)',8,'median_abs')}, {r('avg(a)',8,'mean_abs')} FROM f"),
    "degree": q(graph(), "SELECT node, degree FROM dg"),
    "network_summary": q(graph(), f"SELECT count(*) AS nodes, (sum(degree)/2)::BIGINT AS edges, {r(f'sum(degree)/2.0::DOUBLE/{M}',8,'density')}, {r('avg(degree)',8,'mean_degree')}, max(degree) AS max_degree FROM dg"),
    "hub_nodes": q(graph(), "SELECT 'd'||node AS gene, degree::DOUBLE AS score FROM dg WHERE degree>=(SELECT quantile_cont(degree::DOUBLE,0.9::DOUBLE) FROM dg)"),
    "degree_tiers": q(graph() + "," + TIERS, "SELECT node, degree, tier FROM dt"),
    "components": q(graph(0.8) + ", rc(node, c) AS (SELECT node, node FROM nodes UNION SELECT bo.v, rc.c FROM rc JOIN bo ON bo.u=rc.node)", "SELECT node, min(c) AS component FROM rc GROUP BY 1", True),
    "laplacian": q(graph(), "SELECT u AS i, v AS j, -1.0::DOUBLE AS l FROM bo UNION ALL SELECT node, node, degree::DOUBLE FROM dg WHERE degree>0"),
    "laplacian_normalised": q(graph(), f"SELECT u AS i, v AS j, {r('-1/sqrt(a.degree*b.degree::DOUBLE)',9,'l')} FROM bo JOIN dg a ON a.node=u JOIN dg b ON b.node=v UNION ALL SELECT node, node, 1.0 FROM dg WHERE degree>0"),
    "betweenness": q(graph() + f""",
rw AS (SELECT node, list(coalesce(w.o,0)::DOUBLE ORDER BY n2) AS r FROM (SELECT a.node, b.node AS n2, 1 AS o FROM nodes a, nodes b) x LEFT JOIN (SELECT u, v, 1 AS o FROM bo) w ON w.u=x.node AND w.v=x.n2 GROUP BY node),
am AS (SELECT list(r ORDER BY node) AS m FROM rw),
wk(k, s, x) AS (SELECT 0, node, list_transform(range({P}), lambda z: (z=node)::INT::DOUBLE) FROM nodes
  UNION ALL SELECT k+1, s, list_transform(range({P}), lambda z: list_inner_product(m[z+1], x)) FROM wk, am WHERE k<{P - 1}),
sp AS (SELECT s, t::INT AS t, min(k) AS d, arg_min(x[t+1], k) AS n FROM wk, range({P}) e(t) WHERE x[t+1]>0 GROUP BY 1,2),
bs AS (SELECT v.t AS node, sum(v.n*w.n/st.n) AS b FROM sp st JOIN sp v ON v.s=st.s JOIN sp w ON w.s=v.t AND w.t=st.t
  WHERE st.s<>st.t AND v.t<>st.s AND v.t<>st.t AND v.d+w.d=st.d GROUP BY 1)""",
        f"SELECT node, {r(f'coalesce(b,0)/{(P - 1) * (P - 2)}::DOUBLE',8,'score')} FROM nodes LEFT JOIN bs USING (node)", True),
    "eigenvector_centrality": q(graph() + f""",
rw AS (SELECT node, list(coalesce(w.o, (x.node=x.n2)::INT)::DOUBLE ORDER BY n2) AS r FROM (SELECT a.node, b.node AS n2 FROM nodes a, nodes b) x LEFT JOIN (SELECT u, v, 1 AS o FROM bo) w ON w.u=x.node AND w.v=x.n2 GROUP BY node),
am AS (SELECT list(r ORDER BY node) AS m FROM rw),
pw(k, x, gap) AS (SELECT 0, list_transform(range({P}), lambda z: 1.0::DOUBLE/{P}), 1e9::DOUBLE
  UNION ALL SELECT k+1, list_transform(y, lambda a: a/nrm), list_sum(list_transform(range({P}), lambda z: abs(y[z+1]/nrm-x[z+1]))) FROM (
    SELECT k, x, y, sqrt(list_inner_product(y,y)) AS nrm FROM (SELECT k, x, list_transform(range({P}), lambda z: list_inner_product(m[z+1], x)) AS y FROM pw, am WHERE gap>={P}*1e-6 AND k<1000)))""",
        f"SELECT node, {r(f'CASE WHEN gap<{P}*1e-6 THEN x[node+1] ELSE degree::DOUBLE END',7,'score')} FROM dg, (SELECT x, gap FROM pw ORDER BY k DESC LIMIT 1)", True),
    "modularity_score": q(graph() + ", mm AS (SELECT count(*)::DOUBLE AS m FROM g)",
        f"SELECT {r('sum(((u IS NOT NULL)::INT - a.degree*b.degree/(2*m)))/(2*min(m))',8,'modularity')} FROM dg a JOIN dg b ON a.node//8=b.node//8 LEFT JOIN bo ON u=a.node AND v=b.node, mm"),
    "community_sets": q(graph(0.8) + """, rc(node, c) AS (SELECT node, node FROM nodes UNION SELECT bo.v, rc.c FROM rc JOIN bo ON bo.u=rc.node),
cm AS (SELECT node, min(c) AS c FROM rc GROUP BY 1), sz AS (SELECT c, count(*) AS n FROM cm GROUP BY 1),
nm AS (SELECT c, 'community_'||(row_number() OVER (ORDER BY n DESC, c)-1) AS s FROM sz WHERE n>=2)""",
        "SELECT coalesce(s,'community_other') AS set_name, 'd'||node AS gene FROM cm LEFT JOIN nm USING (c)", True),
    "triangle_closing_edges": q(graph(), f"SELECT i, j, {r('gw.w',8,'w')}, {r('a.w+b.w',8,'support')} FROM gw JOIN bo a ON a.u=10 AND a.v=i JOIN bo b ON b.u=10 AND b.v=j"),
    "edge_filtration": q(graph() + """, mx AS (SELECT max(w) AS hi, min(w) AS lo FROM gw),
tg AS (SELECT k::INT AS step, CASE WHEN k=0 THEN hi WHEN k=19 THEN lo ELSE pow(10, log10(hi)+(log10(lo)-log10(hi))/19*k) END AS t FROM mx, range(20) s(k))""",
        f"SELECT step, {r('t',8,'threshold')}, count(w) AS active_edges FROM tg LEFT JOIN gw ON w>=t GROUP BY step, t"),
    "filtration_degrees": q(graph() + """, mx AS (SELECT max(w) AS hi, min(w) AS lo FROM gw),
tg AS (SELECT k::INT AS step, CASE WHEN k=0 THEN hi WHEN k=19 THEN lo ELSE pow(10, log10(hi)+(log10(lo)-log10(hi))/19*k) END AS t FROM mx, range(20) s(k))""",
        "SELECT step, u AS node, count(*) AS degree FROM tg JOIN bo ON w>=t GROUP BY 1,2"),
    "random_graph": q(graph() + "," + GRID, f"SELECT i, j FROM gd ORDER BY {pair_key(3)}, i, j LIMIT (SELECT count(*) FROM g)"),
    "expression_csv": """SELECT var_name, (2*count(*))::BIGINT AS samples, (2*count(*))::BIGINT AS n, (2*sum(value::DECIMAL(18,2)))::DOUBLE AS total,
 min(value) AS low, max(value) AS high FROM (SELECT unnest(['l_quantity','l_extendedprice','l_discount','l_tax']) AS var_name,
 unnest([l_quantity::DOUBLE, l_extendedprice::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE]) AS value FROM lineitem) GROUP BY var_name""",
    "edge_ranking": q(graph(), f"SELECT i, j, {r('w',9,'w')} FROM gw ORDER BY gw.w DESC, i, j"),
    "diffusion_signal": q(graph() + ", b1 AS (SELECT u, v, 1.0::DOUBLE AS w FROM bo)," + heat("b1", "h") + "," + heat_signal("h", T_GRID),
        f"SELECT node, t_idx, {r('s',8,'s')} FROM h_s", True),
    "correlation_pvalues": q(TESTED, f"SELECT i, j, {r('p',8,'p_value')} FROM tp"),
    "correlation_fdr": q(TESTED + "," + bh("tp", "p"), f"SELECT i, j, {r('q',6,'q_value')}, (q<=0.05)::INT AS is_edge FROM qv"),
    "correlation_fdr_sliced": q(TESTED + "," + bh("tp", "p", harmonic=True), f"SELECT i, j, {r('q',6,'q_value')} FROM qv"),
    "ranked_min_p": q(TESTED, f"SELECT node, {r('coalesce(-log10(min(p)),0)',4,'score')} FROM nodes LEFT JOIN sb2 ON u=node GROUP BY 1"),
    "ranked_degree": q(TESTED, "SELECT node, count(p)::DOUBLE AS score FROM nodes LEFT JOIN sb2 ON u=node GROUP BY 1"),
    "ranked_fisher": q(TESTED, f"SELECT node, {r('coalesce(-2*sum(ln(p)),0)',3,'score')} FROM nodes LEFT JOIN sb2 ON u=node GROUP BY 1"),
}

_SPREAD = ",".join(f"({t}::DOUBLE)" for t in STARS_GRID)
_STARS = AR + "," + subsets("embeddings", "vec_id", 20, 0, "0.75::DOUBLE") + f""",
sc AS (SELECT s, a.v AS i, b.v AS j, abs(corr(a.y,b.y)) AS c FROM sb JOIN ar a USING (row_id) JOIN ar b ON a.row_id=b.row_id AND a.v<b.v GROUP BY 1,2,3),
tg(theta) AS (VALUES {_SPREAD}),
fq AS (SELECT theta, i, j, sum((c>theta)::INT)/20.0::DOUBLE AS f FROM sc, tg GROUP BY 1,2,3),
dd AS (SELECT theta, avg(4*f*(1-f)) AS d FROM fq GROUP BY 1)"""
_LAM4 = "sqrt(2*ln(CASE WHEN 4/sqrt(n)>1 THEN 4/sqrt(n) ELSE 4 END)/n)"


def small_fits(source: str) -> str:
    """Fits of every group ``s`` of a 4-variable long table ``s, row_id, v, y``."""
    step = "w[j+1]+eta*(m[i+1][j+1]-list_inner_product(m[j+1],w))"
    return f"""c4 AS (SELECT a.s, a.v AS i, b.v AS j, corr(a.y,b.y) AS c, count(*)::DOUBLE AS n FROM {source} a JOIN {source} b ON a.s=b.s AND a.row_id=b.row_id GROUP BY 1,2,3),
r4 AS (SELECT s, n, i, list(CASE WHEN i=j THEN 1.0::DOUBLE ELSE c END ORDER BY j) AS r FROM c4 GROUP BY 1,2,3),
m4 AS (SELECT s, n, {_LAM4} AS lam, list(r ORDER BY i) AS m, 1/max(list_sum(list_transform(r, lambda x: abs(x)))) AS eta FROM r4 GROUP BY s, n),
t4(k,s,i,b,w) AS (SELECT 0, s, i, [0.0::DOUBLE,0.0,0.0,0.0], [0.0::DOUBLE,0.0,0.0,0.0] FROM r4
 UNION ALL SELECT k+1, s, i, nb, list_transform(range(4), lambda j: nb[j+1]+(k%60)::DOUBLE/((k%60)+3)*(nb[j+1]-b[j+1])) FROM (
  SELECT k, t4.s, i, b, list_transform(range(4), lambda j: CASE WHEN j=i THEN 0.0::DOUBLE ELSE sign({step})*greatest(abs({step})-eta*lam,0.0::DOUBLE) END) AS nb
  FROM t4 JOIN m4 ON t4.s=m4.s WHERE k<600)),
b4 AS (SELECT t4.s, i, b, n, 1-2*list_inner_product(b,m[i+1])+list_sum(list_transform(range(4), lambda j: b[j+1]*list_inner_product(m[j+1],b))) AS tau2 FROM t4 JOIN m4 ON t4.s=m4.s WHERE k=600),
e4 AS (SELECT x.s, x.n, x.i, y.i AS j, (-x.b[y.i+1]/x.tau2-y.b[x.i+1]/y.tau2)/2 AS omega, x.tau2*y.tau2 AS variance FROM b4 x JOIN b4 y ON x.s=y.s AND x.i<y.i)"""


def _tail(k: str, K: str, n: str, N: str) -> str:
    lc = lambda a, b: f"(lgamma({a}+1)-lgamma({b}+1)-lgamma({a}-{b}+1))"
    return (f"least(1.0::DOUBLE, list_sum(list_transform(list_filter(range({k}, least({K},{n})+1), lambda x: {n}-x<={N}-{K}), lambda x: "
            f"exp({lc(K, 'x')}+{lc(f'({N}-{K})', f'({n}-x)')}-{lc(N, n)}))))")


_KO = graph() + f""",
xs AS (SELECT x.node AS ko, bo.u, bo.v, CASE WHEN bo.u=x.node OR bo.v=x.node THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS w FROM nodes x, bo
  UNION ALL SELECT -1, u, v, 1.0 FROM bo),
kd AS (SELECT ko, u, sum(w) AS d FROM xs GROUP BY 1,2),
kc AS (SELECT 2*max(d) AS c FROM kd),
kr AS (SELECT z.ko, z.a AS i, list(CASE WHEN z.a=z.b THEN 1-coalesce(d,0)/c ELSE coalesce(w,0)/c END ORDER BY z.b) AS r
  FROM (SELECT y.ko, a.node AS a, b.node AS b FROM (SELECT DISTINCT ko FROM xs) y, nodes a, nodes b) z CROSS JOIN kc
  LEFT JOIN kd ON kd.ko=z.ko AND kd.u=z.a LEFT JOIN xs ON xs.ko=z.ko AND xs.u=z.a AND xs.v=z.b GROUP BY 1,2),
km AS (SELECT ko, list(r ORDER BY i) AS m FROM kr GROUP BY ko),
kv(k, ko, v) AS (SELECT 0, ko, list_transform(range({P}), lambda x: (x=hub)::INT::DOUBLE) FROM km, hb
  UNION ALL SELECT k+1, kv.ko, list_transform(range({P}), lambda x: list_inner_product(m[x+1], v)) FROM kv JOIN km ON kv.ko=km.ko WHERE k<90),
kt(t_idx,t) AS (VALUES {",".join(f"({k},{t}::DOUBLE)" for k, t in enumerate(T_GRID))}),
ks AS (SELECT ko, t_idx, node, sum(exp(-c*t+k*ln(c*t)-lgamma(k+1))*v[node+1]) AS s FROM kv, kc, kt, nodes GROUP BY 1,2,3),
kn AS (SELECT a.ko AS node, a.t_idx, sqrt(sum(pow(a.s-b.s,2))) AS d FROM ks a JOIN ks b ON b.ko=-1 AND a.ko>=0 AND a.t_idx=b.t_idx AND a.node=b.node GROUP BY 1,2)"""

_P1, _P2, _P3, _NF = FRAMES
_SMOOTH = "(t*t*(3-2*t))"

ORACLES.update({
    "npn_shrinkage": q(EV + "," + ranks("el") + """, cl AS (SELECT *, 1/(4*pow(n,0.25::DOUBLE)*sqrt(pi()*ln(n))) AS d FROM rk),
cu AS (SELECT *, greatest(d, least(1-d, r/(n+1))) AS u FROM cl),""" + ppf("u", "", "cu"),
        f"SELECT row_id, v AS var_id, {r('q3.x',7,'value')} FROM cu JOIN q3 USING (u)"),
    "npn_chain": q(AR + "," + ranks("ar") + """, cl AS (SELECT *, 1/(4*pow(rk.n,0.25::DOUBLE)*sqrt(pi()*ln(rk.n))) AS d FROM rk),
cu AS (SELECT *, greatest(d, least(1-d, r/(n+1))) AS u FROM cl),""" + ppf("u", "", "cu"),
        f"SELECT v AS var_id, count(*) AS n, {r('max(q3.x)',7,'hi')}, {r('stddev_pop(q3.x)',7,'sd')} FROM cu JOIN q3 USING (u) GROUP BY 1"),
    "line_network": q(LINE_CHAIN + ", sx AS (SELECT 0 AS s, row_id, v, y FROM ll)," + small_fits("sx") + f", z4 AS (SELECT *, sqrt(n)*omega/sqrt(variance) AS z FROM e4), p4 AS (SELECT *, {two_sided('z')} AS p FROM z4)," + bh("p4", "p"),
        f"SELECT i, j, {r('omega',6,'omega')}, {r('z',3,'z')}, {r('q',6,'q_value')}, (q<=0.05)::INT AS is_edge FROM qv", True),
    "ensemble_ci": q(LINE_CHAIN + "," + subsets("ln", "row_id", 25, 0, "0.5::DOUBLE") + ", sx AS (SELECT s, row_id, v, y FROM sb JOIN ll USING (row_id))," + small_fits("sx"),
        f"SELECT i, j, {r('avg(omega)',6,'omega')}, {r('avg(omega)-1.959963984540054::DOUBLE*stddev_samp(omega)/5',6,'lower')}, {r('avg(omega)+1.959963984540054::DOUBLE*stddev_samp(omega)/5',6,'upper')} FROM e4 GROUP BY 1,2", True),
    "stars_instability": q(_STARS, f"SELECT theta, {r('d',8,'d')} FROM dd"),
    "stars_select": q(_STARS + ", cg AS (SELECT a.v AS i, b.v AS j, corr(a.y, b.y) AS c FROM ar a JOIN ar b ON a.row_id=b.row_id AND a.v<b.v GROUP BY 1,2), ch AS (SELECT coalesce(max(theta) FILTER (d<=0.05), min(theta)) AS theta FROM dd)",
        "SELECT i, j, theta FROM cg, ch WHERE abs(c)>theta"),
    "cascade_removals": q(graph() + """, tr AS (SELECT i, j, a.w+b.w AS s FROM gw JOIN bo a ON a.u=10 AND a.v=i JOIN bo b ON b.u=10 AND b.v=j)""",
        """SELECT 0 AS phase, (row_number() OVER (ORDER BY w, i, j)-1)::INT AS pos, i, j FROM gw WHERE i=10 OR j=10
 UNION ALL SELECT 1, (rn-1)::INT, i, j FROM (SELECT *, row_number() OVER (ORDER BY s DESC, i, j) AS rn FROM tr) WHERE rn<=30"""),
    "cascade_schedule": q(graph() + f""", sz AS (SELECT (SELECT count(*) FROM gw) AS tot, (SELECT count(*) FROM bo WHERE u=10) AS h,
  (SELECT least(30,count(*)) FROM gw JOIN bo a ON a.u=10 AND a.v=i JOIN bo b ON b.u=10 AND b.v=j) AS s),
fr AS (SELECT f::INT AS frame, greatest(0,least(1,(f-{_P1})/{_P2 - _P1}.0::DOUBLE)) AS t1, greatest(0,least(1,(f-{_P2})/{_P3 - _P2}.0::DOUBLE)) AS t2 FROM range({_NF}) x(f)),
rm AS (SELECT frame, round_even(t1*t1*(3-2*t1)*h,0)::BIGINT AS a, round_even(t2*t2*(3-2*t2)*s,0)::BIGINT AS b, tot, h FROM fr, sz)""",
        "SELECT frame, a AS hub_removed, b AS secondary_removed, tot-a-b AS edges_left, h-a AS hub_edges_left FROM rm"),
    "ora_hypergeom": q(graph() + "," + TIERS + "," + TERMS + """,
st AS (SELECT tier AS set_name, 'd'||node AS gene FROM dt), ns AS (SELECT set_name, count(*) AS n FROM st GROUP BY 1),
nt AS (SELECT term_id, count(*) AS K FROM tm GROUP BY 1), na AS (SELECT count(DISTINCT gene) AS N FROM tm),
hx AS (SELECT set_name, term_id, count(*) AS h FROM st JOIN tm USING (gene) GROUP BY 1,2),
hp AS (SELECT set_name, term_id, h, K AS tk, ns.n AS nq, """ + _tail("h", "K", "ns.n", "na.N") + """ AS p FROM hx JOIN ns USING (set_name) JOIN nt USING (term_id), na),
hr AS (SELECT *, row_number() OVER (PARTITION BY set_name ORDER BY p) AS rn, count(*) OVER (PARTITION BY set_name) AS m FROM hp)""",
        f"SELECT set_name, term_id, h AS intersection_size, tk AS term_size, nq AS query_size, {r('p',9,'p_value')}, {r('least(1.0::DOUBLE, min(p*m/rn) OVER (PARTITION BY set_name ORDER BY rn DESC ROWS UNBOUNDED PRECEDING))',8,'adjusted_p_value')} FROM hr"),
    "enrich_hubs": q(graph() + "," + TERMS + """,
st AS (SELECT 'd'||node AS gene FROM dg WHERE degree>=(SELECT median(degree) FROM dg)), ns AS (SELECT count(*) AS n FROM st),
nt AS (SELECT term_id, count(*) AS K FROM tm GROUP BY 1), na AS (SELECT count(DISTINCT gene) AS N FROM tm),
hx AS (SELECT term_id, count(*) AS h FROM st JOIN tm USING (gene) GROUP BY 1)""",
        f"SELECT 'hub_genes' AS gene_set_name, 'all' AS level, 'gprofiler' AS backend, 'ora' AS method, term_id, h AS intersection_size, {r(_tail('h','K','ns.n','na.N'),9,'p_value')} FROM hx JOIN nt USING (term_id), ns, na"),
    "gsea_es": q(CG + "," + TERMS + """,
sx AS (SELECT 'd'||n AS gene, round(sum(a),9) AS s FROM (SELECT i AS n, abs(c) AS a FROM cg UNION ALL SELECT j, abs(c) FROM cg) GROUP BY 1),
ps AS (SELECT gene, s, row_number() OVER (ORDER BY s DESC, gene) AS pos, count(*) OVER () AS n FROM sx),
tt AS (SELECT DISTINCT term_id FROM tm), wk AS (SELECT term_id, gene, pos, s, n, tm.gene IS NOT NULL AS hit FROM tt CROSS JOIN ps LEFT JOIN tm USING (term_id, gene)),
tl AS (SELECT term_id, sum(s) FILTER (hit) AS w, count(*) FILTER (hit) AS k FROM wk GROUP BY 1),
rn AS (SELECT term_id, k, sum(CASE WHEN hit THEN s/w ELSE -1.0::DOUBLE/(n-k) END) OVER (PARTITION BY term_id ORDER BY pos) AS d FROM wk JOIN tl USING (term_id))""",
        f"SELECT term_id, k AS hits, {r('CASE WHEN max(d)>=-min(d) THEN max(d) ELSE min(d) END',8,'es')} FROM rn GROUP BY 1,2"),
    "diffusion_metrics": q(graph() + f""", b1 AS (SELECT u, v, 1.0::DOUBLE AS w FROM bo),
b2 AS (SELECT a AS u, b AS v, 1.0::DOUBLE AS w FROM (SELECT x.node AS a, y.node AS b FROM nodes x JOIN nodes y ON abs(x.node-y.node)=1)),""" + heat("b1", "h") + "," + heat_signal("h", [0.5, 1.0]) + "," + heat("b2", "e") + "," + heat_signal("e", [0.5, 1.0]) + """,
bo2 AS (SELECT h_s.t_idx, h_s.node, h_s.s AS rb, e_s.s AS ra, round(h_s.s,12) AS b, round(e_s.s,12) AS a FROM h_s JOIN e_s USING (t_idx, node)),
rr AS (SELECT *, rank() OVER (PARTITION BY t_idx ORDER BY a)+(count(*) OVER (PARTITION BY t_idx,a)-1)/2.0::DOUBLE AS ka, rank() OVER (PARTITION BY t_idx ORDER BY b)+(count(*) OVER (PARTITION BY t_idx,b)-1)/2.0::DOUBLE AS kb FROM bo2),
pt AS (SELECT t_idx, corr(ka,kb) AS rho, avg(abs(ra-rb)) AS mae FROM rr GROUP BY 1), rc(node, c) AS (SELECT node, node FROM nodes UNION SELECT bo.v, rc.c FROM rc JOIN bo ON bo.u=rc.node)""",
        f"SELECT {r('avg(rho)',6,'diffusion_spearman_mean')}, {r('min(rho)',6,'diffusion_spearman_min')}, {r('avg(mae)',8,'diffusion_mae_mean')}, (SELECT count(DISTINCT c) FROM (SELECT node, min(c) AS c FROM rc GROUP BY 1)) AS n_components_pred FROM pt", True),
    "knockout_impact": q(_KO, f"SELECT node, {r('max(d)',8,'impact')} FROM kn GROUP BY 1", True),
})

for _name in ("kendall_edges", "kendall_edges_binned"):
    ORACLES[_name] = q(EV + """,
kp AS (SELECT a.v AS i, b.v AS j, a.row_id, a.y AS x, b.y AS y FROM el a JOIN el b ON a.row_id=b.row_id AND a.v<b.v),
kk AS (SELECT p.i, p.j, sum(sign(p.x-t.x)*sign(p.y-t.y)) AS s, sum((p.x<>t.x)::INT) AS nx, sum((p.y<>t.y)::INT) AS ny FROM kp p JOIN kp t ON p.i=t.i AND p.j=t.j AND p.row_id<t.row_id GROUP BY 1,2)""",
        f"SELECT i, j, {r('s/sqrt(nx::DOUBLE*ny::DOUBLE)',8,'tau')} FROM kk")
ORACLES["skeptic_latent_corr"] = q(EV + "," + ranks("el") + """,
kp AS (SELECT a.v AS i, b.v AS j, a.row_id, a.y AS x, b.y AS y FROM el a JOIN el b ON a.row_id=b.row_id AND a.v<b.v),
kk AS (SELECT p.i, p.j, sum(sign(p.x-t.x)*sign(p.y-t.y))/sqrt(sum((p.x<>t.x)::INT)::DOUBLE*sum((p.y<>t.y)::INT)::DOUBLE) AS tau FROM kp p JOIN kp t ON p.i=t.i AND p.j=t.j AND p.row_id<t.row_id GROUP BY 1,2),
sr AS (SELECT a.v AS i, b.v AS j, corr(a.r,b.r) AS rho FROM rk a JOIN rk b ON a.row_id=b.row_id AND a.v<b.v GROUP BY 1,2)""",
    f"SELECT i, j, {r('sin(pi()/2*tau)',8,'c_tau')}, {r('2*sin(pi()/6*rho)',8,'c_rho')} FROM kk JOIN sr USING (i,j)")
