"""SQL for the registered queries, written for an independent engine."""

from __future__ import annotations

from ..functions import mathx
from .views import ctes


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def _avg_rank(value: str, group: str) -> str:
    return f"(rank() OVER (PARTITION BY {group} ORDER BY {value}) + (count(*) OVER (PARTITION BY {group}, {value}) - 1) / 2.0::DOUBLE)"


def _u(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS STRING)" for p in parts)
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0::DOUBLE)"


def area_ctes(net: str, m: str, out: str, ordinal: bool = False, eset: bool = False, least: int = 30) -> str:
    source = f"(SELECT * FROM {m} WHERE feature IN (SELECT target FROM {net} UNION SELECT regulator FROM {net}))" if eset else m
    rank = "row_number() OVER (PARTITION BY sample ORDER BY value, feature)" if ordinal else _avg_rank("value", "sample")
    return f""", {out}_p AS (
  SELECT regulator, target, mor, likelihood FROM (SELECT *, count(*) OVER (PARTITION BY regulator) AS n FROM {net}) WHERE n >= {least}
), {out}_e AS (SELECT * FROM {out}_p WHERE target IN (SELECT feature FROM {source} x)),
{out}_w AS (
  SELECT regulator, target, mor, likelihood / sum(likelihood) OVER (PARTITION BY regulator) AS w FROM {out}_e
), {out}_i AS (SELECT regulator, sqrt(sum(likelihood * likelihood)) / max(likelihood) AS icp FROM {out}_e GROUP BY regulator),
{out}_t AS (SELECT sample, feature, {rank} / (count(*) OVER (PARTITION BY sample) + 1.0::DOUBLE) AS t2 FROM {source} x),
{out}_t1 AS (SELECT *, 2 * abs(t2 - 0.5) AS a FROM {out}_t),
{out}_l AS (SELECT sample, feature, t2, a + (1 - max(a) OVER ()) / 2 AS t1 FROM {out}_t1),
{out}_z AS (SELECT sample, feature, {mathx.ppf('t2')} AS z2, {mathx.ppf('t1')} AS z1 FROM {out}_l),
{out}_s AS (
  SELECT sample, regulator, sum(w * mor * z2) AS d, sum(w * (1 - abs(mor)) * z1) AS u
  FROM {out}_z JOIN {out}_w ON feature = target GROUP BY sample, regulator
), {out} AS (
  SELECT sample, s.regulator AS regulator, (abs(d) + greatest(u, 0)) * sign(d) * icp AS nes FROM {out}_s s JOIN {out}_i i ON s.regulator = i.regulator
)"""


def _combine(name: str, source: str, d: str, u: str, keep: str, out: str) -> str:
    plus = mathx.logsf(f"(({d}) + ({u})) / sqrt(2 + 2 * rho)")
    minus = mathx.logsf(f"(({u}) - ({d})) / sqrt(2 - 2 * rho)")
    return f""", {name}_1 AS (SELECT {keep}, {plus} AS p_, {minus} AS m_ FROM {source}),
{name}_2 AS (SELECT *, least(p_, m_) + ln(1 - exp(least(p_, m_)) / 2) AS f_ FROM {name}_1),
{name} AS (SELECT {keep}, CASE WHEN p_ < m_ THEN {mathx.log_quantile('f_')} ELSE -({mathx.log_quantile('f_')}) END AS {out} FROM {name}_2)"""


def narnea_ctes(net: str, m: str, o: str) -> str:
    return f""", {o}_p AS (
  SELECT regulator, target, mor, likelihood AS l FROM (SELECT *, count(*) OVER (PARTITION BY regulator) AS n FROM {net}) WHERE n >= 30
), {o}_e AS (
  SELECT regulator, target, l, CASE WHEN abs(mor) >= 1 THEN sign(mor) * 0.999::DOUBLE WHEN mor = 0 THEN 0.002::DOUBLE * ({_u("'0'", 'regulator', 'target')} - 0.5) ELSE mor END AS mor
  FROM {o}_p WHERE target IN (SELECT feature FROM {m})
), {o}_a AS (SELECT *, mor * l AS a, (1 - abs(mor)) * l AS b, dense_rank() OVER (PARTITION BY regulator ORDER BY l DESC) AS place FROM {o}_e),
{o}_q AS (
  SELECT regulator, sum(a) AS sa, sum(a * a) AS saa, sum(b) AS sb, sum(b * b) AS sbb, sum(a * b) AS sab, sum(abs(mor) * l) AS pa,
         sum(abs(mor) * l * place) AS pap, sum((1 - abs(mor)) * l) AS pb, sum((1 - abs(mor)) * l * place) AS pbp FROM {o}_a GROUP BY regulator
), {o}_f AS (SELECT min(value) FILTER (value <> 0) AS least, CAST(count(*) FILTER (value > 0) AS DOUBLE) / count(*) FILTER (value <> 0) AS positive FROM {m}),
{o}_v AS (
  SELECT sample, feature, CASE WHEN value <> 0 THEN value ELSE (CASE WHEN {_u("'0'", 'sample', 'feature', "'s'")} < positive THEN 1 ELSE -1 END)
    * {_u("'0'", 'sample', 'feature', "'m'")} * least END AS value FROM {m}, {o}_f
), {o}_r AS (
  SELECT sample, feature, sign(value) AS s, rank() OVER (PARTITION BY sample ORDER BY abs(value)) + (count(*) OVER (PARTITION BY sample, abs(value)) - 1) / 2.0::DOUBLE AS r,
         CAST(count(*) OVER (PARTITION BY sample) AS DOUBLE) AS n FROM {o}_v
), {o}_m AS (
  SELECT sample, (any_value(n) + 1) / 2 AS e_r, (2 * any_value(n) * any_value(n) + 3 * any_value(n) + 1) / 6 AS e_r2,
         sum(r * s) / any_value(n) AS e_rs, sum(r * r * s) / any_value(n) AS e_r2s FROM {o}_r GROUP BY sample
), {o}_h AS (
  SELECT sample, regulator, sum(r * s * a) AS d, sum(r * b) AS u, any_value(n) AS n FROM {o}_r JOIN {o}_a ON feature = target GROUP BY sample, regulator
), {o}_g AS (
  SELECT h.sample AS sample, h.regulator AS regulator, sa * e_rs AS ed, saa * (e_r2 - e_rs * e_rs) AS vd, sb * e_r AS eu, sbb * (e_r2 - e_r * e_r) AS vu,
         sab * (e_r2s - e_rs * e_r) AS cov, d, u, (n + 1) * pa - pap AS dmax, (n + 1) * pb - pbp AS umax
  FROM {o}_h h JOIN {o}_q q ON h.regulator = q.regulator JOIN {o}_m m ON m.sample = h.sample
), {o}_k AS (
  SELECT sample, regulator, (d - ed) / sqrt(vd) AS zd, (u - eu) / sqrt(vu) AS zu, (dmax - ed) / sqrt(vd) AS zp, (-dmax - ed) / sqrt(vd) AS zn,
         (umax - eu) / sqrt(vu) AS zm, cov / sqrt(vd * vu) AS rho FROM {o}_g
){_combine(o + '_n', o + '_k', 'zd', 'zu', 'sample, regulator, zp, zn, zm, rho', 'nes')}{_combine(o + '_pp', o + '_n', 'zp', 'zm', 'sample, regulator, nes, zn, zm, rho', 'pos')}{_combine(o + '_nn', o + '_pp', 'zn', 'zm', 'sample, regulator, nes, pos', 'neg')},
{o} AS (SELECT sample, regulator, nes, nes / abs(CASE WHEN nes > 0 THEN pos ELSE neg END) AS pes FROM {o}_nn)"""


_PRUNED = ("SELECT regulator, target, mor, likelihood FROM (SELECT *, row_number() OVER (PARTITION BY regulator ORDER BY likelihood DESC, target, mor DESC) AS k, "
           "count(*) OVER (PARTITION BY regulator) AS n FROM n1) WHERE k <= 50 AND n >= 50")
_STOUFFER = "s AS (SELECT cluster, feature, sum(value) / sqrt(count(*)) AS score FROM m2 GROUP BY cluster, feature)"


def pleiotropy_sql() -> str:
    stat = ("(abs(sum(mor * l * z2)) + greatest(sum((1 - abs(mor)) * l * z1), 0)) / sum(l) * {0} * sqrt(sum(l * l)) / max(l)")
    return ctes("n1", "m1") + f", np AS ({_PRUNED})" + area_ctes("np", "m1", "a") + f""",
c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sample) AS k FROM a WHERE regulator NOT LIKE '%--%' AND 2 * ({mathx.sf('abs(nes)')}) < 0.05) WHERE k >= 2),
j AS (SELECT c.sample AS sample, c.regulator AS regulator, np.target AS target, mor, likelihood AS l, nes, value
  FROM c JOIN np ON c.regulator = np.regulator JOIN m1 ON m1.sample = c.sample AND m1.feature = np.target),
o0 AS (SELECT *, 2 * {_avg_rank('value', 'sample, regulator')} / (count(*) OVER (PARTITION BY sample, regulator) + 1) - 1 AS t FROM j),
o1 AS (SELECT *, 2 * abs(t) - 1 AS u0, max(2 * abs(t) - 1) OVER (PARTITION BY sample, regulator) AS top FROM o0),
o2 AS (SELECT *, t / 2 + 0.5 AS pt, (u0 + (1 - top) / 2) / 2 + 0.5 AS pu FROM o1),
o AS (SELECT sample, regulator, target, mor, l, ({mathx.ppf('pt')}) * sign(nes) AS z2, {mathx.ppf('pu')} AS z1 FROM o2),
s AS (SELECT x.*, y.regulator AS rival FROM o x JOIN o y ON x.sample = y.sample AND x.target = y.target AND x.regulator <> y.regulator),
t AS (SELECT sample, regulator, rival, {stat.format('CASE WHEN sum(mor * l * z2) < 0 THEN -1 ELSE 1 END')} AS stat FROM s GROUP BY sample, regulator, rival HAVING count(*) >= 3),
p AS (SELECT sample, regulator, rival, greatest({mathx.sf('stat')}, 1e-300) AS p FROM t),
q AS (SELECT p.*, r.p AS q, count(*) OVER (PARTITION BY p.sample, p.regulator) AS tests FROM p JOIN p r ON r.sample = p.sample AND r.regulator = p.rival AND r.rival = p.regulator),
lost AS (SELECT sample, regulator, rival, ln(1 + abs(log10(p) - log10(q))) * 20 / tests AS w FROM q WHERE p > q),
cut AS (SELECT s.sample AS sample, s.regulator AS regulator, s.target AS target, sum(w) AS w FROM s JOIN lost d ON d.sample = s.sample AND d.regulator = s.regulator AND d.rival = s.rival GROUP BY ALL),
new AS (SELECT x.sample AS sample, x.regulator AS regulator, np.target AS target, mor, likelihood * exp(-coalesce(w, 0)) AS l
  FROM (SELECT DISTINCT sample, regulator FROM lost) x JOIN np ON np.regulator = x.regulator
  LEFT JOIN cut ON cut.sample = x.sample AND cut.regulator = x.regulator AND cut.target = np.target),
again AS (SELECT n.sample AS sample, regulator, {stat.format('sign(sum(mor * l * z2))')} AS nes FROM new n JOIN a_z ON a_z.sample = n.sample AND a_z.feature = n.target GROUP BY n.sample, regulator HAVING count(*) >= 5)
SELECT a.sample AS sample, a.regulator AS regulator, round(coalesce(b.nes, a.nes), 6) AS nes FROM a LEFT JOIN again b ON b.sample = a.sample AND b.regulator = a.regulator"""


_STACK = "SELECT *, 0 AS net FROM {0} UNION ALL SELECT *, 1 AS net FROM {1}"


def _null(score: str, mean: str, sd: str) -> str:
    return f"least(1.0, 2 * ({mathx.cdf(f'(-abs({score}) - ({mean})) / nullif({sd}, 0)')}))"


_SUMS = """, g AS (SELECT cluster, feature, sum(value) AS s, sum(value * value) AS q, CAST(count(*) AS DOUBLE) AS n FROM m2 GROUP BY cluster, feature),
t AS (SELECT *, sum(s) OVER (PARTITION BY feature) AS st, sum(q) OVER (PARTITION BY feature) AS qt, sum(n) OVER (PARTITION BY feature) AS nt FROM g)"""
_CENTRED = """, c AS (SELECT sample, feature, cluster, value - avg(value) OVER (PARTITION BY sample) AS v FROM m2),
d AS (SELECT sample, cluster, list(v / n ORDER BY feature) AS v FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY sample)) AS n FROM c) GROUP BY sample, cluster),
pairs AS (SELECT a.sample AS i, b.sample AS j, a.cluster AS ci, b.cluster AS cj,
  CASE WHEN a.sample = b.sample THEN 0.0::DOUBLE ELSE sqrt(greatest(0, 1 - list_dot_product(a.v, b.v))) END AS dist FROM d a, d b)"""


def similarity_sql(method: str, nn: int | None = None) -> str:
    import math

    keep = {"two.sided": "TRUE", "greater": "value > 0", "less": "value < 0"}[method]
    slope = repr(math.log(1 / 0.9 - 1) / -2.0)
    size = f"sign(value) * ({mathx.sigmoid('abs(value)', slope, '4.0')})"
    if nn:  # two-sided
        up = "row_number() OVER (PARTITION BY sample ORDER BY value, feature)"
        size = f"CASE WHEN {up} > count(*) OVER (PARTITION BY sample) - {nn // 2} THEN 1.0::DOUBLE WHEN {up} <= {nn // 2} THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return ctes("m2") + f""", x AS (SELECT sample, feature, value * 10 AS value FROM m2),
w AS (SELECT sample, feature, value, {_avg_rank('value', 'sample')} / (count(*) OVER (PARTITION BY sample) + 1.0::DOUBLE) AS p,
  CASE WHEN {keep} THEN {size} ELSE 0.0::DOUBLE END AS w FROM x),
s AS (SELECT sample, list(w / nullif(sw, 0) ORDER BY feature) AS w, list(t ORDER BY feature) AS t, any_value(len) AS len FROM (
  SELECT sample, feature, w, {mathx.ppf('p')} AS t, sum(abs(w)) OVER (PARTITION BY sample) AS sw, sqrt(sum(w * w) OVER (PARTITION BY sample)) AS len FROM w) GROUP BY sample),
v AS (SELECT a.sample AS i, b.sample AS j, list_dot_product(a.w, b.t) * a.len AS x, list_dot_product(a.t, b.w) * b.len AS y FROM s a, s b)
SELECT i AS sample_i, j AS sample_j, round(CASE WHEN i = j THEN x WHEN x * x + y * y > 0 THEN (x * x * x + y * y * y) / (x * x + y * y) ELSE 0 END, 6) AS similarity FROM v"""


def oracle_sql() -> dict[str, str]:
    two = f"2 * ({mathx.sf('abs(z)')})"
    scaled = ctes("m2") + ", s AS (SELECT sample, feature, 10 * value AS z FROM m2)"
    out = {
        "net_targets_per_regulon": ctes("n1") + " SELECT regulator, count(DISTINCT target) AS targets FROM n1 GROUP BY regulator",
        "net_size": ctes("n1") + " SELECT count(DISTINCT regulator) AS regulators FROM n1",
        "net_summary": ctes("n1") + ", p AS (SELECT regulator, count(DISTINCT target) AS t, count(*) AS n, sum(abs(mor)) AS m, sum(likelihood) AS l FROM n1 GROUP BY regulator) "
        "SELECT count(*) AS regulators, CAST(sum(n) AS BIGINT) AS interactions, median(t) AS median_targets, round(sum(m) / sum(n), 6) AS mean_abs_mor, round(sum(l) / sum(n), 6) AS mean_likelihood FROM p",
        "net_filter_targets": ctes("n1") + " SELECT * FROM n1 WHERE target IN (SELECT CAST(p_partkey AS STRING) FROM part WHERE p_size <= 25)",
        "net_filter_regulators": ctes("n1") + " SELECT * FROM n1 WHERE regulator NOT IN (SELECT CAST(s_suppkey AS STRING) FROM supplier WHERE s_acctbal < 0)",
        "net_get_reg": ctes("n1") + " SELECT * FROM n1 WHERE regulator = '1'",
        "net_targets": ctes("n1") + " SELECT DISTINCT target FROM n1",
        "net_prune": ctes("n1") + " SELECT regulator, target, mor, likelihood FROM (SELECT *, row_number() OVER (PARTITION BY regulator ORDER BY likelihood DESC, target, mor DESC) AS k, count(*) OVER (PARTITION BY regulator) AS n FROM n1) WHERE k <= 50 AND n >= 50",
        "net_repeated_pairs": ctes("n0") + " SELECT regulator, target, count(*) AS times FROM n0 GROUP BY ALL HAVING count(*) > 1",
        "net_dedup_likelihood": ctes("n0") + " SELECT regulator, target, mor, likelihood FROM (SELECT *, row_number() OVER (PARTITION BY regulator, target ORDER BY likelihood DESC, mor DESC) AS k FROM n0) WHERE k = 1",
        "net_icp": ctes("n1") + " SELECT regulator, round(sqrt(sum(likelihood * likelihood)) / max(likelihood), 6) AS icp FROM n1 GROUP BY regulator",
        "net_ic_weights": ctes("n1") + " SELECT regulator, target, mor, round(likelihood / sum(likelihood) OVER (PARTITION BY regulator), 9) AS weight FROM n1",
        "net_normalized_likelihoods": ctes("n1") + f" SELECT regulator, target, mor, round({_avg_rank('likelihood', 'regulator')} / (count(*) OVER (PARTITION BY regulator) + 1), 6) AS likelihood FROM n1",
        "net_integrate": ctes("n2", "n3") + """, u AS (SELECT *, 1.0::DOUBLE AS w FROM n2 UNION ALL SELECT *, 2.0::DOUBLE FROM n3),
r AS (SELECT regulator, sum(w) AS total FROM (SELECT DISTINCT regulator, w FROM u) GROUP BY regulator)
SELECT u.regulator AS regulator, target, round(sum(w * mor) / any_value(total), 6) AS mor, round(sum(w * likelihood) / any_value(total), 6) AS likelihood FROM u JOIN r ON u.regulator = r.regulator GROUP BY u.regulator, target""",
        "net_translate": ctes("n1", "brands") + " SELECT regulator, name AS target, mor, likelihood FROM n1 JOIN brands ON target = id",
        "net_from_aracne": ctes("aracne") + """ SELECT regulator, target, mor, round(mi / max(mi) OVER (PARTITION BY regulator), 6) AS likelihood FROM (
  SELECT regulator, target, mi, scc AS mor, row_number() OVER (PARTITION BY regulator ORDER BY count DESC, mi DESC, target) AS k FROM aracne WHERE mi > 10) WHERE k <= 50""",
        "net_from_activity": ctes("m2") + """ SELECT sample AS regulator, feature AS target, CASE WHEN t <= 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS mor, 1.0::DOUBLE AS likelihood FROM (
  SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value DESC, feature) AS t, row_number() OVER (PARTITION BY sample ORDER BY value, feature) AS b FROM m2) WHERE t <= 5 OR b <= 5""",
        "net_regulons": ctes("n1") + " SELECT regulator, len(list(target)) AS edges, min(target) AS first_target FROM n1 GROUP BY regulator",
        "sig_scale": ctes("m2") + " SELECT sample, feature, round((value - avg(value) OVER (PARTITION BY feature)) / stddev_samp(value) OVER (PARTITION BY feature), 6) AS value FROM m2",
        "sig_rank": ctes("m2") + f" SELECT sample, feature, {_avg_rank('value', 'feature')} AS value FROM m2",
        "sig_mad": ctes("m2") + " SELECT sample, feature, round((value - median(value) OVER (PARTITION BY feature)) / (1.4826 * mad(value) OVER (PARTITION BY feature)), 6) AS value FROM m2",
        "sig_ttest": ctes("m2") + """, a AS (SELECT *, sum(value) OVER w AS s, sum(value * value) OVER w AS q, count(*) OVER w AS n FROM m2 WINDOW w AS (PARTITION BY feature)),
b AS (SELECT *, (s - value) / (n - 1) AS mean FROM a)
SELECT sample, feature, round((value - mean) / sqrt(greatest((q - value * value - (n - 1) * mean * mean) / (n - 2), 0) / (n - 1)), 6) AS value FROM b""",
        "sig_doublerank": ctes("m2") + f", r AS (SELECT sample, feature, {_avg_rank('value', 'feature')} AS v FROM m2) "
        "SELECT sample, feature, round((v - median(v) OVER (PARTITION BY sample)) / (1.4826 * mad(v) OVER (PARTITION BY sample)), 6) AS value FROM r",
        "rank_average": ctes("m2") + f" SELECT sample, feature, {_avg_rank('value', 'sample')} AS r FROM m2",
        "rank_ordinal": ctes("m2") + " SELECT sample, feature, CAST(row_number() OVER (PARTITION BY sample ORDER BY value, feature) AS INTEGER) AS r FROM m2",
        "area_nes": ctes("n1", "m1") + area_ctes("n1", "m1", "a") + f" SELECT sample, regulator, {_r('nes', 'nes')} FROM a",
        "area_nes_ordinal": ctes("n1", "m1") + area_ctes("n1", "m1", "a", ordinal=True) + f" SELECT sample, regulator, {_r('nes', 'nes')} FROM a",
        "area_eset_filter": ctes("n2", "m1") + area_ctes("n2", "m1", "a", eset=True) + f" SELECT sample, regulator, {_r('nes', 'nes')} FROM a",
        "area_meta_weights": ctes("n2", "n3", "m1") + area_ctes("n2", "m1", "a") + area_ctes("n3", "m1", "b") + f", s AS ({_STACK.format('a', 'b')}) "
        "SELECT sample, regulator, round(coalesce(sum(nes * abs(nes)) / nullif(sum(abs(nes)), 0), 0), 6) AS nes FROM s GROUP BY sample, regulator",
        "area_meta_manual": ctes("n2", "n3", "m1") + area_ctes("n2", "m1", "a") + area_ctes("n3", "m1", "b") + f", s AS ({_STACK.format('a', 'b')}) "
        "SELECT sample, regulator, round(nes, 6) AS nes FROM s WHERE net = CAST(sample AS INTEGER) % 2",
        "area_meta_auto": ctes("n2", "n3", "m1") + area_ctes("n2", "m1", "a") + area_ctes("n3", "m1", "b") + f", s AS ({_STACK.format('a', 'b')})" + """,
k AS (SELECT *, row_number() OVER (PARTITION BY sample, net ORDER BY nes DESC, regulator) AS t, row_number() OVER (PARTITION BY sample, net ORDER BY nes, regulator) AS b FROM s),
n AS (SELECT sample, net, (avg(nes) FILTER (t <= 50) - avg(nes) FILTER (b <= 50)) / 2 AS score FROM k GROUP BY sample, net),
c AS (SELECT sample, arg_min(net, (-score, net)) AS net FROM n GROUP BY sample)
SELECT s.sample AS sample, regulator, round(nes, 6) AS nes FROM s JOIN c ON s.sample = c.sample AND s.net = c.net""",
        "narnea_nes_pes": ctes("n1", "m1") + narnea_ctes("n1", "m1", "a") + f" SELECT sample, regulator, {_r('nes', 'nes')}, {_r('pes', 'pes')} FROM a",
        "narnea_meta": ctes("n2", "n3", "m1") + narnea_ctes("n2", "m1", "a") + narnea_ctes("n3", "m1", "b") + f", s AS ({_STACK.format('a', 'b')})" + """,
v AS (SELECT sample, regulator, arg_min(net, (-abs(pes), net)) AS net FROM s GROUP BY sample, regulator HAVING count(pes) = 2),
w AS (SELECT sample, net, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY sample) AS w FROM v GROUP BY sample, net),
j AS (SELECT s.*, coalesce(w.w, 0) AS w FROM s LEFT JOIN w ON s.sample = w.sample AND s.net = w.net)
SELECT sample, regulator, round(coalesce(sum(w * nes) / nullif(sqrt(sum(w * w) FILTER (nes <> 0)), 0), 0), 6) AS nes,
       round(coalesce(sum(w * pes) / nullif(sum(w) FILTER (pes <> 0), 0), 0), 6) AS pes FROM j GROUP BY sample, regulator""",
        "viper_rank_area": ctes("n2", "m1") + f", r AS (SELECT sample, feature, {_avg_rank('value', 'feature')} AS value FROM m1)" + area_ctes("n2", "r", "a", eset=True)
        + f" SELECT sample, regulator, {_r('nes', 'nes')} FROM a",
        "viper_two_networks": ctes("n2", "n3", "m1") + area_ctes("n2", "m1", "a", eset=True) + area_ctes("n3", "m1", "b", eset=True) + f", s AS ({_STACK.format('a', 'b')}) "
        "SELECT sample, regulator, round(coalesce(sum(nes * abs(nes)) / nullif(sum(abs(nes)), 0), 0), 6) AS nes FROM s GROUP BY sample, regulator",
        "viper_narnea": ctes("n3", "m1") + ", e AS (SELECT * FROM m1 WHERE feature IN (SELECT target FROM n3 UNION SELECT regulator FROM n3))" + narnea_ctes("n3", "e", "a")
        + f" SELECT sample, regulator, {_r('nes', 'nes')}, {_r('pes', 'pes')} FROM a WHERE round(nes, 6) > 0",
        "area_weighted": ctes("cw", "n1", "m1s") + f""", e AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY regulator) AS n1 FROM n1 WHERE target IN (SELECT feature FROM m1s)) WHERE n1 >= 20),
t AS (SELECT sample, feature, {_avg_rank('value', 'sample')} / (count(*) OVER (PARTITION BY sample) + 1.0::DOUBLE) AS t2 FROM m1s),
u AS (SELECT *, 2 * abs(t2 - 0.5) AS a FROM t), v AS (SELECT sample, feature, t2, a + (1 - max(a) OVER (PARTITION BY sample)) / 2 AS t1 FROM u),
z AS (SELECT v.sample AS sample, v.feature AS feature, {mathx.ppf('t2')} AS z2, {mathx.ppf('t1')} AS z1, coalesce(weight, 0) AS w FROM v LEFT JOIN cw ON cw.sample = v.sample AND cw.feature = v.feature),
s AS (SELECT sample, regulator, sum(likelihood * w * mor * z2) AS d, sum(likelihood * w * (1 - abs(mor)) * z1) AS u, sum(likelihood * w) AS total,
  sqrt(sum(likelihood * w * likelihood * w)) / nullif(max(likelihood * w), 0) AS size FROM z JOIN e ON feature = target GROUP BY sample, regulator)
SELECT sample, regulator, round((abs(d) + greatest(u, 0)) * CASE WHEN d < 0 THEN -1 ELSE 1 END / nullif(total, 0) * size, 6) AS nes FROM s""",
        "pleiotropy": pleiotropy_sql(),
        "path_enrich": ctes("m2") + ", " + _STOUFFER + """, k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, feature) AS t, row_number() OVER (PARTITION BY cluster ORDER BY score, feature) AS b FROM s),
net AS (SELECT 'set' || cluster AS regulator, feature AS target, CASE WHEN t <= 20 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS mor, 1.0::DOUBLE AS likelihood FROM k WHERE t <= 20 OR b <= 20),
e AS (SELECT sample, feature, value * 10 AS value FROM m2)""" + area_ctes("net", "e", "a", eset=True, least=0) + f" SELECT sample, regulator, {_r('nes', 'nes')} FROM a",
        "oncomatch": ctes("m2") + """, e AS (SELECT sample, feature, value * 10 AS value FROM m2 WHERE CAST(sample AS BIGINT) % 2 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value * 10 DESC, feature) AS t, row_number() OVER (PARTITION BY sample ORDER BY value * 10, feature) AS b FROM m2 WHERE CAST(sample AS BIGINT) % 2 = 1),
net AS (SELECT sample AS regulator, feature AS target, CASE WHEN t <= 10 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS mor, 1.0::DOUBLE AS likelihood FROM k WHERE t <= 10 OR b <= 10)"""
        + area_ctes("net", "e", "a", least=0) + f""", q AS (SELECT sample, regulator AS reference, least(coalesce(nes, 0), 30.0) AS z FROM a),
p AS (SELECT sample, reference, least({mathx.sf('z')}, 1.0) AS p FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY p) AS r, count(*) OVER (PARTITION BY sample) AS m FROM p),
f AS (SELECT sample, reference, least(1.0, min(p * m / r) OVER (PARTITION BY sample ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM r)
SELECT sample, reference, round(greatest(0, -log10(fdr + 1e-300)), 6) AS score FROM f""",
        "similarity_nn": similarity_sql("two.sided", nn=20),
        "sample_order": ctes("m2") + _CENTRED + """, s AS (SELECT i, ci, cj, sum(dist) AS s, count(*) AS n FROM pairs GROUP BY i, ci, cj),
ab AS (SELECT i, ci, max(s / nullif(n - 1, 0)) FILTER (ci = cj) AS a, min(s / n) FILTER (ci <> cj) AS b FROM s GROUP BY i, ci),
w AS (SELECT i AS sample, ci AS cluster, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 9) AS w FROM ab)
SELECT sample, cluster, row_number() OVER (ORDER BY cluster, w DESC, sample) AS position FROM w""",
        "mr_rows": ctes("m2") + ", " + _STOUFFER + """, t AS (SELECT cluster, feature FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, feature) AS t FROM s) WHERE t <= 10),
u AS (SELECT m2.cluster AS cluster, m2.feature AS feature, sum(value) AS total FROM m2 JOIN t ON t.cluster = m2.cluster AND t.feature = m2.feature GROUP BY m2.cluster, m2.feature)
SELECT cluster, feature, round(total, 6) AS total, CAST(row_number() OVER (PARTITION BY cluster ORDER BY total DESC, feature) AS INTEGER) AS position FROM u""",
        "metacell_shares": ctes("m2") + _CENTRED + """, k AS (SELECT * FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY i <> j, round(dist, 9), j) AS r FROM pairs) WHERE r <= 5),
u AS (SELECT j, count(*) AS times FROM k GROUP BY j)
SELECT count(*) AS samples_used, round(100 * avg(CASE WHEN times > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS perc_reused, round(avg(times), 6) AS mean_use, round(stddev_pop(times), 6) AS std_use FROM u""",
        "stouffer": ctes("m2") + _SUMS + f", f AS (SELECT cluster, feature, s / sqrt(n) AS score, sqrt(n) * st / nt AS mu, sqrt(greatest(qt / nt - (st / nt) * (st / nt), 0) * (nt - n) / nullif(nt - 1, 0)) AS sd FROM t) "
        f"SELECT cluster, feature, {_r('score', 'score')}, {_r(_null('score', 'mu', 'sd'), 'pval')} FROM f",
        "mean_diffs": ctes("m2") + _SUMS + ", f AS (SELECT cluster, feature, s / n - (st - s) / (nt - n) AS score, sqrt(greatest(qt / nt - (st / nt) * (st / nt), 0) * nt * nt / (n * (nt - n) * (nt - 1))) AS sd FROM t) "
        f"SELECT cluster, feature, {_r('score', 'score')}, {_r(_null('score', '0', 'sd'), 'pval')} FROM f",
        "median_diffs": ctes("m2") + ", k AS (SELECT DISTINCT cluster AS own FROM m2) SELECT own AS cluster, feature, round(median(value) FILTER (cluster = own) - median(value) FILTER (cluster <> own), 6) AS score FROM m2, k GROUP BY own, feature",
        "mwu": ctes("m2") + f""", r AS (SELECT cluster, feature, {_avg_rank('value', 'feature')} AS r, CAST(count(*) OVER (PARTITION BY feature, value) AS DOUBLE) AS ties FROM m2),
g AS (SELECT cluster, feature, sum(r) AS r1, CAST(count(*) AS DOUBLE) AS n1, sum(ties * ties - 1) AS t FROM r GROUP BY cluster, feature),
h AS (SELECT *, sum(n1) OVER (PARTITION BY feature) AS n, sum(t) OVER (PARTITION BY feature) AS tt FROM g),
u AS (SELECT cluster, feature, r1 - n1 * (n1 + 1) / 2 AS score, n1 * (n - n1) AS nn, sqrt(n1 * (n - n1) / 12 * (n + 1 - tt / (n * (n - 1)))) AS sd FROM h),
z AS (SELECT *, (greatest(score, nn - score) - nn / 2 - 0.5) / nullif(sd, 0) AS z FROM u)
SELECT cluster, feature, score, {_r(f"least(1.0, 2 * ({mathx.sf('z')}))", 'pval')} FROM z""",
        "spearman": ctes("m2") + f""", e AS (SELECT cluster AS k, feature, avg(value) AS centre FROM m2 GROUP BY cluster, feature),
c AS (SELECT sample, k, 1 - sqrt(greatest(1 - corr(value, centre), 0)) AS closeness FROM m2 JOIN e ON m2.feature = e.feature GROUP BY sample, k),
r AS (SELECT sample, feature, {_avg_rank('value', 'feature')} AS r FROM m2),
s AS (SELECT k AS cluster, feature, corr(r, closeness) AS score, CAST(count(*) AS DOUBLE) AS n FROM r JOIN c ON r.sample = c.sample GROUP BY k, feature)
SELECT cluster, feature, {_r('score', 'score')}, {_r(_null('score', '0', 'n / pow(n - 1, 1.5)'), 'pval')} FROM s""",
        "top_mrs": ctes("m2") + """, s AS (SELECT cluster, feature, round(sum(value) / sqrt(count(*)), 6) AS score FROM m2 GROUP BY cluster, feature),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, feature) AS t, row_number() OVER (PARTITION BY cluster ORDER BY score, feature) AS b FROM s)
SELECT cluster, feature, score, CAST(CASE WHEN t <= 10 THEN 11 - t ELSE -(11 - b) END AS INTEGER) AS mark FROM k WHERE t <= 10 OR b <= 10""",
        "nes_to_pval": scaled + f" SELECT sample, feature, {_r(two, 'pval')} FROM s",
        "nes_to_pval_fdr": scaled + f""", p AS (SELECT sample, feature, {two} AS p FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY p) AS r, count(*) OVER (PARTITION BY sample) AS m FROM p)
SELECT sample, feature, round(least(1.0, min(p * m / r) OVER (PARTITION BY sample ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS pval FROM k""",
        "nes_to_neg_log10": scaled + f" SELECT sample, feature, round(-log10(least({mathx.sf('z')}, 1.0) + 1e-300), 6) AS pval FROM s",
        "corr_distance": ctes("m2") + _CENTRED + " SELECT i AS sample_i, j AS sample_j, round(dist, 5) AS dist FROM pairs",
        "knn": ctes("m2") + _CENTRED + " SELECT * FROM (SELECT i AS sample, CAST(row_number() OVER (PARTITION BY i ORDER BY i <> j, round(dist, 9), j) AS INTEGER) AS rank, j AS neighbor FROM pairs) WHERE rank <= 10",
        "silhouette": ctes("m2") + _CENTRED + """, s AS (SELECT i, ci, cj, sum(dist) AS s, count(*) AS n FROM pairs GROUP BY i, ci, cj),
ab AS (SELECT i, ci, max(s / nullif(n - 1, 0)) FILTER (ci = cj) AS a, min(s / n) FILTER (ci <> cj) AS b FROM s GROUP BY i, ci)
SELECT i AS sample, ci AS cluster, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 6) AS silhouette FROM ab""",
        "similarity_two_sided": similarity_sql("two.sided"),
        "similarity_greater": similarity_sql("greater"),
        "similarity_less": similarity_sql("less"),
        "metacell_counts": ctes("m2") + _CENTRED + """, k AS (SELECT * FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY i <> j, round(dist, 9), j) AS r FROM pairs) WHERE r <= 5)
SELECT i AS metacell, feature, round(sum(value), 6) AS count FROM k JOIN m2 ON sample = j GROUP BY i, feature""",
        "vis_net_nodes": ctes("n1", "m1") + """, v AS (SELECT DISTINCT target AS id, FALSE AS is_regulator FROM n1 WHERE target NOT IN (SELECT regulator FROM n1) UNION SELECT regulator, TRUE FROM n1),
s AS (SELECT target, avg(mor) AS mor FROM n1 GROUP BY target), e AS (SELECT feature, avg(value) AS value FROM m1 GROUP BY feature)
SELECT id, is_regulator, round(mor, 13) AS mor, round(CASE WHEN is_regulator THEN NULL ELSE value END, 4) AS value FROM v LEFT JOIN s ON id = s.target LEFT JOIN e ON id = e.feature""",
        "group_summary": ctes("m2") + " SELECT cluster, feature AS variable, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS fraction, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM m2 GROUP BY cluster, feature",
        "normalized_expression": ctes("m1") + " SELECT sample, feature, round(ln(1 + floor(value) * 10000 / sum(floor(value)) OVER (PARTITION BY sample)), 6) AS value FROM m1",
    }
    return out
