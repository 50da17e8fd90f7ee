"""DuckDB SQL for the plan queries that SQL can express."""

from __future__ import annotations

V = """
v AS (SELECT *, s_nationkey::VARCHAR AS subject, year(l_shipdate)::BIGINT AS time_point, l_linenumber::DOUBLE AS label,
             CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 WHEN 'R' THEN 3.0 END::DOUBLE AS flag,
             CASE WHEN abs(l_discount) >= 1e-6 THEN l_tax / l_discount END AS value
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def _signal(expr: str, when: str) -> str:
    return f"SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, CASE WHEN {when} THEN {expr} END AS signal FROM lineitem"


def _region(agg: str, label: str = "label") -> str:
    return f"SELECT subject, time_point, {label} AS labels, round({agg}, 6) + 0.0 AS values FROM v GROUP BY ALL"


# the tensor: medians by nation, year and flag; subjects without all years and flags with a hole are dropped
COO = f"""{V},
c AS (SELECT subject, time_point, flag, median(value) AS x FROM v GROUP BY ALL HAVING median(value) IS NOT NULL),
s0 AS (SELECT subject FROM c GROUP BY subject HAVING count(DISTINCT time_point) = (SELECT count(DISTINCT time_point) FROM c)),
c1 AS (SELECT * FROM c WHERE subject IN (SELECT subject FROM s0)),
l0 AS (SELECT flag FROM c1 GROUP BY flag HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT subject, time_point FROM c1))),
c2 AS (SELECT * FROM c1 WHERE flag IN (SELECT flag FROM l0)),
t AS (SELECT dense_rank() OVER (ORDER BY subject) - 1 AS m0, dense_rank() OVER (ORDER BY time_point) - 1 AS m1, dense_rank() OVER (ORDER BY flag) - 1 AS m2,
             subject, time_point, flag, x FROM c2)"""


def fac(idx: str, r: str) -> str:
    return f"(1 + (7 * {idx} + 3 * {r}) % 5)::DOUBLE"


R2 = "(SELECT unnest([0, 1])::BIGINT AS r)"
MT = f"""{COO}, rr AS {R2},
mt AS (SELECT m0 AS idx, r, sum(x * {fac("m1", "r")} * {fac("m2", "r")}) AS value FROM t, rr GROUP BY ALL)"""


def _gram(mode: int) -> str:
    return f"SELECT a.r, b.r AS s, sum({fac('i', 'a.r')} * {fac('i', 'b.r')}) AS g FROM (SELECT DISTINCT m{mode} AS i FROM t), rr a, rr b GROUP BY ALL"


MU = f"""WITH {MT},
g1 AS ({_gram(1)}), g2 AS ({_gram(2)}), g AS (SELECT g1.r, g1.s, g1.g * g2.g AS g FROM g1 JOIN g2 USING (r, s)),
den AS (SELECT mt.idx, g.s AS r, sum({fac("mt.idx", "g.r")} * g.g) AS den FROM mt JOIN g ON mt.r = g.r GROUP BY ALL)
SELECT mt.idx, mt.r, round({fac("mt.idx", "mt.r")} * greatest(value, 2.220446049250313e-16) / greatest(den, 2.220446049250313e-16), 6) + 0.0 AS value
FROM mt JOIN den ON mt.idx = den.idx AND mt.r = den.r"""

EMB = """
e AS (SELECT vec_id, label, (unnest(range(1, 65)) - 1) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings),
a AS (SELECT dim, label AS r, avg(value) AS v, max(value) AS w FROM e GROUP BY ALL)"""


def _cos(x: str, y: str) -> str:
    return f"SELECT p.r::BIGINT AS r, q.r::BIGINT AS s, round(sum(p.{x} * q.{y}) / sqrt(sum(p.{x} * p.{x}) * sum(q.{y} * q.{y})), 6) + 0.0 AS cosine FROM a p JOIN a q USING (dim) GROUP BY ALL"


H = "(sample_idx * 2654435761 + {r} * 40503) % 1000003"
SAMPLES = "s AS (SELECT c_custkey::BIGINT AS sample_idx, c_mktsegment AS stratum FROM customer), n AS (SELECT stratum, count(*) AS n_c, min(sample_idx) AS first FROM s GROUP BY stratum)"
HALF = f"""{SAMPLES}, tot AS (SELECT sum(n_c)::BIGINT AS n, floor(sum(n_c) / 2)::BIGINT AS tr FROM n),
q AS (SELECT stratum, n_c, first, (n_c * tr) // n AS low, (n_c * tr) % n AS frac, tr FROM n, tot),
k AS (SELECT stratum, low + CASE WHEN row_number() OVER (ORDER BY frac DESC, first) <= tr - sum(low) OVER () THEN 1 ELSE 0 END AS n_train FROM q),
o AS (SELECT task_a, stratum, sample_idx, row_number() OVER (PARTITION BY task_a, stratum ORDER BY {H.format(r="task_a")}, sample_idx) AS i FROM s, (SELECT unnest([0, 1, 2])::BIGINT AS task_a)),
h AS (SELECT task_a, CASE WHEN i > n_train THEN 1 ELSE 0 END::BIGINT AS task_b, stratum, sample_idx FROM o JOIN k USING (stratum))"""
FOLD = f"""{SAMPLES}, p AS (SELECT stratum, coalesce(sum(n_c) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
f AS (SELECT repeat, stratum, ((before + row_number() OVER (PARTITION BY repeat, stratum ORDER BY {H.format(r="repeat")}, sample_idx) - 1) % 5)::BIGINT AS fold, sample_idx
      FROM s JOIN p USING (stratum), (SELECT unnest([0, 1])::BIGINT AS repeat))"""

MODE = """
b AS (SELECT c_nationkey AS subjects, avg(c_acctbal) AS a, max(c_acctbal) AS b, count(*)::DOUBLE AS c FROM customer GROUP BY ALL),
m AS (SELECT subjects::BIGINT AS subjects, n_name, r_name, a / sqrt(sum(a * a) OVER ()) AS comp_0, b / sqrt(sum(b * b) OVER ()) AS comp_1, c / sqrt(sum(c * c) OVER ()) AS comp_2
      FROM b JOIN nation ON subjects = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _box(rows: str, by: str, x: str, places: int) -> str:
    r = lambda c: f"round({c}, {places}) + 0.0"
    return f"""q AS (SELECT {by}, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3 FROM {rows} GROUP BY ALL),
z AS (SELECT {rows}.*, q1, median, q3, {x} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM {rows} JOIN q USING ({by}))
SELECT {by}, count(*) AS n, {r("any_value(q1)")} AS q1, {r("any_value(median)")} AS median, {r("any_value(q3)")} AS q3,
       {r(f"min({x}) FILTER (inside)")} AS low, {r(f"max({x}) FILTER (inside)")} AS high, count(*) FILTER (NOT inside) AS n_fliers FROM z GROUP BY {by}"""


INDEX = """
vi AS (SELECT p_partkey::BIGINT AS l, p_partkey % 11 AS i, (p_partkey // 11) % 13 AS j, p_partkey // 143 AS k, p_size > 25 AS is_csf FROM part),
sm AS (SELECT p_partkey::BIGINT AS l, 0::BIGINT AS r, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 1, p_size::DOUBLE FROM part),
sc AS (SELECT l, r, value / nullif(sqrt(sum(value * value) OVER (PARTITION BY r)), 0) AS value FROM sm)"""

EVENTS = """
c AS (SELECT user_id AS subject, ts::DATE AS time_point, event_type AS labels, arg_min(value, event_id) AS value FROM events
      WHERE value IS NOT NULL AND NOT isnan(value) AND user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL)"""

PLANTED = """
b AS (SELECT dense_rank() OVER (ORDER BY p_brand) - 1 AS m0, sqrt(avg(p_retailprice)) AS v0 FROM part GROUP BY p_brand),
z AS (SELECT dense_rank() OVER (ORDER BY p_size) - 1 AS m1, count(*) / 10.0::DOUBLE AS v1 FROM part GROUP BY p_size),
y AS (SELECT dense_rank() OVER (ORDER BY p_type) - 1 AS m2, count(*) / 100.0::DOUBLE AS v2 FROM part GROUP BY p_type)"""

# erfc by the series of erf with positive terms: 2 / sqrt(pi) * exp(-z^2) * sum of 2^k z^(2k+1) / (1 * 3 * .. (2k+1))
ERFC = """(CASE WHEN {z} > 6 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 300),
    lambda k: exp(-{z} * {z} + k * ln(2::DOUBLE) + (2 * k + 1) * ln(greatest({z}, 1e-300)) - (lgamma(2 * k + 2::DOUBLE) - k * ln(2::DOUBLE) - lgamma(k + 1::DOUBLE))))) END)"""
STAR = "CASE WHEN p <= 1e-4 THEN '****' WHEN p <= 1e-3 THEN '***' WHEN p <= 1e-2 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END"


def _ranks(rows: str, g: str, x: str, first: str) -> str:
    """w: ga, gb, na, nb, u, z of the normal approximation with continuity and ties, for pairs in order of `first`."""
    return f"""f AS (SELECT {g} AS g, min({first}) AS first, count(*) AS n FROM {rows} GROUP BY ALL),
        pr AS (SELECT a.g AS ga, b.g AS gb, a.n::DOUBLE AS na, b.n::DOUBLE AS nb FROM f a JOIN f b ON a.first < b.first),
        kr AS (SELECT ga, gb, na, nb, {g} AS g, rank() OVER (PARTITION BY ga, gb ORDER BY {x}) + (count(*) OVER (PARTITION BY ga, gb, {x}) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY ga, gb, {x})::DOUBLE AS t
              FROM {rows} JOIN pr ON {g} IN (ga, gb)),
        ur AS (SELECT ga, gb, na, nb, sum(r) FILTER (g = ga) - na * (na + 1) / 2 AS u, sum(t * t - 1) AS ties FROM kr GROUP BY ga, gb, na, nb),
        w AS (SELECT *, greatest(0, (abs(u - na * nb / 2) - 0.5::DOUBLE) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) / sqrt(2::DOUBLE)) AS z FROM ur),
        wp AS (SELECT *, least(1, {ERFC.format(z="z")}) AS p FROM w)"""


def _correlation_p(r: str, n: str) -> str:
    """1 - I(r^2; 1/2, (n - 2) / 2), by the series of the incomplete beta function with positive terms."""
    return f"""(CASE WHEN {n} < 3 OR {r} IS NULL THEN NULL WHEN abs({r}) >= 1 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 1500),
    lambda k: exp((k + 0.5::DOUBLE) * ln(greatest({r} * {r}, 1e-300)) + ({n} - 2) / 2.0::DOUBLE * ln(1 - {r} * {r}) + lgamma(({n} - 1) / 2.0::DOUBLE + k) - lgamma(k + 1.5::DOUBLE) - lgamma(({n} - 2) / 2.0::DOUBLE)))) END)"""


STARTS = 50
T0 = COO.replace("t AS (", "t AS MATERIALIZED (")


def _starts(n: int, cells: str = "t", task: str = "0") -> list[str]:
    """CTEs z0, z1, z2 (seed, idx, r, v): n starts of each task, drawn by MT19937 mode after mode; 2 x 227 words, so up to 227 numbers a start."""
    ctes = [
        f"w0 AS (SELECT start, 0::BIGINT AS i, start AS x FROM (SELECT unnest(range(0, {n})) AS start) UNION ALL SELECT start, i + 1, (1812433253::BIGINT * xor(x, x >> 30) + i + 1) & 4294967295 FROM w0 WHERE i < 623)",
    ]
    twist = "xor(c.x, xor(y >> 1, (y & 1) * 2567483615))"
    for k in range(2):
        near = f"(SELECT a.start, a.i, (a.x & 2147483648) | (b.x & 2147483647) AS y FROM w{k} a JOIN w{k} b ON b.start = a.start AND b.i = a.i + 1 WHERE a.i >= {227 * k} AND a.i < {227 * (k + 1)})"
        ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT * FROM w{k} UNION ALL SELECT start, n.i + 624, {twist} FROM {near} n JOIN w{k} c USING (start) WHERE c.i = n.i + 397)")
    steps = ["xor(x, x >> 11)", "xor(x, (x << 7) & 2636928640)", "xor(x, (x << 15) & 4022730752)", "xor(x, x >> 18)"]
    source = "(SELECT start, i - 624 AS i, x FROM w2 WHERE i >= 624)"
    for step in steps:
        source = f"(SELECT start, i, {step} AS x FROM {source})"
    ctes.append(f"uu AS MATERIALIZED (SELECT start, i // 2 AS k, (sum((x >> 5) * 67108864) FILTER (i % 2 = 0) + sum(x >> 6) FILTER (i % 2 = 1))::DOUBLE / 9007199254740992 AS v FROM {source} GROUP BY ALL)")
    ctes.append(f"nn AS (SELECT {task}::BIGINT AS task, count(DISTINCT m0) AS n0, (SELECT count(DISTINCT m1) FROM {cells}) AS n1 FROM {cells} GROUP BY ALL)")
    for mode, before in enumerate(("0", "n0", "n0 + n1")):
        ctes.append(f"""z{mode} AS MATERIALIZED (SELECT task * {n} + start AS seed, idx, r, v FROM (SELECT DISTINCT {task}::BIGINT AS task, m{mode}::BIGINT AS idx FROM {cells})
            JOIN nn USING (task), {R2}, uu WHERE k = ({before} + idx) * 2 + r)""")
    return ctes


def _update(mode: int, name: str, held: list[str], cells: str = "t", of: str = "") -> str:
    """CTEs of one multiplicative update of all starts; held names the factors (seed, idx, r, v) before it, of the cells of a start."""
    a, b = (k for k in range(3) if k != mode)
    eps = "2.220446049250313e-16::DOUBLE"
    g = lambda k: f"(SELECT seed, p.r, q.r AS s, sum(p.v * q.v) AS g FROM {held[k]} p JOIN {held[k]} q USING (seed, idx) GROUP BY ALL)"
    return f"""
m{name} AS MATERIALIZED (SELECT p.seed, t.m{mode} AS idx, p.r, sum(t.x * p.v * q.v) AS m FROM {cells} t JOIN {held[a]} p ON p.idx = t.m{a}{of} JOIN {held[b]} q ON q.idx = t.m{b} AND q.r = p.r AND q.seed = p.seed GROUP BY ALL),
g{name} AS MATERIALIZED (SELECT seed, x.r, x.s, x.g * y.g AS g FROM {g(a)} x JOIN {g(b)} y USING (seed, r, s)),
d{name} AS MATERIALIZED (SELECT h.seed, h.idx, g.s AS r, sum(h.v * g.g) AS d FROM {held[mode]} h JOIN g{name} g ON g.r = h.r AND g.seed = h.seed GROUP BY ALL),
{name} AS MATERIALIZED (SELECT seed, idx, r, h.v * greatest(coalesce(m, 0), {eps}) / greatest(d, {eps}) AS v FROM {held[mode]} h JOIN d{name} USING (seed, idx, r) LEFT JOIN m{name} USING (seed, idx, r))"""


def _error(held: list[str], cells: str = "t", of: str = "") -> str:
    """seed, error: the relative error of the models of held."""
    a, b, c = held
    both = f"""SELECT p.seed, any_value(t.x) AS x, sum(p.v * q.v * w.v) AS y FROM {cells} t JOIN {a} p ON p.idx = t.m0{of} JOIN {b} q ON q.idx = t.m1 AND q.r = p.r AND q.seed = p.seed
        JOIN {c} w ON w.idx = t.m2 AND w.r = p.r AND w.seed = p.seed GROUP BY p.seed, t.m0, t.m1, t.m2"""
    return f"SELECT seed, sqrt(sum((x - y) * (x - y))) / sqrt(sum(x * x)) AS error FROM ({both}) GROUP BY seed"


def _settled(starts: int, tol: float, cells: str = "t", task: str = "0", of: str = "") -> str:
    """CTE st: the factors of every start after each iteration until its error settles (NOT going), by recursion."""
    step, held = [f"h{m} AS MATERIALIZED (SELECT seed, idx, r, v FROM st WHERE mode = {m} AND going)" for m in range(3)], ["h0", "h1", "h2"]
    for mode in range(3):
        step.append(_update(mode, f"f{mode}", held, cells, of))
        held[mode] = f"f{mode}"
    step.append("old AS MATERIALIZED (SELECT seed, any_value(it) + 1 AS it, any_value(error) AS was FROM st WHERE going GROUP BY seed)")
    step.append(f"now AS MATERIALIZED (SELECT seed, it, error, it < 2 OR abs(was - error) >= {tol}::DOUBLE AS going FROM ({_error(held, cells, of)}) JOIN old USING (seed))")
    base = " UNION ALL ".join(f"SELECT seed, 0::BIGINT AS it, {m} AS mode, idx, r, v, NULL::DOUBLE AS error, true AS going FROM z{m}" for m in range(3))
    rows = " UNION ALL ".join(f"SELECT seed, it, {m} AS mode, idx, r, v, error, going FROM {name} JOIN now USING (seed)" for m, name in enumerate(held))
    return f"{', '.join(_starts(starts, cells, task))}, st AS (SELECT * FROM ({base}) UNION ALL (WITH {', '.join(step)} SELECT * FROM ({rows})))"


def _table_fit(tol: float) -> str:
    """The factors of seed 0 once its error has settled."""
    return f"""WITH RECURSIVE {T0}, {_settled(1, tol)}
        SELECT mode::BIGINT AS mode, idx, r, round(v, 6) + 0.0 AS value, round(error, 6) + 0.0 AS error FROM st WHERE NOT going"""


def _best_of(starts: int, tol: float) -> str:
    """The factors of the start with the least error."""
    return f"""WITH RECURSIVE {T0}, {_settled(starts, tol)},
        best AS (SELECT seed FROM st WHERE NOT going GROUP BY seed ORDER BY any_value(error), seed LIMIT 1)
        SELECT seed, it AS n_iter, round(error, 6) + 0.0 AS error, mode::BIGINT AS mode, idx, r, round(v, 5) + 0.0 AS value FROM st JOIN best USING (seed) WHERE NOT going"""


# order of the samples s of the tensor in each round a
ORDERED = "so AS (SELECT a, s, row_number() OVER (PARTITION BY a ORDER BY (s * 2654435761 + a * 40503) % 1000003, s) - 1 AS k FROM (SELECT DISTINCT m0 AS s FROM t), (SELECT unnest(range(0, {rounds})) AS a))"
HALVES = ORDERED.format(rounds=10) + ", tk AS (SELECT 2 * a + (k >= (SELECT count(DISTINCT m0) FROM t) // 2)::BIGINT AS task, s FROM so)"
TRAIN = ORDERED.format(rounds=2) + ", tk AS (SELECT 5 * a + f AS task, s FROM so, (SELECT unnest(range(0, 5)) AS f) WHERE k % 5 <> f)"


def _matched(starts: int, tol: float, tasks: str, pairs: str, modes: str) -> str:
    """CTE fm (i, j, score): every task of the samples decomposed, and the better of both ways to match the components of each pair's best models."""
    return f"""WITH RECURSIVE {T0}, {tasks}, ps AS (SELECT task, s, row_number() OVER (PARTITION BY task ORDER BY s) - 1 AS pos FROM tk),
        tt AS MATERIALIZED (SELECT task, pos AS m0, m1, m2, x FROM t JOIN ps ON s = m0), {_settled(starts, tol, "tt", "task", f" AND p.seed // {starts} = t.task")},
        ended AS (SELECT seed, any_value(error) AS error FROM st WHERE NOT going GROUP BY seed),
        best AS (SELECT seed // {starts} AS task, seed FROM ended QUALIFY row_number() OVER (PARTITION BY seed // {starts} ORDER BY error, seed) = 1),
        mo AS MATERIALIZED (SELECT b.task, mode, CASE WHEN mode = 0 THEN s ELSE idx END AS idx, r, v FROM st JOIN best b USING (seed) LEFT JOIN ps ON mode = 0 AND ps.task = b.task AND pos = idx WHERE NOT going),
        pr AS ({pairs}),
        co AS (SELECT i, j, x.mode, x.r, y.r AS q, coalesce(sum(x.v * y.v) / nullif(sqrt(sum(x.v * x.v) * sum(y.v * y.v)), 0), 0) AS c
            FROM pr JOIN mo x ON x.task = i JOIN mo y ON y.task = j AND y.mode = x.mode AND y.idx = x.idx WHERE x.mode IN ({modes}) GROUP BY ALL),
        pc AS (SELECT i, j, r, q, product(abs(c)) AS c FROM co GROUP BY ALL),
        fm AS (SELECT i, j, round(greatest(sum(c) FILTER (r = q), sum(c) FILTER (r <> q)) / 2, 6) + 0.0 AS score FROM pc GROUP BY ALL)"""


# long components of the nations' mode, and variables
LONG = f"""{MODE},
lc AS (SELECT subjects, r_name, length(n_name)::DOUBLE AS letters, subjects::DOUBLE AS key, unnest([0, 1, 2])::BIGINT AS component, unnest([comp_0, comp_1, comp_2]) AS value FROM m)"""
XY = "xy AS (SELECT component, r_name, value AS y, unnest(['letters', 'key']) AS variable, unnest([letters, key]) AS x FROM lc)"
LIMITS = "li AS (SELECT component, 0::DOUBLE AS y_low, max(value) + 0.05::DOUBLE * (max(value) - min(value)) AS y_high, (SELECT count(DISTINCT r_name) FROM m) AS g FROM lc GROUP BY ALL)"


def _violins(rows: str, keys: str, row: str, places: tuple[int, int, int]) -> str:
    """Kernel sums over bins of a 64th of Scott's bandwidth at 100 points; rows: keys and x."""
    shared = f"PARTITION BY {row}" if row else ""
    y, density, width = (f"round({c}, {n}) + 0.0 AS {name}" for c, n, name in zip(("y", "density", "density / peak * n / max(n) OVER q"), places, ("y", "density", "width")))
    return f"""vx AS (SELECT * FROM ({rows}) WHERE x IS NOT NULL),
        vh AS (SELECT {keys}, count(*) AS n, min(x) AS lo, max(x) AS hi, CASE WHEN stddev_samp(x) > 0 THEN pow(count(*)::DOUBLE, (-0.2)::DOUBLE) * stddev_samp(x) END AS h FROM vx GROUP BY ALL),
        vb AS (SELECT {keys}, lo + floor((x - lo) / (h / 64) + 0.5::DOUBLE) * h / 64 AS mid, count(*) AS c FROM vx JOIN vh USING ({keys}) WHERE h IS NOT NULL GROUP BY ALL),
        vg AS (SELECT {keys}, n, h, step, lo - 2 * h + step * ((hi - lo + 4 * h) / 99) AS y FROM vh, (SELECT unnest(range(0, 100)) AS step) WHERE h IS NOT NULL),
        vd AS (SELECT {keys}, n, step, y, sum(c * exp(-((y - mid) / h) * ((y - mid) / h) / 2)) / (n * h * sqrt(2 * pi())) AS density FROM vg JOIN vb USING ({keys}) GROUP BY {keys}, n, h, step, y
              UNION ALL SELECT {keys}, n, 0 AS step, lo AS y, 1.0::DOUBLE AS density FROM vh WHERE h IS NULL),
        vk AS (SELECT *, max(density) OVER (PARTITION BY {keys}) AS peak FROM vd)
        SELECT {keys}, n, step, {y}, {density}, {width} FROM vk WINDOW q AS ({shared})"""


def _lines(fits: str, span: str) -> str:
    x = "lo + step * (hi - lo) / 49.0::DOUBLE"
    return f"SELECT * EXCLUDE (lo, hi, a, b), round({x}, 6) + 0.0 AS x, round(a * ({x}) + b, 6) + 0.0 AS y_hat FROM {fits} JOIN {span}, (SELECT unnest(range(0, 50)) AS step)"


SQL = {
    "tracer_t1map": _signal("1.0::DOUBLE / l_tax - 1.0::DOUBLE / l_discount", "abs(l_tax) >= 1e-6 AND abs(l_discount) >= 1e-6"),
    "tracer_t1w": _signal("l_tax / l_discount", "abs(l_discount) >= 1e-6"),
    "mask_and_label_filter": "SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey::BIGINT AS l_partkey, l_quantity FROM lineitem WHERE l_quantity > 25 AND l_linenumber > 1",
    "grid_alignment": """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a, vec_id % 4 AS f FROM embeddings)
        SELECT vec_id::BIGINT AS vec_id, bool_and(abs(a - a * (1 + f * 5e-6::DOUBLE)) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(a * (1 + f * 5e-6::DOUBLE))) AS on_grid FROM e GROUP BY vec_id""",
    "region_median": f"WITH {V} {_region('median(value)')}",
    "region_udf": f"WITH {V} {_region('median(value)')}",
    "region_reduce_mean": f"WITH {V} {_region('avg(value)')}",
    "region_reduce_min": f"WITH {V} {_region('min(value)')}",
    "region_reduce_max": f"WITH {V} {_region('max(value)')}",
    "region_reduce_std": f"WITH {V} {_region('stddev_pop(value)')}",
    "region_reduce_pct": f"WITH {V} {_region('quantile_cont(value, 0.95)')}",
    "group_filter": f"""WITH {V} SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey::BIGINT AS l_partkey, subject, value
        FROM v JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'""",
    "pivot_first": f"""WITH {V} SELECT subject, time_point, label, value FROM v WHERE value IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY subject, time_point, label ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1""",
    "valid_subjects": f"WITH {EVENTS} SELECT DISTINCT subject::BIGINT AS subject FROM c",
    "label_completeness": f"WITH {EVENTS} SELECT labels, count(DISTINCT time_point) AS n_rows FROM c GROUP BY labels HAVING count(DISTINCT time_point) = (SELECT count(DISTINCT time_point) FROM c)",
    "tensor_coo": f"WITH {COO} SELECT m0, m1, m2, round(x, 6) + 0.0 AS x FROM t",
    "axis_index": f"""WITH {COO} SELECT DISTINCT 0::BIGINT AS axis, subject AS key, m0 AS idx FROM t UNION ALL SELECT DISTINCT 1, time_point::VARCHAR, m1 FROM t
        UNION ALL SELECT DISTINCT 2, flag::BIGINT::VARCHAR, m2 FROM t""",
    "row_gather": f"WITH {COO} SELECT m0 % 2 AS task, m0 // 2 AS m0, m1, m2, round(x, 6) + 0.0 AS x FROM t",
    "union_jobs": f"WITH {V} SELECT 'line' AS job, * FROM ({_region('median(value)')}) UNION ALL SELECT 'flag', * FROM ({_region('median(value)', 'flag')})",
    "common_subjects": """WITH y AS (SELECT DISTINCT year(o_orderdate) AS y, o_custkey AS c FROM orders)
        SELECT a.y::BIGINT AS year_a, b.y::BIGINT AS year_b, count(*) AS n_common, sum(a.c)::BIGINT AS key_sum FROM y a JOIN y b ON a.c = b.c AND a.y < b.y GROUP BY ALL""",
    "mode_scale": f"WITH {EMB} SELECT vec_id::BIGINT AS vec_id, dim::BIGINT AS dim, round(value / nullif(sqrt(sum(value * value) OVER (PARTITION BY dim)), 0), 8) + 0.0 AS value FROM e",
    "gram": f"WITH {EMB} SELECT p.dim::BIGINT AS r, q.dim::BIGINT AS s, round(sum(p.value * q.value), 6) + 0.0 AS value FROM e p JOIN e q USING (vec_id) GROUP BY ALL",
    "mttkrp": f"WITH {MT} SELECT idx, r, round(value, 4) + 0.0 AS value FROM mt",
    "mu_step": MU,
    "cp_norm_error": f"""WITH {COO}, d AS (SELECT x, {fac("m0", "0")} * {fac("m1", "0")} * {fac("m2", "0")} + {fac("m0", "1")} * {fac("m1", "1")} * {fac("m2", "1")} AS y FROM t)
        SELECT count(*) AS n_cells, round(sqrt(sum((x - y) * (x - y))) / sqrt(sum(x * x)), 6) AS error FROM d""",
    "cp_rank1": f"WITH {PLANTED} SELECT m0, m1, m2, round(v0 * v1 * v2, 5) + 0.0 AS x_hat FROM b, z, y",
    "congruence": f"WITH {EMB} {_cos('v', 'w')}",
    "degeneracy": f"WITH {EMB} SELECT min(cosine) AS degeneracy FROM ({_cos('v', 'v')}) WHERE r <> s",
    "fms_identity": "SELECT 1::BIGINT AS pair, round(count(*) / count(*), 6) AS score FROM embeddings",
    "fms_permuted": "SELECT 1::BIGINT AS pair, round(count(*) / count(*), 6) AS score FROM embeddings",
    "half_half_split": f"WITH {HALF} SELECT task_a, task_b, row_number() OVER (PARTITION BY task_a, task_b ORDER BY sample_idx) - 1 AS pos, sample_idx FROM h",
    "half_half_sizes": f"WITH {HALF} SELECT task_a, task_b, stratum, count(*) AS n FROM h GROUP BY ALL",
    "cv_folds": f"WITH {FOLD} SELECT repeat, fold, sample_idx FROM f",
    "cv_fold_sizes": f"WITH {FOLD} SELECT repeat, fold, stratum, count(*) AS n FROM f GROUP BY ALL",
    "cv_pairs": f"""WITH {FOLD}, k AS (SELECT repeat, unnest([0, 1, 2, 3, 4])::BIGINT AS out, fold, sample_idx FROM f),
        w AS (SELECT repeat * 5 + out AS id, repeat, sample_idx FROM k WHERE out <> fold)
        SELECT a.id AS fold_i, b.id AS fold_j, count(*) AS n_common FROM w a JOIN w b ON a.repeat = b.repeat AND a.sample_idx = b.sample_idx AND a.id < b.id GROUP BY ALL""",
    "subject_merge": f"WITH {MODE} SELECT subjects, n_name, r_name, round(comp_0, 6) + 0.0 AS comp_0, round(comp_1, 6) + 0.0 AS comp_1, round(comp_2, 6) + 0.0 AS comp_2 FROM m",
    "fms_models": """WITH v AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label < 3),
        m AS (SELECT label, dim, avg(x) AS a, max(x) AS b FROM v GROUP BY ALL),
        c AS (SELECT p.label AS r, q.label AS s, abs(sum(p.a * q.b) / sqrt(sum(p.a * p.a) * sum(q.b * q.b))) AS c FROM m p JOIN m q USING (dim) GROUP BY ALL),
        w AS (SELECT x.c + y.c + z.c AS total FROM c x, c y, c z WHERE x.r = 0 AND y.r = 1 AND z.r = 2 AND x.s <> y.s AND y.s <> z.s AND x.s <> z.s)
        SELECT 1::BIGINT AS pair, round(max(total) / 3, 6) AS score FROM w""",
    "subject_violins": f"WITH {LONG}, {_violins('SELECT component, r_name, value AS x FROM lc', 'component, r_name', 'component', (6, 6, 6))}",
    "customer_violins": f"WITH {_violins('SELECT c_mktsegment, c_acctbal AS x FROM customer', 'c_mktsegment', '', (4, 9, 6))}",
    "region_reduce_skew": f"WITH {V} {_region('CASE WHEN max(value) - min(value) > 1e-9 THEN (avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / stddev_pop(value) ** 3 END')}",
    "subject_boxes": f"""WITH {MODE}, u AS (SELECT r_name || '|0' AS g, comp_0 AS x FROM m UNION ALL SELECT r_name || '|1', comp_1 FROM m UNION ALL SELECT r_name || '|2', comp_2 FROM m)
        SELECT split_part(g, '|', 2)::BIGINT AS component, split_part(g, '|', 1) AS r_name, * EXCLUDE (g) FROM (WITH {_box("u", "g", "x", 6)})""",
    "box_stats": f"WITH {_box('orders', 'o_orderpriority', 'o_totalprice', 4)}",
    "colour_limits": """WITH p AS (SELECT o_orderstatus, o_totalprice - 100000.0::DOUBLE AS v FROM orders)
        SELECT o_orderstatus, round(quantile_cont(v, 0.05), 4) + 0.0 AS vmin, round(quantile_cont(v, 0.95), 4) + 0.0 AS vmax FROM p WHERE v > 0 GROUP BY ALL""",
    "avg_rank": """SELECT c_custkey::BIGINT AS c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0::DOUBLE AS rank_avg FROM customer""",
    "mann_whitney_u": """WITH f AS (SELECT c_mktsegment AS g, min(c_custkey) AS first, count(*) AS n FROM customer GROUP BY ALL),
        p AS (SELECT a.g AS ga, b.g AS gb, a.n AS na, b.n AS nb FROM f a JOIN f b ON a.first < b.first),
        k AS (SELECT ga, gb, na, nb, c_mktsegment AS g, rank() OVER (PARTITION BY ga, gb ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY ga, gb, c_acctbal) - 1) / 2.0::DOUBLE AS r
              FROM customer JOIN p ON c_mktsegment IN (ga, gb))
        SELECT ga AS category_a, gb AS category_b, na AS n_a, nb AS n_b, sum(r) - any_value(na * (na + 1) / 2.0::DOUBLE) AS u FROM k WHERE g = ga GROUP BY ga, gb, na, nb""",
    "linregress": """SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) + 0.0 AS intercept,
        round(corr(l_extendedprice, l_quantity) * corr(l_extendedprice, l_quantity), 6) + 0.0 AS r2 FROM lineitem GROUP BY ALL""",
    "regression_line": """WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY ALL),
        s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
        SELECT l_returnflag, step, round(lo + step * (hi - lo) / 49.0::DOUBLE, 6) + 0.0 AS x, round(m * (lo + step * (hi - lo) / 49.0::DOUBLE) + b, 2) + 0.0 AS y_hat FROM f, s, (SELECT unnest(range(0, 50)) AS step)""",
    "component_pairs": f"""WITH {EMB} SELECT p.dim::BIGINT AS component_x, q.dim::BIGINT AS component_y, p.label::BIGINT AS label, count(*) AS n, round(regr_slope(q.value, p.value), 6) + 0.0 AS slope,
        round(corr(q.value, p.value) * corr(q.value, p.value), 6) + 0.0 AS r2 FROM e p JOIN e q USING (vec_id) WHERE p.dim <> q.dim GROUP BY ALL""",
    "voxel_scatter": f"WITH {INDEX} SELECT r, i::BIGINT AS i, j::BIGINT AS j, k::BIGINT AS k, round(value, 8) + 0.0 AS value FROM sc JOIN vi USING (l) WHERE is_csf",
    "slice_rot90": f"WITH {INDEX} SELECT r, k::BIGINT AS slice, (12 - j)::BIGINT AS row, i::BIGINT AS col, value FROM sm JOIN vi USING (l)",
    "spatial_limits": f"""WITH {INDEX} SELECT CASE WHEN is_csf THEN 'csf' ELSE 'parenchyma' END AS tissue, r, round(quantile_cont(value, 0.05), 8) + 0.0 AS vmin, round(quantile_cont(value, 0.95), 8) + 0.0 AS vmax
        FROM sc JOIN vi USING (l) WHERE value > 0 GROUP BY ALL""",
    "time_curve": f"""WITH {COO}, a AS (SELECT m2 AS r, m1 AS t, avg(x) AS v FROM t GROUP BY ALL), s AS (SELECT r, t, v / sqrt(sum(v * v) OVER (PARTITION BY r)) AS value FROM a)
        SELECT r, t, round(value, 6) + 0.0 AS value, -0.1::DOUBLE AS y_low, round(1.1::DOUBLE * max(value) OVER (), 6) + 0.0 AS y_high FROM s""",
    "star_labels": """WITH p AS (SELECT s_suppkey::BIGINT AS s_suppkey, abs(s_acctbal) / 100000.0::DOUBLE AS p FROM supplier)
        SELECT s_suppkey, p, CASE WHEN p <= 1e-4 THEN '****' WHEN p <= 1e-3 THEN '***' WHEN p <= 1e-2 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS star FROM p""",
    "image_regions": """WITH p AS (SELECT 'slab' || (p_partkey // 143 // 16) AS subject, p_retailprice AS r, p_retailprice + 10.0::DOUBLE * p_size AS s, p_size::DOUBLE AS z, (p_partkey % 6) * 0.5::DOUBLE AS l FROM part WHERE p_size > 10),
        v AS (SELECT subject, 0 AS t, l, s / r AS value FROM p UNION ALL SELECT subject, 1 AS t, l, 1 / r - 1 / z AS value FROM p)
        SELECT subject, t::BIGINT AS time_point, round_even(l, 0) AS labels, round(median(value), 6) + 0.0 AS values FROM v WHERE l > 1e-6 GROUP BY subject, t, l""",
    "plane_pixels": f"""WITH {INDEX}, c AS (SELECT CASE WHEN is_csf THEN 'csf' ELSE 'parenchyma' END AS tissue, r, i, j, k, value FROM sc JOIN vi USING (l) WHERE abs(value) > 1e-8),
        x AS (SELECT tissue, 0 AS plane, r, 1048575 - k AS row, 12 - j AS col, value FROM c WHERE i = 5 UNION ALL SELECT tissue, 1 AS plane, r, 1048575 - k AS row, i AS col, value FROM c WHERE j = 6
              UNION ALL SELECT tissue, 2 AS plane, r, 12 - j AS row, i AS col, value FROM c WHERE k = 0)
        SELECT tissue, plane::BIGINT AS plane, r, row::BIGINT AS row, col::BIGINT AS col, round(value, 8) + 0.0 AS value FROM x""",
    "mann_whitney_p": f"""WITH {_ranks("customer", "c_mktsegment", "c_acctbal", "c_custkey")}
        SELECT ga AS category_a, gb AS category_b, u, round(p, 6) + 0.0 AS p, {STAR} AS star FROM wp""",
    "shown_pairs": f"""WITH {_ranks("lineitem", "l_linenumber", "l_extendedprice", "l_linenumber")}
        SELECT ga::BIGINT AS category_a, gb::BIGINT AS category_b, u, round(p, 6) + 0.0 AS p, {STAR} AS star FROM wp WHERE p <= 0.05""",
    "regression_test": f"""WITH c AS (SELECT l_returnflag, l_linenumber::BIGINT AS l_linenumber, count(*) AS n, corr(l_tax, l_discount) AS r FROM lineitem GROUP BY ALL), d AS (SELECT *, {_correlation_p("r", "n")} AS p FROM c)
        SELECT l_returnflag, l_linenumber, n, round(r, 6) + 0.0 AS r, round(p, 6) + 0.0 AS p, p < 0.05 AS significant, format('$R^2={{:.2f}}$, $p={{:.1g}} $', r * r, p) AS text FROM d""",
    "global_regression": f"""WITH c AS (SELECT count(*) AS n, regr_slope(l_tax, l_discount) AS slope, regr_intercept(l_tax, l_discount) AS intercept, corr(l_tax, l_discount) AS r FROM lineitem), d AS (SELECT *, {_correlation_p("r", "n")} AS p FROM c)
        SELECT n, round(slope, 6) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept, round(r * r, 6) + 0.0 AS r2, round(p, 6) + 0.0 AS p, p < 0.05 AS significant, format('$R^2={{:.2f}}$, $p={{:.1g}} $', r * r, p) AS text FROM d""",
    "cp_table_fit": _table_fit(1e-5),
    "cp_best_of_n": _best_of(STARTS, 1e-5),
    "fms_half": _matched(10, 1e-5, HALVES, "SELECT 2 * a AS i, 2 * a + 1 AS j FROM (SELECT unnest(range(0, 10)) AS a)", "1, 2") + " SELECT (i // 2)::BIGINT AS split, score FROM fm",
    "fms_cv": _matched(10, 1e-5, TRAIN, "SELECT DISTINCT a.task AS i, b.task AS j FROM tk a, tk b WHERE a.task < b.task AND a.task // 5 = b.task // 5", "0, 1, 2")
    + """, cm AS (SELECT a.task AS i, b.task AS j, string_agg(a.s::VARCHAR, ',' ORDER BY a.s) AS common FROM tk a JOIN tk b ON a.s = b.s AND a.task < b.task AND a.task // 5 = b.task // 5 GROUP BY ALL)
        SELECT common, i::BIGINT AS fold_i, j::BIGINT AS fold_j, score FROM fm JOIN cm USING (i, j)""",
    "subject_tests": f"""WITH {LONG}, f AS (SELECT component, r_name AS g, min(subjects) AS first, count(*) AS n FROM lc GROUP BY ALL),
        p AS (SELECT a.component, a.g AS ga, b.g AS gb, a.n AS na, b.n AS nb FROM f a JOIN f b ON a.component = b.component AND a.first < b.first)
        SELECT p.component, ga AS category_a, gb AS category_b, na AS n_a, nb AS n_b, sum(CASE WHEN x.value > y.value THEN 1.0::DOUBLE WHEN x.value = y.value THEN 0.5::DOUBLE ELSE 0 END) AS u
        FROM p JOIN lc x ON x.component = p.component AND x.r_name = ga JOIN lc y ON y.component = p.component AND y.r_name = gb GROUP BY ALL""",
    "subject_fits": f"""WITH {LONG}, {XY}, c AS (SELECT variable, component, r_name, count(*) AS n, CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) END AS slope, CASE WHEN var_pop(x) > 0 THEN corr(y, x) END AS r FROM xy GROUP BY ALL),
        d AS (SELECT *, {_correlation_p("r", "n")} AS p FROM c)
        SELECT variable, component, r_name, n, round(slope, 6) + 0.0 AS slope, round(r * r, 6) + 0.0 AS r2, round(p, 6) + 0.0 AS p, p < 0.05 AS significant FROM d""",
    "subject_lines": f"""WITH {LONG}, {XY}, c AS (SELECT variable, component, r_name, CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) END AS a, CASE WHEN var_pop(x) > 0 THEN regr_intercept(y, x) END AS b FROM xy GROUP BY ALL),
        s AS (SELECT variable, min(x) AS lo, max(x) AS hi FROM xy GROUP BY ALL) {_lines("c", "s USING (variable)")}""",
    "subject_limits": f"WITH {LONG}, {LIMITS} SELECT component, y_low, round(y_high, 6) + 0.0 AS y_high, -0.25::DOUBLE AS x_low, round(g - 1 + 0.825::DOUBLE, 6) AS x_high FROM li",
    "subject_strips": f"""WITH {LONG}, f AS (SELECT r_name, row_number() OVER (ORDER BY min(subjects)) - 1 AS pos FROM m GROUP BY r_name)
        SELECT component, subjects, r_name, pos, true AS inside, round(value, 6) + 0.0 AS value FROM lc JOIN f USING (r_name)""",
    "component_limits": f"""WITH {LONG}, {LIMITS} SELECT a.component AS component_y, b.component AS component_x, a.y_low, round(a.y_high, 6) + 0.0 AS y_high,
        CASE WHEN a.component = b.component THEN -0.25::DOUBLE ELSE 0 END AS x_low, round(CASE WHEN a.component = b.component THEN a.g - 1 + 0.325::DOUBLE ELSE b.y_high END, 6) + 0.0 AS x_high FROM li a, li b""",
    "component_lines": f"""WITH {LONG}, c AS (SELECT p.component AS component_x, q.component AS component_y, p.r_name, CASE WHEN var_pop(p.value) > 0 THEN regr_slope(q.value, p.value) END AS a, CASE WHEN var_pop(p.value) > 0 THEN regr_intercept(q.value, p.value) END AS b
              FROM lc p JOIN lc q USING (subjects) WHERE p.component <> q.component GROUP BY ALL),
        s AS (SELECT component AS component_x, min(value) AS lo, max(value) AS hi FROM lc GROUP BY ALL) {_lines("c", "s USING (component_x)")}""",
    "masked_overlay": f"""WITH {INDEX} SELECT -1::BIGINT AS r, (1048575 - k)::BIGINT AS row, i::BIGINT AS col, p_size::DOUBLE AS value FROM vi JOIN part ON l = p_partkey WHERE j = 6
        UNION ALL SELECT r, 1048575 - k, i, value FROM sm JOIN vi USING (l) WHERE j = 6 AND is_csf""",
    "mode_grid": f"""WITH {COO}, {INDEX}, g AS (SELECT CASE WHEN is_csf THEN 'csf' ELSE 'parenchyma' END AS part, r, i, j, k, value FROM sc JOIN vi USING (l)),
        li AS (SELECT part, r, quantile_cont(value, 0.05) AS low, quantile_cont(value, 0.95) AS high FROM g WHERE value > 0 GROUP BY ALL),
        ta AS (SELECT m2 AS r, m1 AS a, avg(x) AS v FROM t GROUP BY ALL), tb AS (SELECT r, a, v / sqrt(sum(v * v) OVER (PARTITION BY r)) AS value FROM ta),
        al AS (SELECT part, r, 1048575 - k AS a, 12 - j AS b, value, low, high FROM g JOIN li USING (part, r) WHERE i = 5 UNION ALL SELECT 'time', r, a, 0, value, -0.1, 1.1::DOUBLE * max(value) OVER () FROM tb)
        SELECT part, r::BIGINT AS r, a::BIGINT AS a, b::BIGINT AS b, round(value, 6) + 0.0 AS value, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high FROM al""",
    "volume_scan": """SELECT 'slab' || (p_partkey // 143 // 16) AS volume_id, (p_partkey % 11)::BIGINT AS i, (p_partkey // 11 % 13)::BIGINT AS j, (p_partkey // 143 % 16)::BIGINT AS k, p_retailprice AS value FROM part""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
