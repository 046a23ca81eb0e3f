"""SQL of another engine (DuckDB) for the same results, put together from named parts."""

from __future__ import annotations

# Each part is a common table expression; parts name others that they need.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (needs, sql)


def sql(final: str, *needs: str) -> str:
    """``final`` after the parts that it needs, each once and after its own needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in PARTS[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order) + "\n" + final


K = "dataset, scene_id, frame_idx"
EV = "ln(0.7::DOUBLE / 0.3::DOUBLE)"


def frame(of: str) -> str:
    return f"'driver' AS dataset, ({of} % 5)::VARCHAR AS scene_id, ({of} // 5)::INT AS frame_idx"


def quat(u: str) -> tuple[str, str]:
    return f"(1 - {u} * {u}) / (1 + {u} * {u})", f"2 * {u} / (1 + {u} * {u})"


def matrix(w: str, z: str) -> str:
    """The upper left of the rotation by a quaternion (w, 0, 0, z)."""
    s = f"(2.0::DOUBLE / ({w} * {w} + {z} * {z}))"
    return f"1 - {s} * ({z} * {z}) AS r00, {s} * (0 - {z} * {w}) AS r01, {s} * ({z} * {w}) AS r10, 1 - {s} * ({z} * {z}) AS r11"


XYZ = """((l_partkey * 7919 + l_linenumber * 1543 + l_orderkey * 31) % 5000 - 2500) / 100.0::DOUBLE AS x,
  ((l_orderkey * 6007 + l_linenumber * 977 + l_partkey * 17) % 5000 - 2500) / 100.0::DOUBLE AS y,
  ((l_orderkey * 101 + l_partkey * 13 + l_linenumber * 7) % 600 - 250) / 100.0::DOUBLE AS z"""

part("pts", f"SELECT {frame('l_suppkey')}, {XYZ} FROM lineitem")
part("pts_dense", f"SELECT {frame('(1 + l_suppkey % 9)')}, {XYZ} FROM lineitem")
part("pts_coarse", f"SELECT {K}, floor(x) + 0.25 AS x, floor(y) + 0.25 AS y, z FROM pts", "pts")
part("frq", f"""SELECT s_suppkey, {frame('s_suppkey')}, (s_suppkey % 7) / 20.0::DOUBLE AS cu, ((s_suppkey // 5) % 11) / 40.0::DOUBLE AS pu,
  1000.0::DOUBLE * (s_suppkey % 5) + 8 * (s_suppkey // 5) / 10.0::DOUBLE AS px, 3 * (s_suppkey // 5) / 10.0::DOUBLE AS py FROM supplier""")
part("frw", f"SELECT *, {quat('pu')[0]} AS pw, {quat('pu')[1]} AS pz, {quat('cu')[0]} AS cw, {quat('cu')[1]} AS cz FROM frq", "frq")
part("frm", f"SELECT *, {matrix('pw', 'pz')} FROM frw", "frw")
part("ego", f"SELECT {K}, x::FLOAT AS x, y::FLOAT AS y, (z + 1.84::DOUBLE)::FLOAT AS z FROM pts JOIN frq USING ({K})", "pts", "frq")
part("ego_coarse", f"SELECT {K}, x::FLOAT AS x, y::FLOAT AS y, (z + 1.84::DOUBLE)::FLOAT AS z FROM pts_coarse JOIN frq USING ({K})", "pts_coarse", "frq")
part("ego_dense", f"SELECT {K}, x::FLOAT AS x, y::FLOAT AS y, (z + 1.84::DOUBLE)::FLOAT AS z FROM pts_dense JOIN frq USING ({K})", "pts_dense", "frq")
part("turned", f"SELECT {K}, (r00 * x + r01 * y)::FLOAT AS x, (r10 * x + r11 * y)::FLOAT AS y, (z + 1.84::DOUBLE)::FLOAT AS z FROM pts JOIN (SELECT {K}, {matrix('cw', 'cz')} FROM frw) USING ({K})", "pts", "frw")
HIGH_OK = "z BETWEEN 0.3::FLOAT AND 3.0::FLOAT"
RANGE_OK = "abs(x) <= 20 AND abs(y) <= 20 AND sqrt(x::DOUBLE * x::DOUBLE + y::DOUBLE * y::DOUBLE) >= 1.5"
CELLS = "least(greatest(floor((20.0::FLOAT - y) / 0.5::FLOAT)::INT, 0), 79) AS row, least(greatest(floor((x + 20.0::FLOAT) / 0.5::FLOAT)::INT, 0), 79) AS col"


def kept(source: str) -> str:
    return f"SELECT {K}, x, y, {CELLS} FROM {source} WHERE {HIGH_OK} AND {RANGE_OK}"


part("kept", kept("ego"), "ego")
part("kept_coarse", kept("ego_coarse"), "ego_coarse")
part("kept_dense", kept("ego_dense"), "ego_dense")
part("kept_turned", kept("turned"), "turned")


def rays(source: str, key: str = K, er: str = "40", ec: str = "40") -> str:
    """Cells of the ray to each distinct hit cell; i = m is the hit."""
    side = lambda d: f"sign({d})::INT * CASE WHEN abs({d}) = m THEN i ELSE (2 * i * abs({d}) + m - 1) // (2 * m) END"
    return f"""SELECT {key}, n, i, m, er + {side('dr')} AS row, ec + {side('dc')} AS col, hit_row, hit_col
      FROM (SELECT *, unnest(range(m + 1))::INT AS i FROM (
        SELECT *, greatest(abs(dr), abs(dc)) AS m FROM (
          SELECT {key}, row AS hit_row, col AS hit_col, {er} AS er, {ec} AS ec, row - {er} AS dr, col - {ec} AS dc, count(*) AS n FROM {source} GROUP BY ALL)))"""


def evidence(source: str, key: str = K) -> str:
    return f"SELECT {key}, row, col, sum(CASE WHEN i = m THEN n ELSE 0 END)::BIGINT AS n_hits, max((i < m)::INT) AS is_free FROM ({source}) GROUP BY ALL"


def scan(source: str) -> str:
    value = f"CASE WHEN n_hits * {EV} >= 5 THEN 5 - {EV} * is_free ELSE {EV} * (n_hits - is_free) END"
    return f"SELECT * EXCLUDE (n_hits, is_free), {value} AS value, (1 / (1 + exp(-({value}))))::FLOAT AS p FROM {source}"


for v in ("", "_coarse", "_dense"):
    part(f"ev{v}", evidence(rays(f"kept{v}")), f"kept{v}")
    part(f"map{v}", scan(f"ev{v}"), f"ev{v}")


def fold(source: str) -> str:
    """Scans of a scene in order, clamped after each."""
    step = f"{{'v': greatest(-5.0::DOUBLE, least(5.0::DOUBLE, a.v + b.n * {EV}) - b.f * {EV}), 'n': 0::BIGINT, 'f': 0::INT}}"
    start = "{'v': 0.0::DOUBLE, 'n': 0::BIGINT, 'f': 0::INT}"
    return f"""SELECT dataset, scene_id, row, col, n_scans, value, (1 / (1 + exp(-value)))::FLOAT AS p FROM (
      SELECT dataset, scene_id, row, col, count(*) AS n_scans,
        list_reduce(list_prepend({start}, list({{'v': 0.0::DOUBLE, 'n': n_hits, 'f': is_free}} ORDER BY frame_idx)), lambda a, b: {step}).v AS value
      FROM {source} GROUP BY ALL)"""


part("centre", "SELECT dataset, scene_id, avg(px) AS ox, avg(py) AS oy FROM frq GROUP BY ALL", "frq")
part("world", """SELECT dataset, scene_id, frame_idx, x, y, least(greatest(floor((20.0::FLOAT - y) / 0.5::FLOAT)::INT, 0), 79) AS row,
  least(greatest(floor((x + 20.0::FLOAT) / 0.5::FLOAT)::INT, 0), 79) AS col, least(greatest(trunc((20 - dy) / 0.5)::INT, 0), 79) AS er, least(greatest(trunc((dx + 20) / 0.5)::INT, 0), 79) AS ec
  FROM (SELECT k.dataset, k.scene_id, k.frame_idx, k.x::DOUBLE + (px - ox) AS x, k.y::DOUBLE + (py - oy) AS y, px - ox AS dx, py - oy AS dy
    FROM kept k JOIN frq f ON k.dataset = f.dataset AND k.scene_id = f.scene_id AND k.frame_idx = f.frame_idx JOIN centre c ON c.dataset = k.dataset AND c.scene_id = k.scene_id)
  WHERE abs(x) <= 20 AND abs(y) <= 20""", "kept", "frq", "centre")
part("world_ev", evidence(rays("world", f"{K}", "er", "ec")), "world")

part("high", f"SELECT * FROM ego WHERE {HIGH_OK}", "ego")
part("pairs", f"SELECT k.dataset, k.scene_id, k.frame_idx, j.frame_idx - k.frame_idx AS off, j.frame_idx AS j FROM frq k JOIN frq j ON j.dataset = k.dataset AND j.scene_id = k.scene_id AND abs(j.frame_idx - k.frame_idx) <= 2", "frq")
part("moved", """SELECT q.dataset, q.scene_id, q.frame_idx, off, (k.r00 * wx + k.r10 * wy)::FLOAT AS x, (k.r01 * wx + k.r11 * wy)::FLOAT AS y FROM (
    SELECT q.*, (j.r00 * h.x + j.r01 * h.y) + j.px AS gx, (j.r10 * h.x + j.r11 * h.y) + j.py AS gy
    FROM pairs q JOIN frm j ON j.dataset = q.dataset AND j.scene_id = q.scene_id AND j.frame_idx = q.j JOIN high h ON h.dataset = q.dataset AND h.scene_id = q.scene_id AND h.frame_idx = q.j) q
  JOIN frm k ON k.dataset = q.dataset AND k.scene_id = q.scene_id AND k.frame_idx = q.frame_idx, LATERAL (SELECT gx - k.px AS wx, gy - k.py AS wy)""", "pairs", "frm", "high")
part("window_kept", f"SELECT {K}, off, x, y, {CELLS} FROM moved WHERE {RANGE_OK}", "moved")
part("window_ev", evidence(rays("window_kept", f"{K}, off"), f"{K}, off"), "window_kept")
part("window_map", scan("window_ev"), "window_ev")
part("fused", f"""SELECT {K}, row, col, w, value, (1 / (1 + exp(-value)))::FLOAT AS p FROM (
    SELECT {K}, row, col, w, greatest(-5.0::DOUBLE, least(5.0::DOUBLE, sum(0.85::DOUBLE ** abs(off) * value))) AS value FROM window_map, (SELECT unnest([0, 1, 2]) AS w) WHERE abs(off) <= w GROUP BY ALL)""", "window_map")

part("boxw", f"""SELECT o_orderkey AS box_id, {frame('f')}, ((o_orderkey * 37) % 4400 - 2200) / 100.0::DOUBLE AS dx, ((o_custkey * 53 + o_orderkey * 11) % 4400 - 2200) / 100.0::DOUBLE AS dy,
  1.5::DOUBLE + (o_orderkey % 5) / 4.0::DOUBLE AS w, 3.0::DOUBLE + (o_orderkey % 7) / 2.0::DOUBLE AS l, (o_orderkey % 9) / 10.0::DOUBLE AS u FROM (SELECT *, o_custkey % (SELECT count(*) FROM supplier) AS f FROM orders)""")
part("box", f"""SELECT b.* EXCLUDE (u), px + dx AS gx, py + dy AS gy, (px + dx) - px AS cx, (py + dy) - py AS cy, atan2(2 * ({quat('u')[0]}) * ({quat('u')[1]}), 1 - 2 * ({quat('u')[1]}) * ({quat('u')[1]})) AS yaw
  FROM boxw b JOIN frq USING ({K})""", "boxw", "frq")


def box_cells(source: str) -> str:
    return f"""SELECT {K}, box_id, row, col FROM (
      SELECT *, (col + 0.5) * 0.5 - 20 - cx AS ex, 20 - (row + 0.5) * 0.5 - cy AS ey FROM {source}, (SELECT unnest(range(80))::INT AS row), (SELECT unnest(range(80))::INT AS col)
      WHERE abs((col + 0.5) * 0.5 - 20 - cx) < 6 AND abs(20 - (row + 0.5) * 0.5 - cy) < 6)
    WHERE abs(ex * cos(yaw) + ey * sin(yaw)) < l / 2 AND abs(ey * cos(yaw) - ex * sin(yaw)) < w / 2"""


part("bcells", box_cells("box"), "box")
part("labels", f"""SELECT box_id, {K}, x + CASE WHEN f % 7 = 3 THEN 100 ELSE 0 END AS x, z, w, l, rotation_y FROM (
  SELECT o_orderkey AS box_id, f, {frame('f')}, ((o_orderkey * 37) % 4400 - 2200) / 100.0::DOUBLE AS x, ((o_custkey * 53 + o_orderkey * 11) % 4400 - 2200) / 100.0::DOUBLE AS z,
    1.5::DOUBLE + (o_orderkey % 5) / 4.0::DOUBLE AS w, 3.0::DOUBLE + (o_orderkey % 7) / 2.0::DOUBLE AS l, ((o_orderkey * 29) % 600 - 300) / 100.0::DOUBLE AS rotation_y
  FROM (SELECT *, o_custkey % (SELECT count(*) FROM supplier) AS f FROM orders))""")
part("kbox", "SELECT *, x AS cx, z AS cy, rotation_y AS yaw FROM labels WHERE abs(x) <= 20 AND abs(z) <= 20", "labels")
part("kcells", box_cells("kbox"), "kbox")
part("occ", f"SELECT {K}, row, col FROM map WHERE p > 0.5", "map")
part("seen", f"""SELECT {K}, floor((atan2(y::DOUBLE, x::DOUBLE) + pi()) / (2 * pi() / 360))::INT % 360 AS bin, min(sqrt(x::DOUBLE * x::DOUBLE + y::DOUBLE * y::DOUBLE)) AS d FROM kept GROUP BY ALL""", "kept")
part("probe", """SELECT bin, step, least(greatest(floor((20 - step * sin(angle)) / 0.5)::INT, 0), 79) AS row, least(greatest(floor((step * cos(angle) + 20) / 0.5)::INT, 0), 79) AS col FROM (
  SELECT bin, 1.5 + i * 0.25::DOUBLE AS step, -pi() + bin * (2 * pi() / 360) AS angle FROM (SELECT unnest(range(360))::INT AS bin), (SELECT unnest(range(108))::INT AS i))""")
part("firsthit", f"SELECT {K}, bin, min(step) AS d_est FROM occ JOIN probe USING (row, col) GROUP BY ALL", "occ", "probe")
part("per_box", f"SELECT {K}, box_id, count(*) AS n_box, count(o.row) AS n_hit FROM bcells LEFT JOIN (SELECT * FROM occ) o USING ({K}, row, col) GROUP BY ALL", "bcells", "occ")
part("res", f"""SELECT CASE WHEN f % 2 = 0 THEN 'a' ELSE 'b' END AS dataset, (f % 5)::VARCHAR AS scene_id, (f // 5)::INT AS frame_idx, ['t1', 't2_beta0', 't2_beta1'][m + 1] AS method, (m = 2)::INT AS beta,
  nmse, iobb, precision, iters, iters < 60 AS converged, elapsed_s FROM (
    SELECT o_custkey % (SELECT count(*) FROM supplier) AS f, o_orderkey % 3 AS m, min(CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 37 % 1000) / 1000.0::DOUBLE END) AS nmse,
      min(CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey * 53 % 1000) / 2000.0::DOUBLE END) AS iobb, min(CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 71 % 1000) / 4000.0::DOUBLE END) AS precision,
      min((o_orderkey * 7 % 150)::INT) AS iters, min((o_orderkey * 13 % 900 + 100) / 100.0::DOUBLE) AS elapsed_s FROM orders GROUP BY ALL)""")
part("near3", f"""SELECT {K}, row, col FROM (SELECT *, row_number() OVER (PARTITION BY {K}, bin ORDER BY rng, x, y) AS nth FROM (
  SELECT *, floor((atan2(y::DOUBLE, x::DOUBLE) + pi()) / (2 * pi() / 360))::INT % 360 AS bin, sqrt(x::DOUBLE * x::DOUBLE + y::DOUBLE * y::DOUBLE) AS rng FROM kept)) WHERE nth <= 3""", "kept")
part("model_rays", rays("near3"), "near3")
part("kernel", "SELECT i, exp(-0.5 * (i / 0.8) ** 2) / sum(exp(-0.5 * (i / 0.8) ** 2)) OVER () AS w FROM (SELECT unnest(range(-3, 4))::INT AS i)")
part("taps", "SELECT u, w, CASE WHEN u + i < 0 THEN -1 - u - i WHEN u + i > 79 THEN 159 - u - i ELSE u + i END AS v FROM (SELECT unnest(range(80))::INT AS u), kernel", "kernel")
part("dense", f"SELECT {K}, row, col, coalesce(p::DOUBLE, 0.5) AS p FROM (SELECT * FROM (SELECT DISTINCT {K} FROM map), (SELECT unnest(range(80))::INT AS row), (SELECT unnest(range(80))::INT AS col)) LEFT JOIN map USING ({K}, row, col)", "map")
part("smooth_rows", f"SELECT {K}, u AS row, col, sum(w * p) AS p FROM dense JOIN taps ON row = v GROUP BY ALL", "dense", "taps")
part("smooth_cols", f"SELECT {K}, row, u AS col, sum(w * p) AS p FROM smooth_rows JOIN taps ON col = v GROUP BY ALL", "smooth_rows", "taps")


def coarse_hits(source: str, key: str, hits: int, bins: int, seen: str = "") -> str:
    """The closest hits of each bearing on a grid of 10 x 10 cells of 4 metres, counted by cell; ``seen`` is part of the pick's key only."""
    return f"""SELECT {key}{seen}, row, col, count(*)::DOUBLE AS n FROM (
      SELECT * EXCLUDE (row, col), least(greatest(floor((20.0::FLOAT - y) / 4.0::FLOAT)::INT, 0), 9) AS row, least(greatest(floor((x + 20.0::FLOAT) / 4.0::FLOAT)::INT, 0), 9) AS col,
        row_number() OVER (PARTITION BY {key}{seen}, bin ORDER BY rng, x, y) AS nth FROM (
        SELECT *, floor((atan2(y::DOUBLE, x::DOUBLE) + pi()) / (2 * pi() / {bins}))::INT % {bins} AS bin, sqrt(x::DOUBLE * x::DOUBLE + y::DOUBLE * y::DOUBLE) AS rng FROM {source}))
    WHERE nth <= {hits} GROUP BY ALL"""


def solves(source: str, size: int, key: str = K, most: int = 150, tol: str = "2e-3") -> str:
    """A recursive table ``em`` of full solves, to follow others: ``key, beta, it, mu, alpha, history, touched, done``, a row a step.

    ``source`` has a row for each hit cell: key, beta, gamma (re-estimated if not above 0), fw (weight of rays), row, col, er, ec (the
    vehicle), h (squared weights), n (hits), start (squared weights that count at the start). In each step the rays of the hits come in
    one by one: each adds a vector g and a number s, and the inverse is the diagonal 1 / d less the sum of s g g'.
    """
    n, names = size * size, f"{key}, beta, gamma_given, fw, hits, h, touched, n"
    cells = f"range(1, {n + 1})"
    each = lambda e: f"list_transform({cells}, lambda i: {e})"
    within = lambda e, low, high: f"least(greatest({e}, {low}), {high})"
    update = lambda omega: within(f"(2 * 1e-4::DOUBLE + 1) / (2 * 1e-4::DOUBLE + {omega})", "1e-3", "1e3")
    side = lambda d: f"sign({d})::INT * CASE WHEN abs({d}) = m THEN i ELSE (2 * i * abs({d}) + m - 1) // (2 * m) END"

    def around(c: str) -> str:
        sides = ((f"i > {size}", f"i - {size}"), (f"i <= {n - size}", f"i + {size}"), (f"(i - 1) % {size} > 0", "i - 1"), (f"i % {size} > 0", "i + 1"))
        return "(" + " + ".join(f"CASE WHEN {there} THEN {c}[{at}] ELSE 0 END" for there, at in sides) + ")"

    def scattered(v: str) -> str:
        return each(f"coalesce(list_sum(list_transform(list_filter(hits, lambda t: t.cell = i), lambda t: t.{v})), 0.0)")

    lines = f"""SELECT {key}, beta, gamma, fw, row, col, h, n, start, list((er + {side('dr')}) * {size} + ec + {side('dc')} + 1) AS line
      FROM (SELECT *, unnest(range(m + 1))::INT AS i FROM (SELECT *, greatest(abs(dr), abs(dc)) AS m FROM (SELECT *, row - er AS dr, col - ec AS dc FROM ({source})))) GROUP BY ALL"""
    hit = f"{{'cell': row * {size} + col + 1, 'h': h, 'n': n, 'start': start, 'line': line, 'u': {each('list_contains(line, i)::INT::DOUBLE')}}}"
    models = f"""SELECT *, {scattered('h')} AS h, list_distinct(flatten(list_transform(hits, lambda t: t.line))) AS touched, list_sum(list_transform(hits, lambda t: t.n)) AS n,
      CASE WHEN gamma_given > 0 THEN gamma_given ELSE 50.0 END::DOUBLE AS gamma
      FROM (SELECT {key}, beta, gamma AS gamma_given, fw, list({hit} ORDER BY row, col) AS hits FROM ({lines}) GROUP BY ALL)"""
    first = f"""SELECT {names}, 0 AS it, gamma, list_transform(list_transform({scattered('start')}, lambda x: gamma * x / (gamma * x + 1)), lambda m: {update('m * m + 1 / gamma')}) AS alpha,
      {each('0.0::DOUBLE')} AS mu, []::DOUBLE[] AS history, false AS done FROM ({models})"""
    none = f"{{'gs': [{{'g': {each('0.0::DOUBLE')}, 's': 0.0::DOUBLE}}], 'u': []::DOUBLE[], 'w': 0.0::DOUBLE}}"
    ray = "{'gs': [{'g': []::DOUBLE[], 's': 0.0::DOUBLE}], 'u': t.u, 'w': gamma * fw * fw * t.h}"
    less = lambda gs: f"list_dot_product(f, list_transform({gs}, lambda z: z.g[i]))"
    grown = f"""list_transform([list_transform(acc.gs, lambda z: z.s * list_dot_product(z.g, x.u))], lambda f: list_transform([{each(f'x.u[i] / d[i] - {less("acc.gs")}')}], lambda g:
      {{'gs': list_append(acc.gs, {{'g': g, 's': 1 / (1 / x.w + list_dot_product(x.u, g))}}), 'u': []::DOUBLE[], 'w': 0.0::DOUBLE}})[1])[1]"""
    rays_in = f"list_reduce(list_prepend({none}, list_transform(list_filter(hits, lambda t: fw > 0), lambda t: {ray})), lambda acc, x: {grown}).gs"
    step = f"SELECT *, {each(f'alpha[i] + beta * {around("alpha")} + gamma * h[i]')} AS d FROM em WHERE NOT done AND it < {most}"
    step = f"SELECT *, {rays_in} AS gs FROM ({step})"
    step = f"SELECT *, list_transform(gs, lambda z: z.s * list_dot_product(z.g, list_transform(h, lambda x: gamma * x))) AS f FROM ({step})"
    step = f"""SELECT *, {each(f'gamma * h[i] / d[i] - {less("gs")}')} AS new,
      {each('greatest(1 / d[i] - list_sum(list_transform(gs, lambda z: z.s * z.g[i] * z.g[i])), 0.0)')} AS var FROM ({step})"""
    step = f"SELECT *, {each('new[i] * new[i] + var[i]')} AS v FROM ({step})"
    step = f"""SELECT *, {each(update(f'v[i] + beta * {around("v")}'))} AS up,
      list_sum(list_transform(hits, lambda t: t.h * (1 - new[t.cell]) ** 2 + t.n * var[t.cell] + fw * fw * t.h * list_dot_product(t.u, new) ** 2 + CASE WHEN fw > 0 THEN t.n * list_dot_product(t.u, var) ELSE 0 END)) AS misfit,
      sqrt(list_sum({each('(new[i] - mu[i]) ** 2')})) / greatest(sqrt(list_sum(list_transform(new, lambda x: x * x))), 1e-12) AS change FROM ({step})"""
    step = f"""SELECT {names}, it + 1, CASE WHEN gamma_given > 0 THEN gamma ELSE {within('2 * n / greatest(misfit, 1e-12)', '1e-3', '1e6')} END,
      CASE WHEN it = 0 THEN up ELSE {each('0.7::DOUBLE * alpha[i] + 0.3::DOUBLE * up[i]')} END, new, list_append(history, change), change < {tol} FROM ({step})"""
    return f", em AS ({first} UNION ALL {step})"


def solved(source: str, size: int, key: str, *needs: str, final: str | None = None) -> str:
    """Full solves of ``source``, cell by cell; or ``final``, which selects from ``cells`` (of the maps) or ``em``."""
    cells = f"""cells AS (SELECT {key}, beta, gamma_given AS gamma, fw AS free_weight, it AS iters, done AS converged, ((c - 1) // {size})::INT AS row, ((c - 1) % {size})::INT AS col, mu[c] AS mu, alpha[c] AS alpha
      FROM (SELECT *, unnest(touched) AS c FROM em WHERE done OR it = 150))"""
    end = final or f"SELECT {key}, beta, gamma, free_weight, iters, converged, row, col, round(mu, 6) + 0.0 AS mu, round(alpha, 6) + 0.0 AS alpha FROM cells"
    return sql("", *needs).strip() + f"{solves(source, size, key)}, {cells}\n{end}"
