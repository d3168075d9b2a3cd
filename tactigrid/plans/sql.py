"""Pieces of SQL for the catalogue: common table expressions over derived frames."""

from __future__ import annotations

from collections.abc import Mapping

from tactigrid.functions.kernels import Factors

#: 8x8 frames of whole numbers from embeddings.
E = """e AS (
  SELECT vec_id AS f, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y,
         CAST(floor(CAST(embedding[i] AS DOUBLE) * 100 + 0.5) AS INTEGER) AS v
  FROM embeddings CROSS JOIN range(1, 65) t(i)
)"""

#: Contacts and splatted 72x48 frames from events.
T = """c AS (
  SELECT user_id AS f, event_id AS id, CAST(event_id * 7 % 72 AS INTEGER) AS mx, CAST(event_id * 13 % 48 AS INTEGER) AS my,
         0.2e0 + abs(coalesce(value, 0e0)) % 100 / 200 AS amplitude
  FROM events
), near(d) AS (SELECT CAST(unnest(range(-5, 6)) AS INTEGER)),
cells AS (
  SELECT f, mx + a.d AS x, my + b.d AS y, amplitude * exp(-(a.d * a.d + b.d * b.d) / 4.5e0) AS v FROM c, near a, near b
  WHERE mx + a.d BETWEEN 0 AND 71 AND my + b.d BETWEEN 0 AND 47
  UNION ALL
  SELECT f, CAST(i % 72 AS INTEGER), CAST(i // 72 AS INTEGER), 0e0 FROM (SELECT DISTINCT f FROM c), range(3456) t(i)
), t AS (SELECT f, x, y, sum(v) AS v FROM cells GROUP BY f, x, y)"""


def _remap(place: str, size: int, border: str) -> str:
    if border == "extend":
        return f"greatest(0, least({size - 1}, {place}))"
    if border == "mirror":
        return f"CASE WHEN {place} < 0 THEN -1 - ({place}) WHEN {place} >= {size} THEN {2 * size - 1} - ({place}) ELSE {place} END"
    return place


def convolve(name: str, source: str, outputs: Mapping[str, tuple[str, Factors]], border: tuple[str, str], keep: tuple[str, ...] = (), size: tuple[int, int] = (8, 8)) -> str:
    """A table expression with f, x, y, the kept columns and each output: (column, kernel factors)."""
    kernels = [k for _, k in outputs.values()]
    nx, ny = len(kernels[0][0]), len(kernels[0][1])
    rows = ", ".join(f"({i - nx // 2}, {j - ny // 2}, {', '.join(repr(k[0][i] * k[1][j]) + 'e0' * ('e' not in repr(k[0][i] * k[1][j]) and isinstance(k[0][i] * k[1][j], float)) for k in kernels)})" for i in range(nx) for j in range(ny))
    weights = ", ".join(f"w{n}" for n in range(len(kernels)))
    sums = ", ".join(f"sum(k.w{n} * b.{column}) AS {target}" for n, (target, (column, _)) in enumerate(outputs.items()))
    kept = "".join(f"any_value(a.{c}) AS {c}, " for c in keep)
    on_x, on_y = _remap("a.x + k.dx", size[0], border[0]), _remap("a.y + k.dy", size[1], border[1])
    return f"{name} AS (SELECT a.f, a.x, a.y, {kept}{sums} FROM {source} a CROSS JOIN (VALUES {rows}) k(dx, dy, {weights}) JOIN {source} b ON b.f = a.f AND b.x = {on_x} AND b.y = {on_y} GROUP BY a.f, a.x, a.y)"


def correlate(name: str, source: str, kernel: list[list[int]], border: tuple[str, str], size: tuple[int, int] = (8, 8)) -> str:
    """A table expression with f, x, y and s: the column v under a kernel of any shape, a row for each of its weights."""
    weights = ", ".join(f"({i - len(row) // 2}, {j - len(kernel) // 2}, {k})" for j, row in enumerate(kernel) for i, k in enumerate(row))
    on_x, on_y = _remap("a.x + k.dx", size[0], border[0]), _remap("a.y + k.dy", size[1], border[1])
    return f"{name} AS (SELECT a.f, a.x, a.y, coalesce(sum(k.weight * b.v), 0) AS s FROM {source} a CROSS JOIN (VALUES {weights}) k(dx, dy, weight) LEFT JOIN {source} b ON b.f = a.f AND b.x = {on_x} AND b.y = {on_y} GROUP BY a.f, a.x, a.y)"


def floor_removed(name: str, source: str) -> str:
    return f"{name} AS (SELECT f, x, y, greatest(v - avg(v) OVER (PARTITION BY f), 0e0) AS v FROM {source})"


def first_root(xx: str, xy: str, yy: str) -> str:
    tr, det = f"({xx} + {yy})", f"({xx} * {yy} - {xy} * {xy})"
    root = f"sqrt(greatest({tr} * {tr} - 4 * {det}, 0e0))"
    return f"CASE WHEN abs({det}) <= 1e-20 THEN CAST({tr} AS DOUBLE) ELSE ({tr} + CASE WHEN {tr} >= 0 THEN {root} ELSE -{root} END) / 2 END"


def second_root(xx: str, xy: str, yy: str, first: str) -> str:
    det = f"({xx} * {yy} - {xy} * {xy})"
    return f"CASE WHEN abs({det}) <= 1e-20 OR {first} = 0 THEN 0e0 ELSE {det} / {first} END"


def eigen(name: str, source: str, prefix: str, first: str, second: str, keep: str) -> str:
    m = [f"CAST({prefix}{k} AS DOUBLE)" for k in ("xx", "xy", "yy")]
    inner = f"SELECT *, {first_root(*m)} AS {first} FROM {source}"
    return f"{name} AS (SELECT f, x, y, {keep}{first}, {second_root(*m, first)} AS {second} FROM ({inner}))"


def labels(name: str, source: str, condition: str, connectivity: int) -> str:
    """Labels of the cells that meet the condition, with 0 elsewhere: f, x, y, v, label. Needs WITH RECURSIVE."""
    near = "abs(b.x - r.x) + abs(b.y - r.y) = 1" if connectivity == 4 else "abs(b.x - r.x) <= 1 AND abs(b.y - r.y) <= 1"
    return f"""{name}_fg AS (SELECT f, x, y, y * 8 + x AS p FROM {source} WHERE {condition}),
{name}_reach(f, x, y, root) AS (
  SELECT f, x, y, p FROM {name}_fg
  UNION
  SELECT b.f, b.x, b.y, r.root FROM {name}_reach r JOIN {name}_fg b ON b.f = r.f AND {near} AND b.p > r.root
),
{name}_root AS (SELECT f, x, y, min(root) AS root FROM {name}_reach GROUP BY f, x, y),
{name}_joined AS (
  SELECT a.f, a.x, a.y, a.root, b.root AS above FROM {name}_root a JOIN {name}_root b ON b.f = a.f AND b.y * 8 + b.x = a.root
),
{name}_ranked AS (SELECT f, x, y, dense_rank() OVER (PARTITION BY f ORDER BY above) AS label FROM {name}_joined),
{name} AS (SELECT s.f, s.x, s.y, s.v, CAST(coalesce(r.label, 0) AS INTEGER) AS label FROM {source} s LEFT JOIN {name}_ranked r USING (f, x, y))"""


def maxima(source: str, column: str, threshold: str, connectivity: int = 8, ties: str = "first") -> str:
    """SELECT of the maxima of a table expression."""
    near = "abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1" if connectivity == 8 else "abs(b.x - a.x) + abs(b.y - a.y) <= 1"
    order = {"first": "(b.y * 10000 + b.x < a.y * 10000 + a.x)", "last": "(b.x * 10000 + b.y > a.x * 10000 + a.y)", "all": "FALSE"}[ties]
    return f"""SELECT a.f, a.x, a.y, a.{column} AS v FROM {source} a
WHERE a.{column} {threshold} AND NOT EXISTS (
  SELECT 1 FROM {source} b WHERE b.f = a.f AND {near} AND (b.x <> a.x OR b.y <> a.y)
  AND (b.{column} > a.{column} OR (b.{column} = a.{column} AND {order}))
)"""


def shortest(name: str, cells: str, source: str, limit: float, connectivity: int = 4) -> str:
    """Least path costs (f, x, y, d) from the cells that meet `source`, over cells with mask; cells: f, x, y, cost, mask and what `source` names. Needs WITH RECURSIVE."""
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if connectivity == 8 else [])
    listed = ", ".join(f"({dx}, {dy}, {0.1 * (2**0.5 if dx and dy else 1.0)!r}e0)" for dx, dy in steps)
    return f"""{name}(f, x, y, d) USING KEY (f, x, y) AS (
  SELECT f, x, y, 0e0 AS d FROM {cells} WHERE {source}
  UNION
  SELECT n.f, n.x, n.y, n.d FROM (
    SELECT b.f, b.x, b.y, min(r.d + a.cost + k.length) AS d FROM {name} r JOIN {cells} a ON a.f = r.f AND a.x = r.x AND a.y = r.y, (VALUES {listed}) k(dx, dy, length), {cells} b
    WHERE b.f = r.f AND b.x = r.x + k.dx AND b.y = r.y + k.dy AND b.mask AND NOT ({source.replace("label", "b.label").replace("inc", "b.inc")}) GROUP BY b.f, b.x, b.y
  ) n LEFT JOIN recurring.{name} o ON o.f = n.f AND o.x = n.x AND o.y = n.y WHERE n.d < {limit!r}e0 AND (o.d IS NULL OR n.d < o.d)
)"""


def solve(name: str, source: str, basis: list[tuple[int, int, int]], keys: str, carry: str, least: float | None = None) -> str:
    """Table expressions ending in `name` (keys, carried columns, q0..q5): symmetric systems of the moments m_ij and r_ij, scaled to a unit diagonal and eliminated in order.

    least: systems with a pivot up to that are left out as singular.
    """
    n = len(basis)
    a = {(p, q): f"{basis[p][2] * basis[q][2]} * m{basis[p][0] + basis[q][0]}{basis[p][1] + basis[q][1]}" for p in range(n) for q in range(p, n)}
    sizes = ", ".join(f"sqrt(greatest({a[p, p]}, 0e0)) AS z{p}" for p in range(n))
    steps = [f"{name}_z AS (SELECT *, {sizes} FROM {source})"]
    unit = ", ".join([*(f"{a[p, q]} / z{p} / z{q} AS a{p}{q}" for p, q in a), *(f"{basis[p][2]} * r{basis[p][0]}{basis[p][1]} / z{p} AS b{p}" for p in range(n))])
    positive = " AND ".join(f"z{p} > 0" for p in range(n))
    kept = f"{keys}, {carry}" if carry else keys
    zs = ", ".join(f"z{p}" for p in range(n))
    steps.append(f"{name}_0 AS (SELECT {kept}, {zs}, {unit} FROM {name}_z WHERE {positive})")
    for k in range(n - 1):
        done = [f"a{p}{q}" for p in range(k + 1) for q in range(p, n)] + [f"b{p}" for p in range(k + 1)]
        new = [f"a{p}{q} - a{k}{p} * a{k}{q} / a{k}{k} AS a{p}{q}" for p in range(k + 1, n) for q in range(p, n)] + [f"b{p} - a{k}{p} * b{k} / a{k}{k} AS b{p}" for p in range(k + 1, n)]
        regular = f" WHERE a{k}{k} > {least!r}" if least is not None else ""
        steps.append(f"{name}_{k + 1} AS (SELECT {kept}, {zs}, {', '.join(done + new)} FROM {name}_{k}{regular})")
    at = f"{name}_{n - 1}"
    for k in range(n - 1, -1, -1):
        rest = "".join(f" - a{k}{q} * y{q}" for q in range(k + 1, n))
        regular = f" WHERE a{k}{k} > {least!r}" if least is not None and k == n - 1 else ""
        steps.append(f"{name}_y{k} AS (SELECT *, (b{k}{rest}) / a{k}{k} AS y{k} FROM {at}{regular})")
        at = f"{name}_y{k}"
    steps.append(f"{name} AS (SELECT {kept}, {', '.join(f'y{p} / z{p} AS q{p}' for p in range(n))} FROM {at})")
    return ", ".join(steps)


def gaussian(name: str, source: str, keep: str, cx: str, cy: str, unit: float) -> str:
    """From q0..q5 in units from (cx, cy): scale, mx, my, pxx, pxy, pyy in pixels; singular precisions are left out."""
    return f"""{name}_p AS (SELECT *, -2 * q0 AS uxx, -2 * q1 AS uxy, -2 * q2 AS uyy FROM {source}),
{name}_m AS (SELECT *, (uyy * q3 - uxy * q4) / (uxx * uyy - uxy * uxy) AS ux, (uxx * q4 - uxy * q3) / (uxx * uyy - uxy * uxy) AS uy FROM {name}_p WHERE abs(uxx * uyy - uxy * uxy) > 1e-40),
{name} AS (SELECT {keep}, q5 + (uxx * ux * ux + 2 * uxy * ux * uy + uyy * uy * uy) / 2 AS log_scale, {cx} + {unit!r}e0 * ux AS mx, {cy} + {unit!r}e0 * uy AS my, uxx / {unit**2!r}e0 AS pxx, uxy / {unit**2!r}e0 AS pxy, uyy / {unit**2!r}e0 AS pyy FROM {name}_m WHERE isfinite(ux) AND isfinite(uy))"""
