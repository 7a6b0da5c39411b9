"""DuckDB SQL for the order-dependent operators: folds over lists in the order of the sweep.

``list_reduce`` goes through the voxels (or passes, regions) in order, with a state of lists; so these
texts share nothing with the operators but the rules. Voxels have a rank ``r`` from 1 in descending order;
a set is named by its smallest rank, that is by its highest voxel.
"""

from __future__ import annotations

VALUE = "v + CAST(idx AS DOUBLE) / 100000.0"
BIG = "CAST([] AS BIGINT[])"


def ordered(threshold: float, kind: int = 26, ascending: bool = False, only: str = "true", tag: str = "") -> str:
    """o: voxels with rank r; item: one row, the list of (r, at, js) with the earlier neighbours, and of all values."""
    down = "" if ascending else " DESC"
    f, o, near, item = (n + tag for n in ("f", "o", "near", "item"))
    return f"""{f} AS (SELECT idx, x, y, z, {VALUE} AS value FROM vox WHERE {VALUE} >= {threshold} AND {only}),
{o} AS (SELECT *, row_number() OVER (ORDER BY value{down}, idx{down}) AS r FROM {f}),
{near} AS (SELECT p.r, list(q.r ORDER BY n.k) AS js FROM {o} p CROSS JOIN all{kind} n JOIN {o} q ON q.x = p.x + n.dx AND q.y = p.y + n.dy AND q.z = p.z + n.dz WHERE q.r < p.r GROUP BY p.r),
{item} AS (SELECT coalesce(list({{'r': r, 'at': value, 'js': coalesce(js, [])}} ORDER BY r), []) AS items, coalesce(list(value ORDER BY r), []) AS val FROM {o} LEFT JOIN {near} USING (r))"""


_FREQUENT = "list_transform(list_reverse_sort(list_transform(i.js, lambda j, k: {'c': len(list_filter(i.js, lambda m: s.comp[m] = s.comp[j])), 'k': -k, 'j': j})), lambda t: t.j)"
_JOINED = """{'comp': list_transform(t.comp, lambda c: CASE WHEN c = greatest(t.comp[i.r], t.comp[j]) THEN least(t.comp[i.r], t.comp[j]) ELSE c END),
  'size': list_transform(t.size, lambda z, k: CASE WHEN k = least(t.comp[i.r], t.comp[j]) THEN t.size[t.comp[i.r]] + t.size[t.comp[j]] ELSE z END)}"""


def sets(name: str, order: str, lasting: str, limit: str, least: int = 0, tag: str = "") -> str:
    """``name``: (idx, r, c), the set of every voxel after the sweep. lasting: of a top and the height at."""
    js = _FREQUENT if order == "majority" else "list_sort(i.js)"
    of = lambda c: f"({lasting.format(top=f'val[{c}]', at='i.at')} <= {limit} OR t.size[{c}] < {least})"
    return f"""{name}_s AS (SELECT list_reduce(items, lambda s, i: list_reduce({js},
  lambda t, j: CASE WHEN t.comp[i.r] <> t.comp[j] AND ({of('t.comp[i.r]')} OR {of('t.comp[j]')}) THEN {_JOINED} ELSE t END,
  {{'comp': list_append(s.comp, i.r), 'size': list_append(s.size, 1)}}), {{'comp': {BIG}, 'size': {BIG}}}) AS s FROM item{tag}),
{name} AS (SELECT idx, r, c FROM (SELECT unnest(s.comp) AS c, unnest(range(1, len(s.comp) + 1)) AS r FROM {name}_s) JOIN o{tag} USING (r))"""


def numbered(name: str) -> str:
    """Labels of all voxels: sets numbered from 1 by their first voxel, 0 elsewhere."""
    return f"SELECT vox.idx, coalesce(l.label, 0) AS label FROM vox LEFT JOIN (SELECT idx, dense_rank() OVER (ORDER BY first) AS label FROM (SELECT idx, min(idx) OVER (PARTITION BY c) AS first FROM {name})) l USING (idx)"


ABSOLUTE = "({top} - {at})"
ADAPTIVE = "CASE WHEN {top} > floor THEN ({top} - {at}) / ({top} - floor) ELSE 0 END"


def segmentation(threshold: float, order: str, limit: str, least: int = 0, lasting: str = ABSOLUTE, before: str = "", beside: str = "") -> str:
    """beside: a table of one row whose columns the limit names; before: its definition."""
    text = f"WITH {before}{ordered(threshold)}, {sets('g', order, lasting, limit, least)} {numbered('g')}"
    return text.replace("FROM item)", f"FROM item, {beside})", 1) if beside else text


def adaptive(threshold: float, limit: str, order: str = "majority", least: int = 0) -> str:
    return segmentation(threshold, order, limit, least, ADAPTIVE, beside=f"(SELECT min({VALUE}) AS floor FROM vox)")


def sweep(threshold: float, order: str, limits: list[float]) -> str:
    parts = ", ".join(sets(f"g{k}", order, ABSOLUTE, str(p)) for k, p in enumerate(limits))
    return f"WITH {ordered(threshold)}, {parts} " + " UNION ALL ".join(f"SELECT {p} AS persistence, idx, label FROM ({numbered(f'g{k}')})" for k, p in enumerate(limits))


def tree(threshold: float, split: bool = False, name: str = "te") -> str:
    """``name``: (cc, lower, higher). A set is named by the last voxel it took in; a voxel is tied to that of each set it meets."""
    hi, lo = ("lower", "higher") if split else ("higher", "lower")
    met = "list_distinct(list_transform(i.js, lambda j: s.comp[j]))"
    return f"""{ordered(threshold, tag='26')}, {sets('whole', 'value', ABSOLUTE, '1e300', tag='26')}, cc AS (SELECT idx, min(idx) OVER (PARTITION BY c) AS cc FROM whole),
{ordered(threshold, 14, split)},
{name}_s AS (SELECT list_reduce(items, lambda s, i: {{'comp': list_append(list_transform(s.comp, lambda c: CASE WHEN list_contains({met}, c) THEN i.r ELSE c END), i.r),
  'e': s.e || list_transform({met}, lambda c: {{'a': i.r, 'b': c}})}}, {{'comp': {BIG}, 'e': CAST([] AS STRUCT(a BIGINT, b BIGINT)[])}}) AS s FROM item),
{name} AS (SELECT cc, p.idx AS {lo}, q.idx AS {hi} FROM (SELECT unnest(s.e) AS e FROM {name}_s) JOIN o p ON p.r = e.a JOIN o q ON q.r = e.b JOIN cc ON cc.idx = p.idx)"""


#: ends: (idx, up, down, kind) of the tree te
POINTS = """cp AS (SELECT idx, sum(up) AS up, sum(down) AS down FROM (SELECT lower AS idx, 1 AS up, 0 AS down FROM te UNION ALL SELECT higher, 0, 1 FROM te) GROUP BY idx),
kinds AS (SELECT *, CASE WHEN up = 0 THEN 'max' WHEN down = 0 THEN 'min' WHEN up > 1 OR down > 1 THEN 'saddle' ELSE 'regular' END AS kind FROM cp)"""


def regions(threshold: float) -> str:
    """top: (m, r, value, n) of regions, ranked from the highest; pass: (p, q, h), the highest pass between two, in order."""
    return f"""RECURSIVE f AS (SELECT idx, x, y, z, {VALUE} AS value FROM vox WHERE {VALUE} >= {threshold}),
pairs AS (SELECT p.idx, p.value, q.idx AS other, q.value AS ov FROM f p CROSS JOIN all26 n JOIN f q ON q.x = p.x + n.dx AND q.y = p.y + n.dy AND q.z = p.z + n.dz),
up AS (SELECT f.idx, coalesce(CASE WHEN max(ov) > any_value(f.value) THEN max_by(other, ov) END, f.idx) AS t FROM f LEFT JOIN pairs USING (idx) GROUP BY f.idx),
way(idx, t) AS (SELECT idx, t FROM up UNION ALL SELECT way.idx, up.t FROM way JOIN up ON up.idx = way.t WHERE up.t <> way.t),
own AS (SELECT way.idx, way.t AS m FROM way JOIN up ON up.idx = way.t WHERE up.t = way.t),
top AS (SELECT m, row_number() OVER (ORDER BY max(value) DESC) AS r, max(value) AS value, count(*) AS n FROM own JOIN f USING (idx) GROUP BY m),
pass AS (SELECT p.r AS p, q.r AS q, max({{'h': least(pairs.value, ov), 'g': greatest(pairs.value, ov)}}) AS h FROM pairs JOIN own a ON a.idx = pairs.idx JOIN own b ON b.idx = pairs.other JOIN top p ON p.m = a.m JOIN top q ON q.m = b.m WHERE p.r < q.r GROUP BY ALL),
item AS (SELECT (SELECT coalesce(list({{'p': p, 'q': q, 'h': h.h}} ORDER BY h DESC), []) FROM pass) AS items, (SELECT coalesce(list(n ORDER BY r), []) FROM top) AS n, (SELECT coalesce(list(value ORDER BY r), []) FROM top) AS val)"""


_MEET = "least(s.comp[i.p], s.comp[i.q])", "greatest(s.comp[i.p], s.comp[i.q])"


def merged(test: str, row: str = "{'p': 0.0}", kind: str = "STRUCT(p DOUBLE)[]") -> str:
    """done: sets of regions after all passes where the test (of sets a, b) holds, with a row for each merge."""
    a, b = _MEET
    put = lambda x: x.replace("$a", a).replace("$b", b)
    return f"""done AS (SELECT val, list_reduce(items, lambda s, i: CASE WHEN {a} <> {b} AND ({put(test)}) THEN {{
  'comp': list_transform(s.comp, lambda c: CASE WHEN c = {b} THEN {a} ELSE c END), 'size': list_transform(s.size, lambda z, k: CASE WHEN k = {a} THEN z + s.size[{b}] ELSE z END),
  'out': list_append(s.out, {put(row)})}} ELSE s END, {{'comp': CAST(range(1, len(n) + 1) AS BIGINT[]), 'size': n, 'out': CAST([] AS {kind})}}) AS s FROM item)"""


def region_merges(threshold: float, name: str = "rm") -> str:
    row = "{'p': val[$b] - i.h, 'n': s.size[$b], 't': val[$b], 'h': i.h}"
    return f"""{regions(threshold)}, {merged('true', row, 'STRUCT(p DOUBLE, n BIGINT, t DOUBLE, h DOUBLE)[]')},
{name} AS (SELECT o.p AS persistence, o.n AS size, o.t AS top, o.h AS saddle FROM (SELECT unnest(s.out) AS o FROM done)
  UNION ALL SELECT NULL, s.size[c], val[c], NULL FROM (SELECT *, unnest(list_distinct(s.comp)) AS c FROM done))"""


def fast(threshold: float, limit: str, least: int = 0) -> str:
    of = lambda c: f"val[{c}] - i.h <= {limit} OR s.size[{c}] < {least}"
    return f"""WITH {regions(threshold)}, {merged(f"{of('$a')} OR {of('$b')}")},
g AS (SELECT own.idx, c FROM own JOIN top USING (m) JOIN (SELECT unnest(s.comp) AS c, unnest(range(1, len(s.comp) + 1)) AS r FROM done) USING (r)) {numbered('g')}"""


def events(threshold: float, least: int, name: str = "ev") -> str:
    """``name``: (persistence) of the sweep that merges all regions, null for the last of a component.

    Sets beside a voxel are structs (n, v, c), by size the first is the largest; those too small go, of the others all but the highest last a while.
    """
    beside = f"list_distinct(list_transform({_FREQUENT}, lambda j: s.comp[j]))"
    first = f"s.comp[{_FREQUENT}[1]]"
    meet = f"list_sort(list_transform({beside}, lambda c: {{'n': s.size[c] + CASE WHEN c = {first} THEN 1 ELSE 0 END, 'v': val[c], 'c': c}}))"
    join = """{'comp': list_append(list_transform(s.comp, lambda c: CASE WHEN list_contains(list_transform(i.js, lambda j: s.comp[j]), c) THEN list_min(list_transform(i.js, lambda j: s.comp[j])) ELSE c END), coalesce(list_min(list_transform(i.js, lambda j: s.comp[j])), i.r)),
  'size': list_append(list_transform(s.size, lambda z, k: CASE WHEN k = list_min(list_transform(i.js, lambda j: s.comp[j])) THEN CAST(1 + list_sum(list_transform(list_distinct(list_transform(i.js, lambda j: s.comp[j])), lambda c: s.size[c])) AS BIGINT) ELSE z END), 1)"""
    return f"""{name}_s AS (SELECT list_reduce(items, lambda s, i: {join}, 'met': list_append(s.met, {{'at': i.at, 'm': {meet}}})}},
  {{'comp': {BIG}, 'size': {BIG}, 'met': CAST([] AS STRUCT("at" DOUBLE, m STRUCT(n BIGINT, v DOUBLE, c BIGINT)[])[])}}) AS s FROM item),
{name}_m AS (SELECT e, m.at AS height, unnest(m.m) AS b, unnest(range(1, len(m.m) + 1)) AS k, len(m.m) AS n FROM (SELECT unnest(s.met) AS m, unnest(range(len(s.met))) AS e FROM {name}_s)),
{name}_k AS (SELECT *, k < n AND b.n < {least} AS small, row_number() OVER (PARTITION BY e ORDER BY b.v) AS place FROM {name}_m),
{name}_p AS (SELECT *, count(*) FILTER (small) OVER (PARTITION BY e) + count(*) FILTER (NOT small) OVER (PARTITION BY e ORDER BY place) AS merged FROM {name}_k),
{name} AS (SELECT b.v - height AS persistence FROM {name}_p WHERE NOT small AND place < n AND merged < n
  UNION ALL SELECT NULL FROM (SELECT unnest(list_distinct(s.comp)) FROM {name}_s))"""


def curve(name: str, highest: float, samples: int, compare: str) -> str:
    return f"SELECT persistence, (SELECT count(*) FROM {name} m WHERE m.persistence IS NULL OR m.persistence {compare} s.persistence) AS segments FROM (SELECT i * ({highest} / {samples - 1}.0) AS persistence FROM range({samples}) r(i)) s"


def split_standard(label: int, limit: float) -> str:
    return f"WITH {ordered(-1e300, only=f'a = {label}')}, {sets('g', 'majority', ABSOLUTE, str(limit))}, k AS (SELECT idx, dense_rank() OVER (ORDER BY first) - 1 AS part FROM (SELECT idx, min(r) OVER (PARTITION BY c) AS first FROM g)) SELECT idx, CASE WHEN part = 0 THEN {label} ELSE (SELECT max(a) FROM vox) + part END AS label FROM k"


def split_two(label: int) -> str:
    """Replays with the veto'th merge (beyond a voxel's first neighbour) left out, one row each; the most even one wins."""
    held = "t.a > 0 AND least(t.comp[i.r], t.comp[j.j]) = least(t.comp[t.a], t.comp[t.b]) AND greatest(t.comp[i.r], t.comp[j.j]) = greatest(t.comp[t.a], t.comp[t.b])"
    join = "list_transform(t.comp, lambda c: CASE WHEN c = greatest(t.comp[i.r], t.comp[j.j]) THEN least(t.comp[i.r], t.comp[j.j]) ELSE c END)"
    js = _FREQUENT.replace("lambda t: t.j)", "lambda t, k: {'j': t.j, 'k': k})")
    return f"""WITH {ordered(-1e300, only=f'a = {label}')},
g AS (SELECT veto, list_reduce(items, lambda s, i: list_reduce({js},
  lambda t, j: CASE WHEN t.comp[i.r] = t.comp[j.j] THEN t
    WHEN {held} THEN {{'comp': t.comp, 'seen': t.seen + CASE WHEN j.k > 1 THEN 1 ELSE 0 END, 'a': t.a, 'b': t.b}}
    WHEN t.a = 0 AND j.k > 1 AND t.seen + 1 = veto THEN {{'comp': t.comp, 'seen': t.seen + 1, 'a': i.r, 'b': j.j}}
    ELSE {{'comp': {join}, 'seen': t.seen + CASE WHEN j.k > 1 THEN 1 ELSE 0 END, 'a': t.a, 'b': t.b}} END,
  {{'comp': list_append(s.comp, i.r), 'seen': s.seen, 'a': s.a, 'b': s.b}}), {{'comp': {BIG}, 'seen': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT}}) AS s
  FROM item CROSS JOIN range(1, 400) v(veto)),
best AS (SELECT s FROM g WHERE s.a > 0 ORDER BY abs(len(list_filter(s.comp, lambda c: c = s.comp[s.a])) - len(list_filter(s.comp, lambda c: c = s.comp[s.b]))), veto LIMIT 1)
SELECT idx, CASE WHEN coalesce(s.comp[r] = s.comp[1], true) THEN {label} ELSE (SELECT max(a) FROM vox) + 1 END AS label FROM o LEFT JOIN best ON true"""


#: cur: the label that each region's voxels have by now, in order of label; near: of x, labels beside it
_NEAR = "list_distinct(list_transform(list_filter(es, lambda e: cur[list_position(ls, e.a)] = x AND cur[list_position(ls, e.b)] NOT IN (x, 0)), lambda e: cur[list_position(ls, e.b)]))"
MELD_CRITICAL = f"""WITH item AS (SELECT (SELECT list(label ORDER BY label) FROM small) AS xs, (SELECT list(label ORDER BY label) FROM stats) AS ls, (SELECT list(n ORDER BY label) FROM stats) AS ns, (SELECT list({{'a': label, 'b': other}}) FROM ends) AS es),
done AS (SELECT xs, ls, list_reduce(xs, lambda cur, x: list_transform(cur, lambda c: CASE WHEN c = x THEN coalesce(list_reverse_sort(list_transform({_NEAR}, lambda y: {{'n': list_sum(list_transform(cur, lambda c2, k: CASE WHEN c2 = y THEN ns[k] ELSE 0 END)), 'y': -y}}))[1].y * -1, 0) ELSE c END), ls) AS cur FROM item)
SELECT x AS label, cur[list_position(ls, x)] AS target FROM (SELECT *, unnest(xs) AS x FROM done)"""

COLORS = """WITH item AS (SELECT (SELECT list({'x': label, 'near': near} ORDER BY label) FROM (SELECT s.label, coalesce(list(e.other) FILTER (e.other < s.label), []) AS near FROM stats s LEFT JOIN ends e ON e.label = s.label GROUP BY s.label)) AS items, (SELECT list(label ORDER BY label) FROM stats) AS ls),
done AS (SELECT ls, list_reduce(items, lambda c, i: list_append(c, list_min(list_filter(range(len(i.near) + 1), lambda k: NOT list_contains(list_transform(i.near, lambda y: c[list_position(ls, y)]), k)))), CAST([] AS BIGINT[])) AS c FROM item)
SELECT unnest(ls) AS label, unnest(c) AS color FROM done"""

_RGB = "[(({0}) // 25) / 4.0, ((({0}) // 5) % 5) / 4.0, (({0}) % 5) / 4.0]"
_FAR = lambda p, q: f"list_sum(list_transform(list_zip({_RGB.format(p)}, {_RGB.format(q)}), lambda d: (d[1] - d[2]) * (d[1] - d[2]))) >= 0.25"


def improved_colors(start: str) -> str:
    """Colours as numbers of the palette; start: of a label."""
    at = lambda x: f"c[list_position(ls, {x})]"
    free = f"list_filter(range(125), lambda k: len(list_filter(i.near, lambda y: NOT ({_FAR('k', at('y'))}))) = 0)"
    return f"""WITH item AS (SELECT (SELECT list({{'a': src, 'b': dst, 'near': near}} ORDER BY src, dst) FROM edges JOIN (SELECT label, list(other) AS near FROM ends GROUP BY label) ON label = dst) AS items, (SELECT list(label ORDER BY label) FROM stats) AS ls, (SELECT list(CAST({start} AS BIGINT) ORDER BY label) FROM stats) AS c0),
done AS (SELECT ls, list_reduce(items, lambda c, i: CASE WHEN {_FAR(at('i.a'), at('i.b'))} THEN c ELSE list_transform(c, lambda own, k: CASE WHEN ls[k] = i.b THEN coalesce(list_min({free}), own) ELSE own END) END, c0) AS c FROM item)
SELECT label, (k // 25) / 4.0 AS r, ((k // 5) % 5) / 4.0 AS g, (k % 5) / 4.0 AS b FROM (SELECT unnest(ls) AS label, unnest(c) AS k FROM done)"""


def search(side: int) -> str:
    """Breadth-first, level by level: a level's cells in order, found from the earliest of the level before, in the order of steps."""
    n, slice_ = side**3, side * side
    return f"""WITH RECURSIVE steps(k, s) AS (VALUES (0, 1), (1, -1), (2, {side}), (3, -{side}), (4, {slice_}), (5, -{slice_})),
fore AS (SELECT idx, a FROM vox WHERE a > 0),
seed AS (SELECT landmark_id, CAST((floor((z + 1.0) / 2.0) * {side} + floor((y + 0.75) / 1.5)) * {side} + floor(x + 0.5) AS BIGINT) AS i FROM marks),
bfs(landmark_id, i, lvl, ord, now, hit) AS (
  SELECT landmark_id, i, 0, CAST(1 AS BIGINT), true, i IN (SELECT idx FROM fore) FROM seed WHERE i BETWEEN 0 AND {n - 1}
  UNION ALL (
  WITH live AS (SELECT * FROM bfs WHERE landmark_id NOT IN (SELECT landmark_id FROM bfs WHERE hit)),
  further AS (SELECT l.landmark_id, l.i + s AS i, any_value(l.lvl) + 1 AS lvl, min({{'ord': l.ord, 'k': k}}) AS place FROM live l CROSS JOIN steps WHERE l.now AND l.i + s BETWEEN 0 AND {n - 1} AND NOT EXISTS (SELECT 1 FROM live o WHERE o.landmark_id = l.landmark_id AND o.i = l.i + s) GROUP BY l.landmark_id, l.i + s)
  SELECT landmark_id, i, lvl, row_number() OVER (PARTITION BY landmark_id ORDER BY place), true, i IN (SELECT idx FROM fore) FROM further
  UNION ALL SELECT landmark_id, i, lvl, ord, false, false FROM live WHERE now AND landmark_id IN (SELECT landmark_id FROM further))),
best AS (SELECT landmark_id, min({{'lvl': lvl, 'ord': ord, 'i': i}}) AS b FROM bfs WHERE now AND hit GROUP BY landmark_id)
SELECT m.landmark_id, coalesce(a, 0) AS label FROM marks m LEFT JOIN best USING (landmark_id) LEFT JOIN fore ON fore.idx = b.i"""


def rays(side: int, at: str, directions: str, key: str) -> str:
    """hit: (key, ray, d, cx, cy, cz), null where the grid ends first. at: CTE pt(key, sx, sy, sz) in voxels; directions: CTE dir(ray, ux, uy, uz)."""
    major = "CASE WHEN abs(ux) >= abs(uy) AND abs(ux) >= abs(uz) THEN 0 WHEN abs(uy) >= abs(uz) THEN 1 ELSE 2 END"
    first = lambda c, m: f"CASE WHEN major = {m} THEN base ELSE s{c} + t{c} * ((base - own) * sign(lead)) END AS f{c}"
    cell = ", ".join(f"floor(f{c} + (k + 1) * t{c} + 0.5) AS c{c}" for c in "xyz")
    gone = f"cx < 0 OR cy < 0 OR cz < 0 OR cx >= {side} OR cy >= {side} OR cz >= {side}"
    return f"""RECURSIVE {at}, {directions},
d1 AS (SELECT *, {major} AS major FROM dir), d2 AS (SELECT *, CASE major WHEN 0 THEN ux WHEN 1 THEN uy ELSE uz END AS lead FROM d1),
d3 AS (SELECT ray, major, lead, ux / abs(lead) AS tx, uy / abs(lead) AS ty, uz / abs(lead) AS tz FROM d2 WHERE lead <> 0),
r1 AS (SELECT *, CASE major WHEN 0 THEN sx WHEN 1 THEN sy ELSE sz END AS own, floor(own) AS base FROM pt CROSS JOIN d3),
ways({key}, ray, tx, ty, tz, fx, fy, fz, k, cx, cy, cz, state) AS (
  SELECT {key}, ray, tx, ty, tz, {first('x', 0)}, {first('y', 1)}, {first('z', 2)}, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 'on' FROM r1
  UNION ALL
  SELECT n.{key}, ray, tx, ty, tz, fx, fy, fz, n.k, cx, cy, cz, CASE WHEN {gone} THEN 'gone' WHEN a = 0 THEN 'end' ELSE 'on' END
  FROM (SELECT {key}, ray, tx, ty, tz, fx, fy, fz, k + 1 AS k, {cell} FROM ways WHERE state = 'on') n
  LEFT JOIN (SELECT idx AS place, a FROM vox) v ON place = CASE WHEN {gone} THEN -1 ELSE CAST((cz * {side} + cy) * {side} + cx AS BIGINT) END),
hit AS (SELECT {key}, ray, CASE WHEN state = 'end' THEN sqrt((cx - fx) * (cx - fx) + (cy - fy) * (cy - fy) + (cz - fz) * (cz - fz)) END AS d,
  CASE WHEN state = 'end' THEN cx END AS cx, CASE WHEN state = 'end' THEN cy END AS cy, CASE WHEN state = 'end' THEN cz END AS cz FROM ways WHERE state <> 'on')"""


def in_plane(side: int, how: str, turns: int = 361) -> str:
    """Distances across the normal (0, 0.6, 0.8)."""
    pt = "pt AS (SELECT idx, x * 1e0 AS sx, y * 15e-1 AS sy, z * 2e0 AS sz FROM vox WHERE a > 0)"
    n, full = (turns - 1, 1) if how == "two" else (turns, 2)
    angle = f"turn AS (SELECT i AS turn, {full} * pi() * i / {turns - 1} AS angle FROM range({n}) r(i))"
    every = f"SELECT turn AS ray, angle FROM turn UNION ALL SELECT turn + {n}, angle + pi() FROM turn" if how == "two" else "SELECT turn AS ray, angle FROM turn"
    u = "(SELECT 0e0 AS x, -8e-1 / sqrt(8e-1 * 8e-1 + 6e-1 * 6e-1) AS y, 6e-1 / sqrt(8e-1 * 8e-1 + 6e-1 * 6e-1) AS z, sqrt(6e-1 * 6e-1 + 8e-1 * 8e-1) AS size)"
    w = f"(SELECT *, 6e-1 / size * z - 8e-1 / size * y AS wx, 8e-1 / size * x - 0e0 / size * z AS wy, 0e0 / size * y - 6e-1 / size * x AS wz FROM {u}) u"
    dirs = f"{angle}, dir AS (SELECT ray, cos(angle) * u.x + sin(angle) * wx AS ux, cos(angle) * u.y + sin(angle) * wy AS uy, cos(angle) * u.z + sin(angle) * wz AS uz FROM ({every}) CROSS JOIN {w})"
    if how == "two":
        last = f"SELECT p.idx, min(coalesce(p.d, 100000) + coalesce(q.d, 100000)) AS distance FROM hit p JOIN hit q ON q.idx = p.idx AND q.ray = p.ray + {n} GROUP BY p.idx"
    elif how == "one":
        last = "SELECT idx, min(coalesce(d, 100000)) AS distance FROM hit GROUP BY idx"
    else:
        last = "SELECT idx, coalesce(avg(d), 0) AS distance FROM hit GROUP BY idx"
    return f"WITH {rays(side, pt, dirs, 'idx')} {last}"


def landmark_rays(side: int, directions) -> str:
    pt = "pt AS (SELECT landmark_id, CAST(x AS DOUBLE) AS sx, CAST(y AS DOUBLE) AS sy, CAST(z AS DOUBLE) AS sz FROM marks)"
    dirs = f"dir(ray, ux, uy, uz) AS (VALUES {', '.join(f'({k}, {x:.17e}, {y:.17e}, {z:.17e})' for k, (x, y, z) in enumerate(directions.tolist()))})"
    return f"WITH {rays(side, pt, dirs, 'landmark_id')} SELECT landmark_id, ray, coalesce(cx, 0) AS x, coalesce(cy, 0) AS y, coalesce(cz, 0) AS z FROM hit"
