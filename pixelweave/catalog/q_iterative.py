"""Morphology, components, instances and prompt seeding."""

from pyspark.sql import functions as F

from ..operators import components as cp, distance as ds, instances as ins, prompts as pr, stencil as st
from ..operators.stats import exact_quantiles, with_group_stats
from ..session import cut_lineage
from . import fixtures as fx
from .registry import query, r6

_KEY = ["scene_id", "y", "x"]
_TILE = 32          # small tiles, so that scenes have seams
_BASE = fx.with_(fx.PX, fx.SCENES, fx.dense_sql())
_SQUARE1, _SQUARE2 = "abs(dy) <= 1 AND abs(dx) <= 1", "abs(dy) <= 2 AND abs(dx) <= 2"
_CROSS1, _DISK2, _DISK1 = "abs(dy) + abs(dx) <= 1", "dy * dy + dx * dx <= 4", "dy * dy + dx * dx <= 1"


def _offsets(name: str, rule: str) -> str:
    return f"{name} AS (SELECT dy, dx FROM (SELECT dy, unnest(range(-3, 4)) AS dx FROM (SELECT unnest(range(-3, 4)) AS dy)) WHERE {rule})"


def _dilate(src: str, out: str, rule: str) -> str:
    return (_offsets(f"{out}_o", rule) + f""",
{out} AS (SELECT DISTINCT s.scene_id, s.y + dy AS y, s.x + dx AS x FROM {src} s JOIN {out}_o ON true JOIN scenes c ON c.scene_id = s.scene_id
  WHERE s.y + dy BETWEEN 0 AND height - 1 AND s.x + dx BETWEEN 0 AND width - 1)""")


def _erode(src: str, out: str, rule: str, outside: str = "background") -> str:
    need = f"(SELECT count(*) FROM {out}_o)" if outside == "background" else \
        f"(SELECT count(*) FROM {out}_o WHERE g.y + dy BETWEEN 0 AND height - 1 AND g.x + dx BETWEEN 0 AND width - 1)"
    return (_offsets(f"{out}_o", rule) + f""",
{out}_h AS (SELECT s.scene_id, s.y - dy AS y, s.x - dx AS x, count(*) AS n FROM {src} s JOIN {out}_o ON true GROUP BY ALL),
{out} AS (SELECT g.scene_id, g.y, g.x FROM {out}_h g JOIN scenes c ON c.scene_id = g.scene_id
  WHERE g.y BETWEEN 0 AND height - 1 AND g.x BETWEEN 0 AND width - 1 AND g.n = {need})""")


def _pixels_of(name: str) -> str:
    return f"SELECT scene_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM {name}"


def _parts(src: str, out: str, near: str) -> str:
    """Components by reachability: label is 1 + least row-major index. CTEs
    that follow may use {out}(scene_id, y, x, label)."""
    return f"""{out}_v AS MATERIALIZED (SELECT {src}.scene_id, {src}.y, {src}.x, CAST({src}.y AS BIGINT) * width + {src}.x + 1 AS id FROM {src} JOIN scenes USING (scene_id)),
{out}_n AS MATERIALIZED (SELECT a.scene_id, a.id AS a, b.id AS b FROM {out}_v a JOIN (SELECT dy, unnest([-1, 0, 1]) AS dx FROM (SELECT unnest([-1, 0, 1]) AS dy)) o ON {near} AND NOT (dy = 0 AND dx = 0)
  JOIN {out}_v b ON b.scene_id = a.scene_id AND b.y = a.y + dy AND b.x = a.x + dx),
{out}_l(scene_id, id, label) AS (SELECT scene_id, id, id FROM {out}_v
  UNION SELECT r.scene_id, n.b, r.label FROM {out}_l r JOIN {out}_n n ON n.scene_id = r.scene_id AND n.a = r.id WHERE r.label < n.b),
{out} AS MATERIALIZED (SELECT v.scene_id, v.y, v.x, min(l.label) AS label FROM {out}_v v JOIN {out}_l l ON l.scene_id = v.scene_id AND l.id = v.id GROUP BY ALL)"""


_N4, _N8 = "abs(dy) + abs(dx) = 1", "true"


def _mask(spark, sf):
    return fx.dense_mask(spark, sf), fx.scenes(spark, sf)


def _scenes(spark, sf):
    """The scenes as a table: chains of operators read them at every step, and
    each reading would count all pixels again."""
    return cut_lineage(fx.scenes(spark, sf))


@query("dilate", fx.with_(fx.PX, fx.SCENES, fx.SPARSE, _dilate("m", "d1", _SQUARE1), _dilate("d1", "d2", _SQUARE1)) + _pixels_of("d2"))
def _(spark, sf):
    return st.dilate(fx.sparse_mask(spark, sf), fx.scenes(spark, sf), iterations=2, tile=_TILE)


@query("erode", _BASE.rstrip() + ",\n" + _erode("m", "e1", _CROSS1) + "\n" + _pixels_of("e1"))
def _(spark, sf):
    return st.erode(*_mask(spark, sf), "cross", tile=_TILE)


@query("opening", fx.with_(fx.PX, fx.SCENES, fx.dense_sql(), _erode("m", "e1", _SQUARE1), _dilate("e1", "d1", _SQUARE1)) + _pixels_of("d1"))
def _(spark, sf):
    return st.opening(*_mask(spark, sf), tile=_TILE)


@query("closing", fx.with_(fx.PX, fx.SCENES, fx.SPARSE, _dilate("m", "d1", _SQUARE2), _erode("d1", "e1", _SQUARE2)) + _pixels_of("e1"))
def _(spark, sf):
    return st.closing(fx.sparse_mask(spark, sf), fx.scenes(spark, sf), "square", 2, tile=_TILE)


@query("closing_disk", fx.with_(fx.PX, fx.SCENES, fx.SPARSE, _dilate("m", "d1", _DISK2), _erode("d1", "e1", _DISK2, "foreground")) + _pixels_of("e1"))
def _(spark, sf):
    return st.closing(fx.sparse_mask(spark, sf), fx.scenes(spark, sf), "disk", 2, outside="foreground", tile=_TILE)


@query("connected_components", fx.with_(fx.PX, fx.SCENES, fx.SPARSE, _parts("m", "c", _N8), recursive=True) + "SELECT scene_id, y, x, label FROM c")
def _(spark, sf):
    return cp.connected_components(fx.sparse_mask(spark, sf), fx.scenes(spark, sf), 8, _TILE)


@query("connected_components_4", fx.with_(fx.PX1, fx.SCENES, fx.SPARSE, _parts("m", "c", _N4), recursive=True) + "SELECT scene_id, y, x, label FROM c")
def _(spark, sf):
    """One scene of all rows."""
    return cp.connected_components(fx.sparse_mask(spark, sf, multi=False), fx.scenes(spark, sf, multi=False), 4, _TILE)


_HOLES = """b AS (SELECT px.scene_id, px.y, px.x FROM px ANTI JOIN {m} ON {m}.scene_id = px.scene_id AND {m}.y = px.y AND {m}.x = px.x),
bn AS MATERIALIZED (SELECT a.scene_id, a.y, a.x, n.y AS ny, n.x AS nx FROM b a JOIN (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) t(dy, dx)) o ON true
  JOIN b n ON n.scene_id = a.scene_id AND n.y = a.y + dy AND n.x = a.x + dx),
op(scene_id, y, x) AS (SELECT b.scene_id, b.y, b.x FROM b JOIN scenes USING (scene_id) WHERE b.y = 0 OR b.x = 0 OR b.y = height - 1 OR b.x = width - 1
  UNION SELECT bn.scene_id, bn.ny, bn.nx FROM op JOIN bn ON bn.scene_id = op.scene_id AND bn.y = op.y AND bn.x = op.x),
{out} AS (SELECT px.scene_id, px.y, px.x FROM px ANTI JOIN op ON op.scene_id = px.scene_id AND op.y = px.y AND op.x = px.x)"""


@query("fill_holes", fx.with_(fx.PX, fx.SCENES, fx.dense_sql(), _HOLES.format(m="m", out="f"), recursive=True) + _pixels_of("f"))
def _(spark, sf):
    return cp.fill_holes(*_mask(spark, sf), _TILE)


_TREE = [_dilate("m", "s1", _DISK2), _erode("s1", "s2", _DISK2, "foreground"), _erode("s2", "s3", _DISK1, "foreground"),
         _dilate("s3", "s4", _DISK1)]


@query("clean_tree_mask", fx.with_(
    fx.PX, fx.SCENES, fx.SPARSE.replace("0.75", "0.88"), *_TREE, _parts("s4", "p4", _N4),
    "k4 AS MATERIALIZED (SELECT scene_id, y, x FROM p4 WHERE (scene_id, label) IN (SELECT (scene_id, label) FROM p4 GROUP BY ALL HAVING count(*) >= 12))",
    _parts("k4", "p8", _N8), recursive=True) + """SELECT scene_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM p8 JOIN
  (SELECT scene_id, label FROM p8 GROUP BY ALL HAVING count(*) <= 60) USING (scene_id, label)""")
def _(spark, sf):
    return cp.clean_tree_mask(_seeds(spark, sf), _scenes(spark, sf), 12, 60, _TILE)


def _seeds(spark, sf):
    px = fx.pixels(spark, sf).select(*_KEY, "b1")
    q = exact_quantiles(px, ["scene_id"], ["b1"], [0.88])
    return with_group_stats(px, q, ["scene_id"]).where(F.col("b1") > F.col("b1_q0")).select(*_KEY)


@query("clean_field_mask", fx.with_(
    fx.PX, fx.SCENES, fx.dense_sql(0.7), _erode("m", "s1", _SQUARE1), _dilate("s1", "s2", _SQUARE1), _dilate("s2", "s3", _SQUARE2),
    _erode("s3", "s4", _SQUARE2), _HOLES.format(m="s4", out="f"), _parts("f", "p4", _N4), recursive=True) + """SELECT scene_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM p4 JOIN
  (SELECT scene_id, label FROM p4 GROUP BY ALL HAVING count(*) >= 15) USING (scene_id, label)""")
def _(spark, sf):
    return cp.clean_field_mask(fx.dense_mask(spark, sf, 70.0), _scenes(spark, sf), 15, _TILE)


@query("distance_transform", fx.with_(fx.PX, fx.dense_sql(0.9), """b AS (SELECT px.scene_id, px.y, px.x FROM px ANTI JOIN m ON m.scene_id = px.scene_id AND m.y = px.y AND m.x = px.x)""") +
       """SELECT m.scene_id, m.y, m.x, CAST(min((m.y - b.y) * (m.y - b.y) + (m.x - b.x) * (m.x - b.x)) AS BIGINT) AS d2,
  round(sqrt(min((m.y - b.y) * (m.y - b.y) + (m.x - b.x) * (m.x - b.x))), 6) AS distance FROM m JOIN b ON b.scene_id = m.scene_id GROUP BY ALL""")
def _(spark, sf):
    d = ds.distance_transform(fx.dense_mask(spark, sf, 90.0), fx.scenes(spark, sf))
    return d.select(*_KEY, "d2", r6("distance"))


_PEAKS = """cd AS MATERIALIZED (SELECT v.scene_id, v.y, v.x, row_number() OVER (PARTITION BY v.scene_id ORDER BY v.v DESC, v.y, v.x) AS r FROM v JOIN scenes USING (scene_id)
  WHERE v.y >= 3 AND v.y < height - 3 AND v.x >= 3 AND v.x < width - 3 AND v.v > 0
  AND NOT EXISTS (SELECT 1 FROM v n WHERE n.scene_id = v.scene_id AND n.y BETWEEN v.y - 3 AND v.y + 3 AND n.x BETWEEN v.x - 3 AND v.x + 3 AND n.v > v.v)),
gr(scene_id, r, kept) AS (SELECT DISTINCT scene_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(y INT, x INT)[]) FROM cd
  UNION ALL SELECT g.scene_id, c.r, CASE WHEN len(list_filter(kept, lambda k: abs(k.y - c.y) <= 3 AND abs(k.x - c.x) <= 3)) > 0 THEN kept ELSE list_append(kept, {'y': c.y, 'x': c.x}) END
  FROM gr g JOIN cd c ON c.scene_id = g.scene_id AND c.r = g.r + 1),
pk AS (SELECT scene_id, unnest(max_by(kept, r)) AS k FROM gr GROUP BY scene_id)"""


@query("local_peaks", fx.with_(fx.PX, fx.SCENES, "v AS MATERIALIZED (SELECT scene_id, y, x, CAST(b2 AS BIGINT) // 30 / 2 AS v FROM px)", _PEAKS, recursive=True) +
       "SELECT scene_id, k.y AS y, k.x AS x FROM pk")
def _(spark, sf):
    """Values in halves, with plateaus; the SQL keeps candidates greedily."""
    v = fx.pixels(spark, sf).select(*_KEY, (F.floor(F.col("b2") / 30) / 2).alias("d2"))
    return st.local_peaks(v, fx.scenes(spark, sf), 3, tile=_TILE)


_SPLIT = [fx.SPARSE.replace("0.75", "0.88"), *_TREE, _parts("s4", "p4", _N4),
          "k4 AS MATERIALIZED (SELECT scene_id, y, x FROM p4 WHERE (scene_id, label) IN (SELECT (scene_id, label) FROM p4 GROUP BY ALL HAVING count(*) >= 12))",
          "bg AS (SELECT px.scene_id, px.y, px.x FROM px ANTI JOIN k4 ON k4.scene_id = px.scene_id AND k4.y = px.y AND k4.x = px.x)",
          "v AS MATERIALIZED (SELECT k4.scene_id, k4.y, k4.x, min((k4.y - bg.y) * (k4.y - bg.y) + (k4.x - bg.x) * (k4.x - bg.x)) AS v FROM k4 JOIN bg ON bg.scene_id = k4.scene_id GROUP BY ALL)",
          _PEAKS, _parts("k4", "p5", _N4)]


@query("split_instances", fx.with_(fx.PX, fx.SCENES, *_SPLIT, recursive=True) + """SELECT p5.scene_id, count(*) AS pixels, any_value(n) AS instances FROM p5
  JOIN (SELECT scene_id, count(*) AS n FROM pk GROUP BY scene_id) USING (scene_id)
  WHERE (p5.scene_id, label) IN (SELECT (q.scene_id, q.label) FROM p5 q JOIN pk ON pk.scene_id = q.scene_id AND pk.k.y = q.y AND pk.k.x = q.x) GROUP BY p5.scene_id""")
def _(spark, sf):
    """Touching blobs: the closed and opened mask. One instance per peak of the
    distance, over all parts that hold a peak."""
    sc = _scenes(spark, sf)
    mask = cp.clean_tree_mask(_seeds(spark, sf), sc, 12, 10000, _TILE)
    return ins.split_instances(mask, sc, 3, _TILE).groupBy("scene_id").agg(
        F.count("*").alias("pixels"), F.count_distinct("label").alias("instances"))


@query("split_instance_pixels")
def _(spark, sf):
    """The label of every pixel of the touching blobs."""
    sc = _scenes(spark, sf)
    mask = cp.clean_tree_mask(_seeds(spark, sf), sc, 12, 10000, _TILE)
    return ins.split_instances(mask, sc, 3, _TILE).select(*_KEY, "label")


def _level_sql(q: float, name: str) -> list[str]:
    return [f"""{name}_m AS (SELECT px.scene_id, y, x FROM px JOIN (SELECT scene_id, quantile_cont(b1, {q}) AS q FROM px GROUP BY scene_id) t ON t.scene_id = px.scene_id WHERE b1 > q)""",
            _erode(f"{name}_m", f"{name}_e", _SQUARE1), _dilate(f"{name}_e", f"{name}_d", _SQUARE1)]


_STAT = """{n}_s AS MATERIALIZED (SELECT scene_id, label, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM {p} GROUP BY ALL)"""


@query("seed_prompts_simple", fx.with_(fx.PX, fx.SCENES, *_level_sql(0.30, "a"), _parts("a_d", "p", _N4), _STAT.format(n="a", p="p"), recursive=True) + """SELECT scene_id, label, area,
  (x0 + x1 - 1) / 2.0 AS cx, (y0 + y1 - 1) / 2.0 AS cy, x0 - 6 AS box_x0, y0 - 6 AS box_y0, x1 + 6 AS box_x1, y1 + 6 AS box_y1, CAST(r AS INT) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY area DESC, label) AS r FROM a_s WHERE (y1 - y0) * (x1 - x0) >= 12) WHERE r <= 10""")
def _(spark, sf):
    px = fx.pixels(spark, sf).select(*_KEY, F.col("b1").alias("index"))
    return pr.seed_prompts_simple(px, fx.scenes(spark, sf), 30.0, 10, 12, tile=_TILE)


_BOX = """{n}_b AS MATERIALIZED (SELECT s.scene_id, CAST({lv} AS DOUBLE) AS level, label, area, (x0 + x1 - 1) / 2.0 AS cx, (y0 + y1 - 1) / 2.0 AS cy,
  greatest(0, y0 - 6) AS box_y0, greatest(0, x0 - 6) AS box_x0, least(height, y1 + 6) AS box_y1, least(width, x1 + 6) AS box_x1,
  row_number() OVER (PARTITION BY s.scene_id ORDER BY area DESC, label) AS r FROM {n}_s s JOIN scenes USING (scene_id) WHERE area >= {a})"""


@query("seed_prompts", fx.with_(
    fx.PX, fx.SCENES, *_level_sql(0.40, "a"), _parts("a_d", "pa", _N4), _STAT.format(n="a", p="pa"), _BOX.format(n="a", lv=40, a=13),
    "a_k AS MATERIALIZED (SELECT * FROM a_b WHERE r <= 12)", *_level_sql(0.30, "c"),
    """c_f AS MATERIALIZED (SELECT scene_id, y, x FROM c_d WHERE NOT EXISTS (SELECT 1 FROM a_k k WHERE k.scene_id = c_d.scene_id AND c_d.y >= box_y0 AND c_d.y < box_y1 AND c_d.x >= box_x0 AND c_d.x < box_x1))""",
    _parts("c_f", "pc", _N4), _STAT.format(n="c", p="pc"), _BOX.format(n="c", lv=30, a=13),
    "n_k AS (SELECT scene_id, count(*) AS t FROM a_k GROUP BY 1)", recursive=True) + """SELECT scene_id, level, label, area, cx, cy, box_y0, box_x0, box_y1, box_x1, CAST(r AS INT) AS rank FROM a_k
  UNION ALL SELECT c_b.scene_id, level, label, area, cx, cy, box_y0, box_x0, box_y1, box_x1, CAST(r + coalesce(t, 0) AS INT) FROM c_b LEFT JOIN n_k USING (scene_id) WHERE r + coalesce(t, 0) <= 12""")
def _(spark, sf):
    """Two levels; objects of the first block their boxes in the second."""
    px = fx.pixels(spark, sf).select(*_KEY, F.col("b1").alias("index"))
    objects, _ = pr.seed_prompts(px, fx.scenes(spark, sf), [30.0, 40.0], 12, 0, floor_area=13, tile=_TILE)
    return objects
