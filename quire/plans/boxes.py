"""Queries of boxes against one another: difference from guards, boxes fitted to neighbours, removable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import boxing
from quire.functions import geometry as G
from quire.operators import boxes as B
from quire.plans.tables import ITEMS_SQL, box, items

PAGE = ["doc_id", "page_idx"]
WIDTH = 612.0


def _edges(c: str = "r") -> list[Column]:
    return [F.col(f"{c}.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")]


def guards_subtracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of every line, without what guards that reach over from lines around it cover."""
    rows = items(spark, sf_dir)
    n, x0, y0 = F.col("line_no"), F.col("x0"), F.col("y0")
    high = rows.where(n % 3 == 0).select(*PAGE, F.col("item_id").alias("id"), G.rect(x0 + 10, y0 + 6, x0 + 60, y0 + 46).alias("r"))
    wide = rows.where(n % 5 == 1).select(*PAGE, (F.col("item_id") + 500000).alias("id"), G.rect(x0 + 40, y0 - 10, x0 + 130, y0 + 8).alias("r"))
    return B.subtract_all(rows.select(*PAGE, F.col("item_id").alias("id"), box().alias("r")), high.unionByName(wide), PAGE).select(F.col("id").alias("item_id"), "n_guards", *_edges())


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("layout_role") == "title", "title").when(F.length("text") >= 60, "body").when(F.trim("text") != "", "region").otherwise("other")
    return items(spark, sf_dir).select(*PAGE, F.col("item_id").alias("id"), F.col("line_no").alias("pos"), kind.alias("kind"), (F.col("line_no") % 17 == 5).alias("locked"), box().alias("r"))


def boxes_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fitted_boxes(_kinds(spark, sf_dir), PAGE, WIDTH).select(F.col("id").alias("item_id"), "kind", *_edges())


def text_removable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as items; their text lies on the page as one span, as two halves of a block, as a foreign block, or in pieces of 80 characters; some boxes reach into the next row."""
    rows = items(spark, sf_dir)
    n, x0, y0, x1, y1 = (F.col(c) for c in ("line_no", "x0", "y0", "x1", "y1"))
    said = F.when(n % 10 == 7, "§§§").when(n % 10 == 6, "").otherwise(F.col("text"))
    own = rows.select(*PAGE, F.col("item_id").alias("id"), G.rect(x0, y0, x1, y1 + F.when(n % 6 == 5, 30.0).otherwise(0.0)).alias("r"), said.alias("text"))
    span = rows.where(n % 4 == 0).select(*PAGE, F.col("item_id").alias("id"), G.rect(x0, y0, x1 - 1, y1).alias("r"), "text")
    block = rows.where(n % 4 == 1).select(*PAGE, F.col("item_id").alias("id"), box().alias("r"), F.when(n % 3 == 0, "nothing of it").otherwise(F.col("text")).alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(".{1,80}"), F.lit(0))
    cut = rows.where(n % 4 >= 2).select(*PAGE, "item_id", "x0", "y0", "x1", F.size(pieces).alias("n"), F.posexplode(pieces).alias("k", "text"))
    at = lambda k: F.col("x0") + (F.col("x1") - F.col("x0")) * (k / F.col("n"))
    words = cut.select(*PAGE, (F.col("item_id") * 100000 + F.col("k")).alias("id"), G.rect(at(F.col("k")), F.col("y0"), at(F.col("k") + 1), F.col("y0") + 10).alias("r"), "text")
    math = rows.where(n % 9 == 4).select(*PAGE, F.col("item_id").alias("id"), G.rect(x0 + 5, y0 + 2, x0 + 30, y0 + 8).alias("r"))
    return B.removable_text(own, span, block, words, math, PAGE).select(F.col("id").alias("item_id"), "route", *_edges())


def text_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of three lines, in the order 2, 3, 1, over their boxes."""
    n = F.col("line_no")
    room = G.box_capacity_units(box(), F.lit(10.0), F.lit(0.4))
    rows = items(spark, sf_dir).select("doc_id", F.floor(n / 3).alias("g"), F.struct((n % 3).alias("k"), "text", room.alias("room")).alias("m"))
    rows = rows.groupBy("doc_id", "g").agg(F.array_sort(F.collect_list("m")).alias("m"))
    text = F.array_join(F.transform(F.concat(F.slice("m", 2, 2), F.slice("m", 1, 1)), lambda m: m["text"]), " ")
    parts = boxing.split_for_boxes_udf(text, F.transform("m", lambda m: m["room"]))
    return rows.select("doc_id", "g", F.posexplode(parts).alias("box", "part"))


QUERIES = {f.__name__: f for f in (guards_subtracted, boxes_fitted, text_removable, text_boxed)}

_SUBTRACT = f"""WITH RECURSIVE {ITEMS_SQL}, guards AS (
    SELECT doc_id, page_idx, item_id AS g, x0 + 10 AS gx0, y0 + 6 AS gy0, x0 + 60 AS gx1, y0 + 46 AS gy1 FROM items WHERE line_no % 3 = 0
    UNION ALL SELECT doc_id, page_idx, item_id + 500000, x0 + 40, y0 - 10, x0 + 130, y0 + 8 FROM items WHERE line_no % 5 = 1
), met AS (
    SELECT i.item_id, gx0, gy0, gx1, gy1, row_number() OVER (PARTITION BY i.item_id ORDER BY g) AS k, count(*) OVER (PARTITION BY i.item_id) AS n
    FROM items i JOIN guards USING (doc_id, page_idx)
    WHERE greatest(0, least(x1, gx1) - greatest(x0, gx0)) * greatest(0, least(y1, gy1) - greatest(y0, gy0)) > 0.5
), cut AS (
    SELECT item_id, 0 AS k, x0, y0, x1, y1 FROM items
    UNION ALL
    SELECT item_id, k + 1, p[1], p[2], p[3], p[4] FROM (
        SELECT item_id, k, unnest(CASE WHEN greatest(0, ix1 - ix0) * greatest(0, iy1 - iy0) > 0.5
               THEN list_filter([[x0, y0, ix0, y1], [ix1, y0, x1, y1], [ix0, y0, ix1, iy0], [ix0, iy1, ix1, y1]], lambda q: greatest(0, q[3] - q[1]) * greatest(0, q[4] - q[2]) > 0.5) ELSE [[x0, y0, x1, y1]] END) AS p
        FROM (SELECT c.*, greatest(x0, gx0) AS ix0, greatest(y0, gy0) AS iy0, least(x1, gx1) AS ix1, least(y1, gy1) AS iy1 FROM cut c JOIN met m ON m.item_id = c.item_id AND m.k = c.k + 1))
)
SELECT c.item_id, coalesce(m.n, 0) AS n_guards, x0, y0, x1, y1 FROM cut c LEFT JOIN (SELECT DISTINCT item_id, n FROM met) m ON m.item_id = c.item_id WHERE c.k = coalesce(m.n, 0)"""


def _same(a: str, b: str) -> str:
    return (
        f"(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) >= least(greatest(1, {a}.x1 - {a}.x0), greatest(1, {b}.x1 - {b}.x0)) * {B.SAME_COLUMN_OVERLAP} OR abs({a}.x0 - {b}.x0) <= {max(18.0, WIDTH * 0.035)})"
    )


_FITTED = f"""WITH {ITEMS_SQL}, b AS (
    SELECT doc_id, page_idx, item_id, line_no AS pos, line_no % 17 = 5 AS locked, x0, y0, x1, y1,
           CASE WHEN layout_role = 'title' THEN 'title' WHEN length(text) >= 60 THEN 'body' WHEN trim(text) <> '' THEN 'region' ELSE 'other' END AS kind FROM items
), gaps AS (
    SELECT doc_id, page_idx, CASE WHEN count(*) >= 2 THEN coalesce(least(4.0, greatest(1.2, median(y1 - y0) FILTER (y1 > y0) * 0.08)), 0) ELSE 0 END AS gap FROM b WHERE kind = 'body' GROUP BY ALL
), below AS (
    SELECT b.item_id, arg_min(c.y0, (c.y0, c.x0, c.pos)) AS ny FROM b JOIN b c USING (doc_id, page_idx) WHERE b.kind = 'body' AND c.kind = 'body' AND (c.y0, c.x0, c.pos) > (b.y0, b.x0, b.pos) AND {_same("b", "c")} GROUP BY b.item_id
), sides AS (
    SELECT b.*, g.gap, ny - y1 AS space, least((y1 - y0) * 0.08, (y1 - y0) * 0.03 * least(1.0, (g.gap - (ny - y1)) / greatest(g.gap, 0.01)) / 2) AS side, (y1 - y0) * 0.03 * least(1.0, (g.gap - (ny - y1)) / greatest(g.gap, 0.01)) AS inset
    FROM b JOIN gaps g USING (doc_id, page_idx) LEFT JOIN below n ON n.item_id = b.item_id WHERE b.kind = 'body'
), marked AS (
    SELECT *, coalesce(gap > 0 AND NOT locked AND space > -gap AND space < gap AND y1 > y0 AND inset >= 0.35 AND side > 0 AND y1 - y0 - side * 2 >= 8.0, false) AS close FROM sides
), body AS (
    SELECT doc_id, page_idx, item_id, pos, x0, CASE WHEN close THEN round(y0 + side, 3) ELSE y0 END AS y0, x1, CASE WHEN close THEN round(y1 - side, 3) ELSE y1 END AS y1 FROM marked
), stats AS (
    SELECT doc_id, page_idx, count(*) AS n, median(y1 - y0) FILTER (y1 > y0) AS mh, median(x1 - x0) FILTER (x1 > x0) AS mw FROM body GROUP BY ALL
), above AS (
    SELECT r.item_id, list({{'x1': a.x1, 'y1': a.y1}} ORDER BY a.y0 DESC, a.x0 DESC, a.pos DESC)[:2] AS near FROM b r JOIN body a USING (doc_id, page_idx)
    WHERE r.kind = 'region' AND (a.y0, a.x0, a.pos) < (r.y0, r.x0, r.pos) AND a.y1 <= r.y0 AND abs(a.x0 - r.x0) <= {max(18.0, WIDTH * 0.1)} AND a.x1 > r.x1 AND {_same("a", "r")} GROUP BY r.item_id
), region AS (
    SELECT r.*, CASE WHEN NOT locked AND s.n >= 2 AND y1 > y0 AND x1 > x0 AND y1 - y0 <= mh * 0.72 AND x1 - x0 <= mw * 0.78 AND len(near) >= 2 THEN near END AS near FROM b r LEFT JOIN stats s USING (doc_id, page_idx) LEFT JOIN above a ON a.item_id = r.item_id WHERE r.kind = 'region'
), grown AS (
    SELECT *, least((y1 - y0) * 0.05, greatest(0, y0 - list_max(list_transform(near, lambda q: q.y1)) - 1.0)) AS up, least(list_max(list_transform(near, lambda q: q.x1)), {WIDTH} - 4.0, x1 + (x1 - x0) * 0.30) AS reach FROM region
), ends AS (
    SELECT t.item_id, max(a.x1) AS e FROM b t JOIN body a USING (doc_id, page_idx) WHERE t.kind = 'title' AND a.y0 >= t.y0 AND abs(a.x0 - t.x0) <= 18.0 AND a.x1 > t.x1 GROUP BY t.item_id
)
SELECT item_id, 'body' AS kind, x0, y0, x1, y1 FROM body
UNION ALL SELECT item_id, 'region', x0, CASE WHEN near IS NOT NULL AND up > 0 THEN round(y0 - up, 3) ELSE y0 END, CASE WHEN near IS NOT NULL AND reach > x1 + 0.5 THEN round(reach, 3) ELSE x1 END, y1 FROM grown
UNION ALL SELECT t.item_id, 'title', x0, y0, CASE WHEN locked OR e IS NULL OR x1 <= x0 THEN x1 ELSE round(greatest(x1, least(e, {WIDTH} - 4.0, x0 + (x1 - x0) * 1.18)), 3) END, y1 FROM b t LEFT JOIN ends USING (item_id) WHERE kind = 'title'
UNION ALL SELECT item_id, kind, x0, y0, x1, y1 FROM b WHERE kind = 'other'"""

_WORDS = "list_transform(regexp_extract_all(%s, '[A-Za-z0-9]+(?:[-./][A-Za-z0-9]+)*|[一-鿿]+'), lambda w: lower(w))"
_ENOUGH = "CASE WHEN len(source) = 0 THEN n >= 2 WHEN len(source) <= 3 THEN hits >= 1 WHEN len(source) <= 8 THEN hits >= 2 ELSE hits >= greatest(2, floor(len(source) * 0.3)) END"

_REMOVABLE = f"""WITH {ITEMS_SQL}, own AS (
    SELECT doc_id, page_idx, item_id, x0, y0, x1, y1 + CASE WHEN line_no % 6 = 5 THEN 30.0 ELSE 0.0 END AS y1, CASE WHEN line_no % 10 = 7 THEN '§§§' WHEN line_no % 10 = 6 THEN '' ELSE text END AS said FROM items
), pieces AS (
    SELECT *, unnest(p) AS part, unnest(range(len(p))) AS k, len(p) AS n FROM (SELECT *, regexp_extract_all(text, '.{{1,80}}') AS p FROM items WHERE line_no % 4 >= 2)
), entries AS (
    SELECT 's' AS kind, doc_id, page_idx, item_id AS e, x0 AS ex0, y0 AS ey0, x1 - 1 AS ex1, y1 AS ey1, text AS et FROM items WHERE line_no % 4 = 0
    UNION ALL SELECT 'b', doc_id, page_idx, item_id, x0, y0, x1, y1, CASE WHEN line_no % 3 = 0 THEN 'nothing of it' ELSE text END FROM items WHERE line_no % 4 = 1
    UNION ALL SELECT 'w', doc_id, page_idx, item_id * 100000 + k, x0 + (x1 - x0) * (k / n), y0, x0 + (x1 - x0) * ((k + 1) / n), y0 + 10, part FROM pieces
), math AS (
    SELECT doc_id, page_idx, x0 + 5 AS mx0, y0 + 2 AS my0, x0 + 30 AS mx1, y0 + 8 AS my1 FROM items WHERE line_no % 9 = 4
), inside AS (
    SELECT o.*, kind, e, ex0, ey0, ex1, ey1, et, ((x0 + x1) / 2 - (ex0 + ex1) / 2) ** 2 + ((y0 + y1) / 2 - (ey0 + ey1) / 2) ** 2 AS d FROM own o JOIN entries USING (doc_id, page_idx)
    WHERE trim(et) <> '' AND (x1 - x0) * (y1 - y0) > 0 AND (ex0 + ex1) / 2 BETWEEN x0 AND x1 AND (ey0 + ey1) / 2 BETWEEN y0 AND y1
), owned AS (
    SELECT * FROM inside QUALIFY first_value([x0, y0, x1, y1]) OVER (PARTITION BY kind, doc_id, page_idx, e ORDER BY d, item_id) = [x0, y0, x1, y1]
), direct AS (
    SELECT item_id, any_value(doc_id) AS doc_id, any_value(page_idx) AS page_idx, any_value(ex0) AS ex0, any_value(ey0) AS ey0, any_value(ex1) AS ex1, any_value(ey1) AS ey1 FROM (
        SELECT *, greatest(0, least(x1, ex1) - greatest(x0, ex0)) * greatest(0, least(y1, ey1) - greatest(y0, ey0)) AS i FROM owned WHERE kind = 's')
    WHERE x0 + (x1 - x0) / 2 BETWEEN ex0 AND ex1 AND y0 + (y1 - y0) / 2 BETWEEN ey0 AND ey1 AND abs((ex1 - ex0) - (x1 - x0)) / greatest(x1 - x0, 1) <= 0.05 AND abs((ey1 - ey0) - (y1 - y0)) / greatest(y1 - y0, 1) <= 0.05
      AND i / ((x1 - x0) * (y1 - y0) + (ex1 - ex0) * (ey1 - ey0) - i) >= 0.8 GROUP BY item_id HAVING count(*) = 1
), rest AS (
    SELECT *, {_WORDS % "said"} AS source FROM own WHERE trim(said) <> '' AND item_id NOT IN (SELECT item_id FROM direct)
), matched AS (
    SELECT r.item_id, r.doc_id, r.page_idx, r.source, r.x0, r.y0, r.x1, r.y1, o.kind, o.e, o.ex0, o.ey0, o.ex1, o.ey1, {_WORDS % "et"} AS found FROM rest r JOIN owned o ON o.item_id = r.item_id
), block AS (
    SELECT item_id, doc_id, page_idx, e, ex0, ey0, ex1, ey1 FROM (SELECT *, len(found) AS n, len(list_intersect(list_distinct(found), list_distinct(source))) AS hits FROM matched WHERE kind = 'b') WHERE n > 0 AND {_ENOUGH}
), first_two AS (
    SELECT item_id, 'direct' AS route, doc_id, page_idx, 0 AS e, ex0 - 1.0 AS x0, ey0 - 0.6 AS y0, ex1 + 1.0 AS x1, ey1 + 0.6 AS y1 FROM direct
    UNION ALL SELECT item_id, 'block', doc_id, page_idx, e, ex0 - 1.0, ey0 - 0.6, ex1 + 1.0, ey1 + 0.6 FROM block
), clear AS (
    SELECT * FROM first_two f WHERE NOT EXISTS (SELECT 1 FROM math m WHERE m.doc_id = f.doc_id AND m.page_idx = f.page_idx AND greatest(0, least(x1, mx1) - greatest(x0, mx0)) * greatest(0, least(y1, my1) - greatest(y0, my0)) > 0.5)
), sums AS (
    SELECT item_id, any_value(source) AS source, sum(len(found)) AS n, len(list_intersect(list_distinct(flatten(list(found))), list_distinct(any_value(source)))) AS hits FROM matched
    WHERE kind = 'w' AND item_id NOT IN (SELECT item_id FROM clear WHERE route = 'block') GROUP BY item_id
), passed AS (
    SELECT m.* FROM matched m JOIN (SELECT item_id FROM sums WHERE n > 0 AND {_ENOUGH}) USING (item_id) WHERE m.kind = 'w'
), last_two AS (
    SELECT item_id, 'word' AS route, doc_id, page_idx, e, ex0 - 1.0 AS x0, ey0 - 0.6 AS y0, ex1 + 1.0 AS x1, ey1 + 0.6 AS y1 FROM passed WHERE len(source) > 0
    UNION ALL SELECT DISTINCT item_id, 'item', doc_id, page_idx, 0, x0 - 1.5, y0 - 1.0, x1 + 1.5, y1 + 1.0 FROM passed WHERE len(source) = 0
), every AS (
    SELECT * FROM clear UNION ALL
    SELECT * FROM last_two f WHERE NOT EXISTS (SELECT 1 FROM math m WHERE m.doc_id = f.doc_id AND m.page_idx = f.page_idx AND greatest(0, least(x1, mx1) - greatest(x0, mx0)) * greatest(0, least(y1, my1) - greatest(y0, my0)) > 0.5)
)
SELECT item_id, route, x0, y0, x1, y1 FROM every QUALIFY row_number() OVER (PARTITION BY item_id, round(x0 * 10), round(y0 * 10), round(x1 * 10), round(y1 * 10) ORDER BY e) = 1"""

SQL = {"guards_subtracted": _SUBTRACT, "boxes_fitted": _FITTED, "text_removable": _REMOVABLE}
