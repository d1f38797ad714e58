"""Step-by-step algorithms as recursive SQL for DuckDB: story clustering and the treemap's layout."""

from __future__ import annotations


def stories(items: str, vectors: str, similarity: float, hours: int) -> str:
    """CTEs that end in `stories` (s, members as a list of i, latest): leader clustering, newest first.

    items: i (1 for the newest), t (seconds). vectors: i, term, w of unit length. A centre is never built: its
    product with an item is the sum of the item's products with its members, its squared length the sum of theirs.
    """
    window = hours * 3600
    return f"""story_dots AS (SELECT x.i AS a, y.i AS b, sum(x.w * y.w) AS dot FROM {vectors} x JOIN {vectors} y ON x.term = y.term AND x.i <> y.i GROUP BY ALL),
story_near AS (SELECT a, list(b ORDER BY b) AS bs, list(dot ORDER BY b) AS ds FROM story_dots WHERE b < a GROUP BY a),
story_items AS (
  SELECT i, t, coalesce(bs, []) AS bs, coalesce(ds, []) AS ds, CASE WHEN i IN (SELECT i FROM {vectors}) THEN 1.0 ELSE 0.0 END AS own
  FROM {items} LEFT JOIN story_near ON a = i),
story_walk AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS story, []::DOUBLE[] AS norm2, []::DOUBLE[] AS earliest, []::DOUBLE[] AS latest
  UNION ALL
  SELECT i, list_append(story, coalesce(best, len(norm2) + 1)),
         CASE WHEN best IS NULL THEN list_append(norm2, own) ELSE list_transform(norm2, lambda v, k: CASE WHEN k = best THEN v + 2 * dot + own ELSE v END) END,
         CASE WHEN best IS NULL THEN list_append(earliest, t) ELSE list_transform(earliest, lambda v, k: CASE WHEN k = best THEN least(v, t) ELSE v END) END,
         CASE WHEN best IS NULL THEN list_append(latest, t) ELSE list_transform(latest, lambda v, k: CASE WHEN k = best THEN greatest(v, t) ELSE v END) END
  FROM (
    SELECT i, any_value(story) AS story, any_value(norm2) AS norm2, any_value(earliest) AS earliest, any_value(latest) AS latest, any_value(t) AS t, any_value(own) AS own,
           arg_max(s, (sim, s)) FILTER (WHERE fits) AS best, arg_max(dot, (sim, s)) FILTER (WHERE fits) AS dot
    FROM (
      SELECT *, dot / sqrt(norm2[s]) AS sim, s IS NOT NULL AND dot / sqrt(norm2[s]) >= {similarity} AND earliest[s] - t <= {window} AND t - latest[s] <= {window} AS fits
      FROM (
        SELECT i, any_value(story) AS story, any_value(norm2) AS norm2, any_value(earliest) AS earliest, any_value(latest) AS latest, any_value(t) AS t, any_value(own) AS own, s, sum(d) AS dot
        FROM (
          SELECT n.i, w.story, w.norm2, w.earliest, w.latest, n.t, n.own,
                 unnest(CASE WHEN len(bs) = 0 THEN [NULL] ELSE list_transform(bs, lambda b: w.story[b]) END) AS s, unnest(CASE WHEN len(ds) = 0 THEN [0.0] ELSE ds END) AS d
          FROM story_walk w JOIN story_items n ON n.i = w.i + 1) one
        GROUP BY i, s) two) three
    GROUP BY i) four),
story_of_place AS (SELECT unnest(story) AS s, unnest(range(1, len(story) + 1)) AS i FROM (SELECT story FROM story_walk ORDER BY i DESC LIMIT 1) x),
stories AS (SELECT s, list(i ORDER BY i) AS members, max(t) AS latest FROM story_of_place JOIN {items} USING (i) GROUP BY s),
story_sums AS (SELECT x.i, x.s, sum(dot) AS inner_dot FROM story_of_place x JOIN story_of_place y ON x.s = y.s AND x.i <> y.i JOIN story_dots ON a = x.i AND b = y.i GROUP BY ALL),
story_close AS (SELECT p.i, p.s, coalesce(inner_dot, 0) + own AS c FROM story_of_place p JOIN story_items USING (i) LEFT JOIN story_sums q ON q.i = p.i),
story_heads AS (
  SELECT s, arg_max(i, (round(c / CASE WHEN total > 0 THEN sqrt(total) ELSE 1 END, 12), -i)) AS head
  FROM (SELECT *, sum(c) OVER (PARTITION BY s) AS total FROM story_close) x GROUP BY s)"""


def squarified(name: str, items: str, boxes: str) -> str:
    """CTEs that end in `name` (g, nth, x, y, w, h): squarified boxes of the items (g, nth from 1, v falling) of each box (g, x, y, w, h).

    A row of cells grows along the shorter side while its worst side ratio does not get worse.
    """
    return f"""{name}_sums AS (SELECT g, sum(v) AS rest, count(*) AS n FROM {items} GROUP BY g),
{name}_walk AS (
  SELECT g, 1::BIGINT AS i, 1::BIGINT AS s, 0::DOUBLE AS total, 'inf'::DOUBLE AS best, x, y, w, h, rest::DOUBLE AS rest, n,
         0::BIGINT AS row_from, 0::BIGINT AS row_to, 0::DOUBLE AS row_total, 0::DOUBLE AS thick, 0::DOUBLE AS rx, 0::DOUBLE AS ry, FALSE AS upright
  FROM {boxes} JOIN {name}_sums USING (g)
  UNION ALL
  SELECT g, CASE WHEN grows THEN i + 1 ELSE i END, CASE WHEN grows THEN s ELSE i END, CASE WHEN grows THEN total + v ELSE 0 END, CASE WHEN grows THEN worst ELSE 'inf' END,
         CASE WHEN grows OR w < h THEN x ELSE x + band END, CASE WHEN grows OR w >= h THEN y ELSE y + band END,
         CASE WHEN grows OR w < h THEN w ELSE w - band END, CASE WHEN grows OR w >= h THEN h ELSE h - band END,
         CASE WHEN grows THEN rest ELSE rest - total END, n,
         CASE WHEN grows THEN 0 ELSE s END, CASE WHEN grows THEN 0 ELSE i - 1 END, total, band, x, y, w >= h
  FROM (
    SELECT *, i <= n AND (i = s OR worst <= best) AS grows
    FROM (
      SELECT k.*, a.v, total / rest * w * h / least(w, h) AS band,
             greatest(grown / least(w, h) * w * h / rest / (f.v / grown * least(w, h)), (f.v / grown * least(w, h)) / (grown / least(w, h) * w * h / rest),
                      grown / least(w, h) * w * h / rest / (a.v / grown * least(w, h)), (a.v / grown * least(w, h)) / (grown / least(w, h) * w * h / rest)) AS worst
      FROM (SELECT r.*, r.total + coalesce(c.v, 0) AS grown FROM {name}_walk r LEFT JOIN {items} c ON c.g = r.g AND c.nth = r.i WHERE r.s <= r.n AND r.rest > 0 AND r.w > 0 AND r.h > 0) k
      LEFT JOIN {items} a ON a.g = k.g AND a.nth = k.i LEFT JOIN {items} f ON f.g = k.g AND f.nth = k.s) one) two),
{name} AS (
  SELECT g, nth, CASE WHEN upright THEN rx ELSE rx + before END AS x, CASE WHEN upright THEN ry + before ELSE ry END AS y,
         CASE WHEN upright THEN thick ELSE long END AS w, CASE WHEN upright THEN long ELSE thick END AS h
  FROM (
    SELECT *, sum(long) OVER (PARTITION BY g, row_from ORDER BY nth) - long AS before
    FROM (
      SELECT r.g, i.nth, r.row_from, r.thick, r.rx, r.ry, r.upright, i.v / r.row_total * side.l AS long
      FROM {name}_walk r JOIN {items} i ON i.g = r.g AND i.nth BETWEEN r.row_from AND r.row_to
      JOIN LATERAL (SELECT CASE WHEN r.upright THEN r.h ELSE r.w END AS l) side ON TRUE
      WHERE r.row_from > 0) cells) placed)"""


def layout(k: int, other: str, small: float, width: float, height: float) -> str:
    """CTEs of one layout of the tiles shown{k} (ticker, sector, weight, change, rn), ending in cells{k}; crumbs go into shown{k + 1}."""
    change = "CASE WHEN change > 0 THEN '+' WHEN change < 0 THEN '−' ELSE '' END || replace(printf('%.2f', abs(change)), '.', ',') || '%'"
    return f"""by{k} AS (SELECT sector, sum(weight) AS value FROM shown{k} GROUP BY sector HAVING sum(weight) > 0),
tiny{k} AS (SELECT sector FROM by{k} WHERE value / (SELECT sum(value) FROM by{k}) < {small} AND sector <> '{other}'),
in{k} AS (
  SELECT t.*, CASE WHEN (SELECT count(*) FROM tiny{k}) > 1 AND t.sector IN (SELECT sector FROM tiny{k}) THEN '{other}' ELSE t.sector END AS grp
  FROM shown{k} t JOIN by{k} USING (sector)),
groups{k} AS (SELECT 'all' AS g, grp, row_number() OVER (ORDER BY sum(weight) DESC) AS nth, sum(weight)::DOUBLE AS v FROM in{k} GROUP BY grp),
whole{k} AS (SELECT 'all' AS g, 0::DOUBLE AS x, 0::DOUBLE AS y, {width}::DOUBLE AS w, {height}::DOUBLE AS h),
{squarified(f"sector{k}", f"groups{k}", f"whole{k}")},
boxed{k} AS (
  SELECT grp, b.x AS gx, b.y AS gy, b.w AS gw, b.h AS gh, CASE WHEN b.w >= 92 AND b.h >= 46 THEN 'across' WHEN b.h >= 92 AND b.w >= 40 THEN 'down' ELSE '' END AS label
  FROM sector{k} b JOIN groups{k} USING (nth)),
inner{k} AS (
  SELECT grp AS g, CASE WHEN label = 'down' THEN 17 ELSE 0 END::DOUBLE AS x, CASE WHEN label = 'across' THEN 17 ELSE 0 END::DOUBLE AS y,
         greatest(gw - CASE WHEN label = 'down' THEN 17 ELSE 0 END, 1)::DOUBLE AS w, greatest(gh - CASE WHEN label = 'across' THEN 17 ELSE 0 END, 1)::DOUBLE AS h
  FROM boxed{k}),
own{k} AS (SELECT grp AS g, ticker, weight::DOUBLE AS v, row_number() OVER (PARTITION BY grp ORDER BY weight DESC, rn) AS nth FROM in{k}),
{squarified(f"tile{k}", f"own{k}", f"inner{k}")},
cells{k} AS (
  SELECT s.ticker, s.weight, b.grp, b.label, b.gx, b.gy, b.gw, b.gh, t.x, t.y, t.w, t.h,
         CASE WHEN t.w >= CASE WHEN length(c) > length(s.ticker) THEN length(c) * 12 ELSE length(s.ticker) * 13 END * 0.66 + 8 AND t.h >= 13 * 1.15 + 12 * 1.15 + 5 THEN ''
              WHEN t.w >= length(s.ticker) * 11 * 0.66 + 8 AND t.h >= 11 * 1.15 + 6 THEN 'sm' WHEN t.w >= length(s.ticker) * 9 * 0.66 + 8 AND t.h >= 9 * 1.15 + 6 THEN 'micro' ELSE 'tiny' END AS fit
  FROM tile{k} t JOIN own{k} o ON o.g = t.g AND o.nth = t.nth JOIN (SELECT *, {change} AS c FROM in{k}) s ON s.ticker = o.ticker JOIN boxed{k} b ON b.grp = t.g),
shown{k + 1} AS (
  SELECT * FROM shown{k} WHERE ticker NOT IN (
    SELECT ticker FROM (SELECT ticker, row_number() OVER (ORDER BY weight) AS r FROM cells{k} WHERE fit = 'tiny') c WHERE r <= (SELECT count(*) FROM shown{k}) - 12))"""
