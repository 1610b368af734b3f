"""Common table expressions for the oracles, in DuckDB's SQL."""

PX = """px AS (
  SELECT img, i, i % 32 AS x, i // 32 AS y, c0, c1, c2, CASE WHEN c2 = 0 THEN 0 ELSE 255 END AS a FROM (
    SELECT l_suppkey AS img, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i,
      CAST(l_quantity AS BIGINT) AS c0, CAST(round(l_discount * 100) AS BIGINT) AS c1, CAST(round(l_tax * 100) AS BIGINT) AS c2
    FROM lineitem))"""
RGB = PX + ", rgb AS (SELECT img, i, x, y, c0 * 5 AS r, c1 * 25 AS g, c2 * 31 AS b, a FROM px)"
LONG = RGB + ", ch AS (SELECT img, 0 AS c, i, x, y, r AS v FROM rgb UNION ALL SELECT img, 1, i, x, y, g FROM rgb UNION ALL SELECT img, 2, i, x, y, b FROM rgb)"
LIN = RGB + """, u AS (SELECT img, i, x, y, r / 255.0 AS r, g / 255.0 AS g, b / 255.0 AS b FROM rgb),
lin AS (SELECT img, i, x, y, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END AS r,
  CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END AS g,
  CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS b FROM u)"""
XYB = LIN + """, mx AS (SELECT img, i, x, y, cbrt(0.30 * r + 0.622 * g + 0.078 * b + 0.0037930734) - 0.1559542 AS l,
  cbrt(0.23 * r + 0.692 * g + 0.078 * b + 0.0037930734) - 0.1559542 AS m,
  cbrt((0.24342269 / (0.24342269 + 0.20476745)) * (1 - 0.55180986) * r + (1 - 0.24342269 / (0.24342269 + 0.20476745)) * (1 - 0.55180986) * g + 0.55180986 * b + 0.0037930734) - 0.1559542 AS s FROM lin),
xyb AS (SELECT img, i, x, y, 0.5 * (l - m) AS xx, 0.5 * (l + m) AS yy, s AS bb FROM mx)"""
YCC = RGB + """, co AS (SELECT img, i, x, y, r, g, b, r - b AS co, b + ((r - b) >> 1) AS t FROM rgb),
ycc AS (SELECT img, i, x, y, r, g, b, t + ((g - t) >> 1) AS c0, co AS c1, g - t AS c2 FROM co),
ych AS (SELECT img, 0 AS c, i, x, y, c0 AS v FROM ycc UNION ALL SELECT img, 1, i, x, y, c1 FROM ycc UNION ALL SELECT img, 2, i, x, y, c2 FROM ycc)"""


def neighbours(source: str, name: str = "nb") -> str:
    """source(img, c, i, x, y, v) with the causal neighbours, edges as the predictors want them."""
    lag = lambda k, when: f"CASE WHEN {when} THEN lag(v, {k}) OVER (PARTITION BY img, c ORDER BY i) END"
    return f"""{name}0 AS (SELECT *, {lag(1, 'x > 0')} AS w0, {lag(32, 'true')} AS n0, {lag(33, 'x > 0')} AS nw0, {lag(31, 'x < 31')} AS ne0,
  {lag(2, 'x > 1')} AS ww0, {lag(64, 'true')} AS nn0, {lag(30, 'x < 30')} AS nee0 FROM {source}),
{name}1 AS (SELECT *, coalesce(w0, n0, 0) AS w FROM {name}0),
{name}2 AS (SELECT *, coalesce(n0, w) AS n FROM {name}1),
{name}3 AS (SELECT *, coalesce(ne0, n) AS ne FROM {name}2),
{name} AS (SELECT img, c, i, x, y, v, w, n, coalesce(nw0, w) AS nw, ne, coalesce(ww0, w) AS ww, coalesce(nn0, n) AS nn, coalesce(nee0, ne) AS nee FROM {name}3)"""


def gradient_residual(nb: str = "nb", name: str = "res") -> str:
    """Zigzag of what the clamped gradient leaves, with its token and raw bits."""
    return f"""{name}0 AS (SELECT img, c, i, x, y, v - least(greatest(w + n - nw, least(w, n)), greatest(w, n)) AS e FROM {nb}),
{name}1 AS (SELECT *, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END AS z FROM {name}0),
{name}2 AS (SELECT *, length(bin(z)) - 1 AS k FROM {name}1),
{name} AS (SELECT img, c, i, x, y, e, z, CASE WHEN z < 16 THEN z ELSE 4 * k + ((z - (1::BIGINT << k::INT)) >> (k - 2)::INT) END AS token, CASE WHEN z < 16 THEN 0 ELSE k - 2 END AS nbits FROM {name}2)"""


SIGNAL = "sig AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE value IS NOT NULL)"
BLOCKS = "blk AS (SELECT vec_id AS block, k - 1 AS k, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(k))"
RD = "rd AS (SELECT l_returnflag || l_linestatus AS series, l_tax AS d, l_suppkey AS image, l_extendedprice / l_quantity AS bpp, round(l_discount * 100) AS m1, CASE WHEN round(l_discount * 100) > 0 THEN l_quantity END AS m2 FROM lineitem)"
LETTERS = """letters AS (SELECT conv_id * 1000 + turn AS stream, k AS seq, CAST(CAST('0x' || substr(h, 2 * k + 1, 2) AS INTEGER) AS BIGINT) AS value FROM
  (SELECT conv_id, turn, h, unnest(range(length(h) // 2)) AS k FROM (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations WHERE text IS NOT NULL)))"""
