"""The same results as plain SQL over the same tables, for checking.

Row and column sizes are scalar subqueries, so one text serves every scale.
"""

from __future__ import annotations

# Named sub-selects. Each entry of a query below lists the ones it needs.
_A = """a AS (
  SELECT o_custkey AS "row", l_suppkey AS "col", sum(l_quantity) AS re,
         CAST(count(*) AS DOUBLE) AS im
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
_B = """b AS (
  SELECT l_suppkey AS "row", CAST(l_linenumber - 1 AS BIGINT) AS "col",
         sum(l_quantity) AS re, CAST(-count(*) AS DOUBLE) AS im
  FROM lineitem GROUP BY 1, 2)"""
_K = """k AS (
  SELECT CAST(n_regionkey AS BIGINT) AS "row", CAST(n_nationkey AS BIGINT) AS "col",
         CAST(n_nationkey + 1 AS DOUBLE) AS re, CAST(n_regionkey + 1 AS DOUBLE) AS im
  FROM nation)"""
_V = """v AS (SELECT event_id AS i, CAST(floor(value) AS DOUBLE) AS re FROM events)"""
_T = """t AS (
  SELECT event_id // 1000 AS i1, event_id // 100 % 10 AS i2, event_id // 10 % 10 AS i3,
         event_id % 10 AS i4, CAST(floor(value) AS DOUBLE) AS val FROM events)"""
_U = """u AS (
  SELECT CAST(c_nationkey AS BIGINT) AS "row", CAST(s_nationkey AS BIGINT) AS "col",
         CAST(count(*) % 3 - 1 AS DOUBLE) AS re
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2)"""
_X0 = """x0 AS (
  SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey - 12 AS DOUBLE) AS re
  FROM nation)"""
_S = """s AS (
  SELECT l_suppkey AS "row", l_partkey AS "col", CAST(count(*) AS DOUBLE) AS re
  FROM lineitem GROUP BY 1, 2)"""
_X = """x AS (
  SELECT vec_id, p, CAST(floor(CAST(embedding[p + 1] AS DOUBLE) * 1000) AS DOUBLE) AS re
  FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS p FROM embeddings))"""
_P = """p AS (
  SELECT o_custkey AS c, l_suppkey AS s, CAST(count(*) AS DOUBLE) AS re,
         CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS im
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
_Y0 = """y0 AS (
  SELECT c_custkey AS i, CAST(c_nationkey - 12 AS DOUBLE) AS re, CAST(0 AS DOUBLE) AS im
  FROM customer)"""
_N = """n AS (SELECT max(event_id) + 1 AS n FROM events)"""
_N2 = """n AS (
  SELECT CAST(pow(2, ceil(log2(max(event_id) + 1))) AS BIGINT) AS n FROM events)"""
_D0 = """d0 AS (
  SELECT i, coalesce(re, 0) AS re
  FROM (SELECT unnest(range((SELECT n FROM n))) AS i) LEFT JOIN v USING (i))"""


def _step(name: str, prev: str) -> str:
    """One product of the nation operator with a vector."""
    return f"""{name} AS (
  SELECT u."row" AS i, sum(u.re * {prev}.re) AS re FROM u JOIN {prev} ON u."col" = {prev}.i
  GROUP BY 1 HAVING sum(u.re * {prev}.re) <> 0)"""


def _hop(name: str, prev: str, to: str, by: str) -> str:
    """One complex product of the customer-supplier counts, or their transpose."""
    re = f"sum(p.re * {prev}.re - p.im * {prev}.im)"
    im = f"sum(p.re * {prev}.im + p.im * {prev}.re)"
    return f"""{name} AS (
  SELECT p.{to} AS i, {re} AS re, {im} AS im FROM p JOIN {prev} ON p.{by} = {prev}.i
  GROUP BY 1 HAVING {re} <> 0 OR {im} <> 0)"""


def _part_hop(name: str, prev: str, to: str, by: str) -> str:
    """One product of real with real and imaginary with imaginary parts."""
    re, im = f"sum(p.re * {prev}.re)", f"sum(p.im * {prev}.im)"
    return f"""{name} AS (
  SELECT p.{to} AS i, {re} AS re, {im} AS im FROM p JOIN {prev} ON p.{by} = {prev}.i
  GROUP BY 1 HAVING {re} <> 0 OR {im} <> 0)"""


_ODD = "odd AS (SELECT event_id AS i, TRUE AS flip FROM events WHERE user_id % 2 = 1)"


def _reflected(name: str, prev: str) -> str:
    return f"""{name}s AS (
  SELECT p.i, CASE WHEN flip THEN -re ELSE re END AS re FROM {prev} p LEFT JOIN odd ON odd.i = p.i),
{name} AS (SELECT i, 2 * (SELECT sum(re) / max(n) FROM {name}s, n) - re AS re FROM {name}s)"""


def _on_axis(name: str, prev: str) -> str:
    """The nation operator on the inner axis of a flat vector."""
    size = "(SELECT max(n_nationkey) + 1 FROM nation)"
    return f"""{name} AS (
  SELECT {prev}.i // {size} * {size} + u."row" AS i, sum(u.re * {prev}.re) AS re
  FROM {prev} JOIN u ON {prev}.i % {size} = u."col"
  GROUP BY 1 HAVING sum(u.re * {prev}.re) <> 0)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def _vector(name: str) -> str:
    return f'SELECT i AS "row", CAST(0 AS BIGINT) AS "col", re FROM {name}'


def _complex_vector(name: str) -> str:
    return f'SELECT i AS "row", CAST(0 AS BIGINT) AS "col", re, im FROM {name}'


_ENTRIES = _with(_A) + 'SELECT "row", "col", re, im FROM a'

_MATVEC = _with(_A) + """
SELECT a."row" AS "row", CAST(0 AS BIGINT) AS "col", sum(a.re * (s_nationkey - 12)) AS re,
       sum(a.im * (s_nationkey - 12)) AS im
FROM a JOIN supplier ON a."col" = s_suppkey GROUP BY 1
HAVING sum(a.re * (s_nationkey - 12)) <> 0 OR sum(a.im * (s_nationkey - 12)) <> 0"""

_MATMUL = _with(_A, _B) + """
SELECT a."row" AS "row", b."col" AS "col", sum(a.re * b.re - a.im * b.im) AS re,
       sum(a.re * b.im + a.im * b.re) AS im
FROM a JOIN b ON a."col" = b."row" GROUP BY 1, 2
HAVING sum(a.re * b.re - a.im * b.im) <> 0 OR sum(a.re * b.im + a.im * b.re) <> 0"""

_KRON = _with(_K, _B) + """
SELECT k."row" * (SELECT max(s_suppkey) + 1 FROM supplier) + b."row" AS "row",
       k."col" * 7 + b."col" AS "col", {re} AS re, {im} AS im
FROM k CROSS JOIN b"""

_SUM_TWO = _with(_T) + "SELECT i2, i4, sum(val) AS val FROM t GROUP BY 1, 2"

_CHAIN3 = _with(_U, _X0, _step("x1", "x0"), _step("x2", "x1"), _step("x3", "x2")) + _vector("x3")

_AXIS = _with(_U, _V, _on_axis("y1", "v")) + _vector("y1")

_ONE_HOP = _with(_P, _Y0, _hop("y1", "y0", "s", "c"), _hop("y2", "y1", "c", "s"))

_HOPS = _with(_P, _Y0, _hop("y1", "y0", "s", "c"), _hop("y2", "y1", "c", "s"),
              _hop("y3", "y2", "s", "c"), _hop("y4", "y3", "c", "s")) + _complex_vector("y4")

_SHIFTED = """
SELECT to_row AS "row", CAST(0 AS BIGINT) AS "col", re FROM moved WHERE re <> 0"""

_SNAPSHOTS = _with(_U, _X0, _step("x1", "x0"), _step("x2", "x1"), _step("x3", "x2"),
                   "xs AS (SELECT 1 AS step, * FROM x1 UNION ALL SELECT 2, * FROM x2 "
                   "UNION ALL SELECT 3, * FROM x3)") + """
SELECT CAST(step AS INTEGER) AS step, i AS "row", CAST(0 AS BIGINT) AS "col", re,
       CAST(0 AS DOUBLE) AS im FROM xs"""

ORACLES: dict[str, str] = {
    "coo_build": _ENTRIES,
    "dims": _with(_A) + """
SELECT max("row") + 1 AS rows, max("col") + 1 AS cols, count(*) AS entries FROM a""",
    "matmul_complex": _MATMUL,
    "matmul_componentwise": _with(_A, _B) + """
SELECT a."row" AS "row", b."col" AS "col", sum(a.re * b.re) AS re, sum(a.im * b.im) AS im
FROM a JOIN b ON a."col" = b."row" GROUP BY 1, 2
HAVING sum(a.re * b.re) <> 0 OR sum(a.im * b.im) <> 0""",
    "matvec": _MATVEC,
    "matvec_bucketed": _MATVEC,
    "gram": _with(_X) + """
SELECT a.p AS "row", b.p AS "col", sum(a.re * b.re) AS re
FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY 1, 2 HAVING sum(a.re * b.re) <> 0""",
    "cooccurrence": _with(_S) + """
SELECT a."row" AS "row", b."row" AS "col", sum(a.re * b.re) AS re
FROM s a JOIN s b ON a."col" = b."col" GROUP BY 1, 2 HAVING sum(a.re * b.re) <> 0""",
    "kron": _KRON.format(re="k.re * b.re - k.im * b.im", im="k.re * b.im + k.im * b.re"),
    "kron_componentwise": _KRON.format(re="k.re * b.re", im="k.im * b.im"),
    "norm": _with(_A) + "SELECT coalesce(sqrt(sum(re * re + im * im)), 0) AS norm FROM a",
    # Whole multiples of a power of two add up without rounding.
    "norm_exact": """
SELECT sqrt(CAST(sum(CAST(CAST(x AS DOUBLE) * x * pow(2, 100) AS HUGEINT)) AS DOUBLE) / pow(2, 100)) AS norm
FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)""",
    "sum_axis_exact": """
SELECT event_id // 100 % 10 AS i2, event_id % 10 AS i4,
  CAST(sum(CAST(value * pow(2, 70) AS HUGEINT)) AS DOUBLE) / pow(2, 70) AS val
FROM events GROUP BY 1, 2""",
    "abs_square": _with(_A) + 'SELECT "row", "col", re * re + im * im AS val FROM a',
    "reshape": _with(_T) + "SELECT i1, i2, i3, i4, val FROM t",
    "ravel": _with(_V) + _vector("v"),
    "sum_axis": _SUM_TWO,
    "sum_axis_all": _with(_T) + "SELECT coalesce(sum(val), 0) AS val FROM t",
    "sum_axis_fixed": _with(_T) + """
SELECT i2, sum(val) AS val FROM t WHERE i3 = 5 AND i4 = 5 GROUP BY 1""",
    "sum_axis_leading": _with(_T) + """
SELECT i3, sum(val) AS val FROM t WHERE i1 = 0 AND i2 = 3 GROUP BY 1""",
    "marginal": _with(_T) + "SELECT i2, i4, sum(val * val) AS val FROM t GROUP BY 1, 2",
    "marginal_fixed": _with(_T) + """
SELECT i1, i2, sum(val * val) AS val FROM t WHERE i3 = 5 AND i4 = 5 GROUP BY 1, 2""",
    "marginal_sets": _with(_T) + """
SELECT CAST(CASE GROUPING_ID(i1, i2, i4) WHEN 4 THEN 0 WHEN 3 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 3
  WHEN 1 THEN 4 ELSE 5 END AS INTEGER) AS "set", i1, i2, i4, sum(val * val) AS val
FROM t GROUP BY GROUPING SETS ((i2, i4), (i1), (i2), (i4), (i1, i2), ())""",
    "zero_prune": """
SELECT l_suppkey AS "row", l_partkey AS "col", sum(q) AS re
FROM (SELECT l_suppkey, l_partkey, CASE l_returnflag
        WHEN 'R' THEN l_quantity WHEN 'A' THEN -l_quantity ELSE 0 END AS q FROM lineitem)
GROUP BY 1, 2 HAVING sum(q) <> 0""",
    "chain3": _CHAIN3,
    "compose": _CHAIN3,
    "compose_ordered": _ONE_HOP + _complex_vector("y2"),
    "axis_form": _with(_U) + """
SELECT "row", "col", re, CAST(4 AS INTEGER) AS "outer", CAST(3 AS INTEGER) AS "inner" FROM u""",
    "snapshots": _SNAPSHOTS,
    "history": _SNAPSHOTS,
    "chain_hops": _HOPS,
    "chain_marginal": _ONE_HOP + """
SELECT i % (SELECT max(n_nationkey) + 1 FROM nation) AS i2, sum(re * re + im * im) AS val
FROM y2 GROUP BY 1""",
    "chain_norm": _ONE_HOP + "SELECT sqrt(sum(re * re + im * im)) AS norm FROM y2",
    "chain_marginal_fixed": _ONE_HOP + """
SELECT i // (SELECT max(n_nationkey) + 1 FROM nation) AS i1, sum(re * re + im * im) AS val
FROM y2 WHERE i % (SELECT max(n_nationkey) + 1 FROM nation) = 3 GROUP BY 1""",
    "chain_componentwise": _with(
        _P, """y0 AS (
  SELECT c_custkey AS i, CAST(c_nationkey - 12 AS DOUBLE) AS re,
         CAST(1 + c_nationkey % 3 AS DOUBLE) AS im FROM customer)""",
        _part_hop("y1", "y0", "s", "c"), _part_hop("y2", "y1", "c", "s")) + _complex_vector("y2"),
    "matmul_cells": _MATMUL,
    "apply_on_axis_cells": _AXIS,
    "kron_blocks": _KRON.format(re="k.re * b.re - k.im * b.im", im="k.re * b.im + k.im * b.re"),
    "matvec_in_place": _MATVEC,
    "chain_in_place": _HOPS,
    "chain_split": _HOPS,
    "chain_text": _ONE_HOP + """
SELECT i % (SELECT max(n_nationkey) + 1 FROM nation) AS i2, sum(re * re + im * im) AS val,
  'marginal' AS report FROM y2 GROUP BY 1
UNION ALL SELECT -1, sqrt(sum(re * re + im * im)), 'norm' FROM y2""",
    "axis_apply": _AXIS,
    "axis_chain": _with(_U, _V, _on_axis("y1", "v"), _on_axis("y2", "y1")) + _vector("y2"),
    "kron_apply": _AXIS,
    "reflect1": _with(_V, _N2, _D0, _ODD, _reflected("d1", "d0")) + _vector("d1"),
    "reflect2": _with(_V, _N2, _D0, _ODD, _reflected("d1", "d0"), _reflected("d2", "d1"))
    + _vector("d2"),
    "reflect_iterated": _with(
        _V, _N2, _D0, _ODD,
        """parted AS (SELECT d0.i, re, coalesce(flip, FALSE) AS flip FROM d0 LEFT JOIN odd ON odd.i = d0.i)""",
        """start AS (
  SELECT coalesce(sum(re) FILTER (WHERE NOT flip), 0) AS plain,
         coalesce(sum(re) FILTER (WHERE flip), 0) AS flipped,
         CAST(count(*) FILTER (WHERE flip) AS DOUBLE) AS k FROM parted)""",
        """walk(step, plain, flipped, plain_shift, flipped_shift) AS (
  SELECT 0, plain, flipped, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM start
  UNION ALL
  SELECT step + 1, m * (CAST(n AS DOUBLE) - k) - plain, m * k + flipped, m - plain_shift,
         m + flipped_shift
  FROM (SELECT walk.*, n, k, 2 * ((walk.plain - walk.flipped) / CAST(n AS DOUBLE)) AS m
        FROM walk, n, start)
  WHERE step < 5)""",
        """final AS (SELECT * FROM walk WHERE step = 5)""",
        """dn AS (
  SELECT i, CASE WHEN flip THEN flipped_shift + re ELSE plain_shift - re END AS re
  FROM parted, final)""", recursive=True) + _vector("dn"),
    "shift": _with(_V, _N, """moved AS (
  SELECT (i - 3 + n) % n AS to_row, re FROM v, n)""") + _SHIFTED,
    "shift_2d": _with(_V, _N, """side AS (
  SELECT CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS s FROM n)""", """moved AS (
  SELECT (i // s - 1 + s) % s * s + (i % s + 2) % s AS to_row, re FROM v, side)""") + _SHIFTED,
    "identity": _ENTRIES,
    "uniform": _with(_A, """w AS (
  SELECT 1 / pow(2, ceil(log2(max(s_suppkey) + 1) / 2)) AS w FROM supplier)""") + """
SELECT "row", CAST(0 AS BIGINT) AS "col", sum(re * w) AS re, sum(im * w) AS im
FROM a, w GROUP BY 1""",
    "basis_vector": _with(_A, """e AS (
  SELECT 1 AS i, 1 AS x, 0 AS y UNION ALL
  SELECT (max(s_suppkey) + 2) // 2, -2, 1 FROM supplier)""") + """
SELECT "row", CAST(0 AS BIGINT) AS "col", sum(re * x - im * y) AS re,
       sum(re * y + im * x) AS im
FROM a JOIN e ON a."col" = e.i GROUP BY 1
HAVING sum(re * x - im * y) <> 0 OR sum(re * y + im * x) <> 0""",
    "parse_complex": """
SELECT event_id, CAST(floor(value) AS DOUBLE) AS re, -CAST(user_id AS DOUBLE) AS im
FROM events""",
    "coo_text": _ENTRIES,
    "text_files": _MATMUL,
    "text_source": _MATMUL,
    "tensor_files": _SUM_TWO,
    "parquet_files": _MATVEC,
    "check_bounds": _with(_A) + """
SELECT "row", "col", re, im FROM a
WHERE "row" >= (SELECT (max(c_custkey) + 2) // 2 FROM customer)
   OR "col" >= (SELECT (max(s_suppkey) + 2) // 2 FROM supplier)""",
}
