"""Alignments in DuckDB SQL: what the registered queries of diffs are held against.

Anchors, regions, tables of longest common subsequences and the way back through
them are common table expressions, recursive where the definition is.
"""

from __future__ import annotations

from .functions.charclass import SQL_NUMBER, SQL_PUNCT, SQL_SPACE, SQL_WORD

_CLASSES = f"{SQL_SPACE}+|{SQL_PUNCT}+|{SQL_NUMBER}+|{SQL_WORD}+"

_ANCHORS = {
    "myers": "SELECT pair_id, 0 AS k, 0 AS i, 0 AS j FROM both_ WHERE false",
    # once on both sides, by place, each further than all before
    "patience": """SELECT pair_id, i AS k, i, j FROM (SELECT *, max(j) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM both_ WHERE na = 1 AND nb = 1)
      WHERE before IS NULL OR j > before""",
    # the ten rarest equal pairs
    "histogram": "SELECT * FROM (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY least(na, nb), i, j) AS k, i, j FROM both_) WHERE k <= 10",
}


def _spans(side: str, text: str) -> str:
    """Tokens of a side with their places in bytes."""
    return f"""{side}_every AS (
  SELECT pair_id, x, k, CAST(sum(strlen(x)) OVER (PARTITION BY pair_id ORDER BY k) AS INTEGER) AS e
  FROM (SELECT pair_id, unnest(w) AS x, unnest(range(0, len(w))) AS k FROM (SELECT pair_id, regexp_extract_all({text}, '{_CLASSES}') AS w FROM pairs))
), {side} AS (
  SELECT pair_id, x, CAST(e - strlen(x) AS INTEGER) AS s, e, row_number() OVER (PARTITION BY pair_id ORDER BY k) - 1 AS i
  FROM {side}_every WHERE NOT regexp_matches(x, '^{SQL_SPACE}') AND NOT regexp_matches(x, '^{SQL_PUNCT}')
)"""


def operations(pairs: str, algorithm: str) -> str:
    """``WITH`` clause up to ``ops``, a row an operation, and ``stats``, a row a pair, of ``pairs`` (which defines a table of that name)."""
    return f"""WITH RECURSIVE {pairs}, {_spans("ta", "original")}, {_spans("tb", "modified")},
both_ AS (
  SELECT ta.pair_id, ta.i, tb.i AS j, ca.n AS na, cb.n AS nb FROM ta JOIN tb ON ta.pair_id = tb.pair_id AND ta.x = tb.x
  JOIN (SELECT pair_id, x, count(*) AS n FROM ta GROUP BY ALL) ca ON ca.pair_id = ta.pair_id AND ca.x = ta.x
  JOIN (SELECT pair_id, x, count(*) AS n FROM tb GROUP BY ALL) cb ON cb.pair_id = ta.pair_id AND cb.x = ta.x
), anchors AS ({_ANCHORS[algorithm]}
), sides AS (
  SELECT p.pair_id, coalesce(a.w, []) AS a, coalesce(b.w, []) AS b, coalesce(c.w, []) AS anchors FROM pairs p
  LEFT JOIN (SELECT pair_id, list(x ORDER BY i) AS w FROM ta GROUP BY pair_id) a ON a.pair_id = p.pair_id
  LEFT JOIN (SELECT pair_id, list(x ORDER BY i) AS w FROM tb GROUP BY pair_id) b ON b.pair_id = p.pair_id
  LEFT JOIN (SELECT pair_id, list({{'i': i, 'j': j}} ORDER BY k) AS w FROM anchors GROUP BY pair_id) c ON c.pair_id = p.pair_id
), regions AS (
  SELECT pair_id, CAST([] AS BIGINT[]) AS path, CAST(0 AS BIGINT) AS fa, CAST(0 AS BIGINT) AS fb, CAST(len(a) AS BIGINT) AS ea, CAST(len(b) AS BIGINT) AS eb, anchors AS held FROM sides
  UNION ALL
  SELECT pair_id, path, fa, fb, ea, eb, list_filter(held, lambda h: h.i >= fa AND h.i < ea AND h.j >= fb AND h.j < eb) FROM (
    SELECT pair_id, list_append(path, 2 * c) AS path, held, CASE WHEN c = 0 THEN fa ELSE held[c].i + 1 END AS fa, CASE WHEN c = 0 THEN fb ELSE held[c].j + 1 END AS fb,
           CASE WHEN c = len(held) THEN ea ELSE held[c + 1].i END AS ea, CASE WHEN c = len(held) THEN eb ELSE held[c + 1].j END AS eb
    FROM (SELECT *, unnest(range(0, len(held) + 1)) AS c FROM regions WHERE len(held) > 0))
  WHERE fa < ea OR fb < eb
), leaves AS (
  SELECT row_number() OVER (ORDER BY r.pair_id, path) AS leaf, r.pair_id, path, fa, fb, a[fa + 1:ea] AS x, b[fb + 1:eb] AS y
  FROM regions r JOIN sides s ON s.pair_id = r.pair_id WHERE len(held) = 0 AND fa <= ea AND fb <= eb
), lengths AS (
  SELECT leaf, CAST(0 AS BIGINT) AS i, list_transform(y, lambda v: CAST(0 AS BIGINT)) AS t FROM leaves WHERE len(x) > 0 AND len(y) > 0
  UNION ALL
  SELECT leaf, i, list_transform(range(1, len(met) + 1), lambda j: list_max(met[1:j])) FROM (
    SELECT d.leaf, d.i + 1 AS i, list_transform(range(1, len(y) + 1), lambda j: greatest(d.t[j], coalesce(d.t[j - 1], 0) + CAST(x[d.i + 1] = y[j] AS BIGINT))) AS met
    FROM lengths d JOIN leaves l ON l.leaf = d.leaf WHERE d.i < len(x))
), back AS (
  SELECT leaf, CAST(len(x) AS BIGINT) AS i, CAST(len(y) AS BIGINT) AS j, false AS met FROM leaves WHERE len(x) > 0 AND len(y) > 0
  UNION ALL
  SELECT leaf, CASE WHEN same OR up THEN i - 1 ELSE i END, CASE WHEN same OR NOT up THEN j - 1 ELSE j END, same FROM (
    SELECT k.leaf, k.i, k.j, l.x[k.i] = l.y[k.j] AS same, above.t[k.j] > coalesce(here.t[k.j - 1], 0) AS up
    FROM back k JOIN leaves l ON l.leaf = k.leaf JOIN lengths here ON here.leaf = k.leaf AND here.i = k.i JOIN lengths above ON above.leaf = k.leaf AND above.i = k.i - 1
    WHERE k.i > 0 AND k.j > 0)
), matched AS (
  SELECT leaf, list(i ORDER BY i) AS mi, list(j ORDER BY j) AS mj FROM back WHERE met GROUP BY leaf
), own AS (
  SELECT l.*, coalesce(mi, []) AS mi, coalesce(mj, []) AS mj FROM leaves l LEFT JOIN matched m ON m.leaf = l.leaf
), placed AS (
  SELECT pair_id, path, len(list_filter(mi, lambda v: v < i)) AS g, 0 AS kind, i AS place, 'Delete' AS edit_type, fa + i AS ai, NULL AS bj
  FROM (SELECT *, unnest(range(0, len(x))) AS i FROM own) WHERE NOT list_contains(mi, i)
  UNION ALL
  SELECT pair_id, path, len(list_filter(mj, lambda v: v < j)), 1, j, 'Insert', NULL, fb + j FROM (SELECT *, unnest(range(0, len(y))) AS j FROM own) WHERE NOT list_contains(mj, j)
  UNION ALL
  SELECT pair_id, path, c, 2, 0, 'Equal', fa + mi[c + 1], fb + mj[c + 1] FROM (SELECT *, unnest(range(0, len(mi))) AS c FROM own)
  UNION ALL
  SELECT pair_id, list_append(path, 2 * c + 1), 0, 3, 0, 'Equal', held[c + 1].i, held[c + 1].j FROM (SELECT *, unnest(range(0, len(held))) AS c FROM regions)
), ops AS (
  SELECT p.pair_id, CAST(row_number() OVER (PARTITION BY p.pair_id ORDER BY path, g, kind, place) - 1 AS INTEGER) AS op_idx, edit_type,
         ta.x AS original_text, tb.x AS modified_text, ta.s AS original_start, ta.e AS original_end,
         CASE WHEN kind = 3 THEN ta.s ELSE tb.s END AS modified_start, CASE WHEN kind = 3 THEN ta.e ELSE tb.e END AS modified_end,
         CASE WHEN edit_type = 'Equal' THEN 'Unknown' ELSE 'Semantic' END AS category
  FROM placed p LEFT JOIN ta ON ta.pair_id = p.pair_id AND ta.i = p.ai LEFT JOIN tb ON tb.pair_id = p.pair_id AND tb.i = p.bj
), stats AS (
  SELECT p.pair_id, p.grp, p.seq, p.original, p.modified, coalesce(insertions, 0) AS insertions, coalesce(deletions, 0) AS deletions, CAST(0 AS BIGINT) AS modifications,
         coalesce(insertions + deletions, 0) AS edit_distance, coalesce(n, 0) AS n_ops,
         CASE WHEN greatest(strlen(p.original), strlen(p.modified)) > 0 THEN coalesce(insertions + deletions, 0) / greatest(strlen(p.original), strlen(p.modified)) ELSE 0.0 END AS change_percentage
  FROM pairs p LEFT JOIN (SELECT pair_id, count(*) AS n, count(*) FILTER (edit_type = 'Insert') AS insertions, count(*) FILTER (edit_type = 'Delete') AS deletions FROM ops GROUP BY pair_id) o ON o.pair_id = p.pair_id
)"""
