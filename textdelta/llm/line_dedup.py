"""Line dedup with a log-template tree, in DataFrame expressions only.

Lines are parsed at a fixed depth: by their number of tokens and their first
``LEADING`` tokens (a token with a digit counts as ``<*>``), which gives a leaf.
Within a leaf a token is constant if at least ``min_docs`` documents have it at
its place, and variable otherwise; if enough of a line's tokens are constant its
template is those, else it is the line itself. A template of ``min_docs`` or more
different documents recurs: its lines are dropped from all documents but the
first (the smallest id). Documents of equal text count once, so copies alone
make nothing recur.

Plan: one pass parses the lines to a table in the shared folder (hashes, and the
masked line), of which later steps read the columns that they need; different
texts are counted by leaf and line in partial aggregates; only lines of leaves
with several kinds and documents enough are split to tokens, whose support is
counted by (leaf, place, token) and joined back with hot tokens by broadcast, as
are templates to lines; dropped places meet the texts in one exchange, by id,
with the places as the hashed side. A leaf and a line are told apart by 64-bit
hashes each, a line within its leaf, so by 128 bits.

Edge cases: null text stays null, empty text empty; lines of fewer than
``min_tokens`` tokens are never dropped, so repeated blank lines stay; a
document may lose all its lines and is then an empty text; a row with a null id
loses no line and is no first document, but counts as a document; rows that
share id and text lose the same lines; other columns are kept as they are, but
for names that begin with two underscores, which the operator uses itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import answered, few, written

LEADING = 3


def _masked(text: Column) -> Column:
    """The lines of a text, tokens apart by one space, each token with a digit ``<*>``."""
    odd = F.lit(r"[\x09\x0B-\x0D]|  ")

    def one(line: Column) -> Column:
        line = F.when(F.rlike(line, odd), F.regexp_replace(line, r"[\x09\x0B-\x0D ]+", " ")).otherwise(line)
        return F.trim(F.when(F.rlike(line, F.lit("[0-9]")), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(line))

    return F.transform(F.split(text, "\n"), one)


def _lines(docs: DataFrame, id_column: str, text_column: str, min_tokens: int) -> DataFrame:
    """doc, text_key, pos, n, leaf, line, masked of every line that has tokens enough."""
    text = F.col(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text).alias("text_key"), F.posexplode(_masked(text)).alias("pos", "masked")).where("masked <> ''")
    rows = rows.withColumn("n", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1).where(F.col("n") >= min_tokens)
    return rows.withColumns({"leaf": F.xxhash64("n", F.substring_index("masked", " ", LEADING)), "line": F.xxhash64(F.lit("line"), "masked")})


def _templates(lines: DataFrame, min_docs: int, constant: float) -> DataFrame:
    """leaf, line, template, n (rows of the line) of the lines that may belong to a recurring template."""
    each = lines.groupBy("leaf", "line", "text_key").agg(F.count("*").alias("rows")).groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.sum("rows").alias("n"))
    each = written(each)
    leaves = written(each.groupBy("leaf").agg(F.sum("docs").alias("all_docs"), F.count("*").alias("n")).where(F.col("all_docs") >= min_docs).withColumn("kinds", F.col("n")))
    each = answered(each.withColumnRenamed("n", "rows"), leaves, ["leaf"], F.col("line")).where("all_docs IS NOT NULL")
    alone = each.where((F.col("kinds") == 1) & (F.col("docs") >= min_docs)).select("leaf", "line", F.col("line").alias("template"), F.col("rows").alias("n"))
    several = each.where("kinds > 1").select("leaf", "line", "docs", "rows")
    names = several.select("leaf", "line")
    marked = few(names)
    own = lines if marked is names else lines.join(marked, ["leaf", "line"], "left_semi")
    masked = own.groupBy("leaf", "line").agg(F.any_value("masked").alias("masked"))
    tokens = several.join(masked, ["leaf", "line"]).select("leaf", "line", "docs", "rows", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    tokens = written(tokens.where(F.col("place") >= LEADING).select("leaf", "line", "docs", "rows", "place", F.xxhash64("token").alias("token")))
    held = written(tokens.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("support"), F.count("*").alias("n")).where(F.col("support") >= min_docs).select("token", "leaf", "place", "n", F.lit(1).alias("held")))
    marked = answered(tokens, held, ["token", "leaf", "place"], F.xxhash64("line", "place"))
    part = F.when(F.col("held") == 1, F.struct("place", "token"))
    parts = marked.groupBy("leaf", "line", "rows").agg(F.count("*").alias("rest"), F.count("held").alias("n_held"), F.array_sort(F.collect_list(part)).alias("parts"))  # a line's own tokens
    size = F.col("rest") + LEADING
    general = F.col("n_held") + LEADING >= F.ceil(size * constant)
    template = F.when(general, F.xxhash64(F.lit("template"), size, "parts")).otherwise(F.col("line"))
    # lines of the leading tokens only have no others in their leaf
    return alone.union(parts.select("leaf", "line", template.alias("template"), F.col("rows").alias("n")))


def drop_recurring(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 5, min_tokens: int = 3, constant: float = 0.75) -> DataFrame:
    """The documents with the lines of recurring templates dropped but from the first document; adds n_lines and n_dropped.

    ``constant`` is the share of a line's tokens that a template must hold.
    """
    lines = written(_lines(docs, id_column, text_column, min_tokens))
    templates = written(_templates(lines, min_docs, constant))
    of = written(answered(lines.select("doc", "text_key", "pos", "leaf", "line"), templates, ["line", "leaf"], F.xxhash64("doc", "pos")).where("template IS NOT NULL"))
    counts = of.groupBy("leaf", "template", "text_key").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    counts = counts.groupBy("template", "leaf").agg(F.count("*").alias("docs"), F.min("first").alias("first"), F.sum("n").alias("n"))
    counts = written(counts.where(F.col("docs") >= min_docs).drop("docs"))
    gone = answered(of, counts, ["template", "leaf"], F.xxhash64("doc", "pos")).where("doc > first")
    gone = gone.groupBy("doc", "text_key").agg(F.collect_set("pos").alias("__gone"))
    gone = gone.select(F.col("doc").alias("__doc"), F.col("text_key").alias("__key"), "__gone").hint("shuffle_hash")
    text = F.col(text_column)
    docs = docs.withColumn("__id", F.col(id_column).cast("long")).withColumn("__text_key", F.xxhash64(text))
    docs = docs.join(gone, (F.col("__id") == F.col("__doc")) & (F.col("__text_key") == F.col("__key")), "left")
    places = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "__gone")
    kept = F.element_at(F.transform(F.array(F.split(text, "\n")), lambda ls: F.array_join(F.transform(places(ls), lambda i: F.get(ls, i)), "\n")), 1)  # so that it is split once
    dropped = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    docs = docs.withColumns({"n_lines": n_lines, "n_dropped": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(dropped).cast("long")})
    docs = docs.withColumn(text_column, F.when(F.col("__gone").isNull(), text).otherwise(kept))
    return docs.drop("__id", "__text_key", "__doc", "__key", "__gone")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left."""
    return drop_recurring(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


#: The digest's rows in DuckDB SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, text, pos,
         list_transform(regexp_extract_all(ls[pos], '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
  FROM (SELECT rid, doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d)
), p AS (
  SELECT rid, doc_id, text, pos, len(t) AS n, list_slice(t, 1, 3) AS lead, t FROM l WHERE len(t) >= 3
), e AS (
  SELECT n, lead, t, count(DISTINCT text) AS docs FROM p GROUP BY n, lead, t
), f AS (
  SELECT n, lead, t, docs, unnest(range(1, len(t) + 1)) AS place FROM e
), s AS (
  SELECT n, lead, place, t[place] AS token, sum(docs) AS support FROM f GROUP BY ALL
), g AS (
  SELECT f.n, f.lead, f.t, list(CASE WHEN support >= 5 THEN s.token ELSE NULL END ORDER BY f.place) AS parts
  FROM f JOIN s ON f.n = s.n AND f.lead = s.lead AND f.place = s.place AND f.t[f.place] = s.token
  GROUP BY f.n, f.lead, f.t
), g2 AS (
  SELECT t, CASE WHEN len(list_filter(parts, lambda x: x IS NOT NULL)) >= ceil(n * 0.75)
                 THEN {'n': n, 'lead': lead, 'parts': parts} ELSE {'n': n, 'lead': lead, 'parts': t} END AS template
  FROM g
), x AS (
  SELECT p.rid, p.doc_id, p.text, p.pos, g2.template FROM p JOIN g2 ON p.t = g2.t
), c AS (
  SELECT template, count(DISTINCT text) AS docs, min(doc_id) AS first FROM x GROUP BY template
), gone AS (
  SELECT rid, list(pos) AS ps FROM x JOIN c ON x.template = c.template WHERE docs >= 5 AND doc_id > first GROUP BY rid
)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_dropped,
       CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(ps, i)), chr(10)) END AS text
FROM d LEFT JOIN gone USING (rid)
"""
