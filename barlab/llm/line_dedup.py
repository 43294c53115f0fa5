"""Boilerplate lines: lines that spread over many sites.

Lines are found once and kept as hashes. Those on as many rows as sites are
asked for get a HyperLogLog sketch of their sites, built by a group-by that
merges partial sketches, so a line that every document holds costs one sketch
per task. Lines whose estimate lies near
the threshold get an exact distinct count; the rest are decided by the sketch.

Exact copies of one document bring its lines to many sites without making them
boilerplate. So distinct texts are counted in the same two ways, and a line
needs as many of them as of sites. For the same reason a document of several
lines that would lose all of them stays as it is if its whole text stands
under another id too: it is an exact copy, and a matter for the duplicate
operators. A page of boilerplate with a text of its own loses its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlab.llm.session import checkpointed

_TRIM = " \t\x0b\x0c\r"


def _norm(line: Column) -> Column:
    return F.btrim(line, F.lit(_TRIM))


def _text(text_col: str) -> Column:
    return F.col(text_col).cast("string")


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """doc_id, text_hash, site and line (hashes), once for each distinct line of a row that is not empty."""
    site = F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("")))
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(_text(text_col)).alias("text_hash"), site.alias("site"), F.explode(F.array_distinct(F.split(_text(text_col), "\n"))).alias("raw"))
    return own.select("doc_id", "text_hash", "site", _norm(F.col("raw")).alias("norm")).where("norm <> ''").select("doc_id", "text_hash", "site", F.xxhash64("norm").alias("line"))


def _with_chosen(rows: DataFrame, chosen: DataFrame, key: str = "line", how: str = "inner", *, small_rows: int, salts: int) -> DataFrame:
    """Join with a table of lines or texts: it is broadcast if it is small by count, else each of its rows goes to ``salts`` tasks, so that one of very many documents is spread."""
    if chosen.count() <= small_rows:
        return rows.join(F.broadcast(chosen), key, how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("text_hash", "doc_id"), F.lit(salts)).cast("int"))
    return salted.join(chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "salt"], how).drop("salt")


def line_spread(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 8, lg_k: int = 12, band: float = 0.25, small_rows: int = 200_000, salts: int = 16) -> DataFrame:
    """Boilerplate lines: line (xxhash64 of the trimmed line), keeper (smallest id with the line), n_sites, n_texts.

    ``band``: relative distance from the threshold within which sites and
    texts are counted exactly; at lg_k 12 it is 15 standard errors of the
    sketch. n_sites and n_texts are such counts there, else estimates. A null
    site counts as '', null and empty texts have no lines, repeated rows count
    once, a null id is never a keeper, an empty table gives no lines.
    """
    return _spread(checkpointed(_lines(docs, id_col, text_col, site_col)), min_sites, lg_k, band, small_rows, salts)


def _spread(lines: DataFrame, min_sites: int, lg_k: int, band: float, small_rows: int, salts: int) -> DataFrame:
    count = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(lg_k)))
    # a line of fewer rows has fewer texts: counting them first spares a sketch for nearly every line there is
    often = checkpointed(lines.groupBy("line").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_sites).select("line"))
    spread = _with_chosen(lines, often, small_rows=small_rows, salts=salts).groupBy("line").agg(count("site").alias("sites"), count("text_hash").alias("texts"), F.min("doc_id").alias("keeper"))
    wide = checkpointed(spread.where((F.col("sites") >= min_sites * (1 - band)) & (F.col("texts") >= min_sites * (1 - band))))
    # what lies near the threshold has few distinct values, so they are made distinct before they meet
    near = lambda c: F.col(c) <= min_sites * (1 + band)
    doubtful = wide.where(near("sites") | near("texts")).select("line", near("sites").alias("near_sites"), near("texts").alias("near_texts"))
    kinds = F.array(F.when(F.col("near_sites"), F.struct(F.lit("site").alias("kind"), F.col("site").alias("value"))), F.when(F.col("near_texts"), F.struct(F.lit("text").alias("kind"), F.col("text_hash").alias("value"))))
    values = _with_chosen(lines, doubtful, small_rows=small_rows, salts=salts).select("line", F.explode(F.array_compact(kinds)).alias("x")).select("line", "x.kind", "x.value")
    exact = values.groupBy("line", "kind", "value").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count_if(F.col("kind") == "site").alias("n_site"), F.count_if(F.col("kind") == "text").alias("n_text"))
    known = lambda exactly, estimate: F.when(near(estimate), F.col(exactly)).otherwise(F.col(estimate)).cast("long")
    counted = wide.join(exact, "line", "left").select("line", "keeper", known("n_site", "sites").alias("n_sites"), known("n_text", "texts").alias("n_texts"))
    return counted.where((F.col("n_sites") >= min_sites) & (F.col("n_texts") >= min_sites))


def remove_boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 8, lg_k: int = 12, band: float = 0.25, small_rows: int = 200_000, salts: int = 16, report: tuple[str, str] | None = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` without boilerplate lines, with two more columns (None: without), replaced if there: how many lines a text had, and how many went.

    A line, trimmed and not empty, that occurs on ``min_sites`` sites and in
    as many distinct texts goes from every document but the one with the
    smallest id, so the corpus keeps one copy; a line found under null ids
    only goes from all of them. A document with two or more distinct lines
    that would lose all of them keeps them if the same text, unchanged, stands
    under another id (null is an id), and only then. A null site counts as a
    site of its own name ''. A null text stays null (no lines). Rows are never
    dropped, and repeated rows are treated alike. An empty table gives none.
    """
    lines = checkpointed(_lines(docs, id_col, text_col, site_col))
    boiler = checkpointed(_spread(lines, min_sites, lg_k, band, small_rows, salts).select("line", "keeper"))
    goes = ~F.coalesce(F.col("doc_id") == F.col("keeper"), F.lit(False))
    met = _with_chosen(lines, boiler, small_rows=small_rows, salts=salts).groupBy("doc_id", "text_hash")
    own = checkpointed(met.agg(F.collect_set(F.when(goes, F.col("line"))).alias("bad"), F.count(F.lit(1)).alias("n")))
    # only a text of several such lines can be an exact copy that would lose all of them
    ids = own.where("n > 1").groupBy("text_hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    copied = checkpointed(ids.where("least <> most OR unnamed AND least IS NOT NULL").select("text_hash", F.lit(True).alias("copied")))
    marked = _with_chosen(own.where(F.size("bad") > 0).drop("n"), copied, "text_hash", "left", small_rows=small_rows, salts=salts)
    hits = marked.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("bad").alias("__bad"), F.coalesce("copied", F.lit(False)).alias("__copied"))
    named = docs.withColumn("__text_hash", F.xxhash64(_text(text_col)))
    joined = named.join(hits, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    found = F.split(_text(text_col), "\n")
    keep = F.filter(found, lambda x: (_norm(x) == "") | ~F.array_contains(F.col("__bad"), F.xxhash64(_norm(x))))
    split = joined.withColumns({"__n": F.coalesce(F.size(found), F.lit(0)), "__keep": F.when(F.col("__bad").isNotNull(), keep)})
    whole = F.col("__bad").isNull() | (F.col("__copied") & (F.size("__bad") > 1) & ~F.exists("__keep", lambda x: _norm(x) != ""))
    rest = [F.col(c) if c != text_col else F.when(whole, F.col(text_col)).otherwise(F.array_join("__keep", "\n")).alias(text_col) for c in docs.columns if c not in (report or ())]
    if report is None:
        return split.select(*rest)
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col("__n"))
    return split.select(*rest, n_lines.cast("long").alias(report[0]), F.when(whole, F.lit(0)).otherwise(n_lines - F.size("__keep")).cast("long").alias(report[1]))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, text, pos, raw, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS norm
  FROM (SELECT doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents)
), b AS (
  SELECT norm, min(doc_id) AS keeper FROM l WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT site) >= 8 AND count(DISTINCT md5(text)) >= 8
), m AS (
  SELECT l.*, b.norm IS NOT NULL AND l.doc_id <> b.keeper AS hit FROM l LEFT JOIN b USING (norm)
), t AS (
  SELECT unnest(ids) AS doc_id FROM (SELECT list(doc_id) AS ids FROM documents GROUP BY md5(text) HAVING count(DISTINCT doc_id) > 1)
), w AS (
  SELECT doc_id, doc_id IN (SELECT doc_id FROM t) AND count(DISTINCT norm) FILTER (WHERE hit) >= 2 AND count(*) FILTER (WHERE NOT hit AND norm <> '') = 0 AS copied FROM m GROUP BY doc_id
), r AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT hit OR copied) AS clean, count(*) AS n_lines, count(*) FILTER (WHERE hit AND NOT copied) AS n_removed FROM m JOIN w USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(clean, '')) END AS clean_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""
