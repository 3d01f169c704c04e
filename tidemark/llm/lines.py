"""Line dedup by distinct-site spread, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, lookup, settled, whole_text, written

SPACES = " \t\n\x0b\x0c\r"


def _line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per line with a word: document, position, 128-bit line hash, site hash."""
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), F.xxhash64(F.col(site_col).cast("string")).alias("site"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    line = F.trim(F.col("line"), F.lit(SPACES))
    rows = rows.withColumn("line", line).where("line <> ''")
    return rows.select("doc", "text_hash", "pos", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def spread_lines(lines: DataFrame, min_sites: int = 5, band: float = 0.25, lg_k: int = 12) -> DataFrame:
    """Boilerplate lines ``h1, h2, first``: hashes of lines (rows ``doc, site, h1, h2``) on at least ``min_sites`` distinct sites.

    One HyperLogLog sketch per line hash, merged from task to task, estimates its sites. Estimates within
    ``band`` of the limit are settled by an exact distinct count of those lines alone. With the defaults the band is
    15 times the sketch's standard error (1.6 %), so lines outside it are on their side for certain in practice. ``first`` is the
    smallest document id, null if no document with the line has one.
    """
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc").alias("first"))
    spread = sketches.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread, _ = settled(spread.where(F.col("sites") >= (1 - band) * min_sites))
    sure = spread.where(F.col("sites") > (1 + band) * min_sites).select("h1", "h2", "first")
    near = spread.where(F.col("sites") <= (1 + band) * min_sites).select("h1", "h2", "first")
    exact = lines.select("h1", "h2", "site").join(lookup(near), ["h1", "h2"]).groupBy("h1", "h2", "site").agg(F.min("first").alias("first"))
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_sites)
    return sure.unionByName(exact.select("h1", "h2", "first"))


def _kept_lines(text: Column, removed: Column) -> Column:
    """The text without the lines at the positions ``removed``, by a hashed difference of positions."""
    def kept(parts: Column) -> Column:  # the split text as a variable, so that it is split once
        places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), removed)
        return F.array_join(F.transform(places, lambda k: F.get(parts, k)), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n")), kept), F.lit(0))


def dedup_lines(
    docs: DataFrame, min_sites: int = 5, band: float = 0.25, lg_k: int = 12, keep_first: bool = True,
    id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text_col``, plus ``n_lines`` and ``n_removed``.

    Lines are parted by a newline and compared without outer ASCII white space; lines without a word are
    never boilerplate. A line on ``min_sites`` distinct sites or more goes from every document but, with
    ``keep_first``, the one with the smallest id. All rows stay, even with an empty text; a null text counts
    as empty and stays null, a null site is a site of its own. A null id is never the first: a line that only
    documents without an id have goes from all of them. Repeated rows are treated alike. Columns of ``docs`` named ``n_lines`` or ``n_removed`` are replaced.

    Texts are split once into a written table of hashes, from which all else follows; per document, the positions to
    cut come back in one join.
    """
    docs = docs.drop("n_lines", "n_removed")
    columns = docs.columns
    lines = written(_line_table(docs, id_col, text_col, site_col), "lines")
    hits = lines.join(lookup(spread_lines(lines, min_sites, band, lg_k)), ["h1", "h2"])
    if keep_first:
        hits = hits.where(F.col("first").isNull() | ~F.col("doc").eqNullSafe(F.col("first")))
    cut, text_hash, doc = free_name(docs, "cut", "text_hash", "doc")
    cuts = hits.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias(cut))  # at most the lines of one document
    cuts = cuts.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), cut)
    same = F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(whole_text(text_col)) == F.col(text_hash))
    joined = docs.join(cuts, same, "left")
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(_kept_lines(F.col(text_col), F.col(cut)))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in columns],
        F.size(F.split(whole_text(text_col), "\n")).alias("n_lines"),
        F.coalesce(F.size(cut), F.lit(0)).alias("n_removed"),
    )


def oracle(min_sites: int = 5) -> str:
    """DuckDB SQL of ``dedup_lines`` over ``documents``: exact distinct counts of the lines themselves."""
    trim = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH texts AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM texts),
spread AS (
  SELECT {trim} AS norm, min(doc_id) AS first FROM lines WHERE {trim} <> ''
  GROUP BY 1 HAVING count(DISTINCT coalesce('s' || source, 'none')) >= {min_sites}),
marked AS (
  SELECT l.doc_id, l.line, l.pos, s.norm IS NOT NULL AND l.doc_id <> s.first AS cut
  FROM lines l LEFT JOIN spread s ON {trim} = s.norm)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS text,
       CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (cut) AS INTEGER) AS n_removed
FROM marked GROUP BY doc_id"""
