"""Line deduplication over overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a text are hashed together; a window whose hash occurred before, at
a smaller (doc_id, position), is a repeat, and all lines that repeats cover are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WINDOW = 3
#: Bytes of repeated positions up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def _lines(text) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column) -> Column:
    """array of (pos, h1, h2) for each window that is not blank; 128 bits of hash over trimmed lines."""
    trimmed = F.transform(lines, lambda x: F.trim(x))
    at = F.sequence(F.lit(0), F.size(lines) - WINDOW)
    arrays = F.transform(at, lambda k: F.struct(k.alias("pos"), F.slice(trimmed, k + 1, WINDOW).alias("w")))
    arrays = F.filter(arrays, lambda s: F.array_join(s["w"], "") != "")
    hashed = F.transform(arrays, lambda s: F.struct(s["pos"].alias("pos"), F.xxhash64(s["w"]).alias("h1"), F.xxhash64(F.lit("basalt"), s["w"]).alias("h2")))
    return F.when(F.size(lines) >= WINDOW, hashed)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, starts): the sorted positions of repeated windows, for documents that have some.

    Occurrences of a window are ordered by doc_id, then position; all but the first are repeats.  The
    hashes are written once; first occurrence and count come from one grouped minimum with map-side
    combine, and the join with it is split by AQE where one window is very common.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.explode(_windows(_lines(F.col("text")))).alias("w")).select("doc_id", "w.*")
    rows = Scratch(docs.sparkSession).put(rows)
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = rows.join(first, ["h1", "h2"]).where("NOT (doc_id = first.doc_id AND pos = first.pos)")
    return later.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every column of docs with the text's repeated lines removed, and n_removed (long, lines removed).

    Lines are parted by newline only.  Texts of fewer than three lines stay as they are, as do
    null and empty texts, windows of blank lines, and rows without a doc_id.  Rows that share one
    doc_id count as one document: their windows at one position are one occurrence.  A text all of
    whose lines go becomes ''.  A column n_removed of docs is replaced.  Positions of repeats are
    broadcast to the texts while they take at most BROADCAST_BYTES; beyond that texts are shuffled to them.
    """
    docs = docs.drop("n_removed")
    gone = repeated_windows(docs.select("doc_id", F.col(text).alias("text"))).select(F.col("doc_id").alias("__id"), "starts")
    gone = Scratch(docs.sparkSession).put(gone)
    size = gone.agg(F.sum(F.size("starts") * 4 + 40)).first()[0] or 0
    out = docs.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, docs["doc_id"] == gone["__id"], "left")
    # what stays lies between one repeat's end and the next one's start, so overlapping repeats need no merging
    lines = _lines(F.col(text))
    ends = F.concat(F.array(F.lit(0)), F.transform("starts", lambda p: p + WINDOW))
    gaps = F.zip_with(ends, F.concat("starts", F.array(F.size(lines))), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    gaps = F.filter(gaps, lambda g: g["n"] > 0)
    kept = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["n"]))), "\n")
    n = F.size(lines) - F.aggregate(gaps, F.lit(0), lambda t, g: t + g["n"])
    same = F.col("starts").isNull()
    out = out.select("*", F.when(same, F.col(text)).otherwise(kept).alias("__kept"), F.when(same, 0).otherwise(n).cast("long").alias("n_removed"))
    return out.select(*[F.col("__kept").alias(c) if c == text else docs[c] for c in docs.columns], "n_removed")


#: The same result in DuckDB SQL, over a relation documents(doc_id, text, ...).
SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, trim(l[i], ' ') AS line, l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)
), windows AS (
  SELECT doc_id, pos, a, b, c FROM (
    SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
  ) WHERE c IS NOT NULL AND a || b || c <> ''
), repeats AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM repeats, (VALUES (0), (1), (2)) AS v(d)
), kept AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS text FROM (
    SELECT doc_id, pos, l[pos + 1] AS raw FROM lines ANTI JOIN gone USING (doc_id, pos)
  ) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
