"""Line dedup by a log-template tree, as DataFrame operations only.

Every line goes down a tree of fixed depth: number of words, then its LEAD leading words, then its remaining words in
SEGMENTS equal runs. Words that hold a digit are variable fields and become one mark before the parse. In a leaf
(count and leading words) a run of words is part of a template when it stands at the same place in another document; a run
that does not is a variable field of the line. A line is an instance of a recurring template when all its runs, or all but
one for lines of at least LOOSE words, already stand in its leaf in a document of smaller doc_id. Such lines are dropped;
the first document keeps its line, so nothing is lost from the table.

Lines are split at line feeds. Lines under LEAST words never enter the tree. Rows that share a doc_id count as one document; a
null doc_id comes last. Null texts stay null, empty ones empty. Lines repeated within one document stay.

This rule, which the SQL states too, lets a line's own words go with it where one of its runs is new, and takes support from
different documents. ``clean_documents`` (the pipeline) sends lines of any length that have a letter or a digit down the same
tree and adds one node below their leaf, the whole line: a line goes when the tree finds it and one and the same earlier
document holds it whole. Variable fields may differ where the line has more other words than fields; else the line must be
equal as it is, so rows of numbers stay. Lines of up to LEAD words are a leaf of their own; rules and brackets alone are layout.
The tree is a table of hashed nodes with the smallest doc_id under each (a partial aggregate), joined back to the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.base import WORD, let

LEAD, SEGMENTS, LEAST, LOOSE = 3, 4, 5, 11
LAST = 9223372036854775807
SPACES = r"[\x20\x09-\x0D]+"
VARIABLE = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def nodes(docs: DataFrame, whole: bool = False) -> DataFrame:
    """id, text_hash, line_no, needed, node: one row for each run of words of each line that is long enough.

    With ``whole``, shorter lines enter too, lines without letter or digit do not, and each line has one more row, with needed
    NULL, for the whole line.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("text_hash"),
                       F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    if whole:
        rows = rows.where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    keep = ["id", "text_hash", "line_no"] + ["line"] * whole
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", VARIABLE, "<*>")).otherwise(F.col("line"))
    words = F.split(_trimmed(masked), SPACES, -1)
    # the one-element explode keeps the words an input of what follows: written into it, they would be cut again for every use
    long = rows.select(*keep, F.explode(F.array(words)).alias("words")).select(
        *keep, "words", F.size("words").alias("m")).where(F.col("m") >= (1 if whole else LEAST))
    runs = long.select("*", F.explode(F.array(*map(F.lit, range(SEGMENTS + whole)))).alias("s"))
    rest = F.col("m") - LEAD
    runs = runs.withColumn("begin", F.expr(f"(m - {LEAD}) * s div {SEGMENTS}").cast("int")).withColumn(
        "end", F.expr(f"(m - {LEAD}) * (s + 1) div {SEGMENTS}").cast("int"))
    is_run = F.col("end") > F.col("begin")
    path = F.array_join(F.concat(F.slice("words", 1, LEAD), F.slice("words", F.col("begin") + LEAD + 1, F.col("end") - F.col("begin"))), " ")
    needed = F.least(rest, F.lit(SEGMENTS)) - F.when(F.col("m") >= LOOSE, 1).otherwise(0)
    if whole:
        line, short = F.col("s") == SEGMENTS, F.col("m") <= LEAD
        is_run = line | F.when(short, F.col("s") == 0).otherwise(is_run)
        path = F.when(line, _whole_line()).when(short, F.array_join("words", " ")).otherwise(path)
        needed = F.when(~line, F.greatest(needed, F.lit(1)))
    named = runs.where(is_run).select("id", "text_hash", "line_no", needed.alias("needed"), "m", "s", F.explode(F.array(path)).alias("path"))
    return named.select("id", "text_hash", "line_no", "needed", F.struct(
        F.xxhash64("m", "s", "path").alias("h"), F.hash("m", "s", "path").alias("g")).alias("node"))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _whole_line() -> Column:
    """The line with white space as one space, its fields masked where it has more other words than fields."""
    fields = F.when(F.col("line").rlike("[0-9]"), F.regexp_count("line", F.lit(VARIABLE))).otherwise(0)
    template = F.array_join("words", " ")
    return F.when(fields == 0, F.concat(F.lit("="), template)).when(2 * fields < F.col("m"), F.concat(F.lit("~"), template)).otherwise(
        F.concat(F.lit("="), F.regexp_replace(_trimmed(F.col("line")), SPACES, " ")))


def dropped_lines(docs: DataFrame, whole: bool = False) -> DataFrame:
    """id, text_hash, gone: the sorted numbers of the lines that are dropped, for documents that lose any.

    With ``whole``, a line that the tree finds goes only where one earlier document holds all of it.
    """
    each = nodes(docs, whole)
    shared = each.groupBy("node").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("node", "first")
    hit = each.join(shared, "node").where("first < id").select("id", "text_hash", "line_no", "needed")
    lines = hit.groupBy("id", "text_hash", "line_no").agg(
        F.count("needed").alias("found"), F.max("needed").alias("needed"), F.count_if(F.col("needed").isNull()).alias("held"))
    found = lines.where("found >= needed and held > 0" if whole else "found >= needed")
    return found.groupBy("id", "text_hash").agg(F.array_sort(F.collect_list("line_no")).alias("gone"))


def dedup(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The input with text rewritten, and n_lines and n_dropped added (clashing columns of those names are replaced)."""
    gone = dropped_lines(docs, whole).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("gone").alias("_gone"))
    base = docs.drop("n_lines", "n_dropped")
    joined = base.join(gone, (F.coalesce("doc_id", F.lit(LAST)) == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    lines = F.split("text", "\n", -1)
    total = F.coalesce(F.size(lines), F.lit(0))
    starts = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda x: x + 1))
    kept = let(lines, lambda all_: F.flatten(F.zip_with(
        starts, F.concat(F.col("_gone"), F.array(F.size(all_))), lambda s, e: F.slice(all_, s + 1, e - s))))
    return joined.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(total).cast("long"),
        "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
    }).drop("_id", "_hash", "_gone")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_chars, kept_md5."""
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """Documents with the columns of the input; a document that had words and lost all its lines goes."""
    out = dedup(docs, whole=True).where(~((F.col("n_dropped") > 0) & ~F.col("text").rlike(WORD)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(doc_id, {LAST}) AS id, string_split(text, chr(10)) AS ls
              FROM documents),
lines AS (SELECT r, id, i - 1 AS line_no, list_filter(string_split_regex(
              regexp_replace(ls[i], '{VARIABLE}', '<*>', 'g'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
          FROM docs, unnest(generate_series(1, len(ls))) AS u(i)),
long AS (SELECT *, len(w) AS m FROM lines WHERE len(w) >= {LEAST}),
runs AS (SELECT r, id, line_no, m, s, struct_pack(m := m, lead := w[1:{LEAD}], s := s,
             run := w[{LEAD} + 1 + (m - {LEAD}) * s // {SEGMENTS} : {LEAD} + (m - {LEAD}) * (s + 1) // {SEGMENTS}]) AS node
         FROM long, range({SEGMENTS}) AS k(s)
         WHERE (m - {LEAD}) * (s + 1) // {SEGMENTS} > (m - {LEAD}) * s // {SEGMENTS}),
firsts AS (SELECT node, min(id) AS first FROM runs GROUP BY node),
hits AS (SELECT r, line_no, any_value(m) AS m, count(*) AS runs, count(*) FILTER (first < id) AS found
         FROM runs JOIN firsts USING (node) GROUP BY r, line_no),
gone AS (SELECT r, list(line_no) AS gone FROM hits
         WHERE found > 0 AND found >= runs - CASE WHEN m >= {LOOSE} THEN 1 ELSE 0 END GROUP BY r),
kept AS (SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(gone), 0) AS n_dropped,
                CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i - 1)), chr(10))
                END AS kept
         FROM docs LEFT JOIN gone USING (r))
SELECT doc_id, n_lines, n_dropped, length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM kept
"""
