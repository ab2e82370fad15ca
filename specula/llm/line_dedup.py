"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a text are hashed together. The earliest place of each hash is found by an aggregation
that is combined before the shuffle, so a passage that a third of all documents share costs a row a task; windows at any
later place mark their three lines, and the marks of a text are merged into the lines that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm.common import written

SIZE = 3
BREAK = "\n"


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, n_lines, n_removed) of every row: without the lines of windows whose lines stand earlier.

    Lines end at a line feed. Earlier is a smaller id, or a higher place in the same text; windows may overlap and are
    judged on the input. Windows of blank lines only don't count. Lines are compared as they are, by a 128-bit digest in
    which their lengths keep the breaks apart. Texts of fewer than ``size`` lines stay whole, null stays null with 0 lines,
    an empty text has one line. Rows that repeat an id are as early as each other. A null id counts as the smallest. An
    empty table gives an empty result; the columns ``carry`` come along in the struct ``row``, others are not read.
    """
    lowest = F.lit(-(1 << 63))
    lines = F.split(F.col("text"), BREAK, -1)
    # Columns of any names travel as one struct.
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("id"), F.col(text_col).alias("text"), F.struct(*carry).alias("row") if carry else F.lit(0).alias("row"))
    each = F.transform(F.sequence(F.lit(0), F.size("lines") - size), lambda i: F.array_join(F.slice("lines", i + 1, size), BREAK))
    windows = (
        rows.select("id", lines.alias("lines"))
        .filter(F.size("lines") >= size)
        .select("id", F.posexplode(each).alias("at", "window"))
        .filter(F.col("window").rlike("[^\\s]"))
        .select("id", "at", F.unhex(F.md5("window")).alias("key"))
    )
    windows = written(windows, "windows")
    # Two plain minima hash-aggregate; the first place is only asked of the text that is first.
    first = windows.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first_id")
    found = windows.join(first, "key")
    place = found.filter("id = first_id").groupBy("key").agg(F.min("at").alias("first_at"))
    later = found.join(place, "key").filter("id > first_id or at > first_at")
    marks = later.groupBy("id").agg(F.array_sort(F.collect_set("at")).alias("marks"))  # a text's lines at most
    # What stays lies between the marks: from the end of the window before (0 at first) up to the next mark, and the rest.
    begin = lambda i: F.coalesce(F.get("marks", i - 1) + size, F.lit(0))
    between = F.flatten(F.transform("marks", lambda at, i: F.slice("lines", begin(i) + 1, F.greatest(at - begin(i), F.lit(0)))))
    kept = F.concat(between, F.slice("lines", begin(F.size("marks")) + 1, F.size("lines")))
    return (
        rows.join(marks, "id", "left")
        .withColumn("lines", lines)
        .withColumn("kept", F.when(F.col("marks").isNotNull(), kept))
        .select(
            F.nullif("id", lowest).alias("id"),
            F.when(F.col("marks").isNull(), F.col("text")).otherwise(F.array_join("kept", BREAK)).alias("text"),
            F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
            F.when(F.col("marks").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
            *(["row"] if carry else []),
        )
    )


def line_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """docs with the text column as ``line_dedup`` leaves it; all other columns and all rows stay."""
    out = line_dedup(docs, id_col, text_col, size, carry=tuple(docs.columns))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def op2_line_dedup(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, array_to_string(ls[i:i + 2], chr(10)) AS s FROM l, unnest(range(1, len(ls) - 1)) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w
      WHERE regexp_matches(s, '[^\s]')) WHERE k > 1),
g AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM r, unnest(range(0, 3)) AS t(j) GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string([x[1] FOR x IN list_zip(ls, range(1, len(ls) + 1)) IF NOT list_contains(gone, x[2])], chr(10)) END AS text
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""
