"""Line dedup: lines that many documents share are dropped from all of them.

Texts are exploded into lines; a line's key (stripped, A-Z lowered) is hashed to 128 bits, and the distinct documents of each hash are
counted. Lines of keys over the threshold leave their places in the text, and what lies between those places is joined again by position. DataFrame
functions only.

Text moves once, to meet the places of its dropped lines; what is counted are rows of hashes. A key that a third of all documents hold is
counted by (key, document) first and then by (key, salt), and meets its verdict under (key, salt) too, so no task holds all its rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, read, written

#: What is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCUMENTS = 1, 10
#: What tells rows apart: the id, and two hashes of the text (rows of one id may differ, and an id may be null).
ROW = ("doc_id", "t1", "t2")


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lowered. lower() would change other letters too, so it is for ASCII lines only."""
    stripped = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(stripped) == F.char_length(stripped), F.lower(stripped)).otherwise(F.translate(stripped, string.ascii_uppercase, string.ascii_lowercase))


def two_hashes(c: Column) -> tuple[Column, Column]:
    """128 bits in two halves of different seeds."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def whole(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t1, t2), null texts as empty."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t1, t2 = two_hashes(F.col("text"))
    return t.withColumns({"t1": t1, "t2": t2})


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, t1, t2, position, h1, h2) of the lines whose keys have at least min_chars code points."""
    lines = whole(docs).select(*ROW, F.posexplode(F.split("text", "\n")).alias("position", "line")).select(*ROW, "position", line_key(F.col("line")).alias("key"))
    h1, h2 = two_hashes(F.col("key"))
    return lines.where(F.char_length("key") >= min_chars).select(*ROW, "position", h1.alias("h1"), h2.alias("h2"))


def salt() -> Column:
    return F.pmod(F.xxhash64("doc_id", "t1"), F.lit(SALTS)).cast("int").alias("salt")


def shared_keys(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(h1, h2, salt) of the keys that at least min_documents documents hold, with every salt they have rows under.

    Rows of one doc_id are one document; rows without a doc_id are told apart by their text.
    """
    unnamed = F.col("doc_id").isNull()
    held = lines.select("h1", "h2", salt(), "doc_id", F.when(unnamed, F.col("t1")).alias("u1"), F.when(unnamed, F.col("t2")).alias("u2"))
    once = held.groupBy("h1", "h2", "doc_id", "u1", "u2").agg(F.min("salt").alias("salt"))
    # documents by one of their salts are counted; all salts that have rows are listed
    counts = once.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("h1", "h2")
    salts = held.select("h1", "h2", "salt").distinct()
    return salts.join(counts.hint("merge"), ["h1", "h2"])


def without_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, a row for each row of docs: text without the lines that at least min_documents documents share.

    A null or empty text is one empty line. Blank lines have empty keys and stay unless min_chars is 0. A text all of whose lines go is empty. Repeated
    rows each keep a row; rows of one doc_id count as one document, those without a doc_id by their text. An empty table gives no rows;
    other columns are not read.
    """
    lines = written(hashed_lines(docs, min_chars), "lines")
    shared = shared_keys(lines, min_documents)
    dropped = lines.withColumn("salt", salt()).join(shared.hint("merge"), ["h1", "h2", "salt"])
    places = dropped.groupBy(*ROW).agg(F.sort_array(F.collect_set("position")).alias("places"))
    rows, cut = whole(docs).alias("d"), places.hint("merge").alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.t1") == F.col("p.t1")) & (F.col("d.t2") == F.col("p.t2"))
    met = rows.join(cut, same, "left").select("d.doc_id", "d.text", "p.places", F.split("d.text", "\n").alias("lines"))
    gone, n = F.size("places"), F.size("lines")
    # what lies before each dropped place and after the last, in order
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("places", i - 1) + 1)
    end = lambda i: F.when(i == gone, n).otherwise(F.get("places", i))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), gone), lambda i: F.slice("lines", begin(i) + 1, end(i) - begin(i))))
    return met.select("doc_id", F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), n.cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them share."""
    cut = without_shared_lines(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The same rows in DuckDB.
SQL = f"""with lines as (select doc_id, row_id, place, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as key from (
  select doc_id, row_id, unnest(l) as line, unnest(range(len(l))) as place from (select doc_id, row_number() over () as row_id, string_split(coalesce(text, ''), chr(10)) as l from documents))),
 shared as (select key from lines where key <> '' group by key having count(distinct doc_id) >= {MIN_DOCUMENTS})
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256 from (select *, key in (select key from shared) as gone from lines) group by doc_id, row_id"""
