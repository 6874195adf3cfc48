"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one sets, for each row, two cells of a Bloom filter chosen by the digest
of its normalised text, and keeps the cells that more than one row has set.
Pass two tests each row against those cells.  A row with an unrepeated cell
is the only one of its text: it passes straight through.  The other rows, the
copies and a few false positives, shuffle by digest and are resolved exactly.

The filter grows with the rows, ``CELLS`` cells each, in words of 64 cells;
both cells of a row are in one word.  It is broadcast in parts of at most
``PART_WORDS`` words, one after another, whatever its size: the digests stand
sorted by word in their files, so a part reads its own pages of them, and no
row shuffles to be tested.

Two texts are equal when they are identical without the characters
``[\\x20\\x09-\\x0D]``.  Of equal texts the row with the most code points stays,
then the one with the smallest id.

Defined results: a null text counts as empty, so null, empty and white-space
texts are copies of each other.  A null id comes after every other id; of rows
equal in length and id one stays.  Other columns are carried as they are, but
for those named like an added column, which are replaced.  Ids may be of any
type that has an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize, new_path, small, without_ids

WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Cells of the filter for each row; about one row in twenty is then a false positive.
CELLS = 8
#: Words of a part of the filter, of about 50 bytes each where they are broadcast.
PART_WORDS = 1 << 21
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c))
    return text


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A small row for each document: its id, digest and length, and a number of its own."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("text_sha256"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("length"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def filter_words(rows: int) -> int:
    """Words of 64 cells that a filter for so many rows has, a power of two."""
    return 1 << max(6, (CELLS * rows // 64).bit_length())


def with_cells(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` with the word of the filter and the two bits in it that the digest sets."""
    h = F.xxhash64("text_sha256")
    bits = F.expr("shiftleft(1L, CAST(pmod(xxhash64(text_sha256), 64) AS INT)) | shiftleft(1L, CAST(pmod(shiftright(xxhash64(text_sha256), 6), 64) AS INT))")
    return rows.withColumn("word", F.shiftrightunsigned(h, 65 - words.bit_length()) if words > 1 else F.lit(0).cast("long")).withColumn("bits", bits)


def repeated_cells(rows: DataFrame) -> DataFrame:
    """(at, often): the words with cells that more than one row has set, and those cells.

    The bits of a word that one row sets are counted together first.
    """
    same = rows.groupBy("word", "bits").agg(F.least(F.count("*"), F.lit(2)).alias("n"))
    single = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(F.getbit("bits", k) == 1, k))
    counts = same.select("word", "n", F.explode(F.array_compact(single)).alias("bit")).groupBy("word", "bit").agg(F.sum("n").alias("n")).where("n > 1")
    return counts.groupBy(F.col("word").alias("at")).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("often"))


def tested(rows: DataFrame, words: int, part_words: int = PART_WORDS) -> DataFrame:
    """The written table ``rows`` (word, bits, ...) with ``maybe``: whether other rows have set both cells."""
    cells = materialize(repeated_cells(rows), "bloom")

    def test(part: DataFrame, side: DataFrame) -> DataFrame:
        found = part.join(F.broadcast(side), part["word"] == side["at"], "left")
        return found.withColumn("maybe", F.coalesce(F.col("often").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False))).drop("at", "often", "word", "bits")

    if words <= part_words:
        return test(rows, cells)
    path = new_path(rows.sparkSession, "tested")
    for low in range(0, words, part_words):
        part = test(rows.where(F.col("word").between(low, low + part_words - 1)), cells.where(F.col("at").between(low, low + part_words - 1)))
        part.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(part.schema).parquet(path)


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int | None = None, part_words: int = PART_WORDS) -> tuple[DataFrame, int]:
    """The written fingerprints of ``docs`` with their cells, sorted by word if the filter has parts; and its words."""
    words = words or filter_words(docs.count())
    rows = with_cells(fingerprints(docs, text, doc_id), words)
    return materialize(rows.sortWithinPartitions("word") if words > part_words else rows, "digests"), words


def resolve(rows: DataFrame, words: int, part_words: int = PART_WORDS) -> DataFrame:
    """``rows`` of digests() with the columns of ADDED."""
    found = tested(rows, words, part_words)
    maybe, single = found.where("maybe"), found.where("NOT maybe")
    groups = (
        maybe.groupBy("text_sha256")
        .agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("length")).alias("longest"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("keep"))
        .select("text_sha256", "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_id").alias("keep_row"))
    )
    # joined by broadcast, a text in a third of all rows moves no row; beyond that size Spark splits the skewed key
    met = maybe.join(small(materialize(groups, "groups")), "text_sha256").withColumn("kept", F.col("row_id") == F.col("keep_row"))
    passed = single.select("*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    columns = ["row_id", "doc_id", *ADDED]
    return met.select(columns).unionByName(passed.select(columns))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int | None = None, part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row, dropped ones too."""
    return resolve(*digests(docs, text, doc_id, words, part_words), part_words).drop("row_id")


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int | None = None, part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` without the rows whose text another row keeps, columns unchanged.

    Only the ids of the dropped rows meet the texts; with unique ids that is
    exact.  Of rows that share id and text one copy stays.
    """
    rows, words = digests(docs, text, doc_id, words, part_words)
    result = resolve(rows, words, part_words).where("NOT kept").select("doc_id", "text_sha256").withColumn("copies", F.lit(1))
    dropped = materialize(result.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("dropped")), "dropped")
    ids = dropped.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("dropped").alias("__dropped"))
    digest = F.sha2(normalised(F.col(text)).cast("binary"), 256)
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return without_ids(docs, dropped, doc_id)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(doc_id, digest).orderBy(F.length(F.coalesce(F.col(text), F.lit("")))))
    ranked = docs.withColumn("__place", place).withColumn("__digest", digest)
    joined = ranked.join(ids, ranked[doc_id].eqNullSafe(ids["__id"]) & (ranked["__digest"] == ids["__sha"]), "left")
    return joined.where("__dropped IS NULL OR __place > __dropped").select(docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), h AS (
  SELECT doc_id, length(t) AS n, sha256(norm) AS text_sha256 FROM d
), k AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM h
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
