"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by their bytes from the front: first by length, then by successive digits of
64, 256, 1024 ... bytes. A group with one member is finished, and so is one whose texts have ended;
only the others go on to the next digit. Digits are compared as they are, so equality rests on no
digest. Most documents are alone after the first digit and their text is never looked at again.

Every round sums a group to one row map-side before the shuffle, and the members meet that row in
a join of two plain exchanges, which adaptive execution splits: a group with a third of all rows is
no hot task. Rounds are written to the shared folder, so a lost executor repeats one round at most.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from newstide.llm.common import BLANK_RUN, row_of
from newstide.sources.layout import written

# Bytes of the first digit, growth per round, and the largest digit.
FIRST_DIGIT, GROWTH, LARGEST_DIGIT = 64, 4, 1 << 20


def normalised(text):
    """The text that is compared: blanks run together, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " ")


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of two and more. The smallest row number names a group: no two share it."""
    return (rows.groupBy(*keys)
            .agg(F.count("*").alias("n"), F.min("rid").alias("label"),
                 F.min("doc_id").alias("keep_id"),
                 F.coalesce(F.min_by("rid", "doc_id"), F.min("rid")).alias("keep_rid"))
            .where("n > 1"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays. Null texts count as empty and are equal to
    each other; a null id is kept only where the whole group has none. Repeated rows (same id and
    text) form a group of which one stays. ``carry`` adds the input row as struct ``row``. An
    empty table gives an empty result. ``docs`` has to be a stored table or give its rows in the
    same order each time, as row numbers are taken from it.
    """
    carried = ["row"] if carry else []
    scan = docs.select(docs[id_col].alias("doc_id"), normalised(docs[text_col]).alias("norm"),
                       *([row_of(docs).alias("row")] if carry else []))
    done, width, seen, keys = [], FIRST_DIGIT, FIRST_DIGIT, ["size", "digit"]
    slim = ["rid", "doc_id", "text_sha256", "size", *carried]
    rows = (scan.select("doc_id", *carried, F.monotonically_increasing_id().alias("rid"),
                        F.sha2("norm", 256).alias("text_sha256"),
                        F.octet_length("norm").alias("size"),
                        F.col("norm").cast("binary").alias("bytes"))
            .select(*slim, F.expr(f"substring(bytes, 1, {width})").alias("digit"),
                    F.expr(f"substring(bytes, {width + 1})").alias("rest")))
    while True:
        groups = written(_groups(rows, keys), "radix-groups")
        active = F.col("n").isNotNull() & (F.col("size") > seen)
        level = written(
            # by sorting at any size: the smaller side has no bound that would let it be broadcast
            rows.join(groups.hint("merge"), keys, "left")
            .select(*slim, "n", "label", "keep_id", "keep_rid", active.alias("active"),
                    F.when(active, F.col("rest")).alias("rest")), "radix-level")
        done.append(level.where(~F.col("active")).select(
            "doc_id", F.when(F.col("n").isNull(), F.col("doc_id"))
            .otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (F.col("n").isNull() | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
            "text_sha256", *carried))
        members = level.where("active")
        if members.isEmpty():
            return reduce(DataFrame.unionByName, done)
        width = min(width * GROWTH, LARGEST_DIGIT)
        seen, keys = seen + width, ["parent", "digit"]
        rows = members.select(*slim, F.col("label").alias("parent"),
                              F.expr(f"substring(rest, 1, {width})").alias("digit"),
                              F.expr(f"substring(rest, {width + 1})").alias("rest"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return (exact_duplicates(docs, id_col, text_col, carry=True)
            .where("kept").select("row.*"))
