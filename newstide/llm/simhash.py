"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two link when at most two of them differ. Cut into two segments of 32
bits, one segment of any linked pair differs in at most one bit. So every segment is indexed under
its 32 one-wildcard variants (one bit deleted): the pair meets in an equality join on one of these
and is verified by counting the differing bits.

Copies of a fingerprint collapse to one node first, which makes a group of copies one row. A
variant with more than ``SMALL`` fingerprints is not expanded into pairs. Its members are indexed
under the 65 points within one bit of them: two fingerprints share such a point exactly when they
differ in at most two bits, at most 65 share one, and each is linked to the smallest. No link
between components is lost and no group is squared.
"""

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from newstide.llm.common import row_of, row_udf
from newstide.llm.components import components
from newstide.sources.layout import written

SHINGLE, MAX_BITS, SEED = 3, 2, 42
# Largest variant that is expanded into pairs.
SMALL = 16
# Shingles hashed at once, which bounds the memory of a very long text.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of lower-cased words; 0 without words.

    ``bytes.split`` cuts at space and \\t to \\r, ``bytes.lower`` changes A-Z: the contract's rules.
    """
    words = text.lower().split()
    if not words:
        return 0
    shifted = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    n = len(shifted[-1])
    ones = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        shingles = zip(*[w[start:start + BLOCK] for w in shifted])
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, carry: bool = False) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; ``carry`` adds the struct ``row``."""

    def make():
        def one(text):
            fp = fingerprint(text or b"", shingle)
            return (fp - (1 << 64) if fp >> 63 else fp,)
        return one

    printed = row_udf("fp bigint", make)
    return (docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"),
                        *([row_of(docs).alias("row")] if carry else []))
            .withColumn("fp", printed("text")["fp"]).drop("text"))


def _variants(nodes: DataFrame) -> DataFrame:
    """64 rows per fingerprint: number of the deleted bit above, the rest of its segment below."""
    segment = "CASE WHEN k < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END"
    return (nodes.select("fp", F.expr("explode(sequence(0, 63))").alias("k"))
            .selectExpr("fp", f"shiftleft(CAST(k AS BIGINT), 32) | "
                              f"(({segment}) & ~shiftleft(1L, k % 32)) AS variant"))


def _ball_links(nodes: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded variants, over the points within one bit of both."""
    point = "CASE WHEN k = 64 THEN fp ELSE fp ^ shiftleft(1L, k) END"
    return (nodes.select("fp", F.expr("explode(sequence(0, 64))").alias("k"))
            .selectExpr("fp", f"{point} AS point")
            # at most 65 fingerprints lie within one bit of a point
            .groupBy("point").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
            .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b"))


def links(nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """Links (a, b) that join all fingerprints at two or fewer differing bits into components.

    ``nodes`` has distinct fingerprints in column fp. Up to ``small`` members every link of a
    variant is returned, in crowded ones a set with the same components.
    """
    variants = _variants(nodes)
    shared = written(variants.groupBy("variant").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1"), "variants")
    members = written(variants.join(
        shared.where("n > 2").select("variant", "n").hint("merge"), "variant"),
                      "members")
    few = members.where(F.col("n") <= small)
    pairs = (few.select("variant", F.col("fp").alias("a"))
             .join(few.select("variant", F.col("fp").alias("b")), "variant")
             .where("a < b").select("a", "b"))
    near = shared.where("n = 2").select("a", "b").union(pairs).where(
        f"bit_count(a ^ b) <= {MAX_BITS}")
    crowded = members.where(F.col("n") > small).select("fp").distinct()
    return near.union(_ball_links(crowded)).distinct()


def _labelled(prints: DataFrame) -> DataFrame:
    """Add the smallest id of its component to every row of a stored fingerprint table."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = components(links(nodes.select("fp")), "a", "b")
    named = (nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", "first_id", F.coalesce("component", "fp").alias("component")))
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = written(named.join(first, "component").select("fp", "component_id"), "labels")
    return prints.join(labels, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint 0 and link like any other. The component is the smallest
    id reachable; null ids do not count, and it is null only where all ids are. Repeated rows share
    fingerprint and component. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return _labelled(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that carry the smallest id of their component, with all columns.

    Rows that repeat this id within the component stay together. A component without any id
    stays whole, as there is no telling its rows apart.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle, carry=True), "fingerprints")
    return (_labelled(prints).where("component_id IS NULL OR doc_id = component_id")
            .select("row.*"))
