"""Token counts with a digest cache.

A count belongs to a content digest (SHA-256 of the text as it is counted) and a version digest
(SHA-256 of the tokenizer file). Texts whose pair of digests is stored are not encoded; of the others
one row per distinct digest is, and the new counts are appended to the cache.

Digests travel without their texts. The text of a missing digest is fetched by the number of the first
row that has it, so no copy is encoded twice, whatever its id; with a warm cache the few numbers are a
small table, and Spark's own choice of join leaves the texts where they are.
"""

import hashlib
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from newstide.llm.common import PartCache, id_and_text, row_udf
from newstide.sources.layout import new_table_path, written

LIMIT = 512
CACHE = "content_digest string, version_digest string, n_tokens bigint"
# Bytes that a Python worker keeps of recurring parts and their counts.
CACHED_BYTES = 96 << 20
_BLANK_AFTER_SPACE = re.compile(r" (?=\s|\Z)")


def _splits_at_spaces(tokenizer) -> bool:
    """Whether a text may be counted in parts that begin with a single space.

    True of plain byte-level tokenizers: nothing is changed before the split, whose pattern starts a
    new match at such a space, and no added token takes blanks.
    """
    import json

    spec = json.loads(tokenizer.to_str())
    split = spec["pre_tokenizer"] or {}
    return (spec["normalizer"] is None and split.get("type") == "ByteLevel"
            and split["use_regex"] and not split["add_prefix_space"]
            and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])
                        for t in spec["added_tokens"]))


def load_counter(name: str, file: bytes) -> Callable[[str], int]:
    """Counter for a .json file of tokenizers or a .model file of sentencepiece."""
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=file)
        return lambda text: len(model.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(file)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def count(text: str) -> int:
        return len(tokenizer.encode(text, add_special_tokens=False))

    if not _splits_at_spaces(tokenizer):
        return count
    counts = PartCache(count, CACHED_BYTES)

    def count_parts(text: str) -> int:
        if _BLANK_AFTER_SPACE.search(text):
            return count(text)
        first, *rest = text.split(" ")
        return (counts[first] if first else 0) + sum([counts[" " + part] for part in rest])

    return count_parts


_COUNTERS: dict[str, Callable[[str], int]] = {}


def _counter(name: str, version: str, file: bytes) -> Callable[[str], int]:
    """The counter of a tokenizer version, built once per Python process."""
    if version not in _COUNTERS:
        _COUNTERS[version] = load_counter(name, file)
    return _COUNTERS[version]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``cache_path`` is a table that later calls read again, of any corpus and tokenizer; without one
    the cache lives for this call. Null texts count as empty, which have no tokens. Repeated rows
    are counted once and returned each; an empty table gives an empty result. Texts of any length
    are counted whole; other columns of ``docs`` never enter. ``docs`` has to be a stored table or
    give its rows in the same order each time, as row numbers are taken from it. Appending the same
    digest twice, as two jobs at a time may do, is harmless: equal digests have equal counts.
    """
    spark = docs.sparkSession
    cache_path = cache_path or new_table_path(spark, "token-cache")
    with open(tokenizer_path, "rb") as file:
        content = file.read()
    version = hashlib.sha256(content).hexdigest()
    name, shared = tokenizer_path, spark.sparkContext.broadcast(content)
    texts = id_and_text(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    keys = written(texts.select("rid", "doc_id", F.sha2("text", 256).alias("content_digest"),
                                F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    stored = read_cache(spark, cache_path).where(F.col("version_digest") == version)
    missing = written(
        keys.groupBy("content_digest").agg(F.min("rid").alias("rid"))
        .join(stored.select("content_digest"), "content_digest", "left_anti"), "misses")

    def make():
        count = _counter(name, version, shared.value)
        return lambda text: (count(text),)

    new = (texts.select("rid", "text").join(missing, "rid")
           .select("content_digest", F.lit(version).alias("version_digest"),
                   row_udf("n_tokens bigint", make)("text")["n_tokens"].alias("n_tokens")))
    new.write.mode("append").parquet(cache_path)
    counts = (read_cache(spark, cache_path).where(F.col("version_digest") == version)
              .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")))
    return (keys.join(written(counts, "counts"), "content_digest")
            .select("doc_id", "n_bytes", "n_tokens",
                    (F.col("n_tokens") > limit).alias("over_limit")))
