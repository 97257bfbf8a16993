"""What the operators of this folder share."""

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The characters that separate words in every contract of this folder: space and \t to \r.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``doc_id`` and ``text`` only, a null text as an empty one.

    Other columns of ``docs`` never enter an operator, so their names cannot clash.
    """
    return docs.select(docs[id_col].alias("doc_id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"))


def row_of(docs: DataFrame) -> Column:
    """A whole row as one struct, to be carried along under a name of the operator's own."""
    return F.struct(*[docs[c] for c in docs.columns])


def row_udf(schema: str, make: Callable[[], Callable[..., tuple | None]], rows_at_once: int = 256):
    """An Arrow UDF that returns a struct from a plain function of one row's values.

    ``make`` builds the function once per task. Few rows are Python objects at a time, so memory
    follows the longest texts and not the batch. All other columns stay in the JVM.
    """
    struct = StructType.fromDDL(schema)
    kind = pa.struct(list(to_arrow_schema(struct)))

    @F.arrow_udf(struct)
    def apply(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        one = make()
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            parts = []
            for start in range(0, len(columns[0]), rows_at_once):
                rows = zip(*[c.slice(start, rows_at_once).to_pylist() for c in columns])
                parts.append(pa.array([dict(zip(kind.names, one(*row))) for row in rows], kind))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return apply


class PartCache(dict):
    """Values of recurring short texts, made by ``make`` and kept within ``limit`` bytes.

    A text of more than ``longest`` characters is worth no place: its value is made each time. When
    the bytes are used up the cache starts anew, which changes no result.
    """

    # of an entry beside its key and value
    ENTRY = 120

    def __init__(self, make: Callable[[str], object], limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.size = make, limit, longest, 0

    def __missing__(self, part: str):
        value = self.make(part)
        if len(part) <= self.longest:
            size = sys.getsizeof(part) + sys.getsizeof(value) + self.ENTRY
            if self.size + size > self.limit:
                self.clear()
                self.size = 0
            self.size += size
            self[part] = value
        return value
