"""What several operators need: exact column choice, settled tables, words."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from clickloom.sources.scratch import fresh_folder

# A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
# bytes.split() without arguments splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pick(frame: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the given names: ``pick(df, text="body")``.

    Columns are found by exact spelling, the first of several alike, so that
    extra columns differing in case only, or named twice, do no harm.
    """
    names = list(frame.columns)
    numbered = frame.toDF(*[f"_{i}" for i in range(len(names))])
    return numbered.select(*[F.col(f"_{names.index(source)}").alias(name) for name, source in wanted.items()])


def numbered(frame: DataFrame, **wanted: str) -> tuple[DataFrame, list[str]]:
    """All columns as ``_0, _1, …`` plus copies of the wanted ones under the given names.

    Whoever returns whole rows selects ``restore`` of the second value.
    """
    names = list(frame.columns)
    plain = frame.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select("*", *[F.col(f"_{names.index(s)}").alias(n) for n, s in wanted.items()]), names


def restore(frame: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``_0, _1, …`` under their old names again."""
    return frame.select(*[f"_{i}" for i in range(len(names))]).toDF(*names)


def settle(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and no lineage before it.

    Executors lost later cost no recomputation of what led here. It also lets
    Spark split a skewed join: that needs plain shuffles on both sides, so an
    aggregate that is joined on its own key is settled first. A settled side has
    a known size too, and is broadcast only if that is small.
    """
    folder = fresh_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def row_hash(frame: DataFrame, columns: list[str]) -> Column:
    """A hash of whole rows, whatever their types: maps, which have no hash, go in as JSON, sorted by key."""

    def has_map(kind: DataType) -> bool:
        if isinstance(kind, StructType):
            return any(has_map(field.dataType) for field in kind)
        return isinstance(kind, (MapType, VariantType)) or isinstance(kind, ArrayType) and has_map(kind.elementType)

    def hashable(name: str) -> Column:
        kind = frame.schema[name].dataType
        if not has_map(kind):
            return F.col(name)
        value = F.col(name)
        if isinstance(kind, MapType) and not has_map(kind.keyType):
            entries = F.map_entries(name)
            # Entries with values that cannot be compared stay as they are.
            value = entries if has_map(kind.valueType) else F.array_sort(entries)
        return F.to_json(F.struct(value.alias("value")))

    return F.xxhash64(*map(hashable, columns))


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in order, in lists from about ``size`` bytes each."""
    at = 0
    while len(data) - at > size:
        cut = _SPACE.search(data, at + size)
        if cut is None:
            break
        yield data[at:cut.start()].split()
        at = cut.end()
    yield (data[at:] if at else data).split()
