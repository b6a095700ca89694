"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slabspark.session import materialize

__all__ = ["fold", "let", "materialize", "mix", "slices", "table", "unused", "words"]

#: ASCII capitals to small letters, other bytes unchanged.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or that with underscores until no column of ``frames`` has it in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: str | None, lower: bool = True) -> list[bytes]:
    """UTF-8 words between the characters 0x20 and 0x09-0x0D; none for null."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: Iterable, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``most`` characters each, one text at least."""
    start, size = 0, 0
    i = -1
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n + 1
    if i >= start:
        yield start, i + 1
