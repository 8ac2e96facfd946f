"""Words, hashes and Arrow plumbing that the operators of this folder share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(1_789)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]                       # A-Z hash as a-z
#: Bytes that separate words: white space, or all ASCII but letters and digits.
SPACE = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))
NO_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_BASE = int(_RNG.integers(0, 1 << 64, dtype=np.uint64)) | 1
_STEPS = _RNG.integers(0, 1 << 64, 32, dtype=np.uint64) | np.uint64(1)
#: Values of bytes that tell A-Z from a-z.
CASED = _BYTE.copy()
CASED[65:91] = _RNG.integers(0, 1 << 64, 26, dtype=np.uint64)
PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n - 1."""
    if n > len(_powers.up):
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            setattr(_powers, name, np.cumprod(steps, dtype=np.uint64))
    return _powers.up, _powers.down


_powers.up = _powers.down = np.empty(0, np.uint64)


def word_places(column: pa.Array, separators: np.ndarray = SPACE
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a column of texts, where each word starts and stops, and where texts end.

    The last are n + 1 places; those of text k are ``ends[k]`` to ``ends[k + 1]``.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    none = np.empty(0, np.int64)
    if not n or ends[-1] == ends[0]:
        return np.empty(0, np.uint8), none, none, np.zeros(n + 1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    blank = separators[raw]
    first = np.ones(len(raw) + 1, bool)             # does a word that stands here start here?
    first[1:-1] = blank[:-1]
    first[ends] = True
    starts = np.flatnonzero(first[:-1] & ~blank)
    stops = np.flatnonzero((np.append(blank[1:], True) | first[1:]) & ~blank) + 1
    return raw, starts, stops, ends


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray,
                values: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of words, A-Z as a-z unless ``values`` is ``CASED``.

    A hash is the difference of two running sums of a polynomial in a random odd base over random
    values of bytes, so no word becomes an object.
    """
    hashes, done = np.empty(len(starts), np.uint64), 0
    while done < len(starts):                       # pieces of whole words bound the memory
        low = starts[done]
        upto = max(done + 1, int(np.searchsorted(stops, low + PIECE, "right")))
        size = int(stops[upto - 1] - low)
        up, down = _powers(max(size, PIECE))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values[raw[low:low + size]] * up[:size], out=sums[1:])
        s, e = starts[done:upto] - low, stops[done:upto] - low
        hashes[done:upto] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        done = upto
    return hashes


def hashed_words(column: pa.Array, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a column, A-Z as a-z, and where each text ends.

    Returns the hashes one after the other and n + 1 bounds: those of text k are
    ``hashes[bounds[k]:bounds[k + 1]]``.
    """
    raw, starts, stops, ends = word_places(column, separators)
    return word_hashes(raw, starts, stops), np.searchsorted(starts, ends)


def by_size(batch: pa.RecordBatch, column: str = "text", limit: int = 8 << 20
            ) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or of one row."""
    sizes = pc.binary_length(batch[column].cast(pa.large_binary())).fill_null(0).to_numpy(False)
    done, start = np.append(0, np.cumsum(sizes)), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(done, done[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def run_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of runs of consecutive word hashes, given where each starts and ends (exclusive)."""
    up, down = _powers(len(words) + 1)
    sums = np.append(np.uint64(0), np.cumsum(words * up[:len(words)], dtype=np.uint64))
    return mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` consecutive word hashes; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0 or size <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] + np.uint64(size)
    for k in range(1, size):
        total = (total ^ (total >> np.uint64(29))) * _STEPS[k % len(_STEPS)] + words[k:k + n]
    return mixed(total)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one has none."""
    if 0 < len(words) < size:
        return gram_hashes(words, len(words))
    return np.unique(gram_hashes(words, size))


def over_arrow(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], Sequence[Sequence]],
               step: int = 512) -> DataFrame:
    """Map a DataFrame in small Arrow batches; ``rows`` returns one sequence per output column."""
    types = _arrow_schema(schema)
    importable(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                columns = rows(whole.slice(start, step))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, types, strict=True)],
                    schema=types)

    return df.mapInArrow(run, schema)


def through_arrow(df: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch],
                  step: int = 512) -> DataFrame:
    """Filter or change rows in small Arrow batches; all columns go through as they are."""
    importable(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                yield change(whole.slice(start, step))

    return df.mapInArrow(run, df.schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def importable(spark: SparkSession) -> None:
    """Let Python workers that see this folder import the package from it.

    Clusters without a shared installation get the package by ``--py-files``, as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder, ``spark.checkpoint.dir``.

    Where that is unset, a local session's own warehouse folder serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/llm-scratch")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to shared storage and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
