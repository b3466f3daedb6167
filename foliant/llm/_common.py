"""Helpers shared by the training-data operators.

Words are runs of anything but the six ASCII white-space characters
(space, tab, line feed, vertical tab, form feed, carriage return); letters
are lower-cased in A-Z only, so that the JVM, Python and SQL forms agree.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_FOLDERS: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session under spark.checkpoint.dir, which every executor sees.

    Only where that setting is absent and all tasks run in this process (tests,
    local mode) is a folder of our own chosen: on a cluster it would be one
    disk an executor. The folder goes when the driver's Python ends.
    """
    for path, session in _FOLDERS.items():
        if session is spark:
            return path
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{root.rstrip('/')}/foliant-{uuid.uuid4().hex}"
    _FOLDERS[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for path, spark in _FOLDERS.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


#: Settings while a table is written: its shuffles are needed no longer then and go at once, not when the driver collects
#: garbage; and batches for Python hold few rows, as texts are long.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 24),
}


BROADCAST_IDS = 1_000_000  # rows of a number or two: some 16 MB


class Stage:
    """Written tables of one operator call: they cut lineage and survive lost executors.

    put() writes a DataFrame as Parquet in the shared folder and reads it
    back, and knows the rows written; drop() deletes tables that no returned
    DataFrame needs any more, clear() all. What a returned DataFrame reads
    stays until clear(spark) or the end of the driver's Python.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.n = 0
        self.where: dict[int, str] = {}
        self.counts: dict[int, int] = {}

    def put(self, df: DataFrame, random: bool = False) -> DataFrame:
        """df, written and read back. random: its bytes are mostly hashes, of which no dictionary is made."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        seen = Observation()
        before = {k: self.spark.conf.get(k, None) for k in WHILE_WRITING}
        for k, v in WHILE_WRITING.items():
            self.spark.conf.set(k, v)
        try:
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("parquet.enable.dictionary", str(not random).lower()).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.where[id(out)], self.counts[id(out)] = path, int(seen.get.get("n") or 0)
        out._stage = self  # keeps id(out) valid as long as the frame lives
        return out

    def rows(self, df: DataFrame) -> int:
        """The rows of a table that put() gave, of any stage."""
        return df._stage.counts[id(df)]

    def small(self, df: DataFrame) -> DataFrame:
        """A table that put() gave, to be broadcast if it has BROADCAST_IDS rows at most; for tables of a few numbers a row."""
        return F.broadcast(df) if self.rows(df) <= BROADCAST_IDS else df

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.where.pop(id(df), None):
                _delete(self.spark, path)

    def clear(self) -> None:
        self.where.clear()
        _delete(self.spark, self.path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that the operators of this session have written: for long sessions, when no result is read any more."""
    for path, session in list(_FOLDERS.items()):
        if session is spark:
            _delete(spark, path)


def carried(keep: Iterable[str], results: Iterable[str]) -> list[tuple[str, str]]:
    """(column, name in the result) of the columns to carry; a name that a result column has (in any case) gets the ending _in."""
    taken, out = {c.lower() for c in results}, []
    for c in keep:
        name = c
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        out.append((c, name))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """array<string> of the words of a text; null and blank give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def n_words(text: Column) -> Column:
    """The number of words; without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts_for(n_bytes: int, each: int, least: int) -> int:
    return max(least, -(-n_bytes // each))


# ---------------------------------------------------------------- NumPy side

_U = np.uint64
_RNG = np.random.RandomState(20240229)


def _odd(n: int) -> np.ndarray:
    return (_RNG.randint(0, 2**63, n, dtype=np.int64).astype(_U) << _U(1)) | _U(1)


#: Random values of bytes and odd multipliers of the rolling hashes.
BYTE_VALUES = _odd(256)
BASE = _odd(1)[0]
BASE_INVERSE = _U(pow(int(BASE), -1, 2**64))
MULTIPLIERS = _odd(16)
_SPACE_TABLE = np.zeros(256, dtype=bool)
_SPACE_TABLE[[9, 10, 11, 12, 13, 32]] = True
_LOWER_TABLE = np.arange(256, dtype=np.uint8)
_LOWER_TABLE[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1), modulo 2 ** 64."""
    key = "i" if inverse else "b"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        step = np.full(size, BASE_INVERSE if inverse else BASE, dtype=_U)
        step[0] = 1
        have = _POWERS[key] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = hash of bytes i..j times BASE ** i."""
    out = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(BYTE_VALUES[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), True)[start])


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about most_bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = string_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(batch.num_rows, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text (n + 1)."""
    blank = _SPACE_TABLE[data]
    before = np.ones(len(data), dtype=bool)
    before[1:] = blank[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = True
    starts = np.flatnonzero(~blank & before)
    after = np.ones(len(data), dtype=bool)
    after[:-1] = blank[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    after[last] = True
    ends = np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_names(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of each word (of its A-Z lower-cased form if fold) among the distinct ones, these, and the words before each text."""
    starts, ends, before = word_bounds(data, offsets)
    letters = data[~_SPACE_TABLE[data]]
    bounds = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    letters = _LOWER_TABLE[letters] if fold else letters
    named = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    return np.asarray(named.indices).astype(np.int64), named.dictionary, before


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """128 bits (two rows) of XXH3 of each word, and the words before each text."""
    number, distinct, before = word_names(data, offsets, fold)
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct.to_pylist())), dtype=_U).reshape(-1, 2)
    return both.T[:, number], before


def shingles(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted shingle hashes of each text, concatenated, and their offsets.

    A text with fewer words than width has its whole sequence as one shingle;
    one without words has none.
    """
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), dtype=_U)
    for k in range(width):
        rolled += hashes[k : n - width + 1 + k] * MULTIPLIERS[k]
    rolled = mix(rolled)
    counts = np.diff(before)
    out, sizes = [], np.zeros(len(counts), dtype=np.int64)
    for i, (at, count) in enumerate(zip(before[:-1].tolist(), counts.tolist(), strict=True)):
        if count >= width:
            own = np.sort(rolled[at : at + count - width + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif count:
            own = mix((hashes[at : at + count] * MULTIPLIERS[:count]).sum(dtype=_U, keepdims=True) + MULTIPLIERS[-1:] * _U(count))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return (np.concatenate(out) if out else np.zeros(0, dtype=_U)), offsets


def _renamed(keys: np.ndarray) -> np.ndarray:
    """0, 1, ... for the distinct keys, by first occurrence."""
    return np.asarray(pa.array(keys).dictionary_encode().indices).astype(np.int64)


def exact_shingles(column: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct word shingles of each text as sorted numbers: equal numbers are equal shingles within this column, without hashing.

    Names of shorter sequences are joined in pairs, and the pairs named anew.
    """
    number, _, before = word_names(*string_buffer(column), fold=True)
    counts, have, name = np.diff(before), 1, number
    while have < width:
        step = min(have, width - have)
        name = _renamed(name[: max(0, len(name) - step)] * (int(name.max(initial=0)) + 1) + name[step:])
        have += step
    out, short = [], {}
    for at, count in zip(before[:-1].tolist(), counts.tolist(), strict=True):
        if count >= width:
            out.append(np.unique(name[at : at + count - width + 1]))
        elif count:  # its whole sequence; never equal to a shingle of full width
            out.append(np.array([-1 - short.setdefault(tuple(number[at : at + count].tolist()), len(short))]))
        else:
            out.append(np.zeros(0, dtype=np.int64))
    return out


def jaccard_parts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted arrays without repeats."""
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared, len(a) + len(b) - shared


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), type=pa.int64())
