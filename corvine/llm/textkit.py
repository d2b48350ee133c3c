"""Shared pieces of the training-data operators: Arrow text access, hashing, tokenising.

Texts reach Python as Arrow batches. They are handled as one flat byte buffer with offsets,
cut into chunks of whole documents, so that numpy works on about a megabyte at a time and the
memory of a task depends on the longest single document, not on the batch.
"""

from __future__ import annotations

import ctypes
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None
#: Bytes of text that one numpy pass handles, unless a single document is longer.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240611))
#: One random odd 64-bit value for each byte, and two odd bases with their inverses mod 2**64.
BYTE_VALUE = (_rng.integers(0, 2**63, size=(2, 256), dtype=np.uint64) << U64(1)) | U64(1)
BASES = [int(x) | 5 for x in _rng.integers(2**40, 2**63, size=2, dtype=np.uint64)]
BASES = [b if b % 2 else b + 1 for b in BASES]
INVERSES = [pow(b, -1, 1 << 64) for b in BASES]

#: The separators of the word contracts: space and the controls from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters for the lexical models: ASCII letters and every byte of a multi-byte character.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches_of(batches, column: int, rows: int = 512, size: int = 16 << 20):
    """Slices of Arrow batches with at most `rows` rows and, but for a single longer one, `size` bytes in a text
    column, so that what a worker makes of a batch stays small whatever the session's batch settings are."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        _, off = flat(batch.columns[column])
        a = 0
        while a < n:
            b = min(max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1), a + rows, n)
            yield batch.slice(a, b - a)
            a = b


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of our own where the setting is absent, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="corvine-ckpt-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut lineage through a checkpoint in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    return df.checkpoint(eager=True)


def text_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, modulus: int):
    """crc32 of the decimal text of a column, modulo; NULL ids count as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % modulus


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], kind, n + 1, column.offset * width).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lens = np.where(np.asarray(column.is_valid()), np.diff(off), 0)
        if lens.sum() != off[-1] - off[0]:  # bytes below a NULL: copy the valid ones
            keep = np.repeat(np.asarray(column.is_valid()), np.diff(off))
            data, off = data[off[0] : off[-1]][keep], np.concatenate(([0], np.cumsum(lens)))
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges [a, b) of documents with at most limit bytes, or one longer document."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Powers:
    """Tables of base**i and base**-i mod 2**64, for either lane, that grow with the longest chunk seen."""

    def __init__(self) -> None:
        self.up: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
        self.down: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

    def need(self, n: int, lane: int = 0) -> None:
        if n <= len(self.up[lane]):
            return
        n = -(-n // (1 << 17)) << 17
        self.up[lane], self.down[lane] = self._table(BASES[lane], n), self._table(INVERSES[lane], n)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.empty(n, U64)
        out[0] = 1
        have = 1
        while have < n:
            step = min(have, n - have)
            out[have : have + step] = out[:step] * U64(pow(base, have, 1 << 64))
            have += step
        return out


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Position-independent hash of values[s:e] for each range, from one prefix sum."""
    POWERS.need(len(values) + 1, lane)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * POWERS.up[lane][: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * POWERS.down[lane][starts])


#: Bytes of a word that a polynomial may hash; longer ones can differ in patterns that cancel out modulo 2**64.
SHORT_WORD = 32


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of the words data[s:e]: range_hashes of their bytes, and BLAKE2b for long words."""
    out = range_hashes(BYTE_VALUE[lane][data], starts, ends, lane)
    long = np.flatnonzero(ends - starts > SHORT_WORD)
    raw = data.tobytes() if len(long) else b""
    for k, s, e in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        out[k] = int.from_bytes(hashlib.blake2b(raw[s:e], digest_size=8, person=b"lane%d" % lane).digest(), "little")
    return out


def rolling_hashes(values: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """range_hashes of every range of one width."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    POWERS.need(len(values) + 1, lane)
    total = np.zeros(len(values) + 1, U64)
    np.multiply(values, POWERS.up[lane][: len(values)], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    h = total[width:] - total[:n]
    h *= POWERS.down[lane][:n]
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def spans(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes inside documents: starts, ends, and runs before each document."""
    n = len(member)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, member[:-1]
    starts = np.flatnonzero(member & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, member[1:]
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between separators: starts, ends, and the number of words before each document."""
    return spans(~IS_SPACE[data], off)


def sha256_hex(piece: bytes | memoryview) -> str:
    return hashlib.sha256(piece).hexdigest()


def pack(a: np.ndarray) -> bytes:
    """A compact binary form of an array for shuffles."""
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


def release() -> None:
    """Give memory that a group of rows has used back to the system, as a worker lives on for many groups."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)
