"""Helpers that the training-data operators share: shared storage, Arrow blocks, word hashes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words wherever an operator speaks of words: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a vectorised step handles at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and is local (tests, one machine) is a temporary one made and
    set; on a cluster that would be a folder of the driver alone, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    os.makedirs("/tmp/checkpoints", exist_ok=True)
    own = tempfile.mkdtemp(prefix="millrace-", dir="/tmp/checkpoints")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}/rdd")
    return f"file://{own}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Makes ``DataFrame.checkpoint()`` usable."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


_folders: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder, for intermediate data."""
    path = f"{shared_dir(spark).rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes the intermediate data that operators have written so far, and says how many folders went.
    For services that run long: to be called once results are written, as they are read from it."""
    gone = 0
    while _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names for an operator's own columns that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return tuple(out)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as (id, th, text): ``th`` tells rows apart that share an id but not a text.

    Only the two columns named are taken, so no other column can clash with an operator's own.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))


#: What a worker process keeps from task to task of one kind (such as encoders with their caches).
worker_state: dict[str, dict] = {}


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``most`` bytes together, one row at least.

    Workers serve one operator after another: what others than ``keeps`` have kept in
    ``worker_state`` is let go first.
    """
    for kind in [k for k in worker_state if k != keeps]:
        del worker_state[kind]
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
        chunk = (np.cumsum(lengths) - lengths) // most
        starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


# --- word hashes -----------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(str(base))
    if got is None or len(got) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        got = np.full(size, base, np.uint64)
        got[0] = 1
        _powers[str(base)] = got = np.cumprod(got, dtype=np.uint64)
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(texts: list[str], separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the offsets at which each text's words begin
    (one more than texts). Words are runs of UTF-8 bytes that aren't separators.

    A word's hash is a polynomial in its bytes, taken from prefix sums over the whole block, so
    that no Python runs per word. Equal words have equal hashes in every task.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    first, size = 0, 0

    def flush(upto: int) -> None:
        data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        for h, ends in _hash_block(data, separators):
            hashes.append(h)
            limits = np.cumsum([len(g) + 1 for g in group])
            counts[first:upto] += np.bincount(np.searchsorted(limits, ends, side="left"), minlength=len(group))[: len(group)]

    for k, t in enumerate(texts):
        data = t.encode("utf-8", "surrogatepass")
        if group and size + len(data) > 2 * BLOCK_BYTES:
            flush(k)
            group, first, size = [], k, 0
        group.append(data)
        size += len(data) + 1
    if group:
        flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.r_[0, np.cumsum(counts)]


def _hash_block(data: np.ndarray, separators: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and end positions, by pieces of bounded size that end at a separator."""
    space = separators[data]
    gaps = np.flatnonzero(space)
    at = 0
    while at < len(data):
        upto = len(data)
        if upto - at > 4 * BLOCK_BYTES:
            k = np.searchsorted(gaps, at + 4 * BLOCK_BYTES)
            upto = int(gaps[k]) + 1 if k < len(gaps) else len(data)
        s = space[at:upto]
        edge = np.diff(np.r_[True, s, True].astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        n = upto - at
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[at:upto].astype(np.uint64) + np.uint64(1)) * _power(_BASE, n)[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64)
        yield mix(h), ends + at
        at = upto


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that stay inside one text, and their word positions in ``words``."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    at = np.flatnonzero(np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n) >= width)
    return mix(h[at]), at
