"""Token-id files: independent zstandard frames, a seek table with checksums, and a document index.

A file is a run of zstandard frames followed by two skippable frames, so that ``zstd -d`` decodes
the whole to the plain ids (little-endian, unsigned, 16 bits if the vocabulary fits, else 32):

* a document index (skippable, magic 0x184D2A50): a zstandard frame that holds the bytes of an id
  and, per document, its id, its number of ids, the crc32 of these as 32-bit integers, and the
  frame and the place in it where they begin;
* the seek table (skippable, magic 0x184D2A5E): per frame the compressed size, the plain size and
  the low 32 bits of the plain bytes' XXH64; then the number of frames, a flag byte 0x80 (there are
  checksums), and the magic number 0x8F92EAB1.

A reader takes the last bytes, then the two tables, then only the frames it needs.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, shared_dir, texts_of, worker_state

END_ID = 2
#: Plain bytes after which a frame ends; a document is never split over frames.
FRAME = 1 << 18
#: Rows of documents for each file.
FILE_ROWS = 20_000
_SKIP_INDEX, _SKIP_SEEK, _SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n_tokens", "<u8"), ("ids_crc32", "<u4"), ("frame", "<u4"), ("at", "<u8")])

#: Pieces of texts that a worker remembers with their ids, in each of two generations: when the
#: young one is full it becomes the old one, and only what is met again moves on.
CACHE = 400_000
#: Bytes of texts that are encoded together, so that what they share is looked up once.
BLOCK = 1 << 21
#: A space before something that isn't space begins a new piece of the pre-tokenizer.
_ODD = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")
#: The byte-level pre-tokenizer's pieces (fixed by the format).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_UNSURE = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as they are,
    the others as the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class Encoder:
    """Encodes texts with a file of the tokenizers library.

    For byte-level BPE, the pre-tokenizer always begins a piece at a space that is followed by
    something else than space, and merges never cross pieces; so a text's ids are the ids of the
    parts between such places. Of a block of texts each part is looked at once; parts are cut into the
    pieces of the pre-tokenizer, each worker keeps the pieces it has met, and the model encodes
    a block's other pieces in one call. Texts that hold an added token of the file (such as an
    end mark written out) are encoded whole by the library, which takes these out first; so are all
    texts where the file is of another kind.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in made.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        before = made.get("pre_tokenizer") or {}
        self.by_parts = made.get("normalizer") is None and made["model"]["type"] == "BPE" and not made["model"].get("dropout") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.model = self.tokenizer.model
        self.letter = np.array([ord(c) for _, c in sorted(byte_letters().items())], "<u4")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        if self.by_parts:
            self.model._resize_cache(0)  # pieces are kept here
            self.lines = Tokenizer(self.model)
            self.lines.pre_tokenizer = CharDelimiterSplit("\n")
            vocabulary = made["model"]["vocab"]
            self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
            self.lengths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def fresh(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that aren't known, by one call of the model: letters never hold the line end that
        is put between pieces, and the ids' lengths in letters tell where each piece ends."""
        data = np.frombuffer("".join(pieces).encode("utf-8", "replace"), "u1")
        begins = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        wanted = begins[np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))]
        lines = np.insert(self.letter[data], wanted, 10).tobytes().decode("utf-32-le")
        ids = np.array(self.lines.encode_batch_fast([lines], add_special_tokens=False)[0].ids, f"<u{self.width}")
        ends = np.cumsum(self.lengths[ids])
        stops = np.searchsorted(ends, wanted) + 1
        if not len(ends) or stops[-1] != len(ends) or (ends[stops - 1] != wanted).any():  # a vocabulary that drops or adds letters
            return [self.pack([t.id for t in self.model.tokenize(p)]) for p in lines.split("\n")[:-1]]
        raw, places = ids.tobytes(), (np.r_[0, stops] * self.width).tolist()
        return [raw[start:stop] for start, stop in zip(places, places[1:], strict=False)]

    def known(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, kept for when they are met again."""
        young, old = self.young, self.old
        got = list(map(young.get, pieces))
        lacking = {p for p, ids in zip(pieces, got, strict=True) if ids is None}
        if not lacking:
            return got
        new = []
        for p in lacking:
            ids = old.get(p)
            if ids is None:
                new.append(p)
            else:
                young[p] = ids
        if new:
            young.update(zip(new, self.fresh(new), strict=True))
        return [young[p] if ids is None else ids for p, ids in zip(pieces, got, strict=True)]

    def cut(self, parts: list[str]) -> tuple[list[str], list[int]]:
        """The pieces of parts that begin with a space and something else, and how many each part has. They are cut
        all at once, as between two of them a piece ends. A part where libraries differ in what is space counts
        as a piece, with the ids that the library gives for the whole of it."""
        joined = "".join(parts)
        if not _UNSURE.search(joined):
            pieces = (_ASCII_PIECES if joined.isascii() else _PIECES).findall(joined)
            stops = np.searchsorted(np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))) + 1
            return pieces, np.diff(stops, prepend=0).tolist()
        pieces, counts = [], []
        for p in parts:
            own = [p] if _UNSURE.search(p) else _PIECES.findall(p)
            if _UNSURE.search(p):
                self.young[p] = self.whole(p)
            pieces += own
            counts.append(len(own))
        return pieces, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, without an end id, little-endian in ``width`` bytes each."""
        if not self.by_parts:
            return [self.whole(t) for t in texts]
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        out, plain, odd = [b""] * len(texts), [], []
        for k, t in enumerate(texts):
            if self.added and self.added.search(t):
                out[k] = self.whole(t)
            elif t:
                (odd if _ODD.search(t) else plain).append(k)
        # parts without the space before them, numbered; a text's first part has none and a number of its own
        even, uneven = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " "), [_CUT.split(texts[k]) for k in odd]
        words = pa.concat_arrays([even.flatten(), pa.array([p for parts in uneven for p in parts], pa.large_string())]).dictionary_encode()
        codes, names = np.array(words.indices), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        bounds = np.cumsum(np.r_[0, np.diff(np.array(even.offsets)), np.array([len(parts) for parts in uneven], np.int64)])
        first, at_first = np.unique(codes[bounds[:-1]], return_inverse=True)
        codes[bounds[:-1]] = len(names) + at_first
        # words are one piece each; of other parts the pieces are found
        is_word = np.fromiter(map(str.isalpha, names), bool, len(names))
        pieces = [" " + p for p, one in zip(names, is_word.tolist(), strict=True) if one]
        is_ascii = np.fromiter(map(str.isascii, names), bool, len(names)) & ~is_word
        groups = [np.flatnonzero(is_ascii), np.flatnonzero(~is_ascii & ~is_word)]
        others = [self.cut([" " + names[c] for c in group.tolist()]) for group in groups]
        others += [self.cut([names[c]]) if names[c] else ([], [0]) for c in first.tolist()]
        order = np.r_[np.flatnonzero(is_word), *groups, len(names) + np.arange(len(first))]
        counts = np.array([1] * len(pieces) + [n for _, own in others for n in own], np.int64)
        ids = self.known(pieces + [p for own, _ in others for p in own])
        # where the ids of each part begin, and how many they are
        places = np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))] // self.width
        starts, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        stops = np.cumsum(counts)
        starts[order], sizes[order] = places[stops - counts], places[stops] - places[stops - counts]
        each = sizes[codes]
        ends = np.r_[0, np.cumsum(each)]
        place = np.int32 if max(ends[-1], places[-1]) < 1 << 31 else np.int64
        raw = np.frombuffer(b"".join(ids), f"<u{self.width}")[np.arange(ends[-1], dtype=place) + np.repeat((starts[codes] - ends[:-1]).astype(place), each)].tobytes()
        ends = (ends[bounds] * self.width).tolist()
        for k, start, stop in zip(plain + odd, ends, ends[1:], strict=False):
            out[k] = raw[start:stop]
        return out


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file, for as long as the worker encodes."""
    kept = worker_state.setdefault("tokens", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def as_u4(ids: bytes, width: int) -> np.ndarray:
    """Stored ids as unsigned 32-bit integers."""
    return np.frombuffer(ids, "<u2").astype("<u4") if width == 2 else np.frombuffer(ids, "<u4")


def crc_of(ids: bytes, width: int) -> int:
    """The crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(as_u4(ids, width))


# --- the file format ---------------------------------------------------------------------------


class Writer:
    """Writes one file; ``add`` documents in order, then ``close``."""

    def __init__(self, sink, width: int = 4, frame: int = FRAME, level: int = 3) -> None:
        self.sink, self.width, self.frame = sink, width, frame
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[bytes] = []
        self.size, self.frames, self.index = 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is None, len(ids) // self.width, crc_of(ids, self.width), len(self.frames), self.size // self.width))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame:
            self._end()

    def _end(self) -> None:
        plain = b"".join(self.held)
        packed = self.pack.compress(plain)
        self.sink.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> int:
        if self.held:
            self._end()
        index = self.pack.compress(bytes([self.width]) + np.array(self.index, _INDEX).tobytes())
        self.sink.write(struct.pack("<II", _SKIP_INDEX, len(index)) + index)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _SEEK_MAGIC)
        self.sink.write(struct.pack("<II", _SKIP_SEEK, len(seek)) + seek)
        return sum(f[1] for f in self.frames) // self.width


class Reader:
    """Reads documents of one file; decompresses only the frames that hold them."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        foot = self._at(size - 9, 9)
        frames, flags, magic = struct.unpack("<IBI", foot)
        if magic != _SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums")
        head = size - 9 - 12 * frames - 8
        table = np.frombuffer(self._at(head + 8, 12 * frames), "<u4").reshape(-1, 3)
        self.frames = table
        self.starts = np.r_[0, np.cumsum(table[:, 0], dtype=np.int64)]
        magic, length = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if magic != _SKIP_INDEX:
            raise ValueError("no document index")
        index = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[-1]) + 8, length))
        self.width, self.index = index[0], np.frombuffer(index, _INDEX, offset=1)
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            plain = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.frames[k, 0])))
            if len(plain) != self.frames[k, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.last = k, plain
        return self.last[1]

    def ids(self, row: int) -> bytes:
        e = self.index[row]
        first = self.width * int(e["at"])
        return self.frame(int(e["frame"]))[first : first + self.width * int(e["n_tokens"])]

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        for row in range(len(self.index)) if rows is None else rows:
            e = self.index[row]
            yield None if e["null"] else int(e["doc_id"]), self.ids(row)


# --- on Spark ------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, order: list | None = None) -> DataFrame:
    """Writes all documents as token-id files in ascending order and returns the files:
    (file, path, n_docs, first): ``first`` counts the ids of all files before it.

    Rows are range-partitioned and sorted by ``order`` (the id if none is given, then the text's
    hash, nulls first), one file a partition. A null text counts as empty (the end id alone);
    repeated rows are written as often as they occur. An empty table writes no file. Only id and
    text are read. A task writes under a name of its own and renames at the end, so a task that
    is run again leaves one whole file. Of the corpus, only one row a file reaches the driver.
    """
    spark = docs.sparkSession
    folder = (folder or f"{shared_dir(spark).rstrip('/')}/millrace-tokens-{uuid.uuid4().hex}").rstrip("/")
    files = max(1, -(-docs.count() // FILE_ROWS))
    keys = order or [F.col(id_col)]
    rows = docs.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.xxhash64(text_col).alias("tie"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    by = [f"k{i}" for i in range(len(keys))] + ["tie"]
    rows = rows.repartitionByRange(files, *by).sortWithinPartitions(*by).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, made = f"part-{part:06d}.ids.zst", f"{root}/.attempt-{part}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        own, n, writer, sink = encoder(tokenizer), 0, None, None
        end = end_id.to_bytes(own.width, "little")
        for batch in blocks(batches, most=BLOCK, keeps="tokens"):
            if writer is None:
                sink = fs.open_output_stream(made)
                writer = Writer(sink, own.width)
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(texts_of(batch)), strict=True):
                writer.add(doc_id, ids + end)
                n += 1
        if writer is not None:
            total = writer.close()
            sink.close()
            fs.move(made, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [part], "name": [name], "n_docs": [n], "n_ids": [total]}, pa.schema([("file", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    done = sorted(rows.mapInArrow(run, "file int, name string, n_docs long, n_ids long").collect())
    out, first = [], 0
    for file, name, n_docs, n_ids in done:
        out.append((file, f"{folder}/{name}", n_docs, first))
        first += n_ids
    return spark.createDataFrame(out, "file int, path string, n_docs long, first long")


def read_index(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its ids as the files give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as source:
                    ids, start, out = Reader(source), first, []
                    for doc_id, got in ids.documents():
                        out.append((doc_id, start, len(got) // ids.width, crc_of(got, ids.width)))
                        start += len(got) // ids.width
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.select("path", "first", "file").repartitionByRange(n, "file").select("path", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(files: DataFrame, wanted: Iterable[int]) -> DataFrame:
    """(doc_id, ids) of the documents wanted: a file's other frames aren't decompressed."""
    asked = np.unique(np.fromiter(wanted, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as source:
                    reader = Reader(source)
                    rows = np.flatnonzero(np.isin(reader.index["doc_id"], asked) & (reader.index["null"] == 0))
                    for doc_id, ids in reader.documents(rows.tolist()):
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([as_u4(ids, reader.width).astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return files.select("path").mapInArrow(run, "doc_id long, ids array<long>")


def default_tokenizer(spark: SparkSession | None = None) -> str:
    """Where the public byte-level vocabulary is on this machine; any path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
