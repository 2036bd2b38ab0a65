"""Token ids in binary files: frequency-ranked, variable-length by whole bytes, control bytes kept apart.

Ids are counted over all documents and ranked by falling frequency; the rank of an id takes one to four bytes. The
lengths of four ranks are two bits each of one control byte. Control bytes and data bytes stand in separate runs, so a
block is decoded by looking lengths up in a table of 256 rows and gathering bytes, without a loop over ids.

A file holds the documents of one range of doc_ids, in ascending order, in blocks, with the table from rank to id in
front, so each file is read alone. A task begins another file when one has FILE_BYTES, as files are read whole. Files are
written under the shared folder to a temporary name and then moved, so a task that runs twice leaves the same files. They
are read back with Spark's binaryFile source.

Texts are encoded once: the ids, as plain 16- or 32-bit numbers, are a table from which frequencies are counted and
which is sorted by doc_id in the place of the texts. Encoding uses the tokenizers library. Its normaliser and splitter
never look across ASCII white space, so a task has the library encode each distinct word once and reuses the ids; the ids
are those of the whole text.

Defined cases: null and empty texts give the end id only. A very long text is encoded alone and is one block. Rows that
repeat a doc_id stand side by side, ordered by a hash of the text. A row without doc_id comes first. Ids of equal
frequency are ranked by id. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from incognita.llm import session
from incognita.llm import text_arrays as ta

MAGIC = b"RANKIDS1"
BLOCK = "<qqqq"
PIECE_BYTES = 1 << 20
FILE_BYTES = 256 << 20
#: Words whose ids a worker keeps; beyond it, it starts afresh.
CACHED_WORDS = 2_500_000
JOINED = 256
#: Kinds of bytes that make pieces of a word: runs of letters, single digits, runs of other ASCII. The small letters of
#: Latin-1 are the bytes C3 A0 to C3 BF (but C3 B7). Other bytes, and what may begin a contraction or a special token,
#: leave the number of pieces unsure.
LETTER, DIGIT, OTHER, BETWEEN, UNSURE = range(5)
PIECE_KIND = np.full(256, UNSURE, dtype=np.uint8)
PIECE_KIND[ord("!") : 127] = OTHER
PIECE_KIND[ord("0") : ord("9") + 1] = DIGIT
PIECE_KIND[ord("A") : ord("Z") + 1] = UNSURE
PIECE_KIND[[*range(ord("a"), ord("z") + 1), 0xC3, *range(0xA0, 0xB7), *range(0xB8, 0xC0)]] = LETTER
PIECE_KIND[[ord("'"), ord("<")]] = UNSURE
PIECE_KIND[ord(" ")] = BETWEEN

_encoders: dict[int, "Encoder"] = {}


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(start - before, count)


class Encoder:
    """Ids of the texts of a batch, by way of the ids of their distinct words."""

    def __init__(self, definition: str):
        self.library = Tokenizer.from_str(definition)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.closes = np.zeros(self.size, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    @staticmethod
    def of(shared: Broadcast) -> "Encoder":
        definition = shared.value
        key = zlib.crc32(definition.encode())
        if key not in _encoders:
            _encoders[key] = Encoder(definition)
        return _encoders[key]

    def _clear(self) -> None:
        self.keys, self.start, self.count = np.empty(0, ta.U64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _one_by_one(self, words: list[str]) -> list[list[int]]:
        return [found.ids for found in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _library_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of each word's.

        Words whose number of pieces is plain from their bytes go many to a call. Each piece ends with a closing
        token, so the ids can be told apart; a call in which the numbers differ is repeated word by word.
        """
        raw = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
        kind = PIECE_KIND[raw]
        last = np.flatnonzero(kind == BETWEEN)
        first = np.concatenate(([0], last[:-1] + 1))
        begins = np.ones(len(raw), dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begins &= kind != BETWEEN
        pieces = np.add.reduceat(begins, first, dtype=np.int64)
        plain = np.add.reduceat(kind == UNSURE, first, dtype=np.int64) == 0
        place = np.flatnonzero(plain)
        groups = [place[i : i + JOINED] for i in range(0, len(place), JOINED)]
        found = self.library.encode_batch_fast([b" ".join([words[i] for i in g]).decode() for g in groups], add_special_tokens=False)
        parts, owners, again = [], [], np.flatnonzero(~plain).tolist()
        for group, ids in zip(groups, (np.array(f.ids, dtype=np.uint32) for f in found)):
            ends = np.flatnonzero(self.closes[ids]) + 1
            until = np.cumsum(pieces[group])
            if len(ends) == until[-1] and ends[-1] == len(ids):
                parts.append(ids)
                owners.append(np.repeat(group, np.diff(ends[until - 1], prepend=0)))
            else:
                again += group.tolist()
        single = self._one_by_one([words[i].decode("utf-8", "replace") for i in again])
        parts.append(np.array([i for ids in single for i in ids], dtype=np.uint32))
        owners.append(np.repeat(np.array(again, dtype=np.int64), [len(ids) for ids in single]))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(parts)[order], np.bincount(owner, minlength=len(words))

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        flat, counts = self._library_ids(words)
        starts = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate((self.flat, flat))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.count = np.insert(self.keys, at, keys), np.insert(self.start, at, starts), np.insert(self.count, at, counts)

    def distinct(self, data: np.ndarray, offsets: np.ndarray) -> tuple[ta.Words, np.ndarray, np.ndarray, np.ndarray]:
        """The words, their distinct place, and start and count in flat of each distinct word's ids."""
        # Lower-casing is part of the encoding, but the names of special tokens are matched before it.
        cased = b"<|" in data.tobytes()
        words = ta.Words(data, offsets, ta.SPACED if cased else ta.SPACED_LOWER)
        keys, first, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHED_WORDS:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), dtype=bool)
        if new.any():
            raw = data.tobytes() if cased else data.tobytes().lower()
            self._learn(keys[new], [raw[a:b] for a, b in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist())])
            at = np.searchsorted(self.keys, keys)
        return words, place, self.start[at], self.count[at]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id behind each text's, and the number of each text's."""
        words, place, start, count = self.distinct(data, offsets)
        ids = self.flat[_ragged(start[place], count[place])]
        counts = ta.per_text(count[place], words.first)
        return np.insert(ids, np.cumsum(counts), end), counts + 1


def _encoded(shared: Broadcast, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(shared)
        for batch, data, offsets in ta.pieces(batches, "text", PIECE_BYTES):
            ids, counts = encoder.encode(data, offsets, end)
            raw = ids.astype(kind)
            starts = np.concatenate(([0], np.cumsum(counts))) * raw.itemsize
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), ta.binaries(raw.tobytes(), starts)], ["doc_id", "tie", "ids"])

    return run


def _frequencies(size: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for _, data, _ in ta.pieces(batches, "ids", 16 * PIECE_BYTES):
            total += np.bincount(np.frombuffer(data, kind), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["id", "n"])

    return run


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    length = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = length
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    used = np.arange(4, dtype=np.uint8) <= length[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    end = np.cumsum(length, dtype=np.int64)
    start = end - length
    raw = np.frombuffer(data, dtype=np.uint8)
    ranks = raw[start].astype(np.uint32)
    for k in range(1, 4):
        long = np.flatnonzero(length > k)
        ranks[long] |= raw[start[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _writer(order: Broadcast, folder: str, kind: str, file_bytes: int):
    """Writes the files of a task; gives their names, which sort as the documents do, and their numbers of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_by_rank = order.value
        rank_of = np.zeros(int(ids_by_rank.max(initial=0)) + 1, dtype=np.uint32)
        rank_of[ids_by_rank] = np.arange(len(ids_by_rank))
        head = MAGIC + struct.pack("<q", len(ids_by_rank)) + ids_by_rank.astype("<u4").tobytes()
        context = TaskContext.get()
        names, totals, stream, written = [], [], None, 0
        files, path = pafs.FileSystem.from_uri(folder)
        temporary = f"{path}/_{context.partitionId()}.{context.taskAttemptId()}"

        def close() -> None:
            stream.close()
            files.move(temporary, f"{path}/{names[-1]}.bin")

        for batch, data, offsets in ta.pieces(batches, "ids", 4 * PIECE_BYTES):
            if stream is None:
                files.create_dir(path, recursive=True)
                stream, written = files.open_output_stream(temporary), 0
                stream.write(head)
                names.append(f"{context.partitionId():08d}-{len(names):06d}")
                totals.append(0)
            ids = np.frombuffer(data, kind)
            control, packed = pack(rank_of[ids])
            known = np.array(batch.column("doc_id").is_valid(), dtype=np.uint8)
            doc_ids = batch.column("doc_id").fill_null(0).to_numpy()
            counts = np.diff(offsets) // ids.itemsize
            parts = (struct.pack(BLOCK, batch.num_rows, len(ids), len(control), len(packed)), known.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), control, packed)
            for part in parts:
                stream.write(part)
            totals[-1] += len(ids)
            written += sum(map(len, parts))
            if written >= file_bytes:
                close()
                stream = None
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(totals, pa.int64())], ["name", "n_ids"])

    return run


def blocks(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, their validity, id counts and ids of each block of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    (size,) = struct.unpack_from("<q", content, 8)
    ids_by_rank = np.frombuffer(content, "<u4", size, 16)
    at = 16 + 4 * size
    while at < len(content):
        docs, n, controls, packed = struct.unpack_from(BLOCK, content, at)
        at += struct.calcsize(BLOCK)
        known = np.frombuffer(content, np.uint8, docs, at)
        doc_ids = np.frombuffer(content, "<i8", docs, at + docs)
        counts = np.frombuffer(content, "<i8", docs, at + 9 * docs)
        at += 17 * docs
        yield doc_ids, known, counts, ids_by_rank[unpack(content[at : at + controls], content[at + controls : at + controls + packed], n)]
        at += controls + packed


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """start counts from the beginning of the file."""
    for batch in batches:
        for content, name in zip(batch.column("content"), batch.column("name").to_pylist()):
            base = 0
            for doc_ids, known, counts, ids in blocks(content.as_py()):
                ends = np.cumsum(counts)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
                starts = base + ends - counts
                base += int(counts.sum())
                names = pa.array([name] * len(counts), pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(doc_ids, pa.int64(), mask=known == 0), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], ["name", "doc_id", "start", "n_tokens", "ids_crc32"])


def write_ids(docs: DataFrame, tokenizer_json: str, folder: str, end_id: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of docs (doc_id, text) to files in folder; gives (name, n_ids) of each file."""
    spark = docs.sparkSession
    tables = session.Tables(spark, "token-ids")
    docs = session.columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    shared = spark.sparkContext.broadcast(tokenizer_json)
    size = max(Encoder(tokenizer_json).size, end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    encoded = tables.keep(docs.mapInArrow(_encoded(shared, end_id, kind), "doc_id long, tie long, ids binary"), "ids")
    counted = encoded.select("ids").mapInArrow(_frequencies(size, kind), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # One row for each id of the vocabulary at most.
    ranked = np.array([r.id for r in counted.orderBy(F.desc("n"), "id").select("id").collect()], dtype=np.int64)
    order = spark.sparkContext.broadcast(ranked)
    placed = encoded.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = tables.keep(placed.select("doc_id", "ids").mapInArrow(_writer(order, folder, kind, file_bytes), "name string, n_ids long"), "manifest")
    tables.drop("ids")
    return manifest


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files that manifest lists, one row a file."""
    bases = manifest.select("name", F.coalesce(F.sum("n_ids").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        return spark.createDataFrame([], kind)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    named = files.select("content", F.regexp_extract("path", "([0-9]+-[0-9]+)\\.bin$", 1).alias("name"))
    # Contents are decoded where they are read; only the decoded rows meet the places of their files.
    decoded = named.mapInArrow(_reader, f"name string, {kind}")
    return decoded.join(bases, "name").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encodes, writes and reads back; see write_ids and read_ids."""
    spark = docs.sparkSession
    session.prepare(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    folder = f"{session.shared_folder(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    manifest = write_ids(docs, definition, folder, end_id)
    return read_ids(spark, folder, manifest)
