"""Line deduplication through a sharded minimal perfect hash.

Documents give one 128-bit hash for each distinct key of their lines (stripped, lower-cased, long enough); Spark counts
documents and finds the largest doc_id per hash, adding up within each task before the shuffle. Hashes seen in two or
more documents are dealt to shards. For each shard a minimal perfect hash is built: levels of bit arrays, where a key
settles in the first level in which it collides with none, and the rank of its bit is its index into compact arrays of
fingerprints, document counts and largest doc_ids. A document's hashes then probe these arrays, a shard at a time; lines
are never joined with lines. A key outside the index is told by its fingerprint of 64 bits.

The number of shards follows the number of indexed keys, so a shard's arrays stay small. A shard's probes are salted by
document into groups of about probes_per_task, counted over all lines, indexed or not; each group meets its own copy of
the small arrays, so a line that a third of all documents hold is probed in many tasks. Lines are hashed once and their
hashes written.

Defined cases: a null or empty text is one empty line and loses nothing. Very long texts and lines are taken whole. A line
that stands in a document several times counts once, and all of its lines go or stay together. Rows that repeat a doc_id
count as one document and lose the same lines. Rows without doc_id lose nothing and are not counted. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incognita.llm import session

SPACE = b" \t\n\v\f\r"
HASHES = "doc_id long, h1 long, h2 long"
ARRAYS = "shard long, levels binary, bits binary, prints binary, counts binary, largest binary"


def line_key(line: bytes) -> bytes:
    """bytes.lower() changes A-Z only."""
    return line.strip(SPACE).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def key_hash(key: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(key)
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def _hashed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs: list[int] = []
            found: list[bytes] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
                keys = {line_key(x) for x in (text.as_py() or b"").split(b"\n") if len(x) >= least}
                own = [xxhash.xxh3_128_digest(k) for k in keys if long_enough(k, least)]
                found += own
                docs += [doc] * len(own)
            h = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "h1", "h2"])

    return run


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1.astype(np.uint64) + h2.astype(np.uint64) * np.uint64(2 * level + 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Indexes n distinct keys by 0 .. n - 1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.concatenate(([0], np.cumsum(bits)))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes: list[int] = []
        levels: list[np.ndarray] = []
        left = np.arange(len(h1))
        while len(left):
            size = 2 * len(left)
            at = _place(h1[left], h2[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, dtype=bool))

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The index of each key, some index or -1 for keys that were not built in."""
        out, left, base = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(h1[left], h2[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left, base = left[~hit], base + size
        return out


def _built(keys: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = keys["h1"].to_numpy(), keys["h2"].to_numpy()
    mph = PerfectHash.build(h1, h2)
    order = np.argsort(mph.index(h1, h2))
    packed = [h2[order], keys["n_docs"].to_numpy()[order], keys["largest"].to_numpy()[order]]
    return pd.DataFrame([[keys["shard"].iloc[0], np.array(mph.sizes, "<i8").tobytes(), np.packbits(mph.bits).tobytes(), *(x.astype("<i8").tobytes() for x in packed)]], columns=["shard", "levels", "bits", "prints", "counts", "largest"])


def _probed(least_docs: int):
    def run(probes: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if not len(arrays) or not len(probes):
            return pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "h1": pd.Series([], dtype="int64")})
        row = arrays.iloc[0]
        sizes = np.frombuffer(row["levels"], "<i8").tolist()
        mph = PerfectHash(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool))
        prints, counts, largest = (np.frombuffer(row[c], "<i8") for c in ("prints", "counts", "largest"))
        at = mph.index(probes["h1"].to_numpy(), probes["h2"].to_numpy())
        ok = (at >= 0) & (prints[at] == probes["h2"].to_numpy())
        ok &= (counts[at] >= least_docs) & (largest[at] != probes["doc_id"].to_numpy())
        return probes.loc[ok, ["doc_id", "h1"]]

    return run


def _cut(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist()):
                lines = (text or "").encode().split(b"\n")
                stay = lines
                if drop:
                    gone = set(drop)
                    stay = [x for x in lines if not (long_enough(k := line_key(x), least) and key_hash(k)[0] in gone)]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return run


def deduplicate_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, keys_per_shard: int = 200_000, probes_per_task: int = 500_000) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of each row of docs (doc_id, text).

    A key of at least least_chars code points that at least least_docs documents hold stays in the largest doc_id only.
    """
    spark = docs.sparkSession
    session.prepare(spark)
    tables = session.Tables(spark, "line-dedup")
    docs = session.columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    hashed = tables.keep(docs.filter("doc_id is not null").mapInArrow(_hashed(least_chars), HASHES), "hashes")
    counted = hashed.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("largest"))
    counted = tables.keep(counted.filter("n_docs > 1"), "counted")
    shards = max(1, -(-counted.count() // keys_per_shard))
    # A small input is dealt over as many tasks as the session shuffles to.
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-hashed.count() // probes_per_task))
    salts = -(-groups // shards)
    shard = F.pmod(F.col("h1"), F.lit(shards)).alias("shard")
    arrays = counted.select("*", shard).groupBy("shard").applyInPandas(_built, ARRAYS).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    probes = hashed.select("*", shard, F.pmod(F.xxhash64("doc_id", "h2"), F.lit(salts)).alias("salt"))
    dropped = probes.groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt")).applyInPandas(_probed(least_docs), "doc_id long, h1 long")
    lost = dropped.groupBy("doc_id").agg(F.collect_set("h1").alias("drop"))
    return docs.join(lost.hint("shuffle_hash"), "doc_id", "left").mapInArrow(_cut(least_chars), "doc_id long, n_lines long, n_dropped long, kept_text string")
