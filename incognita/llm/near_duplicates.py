"""MinHash near-duplicates: one-permutation hashing with optimal densification, bands, star-shaped candidates.

Every text becomes a set of word shingles. Texts with equal sets are one node. One hash per shingle fills the bins of
a one-permutation sketch; empty bins borrow from bins drawn by a sequence that is the same for all texts (optimal
densification). Bands of the sketch are buckets. In each bucket one node is the centre of a star, so a bucket of n nodes
gives n - 1 candidates. A bucket of more than `fan` nodes is a star of stars: it is dealt into parts of up to the square
root of its size (`fan` at least), each with a centre of its own, and the centres are the arms of one more star; so no
node has more than that many arms in a bucket, and no key of the joins behind is hotter. Candidates are confirmed on full
shingle sets, as hashes of 48 bits.

A star misses pairs of which neither is the centre. In buckets that hold several components, further stars are therefore
made for as long as they join a tenth of their arms: a bucket's nodes are dealt into parts, by another hash in each round,
and in each part the nodes outside the component that holds most of it are the arms of `centres` nodes of that one. Parts
are as small as those of a star of stars, so no node has more arms in a bucket than there. A completing step then takes
the nodes of buckets that still hold several components, and finds the similar pairs among them exactly: shingles are put
into one order, those that few of these nodes have first (counted in a table of fixed size, so counts may be too high, which changes the order but no
result); similar nodes share a shingle among the first few of each, and where they share it bounds their intersection.
Only pairs of different components are compared; of a shingle's nodes, those of the component that holds it most often are
not compared with one another. If many comparisons are ahead, the step goes by slices of the nodes: which nodes are
compared is fixed before the first slice, and components found in one slice spare later ones only the pairs they have
joined. No bucket is cut short.

Defined cases: null and empty texts have no shingles and no links. A text with fewer words than a shingle is one
shingle. A very long text is taken alone, whole; its set is its only row. Rows that repeat a doc_id are each returned and
linked by their texts. Of texts with equal sets the smallest doc_id stands for all. Rows without doc_id are returned with
a null component and kept. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.llm import session
from incognita.llm import text_arrays as ta

SKETCH = "doc_id long, n_shingles long, node binary, bands array<long>"
SETS = "nid long, shingles binary"
PREFIXES = "nid long, label long, shingle long, size int, place int"
#: Places of the table in which shingles are counted to order them: 2 MB, whatever the input.
SLOTS = 1 << 18


def shingle_sets(words: ta.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and where each text's begin."""
    hashes = words.hashes()
    grams = ta.gram_hashes(hashes, size)
    found, first = [], np.zeros(len(words.counts) + 1, dtype=np.int64)
    for i, n in enumerate(words.counts):
        a = words.first[i]
        if n >= size:
            own = np.sort(grams[a : a + n - size + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            own = ta.gram_hashes(hashes[a : a + n], int(n))
        else:
            own = hashes[:0]
        found.append(own)
        first[i + 1] = first[i] + len(own)
    return (np.concatenate(found) if found else hashes[:0]), first


def nodes(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes for each text that depend on its shingle set only."""
    out = np.empty((len(first) - 1, 2), dtype=ta.U64)
    for k, salt in enumerate((0x51, 0xA3C59AC2)):
        sums = np.zeros(len(shingles) + 1, dtype=ta.U64)
        np.cumsum(ta.mix(shingles + ta.U64(salt)), out=sums[1:])
        out[:, k] = ta.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(ta.U64))
    return out


def densified_sketch(shingles: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash in each bin, for each text with shingles; empty bins take that of a bin drawn for them."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    place = ((shingles >> ta.U64(32)) * ta.U64(bins)) >> ta.U64(32)
    place = place.astype(np.int64)
    lead = np.ones(len(shingles), dtype=bool)
    lead[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    sketch = np.zeros((n, bins), dtype=ta.U64)
    filled = np.zeros((n, bins), dtype=bool)
    sketch[text[lead], place[lead]] = ta.mix(shingles[lead])
    filled[text[lead], place[lead]] = True
    row, column = np.nonzero(~filled & (np.diff(first) > 0)[:, None])
    attempt = 0
    while len(row):
        drawn = ta.mix(column.astype(ta.U64) * ta.U64(0x100000001) + ta.U64(attempt << 20)) % ta.U64(bins)
        drawn = drawn.astype(np.int64)
        hit = filled[row, drawn]
        sketch[row[hit], column[hit]] = sketch[row[hit], drawn[hit]]
        row, column = row[~hit], column[~hit]
        attempt += 1
    return sketch


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    n, bins = sketch.shape
    rows = bins // bands
    out = np.zeros((n, bands), dtype=ta.U64)
    out += np.arange(1, bands + 1, dtype=ta.U64) * ta.U64(0xD6E8FEB86659FD93)
    parts = sketch[:, : rows * bands].reshape(n, bands, rows)
    for r in range(rows):
        out = ta.mix(out * ta.U64(ta.BASE) + parts[:, :, r])
    return out


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in ta.pieces(batches, "text"):
            shingles, first = shingle_sets(ta.Words(data, offsets, ta.SPACED_LOWER), size)
            counts = np.diff(first)
            keys = band_hashes(densified_sketch(shingles, first, bands * rows), bands)[counts > 0].ravel().view(np.int64)
            starts = np.concatenate(([0], np.cumsum((counts > 0) * bands)))
            node = ta.binaries(nodes(shingles, first).tobytes(), 16 * np.arange(len(first)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), node, ta.lists(keys, starts, pa.int64())], ["doc_id", "n_shingles", "node", "bands"])

    return run


def _packed_sets(size: int):
    """nid and its set's hashes cut to 48 bits, in ascending order; a text of the same doc_id with another set is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in ta.pieces(batches, "text"):
            shingles, first = shingle_sets(ta.Words(data, offsets, ta.SPACED_LOWER), size)
            own = nodes(shingles, first).view(np.uint8).reshape(-1, 16)
            wanted = np.frombuffer(b"".join(batch.column("node").to_pylist()), np.uint8).reshape(-1, 16)
            cut = (shingles >> ta.U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            sets = pa.RecordBatch.from_arrays([batch.column("nid"), ta.binaries(cut, 6 * first)], ["nid", "shingles"])
            yield sets.filter(pa.array((own == wanted).all(axis=1)))

    return run


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _unpacked(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows, their shingles one after another, and the row of each."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            raw = part.column("shingles").to_pylist()
            yield part, _unpack(b"".join(raw)), np.repeat(np.arange(len(raw)), [len(x) // 6 for x in raw])


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(SLOTS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, dtype=np.int64)
    for _, shingles, _ in _unpacked(batches):
        total += np.bincount(_slot(shingles), minlength=SLOTS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["slot", "n"])


def _prefixes(often: Broadcast, percent: int):
    """The first shingles of each set by how often they are met, as many as two similar sets must share one of.

    place counts from 1. Shingles that one node alone has keep their place but are no rows, as nothing can meet them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shingles, row in _unpacked(batches):
            times = often.value[_slot(shingles)]
            order = np.lexsort((shingles, times, row))
            shingles, times, row = shingles[order], times[order], row[order]
            size = np.bincount(row, minlength=part.num_rows)
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row] + 1
            least = -(-size * percent // 100)
            keep = (place <= (size - least + 1)[row]) & (times > 1)
            at, own = pa.array(row[keep]), row[keep]
            columns = [part.column("nid").take(at), part.column("label").take(at), pa.array(shingles[keep].astype(np.int64)), pa.array(size[own], pa.int32()), pa.array(place[keep], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["nid", "label", "shingle", "size", "place"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_sets, b_sets = batch.column("a_shingles"), batch.column("b_shingles")
            keep, known, last = [], None, None
            for i in range(batch.num_rows):
                raw, other = a_sets[i].as_py(), b_sets[i].as_py()
                # Sets so different in size cannot reach the similarity.
                if 100 * min(len(raw), len(other)) < percent * max(len(raw), len(other)):
                    keep.append(False)
                    continue
                if raw != last:
                    known, last = _unpack(raw), raw
                other = _unpack(other)
                at = np.searchsorted(known, other)
                both = int(np.count_nonzero(known[np.minimum(at, len(known) - 1)] == other))
                keep.append(100 * both >= percent * (len(known) + len(other) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def parts(n: str, fan: int) -> Column:
    """Into how many parts a bucket of n nodes is dealt: of up to fan nodes each, or the square root of n where that is more.

    Powers of two, so that buckets of about one size deal their nodes alike and their stars are much the same.
    """
    return F.expr(f"shiftleft(1L, cast(ceil(log2(greatest(1, {n} / greatest({fan}, sqrt({n}))))) as int))")


def star_edges(shared: DataFrame, fan: int) -> DataFrame:
    """Candidate pairs (a, b) of buckets: shared has bucket, nid, centre and n, the bucket's number of nodes."""
    near = shared.filter(F.col("n") <= fan).select(F.col("centre").alias("a"), F.col("nid").alias("b"))
    wide = shared.filter(F.col("n") > fan).withColumn("part", F.pmod(F.xxhash64("nid"), parts("n", fan)))
    inner = wide.groupBy("bucket", "part").agg(F.min("nid").alias("own"), F.min("centre").alias("centre"))
    arms = wide.select("bucket", "part", "nid").join(inner, ["bucket", "part"]).select(F.col("own").alias("a"), F.col("nid").alias("b"))
    return near.union(arms).union(inner.select(F.col("centre").alias("a"), F.col("own").alias("b"))).filter("a <> b").distinct()


def further_stars(named: DataFrame, centres: int, fan: int, turn: int) -> DataFrame:
    """Pairs (a, b) of nodes b of a bucket's part and some nodes a of the label that most of the part has.

    named has bucket, n, nid and label. Which nodes are centres goes by hashes of nid, so that buckets with much the same
    nodes have the same centres.
    """
    dealt = named.withColumn("part", F.pmod(F.xxhash64("nid", F.lit(-1 - turn)), parts("n", fan)))
    drawn = F.array(*[F.min_by("nid", F.xxhash64("nid", F.lit(j))) for j in range(centres)]).alias("drawn")
    by_label = dealt.groupBy("bucket", "part", "label").agg(F.count("*").alias("m"), drawn)
    most = by_label.groupBy("bucket", "part").agg(F.max_by(F.struct("label", "drawn"), F.struct("m", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    arms = dealt.join(most, ["bucket", "part"]).filter("label <> main.label")
    return arms.select(F.explode(F.array_distinct("main.drawn")).alias("a"), F.col("nid").alias("b")).distinct()


def components(tables: session.Tables, known: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """nid and label: the smallest nid that links (a, b), and those behind known's labels, lead to from each of known (nid, label).

    Labels flow along links; then a label that has met a smaller one anywhere is replaced by it everywhere, so the
    number of rounds grows with the logarithm of the longest chain.
    """
    both = tables.keep(links.union(links.select("b", "a")), f"{name}-both")
    labels, turn = known.select("nid", "label"), 0
    while True:
        heard = both.join(labels.select(F.col("nid").alias("b"), "label"), "b").groupBy(F.col("a").alias("nid")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "nid", "left").select("nid", F.least("label", "heard").alias("next"), F.col("label").alias("before"))
        near = tables.keep(near, f"{name}-near-{turn}")
        if near.filter("next <> before").isEmpty():
            tables.drop(f"{name}-both", *[f"{name}-{turn - 1}"] * bool(turn))
            return near.select("nid", F.col("next").alias("label"))
        # Nodes with one label, and the node that gave it its name, are of one component.
        met = near.filter("next < before").select(F.col("before").alias("next"), F.col("next").alias("jump")).union(near.filter("next < nid").select("nid", "next"))
        moved = tables.keep(met.groupBy("next").agg(F.min("jump").alias("jump")), f"{name}-moved-{turn}")
        labels = tables.keep(near.join(moved, "next", "left").select("nid", F.least("next", "jump").alias("label")), f"{name}-{turn}")
        tables.drop(f"{name}-near-{turn}", f"{name}-moved-{turn}", *[f"{name}-{turn - 1}"] * bool(turn))
        turn += 1


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 32, band_rows: int = 6, comparisons_per_slice: int = 200_000_000, fan: int = 64, centres: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    Sets linked: 100 * intersection >= percent * union. At 32 bands of 6 bins, texts of similarity 0.85 share no band
    with a probability of 3e-7, of 0.8 with 6e-5. comparisons_per_slice bounds the pairs looked at at once in the
    completing step, fan the arms of a star below which a bucket is one star; centres is the number of further stars in a part.
    """
    spark = docs.sparkSession
    session.prepare(spark)
    tables = session.Tables(spark, "near-duplicates")
    docs = session.columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sketched = tables.keep(docs.mapInArrow(_sketches(shingle_words, bands, band_rows), SKETCH), "sketched")
    with_id = sketched.filter("doc_id is not null and n_shingles > 0")
    # Nodes are numbered as they are written; the number is short where the set's hash is not.
    distinct = with_id.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))
    distinct = tables.keep(distinct.withColumn("nid", F.monotonically_increasing_id()), "distinct")
    members = distinct.select("nid", F.explode("bands").alias("bucket"))
    stars = tables.keep(members.groupBy("bucket").agg(F.min("nid").alias("centre"), F.count("*").alias("n")).filter("n > 1"), "stars")
    shared = tables.keep(members.join(stars, "bucket"), "shared")
    candidates = tables.keep(star_edges(shared, fan), "candidates")
    active = tables.keep(shared.select("nid").distinct().join(distinct.select("nid", "doc_id", "node"), "nid"), "active")
    texts = docs.join(active.select("doc_id", "nid", "node").hint("shuffle_hash"), "doc_id")
    sets = tables.keep(texts.select("text", "nid", "node").mapInArrow(_packed_sets(shingle_words), SETS), "sets")
    tables.drop("stars")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        left = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("a_shingles"))
        right = sets.select(F.col("nid").alias("b"), F.col("shingles").alias("b_shingles"))
        return tables.keep(pairs.join(right, "b").join(left, "a").select("a", "b", "a_shingles", "b_shingles").mapInArrow(_confirm(percent), "a long, b long"), name)

    links = confirmed(candidates, "links")
    known = components(tables, active.select("nid", F.col("nid").alias("label")), links, "labels")
    turn, asked, joined = 0, 1, 1
    while joined and 10 * joined >= asked:
        named = tables.keep(shared.filter("n > 2").select("bucket", "n", "nid").join(known, "nid"), f"named-{turn}")
        pairs = tables.keep(further_stars(named, centres, fan, turn), f"pairs-{turn}")
        found = confirmed(pairs, f"found-{turn}")
        asked, joined = (x.select("b").distinct().count() for x in (pairs, found))
        if joined:
            known = components(tables, known, found, f"labels-of-{turn}")
        tables.drop(f"pairs-{turn}", f"found-{turn}", *[f"named-{turn}"] * bool(joined))
        turn += 1
    if joined:
        named = tables.keep(shared.filter("n > 2").select("bucket", "n", "nid").join(known, "nid"), "named")
    mixed = named.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.first("n").alias("n")).filter("least <> most")
    # A bucket's nodes meet it part by part, so that no task gets all of a large one.
    mixed = tables.keep(mixed.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), parts("n", fan) - 1)).alias("part")), "mixed")
    dealt = named.withColumn("part", F.pmod(F.xxhash64("nid"), parts("n", fan)))
    apart = dealt.join(mixed, ["bucket", "part"], "left_semi").select("nid", "label").distinct()
    apart_sets = tables.keep(sets.join(apart, "nid").select("nid", "label", "shingles"), "apart-sets")
    tables.drop("candidates", "shared", "named" if joined else f"named-{turn - 1}")
    often = np.zeros(SLOTS, dtype=np.int64)
    # At most SLOTS pairs of numbers reach the driver.
    for row in apart_sets.select("shingles").mapInArrow(_counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        often[row.slot] = row.n
    prefixes = tables.keep(apart_sets.mapInArrow(_prefixes(spark.sparkContext.broadcast(often), percent), PREFIXES), "prefixes")
    tables.drop("apart-sets")

    # Which node asks at which shingle is settled once, by the labels before the first slice: of two nodes of different
    # components at least one asks at each shingle that they share. Later links only spare pairs that they have joined.
    by_label = prefixes.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    met = by_label.groupBy("shingle").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("n"))
    met = tables.keep(met.filter("labels > 1").select("shingle", "main", "n"), "met")
    asking = tables.keep(prefixes.join(met, "shingle").filter("label <> main").select("nid", "label", "shingle", "size", "place", "n"), "asking")
    # Of the shared shingles of two nodes, the first in both orders has only so many behind it.
    reachable = F.expr(f"q.label <> o.label and (100 + {percent}) * (1 + least(q.size - q.place, o.size - o.place)) >= {percent} * (q.size + o.size)")
    slices = -(-(asking.agg(F.sum("n")).first()[0] or 0) // comparisons_per_slice)

    def now(rows: DataFrame, at: int) -> DataFrame:
        return rows if at == 0 else rows.drop("label").join(known, "nid")

    for at in range(slices):
        queries = now(asking.filter(F.pmod(F.xxhash64("nid"), F.lit(slices)) == at), at)
        pairs = queries.alias("q").join(now(prefixes, at).alias("o"), (F.col("q.shingle") == F.col("o.shingle")) & reachable)
        pairs = pairs.select(F.least("q.nid", "o.nid").alias("a"), F.greatest("q.nid", "o.nid").alias("b")).distinct()
        more = confirmed(pairs, f"more-{at}")
        if not more.isEmpty():
            known = components(tables, known, more, f"labels-{at}")
    tables.drop("prefixes", "met", "asking", "sets", "links")

    least = tables.keep(known.join(active.select("nid", "doc_id"), "nid").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    named_all = distinct.select("nid", "node", "doc_id").join(known.join(least, "label").select("nid", "least"), "nid", "left").select("node", F.coalesce("least", "doc_id").alias("component_id"))
    linked = with_id.select("doc_id", "n_shingles", "node").join(named_all, "node").select("doc_id", "n_shingles", "component_id")
    alone = sketched.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
