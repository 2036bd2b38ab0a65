"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the smallest (the rightmost of equal ones) is kept as a fingerprint.
With k-grams of k words and windows of w k-grams, any span of k + w - 1 words that an item and a document share gives
both the same fingerprint at the same place in the span, so nothing that long is missed. Fingerprints of documents are
joined with those of the benchmark, and hits are extended to both sides: each window of k + w - 1 words around a hit is
looked up among the items' windows by its hash of 64 bits. Only spans of whole item windows count. A word or a passage
that is repeated very often in a text and in an item costs a look-up for each of the text's words and no more.

The benchmark's fingerprints go to all tasks as one block where they are few, which is checked: a block holds at most
block_words words. A larger benchmark goes through in several blocks, each one pass over the documents with the
results so far written in between. The documents are never shuffled, so no key can be hot.

Defined cases: null and empty texts have no words and are not contaminated; very long texts are read whole, one at a
time; an item without words is ignored; an item without item_id is reported as "null"; repeated item_ids count once; repeated documents are each returned. Columns
other than doc_id and text, item_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incognita.llm import session
from incognita.llm import text_arrays as ta

STATE = "doc_id long, n_words long, n_hit long, spans array<int>, items array<string>"


def winnow(hashes: np.ndarray, text: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-gram hashes and the index of each one's first word."""
    grams = ta.gram_hashes(hashes, gram)
    n = len(grams) - window + 1
    if n <= 0:
        return grams[:0], np.empty(0, dtype=np.int64)
    least, place = grams[:n].copy(), np.zeros(n, dtype=np.int8)
    for j in range(1, window):
        lower = grams[j : j + n] <= least
        np.copyto(least, grams[j : j + n], where=lower)
        place[lower] = j
    inside = np.flatnonzero(text[:n] == text[gram + window - 2 : gram + window - 2 + n])
    at = np.unique(inside + place[inside])
    return grams[at], at


class Index:
    """Fingerprints of a block of benchmark items, and their windows."""

    def __init__(self, ids: list[str], texts: list[str], span: int, gram: int):
        self.span, self.gram, self.ids = span, gram, np.array(ids, dtype=object)
        data, offsets = ta.buffers(pa.array(texts, pa.string()))
        words = ta.Words(data, offsets, ta.ALNUM_LOWER)
        hashes = words.hashes()
        self.prints = np.unique(winnow(hashes, words.text, gram, span - gram + 1)[0])
        #: For each length: the windows' hashes in order, where the items of each begin, and the items.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(int(c), span) for c in words.counts if c}):
            grams, at = ta.gram_hashes_within(hashes, words.text, n)
            item = words.text[at]
            whole = np.ones(len(item), dtype=bool) if n == span else words.counts[item] == n
            grams, item = grams[whole], item[whole]
            order = np.lexsort((item, grams))
            grams, item = grams[order], item[order]
            new = np.ones(len(grams), dtype=bool)
            new[1:] = (grams[1:] != grams[:-1]) | (item[1:] != item[:-1])
            keys, first = np.unique(grams[new], return_index=True)
            self.windows[n] = keys, np.append(first, new.sum()), item[new]


def _hits(index: Index, words: ta.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of items in the batch: their first words and ends; and (text, item) of each pair met."""
    hashes, text = words.hashes(), words.text
    starts, ends, texts, items = [], [], [], []
    for n, (keys, first, item) in index.windows.items():
        grams = ta.gram_hashes(hashes, n)
        if n == index.span:
            prints, at = winnow(hashes, text, index.gram, n - index.gram + 1)
            at = at[np.isin(prints, index.prints)]
            at = np.unique(at[:, None] - np.arange(n - index.gram + 1))
            at = at[(at >= 0) & (at < len(grams))]
        else:
            at = np.arange(len(grams))
        at = at[text[at] == text[at + n - 1]]
        key = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
        met = keys[key] == grams[at]
        at, key = at[met], key[met]
        starts.append(at)
        ends.append(at + n)
        # Each window of a text names its items once.
        both = np.unique(text[at] * len(keys) + key)
        own, key = both // len(keys), both % len(keys)
        count = first[key + 1] - first[key]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        texts.append(np.repeat(own, count))
        items.append(item[np.repeat(first[key], count) + within])
    empty = [np.empty(0, dtype=np.int64)]
    return tuple(np.concatenate(x or empty) for x in (starts, ends, texts, items))


def _scan(shared: Broadcast, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch, data, offsets in ta.pieces(batches, "text"):
            words = ta.Words(data, offsets, ta.ALNUM_LOWER)
            start, end, text, item = _hits(index, words)
            # What earlier blocks have hit is hit again.
            known = batch.column("spans")
            place = words.first[:-1][np.repeat(np.arange(batch.num_rows), pc.list_value_length(known).fill_null(0).to_numpy())]
            flat = known.flatten().to_numpy() + place
            edges = np.zeros(len(words.text) + 1, dtype=np.int64)
            np.add.at(edges, np.concatenate((start, flat[0::2])), 1)
            np.add.at(edges, np.concatenate((end, flat[1::2])), -1)
            hit = np.cumsum(edges[:-1]) > 0
            begins, stops = hit.copy(), hit.copy()
            cut = words.text[1:] != words.text[:-1]
            begins[1:] &= ~hit[:-1] | cut
            stops[:-1] &= ~hit[1:] | cut
            first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
            base = words.first[words.text[first]]
            spans = ta.lists(np.stack((first - base, last - base), axis=1).ravel(), 2 * np.searchsorted(first, words.first), pa.int32())
            items = batch.column("items").to_pylist()
            for t in np.unique(text):
                items[t] = sorted({*(items[t] or []), *index.ids[np.unique(item[text == t])]})
            out = [batch.column("doc_id"), pa.array(words.counts), pa.array(ta.per_text(hit, words.first)), spans, pa.array(items, pa.list_(pa.string()))]
            names = ["doc_id", "n_words", "n_hit", "spans", "items"]
            yield pa.RecordBatch.from_arrays([*out, *(batch.column(c) for c in kept)], [*names, *kept])

    return run


def _blocks(benchmark: DataFrame, block_words: int, span: int, gram: int) -> Iterator[Index]:
    ids: list[str] = []
    texts: list[str] = []
    size = 0
    for row in benchmark.toLocalIterator():
        n = len(row.text or "") // 2 + 1
        if ids and size + n > block_words:
            yield Index(ids, texts, span, gram)
            ids, texts, size = [], [], 0
        ids.append("null" if row.item_id is None else str(row.item_id))
        texts.append(row.text or "")
        size += n
    yield Index(ids, texts, span, gram)


def decontaminate(docs: DataFrame, benchmark: DataFrame, span_words: int = 13, gram_words: int = 7, block_words: int = 4_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_hit (words in shared windows), spans (word indexes, flat pairs), items.

    A window is span_words consecutive words of an item of benchmark (item_id, text), or the whole item if it is shorter.
    Columns of docs in carry are returned too; text may be one of them.
    """
    session.prepare(docs.sparkSession)
    state = session.columns(docs, *dict.fromkeys(("doc_id", "text", *carry))).withColumns({"doc_id": F.col("doc_id").cast("long"), "spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    blocks = _blocks(session.columns(benchmark, "item_id", "text"), block_words, span_words, gram_words)
    index = next(blocks)
    while index is not None:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        more = following is not None
        kept = list(dict.fromkeys([*(["text"] if more else []), *carry]))
        kind = T.StructType([*T.StructType.fromDDL(STATE).fields, *(state.schema[c] for c in kept)])
        state = state.mapInArrow(_scan(shared, kept), kind)
        if more:
            state = state.checkpoint()
        index = following
    return state


def contaminated(scanned: DataFrame, hit_share: int = 20) -> DataFrame:
    """Adds contaminated to what decontaminate gives: some word is hit, and at least one in hit_share is."""
    return scanned.withColumn("contaminated", F.expr(f"n_hit > 0 and {hit_share} * n_hit >= n_words"))
