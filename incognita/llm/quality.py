"""Quality rules: base counts, and divergence from language references.

Each document gives two histograms: its code points by character class and its words by common word (function words of
English, German, French and Spanish, and one place for all others). The same histograms summed over all documents of a
language are that language's reference. A document whose Jensen-Shannon distance from its language's reference exceeds
a threshold, in either histogram, is rejected; each histogram is judged only on documents long enough for it.

Defined cases: null and empty texts have no words and fail the base rule; a language of which no text has a character has
no reference, and no distance from it. Null languages share one reference. A distance equal to its limit is kept. Very long
texts are read whole, one at a time. Repeated rows are counted and returned each. Columns other than doc_id, text and lang
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incognita.llm import session
from incognita.llm import text_arrays as ta

# Frequent function words.
COMMON = {
    "en": "the of and to in a is that it for was on are as with be by this from at or an have not",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il avec ce",
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más o pero sus",
}
WORDS = sorted({w for words in COMMON.values() for w in words.split()})
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "beyond")
WIDTH = len(CLASSES) + len(WORDS) + 1

_class = np.full(256, 6, dtype=np.uint8)
_class[ord("a") : ord("z") + 1] = 0
_class[ord("A") : ord("Z") + 1] = 1
_class[ord("0") : ord("9") + 1] = 2
_class[[32, *range(9, 14)]] = 3
_class[list(b".,;:!?'\"()-")] = 4
_class[list(SYMBOLS)] = 5
_class[0xC0:] = 7
_class[0x80:0xC0] = 8  # continuation bytes are no code points

_data, _offsets = ta.buffers(pa.array(WORDS))
_keys = ta.Words(_data, _offsets, ta.ALNUM_LOWER).hashes()
_order = np.argsort(_keys)
_keys = _keys[_order]


def class_histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    texts = len(offsets) - 1
    place = np.repeat(np.arange(texts) * 9, np.diff(offsets)) + _class[data]
    return np.bincount(place, minlength=9 * texts).reshape(-1, 9)[:, :8]


def word_histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the common words, and of all others in the last column."""
    words = ta.Words(data, offsets, ta.ALNUM_LOWER)
    hashes = words.hashes()
    at = np.minimum(np.searchsorted(_keys, hashes), len(_keys) - 1)
    column = np.where(_keys[at] == hashes, _order[at], len(WORDS))
    width = len(WORDS) + 1
    return np.bincount(words.text * width + column, minlength=width * (len(offsets) - 1)).reshape(-1, width)


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, 0 to 1, of each row of counts from the reference's row; 0 for empty rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.nan_to_num(counts / counts.sum(axis=1, keepdims=True))
        q = np.nan_to_num(reference / reference.sum(axis=1, keepdims=True))
        m = (p + q) / 2
        half = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)
        found = np.sqrt(np.clip((half(p) + half(q)) / 2, 0, 1))
    return np.where((counts.sum(axis=1) > 0) & (reference.sum(axis=1) > 0), found, 0.0)


def repeated_words(words: ta.Words, hashes: np.ndarray, window: int) -> np.ndarray:
    """Words of each text in windows of consecutive words that the text has twice or more."""
    grams, at = ta.gram_hashes_within(hashes, words.text, window)
    if not len(grams):
        return np.zeros(len(words.counts), dtype=np.int64)
    keys = ta.mix(grams + words.text[at].astype(ta.U64) * ta.U64(ta.BASE))
    order = np.argsort(keys)
    twin = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:][twin]] = again[order[:-1][twin]] = True
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    starts = at[again]
    edges[starts] += 1
    np.add.at(edges, starts + window, -1)
    return ta.per_text(np.cumsum(edges[:-1]) > 0, words.first)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, words: ta.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(data == 10)
    text = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1))
    start, end = np.concatenate((offsets[:-1], breaks + 1)), np.concatenate((offsets[1:], breaks))
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    end = np.append(start[1:] - 1, len(data)) if len(start) else end
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, dtype=bool)
    end[last] = offsets[1:][text[last]]
    worded = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    text, start, end = text[worded], start[worded], end[worded]
    keys = ta.mix(ta.span_hashes(data, start, end) + text.astype(ta.U64) * ta.U64(ta.BASE))
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), dtype=bool)
    later[first] = False
    return np.bincount(text[later], minlength=len(offsets) - 1)


def base_counts(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    words = ta.Words(data, offsets, ta.SPACED)
    hashes = words.hashes()
    points = (data & 0xC0) != 0x80
    places = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(points, out=places[1:])
    return {
        "n_words": words.counts,
        "word_chars": ta.per_text(places[words.end] - places[words.start], words.first),
        "n_symbols": ta.per_text(_class[data] == 5, offsets),
        "n_dup_lines": duplicate_lines(data, offsets, words),
        "n_repeat_words": repeated_words(words, hashes, window),
    }


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histograms added up per language within the task."""
    sums: dict[str | None, np.ndarray] = {}
    for batch, data, offsets in ta.pieces(batches, "text"):
        both = np.hstack((class_histograms(data, offsets), word_histograms(data, offsets)))
        langs = batch.column("lang").dictionary_encode(null_encoding="encode")
        place = langs.indices.to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            sums[lang] = sums.get(lang, 0) + both[place == i].sum(axis=0)
    rows = [(lang, i, int(n)) for lang, v in sums.items() for i, n in enumerate(v) if n]
    yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "place": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2] for r in rows], pa.int64())})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [np.array(x, "<i8").tobytes() for x in batch.column("reference").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(raw, pa.binary())], ["of_lang", "reference"])


def references(docs: DataFrame) -> DataFrame:
    """One row per language with a character: of_lang, reference (class counts, then word counts, as 64-bit numbers) over all documents."""
    counted = docs.select("text", "lang").mapInArrow(_summed, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    filled = counted.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("of"))
    wide = filled.select("lang", F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.coalesce(F.element_at("of", i), F.lit(0).cast("long"))).alias("reference"))
    return wide.mapInArrow(_packed, "of_lang string, reference binary")


def _rows_of(packed: pa.Array) -> np.ndarray:
    """The reference of each row; the few different ones are unpacked once. Zeros where there is none."""
    few = packed.dictionary_encode()
    matrix = np.frombuffer(b"".join([*few.dictionary.to_pylist(), bytes(8 * WIDTH)]), "<i8").reshape(-1, WIDTH)
    return matrix[few.indices.fill_null(len(matrix) - 1).to_numpy()].astype(np.float64)


def _judged(limits: dict[str, float]):
    k = len(CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in ta.pieces(batches, "text"):
            base = base_counts(data, offsets)
            reference = _rows_of(batch.column("reference"))
            kinds, words = class_histograms(data, offsets), word_histograms(data, offsets)
            class_distance, word_distance = js_distance(kinds, reference[:, :k]), js_distance(words, reference[:, k:])
            odd = (kinds.sum(axis=1) >= limits["class_chars"]) & (class_distance > limits["class_distance"])
            odd |= (words.sum(axis=1) >= limits["word_words"]) & (word_distance > limits["word_distance"])
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            out = {"doc_id": batch.column("doc_id")} | {c: pa.array(v, pa.int64()) for c, v in base.items()}
            out |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & ~odd), "class_distance": pa.array(class_distance), "word_distance": pa.array(word_distance)}
            yield pa.RecordBatch.from_pydict(out)

    return run


JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
#: Language references are sent to all tasks up to so many languages, about 2 KB each; beyond it they are joined by shuffle.
BROADCAST_LANGUAGES = 5_000


def judge_quality(docs: DataFrame, class_chars: int = 600, class_distance: float = 0.26, word_words: int = 100, word_distance: float = 0.5) -> DataFrame:
    """Base counts, distances and verdict for each row of docs (doc_id, text, lang)."""
    session.prepare(docs.sparkSession)
    docs = session.columns(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    refs = references(docs).checkpoint()
    few = refs.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    joined = docs.join(F.broadcast(refs) if few else refs, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    limits = {"class_chars": class_chars, "class_distance": class_distance, "word_words": word_words, "word_distance": word_distance}
    return joined.select("doc_id", "text", "reference").mapInArrow(_judged(limits), JUDGED)
