"""Fill-in-middle: texts cut at two unit boundaries and told again with the middle at the end.

Overlapping-chunk decomposition. A boundary between two units is told by two adjacent characters alone, so a text is
taken as chunks that overlap by one character: each pair of neighbours lies in exactly one chunk, and chunks are counted
independently of one another. Prefix sums over the counts give the number of units, from which the two cut ranks are
drawn, and tell which chunk owns each cut; only these chunks are scanned again for the place. Chunks are cut inside the
task that has the text: what a chunk is counted for costs less than sending it elsewhere, and no text is shuffled. Memory
is bounded by the longest text, not by its number of units.

Which units go where is drawn from sha256 of seed and doc_id, so it depends neither on partitions nor on the order of rows.

Defined cases: null and empty texts have no units and are plain. Texts that hold a marker are plain, so that restoring is
always exact. Rows with null doc_id are drawn as if their doc_id were written as nothing. Both cut ranks equal: the middle
is empty. Repeated rows are told alike. Very long texts are read whole. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.llm import session
from incognita.llm import text_arrays as ta

#: Bytes of a chunk.
CHUNK_BYTES = 256 << 10
MARKERS = ("<P>", "<S>", "<M>")
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_blank = np.zeros(256, dtype=bool)
_blank[[32, *range(9, 14)]] = True
#: Whether a unit ends between two adjacent bytes of UTF-8.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "line": lambda left, right: left == 10,
    "word": lambda left, right: _blank[left] & ~_blank[right],
    "character": lambda left, right: (right & 0xC0) != 0x80,
}


def _ends(data: np.ndarray, start: int, end: int, unit: str) -> np.ndarray:
    """For each place of data[start:end]: whether a unit ends before it. One byte more is read on the left."""
    found = np.zeros(end - start, dtype=bool)
    first = max(start, 1)
    found[first - start :] = UNITS[unit](data[first - 1 : end - 1], data[first:end])
    return found


class Chunks:
    """The chunks of a batch of texts: where they start, and prefix sums of the unit ends and code points in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str, size: int):
        self.data, self.offsets, self.unit = data, offsets, unit
        texts = offsets[:-1]
        self.start = np.unique(np.concatenate([np.arange(0, len(data), size), texts[texts < len(data)]]))
        self.end = np.append(self.start[1:], len(data))
        ends, points = np.zeros(len(self.start) + 1, dtype=np.int64), np.zeros(len(self.start) + 1, dtype=np.int64)
        for at in range(0, len(data), size):
            to = min(at + size, len(data))
            k, m = np.searchsorted(self.start, [at, to])
            own = self.start[k:m] - at
            found = _ends(data, at, to, unit)
            # No unit ends between two texts.
            found[own[np.isin(self.start[k:m], texts, assume_unique=False)]] = False
            ends[k + 1 : m + 1] = np.add.reduceat(found, own, dtype=np.int64)
            points[k + 1 : m + 1] = np.add.reduceat((data[at:to] & 0xC0) != 0x80, own, dtype=np.int64)
        self.ends, self.points = np.cumsum(ends), np.cumsum(points)
        #: Chunks of text i are first[i] : first[i + 1].
        self.first = np.searchsorted(self.start, offsets)
        self.units = self.ends[self.first[1:]] - self.ends[self.first[:-1]] + (np.diff(offsets) > 0)

    def place(self, text: int, rank: int) -> tuple[int, int]:
        """Where text ends its rank-th unit: byte, and code points of the text before it."""
        low, high = self.offsets[text], self.offsets[text + 1]
        began = self.points[self.first[text]]
        if rank == 0:
            return int(low), 0
        if rank == self.units[text]:
            return int(high), int(self.points[self.first[text + 1]] - began)
        wanted = self.ends[self.first[text]] + rank
        owner = int(np.searchsorted(self.ends, wanted)) - 1
        start = self.start[owner]
        found = _ends(self.data, start, self.end[owner], self.unit)
        found[0] &= start != low
        at = int(np.flatnonzero(found)[wanted - self.ends[owner] - 1]) + int(start)
        inside = int(np.count_nonzero((self.data[start:at] & 0xC0) != 0x80))
        return at, int(self.points[owner] - began) + inside


def _number(i: int) -> Column:
    """The i-th group of 8 hex digits, as an unsigned integer."""
    return F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")


def _drawn(docs: DataFrame, seed: int, rate: int, spm: int) -> DataFrame:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = session.columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("digest"))
    form = F.when(_number(2) % 100 >= rate, "plain").when(_number(3) % 100 < spm, "spm").otherwise("psm")
    return rows.select("doc_id", "text", _number(0).alias("h1"), _number(1).alias("h2"), form.alias("drawn"))


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", markers: tuple[str, str, str] = MARKERS, chunk: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of each of docs.

    rate: how many of 100 texts are cut; spm: how many of 100 of these tell the suffix first. The markers stand for prefix,
    suffix and middle; the first character of each may stand nowhere else in any of them.
    """
    if any(m[:1] in "".join(x[1:] for x in markers) or not m for m in markers) or len(set(markers)) < 3:
        raise ValueError("markers must differ, and their first characters stand nowhere else in them")
    session.prepare(docs.sparkSession)
    marks = [m.encode() for m in markers]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in ta.pieces(batches, "text"):
            chunks, raw = Chunks(data, offsets, unit, chunk), data.tobytes()
            drawn, h1, h2 = (rows.column(c).to_pylist() for c in ("drawn", "h1", "h2"))
            forms, prefixes, middles, out, ends = [], [], [], [], [0]
            for i, n in enumerate(chunks.units.tolist()):
                low, high = int(offsets[i]), int(offsets[i + 1])
                if drawn[i] == "plain" or low == high or any(raw.find(m, low, high) >= 0 for m in marks):
                    form, parts = "plain", [raw[low:high]]
                    prefixes.append(None)
                    middles.append(None)
                else:
                    form = drawn[i]
                    ranks = sorted((h1[i] % (n + 1), h2[i] % (n + 1)))
                    (a, before), (b, until) = (chunks.place(i, r) for r in ranks)
                    prefix, middle, suffix = raw[low:a], raw[a:b], raw[b:high]
                    parts = [marks[0], prefix, marks[1], suffix] if form == "psm" else [marks[1], suffix, marks[0], prefix]
                    parts += [marks[2], middle]
                    prefixes.append(before)
                    middles.append(until - before)
                forms.append(form)
                out += parts
                ends.append(ends[-1] + sum(map(len, parts)))
            output = ta.binaries(b"".join(out), np.array(ends)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(chunks.units, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), output],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return _drawn(docs, seed, rate, spm).mapInArrow(tell, COLUMNS)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text, out of what fill_in_middle made of it."""
    p, s, m = markers

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands behind the first marker, behind the second, and behind that of the middle."""
        body = F.substr(output, F.lit(len(first) + 1))
        left = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(left) + len(second) + 1)
        right = F.substring_index(rest, m, 1)
        return left, right, F.substr(rest, F.char_length(right) + len(m) + 1)

    (prefix, suffix, middle), (spm_suffix, spm_prefix, spm_middle) = parts(p, s), parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(spm_prefix, spm_middle, spm_suffix))
