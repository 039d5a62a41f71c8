"""Order-preserving packing by dynamic programming (operator 7).

Documents keep their order. Their ids form one stream, and a cut may fall after any document or
sentence; windows hold at most ``WINDOW`` ids. A window costs its padding, plus a penalty if it
ends inside a document. With p the positions of the allowed cuts and f the least cost up to one,

    f[j] = min over i, p[j] - p[i] <= WINDOW, of f[i] + WINDOW - (p[j] - p[i]) + penalty[j]

The minimum of f[i] + p[i] over a sliding window is kept by a monotone queue, so the work is
linear in the number of cuts. Where sentence ends are over ``GAP`` ids apart, cuts
at every ``GAP // 2`` ids are allowed too, at a higher penalty. A window whose length is a power of two is
not padded and so costs no padding.

Documents are dealt by ascending doc_id to range partitions of about ``PART_BYTES`` of text; each
task streams its documents and solves stretches of about ``STRETCH`` ids, so memory is bounded for any document, and only the
last window of a stretch is short for want of text.

Defined results: null text is empty (only the end id, so every document has a piece); null
doc_ids come first; equal doc_ids are ordered by text; an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, spread, whole_text
from .tokenize import SpaceFree, encoder, load_tokenizer, vocabulary

WINDOW = 4096
STRETCH = 1 << 20
PART_BYTES = 8 << 20
GAP = 128
IN_DOCUMENT = 8.0     # cost of a window that ends at a sentence end inside a document
IN_SENTENCE = 48.0    # ... or inside a sentence
SENTENCE_ENDS = (".", "!", "?", "...", "…", "。", "！", "？", ".\"", "?\"", "!\"", ".)", "!!", "??")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_end_ids(path: str) -> np.ndarray:
    """Ids of the tokens that end a sentence, with and without a word-end mark."""
    t = load_tokenizer(path)
    found = {t.token_to_id(x + mark) for x in SENTENCE_ENDS for mark in ("", "</w>")}
    for x in SENTENCE_ENDS:
        ids = t.encode(x, add_special_tokens=False).ids
        if len(ids) == 1:
            found.add(ids[0])
    return np.array(sorted(x for x in found if x is not None), dtype=np.uint32)


def window_cuts(places: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Chosen cut positions. ``places`` ascends from 0 to the end, with no gap over ``window``."""
    p, pen = places.tolist(), penalty.tolist()
    # Where a window that ends here would begin to have a length that is a power of two (-1: no cut there).
    exact = []
    size = window >> 1
    while size >= window >> 2 and size:
        k = np.searchsorted(places, places - size)
        exact.append(np.where((places >= size) & (places[k] == places - size), k, -1).tolist())
        size >>= 1
    best, came = [0.0] * len(p), [0] * len(p)
    queue = deque([0])
    for j in range(1, len(p)):
        at = p[j]
        while p[queue[0]] < at - window:
            queue.popleft()
        i = queue[0]
        cost = best[i] + p[i] + window - at
        for starts in exact:
            k = starts[j]
            if k >= 0 and best[k] < cost:
                cost, i = best[k], k
        best[j], came[j] = cost + pen[j], i
        while queue and best[queue[-1]] + p[queue[-1]] >= best[j] + at:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = came[j]
    return cuts[::-1]


def stretch_places(sizes: list[int], ids: np.ndarray, ends: np.ndarray, last_is_end: bool,
                   window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts of a stretch and their penalties (0 at document ends)."""
    total = len(ids)
    doc_ends = np.cumsum(sizes)
    pen = np.full(total + 1, np.inf)
    pen[np.flatnonzero(np.isin(ids, ends)) + 1] = IN_DOCUMENT
    pen[doc_ends if last_is_end else doc_ends[:-1]] = 0.0
    pen[0] = 0.0
    if not np.isfinite(pen[total]):
        pen[total] = IN_SENTENCE
    places = np.flatnonzero(np.isfinite(pen))
    gap = min(GAP, window // 2)
    for k in np.flatnonzero(np.diff(places) > gap):
        more = np.arange(places[k] + gap // 2, places[k + 1], gap // 2)
        pen[more] = IN_SENTENCE
    places = np.flatnonzero(np.isfinite(pen))
    return places, pen[places]


class Packer:
    """Packs a stream of documents; ``rows`` are pieces ready to leave."""

    def __init__(self, part: int, ends: np.ndarray, window: int = WINDOW, stretch: int = STRETCH):
        if stretch < 4 * window:
            raise ValueError("a stretch must hold four windows")
        self.ends, self.window, self.stretch = ends, window, stretch
        self.next_id, self.rows = part << 32, []
        self.docs, self.parts, self.held = [], [], 0   # (doc_id, start, n, doc_tokens) and ids

    def add(self, doc_id, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            n = min(len(ids) - start, self.stretch - self.held)
            self.docs.append((doc_id, start, n, len(ids)))
            self.parts.append(ids[start:start + n])
            self.held += n
            start += n
            if self.held >= self.stretch:
                self.solve(final=False)

    def solve(self, final: bool) -> None:
        """Pack what is held. Unless at the end, the last window is kept back to be filled."""
        if not self.held:
            return
        ids = np.concatenate(self.parts)
        whole = self.docs[-1][1] + self.docs[-1][2] == self.docs[-1][3]
        places, pen = stretch_places([d[2] for d in self.docs], ids, self.ends, whole, self.window)
        cuts = window_cuts(places, pen, self.window)
        if not final:
            cuts = cuts[:-1]
        begin, d, inside = 0, 0, 0     # inside: ids of document part d that are already in a window
        for cut in cuts:
            at = begin
            while at < cut:
                doc_id, start, n, size = self.docs[d]
                take = min(n - inside, cut - at)
                self.rows.append((doc_id, start + inside, take, zlib.crc32(ids[at:at + take].tobytes()), size,
                                  self.next_id, at - begin))
                at += take
                inside += take
                if inside == n:
                    d, inside = d + 1, 0
            begin = cut
            self.next_id += 1
        rest = self.docs[d:]
        if rest and inside:
            doc_id, start, n, size = rest[0]
            rest[0] = (doc_id, start + inside, n - inside, size)
        self.docs, self.parts, self.held = rest, [ids[begin:]] if begin < len(ids) else [], len(ids) - begin

    def take(self):
        import pyarrow as pa
        cols = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols],
                                          names=[x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, stretch: int = STRETCH) -> DataFrame:
    """Pieces of the packed sequences; ``sequence_id`` ascends with doc_id."""
    end = struct.pack("<I", end_id)
    ends = sentence_end_ids(tokenizer)

    def run(batches):
        from pyspark import TaskContext
        encode = encoder(SpaceFree, tokenizer)
        packer = Packer(TaskContext.get().partitionId(), ends, window, stretch)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                packer.add(doc_id, np.frombuffer(encode(text) + end, dtype="<u4"))
                if len(packer.rows) >= 10_000:
                    yield packer.take()
        packer.solve(final=True)
        if packer.rows:
            yield packer.take()

    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")) \
        .withColumns(spread())
    rows = rows.repartitionByRange(size // PART_BYTES + 1, "doc_id", *spread()).sortWithinPartitions("doc_id", *spread()).select("doc_id", "text")
    return rows.mapInArrow(run, PIECES)


def op7_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)


QUERIES = {"op7_pack_windows": op7_pack_windows}
ORACLES: dict[str, str] = {}
