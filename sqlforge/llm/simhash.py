"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 9).

A document's fingerprint has 64 bits, each set if more than half of the hashes of its word shingles have
it set. Fingerprints link at ``MOST`` or fewer differing bits. Each different fingerprint is decoded by
segments to nearby Golay codeword indices, which gives joint keys such that no linked pair is without a
common one (``golay``). Fingerprints that share a key are compared exactly, and the links are closed to
components.

Scale. Copies fall together before keys are made (one row per different fingerprint). Rows with keys are
dealt by key and sorted; a task reads them as a stream, compares inside each run of one key and
keeps only links that join something new, so its output is at most one link per
fingerprint it saw, whatever the size of a group. A run over ``RUN_ROWS`` is not compared there: its rows
get further keys (five blocks of bits, one of which a linked pair has in common) and are dealt anew.

Defined results: null and empty texts have the fingerprint zero and link like any other; a null doc_id
takes part, but is smaller than no other (a component of null ids has a null id); rows that repeat link
by their equal fingerprints; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .common import documents, materialize
from .components import components

SHINGLE = 4
MOST = golay.MOST
SEED = 42
RUN_ROWS = 1 << 15
STEP = 2000            # fingerprints whose keys are made at once
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - shingle + 1]
    ends = ends[shingle - 1:]
    counts, n = np.zeros(64, dtype=np.int64), len(starts)
    for k in range(0, n, 1 << 16):
        h = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k:k + (1 << 16)].tolist(), ends[k:k + (1 << 16)].tolist())]
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``_fp``, the fingerprint as a signed long."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "_fp"]
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column("_text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp)], names=[*keep, "_fp"])

    return rows.mapInArrow(run, docs.select(*keep).withColumn("_fp", F.lit(0).cast("long")).schema)


def with_keys(prints: DataFrame) -> DataFrame:
    """(key, fp) for all joint keys of the fingerprints ``_fp``."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), STEP):
                part = fp[k:k + STEP]
                rows, keys = golay.joint_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    return prints.select("_fp").mapInArrow(run, "key long, fp long")


class Forest:
    """Links that join two parts that were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def add(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def linked_rows(keys: np.ndarray, fps: np.ndarray, most: int, forest: Forest) -> list[tuple[int, int]]:
    """Links inside the runs of equal keys (sorted), only those that join something new."""
    found = []
    same = keys[1:] == keys[:-1]
    at = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    lag = 1
    while len(at):
        at = at[at + lag < len(keys)]
        at = at[keys[at] == keys[at + lag]]        # those whose run is longer than the lag
        near = at[golay.distance(fps[at], fps[at + lag]) <= most]
        for a, b in zip(fps[near].tolist(), fps[near + lag].tolist()):
            if a != b and forest.add(a, b):
                found.append((a, b))
        lag += 1
    return found


def compare(keyed: DataFrame, most: int, run_rows: int | None) -> DataFrame:
    """(a, b, key): links, and with a key the rows of runs that are longer than ``run_rows``."""
    def run(batches):
        import pyarrow as pa
        forest = Forest()
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(a, b, key=None):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, dtype=np.uint64).view(np.int64)), pa.array(np.asarray(b, dtype=np.uint64).view(np.int64)),
                                               pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)], names=["a", "b", "key"])

        def solve(keys, fps):
            if run_rows is not None and len(keys):
                size = np.diff(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])))
                long = np.repeat(size > run_rows, size)
                if long.any():
                    yield out(fps[long], fps[long], keys[long])
                    keys, fps = keys[~long], fps[~long]
            links = linked_rows(keys, fps, most, forest)
            if links:
                yield out(*zip(*links))
            if len(forest.up) > 1_000_000:
                forest.up.clear()

        too_long = None       # key of a run that is already known to be too long
        for b in batches:
            k, f = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if too_long is not None:
                on = k == too_long
                if on.any():
                    yield out(f[on], f[on], k[on])
                    k, f = k[~on], f[~on]
                if len(k):
                    too_long = None
                else:
                    continue
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0     # the last run may go on
            yield from solve(keys[:done], fps[:done])
            keys, fps = keys[done:], fps[done:]
            if run_rows is not None and len(keys) > run_rows:
                too_long = int(keys[0])
                yield out(fps, fps, keys)
                keys, fps = keys[:0], fps[:0]
        yield from solve(keys, fps)

    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long, key long")


def links(prints: DataFrame, most: int = MOST, run_rows: int = RUN_ROWS) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all those within ``most`` bits."""
    if most > golay.MOST:
        raise ValueError(f"the keys are complete up to {golay.MOST} bits")
    first = materialize(compare(with_keys(prints), most, run_rows), "simhash-links")
    found = first.filter("key IS NULL").select("a", "b")
    if first.filter("key IS NOT NULL").isEmpty():
        return found
    block = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("a", s).bitwiseAND(F.lit((1 << w) - 1)).alias("v"))
             for i, (s, w) in enumerate(BLOCKS)]
    more = first.filter("key IS NOT NULL").select("key", "a", F.explode(F.array(*block)).alias("e")) \
        .select(F.xxhash64("key", "e.i", "e.v").alias("key"), F.col("a").alias("fp"))
    return materialize(compare(more, most, None), "simhash-links").select("a", "b").unionByName(found)


def component_table(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(_fp, _root) of the different fingerprints of ``rows``; the root names the component."""
    prints = rows.select("_fp").distinct()
    roots = components(links(prints, most))
    return prints.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left") \
        .select("_fp", F.coalesce("root", "_fp").alias("_root"))


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(fingerprints(documents(spark, sf_dir), keep=["doc_id"]), "simhash-rows")
    named = rows.groupBy("_fp").agg(F.min("doc_id").alias("_id")).join(component_table(rows), "_fp")
    ids = named.groupBy("_root").agg(F.min("_id").alias("component_id"))
    return rows.join(named.select("_fp", "_root").join(ids, "_root").drop("_root"), "_fp") \
        .select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """One document of each component, all its columns: the smallest id, among equal ids the first row."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    rows = materialize(fingerprints(whole, shingle, keep=["_doc"]).withColumn("_row", F.monotonically_increasing_id()), "simhash-docs")
    first = F.struct(F.col("_doc.doc_id").isNull().alias("n"), F.col("_doc.doc_id").alias("doc_id"), "_row")
    per = rows.groupBy("_fp").agg(F.min(first).alias("_first")).join(component_table(rows, most), "_fp")
    kept = per.groupBy("_root").agg(F.min("_first").alias("_first")).select(F.col("_first._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("_doc.*")


QUERIES = {"op9_simhash_golay": op9_simhash_golay}
ORACLES: dict[str, str] = {}
