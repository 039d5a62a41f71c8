"""Ranked lexical search by NRA, sequential reads of impact-sorted lists (operator 13).

A document's score for an item is the sum, over the item's terms, of the term's impact in it: an integer
that depends on the term and the document alone (``w * tf part``). Each block of documents has one list per term, its
documents by falling impact. For an item, the lists of its terms are read side by side from the top, in strides that
double, and never by document (no random access). Every document has a score interval:

- lower: the impacts that were read for it;
- upper: lower, and for each list that hasn't shown it yet the list's last read impact (0 once read to its end).

A document whose upper is under the k-th best lower is out. Reading goes on until every document still in has
lower = upper: then membership, equal scores and the scores themselves are settled, and only then is the block's answer given. The
k-th best lower of all blocks is a floor for each of them (``floors``): a first pass reads every list's first stride, and its lower
bounds, being sums of real impacts, bound the true k-th score from below; blocks without a document that can pass it end at once.

Work on Spark: one pass over the texts writes the lists of each block (no posting is shuffled on the way);
document frequencies and lengths are sums over it; lists meet the items' terms in a join on the term and then their block in a
group of at most ``BLOCK_ROWS`` documents and about ``QUERY_ROWS`` items. Best rows of the blocks meet in a top-k window, for which Spark keeps k rows
an item in each task. Only terms of the items are listed: a bitmap of ``BITS`` bits, whatever their number, goes to
the tasks and lets other terms out early; the join removes the few that pass by chance.

Defined results: null, empty and term-less texts count in no figure and are found by no item; an item without
terms has no rows; rows of one item_id are one item with the terms of all; a null item_id is an item; rows
that repeat are documents each, ranked side by side; null doc_ids rank after all others of their score; other
columns aren't read; empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import documents, materialize, read_table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 10
BLOCK_ROWS = 4096        # documents of a block at most
QUERY_ROWS = 512         # items that are answered together, about
STRIDE = 64              # entries of each list that the first round reads
BITS = 1 << 23           # bits of the map of the items' terms: 1 MB
CACHE_WORDS = 200_000    # terms whose bit a task remembers
# Bytes of UTF-8 that are no part of a term become spaces, A-Z become a-z; bytes from 128 on stay.
_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text as UTF-8, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


# ------------------------------------------------------------------ the items
def item_terms(items: DataFrame) -> DataFrame:
    """(item, term), each pair once; item is a text key of item_id, empty for null."""
    key = F.coalesce(F.concat(F.lit("="), F.col("item_id").cast("string")), F.lit(""))
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(key.alias("item"), F.explode(found).alias("term")).distinct()


def _query_lists(pairs: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(q, term, items): the items of a query block that hold a term; and the number of query blocks."""
    n = pairs.select("item").distinct().count()
    blocks = max(1, -(-n // rows))
    q = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    return pairs.groupBy(q.alias("q"), "term").agg(F.array_sort(F.collect_list("item")).alias("items")), blocks


def _bitmap(pairs: DataFrame) -> bytes:
    """One bit per remainder of the terms' CRC; at most ``BITS`` of them reach the driver, however many terms there are."""
    which = pairs.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BITS)).cast("int").alias("b")).distinct()
    bits = np.zeros(BITS, np.bool_)
    bits[which.toPandas()["b"].to_numpy(np.int64)] = True
    return np.packbits(bits).tobytes()


# ------------------------------------------------------------------ the index
def index(docs: DataFrame, pairs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Lists of blocks of documents: (block, term, at, tf), and for each block a row without a term: (block, ids, sizes).

    ``at`` are places in the block's ids, ``sizes`` the documents' numbers of terms; all little-endian 32-bit
    integers, the ids 64-bit. A block is a run of rows of one input partition.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_bitmap(pairs))

    def run(batches):
        from collections import Counter

        from pyspark import TaskContext
        part, bits, known = TaskContext.get().partitionId(), sent.value, {}
        ids, sizes, lists, made = [], [], {}, 0

        def wanted(term):
            b = zlib.crc32(term) % BITS
            found = bits[b >> 3] >> (7 - (b & 7)) & 1
            if len(known) < CACHE_WORDS and len(term) < 100:
                known[term] = found
            return found

        def block():
            nonlocal ids, sizes, lists, made
            name, made = (part << 33) + made, made + 1
            n = len(lists)
            out = pa.RecordBatch.from_arrays(
                [pa.array([name] * (n + 1), pa.int64()), pa.array([None, *(t.decode("utf-8", "surrogatepass") for t in lists)], pa.string()),
                 pa.array([None, *(np.array(a, "<i4").tobytes() for a, _ in lists.values())], pa.binary()),
                 pa.array([None, *(np.array(c, "<i4").tobytes() for _, c in lists.values())], pa.binary()),
                 pa.array([ids] + [None] * n, pa.list_(pa.int64())), pa.array([np.array(sizes, "<i4").tobytes()] + [None] * n, pa.binary())],
                names=["block", "term", "at", "tf", "ids", "sizes"])
            ids, sizes, lists = [], [], {}
            return out

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = terms_of(text)
                if not found:
                    continue
                at = len(ids)
                ids.append(doc_id)
                sizes.append(len(found))
                for term, tf in Counter(found).items():
                    hit = known.get(term)
                    if hit or hit is None and wanted(term):
                        places, counts = lists.setdefault(term, ([], []))
                        places.append(at)
                        counts.append(tf)
                if len(ids) == block_rows:
                    yield block()
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "block long, term string, at binary, tf binary, ids array<bigint>, sizes binary"), "ranked-index")


def _figures(lists: DataFrame) -> DataFrame:
    """One row (n_docs, n_terms): N and L."""
    def run(batches):
        for b in batches:
            sizes = [np.frombuffer(s, "<i4") for s in b.column("sizes").to_pylist()]
            yield pa.RecordBatch.from_pydict({"n_docs": [sum(map(len, sizes))], "n_terms": [int(sum(int(s.sum(dtype=np.int64)) for s in sizes))]})

    return lists.filter("term IS NULL").select("sizes").mapInArrow(run, "n_docs long, n_terms long") \
        .agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms"))


# ------------------------------------------------------------------ NRA over one block
def tf_part(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 8 * m) for a list, with the documents' numbers of terms."""
    m = 10 + (90 * size.astype(np.int64) * n_docs) // n_terms
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int = K, floor: int = 1, rounds: int | None = None,
        stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the documents among 0..n-1 that can be one of the k best of at least ``floor``, and the entries read.

    ``lists`` have (places, impacts), impacts falling. Scores are final. With ``rounds``, reading ends after so many and the
    scores are lower bounds.
    """
    # seen[t] marks the documents that list t has shown.
    seen = np.zeros((len(lists), n), np.bool_)
    lower = np.zeros(n, np.int64)
    alive = np.ones(n, np.bool_)
    high = np.array([imp[0] if len(imp) else 0 for _, imp in lists], np.int64)
    begin, read, done = 0, 0, 0
    if high.sum() < floor:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while True:
        for t, (places, imp) in enumerate(lists):
            if begin >= len(places):
                continue
            p = places[begin:begin + stride]
            lower[p] += imp[begin:begin + stride]
            seen[t, p] = True
            read += len(p)
            high[t] = imp[begin + len(p) - 1] if begin + len(p) < len(places) else 0
        begin += stride
        stride *= 2
        done += 1
        if done == rounds:
            break
        least = floor if n < k else max(floor, int(np.partition(lower, n - k)[n - k]))
        open_lists = np.flatnonzero(high)
        # What the lists that are still open may add to a document that they haven't shown.
        rest = np.zeros(n, np.int64)
        for t in open_lists:
            rest += np.where(seen[t], 0, high[t])
        alive &= lower + rest >= least
        if not len(open_lists) or not (alive & (rest > 0)).any():
            break
    where = np.flatnonzero(alive & (lower >= max(1, floor)))
    return where, lower[where], read


def _search(matched: DataFrame, k: int, rounds: int | None) -> DataFrame:
    """(item, doc_id, score): the k best of each block and item of :func:`_matched`."""
    def run(key, table):
        lists_of: dict[str, list] = {}
        floors: dict[str, int] = {}
        ids = np.zeros(0, np.int64)
        rows = table.to_pydict()
        size = next(np.frombuffer(s, "<i4") for s in rows["sizes"] if s is not None)
        for given in rows["ids"]:
            if given is not None:
                ids = np.array([NO_ID if x is None else x for x in given], np.int64)
                void = np.array([x is None for x in given], np.bool_)
        for term, at, tf, items, least, w, n_docs, n_terms in zip(*(rows[c] for c in ("term", "at", "tf", "items", "floors", "w", "n_docs", "n_terms"))):
            if term is None:
                continue
            places = np.frombuffer(at, "<i4")
            part = tf_part(np.frombuffer(tf, "<i4"), size[places], n_docs, n_terms)
            order = np.argsort(-part, kind="stable")
            entry = places[order], part[order] * w
            for item, f in zip(items, least):
                lists_of.setdefault(item, []).append(entry)
                floors[item] = max(1, f)
        out_item, out_at, out_score = [], [], []
        for item, lists in lists_of.items():
            where, score, _ = nra(lists, len(ids), k, floors[item], rounds)
            order = np.lexsort((ids[where], void[where], -score))[:k]
            out_item += [item] * len(order)
            out_at.append(where[order])
            out_score.append(score[order])
        at = np.concatenate(out_at) if out_at else np.zeros(0, np.int64)
        return pa.table({"item": pa.array(out_item, pa.string()), "doc_id": pa.array(ids[at], pa.int64(), mask=void[at]),
                         "score": pa.array(np.concatenate(out_score) if out_score else [], pa.int64())})

    return matched.groupBy("q", "block").applyInArrow(run, "item string, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents for each item."""
    pairs = materialize(item_terms(items), "ranked-terms")
    lists = index(docs, pairs, block_rows)
    figures = materialize(_figures(lists), "ranked-figures").first()
    n_docs, n_terms = figures["n_docs"], figures["n_terms"]
    queries, blocks = _query_lists(pairs, query_rows)
    df = lists.filter("term IS NOT NULL").groupBy("term").agg(F.sum(F.octet_length("at") / 4).cast("long").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    terms = materialize(queries.join(df, "term").select("q", "term", "items", weight.alias("w")).filter("w > 0"), "ranked-weights")
    first = _matched(lists, terms.withColumn("floors", F.transform("items", lambda _: F.lit(1).cast("long"))), blocks, n_docs, n_terms)
    low = materialize(_best(_search(first, k, rounds=1), k), "ranked-floors")
    floor = low.filter(F.col("rank") == k).select("item", F.col("score").alias("floor"))
    floored = terms.select("q", "term", "w", F.explode("items").alias("item")).join(floor, "item", "left") \
        .groupBy("q", "term", "w").agg(F.array_sort(F.collect_list(F.struct("item", F.coalesce("floor", F.lit(1)).alias("floor")))).alias("f")) \
        .select("q", "term", "w", F.col("f.item").alias("items"), F.col("f.floor").alias("floors"))
    found = _search(_matched(lists, materialize(floored, "ranked-floored"), blocks, n_docs, n_terms), k, rounds=None)
    kind = dict(items.dtypes)["item_id"]
    return _best(found, k).select(F.when(F.col("item") != "", F.expr("substr(item, 2)")).cast(kind).alias("item_id"), "rank", "doc_id", "score")


def _matched(lists: DataFrame, terms: DataFrame, blocks: int, n_docs: int, n_terms: int) -> DataFrame:
    """Lists with the items of each query block that hold their term, and every block's documents for each query block."""
    have = lists.filter("term IS NOT NULL").select("block", "term", "at", "tf").join(terms, "term")
    docs = lists.filter("term IS NULL").select("block", "ids", "sizes", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"))
    return have.unionByName(docs, allowMissingColumns=True).withColumns({"n_docs": F.lit(n_docs), "n_terms": F.lit(n_terms)})


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir).select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS ts FROM documents),
big AS (SELECT count(*)::bigint AS nn, sum(length(ts))::bigint AS ll FROM d WHERE length(ts) > 0),
want AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT r, term, count(*)::bigint AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM want) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM tf, big GROUP BY term, nn),
part AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * length(ts)::bigint * nn) // ll))) AS s
  FROM tf JOIN w USING (term) JOIN d USING (r), big),
score AS (SELECT item_id, r, sum(s)::bigint AS score FROM want JOIN part USING (term) GROUP BY item_id, r HAVING sum(s) > 0),
best AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score JOIN d USING (r))
SELECT item_id, rank::int AS rank, doc_id, score FROM best WHERE rank <= {K}"""

QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {"op13_ranked_search": ORACLE}
