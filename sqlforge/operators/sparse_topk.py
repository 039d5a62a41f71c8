"""Exact top-k by sparse cosine over lists in large blocks.

A plain term join forms every pair that shares a word, and a common word pairs most questions with
most items of a group. Here no pair is a row:

1. *Classes.* Only terms that some item of the group holds can add to a dot product. Queries that agree in the
   weights of these terms have equal sums with every item, so they are one class, searched once.
2. *Lists.* The items of a group lie in blocks of about ``BLOCK`` rows. A block has one list per term (places and weights).
3. *Search.* A group's classes lie in blocks of that size, too. One task takes one block of lists and one block of classes
   and adds the lists up for some classes at a time: short lists where they are, lists of common words as a
   product of matrices, and only for classes that can still reach their threshold. Only the k best of a class leave it.

Lists are copied once per class block and classes once per block of lists, so what is shuffled and kept on disk is the input
times the number of blocks of its group, not a row per class, word and small block. The work in the tasks remains
classes times items of a group: whole sums are what makes the values exact. Equal values are ordered by the item's order key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SIM_SCALE
from ..session import materialize

BLOCK = 16384     # items of a block and classes of a class block, about
SUMS = 1 << 22    # sums that a task holds at a time
COMMON = 32       # a word that one item of so many holds is common
SLACK = 1e-8      # values that differ by less may be equal after rounding to SIM_SCALE digits


def dot(a: Column, b: Column) -> Column:
    """Dot product of a vector given as an array of struct<term, w> and one given as a map from term to w."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.element_at(b, x["term"]), F.lit(0.0)))


def vectors(vecs: DataFrame, ids: list[str], name: str) -> DataFrame:
    """Long-form vectors (ids, term, w) as one array a row (one text's words: bounded by the text)."""
    return vecs.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias(name))


def lookup(vecs: DataFrame, ids: list[str]) -> DataFrame:
    """Long-form vectors as ``_rv``, one map from term to weight a row."""
    return vectors(vecs, ids, "_rv").withColumn("_rv", F.map_from_entries("_rv"))


def pair_dots(pairs: DataFrame, left: DataFrame, left_ids: list[str], right: DataFrame, right_ids: list[str]) -> DataFrame:
    """``pairs`` with ``sim``, the dot product of their rows ``_lv`` of ``left`` (:func:`vectors`) and ``_rv`` of ``right`` (:func:`lookup`)."""
    both = pairs.join(left, left_ids).join(right, right_ids)
    return both.withColumn("sim", dot(F.col("_lv"), F.col("_rv"))).drop("_lv", "_rv")


def best_of_block(lists: list[tuple], taus: dict, k: int) -> list[tuple]:
    """The k best items of a block for each class: (class, order key, value).

    ``lists`` have (order keys, weights, classes, class weights); ``taus`` maps a class to its threshold.
    """
    places = {c: r for r, c in enumerate(taus)}
    lens = [len(o) for o, *_ in lists]
    orders, at = np.unique(np.concatenate([np.asarray(o, np.int64) for o, *_ in lists]), return_inverse=True)
    ends = np.cumsum(lens)
    at = [at[e - n:e] for e, n in zip(ends, lens)]
    weights = [np.asarray(w, np.float64) for _, w, *_ in lists]
    tops = np.array([w.max() for w in weights])
    # The classes' own words: row, list, weight, in the order of rows.
    rows = np.concatenate([np.fromiter((places[c] for c in m), np.int64, len(m)) for *_, m, _ in lists])
    of = np.repeat(np.arange(len(lists)), [len(m) for *_, m, _ in lists])
    qw = np.concatenate([np.asarray(x, np.float64) for *_, x in lists])
    # A key that is given more than once counts once.
    _, order = np.unique(rows * len(lists) + of, return_index=True)
    rows, of, qw = rows[order], of[order], qw[order]
    # The longest lists as rows of a matrix.
    step, most = max(1, SUMS // len(orders)), max(1, 2 * SUMS // len(orders))
    common = [x for x in np.argsort(lens, kind="stable")[::-1][:most].tolist() if lens[x] * COMMON >= len(orders)]
    column = np.full(len(lists), -1)
    column[common] = np.arange(len(common))
    dense = np.zeros((len(common), len(orders)))
    for n, x in enumerate(common):
        dense[n, at[x]] = weights[x]
    names, tau, out = list(taus), np.array(list(taus.values())) - SLACK, []
    for first in range(0, len(names), step):
        last = min(first + step, len(names))
        a, b = np.searchsorted(rows, [first, last])
        r, x, w = rows[a:b] - first, of[a:b], qw[a:b]
        in_matrix = column[x] >= 0
        sums, asked, rest = np.zeros((last - first, len(orders))), np.zeros((last - first, len(common))), np.zeros(last - first)
        for i, l, v in zip(r[~in_matrix].tolist(), x[~in_matrix].tolist(), w[~in_matrix].tolist()):
            sums[i, at[l]] += v * weights[l]
        asked[r[in_matrix], column[x[in_matrix]]] = w[in_matrix]
        np.add.at(rest, r[in_matrix], w[in_matrix] * tops[x[in_matrix]])
        alive = np.flatnonzero(sums.max(axis=1) + rest >= tau[first:last])
        sums = sums[alive] + asked[alive] @ dense
        for c, s in zip((alive + first).tolist(), sums):
            least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else 0.0
            some = np.flatnonzero(s >= least - SLACK)      # values that may be equal to the k-th when rounded
            v = np.round(s[some], SIM_SCALE)
            held = (v > 0) & (v >= tau[c])
            some, v = some[held], v[held]
            best = np.lexsort((orders[some], -v))[:k]
            out += [(names[c], int(orders[some[n]]), float(v[n])) for n in best.tolist()]
    return out


class SparseIndex:
    """Lists of a set of items: (keys, item_id, order_key) with vectors (keys, item_id, term, w).

    Order keys are whole numbers, each once in a group. A group is the rows with equal ``keys`` (all rows without keys).
    """

    def __init__(self, items: DataFrame, item_vecs: DataFrame, keys: list[str], item_id: str, order_key: str, k: int, block: int = BLOCK):
        self.keys, self.item_id, self.order_key, self.k, self.block = keys, item_id, order_key, k, block
        group = F.to_json(F.struct(*keys)) if keys else F.lit("")
        cols = list(dict.fromkeys([*keys, item_id, order_key]))
        self.items = items.select(*cols, group.alias("g"), F.col(order_key).cast("long").alias("_ord"))
        blocks = self.items.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
        placed = self.items.join(blocks, "g").withColumn("blk", F.pmod(F.xxhash64("_ord"), F.col("_n")).cast("int"))
        entries = item_vecs.select(*keys, item_id, "term", "w").join(placed, [*keys, item_id] if item_id not in keys else keys)
        self.lists = materialize(entries.groupBy("g", "blk", "term").agg(F.collect_list(F.struct("_ord", "w")).alias("entries")), "sparse-lists")

    def classes(self, queries: DataFrame, query_vecs: DataFrame, q_id: str) -> tuple[DataFrame, DataFrame]:
        """(q, g, class): the class of every query; (class, g, _lv): its vector. Without a known term: an empty vector."""
        group = F.to_json(F.struct(*self.keys)) if self.keys else F.lit("")
        own = queries.select(F.col(q_id).alias("q"), group.alias("g"))
        known = query_vecs.select(F.col(q_id).alias("q"), "term", "w").join(own, "q") \
            .join(self.lists.select("g", "term").distinct(), ["g", "term"])
        own = own.join(vectors(known, ["q", "g"], "_lv"), ["q", "g"], "left") \
            .withColumn("_lv", F.coalesce("_lv", F.array().cast("array<struct<term:string,w:double>>")))
        # Equal vectors meet by a 128-bit text of themselves; the vector itself is compared too.
        own = materialize(own.withColumn("_h", F.md5(F.to_json("_lv"))), "sparse-queries")
        # A query is in one group or in several; the least of a class's queries names the class within its group.
        of = materialize(own.groupBy("g", "_h", "_lv").agg(F.min("q").alias("class")), "sparse-classes")
        on = (own["_h"] == of["_h"]) & (own["g"] == of["g"]) & (own["_lv"] == of["_lv"])
        return own.join(of, on).select(own["q"], own["g"], of["class"]), of.select("class", "g", "_lv")

    def search(self, classes: DataFrame) -> DataFrame:
        """(class, g, _ord, sim): the items of positive value that can be among a class's k best."""
        n = classes.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / self.block).alias("_n"))
        cblk = F.pmod(F.xxhash64("class"), F.col("_n")).cast("int").alias("cblk")
        terms = classes.join(n, "g").select("class", "g", cblk, F.explode("_lv").alias("_t")) \
            .select("class", "g", "cblk", "_t.term", F.col("_t.w").alias("qw"))
        blocks = self.lists.select("g", "blk").distinct()
        return self._sums(terms, classes.select("class", "g").join(blocks, "g").withColumn("tau", F.lit(0.0)))

    def _sums(self, terms: DataFrame, wanted: DataFrame) -> DataFrame:
        """The k best of each wanted (class, g, blk) with threshold tau."""
        held = terms.join(wanted, ["class", "g"])
        # Every class block meets the lists of every block of its group: a task's rows are two blocks.
        places = terms.select(F.col("g").alias("_g"), F.col("cblk").alias("_cblk")).distinct()
        lists = self.lists.join(places, F.col("g") == F.col("_g")).select("_g", F.col("blk").alias("_blk"), "_cblk", "term", "entries")
        kind, k = dict(terms.dtypes)["class"], self.k

        def run(key, both):
            of, lists = both.filter(pc.is_null(both.column("entries"))), both.filter(pc.is_valid(both.column("entries")))
            names = of.column("class").combine_chunks() if of.num_rows else pa.array([], of.schema.field("class").type)
            best = []
            if of.num_rows and lists.num_rows:
                coded = names.dictionary_encode()
                row, tau = coded.indices.to_numpy(), of.column("tau").to_numpy()
                taus = dict(zip(row.tolist(), tau.tolist()))
                place = pc.index_in(of.column("term"), value_set=lists.column("term").combine_chunks()).to_numpy()
                some = np.flatnonzero(place >= 0) if place.dtype.kind == "i" else np.flatnonzero(~np.isnan(place))
                some = some[np.argsort(place[some], kind="stable")]
                place, row, qw = place[some].astype(np.int64), row[some], of.column("qw").to_numpy()[some]
                entries = lists.column("entries").combine_chunks()
                e = entries.offsets.to_numpy()
                order, weight = (entries.values.field(c).to_numpy() for c in ("_ord", "w"))
                met, start = np.unique(place, return_index=True)
                end = np.append(start[1:], len(place))
                found = [(order[e[x]:e[x + 1]], weight[e[x]:e[x + 1]], row[a:b], qw[a:b]) for x, a, b in zip(met.tolist(), start.tolist(), end.tolist())]
                best = best_of_block(found, taus, k) if found else []
                names = coded.dictionary
            return pa.table({"class": names.take(pa.array([b[0] for b in best], pa.int64())),
                             "g": pa.array([key[0].as_py()] * len(best), pa.string()), "_ord": pa.array([b[1] for b in best], pa.int64()),
                             "sim": pa.array([b[2] for b in best], pa.float64())})

        # Both sides of a task as one table: rows with entries are lists, the others words of classes.
        both = held.select("g", "blk", "cblk", "class", "term", "qw", "tau").unionByName(
            lists.select(F.col("_g").alias("g"), F.col("_blk").alias("blk"), F.col("_cblk").alias("cblk"), "term", "entries"), allowMissingColumns=True)
        return both.groupBy("g", "blk", "cblk").applyInArrow(run, f"class {kind}, g string, _ord long, sim double")

    def topk(self, queries: DataFrame, query_vecs: DataFrame, q_id: str) -> DataFrame:
        """(q_id, keys, item_id, order_key, sim, rank): the k best items of each query, zeros filled in item order."""
        members, classes = self.classes(queries, query_vecs, q_id)
        w = Window.partitionBy("g").orderBy("_ord")
        if self.keys:
            first = self.items.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= self.k).select("g", "_ord")
        else:
            first = self.items.orderBy("_ord").limit(self.k).select("g", "_ord")
        fill = classes.select("class", "g").join(first, "g").withColumn("sim", F.lit(0.0))
        cands = self.search(classes).unionByName(fill).groupBy("class", "g", "_ord").agg(F.max("sim").alias("sim"))
        w = Window.partitionBy("class", "g").orderBy(F.col("sim").desc(), F.col("_ord").asc())
        best = cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= self.k).join(self.items, ["g", "_ord"])
        cols = list(dict.fromkeys([*self.keys, self.item_id, self.order_key]))
        return members.join(best, ["class", "g"]).select(F.col("q").alias(q_id), *cols, "sim", "rank")
