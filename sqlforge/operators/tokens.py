"""Token features C13 and segment lengths C14.

The default tokenizer is a regular expression (the 18 tags as single tokens,
Unicode words, single other characters) with a vocabulary ranked by corpus
frequency; a real tokenizer is plugged in through :func:`tokenizer_features`
(Arrow batches, one load per Python worker).

Ids: 0 pad, 1 end of text, 2 unknown, 3..20 the 18 tags in fixed order,
then corpus tokens from 21 by (count desc, token). Every sample keeps only its first
``max_length`` tokens, so a sample's list is bounded by the token budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ALL_TAGS, CLAUSES, MAX_LENGTH, SYSTEM_TEXT
from ..session import materialize
from .corpus import build_sft
from .generate import _loaded, model_name
from .ranking import global_row_number

TOKEN_RE = r"</?(?:clause_[a-z_]+|summary)>|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
PAD_ID, EOS_ID, UNK_ID, FIRST_TAG_ID = 0, 1, 2, 3
FIRST_WORD_ID = FIRST_TAG_ID + len(ALL_TAGS)
IGNORE = -100
TOKEN_BLOCK = 512     # texts that share a dictionary
FEATURES = 1 << 20    # ids of one kind that a tokenizer's worker holds at a time


def tokens(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(col, F.lit(TOKEN_RE), 0)


def full_tokens(texts: DataFrame) -> Column:
    """Tokens of the full text. With an ``answer`` they are the prompt's and the answer's: the prompt ends in a colon, a
    token of its own, so none reaches over its end."""
    return F.concat(tokens("prompt"), tokens("answer")) if "answer" in texts.columns else tokens("full")


def sft_texts(sft: DataFrame, system: str | None = None) -> DataFrame:
    """Prompt text (flat chat form) and full text of each training example."""
    sys_c = F.lit(system) if system is not None else F.coalesce(F.col("system"), F.lit(SYSTEM_TEXT))
    user = F.col("conversations")[0]["content"]
    asst = F.col("conversations")[1]["content"]
    prompt = F.concat(sys_c, F.lit("\n\nUser: "), user, F.lit("\nAssistant:"))
    carried = [c for c in ("source", "clauses", "query") if c in sft.columns]
    return sft.select("sample_id", *carried, prompt.alias("prompt"), asst.alias("answer"), F.concat(prompt, asst).alias("full"))


def build_vocab(texts: DataFrame, col: str = "full") -> DataFrame:
    """(token, n, id): corpus tokens by frequency; tags keep their fixed ids and are not listed."""
    return _ranked(texts.select(F.explode(tokens(col)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def _ranked(counts: DataFrame) -> DataFrame:
    counts = counts.filter(~F.col("token").isin(*ALL_TAGS))
    ranked = global_row_number(counts, [F.col("n").desc(), F.col("token").asc()], "rank")
    return ranked.select("token", "n", (F.col("rank") + FIRST_WORD_ID - 1).cast("int").alias("id"))


def encoded(texts: DataFrame, max_length: int = MAX_LENGTH, block: int = TOKEN_BLOCK) -> DataFrame:
    """Texts with dictionary-encoded tokens, in blocks of at most ``block`` texts of one input partition.

    Rows are of two kinds: (blk, sample_id, prompt_len, codes) for a text, its first ``max_length`` tokens as places in the block's
    dictionary, and (blk, token, n) for the dictionary, its tokens and how often the block's whole texts hold each.
    """
    kind = dict(texts.dtypes)["sample_id"]
    rows = texts.select("sample_id", F.size(tokens("prompt")).alias("prompt_len"), full_tokens(texts).alias("toks"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            # Left out here: Spark would find the tokens once more for a filter before.
            b = b.filter(pc.greater(pc.list_value_length(b.column("toks")), 0))
            for first in range(0, b.num_rows, block):
                some = b.slice(first, block)
                toks = some.column("toks")
                flat = toks.flatten().dictionary_encode()
                codes, ends = flat.indices.to_numpy(), np.cumsum(toks.value_lengths().to_numpy())
                starts = np.concatenate([[0], ends[:-1]])
                n, size = some.num_rows, np.minimum(ends - starts, max_length)
                kept = np.concatenate([codes[a:a + m] for a, m in zip(starts, size)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(kept, pa.int32()))
                count = np.bincount(codes, minlength=len(flat.dictionary))
                name = pa.array([part + made] * (n + 1), pa.int64())
                made += 1
                yield pa.RecordBatch.from_arrays(
                    [name, pa.concat_arrays([some.column("sample_id"), pa.nulls(1, some.column("sample_id").type)]),
                     pa.concat_arrays([some.column("prompt_len"), pa.nulls(1, pa.int32())]), pa.concat_arrays([lists, pa.nulls(1, lists.type)]),
                     pa.array([None] * n + [flat.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([None] * n + [count.tolist()], pa.list_(pa.int64()))],
                    names=["blk", "sample_id", "prompt_len", "codes", "token", "n"])

    return rows.mapInArrow(run, f"blk long, sample_id {kind}, prompt_len int, codes array<int>, token array<string>, n array<long>")


def token_features(sft: DataFrame, vocab: DataFrame | None = None, max_length: int = MAX_LENGTH) -> DataFrame:
    """input_ids, attention_mask, labels (prompt positions -100), truncated and padded to max_length.

    Tokens are never rows. Texts are encoded in blocks against a dictionary of the block (:func:`encoded`); only the dictionaries'
    entries, each token once a block, are counted for the vocabulary and looked up in it. A block's ids then come back as one array by
    which each text's codes are replaced where they are. A token of all texts is one row per block on either way.
    """
    texts = sft_texts(sft)
    spark = sft.sparkSession
    enc = materialize(encoded(texts, max_length), "sft-encoded")
    entries = enc.filter(F.col("token").isNotNull()).select("blk", F.posexplode(F.arrays_zip("token", "n")).alias("code", "e")) \
        .select("blk", "code", "e.token", "e.n")
    if vocab is None:
        vocab = _ranked(entries.groupBy("token").agg(F.sum("n").alias("n")))
    tags = spark.createDataFrame([(t, FIRST_TAG_ID + i) for i, t in enumerate(ALL_TAGS)], "token string, id int")
    ids = materialize(vocab.select("token", "id").unionByName(tags), "token-ids")
    looked = entries.join(ids, "token", "left").groupBy("blk") \
        .agg(F.array_sort(F.collect_list(F.struct("code", F.coalesce("id", F.lit(UNK_ID)).alias("id")))).alias("d")) \
        .select("blk", F.col("d.id").alias("_ids"))
    per = enc.filter(F.col("token").isNull()).select("blk", "sample_id", "prompt_len", "codes").join(looked, "blk") \
        .select("sample_id", "prompt_len", F.transform("codes", lambda c: F.get("_ids", c)).alias("p"))
    full_ids = F.slice(F.concat("p", F.array(F.lit(EOS_ID))), 1, max_length)
    per = per.select("sample_id", "prompt_len", full_ids.alias("ids"))
    n = F.size("ids")
    pad = F.lit(max_length) - n
    plen = F.least(F.col("prompt_len"), F.lit(max_length))
    labels = F.concat(F.array_repeat(F.lit(IGNORE), plen), F.slice("ids", plen + 1, F.greatest(n - plen, F.lit(0))))
    labels = F.slice(labels, 1, max_length)
    return per.select(
        "sample_id", "prompt_len", n.alias("n_tokens"),
        F.concat("ids", F.array_repeat(F.lit(PAD_ID), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
        F.concat(labels, F.array_repeat(F.lit(IGNORE), F.lit(max_length) - F.size(labels))).alias("labels"))


def segment_lengths(samples: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """C14: tokens in the prompt, in each clause, in the summary, in total, and the over-budget flag.

    ``samples`` carry schema and clauses through :func:`corpus.build_sft`, so nothing is joined back.
    """
    texts = sft_texts(build_sft(samples, keep=("clauses",)))
    cols = [F.size(tokens(F.col("clauses")[c])).alias(f"n_{c}") for c in CLAUSES]
    sized = texts.select("sample_id", "source", F.size(tokens("prompt")).alias("n_prompt"), *cols,
                         F.size(tokens("query")).alias("n_summary"), (F.size(full_tokens(texts)) + 1).alias("n_total"))
    return sized.withColumn("over_budget", F.col("n_total") > max_length)


def segment_quantiles(lengths: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), col: str = "n_total") -> DataFrame:
    """C14: exact quantiles per source: the least length that at least the given share of samples reaches.

    Samples are first counted per (source, length); the running sum is over those counts, so a source of any
    size is as many rows as it has different lengths.
    """
    per = lengths.groupBy("source", F.col(col).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("source")
    run = per.withColumn("upto", F.sum("n").over(whole.orderBy("length"))).withColumn("all", F.sum("n").over(whole))
    return run.groupBy("source").agg(
        *[F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("all")), F.col("length"))).cast("int").alias(f"p{round(q * 100)}")
          for q in shares], F.max("length").cast("int").alias("longest"))


def segment_profile(lengths: DataFrame, bucket: int = 256) -> DataFrame:
    """Per source and length bucket: samples, over-budget samples, mean and max of the total."""
    return lengths.groupBy("source", (F.floor(F.col("n_total") / bucket) * bucket).cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("over_budget").alias("n_over"),
        F.round(F.avg("n_total"), 9).alias("avg_total"), F.max("n_total").alias("max_total"))


def tokenizer_features(sft: DataFrame, load_tokenizer, max_length: int = MAX_LENGTH, pad_id: int = PAD_ID,
                       eos_id: int | None = EOS_ID, name: str | None = None) -> DataFrame:
    """C13 with a user tokenizer: prompt_len, n_tokens, input_ids, attention_mask, labels (prompt positions -100).

    ``load_tokenizer()`` gives ``fn(list[str]) -> list[list[int]]``; it is loaded once per Python worker.
    ``eos_id`` (unless None) ends the text where it fits. Truncated and padded to ``max_length``.
    """
    name = model_name(load_tokenizer, name)
    kind = dict(sft.dtypes)["sample_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _loaded(load_tokenizer, name)
        ends, step = () if eos_id is None else (eos_id,), max(1, FEATURES // max_length)
        # Rows are cut from plain lists: Spark makes lists of what it is given, of arrays element by element.
        pads, unseen, seen, past = ([x] * max_length for x in (pad_id, IGNORE, 1, 0))
        for batch in batches:
            for first in range(0, len(batch), step):
                df = batch.iloc[first:first + step]
                prompts, answers = df["prompt"].tolist(), df["answer"].tolist()
                asked = np.fromiter(map(len, encode(prompts)), np.int32, len(df))
                full = encode([None if p is None or a is None else p + a for p, a in zip(prompts, answers)])
                size = np.minimum(np.fromiter(map(len, full), np.int32, len(df)) + len(ends), max_length)
                flat = np.fromiter(chain.from_iterable(islice(chain(f[:max_length], ends), max_length) for f in full), np.int32, int(size.sum())).tolist()
                ids, mask, labels, begin = [], [], [], 0
                for n, k in zip(size.tolist(), np.minimum(asked, max_length).tolist()):
                    own = flat[begin:begin + n]
                    begin += n
                    ids.append(own + pads[n:])
                    mask.append(seen[:n] + past[n:])
                    labels.append(unseen[:k] + own[k:] + unseen[max(n, k):])
                yield pd.DataFrame({"sample_id": df["sample_id"].to_numpy(), "prompt_len": asked, "n_tokens": size, "input_ids": ids,
                                    "attention_mask": mask, "labels": labels})

    # The answer goes to the worker, not the full text: the prompt would be made and sent twice.
    return sft_texts(sft).select("sample_id", "prompt", "answer").mapInPandas(
        run, f"sample_id {kind}, prompt_len int, n_tokens int, input_ids array<int>, attention_mask array<int>, labels array<int>")


# ---------------------------------------------------------------- stub for tests and checks
def word_length_tokenizer():
    """Stub tokenizer: a token per run of non-space characters, its id 10 plus the run's length."""
    return lambda texts: [[10 + len(w) for w in t.split(" ") if w] for t in texts]
