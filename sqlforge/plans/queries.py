"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query builds its input from the driver tables (fixtures F1-F10 in
``sqlforge.fixtures``) and runs one operator or job of the library over the
whole table. Output columns are aliased to the names the oracles use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLAUSES
from ..fixtures import fixture
from ..functions import clauses as CL
from ..functions import text as TX
from ..functions.prompts import chat_messages, flat_prompt, user_prompt
from ..operators import corpus as C
from ..sources.catalog import catalog_from_tables, foreign_keys

Q = {}


def register(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def _flat_clauses(col: str, prefix: str = "cl_"):
    return [F.col(col)[c].alias(prefix + c) for c in CLAUSES]


# ------------------------------------------------------------------ corpus
@register("clause_split")
def q_clause_split(spark: SparkSession, sf: str) -> DataFrame:
    df = C.with_clauses(fixture(spark, sf, "qa_corpus"))
    return df.select("sample_id", *_flat_clauses("clauses"))


@register("clause_output")
def q_clause_output(spark, sf):
    df = C.with_clauses(fixture(spark, sf, "qa_corpus"))
    return df.select("sample_id", CL.clause_output(F.col("clauses"), F.col("query")).alias("output"))


@register("corpus_union")
def q_corpus_union(spark, sf):
    qa = fixture(spark, sf, "qa_corpus")
    kb = qa.filter(F.col("source") == "kb")
    plain = qa.filter(F.col("source") == "plain").drop("evidence", "difficulty")
    return C.unify_corpora(plain, kb).select("sample_id", "source", "split", "db_id", "question",
                                              "query", "evidence", "difficulty")


@register("clause_profile")
def q_clause_profile(spark, sf):
    return C.clause_profile(fixture(spark, sf, "qa_corpus"))


@register("catalog_tables")
def q_catalog_tables(spark, sf):
    return catalog_from_tables(spark, sf)


@register("schema_text_typed")
def q_schema_text_typed(spark, sf):
    return C.serialize_schema_typed(catalog_from_tables(spark, sf))


@register("schema_text_compact")
def q_schema_text_compact(spark, sf):
    return C.serialize_schema(catalog_from_tables(spark, sf), foreign_keys(spark), compact=True)


@register("schema_text_bullets")
def q_schema_text_bullets(spark, sf):
    return C.serialize_schema(catalog_from_tables(spark, sf), foreign_keys(spark), compact=False)


def _corpus_with_schema(spark, sf):
    schema = C.serialize_schema_typed(catalog_from_tables(spark, sf))
    return C.attach_schema(fixture(spark, sf, "qa_corpus"), schema)


@register("sft_build")
def q_sft_build(spark, sf):
    sft = C.build_sft(_corpus_with_schema(spark, sf))
    return sft.select("sample_id", "split", "system",
                      F.col("conversations")[0]["content"].alias("user_text"),
                      F.col("conversations")[1]["content"].alias("assistant_text"),
                      "db_id", "source", "query")


@register("sft_counts")
def q_sft_counts(spark, sf):
    return C.sft_counts(fixture(spark, sf, "qa_corpus"))


@register("sft_shuffle")
def q_sft_shuffle(spark, sf):
    sft = C.shuffle_train(C.build_sft(_corpus_with_schema(spark, sf)), seed=42)
    return sft.select("sample_id", "split", "shuffle_key")


@register("user_prompt")
def q_user_prompt(spark, sf):
    df = _corpus_with_schema(spark, sf)
    return df.select("sample_id", user_prompt(F.col("schema"), F.col("question"), F.col("evidence"),
                                              F.col("db_id"), with_prefix=(True)).alias("prompt"))


@register("chat_messages")
def q_chat_messages(spark, sf):
    df = _corpus_with_schema(spark, sf)
    u = user_prompt(F.col("schema"), F.col("question"), F.col("evidence"), F.col("db_id"))
    m = chat_messages(C.SYSTEM_TEXT, u)
    return df.select("sample_id", F.size(m).alias("n_messages"),
                     F.md5(flat_prompt(C.SYSTEM_TEXT, u)).alias("flat_md5"),
                     F.md5(m[1]["content"]).alias("user_md5"))


# ------------------------------------------------------------------ parsing
@register("extract_clauses")
def q_extract_clauses(spark, sf):
    df = fixture(spark, sf, "model_outputs")
    return df.select("sample_id", CL.extract_clauses(F.col("output")).alias("c")) \
             .select("sample_id", *_flat_clauses("c"))


@register("extract_summary")
def q_extract_summary(spark, sf):
    df = fixture(spark, sf, "model_outputs")
    return df.select("sample_id", CL.extract_summary(F.col("output")).alias("summary"))


@register("assemble_sql")
def q_assemble_sql(spark, sf):
    df = fixture(spark, sf, "model_outputs")
    return df.select("sample_id", CL.assemble_sql(CL.extract_clauses(F.col("output"))).alias("assembled"))


@register("final_sql")
def q_final_sql(spark, sf):
    df = fixture(spark, sf, "model_outputs")
    return df.select("sample_id", CL.final_sql(F.col("output")).alias("final_sql"))


@register("extract_reflection")
def q_extract_reflection(spark, sf):
    df = fixture(spark, sf, "model_outputs")
    r = CL.extract_reflection(F.col("output"))
    return df.select("sample_id", r["reasoning"].alias("reasoning"), r["answer"].alias("answer"))


@register("round_trip")
def q_round_trip(spark, sf):
    """assemble(split(q)) compared with q under normalisation, per template shape."""
    df = C.with_clauses(fixture(spark, sf, "qa_corpus"))
    same = TX.normalize_sql(CL.assemble_sql(F.col("clauses"))) == TX.normalize_sql(F.col("query"))
    return df.groupBy((F.col("sample_id") % 8).alias("shape")).agg(
        F.count_if(same).alias("n_same"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ exact match
@register("normalize_sql")
def q_normalize_sql(spark, sf):
    df = fixture(spark, sf, "pairs")
    return df.select("sample_id", TX.normalize_sql(F.col("pred_sql")).alias("norm_pred"),
                     TX.normalize_sql(F.col("gold_sql")).alias("norm_gold"))


@register("exact_match")
def q_exact_match(spark, sf):
    df = fixture(spark, sf, "pairs")
    return df.select("sample_id", (TX.normalize_sql("pred_sql") == TX.normalize_sql("gold_sql")).alias("em"))


@register("exact_match_rate")
def q_exact_match_rate(spark, sf):
    em = q_exact_match(spark, sf)
    return em.agg(F.coalesce(F.round(F.avg(F.col("em").cast("double")), 9), F.lit(0.0)).alias("em_rate"),
                  F.count(F.lit(1)).alias("n"))



# ------------------------------------------------------------------ execution results
from ..operators import evaluate as EV  # noqa: E402
from ..operators import rewards as RW  # noqa: E402


def _results(spark, sf):
    return fixture(spark, sf, "result_rows"), fixture(spark, sf, "result_status")


@register("execution_match")
def q_execution_match(spark, sf):
    rows, status = _results(spark, sf)
    return EV.execution_match(rows, status)


@register("execution_match_rate")
def q_execution_match_rate(spark, sf):
    return EV.rate(q_execution_match(spark, sf), "ex", "ex_rate")


@register("result_f1")
def q_result_f1(spark, sf):
    rows, status = _results(spark, sf)
    samples = status.select("sample_id").distinct()
    return RW.result_token_f1(rows, samples).select("sample_id", F.round("f1", 9).alias("f1"))


@register("reward_execution")
def q_reward_execution(spark, sf):
    rows, status = _results(spark, sf)
    return RW.reward_execution(rows, status).select("sample_id", F.round("r_exec", 9).alias("r_exec"))


@register("difficulty_breakdown")
def q_difficulty_breakdown(spark, sf):
    return EV.difficulty_breakdown(fixture(spark, sf, "eval_rows"))


@register("eval_details")
def q_eval_details(spark, sf):
    samples = fixture(spark, sf, "qa_corpus")
    preds = fixture(spark, sf, "pairs")
    return EV.eval_details(samples, preds, q_execution_match(spark, sf))


@register("eval_summary")
def q_eval_summary(spark, sf):
    return EV.eval_summary(q_eval_details(spark, sf))


# ------------------------------------------------------------------ text rewards
@register("reward_format")
def q_reward_format(spark, sf):
    df = fixture(spark, sf, "model_outputs")
    return df.select("sample_id", F.round(RW.reward_format(F.col("output")), 9).alias("r_format"))


@register("schema_tokens")
def q_schema_tokens(spark, sf):
    df = fixture(spark, sf, "qa_corpus")
    t = TX.schema_tokens(F.col("query"))
    return df.select("sample_id", F.size(t).alias("n_tokens"), F.array_join(F.array_sort(t), ",").alias("tokens"))


@register("reward_schema")
def q_reward_schema(spark, sf):
    df = fixture(spark, sf, "pairs")
    return df.select("sample_id", F.round(RW.reward_schema(F.col("pred_sql"), F.col("gold_sql")), 9).alias("r_schema"))


@register("ngram_counts")
def q_ngram_counts(spark, sf):
    df = fixture(spark, sf, "qa_corpus")
    g = TX.ngrams(F.col("query"), 2)
    return df.select("sample_id", F.size(g).alias("n_ngrams"), F.array_join(g, "|").alias("ngrams"))


@register("reward_ngram")
def q_reward_ngram(spark, sf):
    df = fixture(spark, sf, "pairs")
    return RW.reward_ngram(df).select("sample_id", F.round("r_ngram", 9).alias("r_ngram"))


@register("output_quality")
def q_output_quality(spark, sf):
    from ..operators.outputs import output_quality
    outs = fixture(spark, sf, "model_outputs").join(
        fixture(spark, sf, "qa_corpus").select("sample_id", "source"), "sample_id")
    return output_quality(outs)
FLAGSHIP = "eval_summary"


# ------------------------------------------------------------------ guarded execution (fixed pairs, F4)
from ..operators import execute as EX  # noqa: E402


def _pair_texts(spark, sf):
    p = fixture(spark, sf, "sql_pairs")
    return p, p.select(F.col("pred_sql").alias("sql")).unionByName(p.select(F.col("gold_sql").alias("sql")))


def _run_pairs(spark, sf):
    p, texts = _pair_texts(spark, sf)
    status, rows = EX.run_sql_batch(spark, texts, timeout=30.0)
    return p, status, rows


@register("sql_batch_status")
def q_sql_batch_status(spark, sf):
    p, status, rows = _run_pairs(spark, sf)
    rw, st = EV.pair_results(p, status, rows)
    return st.select("sample_id", "side", "status")


@register("sql_batch_rows")
def q_sql_batch_rows(spark, sf):
    p, status, rows = _run_pairs(spark, sf)
    rw, st = EV.pair_results(p, status, rows)
    ordered = st.select("sample_id", "side", TX.has_order_by("sql").alias("o"))
    return rw.join(ordered, ["sample_id", "side"]).select(
        "sample_id", "side", "row_str", F.when(F.col("o"), F.col("row_no")).alias("row_pos"))


@register("execution_match_fixed")
def q_execution_match_fixed(spark, sf):
    p, status, rows = _run_pairs(spark, sf)
    rw, st = EV.pair_results(p, status, rows)
    return EV.execution_match(rw, st)


@register("sql_validity")
def q_sql_validity(spark, sf):
    p, texts = _pair_texts(spark, sf)
    v = EX.sql_validity(spark, texts)
    sides = p.select("sample_id", F.lit("pred").alias("side"), F.col("pred_sql").alias("sql")) \
        .unionByName(p.select("sample_id", F.lit("gold").alias("side"), F.col("gold_sql").alias("sql")))
    return sides.withColumn("sql_id", EX.sql_id_col("sql")).join(v, "sql_id").select("sample_id", "side", "validity")


@register("exec_feedback")
def q_exec_feedback(spark, sf):
    rows = fixture(spark, sf, "result_rows").filter(F.col("side") == "pred")
    status = fixture(spark, sf, "result_status_err").filter(F.col("side") == "pred")
    return EX.exec_feedback(rows, status, key="sample_id")


# ------------------------------------------------------------------ retrieval
from ..operators import generate as GE  # noqa: E402
from ..operators import retrieval as R  # noqa: E402
from ..operators.corpus import serialize_schema  # noqa: E402
from ..session import materialize  # noqa: E402


def _catalog(spark, sf):
    return catalog_from_tables(spark, sf)


def _known(spark, sf):
    return fixture(spark, sf, "questions_placed")


@register("bow_vectors")
def q_bow_vectors(spark, sf):
    v = R.bow_vectors(fixture(spark, sf, "questions"), ["q_id"], "question")
    return v.select("q_id", "term", F.round("w", 9).alias("w"))


@register("db_registry")
def q_db_registry(spark, sf):
    reg = R.build_registry(_catalog(spark, sf))
    return reg.select("db_ord", "db_id", "description", F.array_join("keywords", ",").alias("keywords"))


@register("keyword_score")
def q_keyword_score(spark, sf):
    reg = R.build_registry(_catalog(spark, sf))
    h = R.keyword_hits(fixture(spark, sf, "questions"), reg)
    return h.select("q_id", "db_id", F.round("kw_score", 9).alias("kw_score"))


@register("route_topk")
def q_route_topk(spark, sf):
    reg = R.build_registry(_catalog(spark, sf))
    r = R.route(fixture(spark, sf, "questions"), reg)
    return r.select("q_id", "db_id", "score", F.col("rank").cast("int").alias("rank"))


def _tables(spark, sf):
    return R.rank_tables(_known(spark, sf), _catalog(spark, sf))


@register("rank_tables")
def q_rank_tables(spark, sf):
    return _tables(spark, sf).select("q_id", "db_id", "table_name", "table_score",
                                     F.col("table_rank").cast("int").alias("table_rank"))


@register("prune_columns")
def q_prune_columns(spark, sf):
    cols = R.prune_columns(_known(spark, sf), _tables(spark, sf), _catalog(spark, sf))
    return cols.select("q_id", "table_name", "col_name", F.col("col_rank").cast("int").alias("col_rank"))


@register("fewshot_topk")
def q_fewshot_topk(spark, sf):
    r = R.fewshot(_known(spark, sf), fixture(spark, sf, "history"))
    return r.select("q_id", "db_id", "hist_ord", "sim", F.col("rank").cast("int").alias("rank"))


@register("fewshot_vectors")
def q_fewshot_vectors(spark, sf):
    q = fixture(spark, sf, "vec_queries").withColumnRenamed("vec_id", "q_id")
    r = R.dense_fewshot(q, fixture(spark, sf, "vec_history"), k=3, key="label")
    return r.select("q_id", "vec_id", "sim", F.col("rank").cast("int").alias("rank"))


@register("route_vectors")
def q_route_vectors(spark, sf):
    """R6 with encoder vectors (the stub encoder of R3)."""
    reg = R.build_registry(_catalog(spark, sf))
    r = R.route(fixture(spark, sf, "questions"), reg, encoder=GE.letter_encoder)
    return r.select("q_id", "db_id", "score", F.col("rank").cast("int").alias("rank"))


@register("rank_tables_vectors")
def q_rank_tables_vectors(spark, sf):
    r = R.rank_tables(_known(spark, sf), _catalog(spark, sf), encoder=GE.letter_encoder)
    return r.select("q_id", "db_id", "table_name", "table_score", F.col("table_rank").cast("int").alias("table_rank"))


@register("rag_link_vectors")
def q_rag_link_vectors(spark, sf):
    """R11 with encoder vectors in routing, tables, columns and examples."""
    cat = _catalog(spark, sf)
    out = R.link(fixture(spark, sf, "questions"), R.build_registry(cat), cat, fixture(spark, sf, "history"), encoder=GE.letter_encoder)
    routing = F.array_join(F.transform("routing", lambda x: F.concat(x["db_id"], F.lit(":"), F.format_number(x["score"], 9))), ";")
    return out.select("q_id", "selected_db", routing.alias("routing"), F.md5("context").alias("context_md5"))


@register("cosine_pairs")
def q_cosine_pairs(spark, sf):
    e = fixture(spark, sf, "vec_history")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(R.cosine("embedding", "next_embedding"), 9).alias("cos"))


@register("prompt_context")
def q_prompt_context(spark, sf):
    cat, known, hist = _catalog(spark, sf), _known(spark, sf), fixture(spark, sf, "history")
    # Both feed several branches, as in R11: made once.
    qv = materialize(R.text_vectors(known, ["q_id"], "question"), "question-vectors")
    tables = materialize(R.rank_tables(known, cat, question_vecs=qv), "ranked-tables")
    cols = R.prune_columns(known, tables, cat, question_vecs=qv)
    shots = R.fewshot(known, hist, question_vecs=qv)
    ctx = R.prompt_context(known, tables, cols, shots, hist)
    return ctx.select("q_id", F.length("context").alias("n_chars"), F.md5("context").alias("context_md5"))


@register("rag_link")
def q_rag_link(spark, sf):
    cat = _catalog(spark, sf)
    out = R.link(fixture(spark, sf, "questions"), R.build_registry(cat), cat, fixture(spark, sf, "history"))
    routing = F.array_join(F.transform("routing", lambda x: F.concat(x["db_id"], F.lit(":"),
                                                                      F.format_number(x["score"], 9))), ";")
    return out.select("q_id", "selected_db", routing.alias("routing"), F.md5("context").alias("context_md5"))


@register("schema_line_filter")
def q_schema_line_filter(spark, sf):
    text = serialize_schema(_catalog(spark, sf), foreign_keys(spark), compact=False)
    j = _known(spark, sf).join(text, "db_id")
    kept = R.keep_relevant_lines(F.col("question"), F.col("schema"))
    return j.select("q_id", F.size(F.split(kept, "\n")).alias("n_lines"), F.md5(kept).alias("kept_md5"))


# ------------------------------------------------------------------ reflection and rollouts
from ..operators import rollouts as RO  # noqa: E402


def _reflection(spark, sf):
    details = q_eval_details(spark, sf)
    corpus = _corpus_with_schema(spark, sf)
    return RO.reflection_set(details, corpus)


@register("reflection_set")
def q_reflection_set(spark, sf):
    r = _reflection(spark, sf)
    return r.select("sample_id", "question", F.md5("schema").alias("schema_md5"), "evidence", "pred_sql", "gold_sql")


@register("reflection_prompt")
def q_reflection_prompt(spark, sf):
    r = _reflection(spark, sf)
    rows = fixture(spark, sf, "result_rows").filter(F.col("side") == "pred")
    status = fixture(spark, sf, "result_status_err").filter(F.col("side") == "pred")
    fb = EX.exec_feedback(rows, status, key="sample_id")
    p = RO.with_reflection_prompt(r.join(fb, "sample_id", "left"))
    return p.select("sample_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


@register("reflection_chat")
def q_reflection_chat(spark, sf):
    rows = fixture(spark, sf, "result_rows").filter(F.col("side") == "pred")
    status = fixture(spark, sf, "result_status_err").filter(F.col("side") == "pred")
    p = RO.with_reflection_prompt(_reflection(spark, sf).join(EX.exec_feedback(rows, status, key="sample_id"), "sample_id", "left"))
    return p.select("sample_id", F.size("messages").alias("n_messages"), F.col("messages")[0]["role"].alias("first_role"),
                    F.md5(F.col("messages")[1]["content"]).alias("user_md5"), F.md5("flat").alias("flat_md5"))


@register("group_advantage")
def q_group_advantage(spark, sf):
    r = RO.group_advantage(fixture(spark, sf, "rollouts"))
    return r.select("group_id", "output_idx", F.round("advantage", 6).alias("advantage"))


@register("informative_groups")
def q_informative_groups(spark, sf):
    r = RO.informative_groups(fixture(spark, sf, "rollouts"))
    return r.select("group_id", "output_idx", F.round("advantage", 6).alias("advantage"))


@register("clipped_objective")
def q_clipped_objective(spark, sf):
    r = RO.clipped_objective(fixture(spark, sf, "rollouts"))
    return r.select("group_id", F.round("loss", 6).alias("loss"))


@register("group_rewards")
def q_group_rewards(spark, sf):
    r = RO.group_rewards(fixture(spark, sf, "rollouts"))
    return r.select("group_id", F.round("mean_reward", 9).alias("mean_reward"), "flat")


@register("training_log")
def q_training_log(spark, sf):
    r = RO.training_log(fixture(spark, sf, "rollouts"))
    return r.select("global_step", "epoch", "step", "group_id", "avg_reward", F.round("loss", 6).alias("loss"))


def _syntax(spark, sf, texts_df, col):
    """r_syntax (W4) of a text column: the texts' shapes are planned against the tables they name."""
    register_tables(spark, sf, ("customer", "orders", "nation", "region"))
    states = EX.sql_validity(spark, texts_df.select(F.col(col).alias("sql")))
    return texts_df.withColumn("sql_id", EX.sql_id_col(col)).join(states, "sql_id", "left") \
        .withColumn("r_syntax", F.coalesce("validity", F.lit(0.0))).drop("sql_id", "validity")


@register("corpus_validity")
def q_corpus_validity(spark, sf):
    """W4 over all predicted texts of the corpus."""
    return _syntax(spark, sf, fixture(spark, sf, "pairs"), "pred_sql").select("sample_id", "r_syntax")


@register("reward_total")
def q_reward_total(spark, sf):
    pairs = fixture(spark, sf, "pairs")
    rows, status = _results(spark, sf)
    exec_r = RW.reward_execution(rows, status)
    outs = fixture(spark, sf, "model_outputs").select("sample_id", RW.reward_format(F.col("output")).alias("r_format"))
    df = (_syntax(spark, sf, pairs, "pred_sql")
          .withColumn("r_schema", RW.reward_schema(F.col("pred_sql"), F.col("gold_sql")))
          .join(RW.reward_ngram(pairs), "sample_id")
          .join(exec_r, "sample_id").join(outs, "sample_id"))
    t = RW.reward_total(df)
    return t.select("sample_id", *[F.round(c, 9).alias(c) for c in
                                   ("r_exec", "r_format", "r_syntax", "r_schema", "r_ngram", "r_total")])


@register("rollout_rewards")
def q_rollout_rewards(spark, sf):
    """Reflection outputs -> answer (P6) -> rewards (W9) per output -> group advantage."""
    outs = fixture(spark, sf, "model_outputs")
    gold = fixture(spark, sf, "qa_corpus").select("sample_id", F.col("query").alias("gold_sql"))
    rows, status = _results(spark, sf)
    exec_r = RW.reward_execution(rows, status)
    a = outs.select("sample_id", CL.extract_reflection(F.col("output"))["answer"].alias("answer"), RW.reward_format(F.col("output")).alias("r_format"))
    a = materialize(a.join(gold, "sample_id"), "answers")      # feeds validity, n-grams and schema
    df = (_syntax(spark, sf, a, "answer")
          .withColumn("r_schema", RW.reward_schema(F.col("answer"), F.col("gold_sql")))
          .join(RW.reward_ngram(a, "answer"), "sample_id")
          .join(exec_r, "sample_id"))
    t = RW.reward_total(df).select(F.floor(F.col("sample_id") / 8).cast("long").alias("group_id"),
                                   (F.col("sample_id") % 8).cast("int").alias("output_idx"),
                                   F.col("r_total").alias("reward"))
    g = RO.group_advantage(t)
    return g.select("group_id", "output_idx", F.round("reward", 9).alias("reward"),
                    F.round("advantage", 6).alias("advantage"))


@register("training_log_runs")
def q_training_log_runs(spark, sf):
    """G8 over three epochs of two runs; group ids recur in each."""
    r = RO.training_log(fixture(spark, sf, "rollout_runs"), epoch_col="epoch", run_col="run_id")
    return r.select("run_id", "global_step", "epoch", "step", "group_id", "avg_reward", F.round("loss", 6).alias("loss"))


# ------------------------------------------------------------------ token features (F1)
from ..operators import tokens as TK  # noqa: E402


def _sft(spark, sf):
    return C.build_sft(_corpus_with_schema(spark, sf))


@register("sft_vocab")
def q_sft_vocab(spark, sf):
    return TK.build_vocab(TK.sft_texts(_sft(spark, sf)))


@register("sft_features")
def q_sft_features(spark, sf):
    f = TK.token_features(_sft(spark, sf))
    return f.select("sample_id", "prompt_len", "n_tokens",
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                    F.md5(F.array_join("labels", ",")).alias("labels_md5"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_mask"),
                    F.size("input_ids").alias("width"))


@register("segment_lengths")
def q_segment_lengths(spark, sf):
    return TK.segment_lengths(C.with_clauses(_corpus_with_schema(spark, sf)))


@register("segment_profile")
def q_segment_profile(spark, sf):
    return TK.segment_profile(q_segment_lengths(spark, sf))


@register("segment_quantiles")
def q_segment_quantiles(spark, sf):
    return TK.segment_quantiles(q_segment_lengths(spark, sf))


@register("sft_features_user")
def q_sft_features_user(spark, sf):
    """C13 with a plugged-in tokenizer (a stub whose ids SQL can give too)."""
    f = TK.tokenizer_features(_sft(spark, sf), TK.word_length_tokenizer)
    return f.select("sample_id", "prompt_len", "n_tokens", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                    F.md5(F.array_join("labels", ",")).alias("labels_md5"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_mask"))


# ------------------------------------------------------------------ sources and sinks (round trips of whole tables)
from ..session import register_tables, shared_path  # noqa: E402
from ..sources import io as IO  # noqa: E402


def _scratch(spark) -> str:
    import uuid
    return shared_path(spark, "round-trips", uuid.uuid4().hex)


ARRAY_FILES = 4


@register("source_qa_round_trip")
def q_source_qa_round_trip(spark, sf):
    """The corpus written as JSON Lines per source and read back; ids stay distinct across inputs."""
    base, qa = _scratch(spark), fixture(spark, sf, "qa_corpus")
    parts = []
    for k, (source, knowledge) in enumerate((("plain", False), ("kb", True))):
        raw = qa.filter(F.col("source") == source).select(
            "db_id", "question", F.col("query").alias("SQL" if knowledge else "query"),
            *([F.col("evidence"), F.col("difficulty")] if knowledge else []))
        raw.write.json(f"{base}/{source}.jsonl")
        parts.append(IO.read_qa_json(spark, f"{base}/{source}.jsonl", source, "train", knowledge, number=k))
    u = C.unify_corpora(*parts)
    return u.groupBy("source", "db_id", "question", "query", "evidence", "difficulty").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("n_ids"))


@register("source_array_round_trip")
def q_source_array_round_trip(spark, sf):
    """The corpus written as pretty-printed JSON arrays and read back in splits; every sample has an id of its own."""
    base = _scratch(spark)
    qa = fixture(spark, sf, "qa_corpus").filter(F.col("source") == "plain").select("db_id", "question", "query")
    # Arrays of a few hundred samples; a file holds several, one after another.
    arrays = qa.groupBy(F.pmod(F.xxhash64("question"), F.lit(ARRAY_FILES)).alias("_f"), F.pmod(F.xxhash64("query"), F.lit(64)).alias("_a")) \
        .agg(F.to_json(F.collect_list(F.struct("db_id", "question", "query")), {"pretty": "true"}).alias("value"))
    arrays.repartition(ARRAY_FILES, "_f").select("value").write.text(f"{base}/arrays")
    got = IO.read_qa_json(spark, f"{base}/arrays", "plain", "train", number=0)
    return got.groupBy("source", "db_id", "question", "query").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("n_ids"))


@register("missing_source")
def q_missing_source(spark, sf):
    """A corpus of two inputs of which one is missing has the rows of the other, under the same columns."""
    base = _scratch(spark)
    qa = fixture(spark, sf, "qa_corpus").select("db_id", "question", "query")
    qa.write.json(f"{base}/there.jsonl")
    both = C.unify_corpora(*(IO.read_qa_json(spark, f"{base}/{n}.jsonl", n, "train", number=k) for k, n in enumerate(("there", "absent"))))
    return both.groupBy("source", "db_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("question")).alias("question_chars"))


@register("split_round_trip")
def q_split_round_trip(spark, sf):
    """The training set written per split and read back line by line."""
    base = _scratch(spark)
    IO.write_split(C.build_sft(_corpus_with_schema(spark, sf)), base)
    parts = [IO.read_jsonl(spark, f"{base}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "dev")]
    return parts[0].unionByName(parts[1]).select(
        "split", "system", F.col("conversations")[0]["content"].alias("user_text"),
        F.col("conversations")[1]["content"].alias("assistant_text"), "db_id", "source", "query")


@register("report_round_trip")
def q_report_round_trip(spark, sf):
    """The evaluation report written and read back."""
    base, details = _scratch(spark), q_eval_details(spark, sf)
    IO.write_eval_report(details, EV.eval_summary(details), base)
    return IO.read_stage1(spark, base).select(F.col("detail_ord").alias("sample_id"), "db_id", "question", "evidence", "difficulty",
                                              "gold_sql", "pred_sql", "ex", "em")


# ------------------------------------------------------------------ user model surfaces (stub models)

@register("batch_generate")
def q_batch_generate(spark, sf):
    df = _corpus_with_schema(spark, sf).select(
        "sample_id", user_prompt(F.col("schema"), F.col("question"), F.col("evidence"), F.col("db_id")).alias("prompt"))
    return GE.batch_generate(df, GE.length_generator, batch_size=16)


@register("embed_questions")
def q_embed_questions(spark, sf):
    e = GE.embed(fixture(spark, sf, "questions"), GE.letter_encoder)
    return e.select("q_id", F.array_join(F.transform("embedding", lambda x: x.cast("int")), ",").alias("vector"))
