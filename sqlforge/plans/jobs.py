"""User-level jobs J1-J6: whole tables in, tables out.

Each job is one lazy plan over DataFrames except where SQL text has to be
run (J4-J6), which goes through the guarded runner and its written results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EVAL_TIMEOUT_S, FEEDBACK_ROWS, REWARD_TIMEOUT_S, REWARD_WEIGHTS
from ..functions.clauses import extract_reflection
from ..operators import corpus as C
from ..operators import evaluate as EV
from ..operators import execute as EX
from ..operators import rewards as RW
from ..operators import rollouts as RO
from ..operators.outputs import output_quality, parse_outputs
from ..operators.retrieval import build_registry, link
from ..sources import catalog as CAT
from ..sources import io as IO


def prepare_corpus(spark: SparkSession, inputs: list[tuple[str, str, str, bool]], catalog_root: str,
                   out: str | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """QA files + catalog -> training set (written per split), counts, clause profile.

    ``inputs``: (path, source, split, with_evidence) per file.
    """
    parts = [IO.read_qa_json(spark, p, src, split, ev, number=k) for k, (p, src, split, ev) in enumerate(inputs)]
    samples = C.with_clauses(C.unify_corpora(*parts))
    schema = C.serialize_schema_typed(CAT.scan_catalog(spark, catalog_root))
    samples = C.attach_schema(samples, schema)
    sft = C.shuffle_train(C.build_sft(samples), seed)
    if out:
        IO.write_split(sft.repartitionByRange("split", "shuffle_key").sortWithinPartitions("shuffle_key"), out)
    return {"sft": sft, "counts": C.sft_counts(samples), "profile": C.clause_profile(samples)}


def parse_model_outputs(outputs: DataFrame, text: str = "output", by: str = "source") -> dict[str, DataFrame]:
    """Final SQL and clauses per output, plus the quality report."""
    return {"parsed": parse_outputs(outputs, text), "quality": output_quality(outputs, text, by)}


def link_questions(spark: SparkSession, questions: DataFrame, catalog_root: str,
                   history: DataFrame | None = None, **kw) -> DataFrame:
    """Routing, schema retrieval, examples and context text per question."""
    cat = CAT.scan_catalog(spark, catalog_root)
    registry = build_registry(cat, CAT.database_ids(spark, catalog_root))
    return link(questions, registry, cat, history, **kw)


def _run_pairs(spark: SparkSession, pairs: DataFrame, timeout: float, catalog_root: str | None) -> tuple[DataFrame, DataFrame]:
    """Run both SQL texts of (sample_id[, db_id], pred_sql, gold_sql), each in its database's session."""
    texts = pairs.select(*[c for c in ("db_id",) if c in pairs.columns], F.explode(F.array("pred_sql", "gold_sql")).alias("sql"))
    return EX.run_sql_batch(spark, texts, timeout=timeout, db_col="db_id" if "db_id" in pairs.columns else None,
                            session_of=EX.database_sessions(spark, catalog_root) if catalog_root else None)


def evaluate(spark: SparkSession, samples: DataFrame, preds: DataFrame, timeout: float = EVAL_TIMEOUT_S,
             out: str | None = None, catalog_root: str | None = None) -> dict[str, DataFrame]:
    """Run pred and gold SQL under guard, execution match, exact match, breakdown, report.

    ``samples``: sample_id, db_id, question, evidence, difficulty, query;
    ``preds``: sample_id, pred_sql. With ``catalog_root`` each sample runs on its own database
    (``<catalog_root>/<db_id>/<table>.parquet``); without it tables must be registered in this session.
    """
    pairs = samples.select("sample_id", "db_id", F.col("query").alias("gold_sql")).join(
        preds.select("sample_id", "pred_sql"), "sample_id", "left").fillna("", subset=["pred_sql"])
    status, rows = _run_pairs(spark, pairs, timeout, catalog_root)
    rw, st = EV.pair_results(pairs, status, rows)
    details = EV.eval_details(samples, preds, EV.execution_match(rw, st))
    summary = EV.eval_summary(details)
    if out:
        IO.write_eval_report(details, summary, out)
    return {"details": details, "summary": summary, "breakdown": EV.difficulty_breakdown(details)}


def score(spark: SparkSession, scored: DataFrame, timeout: float = REWARD_TIMEOUT_S,
          weights: dict | None = None, catalog_root: str | None = None) -> DataFrame:
    """Rewards of (sample_id[, db_id], output, pred_sql, gold_sql): exec, format, syntax, schema, ngram, total.

    The syntax part is what the run says of planning, so no text is planned twice.
    """
    pairs = scored.select("sample_id", *[c for c in ("db_id",) if c in scored.columns], "pred_sql", "gold_sql")
    status, rows = _run_pairs(spark, pairs, timeout, catalog_root)
    rw, st = EV.pair_results(pairs, status, rows)
    r_exec = RW.reward_execution(rw, st)
    planned = st.filter(F.col("side") == "pred").select("sample_id", F.col("planned").alias("_planned"))
    df = (scored.join(planned, "sample_id", "left")
          .withColumn("r_syntax", EX.validity_of("pred_sql", "_planned"))
          .withColumn("r_format", RW.reward_format(F.col("output")))
          .withColumn("r_schema", RW.reward_schema(F.col("pred_sql"), F.col("gold_sql")))
          .join(RW.reward_ngram(scored), "sample_id")
          .join(r_exec, "sample_id").drop("_planned"))
    return RW.reward_total(df, weights or REWARD_WEIGHTS)


def reflection_inputs(spark: SparkSession, stage1_path: str, corpus: DataFrame, only_wrong: bool = True,
                      timeout: float = EVAL_TIMEOUT_S, catalog_root: str | None = None) -> DataFrame:
    """Evaluation report + corpus -> reflection prompts with execution feedback of the wrong SQL.

    Only the rows that the feedback shows are taken from each query.
    """
    details = IO.read_stage1(spark, stage1_path).withColumnRenamed("detail_ord", "sample_id")
    refl = RO.reflection_set(details, corpus, only_wrong)
    status, rows = EX.run_sql_batch(spark, refl, "pred_sql", timeout=timeout, db_col="db_id", max_rows=FEEDBACK_ROWS,
                                    session_of=EX.database_sessions(spark, catalog_root) if catalog_root else None)
    fb = EX.exec_feedback(rows, status)
    return RO.with_reflection_prompt(refl.withColumn("sql_id", EX.sql_id_col("pred_sql", "db_id")).join(fb, "sql_id", "left"))


def rollout_statistics(rollouts: DataFrame, epoch_col: str | None = None, run_col: str | None = None) -> dict[str, DataFrame]:
    """Advantages, informative rows, objective per group, mean rewards, training log."""
    return {"advantages": RO.group_advantage(rollouts), "informative": RO.informative_groups(rollouts),
            "objective": RO.clipped_objective(rollouts), "group_rewards": RO.group_rewards(rollouts),
            "log": RO.training_log(rollouts, epoch_col=epoch_col, run_col=run_col)}


def reflection_answers(outputs: DataFrame, text: str = "output") -> DataFrame:
    """Corrected SQL of reflection outputs (reasoning/answer tags or a SQL fence)."""
    r = extract_reflection(F.col(text))
    return outputs.withColumn("reasoning", r["reasoning"]).withColumn("pred_sql", r["answer"])
