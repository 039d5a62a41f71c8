"""

Each entry runs on DuckDB over the pre-registered driver views. Fixtures are
embedded as CTEs with the same SQL text that Spark runs. Nothing here calls
library code; only fixed values (tags, keyword lists, default texts) are
shared, because they are data.
"""

from __future__ import annotations

from sqlforge import constants as K
from sqlforge.fixtures import cte
from sqlforge.functions.prompts import HEADERS as H

ORACLES: dict[str, str] = {}

NL = "chr(10)"
WS = r"[\t\n\v\f\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"


def lit(s: str) -> str:
    """A Python string as a DuckDB string expression (quotes doubled, newlines as chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts) if len(parts) > 1 else f"'{parts[0]}'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def split_items(q: str) -> str:
    """List of {kw, val} for the clause split of SQL expression q."""
    pat = (r"\b(SELECT|FROM|(?:LEFT\s+|RIGHT\s+|INNER\s+|OUTER\s+|FULL\s+)?JOIN|WHERE|GROUP\s+BY|HAVING"
           r"|ORDER\s+BY|LIMIT)\b")
    cleaned = f"regexp_replace({strip(q)}, ';+$', '')"
    marked = f"regexp_replace({cleaned}, '{pat}', chr(1) || '\\1' || chr(2), 'gi')"
    return (f"list_transform(string_split({marked}, chr(1))[2:], lambda p: "
            f"{{'kw': replace(upper({strip('split_part(p, chr(2), 1)')}), '  ', ' '), "
            f"'val': {strip('split_part(p, chr(2), 2)')}}})")


_KW = {"select": "SELECT", "from": "FROM", "where": "WHERE", "group_by": "GROUP BY",
       "having": "HAVING", "order_by": "ORDER BY", "limit": "LIMIT"}


def clause_cols(items: str, prefix: str = "cl_") -> str:
    cols = []
    for c in K.CLAUSES:
        if c == "join":
            cols.append(f"array_to_string(list_transform(list_filter({items}, lambda it: contains(it.kw, 'JOIN')), "
                        f"lambda it: CASE WHEN it.val = '' THEN it.kw ELSE it.kw || ' ' || it.val END), ' ') AS {prefix}join")
        else:
            cols.append(f"coalesce(list_filter({items}, lambda it: it.kw = '{_KW[c]}')[-1].val, '') AS {prefix}{c}")
    return ",\n  ".join(cols)


def extract(text: str, tag: str, flags: str = "(?is)") -> str:
    return strip(f"regexp_extract({text}, '{flags}<{tag}>\\s*(.*?)\\s*</{tag}>', 1)")


_PREFIX = {"select": ("SELECT", "SELECT "), "from": ("FROM", "FROM "), "where": ("WHERE", "WHERE "),
           "group_by": ("GROUP", "GROUP BY "), "having": ("HAVING", "HAVING "),
           "order_by": ("ORDER", "ORDER BY "), "limit": ("LIMIT", "LIMIT ")}


def assemble(cols: dict) -> str:
    parts = []
    for c in K.CLAUSES:
        v = cols[c]
        if c == "join":
            parts.append(f"CASE WHEN {v} <> '' THEN {v} END")
        else:
            pre, add = _PREFIX[c]
            parts.append(f"CASE WHEN {v} <> '' THEN CASE WHEN starts_with(upper({v}), '{pre}') THEN {v} "
                         f"ELSE '{add}' || {v} END END")
    return f"concat_ws({NL}, " + ", ".join(parts) + ")"


def normalize(x: str) -> str:
    s = f"lower(regexp_replace({strip(x)}, ';+$', ''))"
    s = f"regexp_replace({s}, '{WS}+', ' ', 'g')"
    s = f"regexp_replace({s}, '\\({WS}+', '(', 'g')"
    s = f"regexp_replace({s}, '{WS}+\\)', ')', 'g')"
    return strip(s)


def tag_lines(cols: dict) -> str:
    lines = [f"'<clause_{c}> ' || {strip(cols[c])} || ' </clause_{c}>'" for c in K.CLAUSES]
    return f" || {NL} || ".join(lines)


# ------------------------------------------------------------------ catalog (inline values)
_TABLES = [
    ("sales", "region", [("r_regionkey", "int"), ("r_name", "string")]),
    ("sales", "nation", [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")]),
    ("sales", "customer", [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                           ("c_acctbal", "double"), ("c_mktsegment", "string")]),
    ("sales", "supplier", [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                           ("s_acctbal", "double")]),
    ("sales", "part", [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
                       ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")]),
    ("sales", "orders", [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                         ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]),
    ("sales", "lineitem", [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                           ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                           ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                           ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]),
    ("clickstream", "events", [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
                               ("event_type", "string"), ("value", "double"), ("props", "string")]),
    ("corpus", "documents", [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                             ("source", "string"), ("n_chars", "bigint")]),
    ("corpus", "embeddings", [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")]),
    ("corpus", "pages", [("page_id", "bigint"), ("url", "string"), ("html", "string")]),
    ("corpus", "benchmark", [("item_id", "bigint"), ("text", "string")]),
    ("corpus", "labels", [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")]),
    ("corpus", "conversations", [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")]),
]
_PK = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
       "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id",
       "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id"}
_FK = [("sales", 0, "nation", "n_regionkey", "region", "r_regionkey"),
       ("sales", 1, "customer", "c_nationkey", "nation", "n_nationkey"),
       ("sales", 2, "supplier", "s_nationkey", "nation", "n_nationkey"),
       ("sales", 3, "orders", "o_custkey", "customer", "c_custkey"),
       ("sales", 4, "lineitem", "l_orderkey", "orders", "o_orderkey"),
       ("sales", 5, "lineitem", "l_partkey", "part", "p_partkey"),
       ("sales", 6, "lineitem", "l_suppkey", "supplier", "s_suppkey"),
       ("corpus", 0, "labels", "doc_id", "documents", "doc_id")]


def _catalog_values() -> str:
    rows, db_ord, t_ord, last_db = [], -1, 0, None
    for db, t, cols in _TABLES:
        if db != last_db:
            db_ord, t_ord, last_db = db_ord + 1, 0, db
        for c_ord, (c, typ) in enumerate(cols):
            rows.append(f"({db_ord}, '{db}', {t_ord}, '{t}', {c_ord}, '{c}', '{typ}', {str(_PK.get(t) == c).upper()})")
        t_ord += 1
    return ("SELECT * FROM (VALUES " + ", ".join(rows) +
            ") AS v(db_ord, db_id, table_ord, table_name, col_ord, col_name, col_type, is_pk)")


CATALOG = f"catalog AS ({_catalog_values()})"
FKS = ("fks AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, '{c}', '{d}', '{e}', '{f}')" for a, b, c, d, e, f in _FK)
       + ") AS v(db_id, fk_ord, t1, c1, t2, c2))")
SCHEMA_TYPED = f"""schema_typed AS (
  SELECT db_id, string_agg(line, {NL} ORDER BY table_ord) AS schema FROM (
    SELECT db_id, table_ord, 'Table ' || table_name || ': (' || string_agg(col_name || ' ' || col_type, ', ' ORDER BY col_ord) || ')' AS line
    FROM catalog GROUP BY db_id, table_ord, table_name) t
  GROUP BY db_id)"""

ORACLES["catalog_tables"] = f"WITH {CATALOG} SELECT * FROM catalog"
ORACLES["schema_text_typed"] = f"WITH {CATALOG}, {SCHEMA_TYPED} SELECT * FROM schema_typed"


def _schema_fk(compact: bool) -> str:
    col = "col_name || CASE WHEN is_pk THEN ' [PK]' ELSE '' END"
    if compact:
        line = f"table_name || '(' || string_agg({col}, ', ' ORDER BY col_ord) || ')'"
    else:
        line = f"'Table ' || table_name || ':' || {NL} || '  - ' || string_agg({col}, {NL} || '  - ' ORDER BY col_ord)"
    return f"""WITH {CATALOG}, {FKS},
t AS (SELECT db_id, string_agg(line, {NL} ORDER BY table_ord) AS s FROM (
        SELECT db_id, table_ord, {line} AS line FROM catalog GROUP BY db_id, table_ord, table_name) x GROUP BY db_id),
f AS (SELECT db_id, string_agg('  ' || t1 || '.' || c1 || ' = ' || t2 || '.' || c2, {NL} ORDER BY fk_ord) AS fk
      FROM fks GROUP BY db_id)
SELECT t.db_id, CASE WHEN f.fk IS NULL THEN t.s ELSE t.s || {NL} || {NL} || 'Foreign Keys:' || {NL} || f.fk END AS schema
FROM t LEFT JOIN f ON t.db_id = f.db_id"""


ORACLES["schema_text_compact"] = _schema_fk(True)
ORACLES["schema_text_bullets"] = _schema_fk(False)

# ------------------------------------------------------------------ corpus
_SPLIT = split_items("query")
ORACLES["clause_split"] = cte("qa_corpus") + f"""
SELECT sample_id, {clause_cols('items')}
FROM (SELECT sample_id, {_SPLIT} AS items FROM qa_corpus) s"""

_CL = {c: f"cl_{c}" for c in K.CLAUSES}
ORACLES["clause_output"] = cte("qa_corpus") + f"""
SELECT sample_id, {tag_lines(_CL)} || {NL} || '<summary>' || {NL} || {strip('query')} || {NL} || '</summary>' AS output
FROM (SELECT sample_id, query, {clause_cols('items')} FROM (SELECT sample_id, query, {_SPLIT} AS items FROM qa_corpus) a) s"""

ORACLES["corpus_union"] = cte("qa_corpus") + """
SELECT sample_id, source, split, db_id, question, query, '' AS evidence, '' AS difficulty FROM qa_corpus WHERE source = 'plain'
UNION ALL
SELECT sample_id, source, split, db_id, question, query, evidence, difficulty FROM qa_corpus WHERE source = 'kb'"""

ORACLES["clause_profile"] = cte("qa_corpus") + f"""
, s AS (SELECT source, split, {clause_cols('items')} FROM (SELECT source, split, {_SPLIT} AS items FROM qa_corpus) a)
SELECT source, split, clause, count(*) FILTER (WHERE text <> '') AS n_used, count(*) AS n_total
FROM (UNPIVOT s ON {', '.join('cl_' + c for c in K.CLAUSES)} INTO NAME clause VALUE text) u
GROUP BY source, split, clause"""
ORACLES["clause_profile"] = ORACLES["clause_profile"].replace(
    "GROUP BY source, split, clause",
    "GROUP BY source, split, clause").replace(
    "SELECT source, split, clause, count(*)", "SELECT source, split, substr(clause, 4) AS clause, count(*)")

_USER_TEXT = (f"{lit(H['schema'] + chr(10))} || schema || {NL} || CASE WHEN evidence <> '' THEN {NL} || "
              f"{lit(H['knowledge'] + chr(10))} || evidence || {NL} ELSE '' END || {NL} || {lit(H['question'] + chr(10))} || question")
_WITH_SCHEMA = f"""{cte('qa_corpus')}, {CATALOG}, {SCHEMA_TYPED},
q AS (SELECT qa.*, coalesce(st.schema, '') AS schema FROM qa_corpus qa LEFT JOIN schema_typed st ON qa.db_id = st.db_id)"""

ORACLES["sft_build"] = _WITH_SCHEMA + f"""
SELECT sample_id, split, {lit(K.SYSTEM_TEXT)} AS system, {_USER_TEXT} AS user_text,
  {tag_lines(_CL)} || {NL} || '<summary>' || {NL} || {strip('query')} || {NL} || '</summary>' AS assistant_text,
  db_id, source, query
FROM (SELECT *, {clause_cols('items')} FROM (SELECT *, {_SPLIT} AS items FROM q) a) s
WHERE question <> '' AND query <> ''"""

ORACLES["sft_counts"] = cte("qa_corpus") + """
SELECT source, split, count(*) AS n_raw, count(*) FILTER (WHERE question <> '' AND query <> '') AS n_kept
FROM qa_corpus GROUP BY source, split"""

ORACLES["sft_shuffle"] = cte("qa_corpus") + """
SELECT sample_id, split, CASE WHEN split = 'train' THEN md5('42:' || CAST(sample_id AS VARCHAR))
  ELSE lpad(CAST(sample_id AS VARCHAR), 20, '0') END AS shuffle_key
FROM qa_corpus WHERE question <> '' AND query <> ''"""

_PREFIX_TAGS = lit("\n".join(f"<clause_{c}>" for c in K.CLAUSES))


def _user_prompt(prefix: bool) -> str:
    parts = ["CASE WHEN db_id <> '' THEN " + lit(H["database"]) + " || db_id END",
             f"{lit(H['schema'] + chr(10))} || schema",
             f"CASE WHEN evidence <> '' THEN {lit(H['knowledge'] + chr(10))} || evidence END",
             f"{lit(H['question'] + chr(10))} || question",
             lit(K.INSTRUCTION_TEXT)]
    if prefix:
        parts.append(_PREFIX_TAGS)
    return f"concat_ws({NL} || {NL}, " + ", ".join(parts) + ")"


ORACLES["user_prompt"] = _WITH_SCHEMA + f"\nSELECT sample_id, {_user_prompt(True)} AS prompt FROM q"
ORACLES["chat_messages"] = _WITH_SCHEMA + f"""
SELECT sample_id, 2 AS n_messages,
  md5({lit(K.SYSTEM_TEXT)} || {NL} || {NL} || 'User: ' || {_user_prompt(False)} || {NL} || 'Assistant:') AS flat_md5,
  md5({_user_prompt(False)}) AS user_md5
FROM q"""

# ------------------------------------------------------------------ parsing
_EX = {c: extract("output", f"clause_{c}") for c in K.CLAUSES}
ORACLES["extract_clauses"] = cte("model_outputs") + "\nSELECT sample_id, " + ", ".join(
    f"{_EX[c]} AS cl_{c}" for c in K.CLAUSES) + " FROM model_outputs"
ORACLES["extract_summary"] = cte("model_outputs") + f"\nSELECT sample_id, {extract('output', 'summary')} AS summary FROM model_outputs"
_EXC = {c: f"x_{c}" for c in K.CLAUSES}
_EXTRACTED = "SELECT sample_id, output, " + ", ".join(f"{_EX[c]} AS x_{c}" for c in K.CLAUSES) + " FROM model_outputs"
ORACLES["assemble_sql"] = cte("model_outputs") + f"\nSELECT sample_id, {assemble(_EXC)} AS assembled FROM ({_EXTRACTED}) e"
ORACLES["final_sql"] = cte("model_outputs") + f"""
SELECT sample_id, coalesce(nullif({extract('output', 'summary')}, ''), {assemble(_EXC)}) AS final_sql FROM ({_EXTRACTED}) e"""

_ANS = strip("regexp_extract(output, '(?s)<answer>(.*?)</answer>', 1)")
_FENCE = "'(?is)```sql\\s*(.*?)\\s*```'"
ORACLES["extract_reflection"] = cte("model_outputs") + f"""
SELECT sample_id, {strip("regexp_extract(output, '(?s)<reasoning>(.*?)</reasoning>', 1)")} AS reasoning,
  CASE WHEN {_ANS} <> '' THEN {_ANS}
       WHEN regexp_matches(output, {_FENCE}) THEN {strip(f"regexp_extract(output, {_FENCE}, 1)")}
       ELSE {strip('output')} END AS answer
FROM model_outputs"""

ORACLES["round_trip"] = cte("qa_corpus") + f"""
SELECT sample_id % 8 AS shape, count(*) FILTER (WHERE {normalize(assemble(_CL))} = {normalize('query')}) AS n_same, count(*) AS n
FROM (SELECT sample_id, query, {clause_cols('items')} FROM (SELECT sample_id, query, {_SPLIT} AS items FROM qa_corpus) a) s
GROUP BY sample_id % 8"""

# ------------------------------------------------------------------ exact match
ORACLES["normalize_sql"] = cte("pairs") + f"""
SELECT sample_id, {normalize('pred_sql')} AS norm_pred, {normalize('gold_sql')} AS norm_gold FROM pairs"""
ORACLES["exact_match"] = cte("pairs") + f"""
SELECT sample_id, {normalize('pred_sql')} = {normalize('gold_sql')} AS em FROM pairs"""
ORACLES["exact_match_rate"] = cte("pairs") + f"""
SELECT coalesce(round(avg(CAST({normalize('pred_sql')} = {normalize('gold_sql')} AS DOUBLE)), 9), 0.0) AS em_rate,
  count(*) AS n FROM pairs"""

# ------------------------------------------------------------------ execution results
def _sides_sql() -> str:
    return """sides AS (
  SELECT sample_id,
    bool_or(side = 'pred' AND status = 'ok') AS pred_ok, bool_or(side = 'gold' AND status = 'ok') AS gold_ok,
    bool_or(side = 'pred' AND contains(lower(sql), 'order by')) AS po,
    bool_or(side = 'gold' AND contains(lower(sql), 'order by')) AS go
  FROM result_status GROUP BY sample_id)"""


def _cmp_sql(pred_keep: str, gold_keep: str) -> str:
    """Per sample equality of the two row lists; a side keeps row_no order when its flag is true, else sorted."""
    return f"""pos AS (
  SELECT r.sample_id, r.side, r.row_str,
    CASE WHEN (r.side = 'pred' AND {pred_keep}) OR (r.side = 'gold' AND {gold_keep}) THEN r.row_no
         ELSE row_number() OVER (PARTITION BY r.sample_id, r.side ORDER BY r.row_str, r.row_no) END AS pos
  FROM result_rows r JOIN sides s ON r.sample_id = s.sample_id),
cmp AS (
  SELECT coalesce(p.sample_id, g.sample_id) AS sample_id, bool_and(p.row_str IS NOT DISTINCT FROM g.row_str) AS same
  FROM (SELECT * FROM pos WHERE side = 'pred') p
  FULL OUTER JOIN (SELECT * FROM pos WHERE side = 'gold') g ON p.sample_id = g.sample_id AND p.pos = g.pos
  GROUP BY 1)"""


EX_BODY = f"""{_sides_sql()},
{_cmp_sql('s.po', 's.go')},
ex_t AS (SELECT s.sample_id, coalesce(s.pred_ok AND s.gold_ok AND coalesce(c.same, true), false) AS ex
         FROM sides s LEFT JOIN cmp c ON s.sample_id = c.sample_id)"""

ORACLES["execution_match"] = cte("result_rows", "result_status") + f", {EX_BODY}\nSELECT * FROM ex_t"
ORACLES["execution_match_rate"] = cte("result_rows", "result_status") + f""", {EX_BODY}
SELECT coalesce(round(avg(CAST(ex AS DOUBLE)), 9), 0.0) AS ex_rate, count(*) AS n FROM ex_t"""

F1_BODY = """toks AS (
  SELECT sample_id, side, unnest(regexp_extract_all(lower(coalesce(cell, 'none')), '\\S+')) AS tok
  FROM (SELECT sample_id, side, unnest(cells) AS cell FROM result_rows) c),
pt AS (SELECT sample_id, tok, count(*) FILTER (WHERE side = 'pred') AS p, count(*) FILTER (WHERE side = 'gold') AS g
       FROM toks GROUP BY sample_id, tok),
ps AS (SELECT sample_id, sum(least(p, g)) AS common, sum(p) AS np, sum(g) AS ng FROM pt GROUP BY sample_id),
nr AS (SELECT sample_id, count(*) FILTER (WHERE side = 'pred') AS pr, count(*) FILTER (WHERE side = 'gold') AS gr
       FROM result_rows GROUP BY sample_id),
f1_t AS (
  SELECT x.sample_id,
    CASE WHEN coalesce(gr, 0) = 0 THEN CASE WHEN coalesce(pr, 0) = 0 THEN 1.0 ELSE 0.0 END
         WHEN coalesce(np, 0) = 0 AND coalesce(ng, 0) = 0 THEN 1.0
         WHEN coalesce(np, 0) = 0 OR coalesce(ng, 0) = 0 THEN 0.0
         WHEN common = 0 THEN 0.0
         ELSE 2 * (common / np) * (common / ng) / ((common / np) + (common / ng)) END AS f1
  FROM (SELECT DISTINCT sample_id FROM result_status) x
  LEFT JOIN nr ON x.sample_id = nr.sample_id LEFT JOIN ps ON x.sample_id = ps.sample_id)"""

ORACLES["result_f1"] = cte("result_rows", "result_status") + f", {F1_BODY}\nSELECT sample_id, round(f1, 9) AS f1 FROM f1_t"
ORACLES["reward_execution"] = cte("result_rows", "result_status") + f""", {_sides_sql()},
{_cmp_sql('s.po', 's.po')}, {F1_BODY}
SELECT s.sample_id, round(CASE WHEN NOT (s.pred_ok AND s.gold_ok) THEN 0.0
                              WHEN coalesce(c.same, true) THEN 1.0 ELSE f.f1 END, 9) AS r_exec
FROM sides s LEFT JOIN cmp c ON s.sample_id = c.sample_id LEFT JOIN f1_t f ON s.sample_id = f.sample_id"""

ORACLES["difficulty_breakdown"] = cte("eval_rows") + """
SELECT coalesce(difficulty, 'unknown') AS difficulty, count(*) FILTER (WHERE ex) AS correct, count(*) AS total,
  round(count(*) FILTER (WHERE ex) / count(*), 9) AS accuracy
FROM eval_rows GROUP BY 1
UNION ALL
SELECT 'all', count(*) FILTER (WHERE ex), count(*), round(count(*) FILTER (WHERE ex) / count(*), 9) FROM eval_rows"""

_DETAILS = f"""details AS (
  SELECT q.sample_id, q.db_id, q.question, q.evidence, q.difficulty, q.query AS gold_sql,
    coalesce(p.pred_sql, '') AS pred_sql, coalesce(e.ex, false) AS ex,
    {normalize("coalesce(p.pred_sql, '')")} = {normalize('q.query')} AS em
  FROM qa_corpus q LEFT JOIN pairs p ON q.sample_id = p.sample_id LEFT JOIN ex_t e ON q.sample_id = e.sample_id)"""
ORACLES["eval_details"] = (cte("qa_corpus", "pairs", "result_rows", "result_status") +
                           f", {EX_BODY}, {_DETAILS}\nSELECT * FROM details")
ORACLES["eval_summary"] = cte("qa_corpus", "pairs", "result_rows", "result_status") + f", {EX_BODY}, {_DETAILS}" + """
SELECT 'overall' AS scope, '' AS difficulty, count(*) FILTER (WHERE ex) AS correct, count(*) AS total,
  coalesce(round(avg(CAST(ex AS DOUBLE)), 9), 0.0) AS ex_rate, coalesce(round(avg(CAST(em AS DOUBLE)), 9), 0.0) AS em_rate
FROM details
UNION ALL
SELECT 'difficulty', coalesce(difficulty, 'unknown'), count(*) FILTER (WHERE ex), count(*),
  round(avg(CAST(ex AS DOUBLE)), 9), round(avg(CAST(em AS DOUBLE)), 9)
FROM details GROUP BY coalesce(difficulty, 'unknown')"""

# ------------------------------------------------------------------ text rewards
_TAG_HITS = " + ".join(f"CAST(contains(output, '{t}') AS INT)" for t in K.ALL_TAGS)
ORACLES["reward_format"] = cte("model_outputs") + f"\nSELECT sample_id, round(({_TAG_HITS}) / {float(len(K.ALL_TAGS))}, 9) AS r_format FROM model_outputs"

_STOP = "[" + ", ".join(f"'{w}'" for w in K.SCHEMA_STOPWORDS) + "]"


def schema_toks(x: str) -> str:
    clean = f"""regexp_replace(regexp_replace(lower({x}), '''[^'']*''', '', 'g'), '"[^"]*"', '', 'g')"""
    return (f"list_filter(list_distinct(regexp_extract_all({clean}, '\\b[a-z_][a-z0-9_]{{1,}}\\b')), "
            f"lambda t: NOT list_contains({_STOP}, t))")


ORACLES["schema_tokens"] = cte("qa_corpus") + f"""
SELECT sample_id, CAST(len({schema_toks('query')}) AS INT) AS n_tokens, array_to_string(list_sort({schema_toks('query')}), ',') AS tokens
FROM qa_corpus"""

ORACLES["reward_schema"] = cte("pairs") + f"""
SELECT sample_id, round(CASE WHEN len(g) = 0 THEN CASE WHEN len(p) = 0 THEN 1.0 ELSE 0.5 END
                             WHEN len(p) = 0 THEN 0.0
                             ELSE len(list_intersect(p, g)) / (len(p) + len(g) - len(list_intersect(p, g))) END, 9) AS r_schema
FROM (SELECT sample_id, {schema_toks('pred_sql')} AS p, {schema_toks('gold_sql')} AS g FROM pairs) t"""


def bigrams(x: str) -> str:
    w = f"regexp_extract_all(lower({x}), '{WORD}')"
    return f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"


ORACLES["ngram_counts"] = cte("qa_corpus") + f"""
SELECT sample_id, CAST(len({bigrams('query')}) AS INT) AS n_ngrams, array_to_string({bigrams('query')}, '|') AS ngrams FROM qa_corpus"""

ORACLES["reward_ngram"] = cte("pairs") + f""",
grams AS (SELECT sample_id, 'p' AS side, unnest({bigrams('pred_sql')}) AS gram FROM pairs
          UNION ALL SELECT sample_id, 'g', unnest({bigrams('gold_sql')}) FROM pairs),
cnt AS (SELECT sample_id, gram, count(*) FILTER (WHERE side = 'p') AS p, count(*) FILTER (WHERE side = 'g') AS g
        FROM grams GROUP BY sample_id, gram),
com AS (SELECT sample_id, sum(least(p, g)) AS common, sum(p) AS np, sum(g) AS ng FROM cnt GROUP BY sample_id)
SELECT pairs.sample_id, round(CASE WHEN coalesce(ng, 0) = 0 THEN CASE WHEN coalesce(np, 0) = 0 THEN 1.0 ELSE 0.0 END
    WHEN coalesce(np, 0) = 0 THEN 0.0 WHEN common = 0 THEN 0.0
    ELSE 2 * (common / np) * (common / ng) / ((common / np) + (common / ng)) END, 9) AS r_ngram
FROM pairs LEFT JOIN com ON pairs.sample_id = com.sample_id"""

ORACLES["output_quality"] = cte("model_outputs", "qa_corpus") + f"""
SELECT source, count(*) AS n_outputs, count(*) FILTER (WHERE summary <> '') AS n_summary,
  count(*) FILTER (WHERE summary = '' AND assembled <> '') AS n_assembled,
  count(*) FILTER (WHERE summary = '' AND assembled = '') AS n_empty,
  round(avg({len(K.ALL_TAGS)} - hits), 9) AS avg_missing_tags
FROM (SELECT q.source, {extract('output', 'summary')} AS summary, {assemble(_EXC)} AS assembled, ({_TAG_HITS}) AS hits
      FROM (SELECT sample_id, output, {', '.join(f'{_EX[c]} AS x_{c}' for c in K.CLAUSES)} FROM model_outputs) m
      JOIN qa_corpus q ON m.sample_id = q.sample_id) t
GROUP BY source"""

# ------------------------------------------------------------------ guarded execution (fixed pairs)
# Expected outcome of the guard per text, as decided by hand from section 7.4:
# refused texts are several statements, syntax error, unknown column, DROP,
# WITH ... INSERT; the runtime cast error plans (validity 1.0) but fails to run.
_REFUSED = {7, 8, 9, 10, 11}
_FAILS = _REFUSED | {12}
ORACLES["sql_batch_status"] = "SELECT CAST(sample_id AS BIGINT) AS sample_id, side, status FROM (VALUES " + ", ".join(
    f"({i}, 'pred', '{'error' if i in _FAILS else 'ok'}'), ({i}, 'gold', 'ok')" for i in range(1, 13)
) + ") AS v(sample_id, side, status)"
ORACLES["sql_validity"] = "SELECT CAST(sample_id AS BIGINT) AS sample_id, side, CAST(validity AS DOUBLE) AS validity FROM (VALUES " + ", ".join(
    f"({i}, 'pred', {0.5 if i in _REFUSED else 1.0}), ({i}, 'gold', 1.0)" for i in range(1, 13)
) + ") AS v(sample_id, side, validity)"
# Expected execution match: equal, equal up to order, ordered equal -> true; the rest false.
ORACLES["execution_match_fixed"] = "SELECT CAST(sample_id AS BIGINT) AS sample_id, ex FROM (VALUES " + ", ".join(
    f"({i}, {'true' if i in (1, 2, 3, 6) else 'false'})" for i in range(1, 13)) + ") AS v(sample_id, ex)"

_G = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 1"
_Q = "chr(39)"


def _rs(*cols_types):
    """Python-style row text for int and string columns."""
    parts = [f"{_Q} || {c} || {_Q}" if t == "s" else f"CAST({c} AS VARCHAR)" for c, t in cols_types]
    inner = " || ', ' || ".join(parts)
    return f"'(' || {inner} || {repr(',)') if len(parts) == 1 else repr(')')}"


_ROWS = [
    # (sample_id, side, select list of row text, from/where, order key or None)
    (1, "pred", _rs(("c_mktsegment", "s"), ("n", "i")), "(SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment)", None),
    (1, "gold", _rs(("c_mktsegment", "s"), ("n", "i")), "(SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment)", None),
    (2, "pred", _rs(("o_orderkey", "i"), ("o_orderstatus", "s")), "orders WHERE o_orderkey % 7 = 0", None),
    (2, "gold", _rs(("o_orderkey", "i"), ("o_orderstatus", "s")), "orders WHERE o_orderkey % 7 = 0 AND o_totalprice >= 0", None),
    (3, "pred", _rs(("c_custkey", "i"), ("c_name", "s")), "customer WHERE c_nationkey = 3", "c_custkey DESC"),
    (3, "gold", _rs(("c_custkey", "i"), ("c_name", "s")), "customer WHERE c_nationkey = 3", "c_custkey DESC"),
    (4, "pred", _rs(("c_custkey", "i"), ("c_name", "s")), "customer WHERE c_nationkey = 4", "c_custkey"),
    (4, "gold", _rs(("c_custkey", "i"), ("c_name", "s")), "customer WHERE c_nationkey = 4", "c_custkey DESC"),
    (5, "pred", _rs(("c_custkey", "i")), "customer", None),
    (5, "gold", _rs(("c_name", "s")), "customer", None),
    (6, "pred", _rs(("c_custkey", "i")), "customer WHERE c_custkey < 0", None),
    (6, "gold", _rs(("c_custkey", "i")), "customer WHERE c_custkey < 0", None),
] + [(i, "gold", _rs(("c_custkey", "i"), ("c_mktsegment", "s")), "customer WHERE c_nationkey = 1", None) for i in range(7, 13)]

ORACLES["sql_batch_rows"] = "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS BIGINT) AS sample_id, '{side}' AS side, {rs} AS row_str, "
    + (f"CAST(row_number() OVER (ORDER BY {o}) AS INT)" if o else "CAST(NULL AS INT)") + f" AS row_pos FROM {src}"
    for i, side, rs, src, o in _ROWS)

ORACLES["exec_feedback"] = cte("result_rows", "result_status_err") + """
SELECT s.sample_id,
  CASE WHEN s.status = 'ok' THEN '[' || coalesce(h.txt, '') || ']' ELSE '' END AS exec_result,
  CASE WHEN s.status = 'ok' THEN '' ELSE s.error END AS exec_error
FROM (SELECT * FROM result_status_err WHERE side = 'pred') s
LEFT JOIN (SELECT sample_id, string_agg(row_str, ', ' ORDER BY row_no) AS txt FROM result_rows
           WHERE side = 'pred' AND row_no <= 10 GROUP BY sample_id) h ON s.sample_id = h.sample_id"""

# ------------------------------------------------------------------ retrieval
def bow(src: str, ids: str, text: str) -> str:
    """Normalised word-count vectors (ids..., term, w) of text column ``text`` of relation ``src``."""
    return f"""(SELECT {ids}, term, n / sqrt(sum(n * n) OVER (PARTITION BY {ids})) AS w FROM (
  SELECT {ids}, term, count(*) AS n FROM (
    SELECT {ids}, unnest(regexp_extract_all(lower({text}), '{WORD}')) AS term FROM {src}) t0
  GROUP BY {ids}, term) t1)"""


REGISTRY = f"""registry AS (
  SELECT d.db_ord, d.db_id,
    'database ' || d.db_id || '; tables ' || array_to_string(t.tables, ', ') || '; columns '
      || array_to_string(c.cols[1:{K.REGISTRY_DESC_COLS}], ', ') AS description,
    list_concat(t.tables, c.cols[1:{K.REGISTRY_KEYWORD_COLS}]) AS keywords
  FROM (SELECT DISTINCT db_ord, db_id FROM catalog) d
  JOIN (SELECT db_id, list(table_name ORDER BY table_ord) AS tables FROM (SELECT DISTINCT db_id, table_name, table_ord FROM catalog) x GROUP BY db_id) t
    ON d.db_id = t.db_id
  JOIN (SELECT db_id, list(col_name ORDER BY table_ord, col_ord) AS cols FROM catalog GROUP BY db_id) c ON d.db_id = c.db_id)"""

_RET = cte("questions", "history") + f", {CATALOG}, {REGISTRY}"

ORACLES["bow_vectors"] = cte("questions") + f"\nSELECT q_id, term, round(w, 9) AS w FROM {bow('questions', 'q_id', 'question')} v"
ORACLES["db_registry"] = f"WITH {CATALOG}, {REGISTRY}\nSELECT db_ord, db_id, description, array_to_string(keywords, ',') AS keywords FROM registry"

_KWS = """kws AS (
  SELECT q.q_id, r.db_id,
    CASE WHEN len(r.keywords) > 0 THEN len(list_filter(r.keywords, lambda k: contains(lower(q.question), lower(k)))) / len(r.keywords)
         ELSE 0.0 END AS kw_score
  FROM questions q CROSS JOIN registry r)"""
ORACLES["keyword_score"] = _RET + f", {_KWS}\nSELECT q_id, db_id, round(kw_score, 9) AS kw_score FROM kws WHERE kw_score > 0"

_ROUTE = f"""qv AS {bow('questions', 'q_id', 'question')},
dv AS {bow('registry', 'db_id', 'description')},
cos AS (SELECT qv.q_id, dv.db_id, sum(qv.w * dv.w) AS sim FROM qv JOIN dv ON qv.term = dv.term GROUP BY qv.q_id, dv.db_id),
{_KWS},
scored AS (
  SELECT k.q_id, k.db_id, r.db_ord,
    round(CAST(0.4 AS DOUBLE) * k.kw_score + CAST(0.6 AS DOUBLE) * coalesce(c.sim, 0.0), 9) AS score
  FROM kws k JOIN registry r ON k.db_id = r.db_id LEFT JOIN cos c ON k.q_id = c.q_id AND k.db_id = c.db_id),
routed AS (SELECT q_id, db_id, score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, db_ord) AS INT) AS rank
           FROM scored QUALIFY rank <= {K.ROUTE_TOP_K})"""
ORACLES["route_topk"] = _RET + f", {_ROUTE}\nSELECT * FROM routed"

_KNOWN = """known AS (SELECT q_id, question, evidence, coalesce(db_id,
    CASE abs(q_id) % 3 WHEN 0 THEN 'sales' WHEN 1 THEN 'clickstream' ELSE 'corpus' END) AS db_id FROM questions)"""
_TABLE_ITEMS = """titems AS (
  SELECT db_id, table_name, table_ord, count(*) AS n_cols,
    table_name || ' ' || string_agg(col_name, ' ' ORDER BY col_ord) AS txt
  FROM catalog GROUP BY db_id, table_name, table_ord)"""


def _rank_tables_sql(qrel: str) -> str:
    return f"""{_TABLE_ITEMS},
tq AS {bow(qrel, 'q_id', 'question')},
tv AS {bow('titems', 'db_id, table_name', 'txt')},
tsim AS (SELECT tq.q_id, tv.db_id, tv.table_name, sum(tq.w * tv.w) AS sim
         FROM tq JOIN {qrel} k ON tq.q_id = k.q_id JOIN tv ON tv.db_id = k.db_id AND tv.term = tq.term
         GROUP BY tq.q_id, tv.db_id, tv.table_name),
tables_r AS (
  SELECT k.q_id, k.db_id, t.table_name, t.table_ord, t.n_cols, round(coalesce(s.sim, 0.0), 9) AS table_score,
    CAST(row_number() OVER (PARTITION BY k.q_id ORDER BY round(coalesce(s.sim, 0.0), 9) DESC, t.table_ord) AS INT) AS table_rank
  FROM {qrel} k JOIN titems t ON t.db_id = k.db_id
  LEFT JOIN tsim s ON s.q_id = k.q_id AND s.db_id = t.db_id AND s.table_name = t.table_name
  QUALIFY table_rank <= {K.TOP_TABLES})"""


def _prune_sql(qrel: str) -> str:
    return f"""cv AS {bow('catalog', 'db_id, table_name, col_name', 'col_name')},
csim AS (SELECT tq.q_id, cv.db_id, cv.table_name, cv.col_name, sum(tq.w * cv.w) AS sim
         FROM tq JOIN {qrel} k ON tq.q_id = k.q_id JOIN cv ON cv.db_id = k.db_id AND cv.term = tq.term
         GROUP BY tq.q_id, cv.db_id, cv.table_name, cv.col_name),
cols_r AS (
  SELECT t.q_id, t.db_id, t.table_name, c.col_name,
    CAST(CASE WHEN t.n_cols <= {K.TOP_COLS} THEN c.col_ord + 1
         ELSE row_number() OVER (PARTITION BY t.q_id, t.table_name ORDER BY round(coalesce(s.sim, 0.0), 9) DESC, c.col_ord) END AS INT) AS col_rank
  FROM tables_r t JOIN catalog c ON c.db_id = t.db_id AND c.table_name = t.table_name
  LEFT JOIN csim s ON s.q_id = t.q_id AND s.db_id = c.db_id AND s.table_name = c.table_name AND s.col_name = c.col_name
  QUALIFY col_rank <= {K.TOP_COLS})"""


def _fewshot_sql(qrel: str) -> str:
    return f"""hv AS {bow('history', 'db_id, hist_ord', 'question')},
hsim AS (SELECT tq.q_id, hv.db_id, hv.hist_ord, sum(tq.w * hv.w) AS sim
         FROM tq JOIN {qrel} k ON tq.q_id = k.q_id JOIN hv ON hv.db_id = k.db_id AND hv.term = tq.term
         GROUP BY tq.q_id, hv.db_id, hv.hist_ord),
shots AS (
  SELECT k.q_id, k.db_id, h.hist_ord, round(coalesce(s.sim, 0.0), 9) AS sim,
    CAST(row_number() OVER (PARTITION BY k.q_id ORDER BY round(coalesce(s.sim, 0.0), 9) DESC, h.hist_ord) AS INT) AS rank
  FROM {qrel} k JOIN history h ON h.db_id = k.db_id
  LEFT JOIN hsim s ON s.q_id = k.q_id AND s.hist_ord = h.hist_ord
  QUALIFY rank <= {K.TOP_FEWSHOT})"""


ORACLES["rank_tables"] = _RET + f", {_KNOWN}, {_rank_tables_sql('known')}\nSELECT q_id, db_id, table_name, table_score, table_rank FROM tables_r"
ORACLES["prune_columns"] = (_RET + f", {_KNOWN}, {_rank_tables_sql('known')}, {_prune_sql('known')}"
                            "\nSELECT q_id, table_name, col_name, col_rank FROM cols_r")
ORACLES["fewshot_topk"] = _RET + f", {_KNOWN}, tq AS {bow('known', 'q_id', 'question')}, {_fewshot_sql('known')}\nSELECT * FROM shots"

ORACLES["fewshot_vectors"] = cte("vec_queries", "vec_history") + f"""
SELECT q_id, vec_id, sim, rank FROM (
  SELECT q.vec_id AS q_id, h.vec_id, round(CASE WHEN qn = 0 OR hn = 0 THEN 0.0 ELSE dot / (qn * hn) END, 9) AS sim,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(CASE WHEN qn = 0 OR hn = 0 THEN 0.0 ELSE dot / (qn * hn) END, 9) DESC, h.vec_id) AS INT) AS rank
  FROM (SELECT *, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS qn FROM vec_queries) q
  JOIN (SELECT *, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS hn FROM vec_history) h
    ON q.label = h.label,
  LATERAL (SELECT list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(h.embedding AS DOUBLE[])) AS dot) d
) x WHERE rank <= 3"""

ORACLES["cosine_pairs"] = cte("vec_history") + """
SELECT a.vec_id, round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE dot / (na * nb) END, 9) AS cos FROM (
  SELECT a.vec_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dot,
    sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) AS na,
    sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS nb
  FROM vec_history a JOIN vec_history b ON b.vec_id = a.vec_id + 1) a"""

from sqlforge.operators.retrieval import CONTEXT_TEXTS as CH  # noqa: E402  (default texts)


def _context_sql(qrel: str) -> str:
    return f"""tlines AS (
  SELECT t.q_id, t.table_rank, {lit(CH['table'])} || t.table_name || {lit(CH['columns'])} || coalesce(string_agg(c.col_name, ', ' ORDER BY c.col_rank), '') || {lit(CH['columns_end'])} AS line
  FROM tables_r t LEFT JOIN cols_r c ON c.q_id = t.q_id AND c.table_name = t.table_name
  GROUP BY t.q_id, t.table_rank, t.table_name),
sch AS (SELECT q_id, string_agg(line, chr(10) ORDER BY table_rank) AS lines FROM tlines GROUP BY q_id),
exs AS (SELECT s.q_id, string_agg({lit(CH['example'])} || CAST(s.rank AS VARCHAR) || chr(10) || {lit(CH['asked'])} || h.question
                                  || chr(10) || {lit(CH['answered'])} || h.sql, chr(10) ORDER BY s.rank) AS ex
        FROM shots s JOIN history h ON h.db_id = s.db_id AND h.hist_ord = s.hist_ord GROUP BY s.q_id),
ctx AS (
  SELECT k.q_id, k.db_id, concat_ws(chr(10) || chr(10),
    {lit(CH['schema'] + chr(10) + CH['database'])} || k.db_id || CASE WHEN sch.lines IS NOT NULL THEN chr(10) || sch.lines ELSE '' END,
    CASE WHEN coalesce(k.evidence, '') <> '' THEN {lit(CH['knowledge'] + chr(10))} || k.evidence END,
    CASE WHEN exs.ex IS NOT NULL THEN chr(10) || {lit(CH['examples'] + chr(10))} || exs.ex END,
    {lit(CH['question'] + chr(10))} || k.question) AS context
  FROM {qrel} k LEFT JOIN sch ON sch.q_id = k.q_id LEFT JOIN exs ON exs.q_id = k.q_id)"""


ORACLES["prompt_context"] = (_RET + f", {_KNOWN}, {_rank_tables_sql('known')}, {_prune_sql('known')}, "
                             f"{_fewshot_sql('known')}, {_context_sql('known')}"
                             "\nSELECT q_id, CAST(length(context) AS INT) AS n_chars, md5(context) AS context_md5 FROM ctx")

_CHOSEN = """chosen AS (
  SELECT q.q_id, q.question, q.evidence, coalesce(q.db_id, r.db_id) AS db_id FROM questions q
  LEFT JOIN routed r ON r.q_id = q.q_id AND r.rank = 1 AND q.db_id IS NULL),
routing AS (
  SELECT q_id, db_id || ':' || printf('%.9f', 1.0) AS routing FROM questions WHERE db_id IS NOT NULL
  UNION ALL
  SELECT r.q_id, string_agg(r.db_id || ':' || printf('%.9f', r.score), ';' ORDER BY r.rank) FROM routed r
  JOIN questions q ON q.q_id = r.q_id AND q.db_id IS NULL GROUP BY r.q_id)"""
ORACLES["rag_link"] = (_RET + f", {_ROUTE}, {_CHOSEN}, {_rank_tables_sql('chosen')}, {_prune_sql('chosen')}, "
                       f"{_fewshot_sql('chosen')}, {_context_sql('chosen')}"
                       "\nSELECT c.q_id, c.db_id AS selected_db, r.routing, md5(c.context) AS context_md5"
                       " FROM ctx c JOIN routing r ON r.q_id = c.q_id")

# The stub encoder counts the 26 letters, so its cosines are those of letter "words".
for _name in ("rank_tables", "rag_link"):
    ORACLES[f"{_name}_vectors"] = ORACLES[_name].replace(f"'{WORD}'", "'[a-z]'")
ORACLES["route_vectors"] = ORACLES["route_topk"].replace(f"'{WORD}'", "'[a-z]'")

_BULLETS = _schema_fk(False).split("SELECT t.db_id, CASE")[0].replace("WITH ", "", 1)
ORACLES["schema_line_filter"] = cte("questions") + f""", {_KNOWN}, {_BULLETS.rstrip()},
bullets AS (SELECT t.db_id, CASE WHEN f.fk IS NULL THEN t.s ELSE t.s || chr(10) || chr(10) || 'Foreign Keys:' || chr(10) || f.fk END AS schema
            FROM t LEFT JOIN f ON t.db_id = f.db_id),
kept AS (
  SELECT q.q_id, b.schema, list_filter(string_split(b.schema, chr(10)), lambda ln:
      len(list_filter(regexp_extract_all(lower(ln), '{WORD}'), lambda w: length(w) > 2 AND contains(lower(q.question), w))) > 0
      OR starts_with(ln, 'Table') OR starts_with(ln, 'Foreign')) AS ls
  FROM known q JOIN bullets b ON b.db_id = q.db_id)
SELECT q_id, CAST(len(string_split(txt, chr(10))) AS INT) AS n_lines, md5(txt) AS kept_md5
FROM (SELECT q_id, CASE WHEN len(ls) > 0 THEN array_to_string(ls, chr(10)) ELSE schema END AS txt FROM kept) x"""

# ------------------------------------------------------------------ reflection and rollouts
_CORPUS_LOOKUP = """lookup AS (SELECT question, max_by(schema, sample_id) AS schema, max_by(evidence, sample_id) AS evidence
                  FROM q GROUP BY question),
refl AS (SELECT d.sample_id, d.question, coalesce(l.schema, '') AS schema, coalesce(l.evidence, '') AS evidence,
                d.pred_sql, d.gold_sql FROM details d LEFT JOIN lookup l ON l.question = d.question WHERE NOT d.ex)"""
_REFL_BASE = (_WITH_SCHEMA + ", " + cte("pairs", "result_rows", "result_status", "result_status_err").replace("WITH ", "", 1)
              + f", {EX_BODY}, {_DETAILS}, {_CORPUS_LOOKUP}")
ORACLES["reflection_set"] = _REFL_BASE + "\nSELECT sample_id, question, md5(schema) AS schema_md5, evidence, pred_sql, gold_sql FROM refl"

_FB = """fb AS (
  SELECT s.sample_id,
    CASE WHEN s.status = 'ok' THEN '[' || coalesce(h.txt, '') || ']' ELSE '' END AS exec_result,
    CASE WHEN s.status = 'ok' THEN '' ELSE s.error END AS exec_error
  FROM (SELECT * FROM result_status_err WHERE side = 'pred') s
  LEFT JOIN (SELECT sample_id, string_agg(row_str, ', ' ORDER BY row_no) AS txt FROM result_rows
             WHERE side = 'pred' AND row_no <= 10 GROUP BY sample_id) h ON s.sample_id = h.sample_id)"""
_PROMPT = f"""concat_ws(chr(10) || chr(10),
    {lit(H['schema'] + chr(10))} || r.schema,
    CASE WHEN r.evidence <> '' THEN {lit(H['knowledge'] + chr(10))} || r.evidence END,
    {lit(H['question'] + chr(10))} || r.question,
    {lit(H['previous'] + chr(10) + '```sql' + chr(10))} || r.pred_sql || chr(10) || '```',
    CASE WHEN coalesce(f.exec_error, '') <> '' THEN {lit(H['error'] + chr(10))} || f.exec_error
         ELSE {lit(H['result'] + chr(10))} || substr(coalesce(f.exec_result, ''), 1, {K.FEEDBACK_CHARS}) END,
    {lit(K.REFLECTION_INSTRUCTION)})"""
ORACLES["reflection_prompt"] = (_REFL_BASE + f", {_FB}\nSELECT r.sample_id, CAST(length({_PROMPT}) AS INT) AS n_chars, md5({_PROMPT}) AS prompt_md5"
                                " FROM refl r LEFT JOIN fb f ON f.sample_id = r.sample_id")

ORACLES["reflection_chat"] = (_REFL_BASE + f""", {_FB}
SELECT sample_id, 2 AS n_messages, 'system' AS first_role, md5(p) AS user_md5,
  md5({lit(K.REFLECTION_SYSTEM)} || chr(10) || chr(10) || 'User: ' || p || chr(10) || 'Assistant:') AS flat_md5
FROM (SELECT r.sample_id, {_PROMPT} AS p FROM refl r LEFT JOIN fb f ON f.sample_id = r.sample_id) x""")

_ADV = """adv AS (
  SELECT *, (reward - avg(reward) OVER (PARTITION BY group_id)) / (stddev_pop(reward) OVER (PARTITION BY group_id) + 1e-8) AS advantage,
    max(reward) OVER (PARTITION BY group_id) - min(reward) OVER (PARTITION BY group_id) < 1e-6 AS flat,
    count(*) OVER (PARTITION BY group_id) AS n_all
  FROM rollouts)"""
ORACLES["group_advantage"] = cte("rollouts") + f", {_ADV}\nSELECT group_id, output_idx, round(advantage, 6) + 0.0 AS advantage FROM adv"
ORACLES["informative_groups"] = cte("rollouts") + f""", {_ADV}
SELECT group_id, output_idx, round(advantage, 6) + 0.0 AS advantage FROM adv WHERE NOT flat AND abs(advantage) >= 1e-6"""
_LOSS = """loss_t AS (
  SELECT group_id, sum(CASE WHEN abs(advantage) >= 1e-6 THEN
      -least(exp(logp_new - logp_ref) * advantage, least(greatest(exp(logp_new - logp_ref), 0.8), 1.2) * advantage)
      + 0.04 * (logp_new - logp_ref) ELSE 0.0 END) / max(n_all) AS loss
  FROM adv WHERE NOT flat GROUP BY group_id)"""
ORACLES["clipped_objective"] = cte("rollouts") + f", {_ADV}, {_LOSS}\nSELECT group_id, round(loss, 6) + 0.0 AS loss FROM loss_t"
ORACLES["group_rewards"] = cte("rollouts") + """
SELECT group_id, round(avg(reward), 9) AS mean_reward, max(reward) - min(reward) < 1e-6 AS flat FROM rollouts GROUP BY group_id"""
ORACLES["training_log"] = cte("rollouts") + f""", {_ADV}, {_LOSS},
per AS (SELECT group_id, avg(reward) AS mr, max(reward) - min(reward) < 1e-6 AS flat FROM rollouts GROUP BY group_id),
seq AS (SELECT p.*, l.loss, row_number() OVER (ORDER BY p.group_id) AS seq, row_number() OVER (ORDER BY p.group_id) - 1 AS step
        FROM per p LEFT JOIN loss_t l ON l.group_id = p.group_id),
upd AS (SELECT *, row_number() OVER (ORDER BY seq) AS global_step FROM seq WHERE NOT flat AND (step + 1) % {K.GRAD_ACCUM} = 0)
SELECT u.global_step, 0 AS epoch, u.step, u.group_id,
  round((SELECT sum(s.mr) FROM seq s WHERE s.seq BETWEEN u.seq - {K.LOG_EVERY - 1} AND u.seq) / {float(K.LOG_EVERY)}, 9) AS avg_reward,
  round(u.loss, 6) + 0.0 AS loss
FROM upd u WHERE u.global_step % {K.LOG_EVERY} = 0"""

_RUN_GROUPS = "run_id, epoch, group_id"
ORACLES["training_log_runs"] = cte("rollout_runs") + f""", {_ADV.replace("PARTITION BY group_id", f"PARTITION BY {_RUN_GROUPS}").replace("FROM rollouts", "FROM rollout_runs")},
{_LOSS.replace("SELECT group_id, sum", f"SELECT {_RUN_GROUPS}, sum").replace("GROUP BY group_id", f"GROUP BY {_RUN_GROUPS}")},
per AS (SELECT {_RUN_GROUPS}, avg(reward) AS mr, max(reward) - min(reward) < 1e-6 AS flat FROM rollout_runs GROUP BY {_RUN_GROUPS}),
seq AS (SELECT p.*, l.loss, row_number() OVER (PARTITION BY p.run_id ORDER BY p.epoch, p.group_id) AS seq,
          row_number() OVER (PARTITION BY p.run_id, p.epoch ORDER BY p.group_id) - 1 AS step
        FROM per p LEFT JOIN loss_t l ON l.run_id = p.run_id AND l.epoch = p.epoch AND l.group_id = p.group_id),
upd AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS global_step FROM seq WHERE NOT flat AND (step + 1) % {K.GRAD_ACCUM} = 0)
SELECT u.run_id, u.global_step, u.epoch, u.step, u.group_id,
  round((SELECT sum(s.mr) FROM seq s WHERE s.run_id = u.run_id AND s.seq BETWEEN u.seq - {K.LOG_EVERY - 1} AND u.seq) / {float(K.LOG_EVERY)}, 9) AS avg_reward,
  round(u.loss, 6) + 0.0 AS loss
FROM upd u WHERE u.global_step % {K.LOG_EVERY} = 0"""

_W9 = K.REWARD_WEIGHTS
_WSUM = float(sum(_W9.values()))


def _total(prefix: str = "") -> str:
    return (f"({_W9['exec']} * r_exec + {_W9['format']} * r_format + {_W9['syntax']} * r_syntax + "
            f"{_W9['schema']} * r_schema + {_W9['ngram']} * r_ngram) / {_WSUM}")




def _rs_cte(pred: str, gold: str, rel: str) -> str:
    return f"""rs AS (
  SELECT sample_id, CASE WHEN len(g) = 0 THEN CASE WHEN len(p) = 0 THEN 1.0 ELSE 0.5 END WHEN len(p) = 0 THEN 0.0
    ELSE len(list_intersect(p, g)) / (len(p) + len(g) - len(list_intersect(p, g))) END AS r_schema
  FROM (SELECT sample_id, {schema_toks(pred)} AS p, {schema_toks(gold)} AS g FROM {rel}) t)"""


def _rn_cte(pred: str, gold: str, rel: str) -> str:
    return f"""grams AS (SELECT sample_id, 'p' AS side, unnest({bigrams(pred)}) AS gram FROM {rel}
          UNION ALL SELECT sample_id, 'g', unnest({bigrams(gold)}) FROM {rel}),
cnt AS (SELECT sample_id, gram, count(*) FILTER (WHERE side = 'p') AS p, count(*) FILTER (WHERE side = 'g') AS g
        FROM grams GROUP BY sample_id, gram),
com AS (SELECT sample_id, sum(least(p, g)) AS common, sum(p) AS np, sum(g) AS ng FROM cnt GROUP BY sample_id),
rn AS (SELECT r.sample_id, CASE WHEN coalesce(ng, 0) = 0 THEN CASE WHEN coalesce(np, 0) = 0 THEN 1.0 ELSE 0.0 END
    WHEN coalesce(np, 0) = 0 THEN 0.0 WHEN common = 0 THEN 0.0
    ELSE 2 * (common / np) * (common / ng) / ((common / np) + (common / ng)) END AS r_ngram
  FROM {rel} r LEFT JOIN com ON r.sample_id = com.sample_id)"""


_REX = f"""{_sides_sql()},
{_cmp_sql('s.po', 's.po')}, {F1_BODY},
rex AS (SELECT s.sample_id, CASE WHEN NOT (s.pred_ok AND s.gold_ok) THEN 0.0 WHEN coalesce(c.same, true) THEN 1.0 ELSE f.f1 END AS r_exec
        FROM sides s LEFT JOIN cmp c ON s.sample_id = c.sample_id LEFT JOIN f1_t f ON s.sample_id = f.sample_id)"""
_ROUND_ALL = ("round(r_exec, 9) AS r_exec, round(r_format, 9) AS r_format, round(r_syntax, 9) AS r_syntax, "
              "round(r_schema, 9) AS r_schema, round(r_ngram, 9) AS r_ngram")

# Dry-run validity of the F3 texts, decided by hand from the fixture: blank texts score 0; the only
# texts that do not plan are those naming the renamed column c_phone (it does not exist); the rest plan.
_SYN_F3 = "CAST(CASE WHEN trim(pred_sql) = '' THEN 0.0 WHEN contains(pred_sql, 'c_phone') THEN 0.5 ELSE 1.0 END AS DOUBLE)"
ORACLES["corpus_validity"] = cte("pairs") + f"\nSELECT sample_id, {_SYN_F3} AS r_syntax FROM pairs"
ORACLES["reward_total"] = (cte("pairs", "model_outputs", "result_rows", "result_status")
                           + f", {_REX}, {_rs_cte('pred_sql', 'gold_sql', 'pairs')}, {_rn_cte('pred_sql', 'gold_sql', 'pairs')}" + f""",
parts AS (
  SELECT p.sample_id, x.r_exec, ({_TAG_HITS}) / {float(len(K.ALL_TAGS))} AS r_format, {_SYN_F3} AS r_syntax,
    rs.r_schema, rn.r_ngram
  FROM pairs p JOIN rex x ON x.sample_id = p.sample_id JOIN model_outputs m ON m.sample_id = p.sample_id
  JOIN rs ON rs.sample_id = p.sample_id JOIN rn ON rn.sample_id = p.sample_id)
SELECT sample_id, {_ROUND_ALL}, round({_total()}, 9) AS r_total FROM parts""")

# Answers that still start with a tag (no answer tag, no fence) do not parse; the others are the
# corpus queries, which plan.
_ANSWER = (f"CASE WHEN {_ANS} <> '' THEN {_ANS} WHEN regexp_matches(output, {_FENCE}) "
           f"THEN {strip(f'regexp_extract(output, {_FENCE}, 1)')} ELSE {strip('output')} END")
ORACLES["rollout_rewards"] = (cte("model_outputs", "qa_corpus", "result_rows", "result_status") + f""",
ans AS (SELECT m.sample_id, m.output, {_ANSWER} AS answer, q.query AS gold_sql
        FROM model_outputs m JOIN qa_corpus q ON q.sample_id = m.sample_id),
{_REX}, {_rs_cte('answer', 'gold_sql', 'ans')}, {_rn_cte('answer', 'gold_sql', 'ans')},
parts AS (
  SELECT a.sample_id, x.r_exec, ({_TAG_HITS}) / {float(len(K.ALL_TAGS))} AS r_format,
    CASE WHEN trim(a.answer) = '' THEN 0.0 WHEN starts_with(a.answer, '<') THEN 0.5 ELSE 1.0 END AS r_syntax,
    rs.r_schema, rn.r_ngram
  FROM ans a JOIN rex x ON x.sample_id = a.sample_id JOIN rs ON rs.sample_id = a.sample_id JOIN rn ON rn.sample_id = a.sample_id),
t AS (SELECT CAST(floor(sample_id / 8) AS BIGINT) AS group_id, CAST(sample_id % 8 AS INT) AS output_idx,
        {_total()} AS reward FROM parts)
SELECT group_id, output_idx, round(reward, 9) AS reward,
  round((reward - avg(reward) OVER (PARTITION BY group_id)) / (stddev_pop(reward) OVER (PARTITION BY group_id) + 1e-8), 6) + 0.0 AS advantage
FROM t""")

# ------------------------------------------------------------------ token features
TOKEN_RE = r"</?(?:clause_[a-z_]+|summary)>|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
_TAGS_LIST = "[" + ", ".join(f"'{t}'" for t in K.ALL_TAGS) + "]"
_SFT_ROWS = f"""sft AS (SELECT * FROM (SELECT *, {clause_cols('items')} FROM (SELECT *, {_SPLIT} AS items FROM q) a) s
                WHERE question <> '' AND query <> ''),
texts AS (SELECT sample_id, source, query, {", ".join(f'cl_{c}' for c in K.CLAUSES)},
            {lit(K.SYSTEM_TEXT)} || chr(10) || chr(10) || 'User: ' || {_USER_TEXT} || chr(10) || 'Assistant:' AS prompt,
            {lit(K.SYSTEM_TEXT)} || chr(10) || chr(10) || 'User: ' || {_USER_TEXT} || chr(10) || 'Assistant:'
              || {tag_lines(_CL)} || chr(10) || '<summary>' || chr(10) || {strip('query')} || chr(10) || '</summary>' AS full_text
          FROM sft)"""
_VOCAB = f"""toks AS (SELECT sample_id, unnest(regexp_extract_all(full_text, '{TOKEN_RE}')) AS token,
                 unnest(range(1, len(regexp_extract_all(full_text, '{TOKEN_RE}')) + 1)) AS pos1 FROM texts),
vocab AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + {2 + len(K.ALL_TAGS)} AS INT) AS id
          FROM (SELECT token, count(*) AS n FROM toks WHERE NOT list_contains({_TAGS_LIST}, token) GROUP BY token) c)"""
ORACLES["sft_vocab"] = _WITH_SCHEMA + f", {_SFT_ROWS}, {_VOCAB}\nSELECT token, n, id FROM vocab"

_L = K.MAX_LENGTH
ORACLES["sft_features"] = _WITH_SCHEMA + f""", {_SFT_ROWS}, {_VOCAB},
ids AS (SELECT t.sample_id, t.pos1, coalesce(v.id, 3 + list_position({_TAGS_LIST}, t.token) - 1) AS id
        FROM toks t LEFT JOIN vocab v ON v.token = t.token),
plen AS (SELECT sample_id, CAST(len(regexp_extract_all(prompt, '{TOKEN_RE}')) AS INT) AS prompt_len,
                len(regexp_extract_all(full_text, '{TOKEN_RE}')) AS n_full FROM texts),
seqs AS (SELECT sample_id, pos1, id FROM ids WHERE pos1 <= {_L}
         UNION ALL SELECT sample_id, n_full + 1, 1 FROM plen WHERE n_full + 1 <= {_L}),
agg AS (SELECT s.sample_id, p.prompt_len, count(*) AS n,
          string_agg(CAST(s.id AS VARCHAR), ',' ORDER BY s.pos1) AS ids_txt,
          string_agg(CASE WHEN s.pos1 <= p.prompt_len THEN '-100' ELSE CAST(s.id AS VARCHAR) END, ',' ORDER BY s.pos1) AS lab_txt
        FROM seqs s JOIN plen p ON p.sample_id = s.sample_id GROUP BY s.sample_id, p.prompt_len)
SELECT sample_id, prompt_len, CAST(n AS INT) AS n_tokens,
  md5(ids_txt || repeat(',0', {_L} - n)) AS ids_md5,
  md5(lab_txt || repeat(',-100', {_L} - n)) AS labels_md5,
  CAST(n AS INT) AS n_mask, {_L} AS width
FROM agg"""

_SEG = _WITH_SCHEMA + f""", {_SFT_ROWS},
seg AS (SELECT sample_id, source, CAST(len(regexp_extract_all(prompt, '{TOKEN_RE}')) AS INT) AS n_prompt,
  {", ".join(f"CAST(len(regexp_extract_all(cl_{c}, '{TOKEN_RE}')) AS INT) AS n_{c}" for c in K.CLAUSES)},
  CAST(len(regexp_extract_all(query, '{TOKEN_RE}')) AS INT) AS n_summary,
  CAST(len(regexp_extract_all(full_text, '{TOKEN_RE}')) + 1 AS INT) AS n_total,
  len(regexp_extract_all(full_text, '{TOKEN_RE}')) + 1 > {_L} AS over_budget
FROM texts)"""
ORACLES["segment_lengths"] = _SEG + "\nSELECT * FROM seg"
ORACLES["segment_profile"] = _SEG + """
SELECT source, CAST(floor(n_total / 256) * 256 AS INT) AS bucket, count(*) AS n, count(*) FILTER (WHERE over_budget) AS n_over,
  round(avg(n_total), 9) AS avg_total, max(n_total) AS max_total
FROM seg GROUP BY source, CAST(floor(n_total / 256) * 256 AS INT)"""

ORACLES["segment_quantiles"] = _SEG + """,
cnt AS (SELECT source, n_total, count(*) AS n FROM seg GROUP BY source, n_total),
run AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY n_total) AS upto, sum(n) OVER (PARTITION BY source) AS whole FROM cnt)
SELECT source, """ + ", ".join(f"CAST(min(n_total) FILTER (WHERE upto >= ceil({q} * whole)) AS INT) AS p{round(q * 100)}"
                               for q in (0.5, 0.9, 0.95, 0.99)) + """, CAST(max(n_total) AS INT) AS longest
FROM run GROUP BY source"""
_UW = "list_transform(list_filter(string_split({}, ' '), lambda w: w <> ''), lambda w: 10 + length(w))"
ORACLES["sft_features_user"] = _WITH_SCHEMA + f""", {_SFT_ROWS},
enc AS (SELECT sample_id, {_UW.format('prompt')} AS p, list_append({_UW.format('full_text')}, 1)[1:{_L}] AS ids FROM texts),
lab AS (SELECT sample_id, len(p) AS np, len(ids) AS n, ids,
          list_concat(list_transform(range(least(len(p), {_L})), lambda x: -100), ids[least(len(p), {_L}) + 1:])[1:{_L}] AS l FROM enc)
SELECT sample_id, CAST(np AS INT) AS prompt_len, CAST(n AS INT) AS n_tokens,
  md5(array_to_string(list_concat(ids, list_transform(range({_L} - n), lambda x: 0)), ',')) AS ids_md5,
  md5(array_to_string(list_concat(l, list_transform(range({_L} - len(l)), lambda x: -100)), ',')) AS labels_md5,
  CAST(n AS INT) AS n_mask
FROM lab"""

# ------------------------------------------------------------------ user model surfaces (stub models)
ORACLES["batch_generate"] = _WITH_SCHEMA + f"""
SELECT sample_id, '<summary>' || chr(10) || 'SELECT ' || CAST(length(p) AS VARCHAR) || chr(10) || '</summary>' AS output,
  'SELECT ' || CAST(length(p) AS VARCHAR) AS pred_sql
FROM (SELECT sample_id, {_user_prompt(False)} AS p FROM q) x"""
ORACLES["embed_questions"] = cte("questions") + "\nSELECT q_id, concat_ws(',', " + ", ".join(
    f"CAST(length(lower(question)) - length(replace(lower(question), '{ch}', '')) AS VARCHAR)"
    for ch in "abcdefghijklmnopqrstuvwxyz") + ") AS vector FROM questions"

# ------------------------------------------------------------------ sources and sinks
# What is written comes back: the round trips equal the tables they wrote.
ORACLES["source_qa_round_trip"] = cte("qa_corpus") + """
SELECT source, db_id, question, query, evidence, difficulty, count(*) AS n, count(*) AS n_ids
FROM qa_corpus GROUP BY source, db_id, question, query, evidence, difficulty"""
ORACLES["source_array_round_trip"] = cte("qa_corpus") + """
SELECT source, db_id, question, query, count(*) AS n, count(*) AS n_ids FROM qa_corpus WHERE source = 'plain' GROUP BY source, db_id, question, query"""
ORACLES["missing_source"] = cte("qa_corpus") + """
SELECT 'there' AS source, db_id, count(*) AS n, CAST(sum(length(question)) AS BIGINT) AS question_chars FROM qa_corpus GROUP BY db_id"""
ORACLES["split_round_trip"] = f"SELECT * EXCLUDE (sample_id) FROM ({ORACLES['sft_build']}) s"
ORACLES["report_round_trip"] = ORACLES["eval_details"]
