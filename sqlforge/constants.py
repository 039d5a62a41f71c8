"""Fixed values that must equal the behaviour being reproduced.

Everything here is data: clause names and their order, the tag vocabulary,
the keyword list that the schema reward removes, default weights and limits.
Prompt wording is ours (the texts below are parameters with own defaults).
"""

# --- fixed values: the eight SQL clauses, in this order ---------------------
CLAUSES = ["select", "from", "join", "where", "group_by", "having", "order_by", "limit"]

# --- fixed values: tag vocabulary (8 open, 8 close, summary pair) ----------
OPEN_TAGS = [f"<clause_{c}>" for c in CLAUSES]
CLOSE_TAGS = [f"</clause_{c}>" for c in CLAUSES]
SUMMARY_TAGS = ["<summary>", "</summary>"]
ALL_TAGS = OPEN_TAGS + CLOSE_TAGS + SUMMARY_TAGS  # 18, the default of the format reward

# --- fixed values: keywords dropped from schema tokens (40 words) ----------
SCHEMA_STOPWORDS = [
    "select", "from", "where", "join", "on", "and", "or", "not",
    "in", "is", "null", "like", "between", "group", "by", "having",
    "order", "limit", "distinct", "count", "sum", "avg", "max", "min",
    "inner", "left", "right", "outer", "as", "case", "when", "then",
    "else", "end", "union", "all", "exists", "asc", "desc", "with",
]

# --- fixed values: keyword pattern of the clause split (one optional join word) ----------
KEYWORD_RE = r"(?i)\b(SELECT|FROM|(?:LEFT\s+|RIGHT\s+|INNER\s+|OUTER\s+|FULL\s+)?JOIN|WHERE|GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT)\b"

# --- fixed values: marks of schema texts: primary key, and the lines that the line filter always keeps ----------
KEY_MARK = " [PK]"
KEPT_LINES = ("Table", "Foreign")

# --- fixed values: reward weights (exec, format, syntax, schema, ngram) ----
REWARD_WEIGHTS = {"exec": 1.0, "format": 0.1, "syntax": 0.1, "schema": 0.2, "ngram": 0.1}

# --- fixed values: limits and sizes --------------------------------------
EVAL_TIMEOUT_S = 30.0
REWARD_TIMEOUT_S = 10.0
FEEDBACK_ROWS = 10          # rows of execution feedback
FEEDBACK_CHARS = 500        # result text cut in the reflection prompt
MAX_LENGTH = 4096           # token budget
GROUP_SIZE = 8              # outputs per prompt
ROUTE_ALPHA = 0.4
ROUTE_TOP_K = 2
TOP_TABLES = 5
TOP_COLS = 10
TOP_FEWSHOT = 3
REGISTRY_DESC_COLS = 20     # columns named in a database description
REGISTRY_KEYWORD_COLS = 30  # columns used as routing keywords
CLIP_EPS = 0.2
KL_BETA = 0.04
ADV_EPS = 1e-8
FLAT_EPS = 1e-6
GRAD_ACCUM = 8
LOG_EVERY = 10
CELL_DIGITS = 12            # significant digits of numbers when results are compared
SIM_SCALE = 9               # similarities are rounded to this many digits before ranking

# Word pattern: Unicode letters, digits and underscore (Python's \w on text).
WORD_RE = r"[\p{L}\p{N}_]+"

# --- own default prompt texts (parameters everywhere they are used) --------
SYSTEM_TEXT = (
    "Turn questions about a database into SQL. Fill in one tagged part per clause, leave a part "
    "empty if the query has no such clause, and finish with the full statement between "
    "<summary> and </summary>."
)
INSTRUCTION_TEXT = (
    "\nGo clause by clause through the tags and end with the full statement between "
    "<summary> and </summary>."
)
REFLECTION_SYSTEM = (
    "You are shown a SQL query, the question it should answer and what happened when it ran. "
    "Find what is wrong and repair it."
)
REFLECTION_INSTRUCTION = (
    "\nSay between <reasoning> and </reasoning> what has to change, then give the repaired "
    "query between <answer> and </answer>."
)
