"""Clause split, tagged output text and its parsing, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ALL_TAGS, CLAUSES, KEYWORD_RE
from .text import _c, let, py_strip, rstrip_chars

_MARK, _SEP = "\u0001", "\u0002"

# Processed keyword text -> clause (JOIN is matched by containment instead).
_KW_CLAUSE = {"SELECT": "select", "FROM": "from", "WHERE": "where", "GROUP BY": "group_by",
              "HAVING": "having", "ORDER BY": "order_by", "LIMIT": "limit"}

# Keyword added by the assembler, and the prefix that counts as "already there".
_ASSEMBLE = {"select": ("SELECT", "SELECT "), "from": ("FROM", "FROM "), "where": ("WHERE", "WHERE "),
             "group_by": ("GROUP", "GROUP BY "), "having": ("HAVING", "HAVING "),
             "order_by": ("ORDER", "ORDER BY "), "limit": ("LIMIT", "LIMIT ")}


def clause_items(sql) -> Column:
    """Keyword/text pairs in order: array<struct<kw, val>>; text before the first keyword is dropped."""
    s = rstrip_chars(py_strip(sql), ";")
    marked = F.regexp_replace(s, KEYWORD_RE, _MARK + "$1" + _SEP)
    pieces = F.filter(F.split(marked, _MARK), lambda p, i: i > 0)
    return F.transform(pieces, lambda p: F.struct(
        F.replace(F.upper(py_strip(F.substring_index(p, _SEP, 1))), F.lit("  "), F.lit(" ")).alias("kw"),
        py_strip(F.substring_index(p, _SEP, -1)).alias("val"),
    ))


def _kw_is(kw: str):
    return lambda it: it["kw"] == kw


def split_clauses(sql) -> Column:
    """Struct of the eight clauses. Last occurrence wins; JOIN parts are concatenated with their keyword."""
    def build(items):
        fields = []
        for clause in CLAUSES:
            if clause == "join":
                joins = F.filter(items, lambda it: it["kw"].contains("JOIN"))
                v = F.array_join(F.transform(joins, lambda it: F.when(it["val"] == "", it["kw"])
                                             .otherwise(F.concat(it["kw"], F.lit(" "), it["val"]))), " ")
            else:
                kw = [k for k, c in _KW_CLAUSE.items() if c == clause][0]
                hits = F.filter(items, _kw_is(kw))
                v = F.coalesce(F.try_element_at(hits, F.lit(-1))["val"], F.lit(""))
            fields.append(v.alias(clause))
        return F.struct(*fields)
    return let(clause_items(sql), build)


def clause_output(clauses, sql) -> Column:
    """One '<tag> value </tag>' line per clause (empty ones kept), then the summary block."""
    cl = _c(clauses)
    lines = [F.concat(F.lit(f"<clause_{c}> "), py_strip(F.coalesce(cl[c], F.lit(""))), F.lit(f" </clause_{c}>"))
             for c in CLAUSES]
    lines.append(F.concat(F.lit("<summary>\n"), py_strip(_c(sql)), F.lit("\n</summary>")))
    return F.concat_ws("\n", *lines)


def assistant_prefix() -> Column:
    """The eight open tags, one per line (prefix that starts clause generation)."""
    return F.lit("\n".join(f"<clause_{c}>" for c in CLAUSES))


def extract_tag(text, tag: str, ignore_case: bool = True) -> Column:
    """First '<tag> ... </tag>' body, whitespace-trimmed, '' when absent (dot matches newline)."""
    flags = "(?is)" if ignore_case else "(?s)"
    return py_strip(F.regexp_extract(_c(text), rf"{flags}<{tag}>\s*(.*?)\s*</{tag}>", 1))


def extract_clauses(text) -> Column:
    """Struct of the eight clause tags of a model output."""
    return F.struct(*[extract_tag(text, f"clause_{c}").alias(c) for c in CLAUSES])


def extract_summary(text) -> Column:
    """The SQL inside <summary></summary> (closing tag required)."""
    return extract_tag(text, "summary")


def assemble_sql(clauses, word_boundary: bool = False) -> Column:
    """Clauses in order, keyword added unless the text already starts with it, joined by newline.

    The prefix test has no word boundary by default (a value 'order_date' gets
    no 'ORDER BY'); ``word_boundary=True`` requires the keyword as a whole word.
    """
    cl = _c(clauses)
    parts = []
    for c in CLAUSES:
        v = py_strip(F.coalesce(cl[c], F.lit("")))
        if c == "join":
            parts.append(F.when(v != "", v))
            continue
        prefix, add = _ASSEMBLE[c]
        starts = (F.upper(v).rlike(rf"^{prefix}\b") if word_boundary else F.upper(v).startswith(prefix))
        parts.append(F.when(v != "", F.when(starts, v).otherwise(F.concat(F.lit(add), v))))
    return F.concat_ws("\n", *parts)


def final_sql(text) -> Column:
    """P5: summary when present, else the assembled clauses."""
    return F.coalesce(F.nullif(extract_summary(text), F.lit("")), assemble_sql(extract_clauses(text)))


def extract_reflection(text) -> Column:
    """struct(reasoning, answer). Case-sensitive tags; empty answer falls back to a ```sql fence, else the text."""
    t = _c(text)
    reasoning = py_strip(F.regexp_extract(t, r"(?s)<reasoning>(.*?)</reasoning>", 1))
    answer = py_strip(F.regexp_extract(t, r"(?s)<answer>(.*?)</answer>", 1))
    fence = F.when(t.rlike(r"(?is)```sql\s*(.*?)\s*```"),
                   py_strip(F.regexp_extract(t, r"(?is)```sql\s*(.*?)\s*```", 1)))
    answer = F.coalesce(F.nullif(answer, F.lit("")), fence, py_strip(t))
    return F.struct(reasoning.alias("reasoning"), answer.alias("answer"))


def tags_present(text, tags=ALL_TAGS) -> Column:
    """Number of the given tags contained in the text (exact case)."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in tags]), lambda tg: F.instr(_c(text), tg) > 0))


def format_score(text, tags=ALL_TAGS) -> Column:
    """Share of the required tags present."""
    return (tags_present(text, tags) / F.lit(float(len(tags)))).cast("double")


def missing_tags(text, tags=ALL_TAGS) -> Column:
    return F.lit(len(tags)) - tags_present(text, tags)
