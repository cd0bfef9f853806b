"""Guards and search predicates as columns: read-only texts, wildcard matches, statement roots, cached answers, approvals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that make a query a writing one, by language.
CYPHER_WRITES = ("CREATE", "DELETE", "REMOVE", "SET", "MERGE", "DROP")
SQL_WRITES = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "TRUNCATE", "ALTER")


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words whole, in any case; a null text holds none."""
    return F.coalesce(text.rlike(r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])"), F.lit(False))


def read_only(text: Column, language: str = "sql") -> Column:
    """Whether a query of the language writes nothing by its words."""
    return ~has_word(text, SQL_WRITES if language == "sql" else CYPHER_WRITES)


def wildcard(name: Column, pattern: str) -> Column:
    """Whether a name holds a pattern in any case, where ``*`` stands for anything."""
    return F.upper(name).like("%" + pattern.upper().replace("*", "%") + "%")


def literal_match(name: Column, part: str) -> Column:
    """Whether a name holds a text as it is; % and _ stand for themselves."""
    return name.contains(part)


def is_root(vtype: Column, parent: Column) -> Column:
    """Whether a vertex is no statement, or a statement without parent."""
    return (vtype != "Statement") | (F.coalesce(parent, F.lit("")) == "")


def all_keywords(question: Column, keywords: Column) -> Column:
    """Whether every non-blank keyword of an array occurs in the question, in any case; an array without any fits nothing."""
    wanted = F.filter(keywords, lambda k: F.trim(k) != "")
    return (F.size(wanted) > 0) & F.forall(wanted, lambda k: F.lower(question).contains(F.lower(k)))


def approval(destructive: Column, policy: Column, cost: Column, most: float = 0.50) -> Column:
    """Reason why a call needs approval, by the first rule that fits, else ``allow``."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(destructive), "destructive").when(yes(policy), "policy").when(yes(cost > most), "cost").otherwise("allow")
