"""Boolean retrieval: expressions over terms, as one pass or as set operations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """kind: term, not, and, or."""

    kind: str
    parts: tuple = ()
    term: str = ""

    def terms(self) -> set[str]:
        return {self.term} if self.kind == "term" else set().union(*(p.terms() for p in self.parts))


def is_boolean(query: str) -> bool:
    """Whether a query holds an operator as a word of its own."""
    return any(w in ("AND", "OR", "NOT") for w in re.findall(r"[^\s()]+", query))


def parse(query: str) -> Node:
    """NOT binds tighter than AND, AND tighter than OR; ValueError for what is no expression."""
    words, at = re.findall(r"[()]|[^\s()]+", query), 0

    def peek() -> str | None:
        return words[at] if at < len(words) else None

    def take() -> str:
        nonlocal at
        if at >= len(words):
            raise ValueError(f"unfinished expression: {query!r}")
        at += 1
        return words[at - 1]

    def chain(kind: str, below) -> Node:
        parts = [below()]
        while peek() == kind.upper():
            take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Node(kind, tuple(parts))

    def atom() -> Node:
        word = take()
        if word == "NOT":
            return Node("not", (atom(),))
        if word == "(":
            inner = chain("or", lambda: chain("and", atom))
            if take() != ")":
                raise ValueError(f"missing ')' in {query!r}")
            return inner
        if word in (")", "AND", "OR"):
            raise ValueError(f"unexpected {word!r} in {query!r}")
        return Node("term", term=word)

    tree = chain("or", lambda: chain("and", atom))
    if peek() is not None:
        raise ValueError(f"unexpected {peek()!r} in {query!r}")
    return tree


def search(query: str | Node, index: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id of the documents for which the expression holds, in one pass over the terms' postings.

    docs is the universe, so a document without terms satisfies NOT. It is read only
    if the expression can hold for a document without any of its terms.
    """
    tree = parse(query) if isinstance(query, str) else query
    names = {t: f"t{i}" for i, t in enumerate(sorted(tree.terms()))}
    flags = index.where(F.col("term").isin(*names)).groupBy("doc_id").agg(*(F.max(F.col("term") == t).alias(n) for t, n in names.items()))

    def holds(node: Node) -> Column:
        if node.kind == "term":
            return F.coalesce(F.col(names[node.term]), F.lit(False))
        parts = [holds(p) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.kind == "and" else out | p
        return ~out if node.kind == "not" else out

    if _without_terms(tree):
        flags = docs.select("doc_id").distinct().join(flags, "doc_id", "left")
    return flags.where(holds(tree)).select("doc_id")


def _without_terms(node: Node) -> bool:
    if node.kind == "term":
        return False
    parts = [_without_terms(p) for p in node.parts]
    return not parts[0] if node.kind == "not" else all(parts) if node.kind == "and" else any(parts)


def search_by_sets(query: str | Node, index: DataFrame, docs: DataFrame) -> DataFrame:
    """The same documents by semi, anti joins and unions, one operator at a time."""
    node = parse(query) if isinstance(query, str) else query
    if node.kind == "term":
        return index.where(F.col("term") == node.term).select("doc_id").distinct()
    parts = [search_by_sets(p, index, docs) for p in node.parts]
    if node.kind == "not":
        return docs.select("doc_id").distinct().join(parts[0], "doc_id", "left_anti")
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "doc_id", "left_semi") if node.kind == "and" else out.union(p).distinct()
    return out


TEMPLATES = {
    2: ("{0} AND {1}", "{0} OR {1}", "{0} AND NOT {1}"),
    3: ("{0} AND {1} AND {2}", "({0} OR {1}) AND {2}", "({0} AND {1}) OR {2}"),
}


def workload(words: list[str], vocabulary: set[str]) -> list[str]:
    """The template queries of a log line of two or three words that are all in the vocabulary; else none."""
    if not all(w in vocabulary for w in words):
        return []
    return [t.format(*words) for t in TEMPLATES.get(len(words), ())]
