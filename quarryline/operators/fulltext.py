"""Full-text search over titles and contents, with snippets.

The indexed dialect is that of a trigram index: terms are case-insensitive substrings of three
characters at least; blanks mean AND across all columns, "..." is a phrase, OR, NOT and `column : term` work. What
it can't parse, and queries under three characters, fall back to one case-insensitive LIKE of the whole
query on title or content, whose % and _ stay wildcards.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHORTEST = 3
_TOKENS = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()])|(\w+)(\s*:)?|(\S))', re.U)


class SyntaxFallback(ValueError):
    """The query isn't one of the indexed dialect."""


def parse(query: str) -> list:
    """A tree of ("term", text, column or None), ("and", a, b), ("or", a, b), ("not", a, b)."""
    found, column = [], None
    for phrase, paren, word, colon, other in _TOKENS.findall(query):
        if other:
            raise SyntaxFallback(other)
        if paren:
            found.append(paren)
        elif word and colon:
            column = word.lower()
        elif word in ("AND", "OR", "NOT"):
            found.append(word)
        else:
            found.append(("term", word or phrase.replace('""', '"'), column))
            column = None
    if column or query.count('"') % 2:
        raise SyntaxFallback(query)
    at = 0

    def peek():
        return found[at] if at < len(found) else None

    def primary():
        nonlocal at
        t = peek()
        if t == "(":
            at += 1
            inner = either()
            if peek() != ")":
                raise SyntaxFallback("(")
            at += 1
            return inner
        if isinstance(t, tuple):
            at += 1
            return t
        raise SyntaxFallback(str(t))

    def minus():
        nonlocal at
        left = primary()
        while peek() == "NOT":
            at += 1
            left = ("not", left, primary())
        return left

    def both():
        nonlocal at
        left = minus()
        while peek() == "AND" or isinstance(peek(), tuple) or peek() == "(":
            at += peek() == "AND"
            left = ("and", left, minus())
        return left

    def either():
        nonlocal at
        left = both()
        while peek() == "OR":
            at += 1
            left = ("or", left, both())
        return left

    tree = either()
    if at < len(found):
        raise SyntaxFallback(str(found[at]))
    return tree


def indexed(query: str, columns: dict[str, Column]) -> Column:
    """The predicate of a query of the indexed dialect."""

    def of(t) -> Column:
        if t[0] == "term":
            _, text, column = t
            if column is not None and column not in columns:
                raise SyntaxFallback(column)
            if len(text) < SHORTEST:
                return F.lit(False)
            where = [columns[column]] if column else list(columns.values())
            return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in where])
        a, b = of(t[1]), of(t[2])
        return a & b if t[0] == "and" else a | b if t[0] == "or" else a & ~b

    return of(parse(query))


def like(query: str, columns: list[Column]) -> Column:
    """The whole query as one substring, case-insensitive, wildcards and all."""
    return reduce(lambda a, b: a | b, [F.coalesce(c.ilike(f"%{query}%"), F.lit(False)) for c in columns])


def matches(query: str, columns: dict[str, Column], dialect: str = "indexed") -> Column:
    """Columns are title, content, and others that only the index covers (chat_id)."""
    plain = [columns["title"], columns["content"]]
    if dialect != "indexed" or len(query) < SHORTEST:
        return like(query, plain)
    try:
        return indexed(query, columns)
    except SyntaxFallback:
        return like(query, plain)


def ordered(rows: DataFrame) -> DataFrame:
    """Chats with the latest message first, in a chat the oldest message first; no ranking by relevance."""
    return rows.orderBy(F.desc("last_message_at"), "created_at", "id")


def first_hits(rows: DataFrame) -> DataFrame:
    """Of each chat the first hit in that order."""
    w = W.partitionBy("chat_id").orderBy("created_at", "id")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def snippet(content: Column, query: str, length: int = 150, start: str = "<b>", stop: str = "</b>") -> Column:
    """``length`` characters around the first match, all matches in them marked, "..." where text is cut off."""
    size = F.length(content)
    at = F.greatest(F.locate(query.lower(), F.lower(content)) - 1, F.lit(0))
    end = F.least(size, F.greatest(at - length // 2, F.lit(0)) + length)
    begin = F.greatest(end - length, F.lit(0))
    marked = F.regexp_replace(F.substring(content, begin + 1, end - begin), F.lit(f"(?i)(\\Q{query}\\E)"), F.lit(f"{start}$1{stop}"))
    return F.concat(F.when(begin > 0, "...").otherwise(""), marked, F.when(end < size, "...").otherwise(""))
