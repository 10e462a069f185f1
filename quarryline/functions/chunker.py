"""Overlapping chunks of texts, packed by paragraphs, sentences and words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Count = Callable[[str], int]
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def quarter(text: str) -> int:
    """A token for each four whole characters."""
    return len(text) // 4


def _tail(parts: list[str], budget: int, count: Count) -> list[str]:
    """The longest run of last parts within the budget."""
    used, at = 0, len(parts)
    while at and used + count(parts[at - 1]) <= budget:
        at -= 1
        used += count(parts[at])
    return parts[at:]


class _Packer:
    """Packs pieces in order while they fit; ``carry`` turns a full chunk's pieces into those the next one begins with."""

    def __init__(self, size: int, glue: str, count: Count, carry: Callable[[list[str]], list[str]]):
        self.size, self.glue, self.count, self.carry = size, glue, count, carry
        self.done: list[str] = []
        self.held: list[str] = []
        self.used = 0

    def add(self, piece: str) -> None:
        cost = self.count(piece)
        if self.held and self.used + cost > self.size:
            kept = self.carry(self.held)
            self.close()
            self.held, self.used = kept, sum(map(self.count, kept))
        self.held.append(piece)
        self.used += cost

    def close(self) -> None:
        if self.held:
            self.done.append(self.glue.join(self.held))
        self.held, self.used = [], 0


def chunks(text: str | None, size: int = 500, overlap: int = 100, count: Count = quarter) -> list[str]:
    """Blank text has no chunks; text that fits is one. Paragraphs are packed while they fit; one that is too
    large itself is split at sentences, a sentence at words. A chunk begins with as many whole sentences (or words) of the one
    before as ``overlap`` allows; but not after a chunk of paragraphs that is within ``overlap`` itself, nor across a
    large paragraph. Overlap and the first piece together may exceed ``size``."""
    if not text or not text.strip():
        return []
    if count(text) <= size:
        return [text.strip()]

    def last_sentences(joined: str) -> list[str]:
        kept = " ".join(_tail(_SENTENCE_END.split(joined), overlap, count)).strip()
        return [kept] if kept else []

    def of_paragraphs(held: list[str]) -> list[str]:
        joined = "\n\n".join(held)
        return last_sentences(joined) if overlap > 0 and count(joined) > overlap else []

    def of_sentences(held: list[str]) -> list[str]:
        return last_sentences(" ".join(held)) if overlap > 0 else []

    def of_words(held: list[str]) -> list[str]:
        return _tail(held, overlap, count) if overlap > 0 else []

    def split(pieces: Iterable[str], glue: str, carry, finer) -> list[str]:
        packer = _Packer(size, glue, count, carry)
        for piece in pieces:
            if finer and count(piece) > size:
                packer.close()
                packer.done += finer(piece)
            else:
                packer.add(piece)
        packer.close()
        return packer.done

    by_words = lambda s: split(s.split(), " ", of_words, None)
    by_sentences = lambda p: split(_SENTENCE_END.split(p), " ", of_sentences, by_words)
    whole = (p.strip() for p in text.split("\n\n"))
    return split((p for p in whole if p), "\n\n", of_paragraphs, by_sentences)


def chunked(docs: DataFrame, text: str = "text", size: int = 500, overlap: int = 100) -> DataFrame:
    """``docs`` without its text, with a row for each chunk: chunk_index from 0, and chunk."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t, size, overlap))

    others: list[str | Column] = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(split(F.col(text))).alias("chunk_index", "chunk"))
