"""Overlapping chunks of texts, along paragraphs and sentences."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how byte-pair vocabularies of this kind split a text before merging.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PARAGRAPH = re.compile(r"\n\s*\n+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class ChunkSize:
    """Tokens aimed at, and their limits; tokens are counted by ``count``."""

    target: int
    least: int
    most: int
    overlap: int

    @staticmethod
    def of(target: int, least: int | None = None, most: int | None = None, overlap_ratio: float = 0.0, overlap: int | None = None) -> ChunkSize:
        if target <= 0:
            raise ValueError("target must be positive")
        least = max(int(target * 0.6), 1) if least is None else least
        most = min(int(target * 1.6), 650) if most is None else most
        if not 0 < least <= target <= most:
            raise ValueError("0 < least <= target <= most must hold")
        if not 0 <= overlap_ratio < 1:
            raise ValueError("overlap_ratio must lie in [0, 1)")
        return ChunkSize(target, least, most, min(int(target * overlap_ratio) if overlap is None else overlap, target // 2))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n+"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    return F.filter(F.split(paragraph, r"(?<=[.!?])\s+"), lambda s: s != "")


def count(text: str) -> int:
    """Tokens of a text where no tokenizer is named: its words, by blanks."""
    return len(text.split())


@lru_cache(maxsize=4)
def _encoding(path: str):
    """The byte-pair encoding of a rank file (base64 token and rank on each line)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(name=path, pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, vocabulary: str) -> int:
    """Tokens of a text by the rank file ``vocabulary``; strings that look like special tokens are ordinary text."""
    return len(_encoding(vocabulary).encode_ordinary(text))


def _units(text: str, most: int, count: Callable[[str], int] = count) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of paragraphs; of sentences where a paragraph is too long; of word windows where a sentence is."""
    out: list[tuple[int, int, int]] = []

    def pieces(pattern: re.Pattern, low: int, high: int) -> Iterator[tuple[int, int]]:
        at = low
        for m in pattern.finditer(text, low, high):
            yield at, m.start()
            at = m.end()
        yield at, high

    def trimmed(low: int, high: int) -> tuple[int, int]:
        while low < high and text[low].isspace():
            low += 1
        while high > low and text[high - 1].isspace():
            high -= 1
        return low, high

    for low, high in map(lambda p: trimmed(*p), pieces(_PARAGRAPH, 0, len(text))):
        if low == high:
            continue
        if (n := count(text[low:high])) <= most:
            out.append((low, high, n))
            continue
        for a, b in map(lambda p: trimmed(*p), pieces(_SENTENCE, low, high)):
            if a == b:
                continue
            if (n := count(text[a:b])) <= most:
                out.append((a, b, n))
                continue
            # whole words while they fit; a word that is longer alone is a window of its own
            low_at, held, end_at = None, 0, a
            for m in re.finditer(r"\S+", text[a:b]):
                n = count(" " + m[0])
                if low_at is not None and held + n > most:
                    out.append((low_at, end_at, held))
                    low_at, held = None, 0
                low_at = a + m.start() if low_at is None else low_at
                held, end_at = held + n, a + m.end()
            if low_at is not None:
                out.append((low_at, end_at, held))
    return out


def chunks_of(text: str | None, size: ChunkSize, count: Callable[[str], int] = count) -> list[tuple[str, int, int, int]]:
    """(text, tokens, start, end) of each chunk; none for an empty text, the whole of a short one."""
    if not text or not (total := count(text)):
        return []
    units = _units(text, size.most, count)
    if total <= size.target or not units:
        return [(text, total, 0, len(text))]
    spans: list[tuple[int, int]] = []
    start = 0
    while True:
        end, held = start, 0
        while end < len(units) and (held + units[end][2] <= size.most or end == start):
            held += units[end][2]
            end += 1
        if held < size.least and end < len(units):
            end += 1
        spans.append((start, end))
        if end >= len(units):
            break
        back, kept = end, 0
        # the next chunk begins with as many whole units as the overlap asks for, and always later than this one
        while back - 1 > start and kept < size.overlap:
            back -= 1
            kept += units[back][2]
        start = back if size.overlap else end
    tokens = lambda a, b: sum(u[2] for u in units[a:b])
    if len(spans) > 1 and tokens(*spans[-1]) < size.least:
        (a, _), (_, b) = spans[-2:]
        if len(spans) == 2 or tokens(a, b) <= size.most:
            spans[-2:] = [(a, b)]
    return [("\n\n".join(text[u[0] : u[1]] for u in units[a:b]), tokens(a, b), units[a][0], units[b - 1][1]) for a, b in spans]


def chunk(documents: DataFrame, size: ChunkSize, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, chunk_no, text, tokens, char_start, char_end) of every document; a map over rows, without a shuffle.

    Tokens are those of the rank file ``vocabulary``, which every executor can read, or words without one.
    """
    kind = documents.schema[doc_id].dataType.simpleString()

    tokens = count if vocabulary is None else partial(token_count, vocabulary=vocabulary)

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(d, k, *c) for d, t in zip(part["d"], part["t"]) for k, c in enumerate(chunks_of(t, size, tokens))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "text", "tokens", "char_start", "char_end"])

    source = documents.select(documents[doc_id].alias("d"), documents[text].alias("t"))
    return source.mapInPandas(split, f"doc_id {kind}, chunk_no int, text string, tokens int, char_start int, char_end int")
