"""Evaluation texts leaking into training text.

The test items are few and fixed; the corpus is not.  A generalised suffix
automaton of the items' normalised words is built once and sent to the tasks
(its size is checked; beyond the bound the items go in blocks, each against
all documents).  Every document is streamed through the automaton, which keeps
the length of the longest item passage that ends at the current word.  A
length of ``min_words`` is a leak outright.  A passage of ``min_words`` words
with one word in ``edit_every`` altered still holds an unaltered run, whose
least length follows from the two limits; wherever the automaton reaches that
length, the surroundings are aligned with the item word by word and the limits
are checked exactly.

Nothing is shuffled: one pass over (doc_id, text), one row out for each find.

Defined cases: null, empty and blank texts hold nothing; words of ``shared``
or more items in a row (standing instructions) are taken out of the items
before the search; an item without ``min_words`` words left can't be found; a
document posted twice is reported under each of its ids; other columns and
their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pairloom.llm.textnorm import words, words_with_spans

#: Least words of a passage, and one alteration allowed for so many of them.
MIN_WORDS, EDIT_EVERY = 12, 6
#: A run of so many words that so many items share word for word is a standing instruction.
SHARED_WORDS, SHARED_ITEMS = 8, 3
#: Words of test items in one automaton: about 400 bytes each in a task's memory.
BLOCK_WORDS = 300_000


def least_run(min_words: int = MIN_WORDS, edit_every: int = EDIT_EVERY) -> int:
    """Words that any passage within the limits holds unaltered in a row."""
    if not edit_every:
        return min_words
    longest = range(min_words, min_words + 20 * edit_every)
    return min(-(-(n - n // edit_every) // (n // edit_every + 1)) for n in longest)


class SuffixAutomaton:
    """Of several sequences of word numbers; states as lists, transitions as dicts."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for n, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].append((n, at))
        # the ends of a state are its own and those of all states that link to it
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                ends[self.link[state]].extend(ends[state])
        self.ends = ends

    def _new(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.length) - 1

    def _split(self, state: int, target: int, word: int, ends: list) -> int:
        """A copy of ``target`` for the shorter strings that ``state`` leads to."""
        copy = self._new(self.length[state] + 1, ends)
        self.next[copy] = dict(self.next[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while state != -1 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int, ends: list) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, target, word, ends)
        new, state = self._new(self.length[last] + 1, ends), last
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state != -1:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, target, word, ends)
        return new


@dataclass
class ItemIndex:
    """Segments (pieces of a question or answer between standing instructions) and their automaton."""

    segments: list[tuple[int, str, list[int]]]
    vocabulary: dict[str, int]
    automaton: SuffixAutomaton
    run: int
    hits: list[list[tuple[int, int]] | None]
    min_words: int
    edit_every: int


def item_segments(items: list[tuple[int, str | None, str | None]], min_words: int = MIN_WORDS) -> list[tuple[int, str, list[str]]]:
    """(item, field, words) of the parts that aren't shared word for word by several items."""
    fields = [(i, f, words(t)) for i, *texts in items for f, t in zip(("question", "answer"), texts)]
    holders: dict[tuple[str, ...], set[int]] = {}
    for i, _, w in fields:
        for k in range(len(w) - SHARED_WORDS + 1):
            holders.setdefault(tuple(w[k : k + SHARED_WORDS]), set()).add(i)
    out = []
    for i, f, w in fields:
        common = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - SHARED_WORDS + 1):
            if len(holders[tuple(w[k : k + SHARED_WORDS])]) >= SHARED_ITEMS:
                common[k : k + SHARED_WORDS] = True
        start = 0
        for at in [*np.flatnonzero(common), len(w)]:
            if at - start >= min_words:
                out.append((i, f, w[start:at]))
            start = at + 1
    return out


def build_index(segments: list[tuple[int, str, list[str]]], min_words: int = MIN_WORDS, edit_every: int = EDIT_EVERY) -> ItemIndex:
    vocabulary: dict[str, int] = {}
    coded = [(i, f, [vocabulary.setdefault(x, len(vocabulary)) for x in w]) for i, f, w in segments]
    automaton = SuffixAutomaton([w for _, _, w in coded])
    run = least_run(min_words, edit_every)
    # for each state, the places of its last `run` words: the ends of its highest link of at least that length
    top: list[int] = list(range(len(automaton.length)))
    for state in sorted(top, key=automaton.length.__getitem__):
        link = automaton.link[state]
        if link > 0 and automaton.length[link] >= run:
            top[state] = top[link]
    hits = [automaton.ends[top[s]] if automaton.length[s] >= run else None for s in range(len(top))]
    return ItemIndex(coded, vocabulary, automaton, run, hits, min_words, edit_every)


def passages(item: list[int], doc: np.ndarray, min_words: int, edit_every: int) -> list[tuple[int, int, int]]:
    """(first, last, edits) of passages of ``item`` in ``doc`` within the limits, apart from each other, the longest first.

    A passage begins and ends with a word of the item; ``best[e]`` holds, for each
    word of ``doc``, the longest passage that ends there with ``e`` words altered,
    as words * unit + first: of equally long ones the one that begins last.  Of
    the passages with the same end only the longest is looked at, so the places
    between the passages may hold more.
    """
    most, size, low = len(item) // edit_every if edit_every else 0, len(doc), -(10**12)
    unit = size + 1
    best = np.full((most + 1, size + 1), low)
    fresh = np.arange(size)
    length, first, edits = np.zeros(size, dtype=int), np.zeros(size, dtype=int), np.zeros(size, dtype=int)
    for word in item:
        new = np.full_like(best, low)
        same = np.zeros(size + 1, dtype=bool)
        same[1:] = doc == word
        for e in range(most + 1):
            step = np.full(size + 1, low)
            step[1:] = np.where(same[1:], np.maximum(best[e, :-1], fresh if e == 0 else low) + unit, low)
            if e:
                other = np.maximum(best[e - 1] + unit, low)
                other[1:] = np.maximum(other[1:], np.maximum(best[e - 1, :-1] + unit, new[e - 1, :-1]))
            else:
                other = np.full(size + 1, low)
            ok = np.flatnonzero(same & (step >= max(min_words, e * edit_every) * unit))
            if len(ok):
                n, at = np.divmod(step[ok], unit)
                better = n > length[ok - 1]
                end = ok[better] - 1
                length[end], first[end], edits[end] = n[better], at[better], e
            new[e] = np.maximum(step, other)
        best = new
    found: list[tuple[int, int, int]] = []
    taken = np.zeros(size, dtype=bool)
    ends = np.flatnonzero(length)
    for last in ends[np.lexsort((ends, edits[ends], -length[ends]))].tolist():
        if not taken[last] and not taken[first[last] : last].any():
            taken[first[last] : last + 1] = True
            found.append((int(first[last]), last, int(edits[last])))
    return found


def scan(codes: list[int], index: ItemIndex) -> list[tuple[int, int, int, int]]:
    """(segment, first word, last word, edits) of the passages in one document."""
    nxt, link, length, hits, run = index.automaton.next, index.automaton.link, index.automaton.length, index.hits, index.run
    state = matched = 0
    at_segment: dict[int, list[tuple[int, int]]] = {}
    for at, word in enumerate(codes):
        if word < 0:
            state = matched = 0
            continue
        target = nxt[state].get(word)
        while target is None and state:
            state = link[state]
            matched = length[state]
            target = nxt[state].get(word)
        if target is None:
            matched = 0
            continue
        state, matched = target, matched + 1
        if matched >= run:
            # the strings of a state differ in length: go up to the one that the text really holds
            seen = state
            while length[link[seen]] >= matched:
                seen = link[seen]
            for segment, _ in hits[seen] or ():
                at_segment.setdefault(segment, []).append((at, matched))
    out = []
    whole = np.asarray(codes)
    unaltered = index.min_words - (index.min_words // index.edit_every if index.edit_every else 0)
    for segment, places in at_segment.items():
        item = index.segments[segment][2]
        reach = len(item) + len(item) // max(index.edit_every, 1) + 1
        groups, group = [], [places[0][0]]
        for at, _ in places[1:]:
            if at - group[-1] > 2 * reach:
                groups.append(group)
                group = []
            group.append(at)
        # the rest of a window is searched again until no passage is left in it
        rest = [(max(0, g[0] - reach), min(len(whole), g[-1] + reach + 1), g) for g in [*groups, group]]
        while rest:
            low, high, ats = rest.pop()
            ats = [at for at in ats if low + index.run - 1 <= at < high]
            if not ats or np.isin(whole[low:high], item).sum() < unaltered:
                continue
            got = sorted(passages(item, whole[low:high], index.min_words, index.edit_every))
            for first, last, edits in got:
                out.append((segment, low + first, low + last, edits))
            if got:
                bounds = [low, *(low + x for first, last, _ in got for x in (first, last + 1)), high]
                rest += [(a, b, [at for at in ats if a <= at < b]) for a, b in zip(bounds[::2], bounds[1::2])]
    return out


def _blocks(items: DataFrame, min_words: int, block_words: int) -> Iterator[list[tuple[int, str, list[str]]]]:
    rows = [(r["item_id"], r["question"], r["answer"]) for r in items.select("item_id", "question", "answer").dropna(subset=["item_id"]).distinct().toLocalIterator()]
    block, size = [], 0
    for segment in item_segments(sorted(rows, key=lambda r: (r[0], str(r[1:]))), min_words):
        if block and size + len(segment[2]) > block_words:
            yield block
            block, size = [], 0
        block.append(segment)
        size += len(segment[2])
    if block:
        yield block


def find_passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, edit_every: int = EDIT_EVERY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, field, first_word, last_word, edits): the passages, those of one part of an item apart from each other; words count from 0 as ``words`` splits them."""
    spark = documents.sparkSession
    kind = documents.schema[doc_id].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, field string, first_word int, last_word int, edits int"
    found = None
    for block in _blocks(items, min_words, block_words):
        shared = spark.sparkContext.broadcast((block, min_words, edit_every))

        def search(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = build_index(*shared.value)
            known = frozenset(index.vocabulary)
            code = index.vocabulary.get
            for part in parts:
                rows = []
                for doc, value in zip(part["doc_id"], part["text"]):
                    codes = [code(w, -1) for w in words(value, known)]
                    for segment, first, last, edits in scan(codes, index):
                        item, field, _ = index.segments[segment]
                        rows.append((doc, item, field, first, last, edits))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "field", "first_word", "last_word", "edits"])

        source = documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text")).dropna()
        part = source.mapInPandas(search, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def leaked(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id), each once."""
    return find_passages(documents, items, **options).select("doc_id", "item_id").distinct()


def _spans(value: str, indexes: list[tuple[ItemIndex, frozenset[str]]]) -> tuple[list[tuple[int, int]], bool]:
    """Places of ``value`` that passages take up, in order and apart from each other; and whether it holds one whose place can't be told."""
    spans: list[tuple[int, int]] = []
    unplaced = False
    for index, known in indexes:
        if scan([index.vocabulary.get(w, -1) for w in words(value, known)], index):
            tokens, places = words_with_spans(value, known)
            own = [(places[a][0], places[b][1]) for _, a, b, _ in scan([index.vocabulary.get(w, -1) for w in tokens], index)]
            unplaced |= not own
            spans += own
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, unplaced


def remove_leaks(documents: DataFrame, items: DataFrame, coverage: float = 0.5, min_words: int = MIN_WORDS, edit_every: int = EDIT_EVERY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text, removed_words, dropped, uncut) of all documents with the leaked passages cut out.

    Passages that overlap are cut as one; ``removed_words`` counts each word once.
    A document of which passages cover more than ``coverage`` of the words is
    dropped whole: its text becomes null and ``dropped`` true.  ``uncut``: the text
    still holds a passage, of which no place could be told.  Every task holds the
    automata of all blocks.
    """
    spark = documents.sparkSession
    blocks = list(_blocks(items, min_words, block_words))
    shared = spark.sparkContext.broadcast((blocks, min_words, edit_every))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def clean(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, *limits = shared.value
        indexes = [(x, frozenset(x.vocabulary)) for x in (build_index(b, *limits) for b in got)]
        for part in parts:
            texts, removed, dropped, uncut = [], [], [], []
            for value in part["text"]:
                total = gone = 0
                unplaced = False
                # where a cut joins two pieces to a passage, that is cut too
                while value:
                    spans, unplaced = _spans(value, indexes)
                    if not spans:
                        break
                    places = words_with_spans(value)[1]
                    total = total or len(places)
                    gone += sum(any(a <= x and y <= b for a, b in spans) for x, y in places)
                    for a, b in reversed(spans):
                        value = value[:a] + value[b:]
                if total and gone > coverage * total:
                    value = None
                texts.append(value)
                uncut.append(bool(value) and unplaced)
                removed.append(gone)
                dropped.append(bool(total and gone > coverage * total))
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": texts, "removed_words": removed, "dropped": dropped, "uncut": uncut})

    return documents.select("doc_id", "text").mapInPandas(clean, f"doc_id {kind}, text string, removed_words int, dropped boolean, uncut boolean")


def p8_found(spark, sf: str) -> DataFrame:
    return leaked(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet"))


def p8_cleaned(spark, sf: str) -> DataFrame:
    """All documents with the leaked passages removed."""
    return remove_leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet"))


QUERIES = {"p8_found": p8_found, "p8_cleaned": p8_cleaned}
SQL: dict[str, str] = {}
