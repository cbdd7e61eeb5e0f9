"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items build one automaton. Training texts stream their words through it; at every word the
automaton gives the longest run of words ending there that some item contains. A run of ``window`` words or more
covers its words; an item shorter than a window counts where it occurs as a whole. Covered spans are removed; where
they cover more than ``max_share`` of a text's words, the text is emptied.

The items are cut into groups of bounded size, each with an automaton of its own, and the texts pass by every group;
the number of groups grows with the benchmark only. Nothing of the corpus is shuffled.

Defined results: a null text or item, or one without words, has no words and no windows. Repeated items count once
per item id, items without an id under the empty string. Repeated documents are judged each by itself. The columns
``n_words, n_hit, items, spans, clean_text, contaminated`` are replaced, all others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, with_fields

WINDOW, MAX_SHARE = 10, 0.5
#: Words of items in one automaton; a broadcast holds one group at a time.
GROUP_WORDS = 200_000
#: The words of the contract.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = str.maketrans(UPPER, LOWER)
RESULT = {"n_words": "long", "n_hit": "long", "items": "array<string>", "spans": "array<struct<first:int,end:int>>",
          "clean_text": "string", "contaminated": "boolean"}


def lowered(text: str) -> str:
    """The text with A-Z in small letters, and no other letter changed."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lowered(text)) if text else []


class SuffixAutomaton:
    """States of all word runs of the items; ``step`` follows a text."""

    def __init__(self, items: Iterable[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = []
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.long: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for name, words in items:
            self._mark(len(self.names), words)
            self.names.append(name)
        # runs of known words that can hold a window or a whole item; no match crosses another word
        shortest = min([window, *(len(words) for _, words in items)])
        self._runs = re.compile(b"\x01{%d,}" % max(shortest, 1))

    def _state(self, length: int, link: int, following: dict[str, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        """The state of p's run followed by the word, apart from q's longer runs."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: str) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word)
        state, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, self.next[p][word], word)
        return state

    def _mark(self, item: int, words: list[str]) -> None:
        state = length = 0
        for word in words:
            state, length = self.step(state, length, word)
            if length >= self.window:
                self.long.setdefault(self.at_window(state), set()).add(item)
        if len(words) < self.window:
            self.short.setdefault(state, []).append((len(words), item))

    def step(self, state: int, length: int, word: str) -> tuple[int, int]:
        """State and longest matching length after one more word."""
        following = self.next
        while state and word not in following[state]:
            state = self.link[state]
            length = self.length[state]
        found = following[state].get(word)
        return (found, length + 1) if found is not None else (0, 0)

    def at_window(self, state: int) -> int:
        """The state of the last ``window`` words of a longer match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def short_items(self, state: int, length: int) -> Iterator[tuple[int, int]]:
        """(words, item) of the short items that end here."""
        while state > 0:
            for n, item in self.short.get(state, ()):
                if n <= length:
                    yield n, item
            state = self.link[state]
            length = min(length, self.length[state])

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """(disjoint covered spans in order, names of the items found)."""
        ends_short = self._ends_short()
        window, following, vocabulary = self.window, self.next, self.next[0]
        spans: list[list[int]] = []
        found: set[int] = set()
        known = bytes(map(vocabulary.__contains__, words))
        for run in self._runs.finditer(known):
            state = length = 0
            for i in range(*run.span()):
                word = words[i]
                if (after := following[state].get(word)) is not None:
                    state, length = after, length + 1
                else:
                    state, length = self.step(state, length, word)
                first = i + 1
                if length >= window:
                    found |= self.long[self.at_window(state)]
                    first = i + 1 - window
                if state in ends_short:
                    for n, item in self.short_items(state, length):
                        found.add(item)
                        first = min(first, i + 1 - n)
                if first <= i:
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append([first, i + 1])
        return [(a, b) for a, b in spans], {self.names[k] for k in found}

    def _ends_short(self) -> set[int]:
        """States on whose way to the root a short item lies."""
        if not hasattr(self, "_near_short"):
            near = set()
            for state in sorted(range(len(self.link)), key=self.length.__getitem__):
                if state in self.short or self.link[state] in near:
                    near.add(state)
            self._near_short = near
        return self._near_short


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from each span's first word to its last."""
    places = [m.span() for m in WORD.finditer(lowered(text))]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return "".join(out) + text[at:]


def item_groups(benchmark: DataFrame, id_col: str, text_col: str, group_words: int) -> DataFrame:
    """``part, name, text``: items dealt to as many parts as hold ``group_words`` each on average."""
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + size // (6 * group_words)
    return items.withColumn("part", F.pmod(F.xxhash64("name", "text"), F.lit(parts)).cast("int"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
    max_share: float = MAX_SHARE, item_id_col: str = "item_id", item_text_col: str = "text",
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """The documents with their hits, the items found, the covered word spans and the cleaned text.

    The driver holds one group of items at a time, of about ``group_words`` words, and broadcasts it.
    """
    groups = item_groups(benchmark, item_id_col, item_text_col, group_words)
    carried = [c for c in docs.columns if c not in RESULT]
    found = docs.select(*carried, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"),
                        F.array().cast("array<struct<first:int,end:int>>").alias("spans"))
    context = docs.sparkSession.sparkContext
    # without items, one empty group still counts the words
    for part in sorted(r[0] for r in groups.select("part").distinct().collect()) or [0]:
        items = context.broadcast([(r["name"], r["text"]) for r in groups.filter(F.col("part") == part).collect()])
        found = found.mapInArrow(_scanner(items, text_col, window), found.schema)
    names = [*carried, *RESULT]
    schema = with_fields(docs.select(*carried).schema, ", ".join(f"{name} {kind}" for name, kind in RESULT.items()))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in RESULT}
            columns = (batch.column(c).to_pylist() for c in (text_col, "n_words", "items", "spans"))
            for text, n_words, items, spans in zip(*columns, strict=True):
                text, spans = text or "", [(s["first"], s["end"]) for s in spans]
                n_hit = sum(b - a for a, b in spans)
                clean = text if not spans else "" if n_hit > max_share * n_words else without_spans(text, spans)
                values = (n_words, n_hit, sorted(items), [{"first": a, "end": b} for a, b in spans], clean, bool(spans))
                for name, value in zip(RESULT, values, strict=True):
                    rows[name].append(value)
            kinds = dict(zip(("n_words", "n_hit", "items", "clean_text", "contaminated"),
                             (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()), strict=True))
            kinds["spans"] = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column(c) for c in carried] + [pa.array(rows[c], kinds[c]) for c in RESULT]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(finish, schema)


def _scanner(items, text_col: str, window: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton([(name, words_of(text)) for name, text in items.value], window)
        for batch in batches:
            names, spans, sizes = [], [], []
            for text, own, before in zip(*(batch.column(c).to_pylist() for c in (text_col, "items", "spans")), strict=True):
                words = words_of(text)
                sizes.append(len(words))
                more, hits = automaton.scan(words)
                names.append(sorted({*own, *hits}))
                whole = _merged([*((s["first"], s["end"]) for s in before), *more])
                spans.append([{"first": a, "end": b} for a, b in whole])
            for name, values in (("n_words", sizes), ("items", names), ("spans", spans)):
                k = batch.schema.get_field_index(name)
                batch = batch.set_column(k, batch.schema.field(k), pa.array(values, batch.schema.field(k).type))
            yield batch

    return scan
