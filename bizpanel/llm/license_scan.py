"""Licence scan: a generalised suffix automaton of licence words and the matches it streams.

The automaton holds every run of words of every template and base phrase. A text is streamed
through it word by word, which gives the matching statistics: for each word the longest run that
ends there and stands in some template. The suffix links of a state name all templates that share an
end of that run, and how much of it: a match of a template is kept where the next word does not go on in
that template, also if it goes on in another. Long matches are chained, per template and in template
order, into covered spans. A base phrase ends at a word when its state lies on the suffix links of
the current state and the match is at least as long.

Defined results: null and empty texts have no words and no labels. Null and repeated ids pass
through row by row. Extra columns are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizpanel.llm.license_texts import BASE_PHRASES, TEMPLATES
from bizpanel.llm.words import ALNUM_LOWER, U64, split_words, text_chunks

#: Words of the shortest match that is chained, unless the template itself is shorter.
MIN_MATCH = 4
#: Most words between two chained matches.
MAX_GAP = 12
#: Share of a template's words that a chain must cover to give its label.
MIN_COVER = 0.75


@dataclass
class _State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)
    ends: set[tuple[int, int]] = field(default_factory=set)
    phrases: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class Span:
    """Words ``start`` to ``end`` of a text, read as template ``template``."""

    template: int
    start: int
    end: int
    covered: int


class LicenceAutomaton:
    """Suffix automaton over the words of all templates and phrases."""

    def __init__(
        self,
        phrases: Iterable[tuple[str, str]] = BASE_PHRASES,
        templates: Iterable[tuple[str, str]] = TEMPLATES,
    ) -> None:
        self.phrases = [(_words(text), label) for text, label in phrases]
        self.templates = [(_words(text), label) for label, text in templates]
        self.vocabulary: dict[bytes, int] = {}
        self.states = [_State(0, -1)]
        for number, (words, _) in enumerate(self.templates):
            self._add([self._id(w) for w in words], number)
        for words, _ in self.phrases:
            self._add([self._id(w) for w in words], None)
        by_length = sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length)
        for s in by_length:
            self.states[self.states[s].link].ends |= self.states[s].ends
        self.states[0].ends = set()
        for number, (words, _) in enumerate(self.phrases):
            state = 0
            for w in words:
                state = self.states[state].next[self.vocabulary[w]]
            self.states[state].phrases.append(number)
        for s in reversed(by_length):
            self.states[s].phrases += self.states[self.states[s].link].phrases
        self.template_ids = [[self.vocabulary[w] for w in words] for words, _ in self.templates]
        #: Per state the places (template, end in it, words shared) on its suffix links.
        self.places: list[list[tuple[int, int, int]]] = [[] for _ in self.states]
        for s in reversed(by_length):
            state = self.states[s]
            here = [(t, at, state.length) for t, at in sorted(state.ends) if state.length >= self.least(t)]
            self.places[s] = here + [p for p in self.places[state.link] if p[:2] not in state.ends]
        self.shortest = min(
            [MIN_MATCH, *(len(words) for words, _ in self.phrases + self.templates)]
        )

    def least(self, template: int) -> int:
        """Words of the shortest match of a template that is chained."""
        return min(MIN_MATCH, len(self.templates[template][0]))

    def _id(self, word: bytes) -> int:
        return self.vocabulary.setdefault(word, len(self.vocabulary))

    def _add(self, ids: list[int], template: int | None) -> None:
        """Adds one sequence, beginning again at the root."""
        states, last = self.states, 0
        for at, c in enumerate(ids):
            last = self._step(last, c)
            if template is not None:
                states[last].ends.add((template, at + 1))

    def _step(self, last: int, c: int) -> int:
        states = self.states
        if c in states[last].next:
            q = states[last].next[c]
            if states[q].length == states[last].length + 1:
                return q
            return self._clone(last, q, c)
        new = len(states)
        states.append(_State(states[last].length + 1, 0))
        p = last
        while p >= 0 and c not in states[p].next:
            states[p].next[c] = new
            p = states[p].link
        if p >= 0:
            q = states[p].next[c]
            same = states[q].length == states[p].length + 1
            states[new].link = q if same else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        states = self.states
        copy = len(states)
        states.append(_State(states[p].length + 1, states[q].link, dict(states[q].next)))
        states[q].link = copy
        while p >= 0 and states[p].next.get(c) == q:
            states[p].next[c] = copy
            p = states[p].link
        return copy

    def stream(self, ids: Iterable[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: the state and length after each word."""
        states, state, length = self.states, 0, 0
        for c in ids:
            while state and c not in states[state].next:
                state = states[state].link
                length = states[state].length
            if c in states[state].next:
                state, length = states[state].next[c], length + 1
            yield state, length

    def scan(self, ids: list[int], offset: int) -> tuple[list[tuple[int, int]], list[tuple]]:
        """Base places (phrase, start) and each template's maximal matches in a run of words.

        Matches are (start, end, template, end in the template).
        """
        base, found = [], []
        for i, (state, length) in enumerate(self.stream(ids)):
            for p in self.states[state].phrases:
                size = len(self.phrases[p][0])
                if length >= size:
                    base.append((p, offset + i + 1 - size))
            following = ids[i + 1 : i + 2]
            for template, at, shared in self.places[state]:
                size = min(length, shared)
                goes_on = following and self.template_ids[template][at : at + 1] == following
                if size >= self.least(template) and not goes_on:
                    found.append((offset + i + 1 - size, offset + i + 1, template, at))
        return base, found

    def chains(self, matches: list[tuple[int, int, int, int]]) -> list[list[Span]]:
        """Chains matches by template: in template order, with at most MAX_GAP words between."""
        by_template: dict[int, set[tuple[int, int, int]]] = {}
        for start, end, template, at in matches:
            by_template.setdefault(template, set()).add((start, end, at))
        return [self._chains(template, self._with_rests(template, sorted(hits))) for template, hits in by_template.items()]

    def _with_rests(self, template: int, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The matches, and of one that begins before another one ends also what stands behind that end."""
        least, rests, before = self.least(template), set(), []
        for start, end, at in hits:
            before = [last for last in before if last > start]
            rests |= {(last, end, at) for last in before if end - last >= least}
            before.append(end)
        return sorted({*hits, *rests})

    def _chains(self, template: int, hits: list[tuple[int, int, int]]) -> list[Span]:
        """For each match that a chain can end with and each start: the most that a chain covers.

        Left out are chains that another one with the same end surpasses, beginning no earlier.
        """
        longest = len(self.templates[template][0])
        fronts: list[dict[int, int]] = []  # per match: start of the chain, words covered
        for j, (start, end, at) in enumerate(hits):
            here = {start: end - start}
            for k in range(j - 1, -1, -1):
                begin, last, was = hits[k]
                if start - begin > MAX_GAP + longest:
                    break
                size = end - max(start, last)
                if start - last <= MAX_GAP and end > last and at > was and size > 0 and at - size >= was:
                    for first, covered in fronts[k].items():
                        here[first] = max(here.get(first, 0), covered + size)
            front, most = {}, 0
            for first in sorted(here, reverse=True):
                if here[first] > most:
                    front[first] = most = here[first]
            fronts.append(front)
        return [Span(template, first, end, n) for (_, end, _), front in zip(hits, fronts) for first, n in front.items()]

    def apart(self, chains: list[Span]) -> list[Span]:
        """Chains of one template that do not overlap, in the order of the text.

        As many as possible that give the label; then by the squares of covered words, so that one long
        chain goes before its pieces.
        """
        found = sorted(chains, key=lambda s: (s.end, -s.start))
        ends = [s.end for s in found]
        best, chosen = [(0, 0)], []
        for i, s in enumerate(found):
            labels, squares = best[bisect_right(ends, s.start, 0, i)]
            value = (labels + (self.cover(s) >= MIN_COVER), squares + s.covered**2)
            chosen.append(value > best[i])
            best.append(max(value, best[i]))
        spans, i = [], len(found)
        while i:
            i -= 1
            if chosen[i]:
                spans.append(found[i])
                i = bisect_right(ends, found[i].start, 0, i)
        return spans[::-1]

    def cover(self, span: Span) -> float:
        return min(1.0, span.covered / len(self.templates[span.template][0]))


def _words(text: str) -> list[bytes]:
    words = split_words(pa.array([text]), ALNUM_LOWER)
    return [words.word(i) for i in range(len(words.start))]


_SCHEMA = pa.schema(
    [
        ("id", pa.int64()),
        ("n_words", pa.int64()),
        ("base", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
        (
            "spans",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()),
                        ("start", pa.int64()),
                        ("end", pa.int64()),
                        ("cover", pa.float64()),
                    ]
                )
            ),
        ),
        ("best", pa.float64()),
    ]
)
_DDL = (
    "id long, n_words long, base array<struct<label:string,start:long>>, "
    "spans array<struct<label:string,start:long,end:long,cover:double>>, best double"
)


def _scanner(automaton: LicenceAutomaton):
    vocabulary = list(automaton.vocabulary)
    known = split_words(pa.array([w.decode() for w in vocabulary]), ALNUM_LOWER).values()
    known = np.sort(known)
    coarse = np.zeros(1 << 16, bool)
    coarse[(known & U64(0xFFFF)).astype(np.int64)] = True

    def per_chunk(chunk: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(chunk.column("text"), ALNUM_LOWER)
        values = words.values()
        maybe = np.flatnonzero(coarse[(values & U64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
        maybe = maybe[known[place] == values[maybe]]
        base: list[list[dict]] = [[] for _ in range(chunk.num_rows)]
        matches: list[list[tuple]] = [[] for _ in range(chunk.num_rows)]
        text_of = np.searchsorted(words.first, maybe, "right") - 1
        new_run = np.flatnonzero((np.diff(maybe, prepend=-2) != 1) | (np.diff(text_of, prepend=-1) != 0))
        sizes = np.diff(new_run, append=len(maybe))
        for at, size in zip(new_run[sizes >= automaton.shortest], sizes[sizes >= automaton.shortest]):
            text, start = int(text_of[at]), int(maybe[at])
            ids = [automaton.vocabulary.get(words.word(i), -1) for i in range(start, start + size)]
            places, found = automaton.scan(ids, start - int(words.first[text]))
            base[text] += [{"label": automaton.phrases[p][1], "start": s} for p, s in places]
            matches[text] += found
        spans, best = [], []
        for found in matches:
            chains = automaton.chains(found)
            best.append(max((automaton.cover(s) for of_one in chains for s in of_one), default=0.0))
            spans.append(
                [
                    {
                        "label": automaton.templates[s.template][1],
                        "start": s.start,
                        "end": s.end,
                        "cover": automaton.cover(s),
                    }
                    for of_one in chains
                    for s in automaton.apart(of_one)
                ]
            )
        return pa.RecordBatch.from_arrays(
            [
                chunk.column("id"),
                pa.array(words.counts, pa.int64()),
                pa.array(base, _SCHEMA.field("base").type),
                pa.array(spans, _SCHEMA.field("spans").type),
                pa.array(best, pa.float64()),
            ],
            schema=_SCHEMA,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            yield per_chunk(chunk)

    return run


def scan_licences(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    phrases: Iterable[tuple[str, str]] = BASE_PHRASES,
    templates: Iterable[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """One row per document: words, base places, all spans of each template, none overlapping another
    of its template, and the largest cover of any chain.
    """
    rows = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    found = rows.mapInArrow(_scanner(LicenceAutomaton(phrases, templates)), _DDL)
    return found.withColumnRenamed("id", id_column)


def licence_labels(scan: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Labels, places and score of ``scan_licences``.

    A base phrase counts as covered in full; a span gives its label from MIN_COVER on. The score
    is the largest cover of any phrase or template, 0 without one. Of chains that overlap, ``spans`` holds
    those that give the most labels, so that a score between two labels' covers may belong to none of them.
    """
    labels = F.transform("base", lambda b: b["label"])
    starts = F.transform("base", lambda b: b["start"])
    kept = F.transform(F.filter("spans", lambda s: s["cover"] >= MIN_COVER), lambda s: s["label"])
    return scan.select(
        id_column,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, kept))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.col("best")).alias("score"),
        "spans",
    )
