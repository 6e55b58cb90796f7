"""Licence scans with a generalised suffix automaton of licence tokens.

The templates' tokens form one automaton. A document streams through it, giving for each token
the length of the longest run ending there that occurs in some template (its matching
statistics). Runs of at least MIN_RUN tokens that cannot be extended are matches, at every place of
the template where they stand; for each template, matches whose places in it rise and whose gaps in
the text are at most MAX_GAP tokens are chained so that a chain covers as many template tokens as
possible, so a stray match in between does not break it. Chains of a template do not overlap in the
text; the one of most cover stands. A template's label is set where a chain covers MIN_COVER of it,
or LONG tokens.

Tokens are words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case. Besides,
each place where a base phrase stands counts and sets its label, whatever the chains say. Null
and empty texts have no words, no labels, and score 0. Rows are independent: repeated rows and
null ids get a row each. A worker holds one document's tokens at a time, whole.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import map_rows, per_worker
from tarn.llm.licence_texts import TEMPLATES

MIN_RUN, MAX_GAP, MIN_COVER, LONG = 4, 12, 0.6, 24

# The base phrases with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_TABLE = bytes((c | 32) if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class SuffixAutomaton:
    """All token runs of several sequences; at[state] has (sequence, last index) of every occurrence of runs of MIN_RUN tokens or more."""

    def __init__(self, sequences: list[list[int]]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.long = [-1], [0]
        self.at: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.at[last].add((k, i))
        for state in sorted(range(1, len(self.go)), key=lambda s: -self.long[s]):
            if self.long[self.link[state]] >= MIN_RUN:
                self.at[self.link[state]] |= self.at[state]

    def _new(self, long: int, go: dict[int, int], link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.long.append(long)
        self.at.append(set())
        return len(self.go) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """The state of the runs of q that end in p's longest run and token."""
        if self.long[q] == self.long[p] + 1:
            return q
        twin = self._new(self.long[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.go[p].get(token) == q:
            self.go[p][token] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, token: int) -> int:
        if token in self.go[last]:
            return self._split(last, token, self.go[last][token])
        new, p = self._new(self.long[last] + 1, {}, 0), last
        while p >= 0 and token not in self.go[p]:
            self.go[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token, self.go[p][token])
        return new

    def statistics(self, tokens: list[int]):
        """(length, state) of the longest known run that ends at each token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.go[state]:
                state = self.link[state]
                length = self.long[state]
            if token in self.go[state]:
                state = self.go[state][token]
                length += 1
            yield length, state


class Scanner:
    """The automaton, its vocabulary, and what scan() needs of the templates."""

    def __init__(self, templates: list[tuple[str, str]], base: dict[str, str]):
        self.ids: dict[bytes, int] = {}
        number = lambda text: [self.ids.setdefault(w, len(self.ids)) for w in words(text)]
        self.labels = [label for label, _ in templates]
        sequences = [number(text) for _, text in templates]
        self.sizes = [len(s) for s in sequences]
        self.base = [(np.array(number(p)), label) for p, label in base.items()]
        self.automaton = SuffixAutomaton(sequences)

    def matches(self, tokens: np.ndarray) -> list[tuple[int, int, int]]:
        """(end, length, state) of runs of MIN_RUN tokens or more that no next token extends."""
        known = tokens >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        found = []
        for a, b in edges.reshape(-1, 2)[np.diff(edges)[::2] >= MIN_RUN]:
            before = (0, 0)
            for i, (length, state) in enumerate(self.automaton.statistics(tokens[a:b].tolist()), int(a)):
                if before[0] >= MIN_RUN and length <= before[0]:
                    found.append((i - 1, *before))
                before = (length, state)
            if before[0] >= MIN_RUN:
                found.append((int(b) - 1, *before))
        return found

    def chains(self, tokens: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, covered tokens, first word, last word) of the chains of most cover, by template and place."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in self.matches(tokens):
            for k, last in self.automaton.at[state]:
                by.setdefault(k, []).append((end, end - length + 1, last))
        out = []
        for k, places in sorted(by.items()):
            places.sort()
            cover, before, root = [], [], []
            for m, (end, start, last) in enumerate(places):
                first, best, via = last - (end - start), end - start + 1, -1
                for p in range(m - 1, -1, -1):
                    end_, start_, last_ = places[p]
                    if start - end_ - 1 > MAX_GAP:
                        break
                    # both the text and the template go on; what both matches cover counts once
                    if end_ < end and start_ < start and last_ < last and last_ - (end_ - start_) < first:
                        got = cover[p] + min(end - max(start - 1, end_), last - max(first - 1, last_))
                        if got > best:
                            best, via = got, p
                cover.append(best)
                before.append(via)
                root.append(start if via < 0 else root[via])
            taken: list[tuple[int, int]] = []
            for m in sorted(range(len(places)), key=lambda m: (-cover[m], places[m])):
                span = root[m], places[m][0]
                if all(span[1] < a or span[0] > b for a, b in taken):
                    taken.append(span)
                    out.append((k, cover[m], *span))
        return sorted(out, key=lambda c: (c[0], c[2]))

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first word, last word, cover)."""
        found = words(text)
        tokens = np.fromiter(map(self.ids.get, found, repeat(-1)), np.int32, len(found))
        places, base_labels = [], set()
        for phrase, label in self.base:
            n = len(tokens) - len(phrase) + 1
            if n > 0:
                hit = np.flatnonzero(tokens[:n] == phrase[0])
                for j in range(1, len(phrase)):
                    hit = hit[tokens[hit + j] == phrase[j]]
                if len(hit):
                    places += [len(hit), int(hit[0]), int(hit[-1])]
                    base_labels.add(label)
        labels, spans, score = set(base_labels), [], 0.5 if base_labels else 0.0
        for k, covered, first, last in self.chains(tokens):
            cover = covered / self.sizes[k]
            if cover >= MIN_COVER or covered >= LONG:
                labels.add(self.labels[k])
                score = max(score, min(1.0, cover))
                spans.append((self.labels[k], first, last, cover))
        return (
            len(found),
            sum(places[::3]),
            min(places[1::3], default=None),
            max(places[2::3], default=None),
            ",".join(sorted(base_labels)),
            ",".join(sorted(labels)),
            float(score),
            spans,
        )


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row for each row of docs (doc_id, text); spans list the covered stretches of words."""

    def make():
        scanner = per_worker(("licence", str(templates), str(base)), lambda: Scanner(templates, base))
        return lambda doc_id, text: (doc_id, *scanner.scan(text))

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,cover:double>>"
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)
