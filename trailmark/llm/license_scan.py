"""License scans by template markup.

A template is the wording of a licence with regions marked up: ``<<optional>> ... <</optional>>`` may be absent,
``<<one:a|b>>`` is replaceable by its alternatives, and ``<<any:N>>`` stands for up to N words of anybody's choosing (a
holder, a year).  Everything else is mandatory and must match word for word.  A template compiles to an automaton over words whose states are places in the template;
a text is accepted where a run of its words leads from the first place to the last.  Runs start only where a
mandatory first word stands, so a text without one costs a look-up per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from trailmark.llm.common import LOWER, UPPER, id_texts
from trailmark.llm.license_texts import TEMPLATES

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = str.maketrans(UPPER, LOWER)

# The phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(_FOLD) if text and not text.isascii() else (text or "").lower())


@dataclass
class Automaton:
    """States are numbers; ``step`` has word edges, ``anyway`` edges for any word, ``free`` edges without one."""

    step: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])
    anyway: list[list[int]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    last: int = 0

    def new(self) -> int:
        self.step.append({})
        self.anyway.append([])
        self.free.append([])
        return len(self.step) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, found = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return found

    def starts(self) -> set[str]:
        return {w for s in self.closure({0}) for w in self.step[s]}

    def run(self, words: list[str], at: int) -> int:
        """Where the longest accepted run from ``at`` ends, or -1."""
        states, end = self.closure({0}), -1
        while states:
            if self.last in states:
                end = at
            if at >= len(words):
                break
            states = self.closure({y for s in states for y in (*self.step[s].get(words[at], ()), *self.anyway[s])})
            at += 1
        return end


def compile_template(markup: str) -> Automaton:
    """``<<optional>>`` regions nest; ``<<one:a|b>>`` and ``<<any:N>>`` (0 to N words) don't; the rest is cut into words like a text."""
    made = Automaton()
    here, opened = 0, []
    for token in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if token == "<<optional>>":
            opened.append(here)
            here = (made.free[here].append(x := made.new()), x)[1]
        elif token == "<</optional>>":
            end = made.new()
            made.free[here].append(end)
            made.free[opened.pop()].append(end)
            here = end
        elif token.startswith("<<one:"):
            end = made.new()
            for alternative in token[6:-2].split("|"):
                at = here
                for word in words_of(alternative):
                    made.step[at].setdefault(word, []).append(nxt := made.new())
                    at = nxt
                made.free[at].append(end)
            here = end
        elif token.startswith("<<any:"):
            places = [here] + [made.new() for _ in range(int(token[6:-2]))]
            end = made.new()
            for x, y in zip(places, places[1:], strict=False):
                made.anyway[x].append(y)
            for x in places:
                made.free[x].append(end)
            here = end
        elif token.startswith("<<"):
            raise ValueError(f"unknown markup {token}")
        else:
            for word in words_of(token):
                nxt = made.new()
                made.step[here].setdefault(word, []).append(nxt)
                here = nxt
    if opened:
        raise ValueError("an optional region isn't closed")
    made.last = here
    if made.last in made.closure({0}):
        raise ValueError("a template without mandatory wording accepts every text")
    if any(made.anyway[s] for s in made.closure({0})):
        raise ValueError("a template starts with wording, not with any words")
    return made


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(label, words_of(phrase)) for phrase, label in phrases.items()]
        self.finals: dict[str, list[tuple[str, list[str]]]] = {}
        for label, phrase in self.phrases:
            self.finals.setdefault(phrase[-1], []).append((label, phrase))
        self.automata = {label: compile_template(t) for label, t in templates.items()}
        self.starts: dict[str, list[str]] = {}
        for label, made in self.automata.items():
            for word in made.starts():
                self.starts.setdefault(word, []).append(label)
        #: Every phrase and template needs one of these somewhere: texts without any are done after counting words.
        self.needed = [next(w for w in sorted(p, key=len, reverse=True)) for _, p in self.phrases] + [max(self._mandatory(t), key=len) for t in templates.values()]

    @staticmethod
    def _mandatory(markup: str) -> list[str]:
        plain = re.sub(r"<<(any|one):[^>]*>>", " ", markup)
        while (less := re.sub(r"<<optional>>((?!<<).)*<</optional>>", " ", plain)) != plain:
            plain = less
        return words_of(plain)

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        present = set(words)
        if not any(w in present for w in self.needed):
            return len(words), 0, None, None, "", "", 0.0
        places, base = [], set()
        for at, word in enumerate(words):
            for label, phrase in self.finals.get(word, ()):
                begin = at - len(phrase) + 1
                if begin >= 0 and words[begin : at + 1] == phrase:
                    places.append(begin)
                    base.add(label)
        spans: list[tuple[int, int, str]] = []
        for at, word in enumerate(words):
            for label in self.starts.get(word, ()):
                end = self.automata[label].run(words, at)
                if end > 0:
                    spans.append((at, end, label))
        covered, upto = 0, 0
        for begin, end, _ in sorted(spans):
            covered += max(0, end - max(begin, upto))
            upto = max(upto, end)
        labels = base | {label for _, _, label in spans}
        score = max(covered / len(words), 0.5 if base else 0.0) if labels else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the share of the words that accepted runs cover, at least one half where a base phrase stands.
    Null and empty texts have no words, no labels and score 0.  Texts are read whole, repeated rows each give
    their row, an empty table none; only id and text are read.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = [(doc, *scanner.scan(text)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return id_texts(docs).mapInArrow(scan, SCHEMA)
