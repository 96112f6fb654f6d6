"""Operator 8: license scan by template markup.

A template is wording with markup: ``<<opt>> ... <</opt>>`` may be left out, ``<<var:n>>`` stands for up to n
words of any kind.  Templates compile to token automata: Thompson's construction gives an automaton with
empty moves, the subset construction makes it deterministic (an arc per word, and one for any other
word inside replaceable regions).  A text carries the template's label where the automaton accepts, that
is, where all mandatory wording stands in order and exactly.  The automaton starts wherever the
template's first words stand; the longest accepted stretch counts.

Words are those of the lower-cased text: runs of letters, digits and characters beyond ASCII.

Score: 1 if a template accepts, 0.5 if only a base phrase is found, else 0.

Inputs: null text is the empty text: no words, no labels.  Repeated rows give repeated rows, an empty
table an empty one; extra columns are ignored.  Texts are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailkit.llm.common import map_batches, read_table

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

TEMPLATES = {
    "mit-notice": "<<opt>>released<</opt>><<opt>>licensed<</opt>><<opt>>distributed<</opt>> under the <<opt>>terms of the<</opt>> mit license",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-notice": "<<opt>>this<<var:3>>is<</opt>> licensed under <<opt>>the terms of<</opt>> the gnu general public license <<opt>>as published by the free software foundation either<</opt>> version <<var:1>>",
    "cc-by-nc": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by nc <<opt>>4 0<</opt>><<opt>>3 0<</opt>>",
    "cc-by-sa": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by sa <<opt>>4 0<</opt>><<opt>>3 0<</opt>>",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of <<var:5>> software and associated "
                "documentation files <<var:3>> to deal in the software without restriction <<var:60>> the software is provided as is "
                "without warranty of any kind",
    "apache-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
                   "license <<opt>>you may obtain a copy of the license at <<var:8>><</opt>> unless required by applicable law",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                "following conditions are met",
    "all-rights-reserved": "copyright <<opt>>c<</opt>> <<var:6>> all rights reserved",
}

OTHER = None     # the arc for any word without an arc of its own
MARKUP = re.compile(r"<<(opt|var:\d+|/opt)>>|([^<]+)")


class Automaton:
    """Deterministic token automaton of one template: ``arcs[state]`` maps a word (or OTHER) to a state."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.eps: list[list[int]] = [[]]
        self.moves: list[dict] = [{}]
        end, stack, self.mandatory = 0, [], []
        for m in MARKUP.finditer(template.lower()):
            kind, wording = m.groups()
            if kind == "opt":
                stack.append(end)
            elif kind == "/opt":
                self.eps[stack.pop()].append(end := self._chain(end, None))
            elif kind:
                start, final = end, self._new()
                for _ in range(int(kind[4:])):
                    self.eps[end].append(final)
                    nxt = self._new()
                    self.moves[end][OTHER] = nxt
                    end = nxt
                self.eps[end].append(final)
                end = final if start != final else end
            else:
                for w in word_list(wording):
                    if not stack:
                        self.mandatory.append(w)
                    end = self._chain(end, w)
        if stack:
            raise ValueError(f"open region in template {label}")
        self._determine(end)

    def _new(self) -> int:
        self.eps.append([])
        self.moves.append({})
        return len(self.eps) - 1

    def _chain(self, at: int, word: bytes | None) -> int:
        """A new state after ``at``: by ``word``, or by an empty move."""
        n = self._new()
        if word is None:
            self.eps[at].append(n)
        else:
            self.moves[at][word] = n
        return n

    def _closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for n in self.eps[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def _determine(self, end: int) -> None:
        start = self._closure([0])
        ids, todo, self.arcs, self.accepts = {start: 0}, [start], [], []
        while todo:
            s = todo.pop(0)
            self.accepts.append(end in s)
            other = [self.moves[n][OTHER] for n in s if OTHER in self.moves[n]]
            arcs = {}
            for w in {w for n in s for w in self.moves[n] if w is not OTHER}:
                arcs[w] = self._closure(other + [self.moves[n][w] for n in s if w in self.moves[n]])
            if other:
                arcs[OTHER] = self._closure(other)
            for k, t in arcs.items():
                if t not in ids:
                    ids[t] = len(ids)
                    todo.append(t)
                arcs[k] = ids[t]
            self.arcs.append(arcs)
        self.first = set(self.arcs[0]) - {OTHER}
        del self.eps, self.moves

    def accepted(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted stretch from ``at``; -1 if there is none."""
        state, end = 0, -1
        for i in range(at, len(words)):
            row = self.arcs[state]
            state = row.get(words[i], row.get(OTHER, -1))
            if state < 0:
                break
            if self.accepts[state]:
                end = i + 1
        return end

    def matches(self, words: list[bytes], present: set[bytes]) -> list[tuple[int, int]]:
        """Accepted stretches, leftmost first, none inside another."""
        if not present.issuperset(self.mandatory):
            return []
        out, at = [], 0
        for i, w in enumerate(words):
            if i >= at and w in self.first and (end := self.accepted(words, i)) > 0:
                out.append((i, end))
                at = end
        return out


#: Bytes of the UTF-8 text: ASCII letters to lower case, digits and bytes beyond ASCII as they are, others to a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_list(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TO_WORDS).split()


def base_places(words: list[bytes], present: set[bytes], base: dict[str, str]) -> list[tuple[int, str]]:
    """(word position, label) of every place where a phrase's words stand one after the other."""
    out = []
    for phrase, label in base.items():
        want = phrase.encode().split()
        if present.issuperset(want):
            rare = min(range(len(want)), key=lambda i: words.count(want[i]))
            at = -1
            while True:
                try:
                    at = words.index(want[rare], at + 1)
                except ValueError:
                    break
                if at >= rare and words[at - rare:at - rare + len(want)] == want:
                    out.append((at - rare, label))
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per document: number of words, base places, labels of base phrases and of templates, spans of templates."""
    def run(c):
        automata = [Automaton(k, t) for k, t in templates.items()]
        out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "template_spans")}
        for t in c["text"]:
            words = word_list(t or "")
            present = set(words)
            places = base_places(words, present, base)
            found = [(a, b, x.label) for x in automata for a, b in x.matches(words, present)]
            at, labels = [p for p, _ in places], {k for _, k in places}
            out["n_words"].append(len(words))
            out["n_base"].append(len(places))
            out["first_word"].append(min(at, default=None))
            out["last_word"].append(max(at, default=None))
            out["base_labels"].append(",".join(sorted(labels)))
            out["labels"].append(",".join(sorted(labels | {k for _, _, k in found})))
            out["score"].append(1.0 if found else 0.5 if places else 0.0)
            out["template_spans"].append(",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found)))
        return {"doc_id": c["doc_id"]} | out
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run,
                       "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                       "score double, template_spans string")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
