"""Operator 13: spelling variants by composition of finite automata.

Words that differ by exactly one inserted, deleted or replaced code point are near.  The near pairs are what the
composition of the vocabulary's acceptor, the one-edit transducer and the acceptor again accepts.  A state of the composed
machine is (q, edits left, r).  It is enumerated per partition of its initial states: the state that a
key leads to.  For words of 2h to 2h + 2 code points, the keys are the first h and the last h code points (read backwards): the
edit of a pair whose shorter word has 2h or 2h + 1 code points lies behind the first h or before the last h, so every pair is
accepted in the partition of a common key; behind the first h, if it could be either.  A partition of more than
LIMIT words moves on by one label, in Spark: to the states (q', 1, q') after a common label, and, the edit spent, to (q', 0, r'),
whose partitions are the remaining text (at most one word per label and one without).  So a task never holds more than
LIMIT words, whatever a key's share.

In a partition, the acceptor of the remaining texts is minimised (states with equal right languages are one), states number their words
in order, and the words that two states accept in common are computed once per pair of states.  No pairs leave a task: it
returns, for each word, the number of its near words there and the most frequent of them.

``group_variants`` then takes as a word's form its near word of largest n if that is at least RATIO times the word's own n (ties: the
smallest in code-point order), and follows forms to the last by pointer doubling.

Words of ``count_words`` are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, lower-cased in A-Z only.  If 97 divides the crc32 of
``<doc_id>:<run>``, one code point (number crc32 modulo the length) is left out, as the contract of the query says.

Inputs: null text has no words; a null doc_id is the empty string in the crc32.  Repeated rows count as often as they stand.  An
empty table gives an empty result; extra columns are ignored.  Texts are read whole; counts are combined in a task first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailkit.llm.common import cut, read_table, record_batch

LIMIT = 20_000            # words of a partition
SHORTEST, LEAST, RATIO, EDITED = 5, 3, 2, 97
RUN = re.compile("[A-Za-zÀ-ÿ]+")
HELD_WORDS = 200_000      # distinct words that a task counts before it passes the counts on


# ---- vocabulary

def runs(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text, altered runs included."""
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")     # bytes: A-Z only
    for run, n in Counter(RUN.findall(lowered)).items():
        h = zlib.crc32(run.encode(), start)
        if not h % EDITED:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        yield run, n


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): words of SHORTEST code points or more that occur LEAST times or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, n in runs(doc_id, text):
                    if len(w) >= SHORTEST:
                        held[w] += n
                if len(held) >= HELD_WORDS:
                    yield record_batch([list(held), list(held.values())], "word string, n long")
                    held.clear()
        if held:
            yield record_batch([list(held), list(held.values())], "word string, n long")

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


# ---- the acceptor of a partition

class Acceptor:
    """The minimal acyclic acceptor of ascending distinct texts.  ``arcs[q]`` maps labels to states in order,
    ``size[q]`` counts the texts that q accepts; texts are numbered in order along a path."""

    def __init__(self, texts: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self.known: dict[tuple, int] = {}
        self.both: dict[tuple[int, int], list[tuple[int, int]]] = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]             # the open states of the last text
        last = ""
        for t in texts:
            same = 0
            while same < len(last) and same < len(t) and last[same] == t[same]:
                same += 1
            self._close(path, last, same)
            for _ in range(len(t) - same):
                path.append(({}, False))
            path[-1] = (path[-1][0], True)
            last = t
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, last: str, down_to: int) -> None:
        while len(path) - 1 > down_to:
            arcs, final = path.pop()
            path[-1][0][last[len(path) - 1]] = self._state(arcs, final)

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        k = (final, *arcs.items())
        q = self.known.get(k)
        if q is None:
            q = self.known[k] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.size.append(final + sum(self.size[r] for r in arcs.values()))
        return q

    def offsets(self, q: int) -> dict[str, int]:
        """Per label, how many texts of q come before those behind the label."""
        out, at = {}, int(self.final[q])
        for c, r in self.arcs[q].items():
            out[c] = at
            at += self.size[r]
        return out

    def common(self, q: int, r: int) -> list[tuple[int, int]]:
        """Numbers (in q, in r) of the texts that both accept: the states (q, 0, r) and what follows."""
        if q == r:
            return [(i, i) for i in range(self.size[q])]
        if not (self.arcs[q].keys() & self.arcs[r].keys()):
            return [(0, 0)] if self.final[q] and self.final[r] else []
        low, high = (q, r) if q < r else (r, q)
        if (low, high) not in self.both:
            self._meet(low, high)
        found = self.both[low, high]
        return found if q < r else [(j, i) for i, j in found]

    def _meet(self, q: int, r: int) -> None:
        """Fills ``both`` for (q, r), what follows first; a loop, as texts may be long."""
        todo = [(q, r)]
        while todo:
            q, r = todo[-1]
            a, b = self.arcs[q], self.arcs[r]
            labels = a.keys() & b.keys()
            open_ = [k for k in ((min(a[c], b[c]), max(a[c], b[c])) for c in labels)
                     if k[0] != k[1] and k not in self.both and self.arcs[k[0]].keys() & self.arcs[k[1]].keys()]
            if open_ and (q, r) not in self.both:
                todo += open_
                continue
            todo.pop()
            if (q, r) not in self.both:
                found = [(0, 0)] if self.final[q] and self.final[r] else []
                at, to = self.offsets(q), self.offsets(r)
                for c in labels:
                    i, j = at[c], to[c]
                    found += [(i + x, j + y) for x, y in self.common(a[c], b[c])]
                self.both[q, r] = found

    def edits(self, q: int) -> list[tuple[int, int]]:
        """Numbers of the texts of q that differ by one edit at this state: another label, or a label that only one
        has.  A label is inserted where the other text goes on differently, so a pair has one place."""
        arcs, at = self.arcs[q], self.offsets(q)
        out: list[tuple[int, int]] = []
        labels = list(arcs)
        for n, b in enumerate(labels):
            j, r = at[b], arcs[b]
            for a in labels[:n]:
                i = at[a]
                out += [(i + x, j + y) for x, y in self.common(arcs[a], r)]
            if self.final[q] and self.final[r]:
                out.append((0, j))
            for c in arcs.keys() & self.arcs[r].keys():
                if c != b:
                    i, k = at[c], self.offsets(r)[c]
                    out += [(i + x, j + k + y) for x, y in self.common(arcs[c], self.arcs[r][c])]
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pairs of texts one edit apart: (q, 1, q) along every path, then the edit."""
        visits: dict[int, list[int]] = {}
        todo = [(self.start, 0)]
        while todo:
            q, base = todo.pop()
            if self.arcs[q]:
                visits.setdefault(q, []).append(base)
                at = self.offsets(q)
                todo += [(r, base + at[c]) for c, r in self.arcs[q].items()]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, bases in visits.items():
            if near := self.edits(q):
                near = np.array(near, np.int64)
                base = np.array(bases, np.int64)[:, None]
                left.append((base + near[:, 0]).ravel())
                right.append((base + near[:, 1]).ravel())
        return np.concatenate(left), np.concatenate(right)


# ---- partitions of the initial states

ROWS = "back boolean, h int, key string, rest string, word string, n long"
FOUND = "word string, n_near long, form_n long, form string"


def initial_states(words: DataFrame) -> DataFrame:
    """ROWS: every word under the first and the last h code points for the h of its length."""
    half, length = F.floor(F.char_length("word") / 2).cast("int"), F.char_length("word")
    h = F.explode(F.when(length % 2 == 0, F.filter(F.array(half, half - 1), lambda x: x >= 0)).otherwise(F.array(half))).alias("h")
    rows = words.select("word", "n", h).select("word", "n", "h", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    rows = rows.withColumn("read", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    return rows.selectExpr("back", "h", "substr(read, 1, h) AS key", "substr(read, h + 1) AS rest", "word", "n")


def near_in(back: bool, h: int, words: list[str], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> list | None:
    """FOUND of the pairs (left, right) of numbers of ``words`` that this partition is to return."""
    size = np.array([len(w) for w in words])
    keep = np.minimum(size[left], size[right]) < 2 * h + 2
    if back:
        code: dict[str, int] = {}
        first = np.array([code.setdefault(w[:h], len(code)) for w in words])
        keep &= first[left] != first[right]
    a, b = np.r_[left[keep], right[keep]], np.r_[right[keep], left[keep]]
    if not len(a):
        return None
    order = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    best, count = np.full(len(words), len(words)), np.bincount(a, minlength=len(words))
    np.minimum.at(best, a, place[b])
    at = np.flatnonzero(count)
    form = order[best[at]]
    return [[words[i] for i in at], count[at], n[form], [words[i] for i in form]]


def composed(words: list[str], rest: list[str], n: np.ndarray, back: bool, h: int) -> list | None:
    """FOUND of a partition (q, 1, q)."""
    order = sorted(range(len(words)), key=rest.__getitem__)
    left, right = Acceptor([rest[i] for i in order]).pairs()
    return near_in(back, h, [words[i] for i in order], n[order], left, right)


def spent(words: list[str], label: list[str | None], rest: str, n: np.ndarray, back: bool, h: int) -> list | None:
    """FOUND of a partition (q, 0, r): its texts are equal from here; ``label`` is what was read before, if anything."""
    pairs = [(i, j) for j, b in enumerate(label) if b is not None for i, a in enumerate(label)
             if (a < b if a is not None else b != rest[:1])]
    left, right = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    return near_in(back, h, words, n, left, right)


def per_partition(rows: DataFrame, keys: list[str], fn) -> DataFrame:
    """``fn(key values, columns of the partition)`` for each partition of equal keys, one in memory at a time."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        def done():
            out = fn(at, held) if at is not None and len(held["word"]) > 1 else None
            return [] if out is None else [record_batch(out, FOUND)]
        for b in batches:
            cols = {c: b.column(i).to_pylist() for i, c in enumerate(names)}
            for i, key in enumerate(zip(*(cols[k] for k in keys))):
                if key != at:
                    yield from done()
                    at, held = key, {c: [] for c in names if c not in keys}
                for c in held:
                    held[c].append(cols[c][i])
        yield from done()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, FOUND)


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n) that have a near word; form is the one of largest n."""
    rows, state, found = initial_states(words), ["back", "h", "key"], []
    while True:
        over = cut(rows.groupBy(*state).count().filter(F.col("count") > limit).select(*state))
        if over.isEmpty():
            break
        big = cut(rows.join(over, state))
        step = big.selectExpr("back", "h", "key", "substr(rest, 1, 1) AS label", "substr(rest, 2) AS rest", "word", "n", "rest AS whole").filter("whole <> ''")
        after = big.selectExpr("back", "h", "key", "CAST(NULL AS string) AS label", "rest", "word", "n").unionByName(step.drop("whole"))
        found.append(per_partition(after, [*state, "rest"], lambda k, c: spent(c["word"], c["label"], k[3], np.array(c["n"]), k[0], k[1])))
        deeper = step.selectExpr("back", "h", "concat(key, label) AS key", "rest", "word", "n")
        rows = cut(rows.join(over, state, "left_anti").unionByName(deeper))
    found.append(per_partition(rows, state, lambda k, c: composed(c["word"], c["rest"], np.array(c["n"]), k[0], k[1])))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    out = every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return out.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


# ---- groups

def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms of every word that has one; pointers double in length every round."""
    at = cut(forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def group_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    words = cut(words)
    fits = F.col("form_n") >= RATIO * F.col("n")
    forms = cut(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(read_table(spark, sf_dir, "documents")))
