"""Operator 10: near-duplicate documents by DartMinHash.

Elements are shingles of five words, weighted by how often they stand in the text; documents are near if their
weighted Jaccard similarity is 0.8 or more.  Element x of weight w owns w unit regions.  Darts fall on each
region by a Poisson process along a rank axis, made from hashes of (region, unit of rank, number), so that
all documents see the same darts.  A document throws the darts below rank T / regions, T = K (ln K + 3), about
T in all; each dart names one of K coordinates, and the earliest dart of a coordinate is its signature value.  If a
coordinate has no dart, the rank bound doubles.  Two documents share a value with probability of their
weighted Jaccard similarity.

Signatures are kept as a byte per coordinate, and BANDS bands of ROWS bytes make the candidates, pairs that share a band's
bucket; a pair at 0.8 shares one with probability over 0.9999.  First every document meets the smallest of each of its
buckets (its hub).  What stands in one bucket but is not of one class by then meets in blocks: of a bucket's classes, all but
the largest ("strangers") meet each other and the largest.  So a pair that shares a bucket is compared or
already of one class; a pair that shares several is compared in the first only.

Blocks are bounded in documents and in regions, and a task holds two.  It compares signatures and drops pairs whose sizes differ
by more than the similarity allows.  Pairs whose signatures agree on at least SURE of the coordinates (0.8 and four standard
errors) are linked; those under UNSURE (0.8 less four) are not.  Of the documents in pairs between, a task returns the
documents, not the pairs; their regions are then read once per block, and the exact similarity decides there.  No step returns pairs:
links are returned only between classes that a task has not joined yet.  Classes are the connected components.

Equal texts are one class from the start and are represented by one text, so copies aren't expanded either.
Texts are told apart by a 64-bit hash.

Inputs: null text is the empty text; texts without words are near to nothing but equal texts; texts of fewer
than five words have one shingle, all their words.  A document with a null id has a class, whose id is the
smallest id in it, null if there is none.  An empty table gives an empty one; extra columns are ignored by ``classes``
and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import e, factorial, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailkit.llm.common import cut, if_small, read_table, record_batch
from retailkit.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
K = BANDS * ROWS
DARTS = K * (log(K) + 3)
ERROR = sqrt(SIMILARITY * (1 - SIMILARITY) / K)
SURE, UNSURE = SIMILARITY + 4 * ERROR, SIMILARITY - 4 * ERROR
POISSON = np.cumsum([1 / (e * factorial(i)) for i in range(20)])
U = np.uint64
STEP = 1 << 19                          # elements handled at once
BLOCK, BLOCK_REGIONS = 1024, 1 << 21    # a block's documents, and its regions unless one document has more
MARKED = 1_000_000                      # ids of documents, of 8 bytes, that are broadcast at most


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0 ** -53


class WordHashes(dict):
    """Word -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def regions(text: str | None, known: WordHashes) -> np.ndarray:
    """The ascending unit regions of a text's weighted shingles: one per shingle and occurrence."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(known.__getitem__, words), U, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    s = np.full(n, len(h[:SHINGLE]), U)
    for i in range(min(SHINGLE, len(h))):
        s = mix(s * U(0x9E3779B97F4A7C15) + h[i:i + n])
    s.sort()
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    if len(first) < n:
        occurrence = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
        s = np.where(occurrence > 0, mix(s + occurrence.astype(U) * U(0xD6E8FEB86659FD93)), s)
        s.sort()
    return s


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Per set, the rank of the earliest dart of each of the K coordinates (infinite for an empty set)."""
    out = np.full((len(sets), K), np.inf)
    size = np.array([len(s) for s in sets])
    bound = np.where(size > 0, DARTS / np.maximum(size, 1), 0.0)
    todo = np.flatnonzero(size > 0)
    while len(todo):
        group: list[int] = []
        total = 0
        for d in todo:
            group.append(d)
            total += size[d] * int(np.ceil(bound[d]))
            if total >= STEP or d == todo[-1]:
                _throw(sets, np.array(group), bound, out)
                group, total = [], 0
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        bound[todo] *= 2
    return out


def _throw(sets: list[np.ndarray], group: np.ndarray, bound: np.ndarray, out: np.ndarray) -> None:
    """The darts of the group's sets below their rank bounds, kept if earliest.  Sets beyond STEP go in parts."""
    parts = [(d, sets[d][i:i + STEP]) for d in group for i in range(0, len(sets[d]), STEP)]
    doc = np.repeat([d for d, _ in parts], [len(s) for _, s in parts])
    region = np.concatenate([s for _, s in parts])
    units = np.ceil(bound[doc]).astype(np.int64)
    at = np.repeat(np.arange(len(region)), units)
    unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    cell = mix(region[at] ^ (unit.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
    n = np.searchsorted(POISSON, uniform(cell))
    hit = np.flatnonzero(n)
    n = n[hit]
    which = np.repeat(hit, n)
    number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    dart = mix(cell[which] + (number.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
    rank = unit[which] + uniform(dart)
    doc = doc[at[which]]
    below = rank < bound[doc]
    coordinate = (mix(dart) % U(K)).astype(np.int64)
    np.minimum.at(out.reshape(-1), (doc * K + coordinate)[below], rank[below])


def band_values(sig: np.ndarray) -> np.ndarray:
    """Each band's bytes with the band's number, as one number: equal if and only if the bytes are."""
    v = sig.reshape(len(sig), BANDS, ROWS).astype(np.int64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.int64), (len(sig), BANDS)).copy()
    for i in range(ROWS):
        out = out << 8 | v[:, :, i]
    return out


SKETCH = "node long, doc_id long, n long, sig binary, bands array<long>"


def slices(column: pa.Array, rows: int = 256, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a text column of at most ``rows`` rows and ``size`` bytes, or of one row."""
    ends, i = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)), 0
    while i < len(column):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right"))
        j = max(i + 1, min(j, i + rows))
        yield i, j
        i = j


def sketches(docs: DataFrame) -> DataFrame:
    """(node, doc_id, n, sig, bands): a text's hash, number of regions, signature (a byte per coordinate) and band values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for i, j in slices(b.column(2)):
                sets = [regions(t, known) for t in b.column(2)[i:j].to_pylist()]
                sig = (mix(signatures(sets).view(U)) >> U(56)).astype(np.uint8)
                bands = band_values(sig).tolist()
                yield record_batch([b.column(0)[i:j], b.column(1)[i:j], [len(x) for x in sets], [x.tobytes() if len(r) else None for x, r in zip(sig, sets)],
                                    [x if len(r) else [] for x, r in zip(bands, sets)]], SKETCH)
    return docs.select("node", "doc_id", "text").mapInArrow(run, SKETCH)


def with_node(docs: DataFrame, name: str = "node") -> DataFrame:
    return docs.withColumn(name, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, first, n): the texts of every bucket of two or more, with its smallest text and its size."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = cut(rows.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    return rows.join(sizes, "bucket").select("bucket", "node", "first", "n")


# ---- what meets: rows (g, i, j, head, node, comp) of group (g, i, j); its heads meet the others, or each other if there are none

GROUP = ["g", "i", "j"]


def blocks_of(n, size):
    """How many blocks documents and regions make."""
    return F.ceil(F.greatest(n / BLOCK, size / BLOCK_REGIONS)).cast("int")


def dealt(node, blocks):
    return F.pmod(F.xxhash64(node), blocks).cast("int")


def star_groups(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every text meets the smallest of each of its buckets."""
    edges = cut(shared.filter(F.col("node") != F.col("first")).select(F.col("first").alias("g"), "node").distinct())
    sizes = cut(edges.join(nodes.select("node", "n"), "node").groupBy("g").agg(F.count("*").alias("c"), F.sum("n").alias("r"))
                .select("g", blocks_of(F.col("c"), F.col("r")).alias("blocks")))
    others = edges.join(sizes, "g").select("g", dealt("node", F.col("blocks")).alias("i"), F.lit(-1).alias("j"), F.lit(False).alias("head"), "node")
    heads = sizes.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(-1).alias("j"), F.lit(True).alias("head"), F.col("g").alias("node"))
    return others.unionByName(heads).withColumn("comp", F.col("node"))


def crowd_groups(shared: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """The texts of a bucket that aren't of one class: strangers meet each other, and those of the bucket's largest class."""
    rest = shared.filter((F.col("n") > 2) & (F.col("node") != F.col("first"))).select("bucket", "node")
    rest = rest.join(comps, "node", "left").join(nodes.select("node", "n"), "node").select(
        F.col("bucket").alias("g"), "node", "n", F.coalesce("comp", "node").alias("comp"))
    rest = cut(rest)
    by_class = rest.groupBy("g", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("r"))
    size = F.struct("c", "r", "comp")
    sizes = by_class.groupBy("g").agg(F.max(size).alias("top"), F.sum("c").alias("c"), F.sum("r").alias("r"), F.count("*").alias("classes")).filter("classes > 1")
    sizes = cut(sizes.select("g", F.col("top.comp").alias("top"), blocks_of(F.col("top.c"), F.col("top.r")).alias("many"),
                             blocks_of(F.col("c") - F.col("top.c"), F.col("r") - F.col("top.r")).alias("few")))
    rows = rest.join(sizes, "g").withColumn("stranger", F.col("comp") != F.col("top"))
    rows = rows.withColumn("own", dealt("node", F.when(F.col("stranger"), F.col("few")).otherwise(F.col("many"))))
    all_of = lambda n: F.sequence(F.lit(0), n - 1)
    # strangers: j = 0.. is the other block of strangers; the largest class: j = -1, -2, ... is its block
    strangers = rows.filter("stranger").withColumn("x", F.explode(F.concat(
        F.transform(all_of(F.col("few")), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), (F.col("own") <= o).alias("head"))),
        F.transform(all_of(F.col("many")), lambda o: F.struct(F.col("own").alias("i"), (-1 - o).alias("j"), F.lit(True).alias("head"))))))
    largest = rows.filter("NOT stranger").withColumn("x", F.explode(
        F.transform(all_of(F.col("few")), lambda o: F.struct(o.alias("i"), (-1 - F.col("own")).alias("j"), F.lit(False).alias("head")))))
    return strangers.unionByName(largest).select("g", "x.i", "x.j", "x.head", "node", "comp")


class Group:
    """A group's documents in memory: heads and others, and the classes joined here so far."""

    def __init__(self, rows: pa.Table, in_bucket: bool):
        head = rows["head"].to_numpy()
        self.inside = not (~head).any()
        self.node, self.n, comp = (rows[c].to_numpy() for c in ("node", "n", "comp"))
        self.sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(-1, K)
        self.heads = np.flatnonzero(head)
        self.others = self.heads if self.inside else np.flatnonzero(~head)
        self.other_sig = np.ascontiguousarray(self.sig[self.others])
        self.classes, self.of = np.unique(comp, return_inverse=True)
        self.up = np.arange(len(self.classes))
        self.band = int(rows["g"][0].as_py() >> 8 * ROWS) if in_bucket else 0

    def tops(self, rows: np.ndarray) -> np.ndarray:
        c = self.of[rows]
        while (self.up[c] != c).any():
            c = self.up[c]
        return c

    def candidates(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(head, others, shares): pairs of different classes that can be near and meet in no earlier band."""
        for at, x in enumerate(self.heads):
            to, sigs = (self.others[at + 1:], self.other_sig[at + 1:]) if self.inside else (self.others, self.other_sig)
            equal = sigs == self.sig[x]
            count = (equal.view(U).sum(axis=1, dtype=U) * U(0x0101010101010101)) >> U(56)          # eight counters of a byte each
            share = (count / K - 1 / 256) / (1 - 1 / 256)
            fits = np.minimum(self.n[x], self.n[to]) >= SIMILARITY * np.maximum(self.n[x], self.n[to])
            near = np.flatnonzero((share >= UNSURE) & fits)
            if self.band and len(near):
                near = near[~equal[near][:, :self.band * ROWS].reshape(len(near), self.band, ROWS).all(axis=2).any(axis=1)]
            near = near[self.tops(to[near]) != self.tops(np.array([x]))[0]]
            if len(near):
                yield int(x), to[near], share[near]

    def link(self, x: int, others: np.ndarray) -> list[tuple[int, int]]:
        """Joins the classes of ``others`` with that of x; a link for each that wasn't."""
        out = []
        tops, first = np.unique(self.tops(others), return_index=True)
        for t, i in zip(tops, first):
            mine = self.tops(np.array([x]))[0]
            if t != mine:
                self.up[t] = mine
                out.append((int(self.node[x]), int(self.node[others[i]])))
        return out


LINKS = "a long, b long"
MARKS = "g long, i int, j int, head boolean, node long, a long, b long"


def judge_by_signature(group: Group, key: tuple) -> list[tuple]:
    """MARKS: links (a, b) of sure pairs, and the documents of unsure pairs between classes that stay apart."""
    links, unsure = [], []
    for x, others, share in group.candidates():
        links += group.link(x, others[share >= SURE])
        unsure.append((x, others[share < SURE]))
    marked: set[tuple[bool, int]] = set()
    for x, others in unsure:
        others = others[group.tops(others) != group.tops(np.array([x]))[0]]
        if len(others):
            marked.add((True, x))
            marked.update((group.inside, int(y)) for y in others)
    none = (None,) * 5
    return [(*none, a, b) for a, b in links] + [(*key, head, int(group.node[x]), None, None) for head, x in sorted(marked)]


def judge_exactly(group: Group, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """LINKS by the exact similarity of unsure pairs between classes that are still apart."""
    # the others' documents by region: what a head has in common with all of them is one count over its regions
    region = np.concatenate([sets[y] for y in group.others])
    owner = np.repeat(np.arange(len(group.others)), [len(sets[y]) for y in group.others])
    order = np.argsort(region, kind="stable")
    region, owner = region[order], owner[order]
    place = {int(y): k for k, y in enumerate(group.others)}
    links = []
    for x, others, _ in group.candidates():
        lo, hi = np.searchsorted(region, sets[x], "left"), np.searchsorted(region, sets[x], "right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        both = np.bincount(owner[at], minlength=len(group.others))[[place[int(y)] for y in others]]
        near = both >= SIMILARITY * (group.n[x] + group.n[others] - both)
        links += group.link(x, others[near])
    return links


def per_group(rows: DataFrame, schema: str, in_bucket: bool, fn) -> DataFrame:
    """``fn(key, rows as an Arrow table)`` for each group, one in memory at a time."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            if t.num_rows > 1 and (out := fn(key, Group(t, in_bucket), t)):
                yield record_batch([list(c) for c in zip(*out)], schema)
        held, at = [], None
        for b in batches:
            if not b.num_rows:
                continue
            b = pa.RecordBatch.from_arrays(b.columns, names=names)
            keys = np.stack([b.column(c).to_numpy() for c in range(3)])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            for s, e_ in zip(starts, np.r_[starts[1:], b.num_rows]):
                key = tuple(int(k) for k in keys[:, s])
                if key != at and held:
                    yield from done(at, held)
                    held = []
                at = key
                held.append(b.slice(s, e_ - s))
        if held:
            yield from done(at, held)

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, schema)


def region_sets(marked: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, regions) of the marked nodes, from the text of one row of each."""
    wanted = if_small(marked.select("node").distinct().join(reps, "node"), MARKED)
    same = (docs["node"] == wanted["node"]) & docs["doc_id"].eqNullSafe(wanted["rep"])
    texts = docs.join(wanted, same, "left_semi").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for i, j in slices(b.column(1)):
                yield record_batch([b.column(0)[i:j], [regions(t, known).tobytes() for t in b.column(1)[i:j].to_pylist()]], "node long, regions binary")
    return cut(texts.mapInArrow(run, "node long, regions binary").dropDuplicates(["node"]))


def judged(groups: DataFrame, nodes: DataFrame, comps: DataFrame, docs: DataFrame, reps: DataFrame, in_bucket: bool) -> DataFrame:
    """``comps`` joined by the links of what meets in ``groups``."""
    sigs = nodes.select("node", "n", "sig")
    rows = groups.join(sigs, "node").select(*GROUP, "head", "node", "comp", "n", "sig")
    found = cut(per_group(rows, MARKS, in_bucket, lambda key, group, t: judge_by_signature(group, key)))
    comps = merged(comps, found.filter("a IS NOT NULL").select("a", "b"))
    marked = found.filter("a IS NULL").select(*GROUP, "head", "node")
    if marked.isEmpty():
        return comps
    rows = marked.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    apart = rows.groupBy(*GROUP).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select(*GROUP)
    rows = cut(rows.join(apart, GROUP))
    if rows.isEmpty():
        return comps
    rows = rows.join(sigs, "node").join(region_sets(rows, docs, reps), "node").select(*GROUP, "head", "node", "comp", "n", "sig", "regions")

    def exactly(key, group, t):
        return judge_exactly(group, [np.frombuffer(r, U) for r in t["regions"].to_pylist()])
    return merged(comps, per_group(rows, LINKS, in_bucket, exactly))


def relabel(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """``edges`` with columns ca, cb: the components of a and b, or a and b themselves."""
    for side in ("a", "b"):
        c = comps.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
        edges = edges.join(c, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return edges


def merged(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after the classes at the ends (a, b) of ``edges`` are joined."""
    edges = cut(relabel(edges, comps).filter(F.col("ca") != F.col("cb")).select("ca", "cb").distinct())
    if edges.isEmpty():
        return comps
    more = components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    alone = edges.select(F.explode(F.array("ca", "cb")).alias("node")).distinct().join(comps, "node", "left_anti").withColumn("comp", F.col("node"))
    return cut(comps.unionByName(alone).join(more, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, node) of every document, (node, comp) of every text linked to another); ``docs``: doc_id, node, text."""
    drawn = cut(sketches(docs))
    members = drawn.select("doc_id", "node")
    reps = drawn.groupBy("node").agg(F.min("doc_id").alias("rep"))
    nodes = cut(drawn.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    shared = cut(shared_buckets(nodes))
    none = docs.sparkSession.createDataFrame([], "node long, comp long")
    comps = judged(star_groups(shared, nodes), nodes, none, docs, reps, False)
    return members, judged(crowd_groups(shared, nodes, comps), nodes, comps, docs, reps, True)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, class_id, kept): a row per document; class_id is the smallest doc_id of its class."""
    docs = with_node(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    members, linked = text_classes(docs)
    of_text = members.groupBy("node").agg(F.min("doc_id").alias("low")).join(linked, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_text = cut(of_text)
    ids = of_text.groupBy("comp").agg(F.min("low").alias("class_id"), F.min(F.struct(F.col("low").isNull(), "low", "node")).alias("kept"))
    found = of_text.join(ids, "comp").select("node", "class_id", F.col("kept.node").alias("kept_node"))
    out = members.join(found, "node")
    return out.select("doc_id", "node", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("kept_node"))).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all its columns; of repeated rows, one."""
    names = docs.columns
    node, doc = (_free(names, n) for n in ("node", "kept_id"))
    keep = classes(docs).filter("kept").select(F.col("node").alias(node + "_"), F.col("doc_id").alias(doc)).distinct()
    rows = with_node(docs, node)
    kept = rows.join(keep, (rows[node] == keep[node + "_"]) & rows["doc_id"].eqNullSafe(keep[doc]), "left_semi")
    return kept.dropDuplicates([node, "doc_id"]).select(*names)


def _free(names: list[str], name: str) -> str:
    while name in names or name + "_" in names:
        name = "_" + name
    return name


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
