"""Operator 7: quality rules with an n-gram perplexity model.

The model: modified Kneser-Ney over bytes of the UTF-8 text, one per language, order 4.  Spark counts the
4-grams of every document; lower orders count the distinct bytes seen before (continuation counts); the
three discounts of an order come from its counts of counts.  Each order is an interpolation with the next
lower one, the lowest with 1/256.  The model keeps every n-gram of every language: for each order, ascending
keys (language, n-gram) with log2 probabilities, and log2 back-off weights by context, 12 bytes an entry.
Spark sorts them, the driver writes them to two files, a piece at a time, and the tasks of an executor map these
files into memory together.  So its size costs disk, and the driver holds no more than a piece and the
names of the languages; the files have a few megabytes for alphabets as they are.

The rules: a document's bits per character and bits per word (log2 of its perplexities) must lie in its
language's band: median -+ WIDTH robust standard deviations (interquartile range / 1.349) of the language's
documents that pass the base rule.  For documents of fewer than TYPICAL_WORDS words the band widens by
sqrt(TYPICAL_WORDS / words), as the mean of fewer words scatters more.  Quartiles are exact over bins of
1/1000 bit.  A language with fewer than MIN_DOCS such documents has no band and rejects nothing by it.

Inputs: null text is the empty text (no words, fails the base rule); a null language is the language "".
Repeated rows are judged alike and count as often as they stand.  An empty table gives an empty one.  Texts
are read whole, in segments of bounded size; extra columns are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailkit.llm.common import cut, if_small, read_table, record_batch

ORDER, SEGMENT = 4, 1 << 20
WIDTH, TYPICAL_WORDS, MIN_DOCS, SIGMA_FLOOR = 5.0, 300, 30, 0.01
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\r\x0b\x0c"


# ---- base rule

def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that stand twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, marked = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if times[w] > 1:
            marked[i:i + 3] = b"\1\1\1"
    return sum(marked)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeat_words(words)


# ---- n-grams of bytes

def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, owners, lengths): bodies of bounded total size, each after ORDER - 1 bytes of what precedes it."""
    pad = b"\n" * (ORDER - 1)
    parts, owners, lengths, size = [], [], [], 0
    for i, t in enumerate(texts):
        t = pad + t
        for at in range(0, len(t) - ORDER + 1, SEGMENT):
            part = t[at:at + SEGMENT + ORDER - 1]
            parts.append(part)
            owners.append(i)
            lengths.append(len(part) - ORDER + 1)
            size += len(part)
            if size >= SEGMENT:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(owners), np.array(lengths)
                parts, owners, lengths, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(owners), np.array(lengths)


def windows(raw: np.ndarray) -> np.ndarray:
    """ORDER-byte windows as numbers, the last byte lowest."""
    a = raw.astype(np.uint32)
    n = len(a) - ORDER + 1
    out = a[:n] << np.uint32(24)
    for i, shift in ((1, 16), (2, 8)):
        out |= a[i:n + i] << np.uint32(shift)
    return out | a[3:n + 3]


def bounds(lengths: np.ndarray) -> np.ndarray:
    """Start and end of every segment's own windows, in turn."""
    starts = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    return np.stack([starts, starts + lengths], axis=1).ravel()


def run_lengths(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
    else:
        o = np.argsort(keys, kind="stable")
        keys, counts = keys[o], counts[o]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)]) if counts is None else np.add.reduceat(counts, first)


COUNTS = "lang string, key long, c long"


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, key, c): how often each ORDER-byte window stands in the language's documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    by_lang.setdefault(lang or "", []).append(text.encode("utf-8", "replace"))
            for lang, texts in by_lang.items():
                new = held.setdefault(lang, [])
                for raw, _, lengths in segments(texts):
                    own = np.ones(len(raw) - ORDER + 1, bool)
                    ends = bounds(lengths)[1::2]
                    for i in range(ORDER - 1):
                        own[(ends + i)[ends + i < len(own)]] = False
                    new.append(run_lengths(windows(raw)[own]))
                    if len(new) >= 16:
                        new[:] = [run_lengths(*map(np.concatenate, zip(*new)))]
        for lang, parts in held.items():
            keys, counts = run_lengths(*map(np.concatenate, zip(*parts)))
            for i in range(0, len(keys), 100_000):
                k = keys[i:i + 100_000].astype(np.int64)
                yield record_batch([[lang] * len(k), k, counts[i:i + 100_000].astype(np.int64)], COUNTS)

    counted = docs.select("lang", "text").mapInArrow(run, COUNTS)
    return counted.groupBy("lang", "key").agg(F.sum("c").alias("c"))


# ---- the model

def kneser_ney(counts: DataFrame) -> DataFrame:
    """(kind, n, lang, key, value): log2 probabilities (p) of n-grams and log2 back-off weights (g) of their contexts."""
    orders = {ORDER: cut(counts)}
    for n in range(ORDER - 1, 0, -1):
        mask = (1 << 8 * n) - 1
        orders[n] = orders[n + 1].groupBy("lang", F.col("key").bitwiseAND(mask).alias("key")).agg(F.count("*").alias("c"))
    out, lower = None, None
    for n in range(1, ORDER + 1):
        t = orders[n]
        def one(i, c="c"):
            return F.sum((F.col(c) == i).cast("long"))
        s = t.groupBy("lang").agg(*[one(i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        def discount(i):
            d = F.when((F.col("n1") + 2 * F.col("n2") > 0) & (F.col(f"n{i}") > 0),
                       i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(0.0)
            return F.least(F.greatest(d, F.lit(0.05)), F.lit(i - 0.001))
        s = if_small(s.select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)]))
        t = t.join(s, "lang").select("lang", "key", "c", F.shiftright("key", 8).alias("ctx"),
                                     F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
        w = Window.partitionBy("lang", "ctx")
        t = t.withColumn("total", F.sum("c").over(w)).withColumn("g", F.sum("d").over(w) / F.col("total"))
        t = t.withColumn("own", (F.col("c") - F.col("d")) / F.col("total"))
        if lower is None:
            t = t.withColumn("p", F.col("own") + F.col("g") / 256)
        else:
            low = lower.select(F.col("lang").alias("l"), F.col("key").alias("suffix"), F.col("p").alias("below"))
            t = t.join(low, (t.lang == low.l) & (t.key.bitwiseAND((1 << 8 * (n - 1)) - 1) == low.suffix)).withColumn("p", F.col("own") + F.col("g") * F.col("below"))
        lower = cut(t.select("lang", "key", "ctx", "p", "g"))
        rows = lower.select(F.lit("p").alias("kind"), F.lit(n).alias("n"), "lang", "key", F.log2("p").alias("value")).unionByName(
            lower.groupBy("lang", "ctx").agg(F.max("g").alias("g")).select(F.lit("g").alias("kind"), F.lit(n).alias("n"), "lang", F.col("ctx").alias("key"),
                                                                         F.log2("g").alias("value")))
        out = rows if out is None else out.unionByName(rows)
    return out


class Mapped:
    """The entries ``at`` to ``end`` of a file that was added to the SparkContext, as a read-only array where it is used."""

    def __init__(self, name: str, kind: str, at: int, end: int):
        self.name, self.kind, self.at, self.end = name, np.dtype(kind), at, end

    def array(self) -> np.ndarray:
        found = np.memmap(SparkFiles.get(self.name), self.kind, "r", self.at * self.kind.itemsize, self.end - self.at)
        return found.view(np.ndarray)


def opened(model: dict) -> dict:
    return {k: tuple(x.array() if isinstance(x, Mapped) else x for x in v) if isinstance(v, tuple) else v for k, v in model.items()}


def sorted_arrays(rows: DataFrame) -> dict:
    """{(kind, n): (ascending keys, values)} and {"langs": numbers of the languages}; a key is a language's number before an n-gram.

    Spark sorts the entries, and tasks pack them to bytes, 8 an entry, for the driver, which appends them to the files piece by piece."""
    packed_schema = "part int, lang string, keys binary, numbers binary"     # part: n of probabilities, -n of back-off weights

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            part, key, value = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            lang = b.column(1).dictionary_encode()
            code = lang.indices.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (code[1:] != code[:-1])])
            ends = np.r_[at[1:], len(part)]
            yield record_batch([part[at].tolist(), [lang.dictionary[int(c)].as_py() for c in code[at]],
                                [key[i:j].astype("<u4").tobytes() for i, j in zip(at, ends)], [value[i:j].astype("<f4").tobytes() for i, j in zip(at, ends)]], packed_schema)

    spark = rows.sparkSession
    part = F.when(F.col("kind") == "p", F.col("n")).otherwise(-F.col("n")).cast("int").alias("part")
    ordered = rows.select(part, "lang", "key", "value").orderBy("part", "lang", "key")
    name = f"quality-{uuid.uuid4().hex}"
    paths = [f"{SparkFiles.getRootDirectory()}/{name}.{x}" for x in ("keys", "values")]      # executors fetch them from here; Spark removes the folder when it stops
    langs: dict[str, int] = {}              # in the order of the sort, the same in every part, as a language has n-grams of all orders
    ends: dict[int, list[int]] = {}
    size = 0
    with open(paths[0], "wb") as keys, open(paths[1], "wb") as values:
        for r in ordered.mapInArrow(packed, packed_schema).toLocalIterator():
            k = np.frombuffer(r.keys, "<u4").astype("<u8") | np.uint64(langs.setdefault(r.lang, len(langs)) << 32)
            keys.write(k.tobytes())
            values.write(r.numbers)
            ends.setdefault(r.part, [size, size])[1] = size = size + len(k)
    for path in paths:
        spark.sparkContext.addFile(path)
    return {"langs": langs} | {("p" if k > 0 else "g", abs(k)): (Mapped(f"{name}.keys", "<u8", *x), Mapped(f"{name}.values", "<f4", *x)) for k, x in ends.items()}


def _find(arrays: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
    if arrays is None or not len(arrays[0]):
        return np.zeros(len(keys), bool), np.full(len(keys), default, np.float32)
    i = np.minimum(np.searchsorted(arrays[0], keys), len(arrays[0]) - 1)
    hit = arrays[0][i] == keys
    return hit, np.where(hit, arrays[1][i], np.float32(default))


def log2_probabilities(model: dict, keys: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """log2 p of each window's last byte after the others, backing off where the window isn't in the model.  ``langs``: of each window, its
    language's number times 2^32."""
    hit, out = _find(model.get(("p", ORDER)), langs | keys, 0.0)
    todo = np.flatnonzero(~hit)
    for n in range(ORDER, 0, -1):
        if not len(todo):
            return out
        k, lang = keys[todo] & np.uint32((1 << 8 * n) - 1), langs[todo]
        if n < ORDER:
            hit, p = _find(model.get(("p", n)), lang | k, 0.0)
            out[todo[hit]] += p[hit]
            todo, k, lang = todo[~hit], k[~hit], lang[~hit]
        out[todo] += _find(model.get(("g", n)), lang | (k >> np.uint32(8)), 0.0)[1]
    out[todo] -= 8.0
    return out


def text_bits(model: dict, texts: list[bytes], langs: list[str]) -> np.ndarray:
    """-log2 of each text's probability under its language's model; a language that the model hasn't leaves 8 bits a byte."""
    model, known = opened(model), model.get("langs", {})
    bits, numbers = np.zeros(len(texts)), np.array([known.get(x, (1 << 32) - 1) << 32 for x in langs], np.uint64)
    for raw, owners, lengths in segments(texts):
        lang = np.repeat(numbers[owners], lengths + ORDER - 1)[:len(raw) - ORDER + 1]
        lp = log2_probabilities(model, windows(raw), lang)
        sums = np.add.reduceat(np.r_[lp, np.zeros(ORDER)].astype(np.float64), bounds(lengths))[::2]
        np.subtract.at(bits, owners, sums)
    return bits


# ---- judging

METRICS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
           ("base_failed", pa.bool_()), ("bits_per_char", pa.float64()), ("bits_per_word", pa.float64())]


def with_metrics(docs: DataFrame, model: dict, prefix: str = "") -> DataFrame:
    """``docs`` (columns text and lang among them) with the metrics as further columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text_at, lang_at = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = [t or "" for t in b.column(text_at).to_pylist()]
                base = [base_counts(t) for t in texts]
                bits = text_bits(model, [t.encode("utf-8", "replace") for t in texts], [x or "" for x in b.column(lang_at).to_pylist()])
                failed = [w < 50 or 100 * r > 50 * w for w, _, _, _, r in base]
                cols = [*map(list, zip(*base)), failed, [float(x) / max(1, len(t)) for x, t in zip(bits, texts)],
                        [float(x) / max(1, m[0]) for x, m in zip(bits, base)]]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, type=t) for c, (_, t) in zip(cols, METRICS))],
                                                 names=[*names, *(prefix + n for n, _ in METRICS)])

    kinds = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType()}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + n, kinds[t]) for n, t in METRICS)])
    return docs.mapInArrow(run, schema)


def bands(scored: DataFrame) -> DataFrame:
    """(lang, and for each metric m_mid, m_sigma) from the documents that pass the base rule."""
    good = scored.filter(~F.col("base_failed")).select(F.coalesce("lang", F.lit("")).alias("band_lang"), "bits_per_char", "bits_per_word")
    long = good.select("band_lang", F.explode(F.create_map(F.lit("char"), F.col("bits_per_char"), F.lit("word"), F.col("bits_per_word"))).alias("m", "v"))
    hist = long.groupBy("band_lang", "m", F.floor(F.col("v") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("band_lang", "m")
    hist = hist.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))

    def quantile(q):
        return F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) / 1000.0
    stats = hist.filter(F.col("all") >= MIN_DOCS).groupBy("band_lang", "m").agg(quantile(0.25).alias("q1"), quantile(0.5).alias("mid"), quantile(0.75).alias("q3"))
    sigma = F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(SIGMA_FLOOR))
    return stats.groupBy("band_lang").agg(*[F.max(F.when(F.col("m") == m, c)).alias(f"{m}_{k}") for m in ("char", "word") for k, c in (("mid", F.col("mid")), ("sigma", sigma))])


def decided(scored: DataFrame, limits: DataFrame, prefix: str = "") -> DataFrame:
    """``scored`` with the column ``kept``: passes the base rule and both bands of its language."""
    names = [prefix + "band_" + c for c in limits.columns]
    limits = if_small(limits.toDF(*names))
    wide = F.sqrt(F.greatest(F.lit(1.0), TYPICAL_WORDS / F.greatest(F.col(prefix + "n_words"), F.lit(1))))
    inside = [F.coalesce(F.abs(F.col(f"{prefix}bits_per_{m}") - F.col(f"{prefix}band_{m}_mid")) <= WIDTH * F.col(f"{prefix}band_{m}_sigma") * wide, F.lit(True))
              for m in ("char", "word")]
    joined = scored.join(limits, F.coalesce(scored["lang"], F.lit("")) == F.col(prefix + "band_band_lang"), "left")
    return joined.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & inside[0] & inside[1]).drop(*names)


def train(docs: DataFrame) -> dict:
    return sorted_arrays(kneser_ney(count_ngrams(docs)))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, whether the base rule failed, both perplexities in bits, and the verdict."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    scored = cut(with_metrics(docs, train(docs)).drop("text"))
    return decided(scored, bands(scored)).drop("lang")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    model, p = train(docs), "_"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    scored = cut(with_metrics(docs.select("text", "lang"), model).drop("text"))
    return decided(with_metrics(docs, model, p), bands(scored), p).filter(p + "kept").select(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))
