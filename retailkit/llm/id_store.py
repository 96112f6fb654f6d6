"""Operator 11: token ids in ORC files, in order of doc_id.

The file format is ORC by Spark's own writer: rows (part, at, n_tokens, doc_id, ids array<int>) sorted by doc_id, one file
per part.  Ids and lengths are stored by ORC's integer run-length encoding; a row index entry stands for every INDEX_ROWS rows,
stripes are cut at STRIPE bytes, and a Bloom filter on doc_id is kept for every index entry.  So a file is read by as many tasks as
it has stripes (Spark cuts files at spark.sql.files.maxPartitionBytes), and a search for doc_ids skips files, stripes and
row groups by minimum, maximum and Bloom filter before it decodes any ids.

Writing deals the documents into ranges of (doc_id, hash of the text, row), so that neither a hot key nor copies make a large part, sorts
them there and encodes them where they are.  ``at`` is the number of ids before the document in its part; the ids
before a part are sums over the few rows (part, ids) of a scan that reads two number columns only.

Encoding: the vocabulary file's own tokenizer; the ids of its words are remembered (``WordIds``).  Every document ends with the end id.

Inputs: null text is the empty text, a document of the end id alone.  Null doc_ids come first.  Rows that repeat a doc_id stand in the
order of their texts' hashes; equal rows are documents of their own.  An empty table gives an empty store.  Extra columns are ignored;
texts of any length are read whole.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retailkit.llm.bpe import byte_symbols
from retailkit.llm.common import read_table
from retailkit.session import ensure_checkpoint_dir

END_ID = 2
STRIPE, INDEX_ROWS, FALSE_HITS = 16 << 20, 1000, 0.01
CACHE_WORDS, BATCH_BYTES = 600_000, 1 << 20
# Fixed value: the vocabulary's pattern for words, in Latin-1: contractions, letters, one digit, or what is neither and no space.
PRE = re.compile(rb"[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|'(?:[stmd]|re|ve|ll)|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                 rb"|[^\x09-\x0d\x20\x85\xa0a-zA-Z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
STORED = "part int, at long, n_tokens long, doc_id long, ids array<int>"
STORED_ARROW = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


class WordIds:
    """Ids of whole texts by a vocabulary whose words carry an end mark.

    In a text of Latin-1 characters the vocabulary's words are found by PRE (it lower-cases first, so A-Z may be lower-cased
    before).  Every known word has a slot in a pool of ids; unknown words of several texts are encoded in one call of the
    tokenizers library and told apart by their end marks.  Words that don't fit the bounded table are dropped after use.
    Other texts, and those with an added token's string, go through the library as they are.
    """

    class Slots(dict):
        def __init__(self):
            super().__init__()
            self.new: list[bytes] = []

        def __missing__(self, word: bytes) -> int:
            slot = self[word] = len(self)
            self.new.append(word)
            return slot

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.marks = np.zeros(max(vocab.values()) + 1, bool)
        self.marks[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.added = [a.content.encode() for a in self.tokenizer.get_added_tokens_decoder().values()]
        # words are cut and normalised already: the same merges without the steps before them, over the vocabulary's symbols of bytes
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.symbols = {b: c for c, b in byte_symbols().items() if b != ord(" ")}
        self.slots, self.ends, self.pool = self.Slots(), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, words: list[bytes]) -> np.ndarray:
        line = b" ".join(words).decode("latin-1").lower().encode().decode("latin-1").translate(self.symbols)
        return np.array(self.merges.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int32)

    def words(self, text: str) -> list[bytes] | None:
        try:
            raw = text.encode("latin-1").lower()
        except UnicodeEncodeError:
            return None
        return None if any(a in raw for a in self.added) else PRE.findall(raw)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        found = [self.words(t) for t in texts]
        plain = [w for w in found if w is not None]
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(plain)), np.int64)
        known, ends, pool = len(self.ends) - 1, self.ends, self.pool
        if new := self.slots.new:
            made = self._merged(new)
            ends = np.r_[ends, ends[-1] + 1 + np.flatnonzero(self.marks[made])]
            pool = np.r_[pool, made]
            if len(ends) != known + len(new) + 1:
                raise RuntimeError("words and end marks differ")
            if len(self.slots) <= CACHE_WORDS:
                self.ends, self.pool = ends, pool
            else:
                for w in new:
                    del self.slots[w]
            self.slots.new = []
        size = ends[slots + 1] - ends[slots]
        upto = np.cumsum(size)
        flat = pool[np.repeat(ends[slots] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        cuts = np.r_[0, upto][np.cumsum([0] + [len(w) for w in plain])]
        ids = iter([flat[a:b] for a, b in zip(cuts, cuts[1:])])
        others = iter(self._library([t for t, w in zip(texts, found) if w is None]))
        return [next(others) if w is None else next(ids) for w in found]


_LOADED: dict[str, WordIds] = {}


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """STORED rows of (doc_id, text) that are sorted within partitions."""
    end = np.array([end_id], np.int32)

    def batch(first: list[int], doc_ids: list, ids: list[np.ndarray], part: int) -> pa.RecordBatch:
        n = [len(x) for x in ids]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.concatenate(ids)))
        cols = [pa.array([part] * len(n), pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(doc_ids, pa.int64()), lists]
        return pa.RecordBatch.from_arrays(cols, schema=STORED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = WordIds(path)
        encode, part, at = _LOADED[path].encode_all, TaskContext.get().partitionId(), 0
        for b in batches:
            i, sizes = 0, np.cumsum(pa.compute.binary_length(b.column(1)).to_numpy())
            while i < b.num_rows:                                  # some BATCH_BYTES of text at once, one document at least
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + BATCH_BYTES, "right")))
                ids = [np.concatenate([x, end]) for x in encode(b.column(1)[i:j].to_pylist())]
                first = at + np.r_[0, np.cumsum([len(x) for x in ids])]
                yield batch(first[:-1].tolist(), b.column(0)[i:j].to_pylist(), ids, part)
                at, i = int(first[-1]), j

    return docs.select("doc_id", "text").mapInArrow(run, STORED)


def write_store(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Encode all texts of (doc_id, text) with the vocabulary file ``path`` and write them in ascending doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("body", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["doc_id", "body", "row"]
    rows = encoded(rows.repartitionByRange(*order).sortWithinPartitions(*order), path, end_id)
    (rows.write.option("compression", "zstd").option("orc.stripe.size", STRIPE).option("orc.row.index.stride", INDEX_ROWS)
         .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", FALSE_HITS).orc(folder))


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents with the number of ids before them, by their stripes."""
    rows = spark.read.schema(STORED).orc(folder)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))      # a row per file
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    # as small as the list of files, so broadcast: a shuffle join would move all ids
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids")


def find_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents; the filter reaches the files' statistics and Bloom filters."""
    return spark.read.schema(STORED).orc(folder).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``read_store``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op11_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_store(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return digests(read_store(spark, folder))
