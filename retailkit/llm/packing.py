"""Operator 3: cost-balanced packing of documents into training sequences.

A document is its ids and an end id.  A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention
is within pieces).  Each task packs its documents in blocks bounded in documents and tokens, so a block
is all it holds.  In a block, documents are cut at the sequence length; the sequences are as many full
lengths as the block's tokens give, and powers of two for the rest, so that no id is padding.
Pieces go in descending length to the lowest-cost sequence with room for them; if none has room, the piece
is cut to fill the lowest-cost sequence with any room, and the rest goes back among the pieces.

A sequence's number holds the task's partition and a counter; the result depends on how the input is
dealt over partitions, and is the same again when a task is repeated on the same partition.  There is no
shuffle.

Inputs: null text is the empty text, a document of the end id alone.  Repeated rows are documents of their
own.  An empty table gives an empty one; extra columns are ignored.  Texts of any length are read whole.
"""

from __future__ import annotations

import heapq
import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailkit.llm.bpe import SPLIT, TextEncoder, byte_symbols
from retailkit.llm.common import read_table, record_batch

LENGTH, LINEAR, QUADRATIC = 1024, 1.0, 1.0 / 1024
BLOCK_DOCS, BLOCK_TOKENS = 4096, 4_000_000


def capacities(tokens: int, length: int) -> list[int]:
    """Sequence lengths that hold exactly ``tokens``: full ones, then distinct powers of two."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, n, sequence, offset) of documents with these lengths."""
    def cost(n: int) -> float:
        return linear * n + quadratic * n * n

    out, queue = [], []
    for d, n in enumerate(lengths):
        for s in range(0, n, length):
            heapq.heappush(queue, (-min(length, n - s), d, s))
    room: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]    # by room left: (cost, sequence)
    best = np.full(length + 1, np.inf)                                       # lowest cost by room left
    used = [0] * len(sizes := capacities(sum(lengths), length))
    for q, c in enumerate(sizes):
        heapq.heappush(room[c], (0.0, q))
        best[c] = 0.0
    while queue:
        n, d, s = heapq.heappop(queue)
        n = -n
        c = n + int(np.argmin(best[n:]))
        if best[c] == np.inf:                          # nowhere whole
            c = 1 + int(np.argmin(best[1:]))
            heapq.heappush(queue, (c - n, d, s + c))
            n = c
        had, q = heapq.heappop(room[c])
        best[c] = room[c][0][0] if room[c] else np.inf
        out.append((d, s, n, q, used[q]))
        used[q] += n
        if left := c - n:
            heapq.heappush(room[left], (had + cost(n), q))
            best[left] = room[left][0][0]
    return out


def fast_encoder(path: str) -> TextEncoder:
    """The ids that the tokenizers library gives for the vocabulary file; stretches between spaces are remembered.

    New stretches go through tiktoken's merge loop, which wants merges ranked as ids; a file that isn't like that
    is encoded by the tokenizers library itself."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    symbol, added = byte_symbols(), {a["content"]: a["id"] for a in d["added_tokens"]}
    vocab, merges = d["model"]["vocab"], d["model"]["merges"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if made != sorted(made) or len(vocab) != len(made) + 256 + sum(t in vocab for t in added):
        return library_encoder(path)
    import tiktoken
    ranks = {bytes(symbol[c] for c in t): i for t, i in vocab.items() if t not in added}
    encode = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return TextEncoder(lambda xs: [little(array("I", encode(x))) for x in xs], added)


def little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def library_encoder(path: str) -> TextEncoder:
    """Ids by the tokenizers library; stretches between spaces are remembered."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return TextEncoder(lambda xs: [np.array(e.ids, dtype="<u4").tobytes() for e in t.encode_batch_fast(xs, add_special_tokens=False)],
                       {a.content: i for i, a in t.get_added_tokens_decoder().items()})


_LOADED: dict[str, TextEncoder] = {}
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """One row per piece of every document."""
    def packed(block: list[tuple[int | None, bytes]], first: int) -> pa.RecordBatch:
        rows = pack([len(b) // 4 for _, b in block], length)
        rows.sort(key=lambda r: (r[3], r[4]))
        return record_batch([[block[d][0] for d, *_ in rows], [s for _, s, *_ in rows], [n for _, _, n, *_ in rows],
                             [zlib.crc32(block[d][1][4 * s:4 * (s + n)]) for d, s, n, _, _ in rows],
                             [len(block[d][1]) // 4 for d, *_ in rows], [first + q for *_, q, _ in rows], [o for *_, o in rows]], PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = fast_encoder(path)
        encode, end = _LOADED[path].encode, end_id.to_bytes(4, "little")
        block, tokens, first = [], 0, TaskContext.get().partitionId() << 40
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text or "") + end
                block.append((doc, ids))
                tokens += len(ids) // 4
                if len(block) >= BLOCK_DOCS or tokens >= BLOCK_TOKENS:
                    yield packed(block, first)
                    first += len(capacities(tokens, length))
                    block, tokens = [], 0
        if block:
            yield packed(block, first)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
