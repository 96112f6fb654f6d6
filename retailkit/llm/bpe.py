"""Operator 9: byte-level BPE by a tokenization automaton.

Merges are compiled, in their order, into a deterministic automaton over token labels.  It starts with
one state that reads every byte.  The gadget of a merge (u, v): let q be the state that label u leads to.
If q reads v, a copy of q without v takes over all arcs labelled u, and a new arc uv leads, from every
state that reads u, to where v leads.  An arc's target depends on its label alone, so a state is stored
as (state it copies, label it lacks, merge that made it), and the rows share their arcs.  The label
sequences that the automaton reads are exactly the results of the merges, and each word has one.

Encoding: text is split as the vocabulary's pattern says; a word is read longest arc first, with a memo of
dead ends, until its one path is found.  Words are remembered in a bounded table.  Decoding emits arc labels.

Inputs: null text is the empty text and gives no ids.  Repeated rows give repeated rows, an empty table
an empty one.  Extra columns are ignored.  The added token's string in a text becomes its id, as in the
vocabulary's library.  Texts of any length are read whole, one Arrow batch in memory at a time.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailkit.llm.common import map_batches, read_table

# Fixed value: the split pattern of byte-level BPE vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 300_000


def byte_symbols() -> dict[str, int]:
    """The vocabulary's printable character for each byte: printable ones stand for themselves, others follow 255."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    ROOT = 0

    def __init__(self, vocab: dict[str, int], merges: list, added: dict[str, int] | None = None):
        symbol = byte_symbols()
        self.added = added or {}
        self.label = {i: bytes(symbol[c] for c in t) for t, i in vocab.items() if t not in self.added}
        self.label |= {i: t.encode() for t, i in self.added.items()}
        ident = {b: i for i, b in self.label.items() if i not in self.added.values()}
        self.made = {ident[bytes([b])]: -1 for b in range(256)}     # merge that made a label; bytes come first
        self.left: dict[int, int] = {}
        self.parent, self.lacks, self.since = [0], [-1], [-1]
        self.target = dict.fromkeys(self.made, self.ROOT)
        self._reads: dict[int, bool] = {}
        for n, pair in enumerate(merges):
            self._gadget(n, *(ident[bytes(symbol[c] for c in p)] for p in (pair.split(" ") if isinstance(pair, str) else pair)), ident)
        self.arcs = {self.label[t]: t for t in self.made}
        self._reads.clear()
        self.longest: dict[bytes, int] = {}
        for b in self.arcs:
            k = b[:2]
            self.longest[k] = max(self.longest.get(k, 1), len(b))

    def _gadget(self, n: int, u: int, v: int, ident: dict[bytes, int]) -> None:
        q = self.target[u]
        if not self._walk(q, v):
            return                                    # no text ever has u before v when this merge is due
        w, after = ident[self.label[u] + self.label[v]], self.target[v]
        self.parent.append(q)
        self.lacks.append(v)
        self.since.append(n)
        self.target[u] = len(self.parent) - 1
        self.made[w], self.left[w], self.target[w] = n, u, after

    def _walk(self, s: int, t: int) -> bool:
        """Does state s read label t?  Copies inherit older arcs; a newer arc uv is there where u is."""
        made, since, lacks, parent = self.made, self.since, self.lacks, self.parent
        while True:
            n = made[t]
            while since[s] > n:
                if lacks[s] == t:
                    return False
                s = parent[s]
            if n < 0:
                return True
            t = self.left[t]

    def step(self, s: int, t: int) -> bool:
        k = s << 20 | t
        r = self._reads.get(k)
        if r is None:
            if len(self._reads) > 1_000_000:
                self._reads.clear()
            r = self._reads[k] = self._walk(s, t)
        return r

    def encode_word(self, word: bytes) -> list[int]:
        """Labels of the one accepting path of ``word``."""
        t = self.arcs.get(word)
        if t is not None:
            return [t]
        n, arcs, target, longest = len(word), self.arcs, self.target, self.longest
        path: list[tuple[int, int, int]] = []         # (start, length tried, label)
        pos, state, size, dead = 0, self.ROOT, min(n, longest.get(word[:2], 1)), set()
        while pos < n:
            while size:
                t = arcs.get(word[pos:pos + size])
                if t is not None and (pos + size, t) not in dead and self.step(state, t):
                    break
                size -= 1
            if size:
                path.append((pos, size, t))
                pos += size
                state = target[t]
            else:                                     # dead end: take back the last arc, try a shorter one
                p, size, t = path.pop()
                dead.add((p + size, t))
                pos, size = p, size - 1
                state = target[path[-1][2]] if path else self.ROOT
                continue
            size = min(n - pos, longest.get(word[pos:pos + 2], 1))
        return [t for _, _, t in path]

    @classmethod
    def from_file(cls, path: str) -> "TokenAutomaton":
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return cls(d["model"]["vocab"], d["model"]["merges"], {a["content"]: a["id"] for a in d["added_tokens"]})


class TextEncoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids; remembers the ids of stretches between spaces.

    A stretch of text that starts at a single space between two other characters and ends before the next such
    space is split the same way wherever it stands, so its ids can be remembered.  ``pieces`` encodes a list
    of stretches.
    """

    def __init__(self, pieces, added: dict[str, int]):
        self.pieces, self.added, self.known, self.first = pieces, added, {}, {}

    def encode(self, text: str) -> bytes:
        for token, i in self.added.items():
            if token in text:
                return i.to_bytes(4, "little").join(self.encode(x) for x in text.split(token))
        if not text:
            return b""
        parts = text.split(" ")
        if not all(parts) or any(map(str.isspace, {p[0] for p in parts} | {p[-1] for p in parts})):
            return b"".join(self.pieces([text]))
        get = self.known.get
        out = [get(p) for p in parts]
        out[0] = self.first.get(parts[0])
        missing = list({p for p, o in zip(parts[1:], out[1:]) if o is None})
        if out[0] is None:
            out[0] = self.pieces([parts[0]])[0]
            if len(self.first) < CACHE_WORDS // 10:
                self.first[parts[0]] = out[0]
        if missing:
            new = dict(zip(missing, self.pieces([" " + p for p in missing])))
            if len(self.known) < CACHE_WORDS:
                self.known.update((p, o) for p, o in new.items() if len(p) < 64)
            out = [new[p] if o is None else o for p, o in zip(parts, out)] if len(out) > 1 else out
        return b"".join(out)


def automaton_encoder(path: str) -> tuple[TokenAutomaton, TextEncoder]:
    a = TokenAutomaton.from_file(path)
    split, words = regex.compile(SPLIT), {}

    def word(w: str) -> bytes:
        ids = words.get(w)
        if ids is None:
            ids = np.array(a.encode_word(w.encode()), dtype="<u4").tobytes()
            if len(words) < CACHE_WORDS and len(w) < 64:
                words[w] = ids
        return ids

    return a, TextEncoder(lambda xs: [b"".join(map(word, split.findall(x))) for x in xs], a.added)


_LOADED: dict[str, tuple] = {}


def loaded(path: str) -> tuple[TokenAutomaton, TextEncoder]:
    """The automaton of a vocabulary file, compiled once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = automaton_encoder(path)
    return _LOADED[path]


def decode(automaton: TokenAutomaton, ids) -> str:
    """Text of a sequence of ids: the labels in order, bytes that are no UTF-8 replaced."""
    return b"".join(map(automaton.label.__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<long>) of every text."""
    def run(c):
        _, enc = loaded(path)
        return {"doc_id": c["doc_id"], "ids": [np.frombuffer(enc.encode(t or ""), "<u4").tolist() for t in c["text"]]}
    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<long>")


def roundtrip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text, decode the ids again, and return counts and digests of both."""
    def run(c):
        a, enc = loaded(path)
        n, ids_hex, text_hex = [], [], []
        for t in c["text"]:
            ids = enc.encode(t or "")
            n.append(len(ids) // 4)
            ids_hex.append(hashlib.sha256(ids).hexdigest())
            back = decode(a, np.frombuffer(ids, "<u4").tolist())
            text_hex.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
        return {"doc_id": c["doc_id"], "n_tokens": n, "ids_sha256": ids_hex, "decoded_sha256": text_hex}
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return roundtrip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
