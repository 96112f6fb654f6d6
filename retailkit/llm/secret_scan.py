"""Operator 2: secret scan.

Base kinds are patterns; the method adds spans found by entropy.  Candidate strings are the longest runs
of ``A-Za-z0-9+/_=-`` with at least ``window`` characters.  For each character class (hex digits, lower case and digits,
upper case and digits, base 64) its runs in a candidate are cut at stretches that an allow-list pattern covers.
A window slides over each piece; counts change by one character that enters and one that leaves, and the window's Shannon
entropy follows from the counts (H = log2 w - sum c*log2 c / w).  A piece that holds the class's required mix of characters
and a window at or over the class's threshold is a span from end to end, unless it reads like words, a path or a number
(``plain``): allow-listed is what has no letter, and what has most of its neighbouring letters in pairs that are common in
European languages.  Allow-listing never touches base spans.

Inputs: null text is the empty text and has no spans.  Repeated rows give repeated rows, an empty table
an empty one; extra columns are ignored.  Texts are scanned whole.  Spans that start together are ordered
by kind, then end.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailkit.llm.common import map_batches, read_table

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")

# class: (characters, window, bits a window needs, required in the whole piece: minimum digits, upper, lower)
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 20, 3.0, (4, 0, 0)),
    "entropy_lower": ("abcdefghijklmnopqrstuvwxyz0123456789", 20, 3.3, (1, 0, 2)),
    "entropy_upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, 3.3, (1, 2, 0)),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 20, 3.5, (1, 1, 1)),
}
KINDS = BASE_KINDS + tuple(CLASSES)

# Strings that look random and are not secret: UUIDs, digests named as such, subresource hashes.
ALLOW = (
    r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",
    r"(?i:(?:md5|sha1|sha256|sha512|commit|etag)[:= -]{1,2}[0-9a-f]+)",
    r"sha(?:256|384|512)-[A-Za-z0-9+/=]+",
)

# Letter pairs common in English, German, French and Spanish words.
PAIRS = frozenset("""
ab ac ad ag ai al am an ap ar as at au av ba be bi bl bo br bu ca ce ch ci ck cl co cr ct cu da de di do du ea ec ed ee ei el em en ep er es et
ex fa fe fi fo fr fu ga ge gi go gr ha he hi ho ht ic id ie if ig il im in io ir is it iv la le li ll lo lu ly ma me mi mo mp mu na nc nd ne
ng ni no ns nt nu ob oc od of og ol om on oo op or os ot ou ow pa pe ph pi pl po pr pt pu qu ra rd re ri ro rs rt ru sa sc se sh si so sp ss st
su ta te th ti to tr ts tu tt ty ub ue ug ui ul um un up ur us ut va ve vi vo wa we wh wi wo""".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SURPLUS = 3                     # by how many the common pairs must outnumber the others


def plain(s: str) -> bool:
    """Whether ``s`` is a number or made of words: its letters, cut at case changes and other characters, stand in common pairs.
    Hexadecimal digits are never words."""
    if not any(map(str.isalpha, s)):
        return True
    if not s.lower().strip("0123456789abcdef"):
        return False
    pairs = [w[i:i + 2] for w in WORDS.findall(s) for w in (w.lower(),) for i in range(len(w) - 1)]
    return 2 * sum(p in PAIRS for p in pairs) - len(pairs) >= SURPLUS


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _xlogx(c: int) -> float:
    return c * log2(c) if c > 1 else 0.0


def entropy_runs(s: str, window: int, bits: float, need: tuple[int, int, int]) -> list[tuple[int, int]]:
    """Joined windows of ``s`` with entropy of at least ``bits`` and the needed digits, upper and lower letters."""
    counts: dict[str, int] = {}
    kinds, total, runs = [0, 0, 0], 0.0, []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _xlogx(c + 1) - _xlogx(c)
        _count_kind(kinds, ch, 1)
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += _xlogx(c - 1) - _xlogx(c)
            _count_kind(kinds, old, -1)
        if i >= window - 1 and log2(window) - total / window >= bits and all(k >= n for k, n in zip(kinds, need)):
            start = i - window + 1
            if runs and start <= runs[-1][1]:
                runs[-1][1] = i + 1
            else:
                runs.append([start, i + 1])
    return [tuple(r) for r in runs]


def _count_kind(kinds: list[int], ch: str, by: int) -> None:
    if "0" <= ch <= "9":
        kinds[0] += by
    elif "A" <= ch <= "Z":
        kinds[1] += by
    elif "a" <= ch <= "z":
        kinds[2] += by


def found(s: str, window: int, bits: float, need: tuple[int, int, int]) -> bool:
    """Whether ``s`` has the needed characters as a whole, and a window of enough entropy."""
    kinds = [0, 0, 0]
    for ch in s:
        _count_kind(kinds, ch, 1)
    return all(k >= n for k, n in zip(kinds, need)) and not plain(s) and bool(entropy_runs(s, window, bits, (0, 0, 0)))


def without(start: int, end: int, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the ascending stretches ``cut`` leave of start..end."""
    out = []
    for a, b in cut:
        if b > start and a < end:
            if a > start:
                out.append((start, a))
            start = b
    return [*out, (start, end)] if start < end else out


class Scanner:
    def __init__(self, classes: dict = CLASSES, allow: tuple[str, ...] = ALLOW):
        self.allow = re.compile("|".join(allow)) if allow else None
        least = min(c[1] for c in classes.values())
        run = "".join(re.escape(ch) for ch in sorted(set("".join(c[0] for c in classes.values()))))
        self.candidates = re.compile(f"(?<![{run}])[{run}]{{{least},}}")
        self.classes = {k: (re.compile(f"[{re.escape(chars)}]{{{w},}}"), w, bits, need) for k, (chars, w, bits, need) in classes.items()}

    def entropy_spans(self, text: str) -> list[tuple[int, int, str]]:
        out, allowed = [], None
        for m in self.candidates.finditer(text):
            for kind, (part, window, bits, need) in self.classes.items():
                for p in part.finditer(text, m.start(), m.end()):
                    if not found(p.group(), window, bits, need):
                        continue
                    if allowed is None:
                        allowed = [x.span() for x in self.allow.finditer(text)] if self.allow else []
                    pieces = without(p.start(), p.end(), allowed)
                    if pieces == [p.span()]:
                        out.append((*p.span(), kind))
                    else:
                        out += [(a, b, kind) for a, b in pieces if found(text[a:b], window, bits, need)]
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans (start, end, kind) by start, then kind as listed in KINDS."""
        return ordered(base_spans(text) + self.entropy_spans(text))


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[0], rank.get(s[2], len(rank)), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base kinds, digest of base spans, all spans."""
    def run(c):
        scanner, out = Scanner(), {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for t in c["text"]:
            found = scanner.spans(t or "")
            base = [s for s in found if s[2] in BASE_KINDS]
            for k in BASE_KINDS:
                out["n_" + k].append(sum(s[2] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(found))
        return {"doc_id": c["doc_id"]} | out
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run,
                       "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """``text`` with every maximal stretch covered by spans replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The documents with their secrets masked; all columns stay, ``n_chars`` (if there) follows the new text."""
    def clean(texts: pd.Series) -> pd.Series:
        scanner = Scanner()
        return pd.Series([None if t is None else masked(t, scanner.spans(t), mark) for t in texts], dtype=object)

    udf = F.pandas_udf(clean, "string")
    out = docs.withColumn("text", udf("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
