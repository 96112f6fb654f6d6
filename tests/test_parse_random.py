"""Flexible dates: the Column expression against a plain-Python statement of the same rules,
on generated strings (separators, part orders, 2-digit years, overflow, junk)."""

import datetime as dt
import random
import re

from retailkit.functions.parse import flexible_date


def _parse_int(p: str):
    m = re.match(r"^\s*([+-]?[0-9]+)", p)
    return int(m.group(1)) if m else None


def brute(text):
    """Independent restatement of FN-9 (not the Spark code)."""
    if text is None:
        return None
    t = text.strip()
    sep = next((s for s in "/-." if s in t), None)
    if sep is None:
        return None
    parts = [_parse_int(x) for x in t.split(sep)]
    if len(parts) != 3 or any(p is None for p in parts):
        return None
    a, b, c = parts
    ymd = None
    if a > 31:
        ymd = (a, c, b) if b > 12 else (a, b, c)
    elif c > 31:
        ymd = (c, b, a) if a > 12 else ((c, a, b) if b > 12 else (c, b, a))
    elif a > 12 and b <= 12 and c <= 31:
        ymd = (a, c, b) if b > 12 else (a, b, c)
    elif b > 31 or (b > 12 and a <= 12 and c <= 31):
        ymd = (b, c, a)
    elif c > 31 or c > 0:
        ymd = (c, b, a) if a > 12 else ((c, a, b) if b > 12 else (c, b, a))
    if ymd is None:
        return None
    y, m, d = ymd
    if y == 0 or m == 0 or d == 0 or not (1 <= d <= 31 and 1 <= m <= 12):
        return None
    if y < 100:
        y += 2000 if y < 50 else 1900
    return dt.date(y, m, 1) + dt.timedelta(days=d - 1)


def _random_texts(n=3000, seed=13):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.random()
        if k < 0.05:
            out.append(rnd.choice(["", "abc", "12", "1//2", " ", "2024-01", "a.b.c", "1-2-3-4"]))
            continue
        sep = rnd.choice("/-.")
        parts = []
        for _ in range(3):
            r = rnd.random()
            if r < 0.6:
                parts.append(str(rnd.randrange(0, 32)).zfill(rnd.choice([1, 2])))
            elif r < 0.9:
                parts.append(str(rnd.randrange(1900, 2100)))
            else:
                parts.append(str(rnd.randrange(32, 100)))
        s = sep.join(parts)
        if rnd.random() < 0.1:
            s = " " + s + " "
        out.append(s)
    return out


def test_flexible_date_matches_brute_force(spark):
    texts = _random_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = {r["i"]: r["d"] for r in df.select("i", flexible_date("t").alias("d")).collect()}
    mism = [(t, got[i], brute(t)) for i, t in enumerate(texts) if got[i] != brute(t)]
    assert not mism, mism[:10]


def _brute_num(text):
    """FN-7 restated: keep digits, '.', '-'; then the longest parseFloat prefix; failure -> 0."""
    s = re.sub(r"[^0-9.\-]", "", text or "")
    m = re.match(r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+))", s)
    return float(m.group(1)) if m else 0.0


def test_clean_num_matches_brute_force(spark):
    from retailkit.functions.parse import clean_num
    rnd = random.Random(21)
    alphabet = "0123456789.,-₵GHS $abc"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 10))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = {r["i"]: r["n"] for r in df.select("i", clean_num("t").alias("n")).collect()}
    mism = [(t, got[i], _brute_num(t)) for i, t in enumerate(texts) if got[i] != _brute_num(t)]
    assert not mism, mism[:10]
