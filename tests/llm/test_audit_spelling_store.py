"""Filter audit, spelling variants and the id store against brute force."""

import glob
import itertools
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql.functions import col as spark_col

os.environ["TOKENIZERS_PARALLELISM"] = "false"
public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from retailkit.check import compare, duck  # noqa: E402
from retailkit.llm import filter_audit, id_store, spelling  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402


def docs_of(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, "n", 1) for r in rows], "doc_id long, text string, source string, n long, word string, mask int")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- filter audit

def brute_audit(rows, labels):
    low = {}
    for d, t, _ in rows:
        if d is not None:
            low[t or ""] = min(low.get(t or "", d), d)
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    out = defaultdict(Counter)
    for d, t, s in rows:
        t = t or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > low[t]}
        for o in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for i, f in enumerate(o, 1):
                c = out[s or "", o, i]
                c["removed"] += fails[f] and not gone
                c["redundant"] += fails[f] and gone
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += fails[f] and not gone and d in good
                c["toxic_lost"] += fails[f] and not gone and d in toxic
                gone = gone or fails[f]
                c["kept"] += not gone
    total = Counter()
    for (s, o, i), c in out.items():
        total[s, o[i - 1]] += c["removed"]
    return {(s, o, i): tuple(c[k] for k in filter_audit.COUNTS) + (total[s, o[i - 1]],) for (s, o, i), c in out.items()}


def audited(spark, rows, labels):
    got = filter_audit.audit(docs_of(spark, rows), labels_of(spark, labels)).collect()
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    return {(r.part, r.filter_order, r.step): (*(r[c] for c in filter_audit.COUNTS), r.shapley) for r in got}


def test_audit_against_every_order(spark):
    rnd = random.Random(12)
    bodies = ["", None, "Ab # c", "a " * 250, " ".join(f"w{i}" for i in range(230)), "UP " * 300, "x\x0by\x0cz\x85u $"]
    bodies += [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(k)) for _ in range(240)) + rnd.choice(["", " %", " ABCDEFGHIJKLMNOPQRSTUVWXYZ"]) for k in (2, 20, 200, 2000)]
    rows = [(i, rnd.choice(bodies) if i % 3 else bodies[5], rnd.choice(["a", "b", "", None])) for i in range(150)]
    rows += [(7, "twice", "a"), (7, "twice", "a"), (7, "twice", "b"), (9, "twice", "b"), (None, "twice", "a"), (None, "twice", "a"), (7, "other", "a"), (999, "w " * 50_000, "long")]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 150, 2)] + [(7, 0, 1), (7, 1, 0), (9, None, 1), (None, 1, 1), (4, None, None)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_no_rows(spark):
    assert audited(spark, [], []) == {} and audited(spark, [], [(1, 1, 1)]) == {}
    assert len(audited(spark, [(1, "a", None)], [])) == 600


def test_audit_equals_sql(spark):
    assert compare(filter_audit.op12_filter_audit(spark, SF_SMALL), duck(SF_SMALL), filter_audit.OP12_SQL)["match"]


# ---- spelling variants

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    form, near = {}, {}
    for w in n:
        others = [x for x in n if abs(len(x) - len(w)) < 2 and x != w and one_edit(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        out[w] = (form[w], r, n[w], near[w], n.get(form[w]))
    return out


def variants(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def random_words(rnd, letters, count, sizes):
    words = {}
    while len(words) < count:
        w = "".join(rnd.choice(letters) for _ in range(rnd.choice(sizes)))
        words[w] = rnd.choice([3, 4, 7, 9, 20, 50, 200])
    return words


def test_acceptor_is_minimal_and_pairs_are_all_pairs():
    rnd = random.Random(3)
    for letters, sizes in (("ab", range(0, 7)), ("abc", range(0, 6)), ("aeé÷z", range(1, 5))):
        texts = sorted(random_words(rnd, letters, 40, list(sizes)))
        a = spelling.Acceptor(texts)
        rights = set()
        for t in {t[:i] for t in texts for i in range(len(t) + 1)}:
            rights.add(frozenset(x[len(t):] for x in texts if x.startswith(t)))
        assert len(a.arcs) == len(rights) and a.size[a.start] == len(texts)
        left, right = a.pairs()
        got = Counter(frozenset((int(x), int(y))) for x, y in zip(left, right))
        assert got == Counter(frozenset((i, j)) for i in range(len(texts)) for j in range(i) if one_edit(texts[i], texts[j]))


@pytest.mark.parametrize("limit", [spelling.LIMIT, 6])
def test_near_words_with_and_without_split_partitions(spark, limit):
    rnd = random.Random(5)
    n = random_words(rnd, "abé", 250, [1, 2, 3, 4, 5, 6, 7]) | random_words(rnd, "aaab", 60, [5, 8, 9, 10])
    n |= {"hot" + w: k for w, k in random_words(rnd, "xyz", 120, [3, 4, 5]).items()}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form_n, r.form) for r in spelling.near_words(words, limit).collect()}
    want = {}
    for w in n:
        others = [x for x in n if x != w and one_edit(w, x)]
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            want[w] = (len(others), n[best], best)
    assert got == want


def brute_count(rows):
    n = Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def test_variants_of_documents(spark):
    rnd = random.Random(13)
    base = ["STRASSE", "straße", "Ångström", "ångström", "naïveté", "colour", "color", "colours", "a×bcde", "abcde", "abcd", "über", "ÜBERALL"]
    rows = [(i, " ".join(rnd.choices(base, weights=[9, 1, 5, 3, 2, 30, 9, 4, 1, 2, 9, 9, 9], k=40)) + rnd.choice(["", "\n1colour_color", "漢colour字"]), "s") for i in range(120)]
    rows += [(None, "colour colour", "s"), (None, None, None), (3, "", "s"), (4, "x" * 100_000 + " " + "x" * 100_001, "s"), (4, "x" * 100_000 + " " + "x" * 100_001, "s"),
             (5, "x" * 100_000 + " " + "x" * 100_001, "s"), (5, "colour " * 3000, "s")]
    got = variants(spelling.group_variants(spelling.count_words(docs_of(spark, rows))))
    assert got == brute_variants(brute_count(rows))
    assert spelling.group_variants(spelling.count_words(docs_of(spark, []))).count() == 0


def test_variants_of_the_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    n = brute_count([(r.doc_id, r.text, None) for r in docs.collect()])
    assert variants(spelling.op13_spelling(spark, SF_SMALL)) == brute_variants(n)


# ---- id store

@pytest.fixture(scope="module")
def word_tokenizer():
    return public_tokenizers.path("word_bpe_49k.json"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def stored(rows, library):
    """(doc_id, start, n, crc) of rows in stored order."""
    out, start = [], 0
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_word_ids_equal_the_library(word_tokenizer, monkeypatch):
    path, library = word_tokenizer
    ids, rnd = id_store.WordIds(path), random.Random(11)
    letters = "aaab etion hs'tre T.,\n\t 012éÜ中́̈\x1c\x85　 ſİΣ가각<|endoftext|>"
    latin = "".join(map(chr, range(256))) + "abc  'sre" * 20
    texts = ["", " ", "x" * 100_000]
    for i in range(3000):
        s = "".join(rnd.choice(letters if i % 2 else latin) for _ in range(rnd.randint(0, 40)))
        texts.append(s + " <|endoftext|>x" + s[:9] if i % 9 == 0 else s)
    for n in (1, 7, 100):
        monkeypatch.setattr(id_store, "CACHE_WORDS", 10 ** n)
        at = 0
        while at < len(texts):
            for t, got in zip(texts[at:at + n], ids.encode_all(texts[at:at + n])):
                assert got.tolist() == library.encode(t, add_special_tokens=False).ids, t
            at += n


def test_store_of_odd_rows(spark, tmp_path, word_tokenizer):
    path, library = word_tokenizer
    rows = [(40, "b c"), (None, "no id"), (None, None), (3, "same row"), (3, "same row"), (3, "other text"), (-5, ""), (2 ** 40, "é 漢字 X <|endoftext|>"), (12, "word " * 60_000)]
    rows += [(7, f"text {i}") for i in range(400)]
    id_store.write_store(docs_of(spark, [(*r, "s") for r in rows]), str(tmp_path / "s"), path)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in id_store.digests(id_store.read_store(spark, str(tmp_path / "s"))).collect()]
    body = dict(spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t)").collect())
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, body[r[1] or ""]))
    assert sorted(got, key=lambda r: r[1]) == stored(rows, library)
    id_store.write_store(docs_of(spark, []), str(tmp_path / "none"), path)
    assert id_store.digests(id_store.read_store(spark, str(tmp_path / "none"))).count() == 0


def test_store_prunes_by_metadata(spark, tmp_path, word_tokenizer):
    folder = str(tmp_path / "s")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("doc_id", 2 * spark_col("doc_id"))
    id_store.write_store(docs, folder, word_tokenizer[0])
    assert {r.doc_id for r in id_store.find_documents(spark, folder, [10, 11, 12]).collect()} == {10, 12}
    assert "PushedFilters: [In(doc_id, [10,11,12])]" in id_store.find_documents(spark, folder, [10, 11, 12])._jdf.queryExecution().toString()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in glob.glob(folder + "/*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        if reader.getNumberOfRows():
            assert reader.getRowIndexStride() == id_store.INDEX_ROWS
            doc_id = 4                                          # column number in the file's type
            kinds = {str(s.getKind()) for s in reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList() if s.getColumn() == doc_id}
            assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds


def test_store_of_the_table(spark, word_tokenizer):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(id_store.op11_id_store(spark, SF_SMALL).collect(), key=lambda r: r.doc_id)
    assert [tuple(r) for r in got] == stored([(r.doc_id, r.text) for r in docs], word_tokenizer[1])
