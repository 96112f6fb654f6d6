"""Operators over the whole corpus against brute force: URL filter, fingerprints, sharding, quality, near-duplicates, pipeline."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
import xxhash

from retailkit.check import compare, duck
from retailkit.llm import fingerprints, near_dup, quality, secret_scan, sharding, url_filter
from retailkit.llm.components import components
from tests.conftest import SF_CHECK, SF_SMALL

LONG = " ".join(f"w{i}" for i in range(30_000))
EDGE = [(1, None), (2, ""), (None, "null id"), (None, None), (3, "same row twice"), (3, "same row twice"), (3, "other text"), (9, LONG), (12, LONG + " end"), (40, "é 漢字 x")]


def edge(spark, rows=EDGE):
    return spark.createDataFrame([(*r, "en", 7, "x", 1) for r in rows], "doc_id long, text string, lang string, node long, rn string, cell int")


def small(spark, name="documents"):
    return spark.read.parquet(f"{SF_SMALL}/{name}.parquet")


# ---- URL filter

def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = []
    for act, rule in url_filter.RULES:
        of, _, prefix = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + prefix):
            fits.append((len(rule), rule, act))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules_and_trees(spark):
    odd = [None, "", "no scheme", "HTTP://A.Example.NET?x=1", "x://net", "x://NET/", "x://a.net/y#z", "x://notnet/", "x://a.example.com/de/1", "x://example.org/fr/", "x://a://b/c",
           "x://casino-x.example.com/en/1", "x://casino-x.example.com/en/1"]
    pages = small(spark, "pages").select("page_id", "url").unionByName(spark.createDataFrame([(-i - 1, u) for i, u in enumerate(odd)], "page_id long, url string"))
    pages = pages.selectExpr("*", "'h' AS host", "0 AS label", "1 AS features")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.seed_labels(pages)).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        host, path, rule, act = brute_rule(r.url)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule) and g.verdict == (act or g.verdict) and g.verdict in ("allow", "block")
    free = [(r.verdict, any(t in r.host.replace("-", ".").split(".") for t in url_filter.SEED)) for r in got.values() if r.rule is None and "example" in r.host]
    assert np.mean([(v == "block") == bad for v, bad in free]) > 0.95           # accuracy on the labelled urls
    assert url_filter.judge(pages.limit(0), url_filter.seed_labels(pages.limit(0))).count() == 0


def test_url_trees_hold_out(spark):
    rnd = random.Random(8)
    def url(bad, i):
        name = "-".join(rnd.choice(["win", "cash", "hot", "bet"]) for _ in range(2)) if bad else "".join(rnd.choice("abcdefgh") for _ in range(8))
        return f"http://{name}.example.com/{'x' * rnd.randint(1, 5)}/{i}{'?a=1&b=2&c=3' if bad else ''}"
    rows = [(url(i % 2, i), float(i % 2)) for i in range(600)]
    t = url_filter.Trees(spark.createDataFrame(rows[:400], "url string, label double"))
    host, path = url_filter.host_and_path(url_filter.F.col("url"))
    held = t.score(spark.createDataFrame(rows[400:], "url string, label double").withColumn("host", host).withColumn("path", path)).collect()
    assert np.mean([(r.score > 0.5) == (r.label == 1.0) for r in held]) > 0.95


def test_url_suffixes_are_counted_over_all_labelled_urls(spark, monkeypatch):
    """Also over those outside the sample; a sampled url's own fold isn't in its statistic."""
    monkeypatch.setattr(url_filter, "SAMPLE", 10)
    rnd = random.Random(4)
    rows = [(f"http://{rnd.choice('abc')}.{h}.x{h % 7}.org/{i}", float(h % 3 == 0)) for i in range(400) for h in [rnd.randrange(60)]]
    t = url_filter.Trees(spark.createDataFrame(rows, "url string, label double"))
    base = np.mean([y for _, y in rows])
    folds = {r.url: r._fold for r in spark.createDataFrame(rows, "url string, label double").withColumn("_fold", url_filter._fold()).collect()}
    for k in url_filter.SUFFIXES:
        def suffix(u):
            return ".".join(u.split("/")[2].split(".")[-k:])
        def share(part):
            return (sum(part) + url_filter.SMOOTHING * base) / (len(part) + url_filter.SMOOTHING)
        got = {r[0]: r[1] for r in t.tables[k].collect()}
        assert set(got) == {suffix(u) for u, _ in rows}
        assert all(abs(v - share([y for u, y in rows if suffix(u) == s])) < 1e-12 for s, v in got.items())
        sample = t.rows.collect()
        assert len(sample) == 20
        for r in sample:
            assert abs(r[f"f_suffix{k}"] - share([y for u, y in rows if suffix(u) == suffix(r.url) and folds[u] != folds[r.url]])) < 1e-12


# ---- fingerprints

def brute_simhash(text):
    words = __import__("re").split("[ \t\n\r\x0b\x0c]+", text)
    votes = [0] * 64
    for a, b in zip(words, words[1:] + [None]):
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        if b is not None:
            h = xxhash.xxh64_intdigest(b.encode(), h)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if votes[i] > 0)


@pytest.mark.parametrize("which", ["small", "edge", "one"])
def test_fingerprints_against_brute_force(spark, which, monkeypatch):
    monkeypatch.setattr(fingerprints, "GROUP", 2)
    monkeypatch.setattr(fingerprints, "BUCKET", 3)
    docs = small(spark) if which == "small" else edge(spark) if which == "edge" else edge(spark, [(5, "only one")])
    got = fingerprints.fingerprint_documents(docs).collect()
    sh = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, signed(sh(r[1]))))
    want = collections.Counter()
    for i, (doc, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        f, e, n = brute_simhash(t), brute_simhash(edited), brute_simhash(nxt)
        want[doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{f:016x}", f"{e:016x}", 1 - (f ^ e).bit_count() / 64, 1 - (f ^ n).bit_count() / 64] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_fingerprints_of_nothing(spark):
    assert fingerprints.fingerprint_documents(edge(spark).limit(0)).count() == 0


def test_block_tables_find_all_pairs_in_the_radius(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = base + [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(1, 6))) for b in base for _ in range(4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {tuple(r) for r in fingerprints.near_fingerprints(spark.createDataFrame([(x,) for x in signed + signed[:5] + [None]], "fp long")).collect()}
    want = {(min(a, b), max(a, b), (fps[signed.index(a)] ^ fps[signed.index(b)]).bit_count()) for a, b in itertools.combinations(sorted(set(signed)), 2)}
    assert got == {w for w in want if w[2] <= 3}


# ---- sharding

def brute_shards(rows, limit):
    bits = lambda k: int(hashlib.md5(str(k if k is not None else "").encode()).hexdigest()[:15], 16) >> (60 - sharding.HASH_BITS)
    out = {}
    def split(prefix, depth, members):
        if not members:
            return
        if sum(n for _, n in members) <= limit or depth == sharding.HASH_BITS:
            out[depth, prefix] = members
            return
        for b in (0, 1):
            split(prefix * 2 + b, depth + 1, [m for m in members if bits(m[0]) >> (sharding.HASH_BITS - depth - 1) & 1 == b])
    split(0, 0, rows)
    return out


@pytest.mark.parametrize("levels", [sharding.LEVELS, (2, 4, sharding.HASH_BITS)])
def test_sharding_against_recursive_splits(spark, monkeypatch, levels):
    monkeypatch.setattr(sharding, "LEVELS", levels)
    rows = EDGE + [(i, "z" * (i % 50)) for i in range(100, 400)] + [(77, "h" * 90)] * 300
    docs = edge(spark, rows)
    got = sharding.shard(docs, 1000).collect()
    assert len(got) == len(rows)
    want = brute_shards([(k, len((t or "").encode())) for k, t in rows], 1000)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.depth, r.bucket].append((r.doc_id, r.n_bytes))
    assert {k: collections.Counter(v) for k, v in shards.items()} == {k: collections.Counter(v) for k, v in want.items()}
    chains = collections.defaultdict(list)
    for r in got:
        chains[r.depth, r.bucket, r.chain].append(r.n_bytes)
    assert all(sum(v) <= 1000 or len(v) == 1 for v in chains.values())
    assert sharding.shard(docs.limit(0)).count() == 0


def test_sharding_oracle(spark, monkeypatch):
    docs = small(spark)
    out = compare(sharding.shard(docs, sharding.LIMIT), duck(SF_SMALL), sharding.OP5_SQL)
    assert out["match"], out
    lower = sharding.OP5_SQL.replace(str(sharding.LIMIT), "20000")
    assert compare(sharding.shard(docs, 20000), duck(SF_SMALL), lower)["match"]


# ---- quality

def brute_counts(t):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    three = collections.Counter(zip(words, words[1:], words[2:]))
    marked = {j for i in range(len(words) - 2) if three[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)


def test_base_counts(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ab \n\t\x0b\x1c\x85é#|<") for _ in range(rnd.randint(0, 60))) for _ in range(500)] + [r.text or "" for r in small(spark).collect()]
    assert [quality.base_counts(t) for t in texts] == [brute_counts(t) for t in texts]


def brute_kn(texts):
    """Probability function of the interpolated modified Kneser-Ney model, by dictionaries."""
    counts = {4: collections.Counter(b for t in texts for x in [b"\n\n\n" + t] for b in (x[i:i + 4] for i in range(len(x) - 3)))}
    for n in (3, 2, 1):
        counts[n] = collections.Counter(k[1:] for k in counts[n + 1])
    disc = {}
    for n, c in counts.items():
        k = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] + 2 * k[1] else 0
        disc[n] = [min(max(i - (i + 1) * y * k[i] / k[i - 1] if k[i - 1] and k[0] + 2 * k[1] else 0.0, 0.05), i - 0.001) for i in (1, 2, 3)]

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / 256
        below = p(gram[1:])
        row = {k: v for k, v in counts[n].items() if k[:-1] == gram[:-1]}
        if not row:
            return below
        d = lambda v: disc[n][min(v, 3) - 1]
        total, v = sum(row.values()), row.get(gram, 0)
        return (v - (d(v) if v else 0)) / total + sum(map(d, row.values())) / total * below
    return p


def test_kneser_ney_against_dictionaries(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "théâtre the end end end"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(9, None, "en"), (10, "le chat noir", None)], "doc_id long, text string, lang string")
    model = quality.train(docs)
    p = brute_kn([t.encode() for t in texts])
    for probe in [*texts, "unseen words qqq zz", "a"]:
        x = b"\n\n\n" + probe.encode()
        want = -sum(math.log2(p(x[i:i + 4])) for i in range(len(probe.encode())))
        assert quality.text_bits(model, [probe.encode()], ["en"])[0] == pytest.approx(want, rel=1e-3)


def test_long_texts_are_read_in_segments(monkeypatch):
    texts = [b"abc" * 50, b"", b"xyzw", b"a" * 33]
    model = {("p", 4): (np.array([0], np.uint32), np.array([-1], np.float32))}
    whole = quality.text_bits(model, texts, ["en"] * 4)
    monkeypatch.setattr(quality, "SEGMENT", 7)
    assert np.allclose(quality.text_bits(model, texts, ["en"] * 4), whole)


def test_quality_query_and_stage(spark):
    docs = small(spark).unionByName(edge(spark).selectExpr("doc_id + 100000 AS doc_id", "text", "IF(doc_id = 2, NULL, lang) AS lang", "'s' AS source", "0L AS n_chars"))
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    want = collections.Counter((r.doc_id, *brute_counts(r.text or "")) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in small(spark, "labels").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.6
    kept = quality.keep_good(docs.withColumn("band_lang", docs.lang).withColumn("_kept", docs.lang))
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in rows if r.kept)
    assert quality.judge(docs.limit(0)).count() == 0


def test_perplexity_rejects_bad_documents(spark):
    rows = quality.judge(spark.read.parquet(f"{SF_CHECK}/documents.parquet")).filter("NOT base_failed").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    good, bad = ([r.kept for r in rows if labels.get(r.doc_id) == v] for v in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.5, (sum(good), len(good), sum(bad), len(bad))


# ---- near-duplicates

def brute_classes(rows, threshold=0.8):
    known = near_dup.WordHashes()
    sets = [set(near_dup.regions(t, known).tolist()) for _, t in rows]
    up = list(range(len(rows)))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (rows[i][1] or "") == (rows[j][1] or "") or a and b and len(a & b) >= threshold * len(a | b):
            up[find(j)] = find(i)
    out = collections.defaultdict(set)
    for i in range(len(rows)):
        out[find(i)].add(i)
    return {i: min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in out.values() for i in g}, len(out)


def fixture(seed=11):
    rnd = random.Random(seed)
    words = [f"t{i}" for i in range(3000)]
    passage = [rnd.choice(words) for _ in range(60)]
    docs = [[rnd.choice(words) for _ in range(40)] + passage for _ in range(60)]                    # a shared passage, no near copies
    base = [rnd.choice(words) for _ in range(200)]
    for _ in range(60):                                                                            # a group of near copies
        d = list(base)
        d[rnd.randrange(200)] = rnd.choice(words)
        docs.append(d)
    for _ in range(60):                                                                            # chains of copies edited again and again
        d = list(docs[rnd.randrange(len(docs))])
        for _ in range(rnd.randint(1, 6)):
            d[rnd.randrange(len(d))] = rnd.choice(words)
        docs.append(d)
    docs += [base] * 60 + [["one"], ["one", "two"], ["one"]]
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_near_duplicates_against_all_pairs(spark):
    rows = fixture() + [(None, "null id text"), (10_000, None), (10_001, ""), (10_002, " \n "), (3, "repeated id"), (10_003, LONG), (10_004, LONG + " end")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, comp int, bucket string")
    want, n = brute_classes(rows)
    got = near_dup.classes(docs).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == collections.Counter((rows[i][0], c) for i, c in want.items())
    kept = near_dup.keep_one(docs.unionByName(docs)).collect()
    assert len(kept) == n and kept[0].asDict().keys() == set(docs.columns)
    assert near_dup.classes(docs.limit(0)).count() == 0


def template_rows(n=300, seed=5):
    """Texts of one template, below 0.8 to each other, and to each a copy edited to a little over 0.8."""
    rnd = random.Random(seed)
    words = [f"t{i}" for i in range(5000)]
    common, docs = [rnd.choice(words) for _ in range(300)], []
    for _ in range(n):
        d = common + [rnd.choice(words) for _ in range(75)]
        docs.append(d)
        d = list(d)
        for i in rnd.sample(range(2, 373, 7), 7):
            d[i] = rnd.choice(words)
        docs.append(d)
    rnd.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("block", [near_dup.BLOCK, 40])
def test_pairs_in_crowded_buckets_are_compared(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = template_rows()
    want, n = brute_classes(rows)
    assert n > 250
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[i][0]: c for i, c in want.items()}


def test_a_crowd_puts_out_no_pairs(spark, monkeypatch):
    """Different texts that share most words: nearly all their pairs are unsure, yet tasks return documents and links only."""
    rnd, out = random.Random(4), []
    common = [f"c{i}" for i in range(85)]
    rows = [(i, " ".join(common + [f"x{rnd.randrange(10 ** 6)}" for _ in range(12)])) for i in range(600)]
    one = near_dup.per_group

    def counted(*args):
        df = one(*args)
        path = near_dup.cut(df)
        out.append(path.filter("a IS NOT NULL").count() if "a" in path.columns else 0)
        out.append(path.count())
        return path
    monkeypatch.setattr(near_dup, "per_group", counted)
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, n = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == {rows[i][0]: c for i, c in want.items()}
    assert max(out[::2]) <= len(rows) and max(out[1::2]) <= near_dup.BANDS * 2 * len(rows) < 600 * 599 / 4, out


def test_signatures_estimate_weighted_jaccard():
    rnd = np.random.default_rng(1)
    for n, share in ((400, 0.8), (5000, 0.5), (60, 0.9)):
        u = rnd.integers(0, 2**63, 2 * n, dtype=np.uint64)
        m = int(2 * n * share / (1 + share))                  # |a & b| / |a | b| = share for |a| = |b| = n
        got = []
        for _ in range(20):
            rnd.shuffle(u)
            a, b = np.sort(u[:n]), np.sort(np.r_[u[:m], u[n:2 * n - m]])
            s = near_dup.signatures([a, b, a[:0]])
            assert np.isfinite(s[:2]).all() and np.isinf(s[2]).all()
            got.append((s[0] == s[1]).mean())
        assert abs(np.mean(got) - m / (2 * n - m)) < 0.03


def test_repeated_shingles_weigh():
    known = near_dup.WordHashes()
    a, b = near_dup.regions("a b c d e " * 10, known), near_dup.regions("a b c d e " * 5, known)
    assert len(a) == 46 and len(b) == 21 and set(b.tolist()) <= set(a.tolist())


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)] + [(500, x) for x in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(up)}


# ---- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp
    docs = small(spark)
    seen = [docs]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, seen[-1], SF_SMALL).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(d.columns == docs.columns for d in seen[:4])
    judged = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in seen[1].collect()} == judged
    rows = [(r.doc_id, r.text) for r in seen[1].orderBy("doc_id").collect()]
    assert {r.doc_id for r in seen[2].collect()} == set(brute_classes(rows)[0].values())
    scanner = secret_scan.Scanner()
    before = {r.doc_id: r for r in seen[2].collect()}
    for r in seen[3].collect():
        spans = scanner.spans(before[r.doc_id].text)
        assert r.text == secret_scan.masked(before[r.doc_id].text, spans, "<secret>") and r.n_chars == len(r.text) and not scanner.spans(r.text)
    whole = seen[4].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in whole} == set(before) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in whole)
    assert cp.run(spark, SF_SMALL).count() == seen[4].count()


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp
    good = "the quick brown fox jumps over a lazy dog while some other animals sleep under the old tree near the river "
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.sample((good * 6).split(), 90)), "en", "s", 0) for i in range(60)]
    rows += [(None, rows[0][1], None, None, None), (None, None, "en", "s", 0), (7, rows[7][1], "en", "s", 0), (100, "", "en", "s", None), (101, LONG, "xx", "s", 0),
             (102, " ".join(rnd.sample((good * 6).split(), 90)) + " token = \"0123456789abcdef01234567\"", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, 1, "c", "d") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, _kept string, comp string")
    for name, stage in cp.STAGES:
        for empty in (False, True):
            out = stage(spark, docs.limit(0) if empty else docs, SF_SMALL)
            path = str(tmp_path / f"{name}-{empty}")
            out.write.parquet(path)
            back = spark.read.parquet(path)
            assert empty == (back.count() == 0)
            if name != cp.STAGES[-1][0]:
                assert back.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / f"{name}-False"))
    with_text = {r.doc_id for r in spark.read.parquet(str(tmp_path / "secret scan-False")).collect()}
    assert 102 in with_text and 100 not in with_text and None not in with_text
    assert not spark.read.parquet(str(tmp_path / "secret scan-False")).filter("text LIKE '%0123456789abcdef%'").count()
