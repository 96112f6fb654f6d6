"""The perplexity model keeps every n-gram of every language."""

import random

import numpy as np
import pytest

from retailkit.llm import quality


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")


def grams(texts, n):
    return {x[i:i + 4][4 - n:] for t in texts for x in [b"\n\n\n" + t.encode()] for i in range(len(x) - 3)}


def test_every_ngram_has_its_own_entry(spark):
    rnd = random.Random(22)
    texts = {lang: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(6000)) for _ in range(5)] for lang in ("en", "de")}
    model = quality.train(docs_of(spark, [(lang, t) for lang, ts in texts.items() for t in ts]))
    arrays = quality.opened(model)
    for n in (1, 2, 3, 4):                      # some 55,000 of order 4
        want = sorted((model["langs"][lang] << 32) + int.from_bytes(g, "big") for lang, ts in texts.items() for g in grams(ts, n))
        assert arrays["p", n][0].tolist() == want and len(arrays["p", n][1]) == len(want)
        assert len(arrays["g", n][0]) == len({(lang, g[:-1]) for lang, ts in texts.items() for g in grams(ts, n)})


def test_languages_are_told_apart(spark):
    texts = [("plumless", "aaaa bbbb aaaa"), ("buckeroo", "cccc aaaa dd"), (None, "aaa")]        # the first two have one CRC-32
    together = quality.train(docs_of(spark, texts))
    for lang, t in texts:
        alone = quality.train(docs_of(spark, [(lang, t)]))
        for probe in [*(x for _, x in texts), "unseen"]:
            assert quality.text_bits(together, [probe.encode()], [lang or ""])[0] == pytest.approx(quality.text_bits(alone, [probe.encode()], [lang or ""])[0], rel=1e-6)
    assert quality.text_bits(together, [b"aaaa"], ["fr"])[0] == 32.0


def test_windows_that_the_model_lacks_back_off(spark):
    """No unseen window takes the value of another one."""
    rnd = random.Random(3)
    model = quality.train(docs_of(spark, [("en", "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)))]))
    arrays, far = quality.opened(model), np.arange(1 << 31, (1 << 31) + 200_000, dtype=np.uint32)      # the first byte isn't ASCII
    assert not quality._find(arrays["p", 4], far.astype(np.uint64), 0.0)[0].any()
