import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from asoflow.llm.divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, extra=5, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOWER))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        own[None] = {t: sum(own[s][t] for s in sources) for t in kept}
        share = {s: {t: 1 + 10**9 * (c + extra) // (sum(x.values()) + extra * len(kept)) for t, c in x.items()} for s, x in own.items()}
        for s in sources:
            pairs = sorted((-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((share[None][t] - share[s][t], t.encode(), t) for t in kept if own[s][t] > 0 and share[s][t] > share[None][t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("term", "n", "g", "block", "place", "total", "value", "rank", "item")})
    got = source_divergence(df.repartition(4), **settings)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(map(tuple, got.collect()))


def test_equals_a_plain_audit(spark):
    rng = random.Random(3)
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(160)] + ["Élan", "ÉLAN", "日本", "naïve", "A1b2"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(" ".join(rng.choices(words, weights, k=rng.randrange(0, 40))).upper() if rng.random() < 0.2 else " ".join(rng.choices(words, weights, k=rng.randrange(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "é", "Z", None, ""])) for _ in range(500)]
    rows += [(None, "xx", "only"), ("", "xx", "two"), (None, None, None), ("1234 --", "yy", "none"), ("hot " * 50_000, "en", "s1"), rows[0], rows[0]]
    for least in (30, 1):
        assert run(spark, rows, least_docs=least) == plain(rows, least)
    assert run(spark, rows, least_docs=10**6) == plain(rows, 10**6)  # no language keeps a term


def test_many_sources_and_blocks(spark):
    rng = random.Random(5)
    words = ["".join(chr(97 + int(c)) for c in str(k)) for k in range(5000)]
    rows = [(" ".join(rng.choices(words, k=60)), "en", f"s{k % 70}") for k in range(700)]  # two tiles of sources, several blocks of terms
    assert run(spark, rows, least_docs=1, top=7) == plain(rows, 1, top=7)


def test_empty(spark):
    assert source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
