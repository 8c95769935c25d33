import random
from collections import Counter, defaultdict
from hashlib import sha256

import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from asoflow.llm.alignment import _byte_letters, aligned_tokens, default_models, link_support, op12_tokenizer_alignment
from asoflow.llm.store import stored

SF = "/root/testdata/sf0.001"


class Plain:
    """Whole texts through both libraries, links from all byte ranges."""

    def __init__(self):
        a, b = default_models()
        self.a, self.b, self.letters = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b), _byte_letters()
        self.a.encode_special_tokens = True

    def tokens(self, text):
        if not text:
            return None
        raw = f" {text}".encode()
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(f" {text}", add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return None
        return a, b

    def links(self, text):
        found = self.tokens(text)
        if not found:
            return 0, 0, 0, [], ""
        ranges = []
        for side in found:
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            ranges.append(out)
        a, b = ranges
        pairs = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        groups, lo = [], 0
        for end in sorted({x[2] for x in a} & {x[2] for x in b}):
            groups.append("|".join(",".join(str(x[0]) for x in side if lo < x[2] <= end) for side in ranges))
            lo = end
        return len(a), len(b), len(groups), pairs, ";".join(groups)

    def table(self, rows):
        found = [(i, *self.links(t)) for i, t in rows]
        count = Counter(p for r in found for p in set(r[4]))
        best = defaultdict(int)
        for (a, _), c in count.items():
            best[a] = max(best[a], c)
        return sorted(
            (i if i is not None else -1, na, nb, ng, len(p), sum(count[x] == best[x[0]] for x in p), sum(count[x] for x in p), sha256(g.encode()).hexdigest() if na else "") for i, na, nb, ng, p, g in found
        )


TEXTS = [
    None, "", " ", "a", "a b", "  two  spaces ", "end ", "\n\nline one\n line two\r\n\ttab", "héllo wörld naïve café", "日本語 テキスト と 漢字", "emoji 😀👩‍👩‍👧 flags 🇩🇪", "rare \U00012345 sign", "mark ▁ inside", "▁", "<s> </s> <unk> <|endoftext|> <0x41>",
    "nul \x00 byte", "a b c　d   e", "don't we're I'll 12345 67.89 $%&*", "x" * 3000, "combining é ä ́start", "zero​width ‍ join", "a b", "a b", "tie\x1c sep\x85 next",
]


def test_equals_whole_texts_through_both_libraries(spark):
    rng = random.Random(3)
    letters = "ab é日😀▁ \n\t '1-"
    rows = [*enumerate(TEXTS), *((100 + k, "".join(rng.choices(letters, k=rng.randrange(1, 60)))) for k in range(200)), (None, "no id"), (4, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "pairs": F.lit(1), "groups": F.lit(2)})
    found = stored(aligned_tokens(docs.repartition(3), *default_models()).withColumn("n", F.monotonically_increasing_id()))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    want = Plain().table(rows)
    for few in (10**6, 0):  # broadcast and shuffled pairs
        got = link_support(found, few=few).select(*names, F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).collect()
        assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == want


def test_query_equals_plain_program(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 3000]
    plain = {r[0]: r[:5] + r[7:] for r in Plain().table(short)}
    got = {r["doc_id"]: r for r in op12_tokenizer_alignment(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, want in plain.items():
        r = got[i]
        assert (i, r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == want
    assert all(0 <= r["n_best"] <= r["n_links"] <= r["count_sum"] for r in got.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert link_support(stored(aligned_tokens(docs, *default_models()).withColumn("n", F.monotonically_increasing_id()))).count() == 0


def test_pieces_that_come_again_stay_remembered(monkeypatch):
    from asoflow.llm import alignment

    monkeypatch.setattr(alignment, "_KEPT", 6)
    a, b = alignment.default_models()
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        tool = alignment._Aligner(f.read(), g.read())
    encoded, plain = [], tool.align
    monkeypatch.setattr(tool, "align", lambda pieces: (encoded.extend(pieces), plain(pieces))[1])
    rows = [next(tool.documents([f"often w{k}a w{k}b"])) for k in range(12)]
    assert encoded.count("often") == 1
    assert len(tool.known) + len(tool.older) <= 6 + 2 * 3  # and what two calls added
    assert all(r[:4] == plain([f"often w{k}a w{k}b"])[0][:2] + (r[4].count(";") + 1, int(r[6].sum())) for k, r in enumerate(rows))
