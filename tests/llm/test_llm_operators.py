"""The training-data operators on small fixtures: brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from voxloom.llm import chat, langid, lmscore, media, mixing, neardup, pii, quality, spm, topk
from voxloom.llm.lattice import SPACE, Marginals, Vocabulary

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string"
EN, FR = "the house of the river and the road", "la maison de la rivière et le chemin"
ODD = [
    (1, EN, "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, EN, "en", "a"),
    (5, "  \t\n ", "fr", None),
    (6, "x" * 70_000, "en", "b"),
    (7, "▁ a  b\n\n漢字 😀 " * 3, None, "b"),
    (7, FR, "fr", "b"),
    (8, "12345 !!! 67", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("n", F.lit(1)).withColumn("id", F.lit("clash")).withColumn("score", F.lit("x")).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# --- top-k ---------------------------------------------------------------------------------------------------------
def brute_topk(rows, k):
    out = []
    for q, v in rows:
        if q % 20 == 0:
            hits = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("shard,leaves", [(16, 1), (1000, 4)])
def test_topk_equals_brute_force_with_ties_and_copies(spark, shard, leaves):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 5).tolist()) for i in range(150)] + [(i, [2, 2, 2, 2, 2]) for i in range(150, 230)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.search(df, df.filter("vec_id % 20 = 0"), "vec_id", "v", k=7, shard=shard, block=5).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, 7)


def test_topk_leaves_out_unusable_vectors(spark):
    df = spark.createDataFrame([(0, [1, 1]), (1, None), (2, [1, None]), (None, [1, 1]), (3, [2, 0]), (4, [1])], "vec_id long, v array<long>")
    got = topk.search(df, df.filter("vec_id % 20 = 0"), "vec_id", "v", k=3).collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 2)]
    assert topk.search(df.limit(0), df.limit(0), "vec_id", "v").count() == 0


@pytest.mark.parametrize("scale", [10**5, 2**40, 2**62])
def test_topk_of_large_components(spark, scale):
    """Scores near and beyond a long; what lies beyond is the nearest long, so ties there go to the smaller id."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-scale, scale, 8).tolist()) for i in range(90)] + [(200, [scale] * 8), (220, [2 * scale if scale < 2**61 else scale] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.search(df, df.filter("vec_id % 20 = 0"), "vec_id", "v", k=7, shard=16, block=2).collect()
    whole = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = []
    for q, v in rows:
        if q % 20 == 0:
            hits = sorted((-whole(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q)[:7]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_shards_by_space_are_left_out_by_their_bounds(spark, monkeypatch):
    """Eight clusters far apart: most pairs of blocks and shards never meet."""
    rng = np.random.default_rng(5)
    centres = np.eye(8) * 1000
    rows = [(i, (centres[i % 8] + rng.normal(size=8) * 10).astype(int).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(4)
    asked, whole = [], topk.visited
    monkeypatch.setattr(topk, "visited", lambda pairs, *a: (asked.append(pairs.count()), whole(pairs, *a))[1])
    got = topk.search(df, df.filter("vec_id % 20 = 0"), "vec_id", "v", k=5, shard=100, block=4).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, 5)
    blocks = asked[0]
    assert sum(asked) < 0.5 * blocks * 16  # at least sixteen shards


# --- language -------------------------------------------------------------------------------------------------------
def test_language_words_then_shorter_grams(spark):
    rows = [(i, EN if i % 2 else FR, "en" if i % 2 else "fr", "s") for i in range(40)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    score = langid.Scorer(model)
    assert score("the river")[0] == "en" and score("la rivière")[0] == "fr"
    assert score("rivièrement")[0] == "fr"  # unseen: decided by its n-grams
    assert "zq" not in model.words and langid.Model(["a"], ({}, np.zeros((0, 1))), ({"z": 0}, np.array([[1.0]])), np.zeros(1)).row("zq").tolist() == [1.0]


def test_language_odd_rows(odd, empty):
    found = {(r.doc_id, r.text): (r.lang_pred, r.lang_score) for r in langid.predict(odd, langid.train(odd)).collect()}
    assert len(found) == len(ODD)
    for text in (None, "", "  \t\n ", "12345 !!! 67"):
        assert {v for (_, t), v in found.items() if t == text} == {("und", 0.0)}
    assert all(0 <= s <= 1 for _, s in found.values())
    assert {r.lang_pred for r in langid.predict(odd, langid.train(empty)).collect()} == {"und"}
    assert langid.predict(empty, langid.train(odd)).count() == 0


def test_numbers_are_no_letters(spark):
    assert langid.words_of("½ ² ① 12 _") == [] and langid.words_of("A½b ²") == ["a½b"]
    model = langid.train(spark.createDataFrame([(1, EN, "en", "a"), (2, "½ ²", "en", "a")], DOCS))
    assert langid.Scorer(model)("½ ²") == ("und", 0.0) and langid.Scorer(model)("é")[0] == "en"


def test_language_names_and_columns_that_clash(spark):
    rows = [(i, EN if i % 2 else FR, "item" if i % 2 else "a`b", "s") for i in range(8)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"_lang": F.lit(1), "lang_pred": F.lit("old"), "a.b`c": F.lit(2)})
    got = langid.predict(docs, langid.train(docs))
    assert got.columns == ["doc_id", "text", "lang", "source", "_lang", "a.b`c", "lang_pred", "lang_score"]
    assert all(r.lang_pred == r.lang and r._lang == 1 for r in got.collect())


def test_a_rare_language_stays_in_a_small_sample(spark):
    rows = [(i, EN, "en", "s") for i in range(600)] + [(1000 + i, FR, "fr", "s") for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.train(docs, max_rows=20, least_rows=5)
    assert model.langs == ["en", "fr"] and np.exp(model.prior) == pytest.approx([600 / 603, 3 / 603])
    assert langid.Scorer(model)("la rivière")[0] == "fr"
    found = langid.sampled(docs.select("lang", F.col("doc_id").alias("key"), F.col("text").alias("item")), {"en": 600, "fr": 3}, 20, 5, 7).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in found}["fr"] == 3 and {r.lang: r["count"] for r in found}["en"] < 60


def test_language_scores_equal_brute_force(spark):
    rng = random.Random(8)
    make = {"en": "river house road the and of walks".split(), "fr": "rivière maison chemin le la et marche".split(), "de": "fluss haus weg der die und geht".split()}
    texts = [(i, " ".join(rng.choice(make[x]) + rng.choice(["", "", "s", "n"]) for _ in range(1 + i % 9)), x, "s") for i, x in enumerate(rng.choices(list(make), k=120))]
    learn, asked = texts[:80], [t for _, t, _, _ in texts[80:]] + ["Riverside 12", "xq", "le the"]
    words, pieces = {}, {}
    for _, t, x, _ in learn:
        for w in t.split():
            words.setdefault(w, {}).setdefault(x, []).append(1)
            for n in range(1, 6):
                for g in list(w) if n == 1 else [f"<{w}>"[k : k + n] for k in range(len(w) + 3 - n)]:
                    pieces.setdefault(g, {}).setdefault(x, []).append(1)
    langs = sorted(make)
    total = lambda table, x: sum(len(v.get(x, ())) for v in table.values())
    log = lambda table, item, x: math.log((len(table[item].get(x, ())) + 0.5) / (total(table, x) + 0.5 * len(table)))

    def of_word(w, x):
        if w in words:
            return log(words, w, x)
        for n in range(5, 0, -1):
            known = [g for g in (list(w) if n == 1 else [f"<{w}>"[k : k + n] for k in range(len(w) + 3 - n)]) if g in pieces]
            if known:
                return sum(log(pieces, g, x) for g in known) / len(known)
        return 0.0

    scorer = langid.Scorer(langid.train(spark.createDataFrame(learn, DOCS)))
    for t in asked:
        ws = re.findall("[a-zè]+", t.lower())
        prior = {x: math.log(sum(r[2] == x for r in learn) / len(learn)) for x in langs}
        sums = {x: sum(of_word(w, x) for w in ws) for x in langs}
        best = max(langs, key=lambda x: prior[x] + sums[x])
        z = {x: prior[x] + sums[x] * min(len(ws), 20) / len(ws) for x in langs}
        p = math.exp(z[best]) / sum(math.exp(v) for v in z.values())
        assert scorer(t)[0] == best and scorer(t)[1] == pytest.approx(p)


# --- mixing ---------------------------------------------------------------------------------------------------------
def mixing_docs(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "big" if i % 10 else f"s{i % 30}") for i in range(600)]
    return spark.createDataFrame(rows, DOCS)


def test_mixing_meets_the_repetition_limit(spark):
    docs = mixing_docs(spark)
    got = mixing.mixture(docs, repeats=2.0, block_docs=16).toPandas()
    sizes = {r.source: r.t for r in docs.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("t")).collect()}
    used = got.groupby("source").mix_tokens.sum()
    ratio = {s: used[s] / sizes[s] for s in sizes}
    assert set(got.doc_id) == set(range(600))  # the default budget uses everything once
    assert max(ratio.values()) / min(ratio.values()) == pytest.approx(2.0, rel=0.05)
    p = np.array([sizes[s] / sum(sizes.values()) for s in sizes])
    t = 1 - math.log(2.0) / math.log(p.max() / p.min())
    w = p**t / (p**t).sum()
    assert [got[got.source == s].mix_weight.iloc[0] for s in sizes] == pytest.approx(w.tolist(), rel=1e-6)
    assert got.groupby("doc_id").mix_copy.apply(lambda c: sorted(c) == list(range(len(c)))).all()
    assert got.mix_place.between(0, 1).all()


def test_mixing_entropy_target_and_budget(spark):
    docs = mixing_docs(spark)
    sources = mixing.shares(docs.select("source", mixing.token_count(F.col("text")).alias("t")), "source", "t")
    t = mixing.exponent(sources, entropy=0.9)
    p = np.array([r.share for r in sources.collect()])
    w = p**t / (p**t).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9 * math.log(len(p)), abs=1e-6)
    got = mixing.mixture(docs, entropy=0.9, budget=600, block_docs=16).toPandas()
    for s, g in got.groupby("source"):
        quota = g.mix_weight.iloc[0] * 600
        assert quota - 6 <= g.mix_tokens.sum() <= quota + 6


def test_every_copy_has_the_whole_source_in_a_new_order(spark):
    docs = mixing_docs(spark)
    got = mixing.mixture(docs, repeats=3.0, block_docs=16).toPandas()
    sizes = {r.source: r.t for r in docs.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("t")).collect()}
    weight = got.groupby("source").mix_weight.first()
    budget = max(sizes[s] / weight[s] for s in sizes)
    orders = []
    for s, g in got.groupby("source"):
        quota = weight[s] * budget
        g = g.sort_values("mix_place", kind="stable")
        # brute force: end to end, every document starts where the one before it ended
        assert (g.mix_place * quota).tolist() == pytest.approx((g.mix_tokens.cumsum() - g.mix_tokens).tolist(), abs=1e-3)
        assert quota - 1e-3 <= g.mix_tokens.sum() < quota + g.mix_tokens.max()
        for c in range(int(quota // sizes[s])):
            one = g[g.mix_copy == c]
            assert sorted(one.doc_id) == sorted(r.doc_id for r in docs.filter(F.col("source") == s).collect())
            if len(one) > 10:
                orders.append((s, one.doc_id.tolist()))
    again = [(a, b) for k, (s, a) in enumerate(orders) for t, b in orders[k + 1 :] if s == t]
    assert again and all(a != b for a, b in again)
    place = {c: {i: k for k, i in enumerate(c)} for c in map(tuple, again[0])}
    blocks = [[next(iter(place))[k] for k in range(n, n + 5)] for n in (0, 10)]
    other = place[tuple(again[0][1])]
    assert any(max(other[i] for i in b) - min(other[i] for i in b) > 5 for b in blocks)  # within blocks, too


def test_mixing_columns_that_clash(spark):
    docs = mixing_docs(spark).withColumns({"_tokens": F.lit("a"), "_source": F.lit("b"), "mix_copy": F.lit("old"), "x.y": F.lit(3)})
    got = mixing.mixture(docs, repeats=2.0)
    assert got.columns == ["doc_id", "text", "lang", "source", "_tokens", "_source", "x.y", *mixing.MIX]
    assert {(r._tokens, r._source, r["x.y"]) for r in got.collect()} == {("a", "b", 3)}


def test_mixing_odd_rows(odd, empty):
    got = mixing.mixed(odd, repeats=1.5)
    assert got.columns == odd.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(a, b) for a, b, _, _ in ODD}
    assert mixing.mixed(empty, repeats=1.5).count() == 0


# --- personal data ---------------------------------------------------------------------------------------------------
RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, raw):
    digits = re.sub("[^0-9]", "", raw)
    if kind == "ip":
        return all(int(p) <= 255 for p in raw.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    return [(k, *m.span()) for k, rule in RULES.items() for m in rule.finditer(text) if valid(k, m.group())]


def test_base_spans_equal_the_rules():
    rng = random.Random(5)
    fixed = ["a@b.c@d.e x@y@z.w", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.004", "4111 1111-1111 1111", "+1 (988) 555-2485", "a@b..c", "a@b.c.", "0" * 40, "+1..........2"]
    made = ["".join(rng.choice("ab1290@@..+-() %_") for _ in range(60)) for _ in range(3000)]
    for text in fixed + made:
        assert pii.base_spans(text) == brute_spans(text), text


def test_base_spans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000):
        pii.base_spans(text)


def test_judge_adds_spans_and_redacts(spark):
    rng = random.Random(2)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(i, f"call me on phone +1 {number()} now" if i % 2 else f"version token {rng.randint(10**7, 10**8)} of it", None, None) for i in range(800)]
    docs = spark.createDataFrame([*rows, (900, None, None, None), (901, "", None, None)], DOCS)
    judge = pii.train(docs)
    found = {r.doc_id: r for r in pii.find(docs, judge).collect()}
    assert all(len(found[i].pii_base) == i % 2 and len(found[i].pii_spans) >= len(found[i].pii_base) for i in range(800))
    assert found[900].pii_spans == [] and found[901].pii_spans == []
    assert sum(len(found[i].pii_spans) for i in range(0, 800, 2)) == 0  # clean texts stay as they are
    texts = {r.doc_id: r.text for r in pii.redact(docs, judge).collect()}
    assert "[PHONE]" in texts[1] and "555" not in texts[1].replace("[PHONE]", "") and texts[900] is None
    assert texts[0] == rows[0][1]


def test_judge_adds_spans_that_no_base_rule_finds(spark):
    rng = random.Random(3)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    word = lambda: "".join(rng.choices("aeinrst", k=5))
    kinds = (lambda: f"call me on phone +1 {number()} now", lambda: f"contact me by mail {word()}.{rng.randint(1, 99)}@{word()}{rng.randint(1, 9)}.example.com now", lambda: f"version token {rng.randint(10**7, 10**8)} of it", lambda: f"{word()} {word()} {word()} {word()} {word()}")
    docs = spark.createDataFrame([(i, kinds[i % 4](), None, None) for i in range(4000)], DOCS)
    judge = pii.train(docs)
    planted = {"you reach me by mail name (at) host (dot) org now": "you reach me by mail [EMAIL] now", "call me on phone 555-123-4567 now": "call me on phone [PHONE] now"}
    clean = ["version token 12345678 of it", "look at the dot matrix of it", "we are here since 2024-01-15 or so", 'token = "a95f8013a8e106335957369e74af1c8"']
    rows = spark.createDataFrame([(i, t, None, None) for i, t in enumerate([*planted, *clean])], DOCS)
    assert not any(r.pii_base for r in pii.find(rows, judge).collect())
    assert [r.text for r in pii.redact(rows, judge).orderBy("doc_id").collect()] == [*planted.values(), *clean]


def test_added_spans_on_forms_that_training_does_not_make(spark):
    """Held against spans marked by hand, in forms other than ``rewritten`` gives; few documents open the thresholds."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("aeinrstlo", k=6))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    kinds = (
        lambda: f"{word()} +{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)} {word()}", lambda: f"{word()} {word()}.{word()}@{word()}.example.com {word()}", lambda: f"{word()} {rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)} {word()}",
        lambda: f"version {digits(8)} {word()} {word()}", lambda: f"{word()} {word()} page {digits(9)} {word()}", lambda: " ".join(word() for _ in range(9)), lambda: f"{word()} 4111 1111 1111 1111 {word()}",
    )
    docs = spark.createDataFrame([(i, kinds[i % 7](), None, None) for i in range(1400)], DOCS)
    judge = pii.train(docs)
    assert sum(t <= 1 for t in judge.threshold.values()) >= 3  # 200 documents a kind are enough
    marked = [
        ("please write to |jane.roe <at> uni <dot> edu| soon", "email"), ("reach |tom[at]mail[dot]net| or me", "email"), ("it is |bob@ home . org| for now", "email"), ("so |(212) 555.0199| rings", "phone"), ("ring |030 1234-5678| now", "phone"),
        ("the |555 867 5309| line", "phone"), ("at |10 . 20 . 30 . 40| it runs", "ip"), ("paid by |4111.1111.1111.1111| then", "card"), ("or |4111/1111/1111/1111| then", "card"),
    ]
    clean = ["we met at the dot of noon", "in 1999 to 2004 it rained", "page 12345678 of it", "isbn 978-3-16-148410-0 it is", "a total 12,345,678 of it", "numbers 9807915762804490 fail", "look at site map", "version 10.4.7 came", "key=9f8e7d6c5b4a39281706 x"]
    hits = wrong = 0
    for text, kind in marked:
        before, raw, _ = text.split("|")
        spans = judge.spans(text.replace("|", ""))[1]
        hits += (kind, len(before), len(before) + len(raw)) in spans
        wrong += sum((s, e) != (len(before), len(before) + len(raw)) for _, s, e in spans)
    wrong += sum(len(judge.spans(t)[1]) for t in clean)
    assert hits >= 6 and wrong <= 1, (hits, wrong, judge.threshold)


def test_the_judge_learns_from_all_documents(spark):
    text = "if(id % 600 = 0, concat('we ask 10.', id % 251, '.', id % 13, '.7 for more'), concat('plain words are here as number ', id))"
    judge = pii.train(spark.range(60_000).selectExpr("id doc_id", f"{text} text", "null lang", "null source"))
    assert judge.threshold["ip"] <= 1  # a third of the hundred addresses would be too few


def test_overlaps_are_found_by_place():
    taken = pii.merged([(5, 9), (7, 12), (20, 22), (12, 14)])
    assert taken == [(5, 12), (12, 14), (20, 22)]
    for s, e in itertools.combinations(range(25), 2):
        assert pii.apart(s, e, taken) == all(e <= a or b <= s for a, b in taken)
    judge = pii.Judge(None, {})
    text = "a@b.cd " * 20_000
    assert len(judge.spans(text)[0]) == 20_000 and len(pii.examples(text)) >= 20_000


def test_pii_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd")], "doc_id long, text string").withColumns({"_pii": F.lit(5), "pii_spans": F.lit("old"), "a.b": F.lit(1)})
    got = pii.find(docs, pii.Judge(None, {}))
    assert got.columns == ["doc_id", "text", "_pii", "a.b", "pii_base", "pii_spans"] and got.first()._pii == 5


def test_pii_odd_rows(odd, empty):
    judge = pii.train(odd)
    assert pii.find(odd, judge).count() == len(ODD)
    assert pii.redact(odd, judge).columns == odd.columns
    assert pii.find(empty, pii.train(empty)).count() == 0


def test_mixing_keeps_the_last_short_documents_of_a_huge_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "token_count", lambda c: F.when(c == "huge", F.lit(10**10)).otherwise(F.lit(1)).cast("long"))
    docs = spark.createDataFrame([(i, "huge" if i == 0 else f"w{i}", "en", "a") for i in range(9)], DOCS)
    assert sorted(r.doc_id for r in mixing.mixed(docs, repeats=5.0).collect()) == list(range(9))


# --- quality ---------------------------------------------------------------------------------------------------------
def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], cycles=20, pair_cycles=40, pairs=2)
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.9


def test_quality_score_is_the_sum_of_its_tables():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(500, 4)), 1)
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), cycles=15, pair_cycles=15, pairs=3)
    for row, got in zip(x[:60], model.score(x[:60]), strict=True):
        at = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        z = model.base + sum(t[k] for t, k in zip(model.tables, at, strict=True)) + sum(t[ci[at[i]]][cj[at[j]]] for (i, j, ci, cj), t in model.pairs)
        assert got == pytest.approx(1 / (1 + math.exp(-z)))


def test_quality_takes_one_text_of_a_repeated_key(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, 7)], "doc_id long, quality int")
    assert quality.score(docs, quality.train(docs, labels)).count() == 4


def test_quality_on_texts(spark, odd, empty):
    good, bad = "The river runs. It is wide, and calm. ", "BUY!! NOW!! BUY!! NOW!! "
    docs = spark.createDataFrame([(i, (good if i % 3 else bad) * (1 + i % 7), "en", "a") for i in range(300)], DOCS)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    model = quality.train(docs, labels.filter("doc_id < 200"))
    got = quality.score(docs, model).toPandas()
    assert ((got.quality_score >= 0.3) == (got.doc_id % 3 != 0)).all()
    assert quality.score(odd, model).filter("quality_score between 0 and 1").count() == len(ODD)
    none = quality.train(empty, labels.limit(0))
    assert {r.quality_score for r in quality.score(odd, none).collect()} == {0.5}


# --- language model --------------------------------------------------------------------------------------------------
def test_lattice_marginal_equals_all_segmentations():
    v = Vocabulary(VOCABULARY)
    m = Marginals(v)
    p = np.exp(m.scores)
    for word in (SPACE + "the", SPACE + "river", "aé", "xx漢"):
        total = 0.0
        for cut in itertools.product((0, 1), repeat=len(word) - 1):
            parts, at = [], 0
            for k, c in enumerate([*cut, 1]):
                if c:
                    parts.append(word[at : k + 1])
                    at = k + 1
            weight = 1.0
            for part in parts:
                if part in v.pieces:
                    weight *= p[v.pieces[part]]
                elif len(part) == 1:
                    weight *= p[v.byte_ids[0]] ** len(part.encode())
                else:
                    weight = 0.0
            total += weight
        assert m.log_probability([word])[0] == pytest.approx(math.log(total), rel=1e-9)


def test_the_prior_of_words_is_a_probability():
    v = Vocabulary(VOCABULARY)
    p = np.exp(v.zipf())
    assert p.sum() == pytest.approx(1)
    starts = np.array([k for piece, k in v.pieces.items() if piece.startswith(SPACE)])
    a = p[starts].sum()
    b = p.sum() - a
    assert 0 < a < 1 and a / (1 - b) <= 1 + 1e-9  # the sum over all words


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_lm_scores_equal_brute_force(spark, common):
    texts = [(1, "The cat the DOG"), (2, "cat unseenword"), (3, None), (4, "  a\tb\n"), (5, "cat é cat"), (5, "cat é cat")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("learn", F.col("doc_id") != 2).withColumn("word", F.lit(1)).withColumn("n_known", F.col("text"))
    docs = docs.withColumn("copy", F.col("text"))
    got = lmscore.score(docs, "learn", VOCABULARY, common=common).toPandas()
    assert len(got) == len(texts)
    words = lambda t: [w.decode() for w in lmscore.tokens(t)]
    count: dict = {}
    for d, t in texts:
        for w in [*words(t), " "] if d != 2 else ():
            count[w] = count.get(w, 0) + 1
    n, v, once = sum(count.values()), len(count), max(1, sum(c == 1 for c in count.values()))
    lat = Marginals(Vocabulary(VOCABULARY))
    prior = lambda w: float(lat.log_probability([SPACE + w if w != " " else SPACE])[0])
    for r in got.itertuples():
        ws = [*words(r.copy), " "]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws))
        assert r.lm_score == pytest.approx(sum(math.log10((count.get(w, 0) + once * math.exp(prior(w))) / (n + once)) for w in ws))


def test_lm_odd_rows(odd, empty):
    got = lmscore.score(odd.withColumn("learn", F.lit(True)), "learn", VOCABULARY)
    assert got.count() == len(ODD) and got.filter("lm_score is null or base_score is null").count() == 0
    assert lmscore.score(empty.withColumn("learn", F.lit(True)), "learn", VOCABULARY).count() == 0


# --- pieces ----------------------------------------------------------------------------------------------------------
def brute_best(v, text):
    """Score of the best segmentation of the marked text, piece by piece."""
    t = spm.marked(text)
    best = [0.0] + [-math.inf] * len(t)
    for i in range(len(t)):
        for size in range(1, min(v.longest, len(t) - i) + 1):
            part = t[i : i + size]
            w = v.scores[v.pieces[part]] if part in v.pieces else v.byte_score * len((SPACE if part == "\udc81" else part).encode()) if size == 1 else -math.inf
            best[i + size] = max(best[i + size], best[i] + w)
    return best[-1]


TEXTS = ["the river runs", "▁ x  y\n\nz\t漢字😀 é", " ", "a" * 500, "including\n" * 90, "the river " * 120, "\n\n" * 200, "é漢 " * 150]


def test_encoding_is_best_and_decodes(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None, ""])], "doc_id long, text string")
    v = Vocabulary(VOCABULARY)
    whole = {r.doc_id: r for r in spm.decode(spm.encode(docs, VOCABULARY), VOCABULARY).collect()}
    cut = {r.doc_id: r for r in spm.decode(spm.encode(docs, VOCABULARY, giant=60, chunk=40), VOCABULARY).collect()}
    for i, t in enumerate(TEXTS):
        for got in (whole[i], cut[i]):
            assert got.decoded == t
            assert got.piece_score == pytest.approx(brute_best(v, t))
            assert got.piece_score == pytest.approx(v.scores[got.ids].sum())
    for i in (len(TEXTS), len(TEXTS) + 1):
        assert whole[i].ids == [] and whole[i].decoded == "" and cut[i].ids == []


def test_scan_is_associative():
    rng = np.random.default_rng(4)
    a, b, c = rng.normal(size=(3, 5, 5))
    assert np.allclose(spm.combine(spm.combine(a, b), c), spm.combine(a, spm.combine(b, c)))


def test_pieces_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c " * 20_000, "y")], "doc_id long, text string, ids string").withColumn("piece_score", F.lit("z"))
    got = spm.encode(docs, VOCABULARY, decoded="back")
    assert got.columns == ["doc_id", "text", "ids", "piece_score", "back"] and got.filter("back = text").count() == 2


def test_pieces_odd_rows(odd, empty):
    got = spm.decode(spm.encode(odd, VOCABULARY), VOCABULARY)
    assert got.count() == len(ODD)
    assert got.filter(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    assert spm.encode(empty, VOCABULARY).count() == 0


# --- media -----------------------------------------------------------------------------------------------------------
def test_media_store_and_read(spark, odd, tmp_path):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij \n") for _ in range(300_000))
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(20, long), (21, "x" + long), (22, long)], "doc_id long, text string"))
    path = f"file://{tmp_path}/store"
    media.store(docs, path)
    got = media.read(spark, path).toPandas()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(texts)
    rows = {(r.key, r.payload_sha256): r for r in got.itertuples()}
    for k, t in texts:
        n, p = media.padded(t, 576)
        r = rows[k, hashlib.sha256(p).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, len(p), zlib.crc32(p[-32:])) and len(p) % 576 == 0
        assert r.media_sha256 == hashlib.sha256(media.wave_header(len(p)) + p).hexdigest() and r.media_bytes == len(p) + 44
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    shared = len(media.cuts(media.padded(long, 576)[1]))
    parts = spark.read.parquet(f"{path}/media").filter("of > 1").select("digest").distinct().count()
    assert parts < 2 * shared  # the shifted copy shares all chunks after the first cut
    back = {bytes(r.payload) for r in media.payloads(spark, path).collect()}
    assert back == {media.padded(t, 576)[1] for _, t in texts}


@pytest.mark.parametrize("hot", [2, 1000])
def test_media_chunks_are_shared_across_documents(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(media, "HOT_LEAST", hot)
    monkeypatch.setattr(media, "HOT_SHARE", 10**9)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common = text(24_000)
    docs = [(k, text(50 + 37 * k) + common + text(700)) for k in range(12)] + [(20, common), (21, common), (22, text(3_000))]
    path = f"file://{tmp_path}/store"
    media.store(spark.createDataFrame(docs, "doc_id long, text string"), path)
    chunks = spark.read.schema(media.CHUNKS).parquet(f"{path}/chunks")
    assert chunks.filter("shared = 1").count() >= 3
    kept = sum(sum(r.sizes) for r in chunks.filter("shared = 0").collect())
    whole = sum(len(media.wave(media.padded(t, 576)[1])) for _, t in docs)
    assert kept < whole / 3  # the common passage is stored apart, once
    got = {r.key: r for r in media.read(spark, path).collect()}
    for k, t in docs:
        stored = media.wave(media.padded(t, 576)[1])
        assert got[k].media_sha256 == hashlib.sha256(stored).hexdigest() and got[k].media_bytes == len(stored)
    assert {r.key: bytes(r.payload) for r in media.payloads(spark, path).collect()} == {k: media.padded(t, 576)[1] for k, t in docs}


def test_damaged_chunk_fails(spark, tmp_path):
    media.store(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), f"file://{tmp_path}/a")
    for name in ("media", "rows", "chunks"):
        df = spark.read.parquet(f"file://{tmp_path}/a/{name}")
        if name == "chunks":
            df = df.withColumn("body", F.lit(zstandard.compress(b"other")))
        df.write.parquet(f"file://{tmp_path}/b/{name}")
    with pytest.raises(Exception, match="damaged"):
        media.read(spark, f"file://{tmp_path}/b").collect()


def test_missing_chunk_of_a_short_payload_fails(spark, tmp_path):
    media.store(spark.createDataFrame([(1, "abc"), (2, "def")], "doc_id long, text string"), f"file://{tmp_path}/a")
    assert media.read(spark, f"file://{tmp_path}/a").count() == 2
    for name in ("media", "rows", "chunks"):
        df = spark.read.parquet(f"file://{tmp_path}/a/{name}")
        (df.orderBy("digest").limit(1) if name == "chunks" else df).write.parquet(f"file://{tmp_path}/b/{name}")
    with pytest.raises(Exception, match="missing chunk"):
        media.read(spark, f"file://{tmp_path}/b").collect()


def test_cuts_follow_content():
    rng = random.Random(9)
    data = bytes(rng.randrange(256) for _ in range(400_000))
    a, b = media.cuts(data), media.cuts(b"12345" + data)
    assert a[-1] == len(data) and all(y - x <= media.MOST for x, y in zip([0, *a], a, strict=False))
    assert len({x + 5 for x in a} & set(b)) >= len(a) - 2
    assert media.gear_hash(np.frombuffer(data, np.uint8))[500] == media.gear_hash(np.frombuffer(data[400:501], np.uint8))[-1]


# --- near duplicates ---------------------------------------------------------------------------------------------------
def brute_groups(rows, width, threshold):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + min(width, len(w))]) for k in range(max(0, len(w) - min(width, len(w)) + 1))} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("small,levels,node_block,set_block", [(64, 5, 512, 128), (3, 3, 4, 3), (2, 1, 3, 8)])
def test_near_duplicates_equal_brute_force(spark, small, levels, node_block, set_block):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(80)] for _ in range(6)]
    rows = []
    for i in range(220):
        t = list(base[i % 6]) if i % 3 else [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t).upper() if i % 7 == 0 else " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component for r in neardup.near_duplicates(docs, words=3, threshold=85, small=small, levels=levels, node_block=node_block, set_block=set_block).collect()}
    assert got == brute_groups(rows, 3, 85)


def test_main_part_of_a_cluster():
    masks, n = np.array([0b0011, 0b0110, 0b1000, 0b10000]), np.array([2, 2, 3, 1])
    assert neardup._main_part(masks, n) == 0b0111
    assert neardup._main_part(masks[:0], n[:0]) == 0


def test_near_duplicates_odd_rows(odd, empty):
    got = sorted((r.id, r.component) for r in neardup.near_duplicates(odd).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 1), (5, 5), (6, 6), (7, 7), (7, 7), (8, 8)]
    assert sorted({r.doc_id for r in neardup.kept_one_each(odd).collect()}) == [1, 2, 3, 5, 6, 7, 8]
    assert neardup.near_duplicates(empty).count() == 0


def test_block_comparison_counts_exactly():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j, strict=True)]
    assert neardup.shared_counts(sets, i, j).tolist() == want and neardup.shared_counts(sets, i[:9], j[:9]).tolist() == want[:9]


# --- chat --------------------------------------------------------------------------------------------------------------
NODES = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def test_reply_tree_paths_and_ranks(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 0.1), (1, 3, 1, "assistant", "b", 0.9), (1, 4, 3, "user", "c", 0.5), (1, 5, 4, "assistant", "d", 0.5), (2, 1, 1, "user", "loop", 0.0), (3, 1, 2, "user", "x", 0.0), (3, 2, 3, "user", "y", 0.0), (3, 3, 2, "user", "z", 0.0)]
    df = spark.createDataFrame(rows, NODES)
    got = {(r.tree_id, r.branch): (r.formatted, r.loss_spans) for r in chat.format_paths(df, best=2).collect()}
    assert set(got) == {(1, 1), (1, 2)}  # trees 2 and 3 run in cycles
    text, spans = got[1, 1]
    assert [text[s.start : s.end] for s in spans] == ["b", "d"] and text.count("</turn>") == 4
    assert [got[1, 2][0][s.start : s.end] for s in got[1, 2][1]] == ["a"]


def test_chat_escapes_are_reversible(spark):
    bad = [r"\### Assistant: </turn> ok", "\\b\\h\\l\\c", "### user: x</turn>\n", "", None, "a: b\n\n</turn>\n### x: y", "é😀<#:\\"]
    rows = [(5, t, role, text) for t, (text, role) in enumerate(itertools.product(bad, ("user", "assistant", "a: b", None)))]
    convs = spark.createDataFrame([*rows, (6, None, "user", "t"), (None, 1, "user", "t")], "conv_id long, turn long, role string, text string")
    got = {r.tree_id: r for r in chat.format_paths(chat.linear_nodes(convs)).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.under_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(t.role, t.text) for t in got[5].turns] == [(r or "", x or "") for _, _, r, x in rows]
    assert got[5].loss == "".join(x or "" for _, _, r, x in rows if r == "assistant")
    assert len(got[6].turns) == 1 and set(got) == {5, 6}
    assert chat.format_paths(chat.linear_nodes(convs.limit(0))).count() == 0


def test_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(100)]
    got = chat.format_paths(chat.linear_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [s.strip() for s in got.formatted.split("</turn>")[:-1]] == [f"### {r}: {t}" for _, _, r, t in rows]


@pytest.mark.parametrize("turns", [3, 5, 300])
@pytest.mark.parametrize("beside", [False, True])
def test_conversation_with_most_of_the_nodes(spark, turns, beside):
    rows = [(1, t, "user", f"t{t}") for t in range(turns)] + [(-7, t, "user", "x") for t in range(2)] * beside
    got = chat.format_paths(chat.linear_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r.tree_id: r.formatted.count("</turn>") for r in got} == {1: turns} | ({-7: 2} if beside else {})


def test_leaf_into_cycle_beside_long_conversation(spark):
    rows = [(1, t, t - 1, "user", "x", 0.0) for t in range(5)] + [(2, 1, 2, "user", "x", 0.0), (2, 2, 1, "user", "x", 0.0), (2, 3, 2, "user", "x", 0.0)]
    got = chat.format_paths(spark.createDataFrame(rows, NODES)).collect()
    assert [(r.tree_id, r.formatted.count("</turn>")) for r in got] == [(1, 5)]
