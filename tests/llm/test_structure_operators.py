"""Hard negatives, conversation repair and packing: brute force, round trips and odd rows."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.llm import exact, negatives, packing, repair

WORDS = public_tokenizers.path("word_bpe_49k.json")


# --- exact products --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("scale", [3, 2**26, 2**31, 2**62])
def test_products_are_exact_at_any_size(scale):
    rng = np.random.default_rng(scale % 1000)
    a, b = (rng.integers(-scale, scale, (7, 5)) for _ in range(2))
    want = [[min(max(sum(x * y for x, y in zip(p, q, strict=True)), -(2**63)), 2**63 - 1) for q in b.tolist()] for p in a.tolist()]
    assert exact.products(a, b).tolist() == want
    assert exact.paired(a, b).tolist() == [want[k][k] for k in range(7)]
    assert exact.products(a[:0], b).shape == (0, 7) and exact.paired(a[:0], b[:0]).shape == (0,)


# --- hard negatives --------------------------------------------------------------------------------------------------
def brute_negatives(rows, positives=5, negatives=3, least=50, most=95):
    out, rows = [], sorted(set(rows))
    for i, label, v in rows:
        if i % 50:
            continue
        score = lambda w, v=v: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True))))
        s = [(-score(w), j, m) for j, m, w in rows if j != i and len(w) == len(v)]
        for ps, pj, _ in sorted(x for x in s if x[2] == label)[:positives]:
            found = sorted(x for x in s if x[2] != label and least * -ps <= 100 * -x[0] <= most * -ps)[:negatives]
            out += [(i, pj, k + 1, j, -ps, -n) for k, (n, j, _) in enumerate(found)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>").withColumns({"score": F.lit("clash"), "dim": F.lit(None), "block": F.lit(1)})
    return sorted(map(tuple, negatives.mine(df, F.col("id") % 50 == 0).collect()))


@pytest.mark.parametrize("scale", [3, 2**31])
def test_negatives_equal_brute_force_over_many_blocks(spark, monkeypatch, scale):
    for name, size in (("CELL", 80), ("BLOCK", 80), ("STRIP", 8)):
        monkeypatch.setattr(negatives, name, size)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)), tuple(rng.integers(-scale // 4, scale, 5).tolist())) for i in range(300)] + [(400 + i, i % 3, (scale // 2,) * 5) for i in range(60)]
    rows += rows[:5]  # repeats count once
    got = mined(spark, rows)
    assert got and got == brute_negatives(rows)


def test_negatives_with_one_label_for_a_third_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0 if i % 3 else i, tuple(rng.integers(-9, 30, 4).tolist())) for i in range(200)] + [(1000, 0, (1, 2)), (1050, 1, (2, 2)), (1100, 0, (3, 1))]
    odd = [(None, 1, (1, 1)), (500, None, (1, 1)), (550, 1, None), (600, 1, (1, None)), (650, 1, ())]
    assert mined(spark, rows + odd) == brute_negatives(rows)
    assert mined(spark, odd) == [] and mined(spark, [(0, 1, (1, 1))]) == []


def test_leading_components_discard_rows(monkeypatch):
    """On vectors near a plane, two of sixteen components leave few rows for integer products."""
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    v = np.floor(256 * (rng.normal(size=(2000, 16)) * ([4, 4] + [0.02] * 14)) @ basis.T).astype(np.int64)
    turn = np.linalg.eigh(v.T.astype(float) @ v)[1][:, ::-1]
    ids, label = np.arange(2000), np.zeros(2000, int)
    struct = lambda n, **more: pa.StructArray.from_arrays([pa.array(ids[:n]), pa.array(label[:n]), pa.array(list(v[:n])), *more.values()], ["id", "label", "v", *more])
    ranges = pa.array([[{"low": -(2**63), "high": 2**63 - 1, "floor": -(2**63)}]] * 50)
    seen, whole = [], negatives.paired
    monkeypatch.setattr(negatives, "paired", lambda a, b: (seen.append(len(a)), whole(a, b))[1])
    rows, _, found, score = negatives.scan(negatives.Asked(struct(50, ranges=ranges), turn), negatives.Cell(struct(2000), turn), 5, True)
    assert sum(seen) < 0.02 * 50 * 2000
    full = v[:50] @ v.T
    full[np.arange(50), np.arange(50)] = -(2**62)
    want = [sorted((-s, i) for i, s in enumerate(r))[:5] for r in full.tolist()]
    assert sorted(zip(rows.tolist(), (-score).tolist(), found.tolist(), strict=True)) == sorted((k, s, i) for k, x in enumerate(want) for s, i in x)


# --- conversation repair ---------------------------------------------------------------------------------------------
NEXT = {"": ["user"], "s": ["user"], "u": ["assistant"], "a": ["user"]}


def brute_repair(conv, rows):
    out = []
    for turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in out:
        black = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("blank" if not black else "duplicate" if (role, text) in seen else "truncated" if black[-1] not in ".!?" else None)
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:], strict=False))
    turns = [r[0] for r in out if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

    def closed(best):
        best = dict(best)
        for _ in range(3):
            for end, (cost, audit, lines) in list(best.items()):
                for role in NEXT[end]:
                    new = (cost + 3, audit + "I", lines + [role + ":"])
                    best[role[0]] = min(best.get(role[0], new), new)
        return best

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(out, faults, strict=True):
        new = {}
        for end, (cost, audit, lines) in closed(best).items():
            options = [(end, (cost + 4, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if end + role[:1] in ("s", "u", "su", "ua", "au"):
                    options.append((role[:1], (cost + more, audit + "K", lines + [f"{role}:{text}"])))
                options += [(r[0], (cost + more + 3, audit + "R", lines + [f"{r}:{text}"])) for r in NEXT[end]]
            for k, v in options:
                new[k] = min(new.get(k, v), v)
        best = new
    cost, audit, lines = min(v for k, v in closed(best).items() if k in ("", "a"))
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", None, "u"], ["a.", "b", "  ", None, "", "c!\n", "d?", "e . x", ".", "é. \t"]
    return [(rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(900)]


def test_repair_equals_brute_force_with_nulls_ties_and_repeats(spark, conversations):
    df = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string").withColumns({"fault": F.lit("clash"), "cost": F.lit(1), "place": F.lit(None)})
    got = {r.conv_id: tuple(r) for r in repair.repaired(repair.damaged(df)).collect()}
    by = defaultdict(list)
    for conv, *row in conversations:
        by[conv].append(row)
    assert got == {k: brute_repair(k, v) for k, v in by.items()}
    assert all(re.fullmatch("[DIKR]*", r[7]) for r in got.values())


def test_repair_of_long_texts_long_conversations_and_none(spark):
    long = [(1, k, ["user", "assistant"][k % 2], f"turn {k}.") for k in range(600)] + [(2, 0, "user", "x " * 50_000)]
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0 and k > 2)
    df = spark.createDataFrame(long + [(gone, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r) for r in repair.repaired(repair.damaged(df)).collect()}
    assert got[1] == brute_repair(1, [r[1:] for r in long[:600]]) and got[2] == brute_repair(2, [long[-1][1:]])
    assert got[gone] == (gone, 0, 0, 0, 0, 0, 0, "", "")
    assert repair.repaired(repair.damaged(df.limit(0))).count() == 0


def test_repair_runs_no_python(spark, conversations):
    df = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string")
    plan = repair.repaired(repair.damaged(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning(conv_id") == 1


# --- packing ---------------------------------------------------------------------------------------------------------
ODD = ["It's 3.14, isn't it?  Yes.", "Ünïcödé Straße ΣΊΣΥΦΟΣ İstanbul ﬁ", "é café. naïve,,, a.,b ).", "<|endoftext|> x<|startoftext|>", "漢字 かな 한글 ́ \u0085x y z", "'s 're don't. 12 ½ ²", "x" * 3000, " \t\n", "a\rb\x1cc", "HELLO WORLD.", ". , .", "word... (word). [x], \"q.\""]


def test_words_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(WORDS), packing.Words(WORDS)
    rng = random.Random(5)
    letters = "aAbzZ éÉüßæŒœšž.,.,'’-()0 19½\n\t́Σσ漢\u0085\u00a0\u2003\x1c\x1f\x0b\x0c_"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, words.kind).tobytes() for t in texts]
    for _ in range(2):  # learnt, then remembered
        assert words.ids(pa.array(texts)).to_pylist() == want
    plain = [t for t in texts if not set(t) & set("\x1c\x1d\x1e\x1f")]
    assert words.ids(pa.array(plain), 2).to_pylist() == [np.array([*whole.encode(t, add_special_tokens=False).ids, 2], words.kind).tobytes() for t in plain]
    assert words.ids(pa.array([None, "", "a"]).slice(0, 2)).to_pylist() == [b"", b""]
    assert words.ids(pa.array([], pa.string()), 2).to_pylist() == []


def checked(docs, pieces, window=4096):
    """Holds the pieces against the contract; returns sequences as lists of (doc, length)."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    want = sorted(((k, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in docs), key=str)
    got, rows, by = [], [r.asDict() for r in pieces.collect()], defaultdict(list)
    for r in rows:
        assert len(r["piece_ids"]) == 4 * r["length"] > 0
        by[r["sequence_id"]].append(r)
    for parts in by.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts[:-1]]).tolist()
        used = sum(r["length"] for r in parts)
        assert used == window or used < window and used & (used - 1) == 0
    docs_of = defaultdict(list)
    for r in rows:
        docs_of[r["doc_id"], r["doc_tokens"]].append(r)
    for (k, n), parts in docs_of.items():
        parts.sort(key=lambda r: r["start"])
        times = sum(r["start"] == 0 for r in parts)
        assert sum(r["length"] for r in parts) == n * times
        if times == 1:
            assert [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts[:-1]]).tolist()
            got.append((k, b"".join(bytes(r["piece_ids"]) for r in parts)))
    return want, sorted(got, key=str), by


def test_packing_holds_every_id_once(spark):
    rng = random.Random(6)
    names = "river house road walks north tree stone light".split()
    docs = [(k, " ".join(rng.choice(names) for _ in range(rng.randint(0, 900)))) for k in range(120)] + [(200 + k, t) for k, t in enumerate(ODD)] + [(300, None), (None, "lost key"), (301, "road " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit("clash"), "length": F.lit(0), "uid": F.lit(1)})
    want, got, by = checked(docs, packing.pack(df, WORDS, shard_tokens=20_000))
    assert got == want
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in (sum(r["length"] for r in p) for p in by.values()))
    assert padding == 0
    assert packing.pack(df.limit(0), WORDS).count() == 0


def test_packing_of_repeated_rows_and_of_one_hot_text(spark):
    docs = [(7, "the same text again and again.")] * 3000 + [(8, "another")] * 2 + [(9, "")] * 500
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pieces = packing.pack(df, WORDS, shard_tokens=4096)
    assert pieces.select(F.shiftright("sequence_id", 32)).distinct().count() > 3  # the hot text spreads over shards
    checked(docs, pieces)
    tokens = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert tokens[9] == 500 and tokens[7] % 3000 == 0


def test_sequences_put_pieces_together(spark):
    df = spark.createDataFrame([(k, "tree " * (50 + k)) for k in range(90)], "doc_id long, text string")
    pieces = packing.pack(df, WORDS).cache()
    found = packing.sequences(pieces).collect()
    assert sum(r.used for r in found) == pieces.agg(F.sum("length")).first()[0]
    assert all(len(r.ids) == 4096 or len(r.ids) == r.used and r.used & (r.used - 1) == 0 for r in found)
    assert sum(x == 2 for r in found for x in r.ids[: r.used]) == 90


def test_neighbours_share_windows():
    """Documents of two topics: a window's documents are of its seed's topic while there are any."""
    rng = np.random.default_rng(7)
    topic = [k % 2 for k in range(200)]
    docs = [rng.integers(10 + 500 * t, 60 + 500 * t, 100) for t in topic]
    ids, at = np.concatenate(docs).astype("<u4"), np.arange(201) * 100

    class Stats:
        df, n, average = np.full(2000, 50), 200, 100.0
        idf = np.log1p((n - df + 0.5) / (df + 0.5))

    made = packing.windows(ids, at, Stats, 1000)
    mixed = sum(len({topic[d] for d, _, _ in seq}) > 1 for seq in made)
    assert len(made) == 20 and mixed <= 2


def brute_scores(docs, query, stats):
    out = []
    for d in docs:
        s = 0.0
        for t in set(query):
            tf = d.count(t)
            idf = np.log(1 + (stats.n - stats.df[t] + 0.5) / (stats.df[t] + 0.5))
            s += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / stats.average))
        out.append(s)
    return out


def test_statistics_and_bm25_equal_brute_force(spark):
    rng = random.Random(8)
    names = "river house road walks north tree stone light".split()
    texts = [" ".join(rng.choice(names[: 2 + k % 7]) for _ in range(rng.randint(0, 12))) for k in range(60)]
    tokens = packing.tokenised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), WORDS, 2, "doc_id", "text")
    stats = packing.Statistics(tokens, 49408)
    rows = [np.frombuffer(bytes(r.ids), stats.kind).tolist() for r in tokens.collect()]
    assert (stats.n, stats.total) == (60, sum(map(len, rows)))
    assert {t: int(n) for t, n in enumerate(stats.df) if n} == {t: sum(t in r for r in rows) for r in rows for t in r}
    index = packing.Index(np.concatenate([np.array(r, "<u2") for r in rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), stats)
    for q in (0, 17, 33):
        assert np.allclose(index.scores(q), brute_scores(rows, rows[q], stats), atol=1e-5)
