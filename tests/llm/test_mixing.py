import random

import pytest
from pyspark.sql import functions as F

from biosignal.llm.mixing import count_tokens, mixture, plan_of, thresholds

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "k", "h") for r in rows], "doc_id bigint, source string, text string, key string, hash string")


def targets(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], "source string, target_share double, max_repeats int, key string")


def corpus():
    rng = random.Random(3)
    rows = []
    for s, n in (("big", 600), (" Mid\t", 150), ("SMALL", 20)):
        rows += [(len(rows) + k, rng.choice([s, s.lower(), s.upper() + "  "]), "word " * rng.randint(1, 60)) for k in range(n)]
    return rows + [(9001, None, "word"), (9002, "unknown", "word " * 500), (9003, "big", None), (9004, "big", ""), (None, "big", "word")]


def test_shares_and_uses(spark):
    rows = corpus()
    uses, report = mixture(docs(spark, rows), targets(spark, [("big", 0.5, 1), ("Mid", 0.3, 2), ("small", 0.2, 3), ("none", 0.0, 1)]), fit="total")
    rep = {r.source: r for r in report.collect()}
    size = {r[0]: (r[2] or "").count("word") for r in rows if r[0] is not None}
    u = uses.collect()
    own = {s: sum(size[r[0]] for r in rows if r[0] is not None and r[1] and r[1].strip().lower() == s.lower()) for s in ("big", "Mid", "small")}
    total = sum(own.values())
    assert all(abs(rep[s].own_tokens - own[s]) <= len(rows) for s in own)  # a space at the end may be a token of its own
    for s, share, repeats in (("big", 0.5, 1), ("Mid", 0.3, 2), ("small", 0.2, 3)):
        mine = [r for r in u if r.source == s]
        assert max(r.uses for r in mine) <= repeats and len({r.id for r in mine}) == len(mine)
        assert rep[s].used_tokens == sum(r.tokens * r.uses for r in mine)
        if rep[s].reached:
            assert 0 <= rep[s].target_tokens - rep[s].used_tokens <= 62
        else:
            assert rep[s].used_tokens == repeats * rep[s].own_tokens and share * total > repeats * own[s] * 0.9
    assert rep["small"].reached is False and rep["big"].reached and rep["none"].used_tokens == 0
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9


def test_every_source_makes_up_its_share(spark):
    rng = random.Random(5)
    rows = [(k, s, "word " * rng.randint(1, 9)) for k, s in enumerate(["big"] * 3000 + ["mid"] * 800 + ["small"] * 300)]
    want = {"big": (0.5, 1), "mid": (0.3, 2), "small": (0.2, 1), "none": (0.0, 4)}
    t = targets(spark, [(s, *v) for s, v in want.items()])
    uses, report = mixture(docs(spark, rows), t)
    rep = {r.source: r for r in report.collect()}
    assert all(abs(rep[s].actual_share - want[s][0]) < 0.005 for s in want)
    assert rep["small"].used_tokens == rep["small"].own_tokens  # no larger total would do
    assert [rep[s].reached for s in want] == [True, True, False, True]
    used: dict = {}
    for r in uses.collect():
        used[r.source] = used.get(r.source, 0) + r.tokens * r.uses
        assert 1 <= r.uses <= want[r.source][1]
    assert used == {s: rep[s].used_tokens for s in used}
    assert {(r.source, r.reached) for r in plan_of(docs(spark, rows), t).collect()} == {(s, rep[s].reached) for s in want}


def test_larger_budgets_take_supersets(spark):
    rows, got = corpus(), []
    for share in (0.1, 0.4, 0.7):
        uses, _ = mixture(docs(spark, rows), targets(spark, [("big", share, 1)]))
        got.append({r.id for r in uses.collect()})
    assert got[0] < got[1] < got[2]


def test_thresholds_against_sorting(spark):
    rng = random.Random(1)
    d = [(s, rng.randint(1, 50), rng.randrange(1 << 60)) for s in "ab" for _ in range(300)]
    sized = spark.createDataFrame(d, "key string, tokens bigint, hash bigint")
    plan = spark.createDataFrame([("a", 2000), ("b", 10**6)], "key string, rest bigint")
    below = {r.key: r.below for r in thresholds(sized, plan).collect()}
    total, want = 0, set()
    for _, n, h in sorted((x for x in d if x[0] == "a"), key=lambda x: x[2]):
        if total + n > 2000:
            break
        total += n
        want.add(h)
    assert {h for s, _, h in d if s == "a" and h < below["a"]} == want
    assert all(h < below["b"] for s, _, h in d if s == "b")


def test_tokens_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    from biosignal.llm.mixing import PATTERN

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    e = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "a b  c\n\n", "Straße ☂ 你好", "x" * 100_000]
    n = {r.doc_id: r.tokens for r in count_tokens(docs(spark, [(k, "s", t) for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        assert n[k] == (len(e.encode_ordinary(t)) if t else 0)
        if t:
            assert e.decode(e.encode_ordinary(t)) == t


def test_empty(spark):
    uses, report = mixture(docs(spark, []), targets(spark, [("a", 1.0, 2)]))
    assert uses.count() == 0 and report.collect()[0].used_tokens == 0
    uses, report = mixture(docs(spark, corpus()), targets(spark, []))
    assert uses.count() == 0 and report.count() == 0
    assert mixture(docs(spark, corpus()), targets(spark, [("a", None, None)]))[1].where(F.col("reached")).count() == 1
