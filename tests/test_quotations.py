import random

import pytest
from pyspark.sql import functions as F

from athenaeum.operators import quotations

WORDS = [f"{a}{b}{c}" for a in ("the", "of", "man", "ration", "pel", "gor") for b in ("", "al", "ty", "ond", "s", "ing") for c in ("", "er", "ly", "um", "ost", "eck", "ab", "oni", "ix", "uth")]
#: Words as often as in prose: the n-th one time in n.
OFTEN = [1 / n for n in range(1, len(WORDS) + 1)]
RARE = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lk", "mn", "rt", "st", "xx", "zz", "pq")]


def changed(quote, n, rng, first=False):
    made = list(quote)
    for k in [*rng.sample(range(len(quote)), n - first), *([0] if first else [])]:
        made[k] = rng.choice("abcxyz ")
    return "".join(made)


@pytest.fixture(scope="module")
def planted(spark):
    """300 texts that share their words; 60 quotations, each whole in two texts and changed in two others, 20 of one to three words."""
    rng = random.Random(11)
    texts, quotes, whole, near = [" ".join(rng.choices(WORDS, OFTEN, k=400)) for _ in range(300)], [], set(), set()
    for i in range(60):
        q = " ".join(rng.choices(WORDS, OFTEN, k=rng.randint(14, 50)) if i < 40 else [*rng.sample(RARE, 1 + i % 3), f"Only{i}"][: 1 + i % 3])
        quotes.append((i, q))
        for w in rng.sample(range(300), 4):
            exactly = len([x for x in whole if x[1] == i]) < 2 or len(q) < 20
            put = q if exactly else changed(q, max(1, len(q) // 25), rng, first=i % 2)
            at = rng.randint(0, len(texts[w]))
            texts[w] = f"{texts[w][:at]} {put} {texts[w][at:]}"
            (whole if exactly else near).add((w, i))
    return spark.createDataFrame(list(enumerate(texts)), "work_id long, text string"), spark.createDataFrame(quotes, "item_id long, q string"), dict(enumerate(texts)), dict(quotes), near


def test_whole_quotations_equal_brute_force(planted):
    texts, quotes, t, q, _ = planted
    got = {tuple(r) for r in quotations.exact(texts, quotes).collect()}
    assert got == {(w, i, t[w].index(q[i]) + 1) for w in t for i in q if q[i] in t[w]}


def test_candidates_are_in_line_with_places(planted):
    """Words are shared by up to all of the texts, yet a quotation meets few: those with its rarest pair, or most of its words."""
    texts, quotes, t, q, near = planted
    long = quotes.filter("item_id < 40")
    hits = sum(q[i] in t[w] for w in t for i in range(40))
    assert quotations.exact_candidates(texts, long).count() <= 3 * hits
    assert quotations.fuzzy_candidates(texts, long).count() <= 5 * (hits + len(near)) < 0.07 * 300 * 40
    assert long.filter(quotations.spoiled(F.col("q")).isNotNull()).count() > 25


def test_changed_quotations_are_found_through_the_query(planted):
    texts, quotes, t, q, near = planted
    got = {(r.work_id, r.item_id) for r in quotations.fuzzy(texts, quotes).collect()}
    exactly = {(w, i) for w in t for i in q if q[i] in t[w]}
    assert exactly <= got
    assert len(near & got) >= 0.9 * len(near) and len(near) > 60


def test_nothing_to_find(spark, planted):
    texts, quotes, *_ = planted
    none = spark.createDataFrame([(1, ""), (2, None), (3, "zzzz yyyy wwww qqqq vvvv")], "item_id long, q string")
    assert quotations.fuzzy(texts, none).count() == 0 and quotations.exact(texts, none.filter("item_id = 3")).count() == 0
    assert quotations.exact(texts.limit(0), quotes).count() == quotations.fuzzy(texts.limit(0), quotes).count() == 0


def test_few_quotations_are_sent_and_texts_never_dealt(spark, planted, monkeypatch):
    """Sent to the texts or dealt to them, quotations are found alike; sent, no text is shuffled or met twice."""
    texts, quotes, *_ = planted
    odd = quotes.selectExpr("cast(item_id AS int) AS item_id", "concat('  ', replace(q, ' ', '\n '), '­') AS q")
    sent = quotations.fuzzy(texts, odd)
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not [x for x in ("Join", "Aggregate", "Repartition", "Generate") if x in plan]
    got = sorted((r.work_id, r.item_id, *r.span) for r in sent.collect())
    monkeypatch.setattr(quotations, "LETTERS", 0)
    assert got == sorted((r.work_id, r.item_id, *r.span) for r in quotations.fuzzy(texts, odd).collect()) and len(got) > 100


def test_repeated_texts_are_found_once_each(spark, planted, monkeypatch):
    texts, quotes, *_ = planted
    once = sorted((r.work_id, r.item_id) for r in quotations.fuzzy(texts.limit(40), quotes).collect())
    for letters in (quotations.LETTERS, 0):
        monkeypatch.setattr(quotations, "LETTERS", letters)
        assert sorted((r.work_id, r.item_id) for r in quotations.fuzzy(texts.limit(40).union(texts.limit(40)), quotes).collect()) == sorted(once * 2)
