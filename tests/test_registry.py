import __spark_entry__ as entry
from athenaeum.plans.registry import load

UNSAID = {"d5_similar_pairs_by_signature", "j3_locate_fuzzy", "j18_claims"}


def test_every_query_has_sql_or_a_reason():
    own = set(load())
    assert own - set(entry.oracle_sql()) == UNSAID


def test_flagship(spark):
    assert entry.entry(spark).count() == 50
