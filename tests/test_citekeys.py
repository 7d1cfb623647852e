from types import SimpleNamespace

from athenaeum.plans.text import j12_citekeys


def test_every_work_beyond_the_letters_has_a_key(spark):
    cited = spark.range(40).selectExpr("id AS cited", "'Doe' AS authors", "2001 AS year")
    got = {r.cited: r.key for r in j12_citekeys(SimpleNamespace(cited=cited)).collect()}
    assert len(got) == len(set(got.values())) == 40
    assert got[0] == "Doe2001" and got[1] == "Doe2001a" and got[26] == "Doe2001z"
    assert all(len(got[i]) == len("Doe2001_") + 6 and got[i].startswith("Doe2001_") for i in range(27, 40))
