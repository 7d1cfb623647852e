import pytest
from pyspark.sql import functions as F

from athenaeum.functions import references


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r"))
    return [r.r for r in rows.orderBy("i").collect()]


ENTRIES = {
    "Smith, J., & Jones, K. (2020). Deep ice of the north. Journal of Ice, 12(3), 4-5. https://doi.org/10.1234/AB.c": ("10.1234/ab.c", None, 2020, "Smith, J., & Jones, K", "Deep ice of the north", "Journal of Ice"),
    "[1] Smith J. Deep ice of the north. Journal of Ice. 2019;1:3-4.": (None, None, 2019, "Smith J", "Deep ice of the north", "Journal of Ice"),
    "Anders K. Models of seas. Press. doi:10.5555/xyz.": ("10.5555/xyz", None, None, "Anders K", "Models of seas", "Press"),
    "Team. A page about ice (2021). https://ice.example.org/a.html.": (None, "https://ice.example.org/a.html", 2021, "Team. A page about ice", None, None),
    "Only words without any order": (None, None, None, None, "Only words without any order", None),
    "Doe, A. (1950). Old work": (None, None, 1950, "Doe, A", "Old work", None),
    "": (None, None, None, None, None, None),
}


def test_entries_are_parsed(spark):
    assert [tuple(r) for r in column(spark, list(ENTRIES), references.parsed)] == list(ENTRIES.values())
    assert tuple(column(spark, [None], references.parsed)[0])[:3] == (None, None, None)


def test_bibliographies_are_cut(spark):
    numbered = "Refs\n[1] Smith J. Deep ice of the north.\n[12] short\n 3. Jones K. Seas of the south,\n continued here.\n4) Anders. Something of some length"
    loose = "Smith J. Deep ice of the north.\n\nJones K. Seas of the south\nAnders. Something of some length\nx"
    got = [[tuple(e) for e in r] for r in column(spark, [numbered, loose, ""], references.entries)]
    assert got == [
        [(1, "Smith J. Deep ice of the north."), (3, "Jones K. Seas of the south, continued here."), (4, "Anders. Something of some length")],
        [(None, "Smith J. Deep ice of the north."), (None, "Jones K. Seas of the south"), (None, "Anders. Something of some length x")],
        [],
    ]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (references.first_surname, {"Smith, J.; Doe, A.": "Smith", "John Smith": "Smith", "Smith J.D.": "Smith", "J. Smith": "Smith", "Иванов И.П.": "Иванов", "Ng": "Ng", "K": "K", "": ""}),
        (references.blocking_surname, {"John Smith and Anna Doe": "smith", "Smith, J.": "smith", "": "", "de la Cruz": "cruz"}),
        (references.surname_set, {"Smith, J. and Doe A et al": ["doe", "smith"], "Иванов и др": ["иванов"], "": []}),
        (references.doi_of_url, {"https://doi.org/10.1/A": "10.1/A", "http://DX.doi.org//10.1/a?x=1": "10.1/a", "https://x.org/10.1/a": "", "no url": "", "": ""}),
        (references.doi_anywhere, {"x" * 4000 + " see 10.1234/Ab_(c)1.": "10.1234/Ab_(c)1", "10.1000/182": None, "10.12/x": None, "": None}),
    ],
)
def test_names_and_dois(spark, f, cases):
    assert column(spark, list(cases), f) == list(cases.values())


def test_author_lists(spark):
    cases = {
        "Smith, J.; Doe, A.": [("Smith", "J."), ("Doe", "A.")],
        "Smith, J., Doe, A. B.": [("Smith", "J."), ("Doe", "A.")],
        "Jane Smith and John Doe": [("Smith", "J."), ("Doe", "J.")],
        "J. Smith, Anna Doe": [("Smith", "J."), ("Doe", "A.")],
        "Plato": [("Plato", "")],
        "; ".join(f"A{i}b, C." for i in range(12)): [(f"A{i}b", "C.") for i in range(10)],
        "": [],
    }
    assert [[tuple(n) for n in r] for r in column(spark, list(cases), references.author_list)] == list(cases.values())
