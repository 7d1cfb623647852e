import random
import time

import pytest

from athenaeum.functions.claims import DEFINING, Phrases, is_identifier, manuscript_claims, quantities


def said(text):
    return [(c.key, c.place, c.kind, c.anchor) for c in manuscript_claims(text)]


def test_every_phrase_is_found_as_by_plain_search():
    rng = random.Random(3)
    trie = Phrases(("a", "ab", "bab", "bc", "bca", "caa"))
    for _ in range(200):
        text = "".join(rng.choices("abcx", k=rng.randint(0, 40)))
        want = {(i, k) for k, p in enumerate(trie.phrases) for i in range(len(text)) if text.startswith(p, i)}
        got = list(trie.find(text))
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It rose by 3.5 % in 2019 [@smith2020].", [("smith2020", "", "number", "3.5 %")]),
        ("Both saw it [@a; see @no; -@b2].", [("a", "", "none", ""), ("b2", "", "none", "")]),
        ("As @jones.x says, it is plain. Other.", [("jones.x", "", "none", "")]),
        ('He wrote "one two three four five" and "short" [@q].', [("q", "", "quote", '"one two three four five"')]),
        ("Sea ice is defined as frozen water at sea [@d].", [("d", "", "definition", "Sea ice is defined as frozen water at sea .")]),
        ("Лёд — это вода, которая является твёрдой [@l].", [("l", "", "definition", "Лёд — это вода, которая является твёрдой .")]),  # both windows are the sentence
        ("By ГОСТ Р 72039-2025, п. 7.3.4.1 and РД 52.27.759-2011 it is 10-15 km or -1,5 °C [@g].", [("g", "", "number", "10"), ("g", "", "number", "15"), ("g", "", "number", "-1,5 °C")]),
        ("So [@s].", []),
        ("`[@no]` and <!-- [@no] --> are hidden but it counts 7 [@yes].", [("yes", "", "number", "7")]),
        ("mail@example.com names nobody and it has 4 parts here.", []),
        ("It grew to 12 units [5, 12].", [("5", "", "reference", "[5]"), ("5", "", "number", "12"), ("12", "", "reference", "[12]"), ("12", "", "number", "12")]),
        ("It is so by rule [4, п. 7.3.2.4] of them.", [("4", "п. 7.3.2.4", "reference", "[4]")]),
        ("It is as said there ibid and so on.", [("", "", "again", "ibid")]),
        ("It was shown in [2026] and before.", []),
        ("It was shown in [7] for all.\n# References\n[7] Author. A title of 12 pages.", [("7", "", "reference", "[7]")]),
        ("", []),
    ],
)
def test_rules(text, want):
    assert said(text) == want


def test_numbers():
    assert [r for *_, r in quantities("x1 1x 5 1.5-2.0 0,674 52.27.759 72039-2025 123456 1999 −4 % 3 кг")] == ["5", "1.5", "2.0", "0,674", "123456", "−4 %", "3 кг"]
    assert is_identifier("7.3.4.1") and is_identifier("72039-2025") and not is_identifier("10-15") and not is_identifier("123456")


def test_long_decimals_with_a_unit_measure():
    assert [r for *_, r in quantities("10000.5 % 123456.25 кг 10000.5 72039-2025 % 52.27.75912 %")] == ["10000.5 %", "123456.25 кг"]
    assert said("In 2019 it rose by 10000.5 % (see 72039-2025) [@k1].") == [("k1", "", "number", "10000.5 %")]


def test_places_and_windows():
    text = "İ" * 40 + " first. " + "w " * 40 + "is defined as " + "v " * 60 + "[@k]. Next"
    got = manuscript_claims(text)
    assert [c.kind for c in got] == ["definition"] and text[got[0].start : got[0].end].startswith("w w") and got[0].anchor == ("w " * 15 + "is defined as" + " v" * 25).strip()
    for phrase in DEFINING:
        assert [c.kind for c in manuscript_claims(f"This thing {phrase.upper()} that thing [@k].")] == ["definition"]


def test_many_citations_are_read_once():
    text = "".join(f"Point {i} refers to what rose by {i} units [@key{i}]. " for i in range(10_000)) + "One sentence " + "[@again] " * 2_000
    start = time.perf_counter()
    got = manuscript_claims(text)
    assert sum(c.kind == "definition" for c in got) == 10_000 and sum(c.key == "again" for c in got) == 2_000
    assert sum(c.kind == "number" for c in got) == 2 * (10_000 - 200)  # years are none
    assert time.perf_counter() - start < 5
