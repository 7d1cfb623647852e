from athenaeum.plans import text


def test_all_whole_quotations_are_looked_for(spark):
    """Also those from the fortieth on; what agrees in 80 characters only isn't found."""
    quotes = [(i, f"quotation number {i:03d} " + "and so it goes on and on for long " * 3 + "end") for i in range(60)]
    works_rows = [(i, "before " + (q if i % 3 else q[:90]) + " after") for i, q in quotes]

    class Given:
        works = spark.createDataFrame(works_rows, "work_id long, text string")

        def raw(self, name):
            return spark.createDataFrame(quotes, "item_id long, text string")

    got = {tuple(r) for r in text.j3_locate_exact_whole(Given()).collect()}
    assert got == {(i, i, 8) for i in range(60) if i % 3}
    assert {r.item_id: r.confirmed for r in text.j4_verbatim_whole(Given()).collect()} == {i: i % 3 > 0 for i in range(60)}


def test_claims_are_read_to_the_end_of_the_text(spark):
    class Late:
        works = spark.createDataFrame([(1, "title", "word " * 600 + 'end. "five words stand right here" says [7].')], "work_id long, title string, text string")

    assert "7" in {r.key for r in text.j18_claims(Late).collect()}
