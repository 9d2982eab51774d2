"""Queries of one id with several texts."""

from cutloom.llm import search


def test_texts_of_one_id_are_one_query(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, "blue plum"), (4, "grey stone")], "doc_id long, text string")
    asked = lambda rows: [tuple(r) for r in search.search(search.build_index(docs), spark.createDataFrame(rows, "query_id long, text string"), 10).orderBy("query_id", "rank").collect()]
    got = asked([(7, "apple"), (7, "pear pear"), (7, "apple"), (7, None), (8, "plum")])
    assert got == asked([(7, "apple pear pear"), (8, "plum")])
    assert {d for q, _, d, _ in got if q == 7} == {1, 2}
