import pytest

from millrace.operators.search import CellIndex, search_all

ROWS = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 0.0, 2.0]), (6, None), (7, [0.0, 0.0])]
QUERIES = [(10, [1.0, 0.0]), (11, [0.0, 0.0, 1.0]), (12, [1.0, 0.0, 0.0, 0.0])]
WANT = {(10, 1), (10, 2), (11, 5), (11, 4)}


@pytest.fixture(scope="module")
def sides(spark):
    return tuple(spark.createDataFrame(r, "id long, v array<double>") for r in (ROWS, QUERIES))


def test_each_dimension_is_searched_by_itself(sides):
    out = search_all(*sides, "v", "id", top_k=2).collect()
    assert {(r.query_id, r.id) for r in out} == WANT


def test_the_index_takes_vectors_of_several_dimensions(sides):
    rows, queries = sides
    out = CellIndex.build(rows, "v", "id", cells=2).search(queries, "v", "id", top_k=2, probes=2).collect()
    assert {(r.query_id, r.id) for r in out} == WANT
