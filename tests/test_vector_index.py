"""Search by cells against the scan of all rows."""

import numpy as np
import pytest

from docketry.operators import vector_index
from docketry.operators.ranking import nearest

ROWS, ASKED = "id long, vector array<double>", "query_id long, vector array<double>"


def listed(df):
    return sorted(map(tuple, df.collect()))


def vectors(n, dim, seed, centres=0):
    rng = np.random.default_rng(seed)
    spread = rng.normal(0, 0.05 if centres else 1, (n, dim)) + (rng.normal(0, 1, (centres, dim))[np.arange(n) % centres] if centres else 0)
    return [(i, v.tolist()) for i, v in enumerate(spread / np.linalg.norm(spread, axis=1)[:, None])]


@pytest.mark.parametrize("centres", [0, 12])
def test_cells_give_the_rows_of_the_scan(spark, tmp_path, centres):
    data = vectors(900, 16, 1, centres)
    rows = spark.createDataFrame(data + [(5000 + i, data[7][1]) for i in range(30)] + [(9999, None)], ROWS).repartition(4)
    asked = spark.createDataFrame([(q, data[i][1]) for q, i in enumerate((0, 7, 450, 899))], ASKED)
    index, seen = vector_index.build(rows, str(tmp_path / "v"), "id"), []
    for k in (1, 10, 2000):
        assert listed(vector_index.nearest_bounded(index, asked, k, seen=seen)) == listed(nearest(rows, asked, k, "id"))
    again = vector_index.open_index(rows, str(tmp_path / "v"), "id")
    assert listed(vector_index.nearest_bounded(again, asked, 3, limit=2000)) == listed(nearest(rows, asked, 3, "id"))
    if centres:
        assert seen[0][1] > 0.5 * seen[0][0]  # most pairs of query and cell are left out


def test_no_rows_no_queries_and_bad_vectors(spark, tmp_path):
    none = vector_index.build(spark.createDataFrame([], ROWS), str(tmp_path / "none"), "id")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], ASKED)
    assert listed(vector_index.nearest_bounded(none, asked, 3)) == []
    some = vector_index.build(spark.createDataFrame([(1, [1.0, 0.0])], ROWS), str(tmp_path / "one"), "id")
    assert listed(vector_index.nearest_bounded(some, asked.limit(0), 3)) == []
    with pytest.raises(Exception, match="vector of 3 elements"):
        vector_index.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], ROWS).coalesce(1), str(tmp_path / "bad"), "id")
