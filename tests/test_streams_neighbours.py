"""Windows that are still open, and how many cells a neighbour query visits."""

import datetime as dt

import numpy as np
from helpers import rows

from newsfacts.operators import neighbours as nb
from newsfacts.streaming import streams


def test_open_windows_follow_the_input(spark, tmp_path):
    folder, sink = f"{tmp_path}/in", f"{tmp_path}/sink"
    schema = "ts timestamp_ntz, kind string"

    def add(name, *events):
        spark.createDataFrame([(dt.datetime(1998, 3, d, h), kind) for d, h, kind in events], schema).coalesce(
            1).write.parquet(f"{folder}/{name}")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*")
        return rows(streams.run_updating(
            streams.daily_counts_stream(stream, "ts", "kind"), "daily", ["day", "kind"], sink))

    day = [dt.date(1998, 3, i) for i in range(1, 32)]
    add("a", (1, 5, "x"), (1, 6, "x"), (2, 1, "y"))
    assert run() == [(day[0], "x", 2), (day[1], "y", 1)]  # both days are open
    add("b", (2, 2, "y"), (2, 3, None), (9, 0, "x"))
    assert run() == [(day[0], "x", 2), (day[1], "y", 2), (day[1], None, 1), (day[8], "x", 1)]
    add("c", (1, 7, "x"), (9, 1, "x"))  # the first of March was closed by the ninth
    assert run() == [(day[0], "x", 2), (day[1], "y", 2), (day[1], None, 1), (day[8], "x", 2)]
    assert run() == [(day[0], "x", 2), (day[1], "y", 2), (day[1], None, 1), (day[8], "x", 2)]


def test_no_events(spark, tmp_path):
    schema = "ts timestamp_ntz, kind string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert rows(streams.run_updating(streams.daily_counts_stream(stream, "ts", "kind"), "daily", ["day", "kind"])) == []


def clustered(spark):
    r = np.random.default_rng(4)
    centres = r.normal(0, 10, (25, 8))
    data = [(i, [float(x) for x in centres[i % 25] + r.normal(0, 0.5, 8)], i % 3) for i in range(600)]
    data += [(600 + i, data[0][1], 7) for i in range(60)]  # copies: a hot cell with ties
    train = spark.createDataFrame(data, "train_id long, vector array<double>, label int")
    return data, train, train.selectExpr("train_id AS query_id", "vector")


def test_clustered_queries_visit_few_cells_and_lose_nothing(spark):
    data, train, queries = clustered(spark)
    k = 5
    cells = nb.make_cells(queries, train, k)
    own = nb._best(nb._search(cells.asked, cells, k, 64), k)
    visits = nb.other_cells(cells, own, k).count() + len(data)
    assert visits / (len(data) * len(cells.size)) < 0.3
    x = np.array([v for _, v, _ in data])
    want = set()
    for i in range(len(data)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want |= {(i, int(j)) for j in np.lexsort((np.arange(len(x)), d))[:k]}
    assert {tuple(r) for r in nb.knn_join(queries, train, k, block=64).select("query_id", "train_id").collect()} == want


def test_few_rows(spark):
    _, train, queries = clustered(spark)
    three = train.filter("train_id < 3")
    got = nb.knn_join(queries.filter("query_id < 3"), three, 5)  # fewer rows than neighbours asked for
    assert rows(got, "query_id", "train_id") == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert rows(nb.knn_join(queries, three.limit(0), 5)) == []
    assert rows(nb.knn_join(queries.limit(0), three, 5)) == []


def test_rows_are_picked_by_a_product_and_measured_by_differences():
    """Far from the origin a product rounds away what parts the rows; ties and copies are all kept."""
    import numpy as np

    from newsfacts.operators import neighbours

    rng = np.random.default_rng(3)
    b = rng.integers(0, 3, (300, 8)) * 1e-4 + 1000.0
    a = b[:40]
    own = np.arange(40)[:, None] == np.arange(300)[None, :]
    i, j, d = neighbours._nearest(a, b, 4, own)
    exact = np.where(own, np.inf, neighbours._distances(a, b))
    for q in range(40):
        got = sorted(zip(d[i == q], j[i == q]))[:4]
        assert got == [(exact[q, n], n) for n in np.lexsort((np.arange(300), exact[q]))[:4]]
    assert len(neighbours._nearest(a, b[:2], 4, own[:, :2])[0]) == 78  # fewer rows than asked for
    centres = b[40:60] + rng.random((20, 8)) * 1e-5
    assert neighbours._own_cells(b, centres).tolist() == neighbours._distances(b, centres).argmin(axis=1).tolist()


def test_cells_are_no_smaller_than_blocks_need(spark, monkeypatch):
    """Few large cells, whose queries are compared slice by slice, give the neighbours that many small ones give."""
    data, train, queries = clustered(spark)
    want = rows(nb.knn_join(queries, train, 5, pivots=20))
    monkeypatch.setattr(nb, "CELLS", 4)
    monkeypatch.setattr(nb, "SLICE", 7)
    assert len(nb.make_cells(queries, train, 5).centres) == 4
    assert rows(nb.knn_join(queries, train, 5)) == want
