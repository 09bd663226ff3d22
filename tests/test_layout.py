"""Reading order of groups of any size, against a plain sort."""

from inkfold.operators import layout
from inkfold.plans import queries as q


def test_ranks_of_a_hot_group_are_those_of_a_sort(spark):
    rows = [(k, None if k % 50 == 0 else int(k % 7 == 0), [float(k * 37 % 11), float(k * 53 % 13), 1.0, 1.0] if k % 9 else None) for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, label int, box array<double>").repartition(3)
    for tall in (True, False):
        place = lambda r: (-(r[2] or [0.0])[0] if tall else (r[2] or [0, 0.0])[1], (r[2] or [0, 0.0])[1] if tall else (r[2] or [0.0])[0], r[0])
        want = {r[0]: n for group in (None, 0, 1) for n, r in enumerate(sorted((r for r in rows if r[1] == group), key=place), 1)}
        got = {r.vec_id: r["rank"] for r in layout.reading_ranks(df, "label", tall, "vec_id", q._held).collect()}
        assert got == want


def test_every_vector_has_a_place(spark, tmp_path):
    rows = [(k, [float(k % 5), float(k % 3), 9.0, 9.0], 0) for k in range(150, 450)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = q.QUERIES["reading_order_whole"](spark, str(tmp_path)).collect()
    assert {r.vec_id for r in got} == set(range(150, 450)) and {r.tall for r in got} == set(range(1, 301)) == {r.wide for r in got}
