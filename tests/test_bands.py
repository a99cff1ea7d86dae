"""Bands of places that are null, no number, infinite or equal, against the query's SQL and by hand."""

import duckdb
from pyspark.sql import functions as F

from assaykit.operators import links
from assaykit.plans import handoff

NAN, INF = float("nan"), float("inf")
ODD = {1: [None, None, None, 4.0, 5.0, 6.0], 2: [NAN, NAN, NAN, 1.0], 3: [INF, INF, INF, -INF, -INF, -INF], 4: [None, 1.0, 7.0, 13.0, 19.5, INF, NAN], None: [1.0, 2.0, 3.0]}


def test_places_without_a_distance_are_in_no_band(spark):
    rows = [(k, v) for k, values in ODD.items() for v in values]
    got = links.bands(spark.createDataFrame(rows, "l_orderkey long, place double"), ["l_orderkey"], "place", 6.0).select("l_orderkey", "low", "high", "n_places").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_quantity DOUBLE)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?)", rows)
    want = con.execute(handoff.ORACLES["bands_of_places"]).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) == sorted([(1, 4.0, 6.0, 3), (4, 1.0, 13.0, 3), (None, 1.0, 3.0, 3)], key=repr)


def test_equal_places_are_counted_in_their_band(spark):
    places = [0.0, 0.0, 8.0, 8.0, 14.0, 14.0, 20.5, 20.5, 20.5]
    frame = spark.range(200).select(F.col("id").alias("k"), F.explode(F.array(*map(F.lit, places))).alias("place"))
    got = links.bands(frame.repartition(5), ["k"], "place", 6.0).groupBy("low", "high", "n_places").count().collect()
    assert sorted(map(tuple, got)) == [(8.0, 14.0, 4, 200), (20.5, 20.5, 3, 200)]
