"""Every query with SQL gives what DuckDB gives."""

import pytest

from brindle import queries, set_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, same, name):
    assert same(queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df())


def test_sizes_beyond_a_pebibyte_match_sql(spark, same, tmp_path):
    import duckdb

    spark.createDataFrame([(0, 1), (31, 3), (671103, 50), (1199999, 50), (1199999, 1)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert same(queries.QUERIES["human_sizes"](spark, str(tmp_path)).toPandas(), c.sql(queries.ORACLES["human_sizes"]).df())


def test_inner_code_finds_what_was_injected(spark):
    got = {r["errors"]: r for r in queries.QUERIES["inner_rs_scrub"](spark, SF).collect()}
    assert set(got) == {-1, *range(17)} and not any(r["wrong"] for r in got.values())


def test_damaged_packets_are_told(spark):
    got = {r["ok"]: r["packets"] for r in queries.QUERIES["packet_scan"](spark, SF).collect()}
    assert got == {True: 171, False: 29}


def test_rolling_blocks_are_found_where_they_moved(spark):
    first = queries.QUERIES["resync_rolling"](spark, SF).filter("rank = 1").first()
    assert first["delta"] == 5 and first["dominant"]


def test_chunks_tile_entries(spark):
    c = queries.QUERIES["cdc_chunks"](spark, SF).toPandas().sort_values(["ord", "chunk"])
    for _, g in c.groupby("ord"):
        assert list(g.offset) == list(g.length.cumsum() - g.length)
    firsts = c[c.canonical]
    assert not firsts.duplicated(["chunk_hash", "length"]).any()


def test_slice_crc_and_blake3(spark):
    from brindle.functions import digests

    data = queries._slice_data(spark, SF).limit(5).collect()
    crc = {r["slice"]: r["crc32c"] for r in queries.QUERIES["slice_crc32c"](spark, SF).collect()}
    assert all(digests.crc32c(bytes(r["data"])) == crc[r["slice"]] for r in data)
    assert queries.QUERIES["blake3_entries"](spark, SF).filter("length(blake3) = 64").count() == 200


def test_planner_orders_candidates(spark):
    rows = queries.QUERIES["planner_candidates"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault((r["slices"], r["recovery"]), []).append(r["score_us"])
    assert by and all(x == sorted(x) for x in by.values())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
