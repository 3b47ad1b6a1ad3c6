import pytest

from meridia.plans.catalog import ORACLES, QUERIES

from .compare import difference

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries whose rows depend on how many points, versions or fees there are: they are held against more rows too.
BY_SIZE = [
    "alert_log", "asof_latest_price", "compare_two_localities", "component_defaults", "facility_rate_lines", "county_exact_match", "cross_anomalies", "default_candidates", "failure_samples", "latency_p95_floor_index", "nearest_by_table_distance", "nearest_in_state",
    "nearest_radius_pobox", "nearest_reverse_asymmetry", "nearest_within_miles", "numeric_range_join", "opps_release_rules", "plan_totals", "price_lines_absent_tables", "price_lines_by_setting", "price_lines_with_fees", "range_override_join", "run_state", "trace_summary", "zip_locality_rules",
]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    told = difference(QUERIES[name](spark, SF), ORACLES[name], SF)
    assert told == "" or (told == "no rows on either side" and name in BY_SIZE)


@pytest.mark.parametrize("name", BY_SIZE)
def test_query_equals_its_sql_on_more_rows(spark, name):
    assert difference(QUERIES[name](spark, LARGER), ORACLES[name], LARGER) == ""


def with_rows(folder, name: str, df) -> str:
    """A folder with all tables of SF, one of them replaced."""
    import os

    for table in os.listdir(SF):
        if table != f"{name}.parquet":
            os.symlink(f"{SF}/{table}", folder / table)
    df.write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("shift", [120_000, 36**5, 40**8])
def test_release_rules_of_parts_with_longer_keys(spark, tmp_path, shift):
    """Keys of more digits than a code has are still codes of their own."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    folder = with_rows(tmp_path, "part", part.unionByName(part.withColumn("p_partkey", part.p_partkey + shift)))
    assert difference(QUERIES["opps_release_rules"](spark, folder), ORACLES["opps_release_rules"], folder) == ""


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["range_override_join", "numeric_range_join", "symmetric_pair_lookup", "asof_latest_price", "nearest_within_miles", "nearest_radius_pobox", "nearest_by_table_distance", "resolution_cascade"])
def test_joins_have_keys(spark, name):
    text = plan(QUERIES[name](spark, SF)).replace("BroadcastNestedLoopJoin BuildRight, Inner, NOT (a", "")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["nearest_in_state", "nearest_radius_pobox", "nearest_by_table_distance"])
def test_no_search_pairs_all_of_a_state(spark, name):
    """Where both sides of a join have coordinates, its keys name a cell of the grid."""
    import re

    for keys in re.findall(r"Join \[([^\]]*)\]", plan(QUERIES[name](spark, SF))):
        names = {k.split("#")[0] for k in keys.split(", ")}
        assert names not in ({"_s"}, {"c_nationkey"}), keys


@pytest.mark.parametrize("name", ["nearest_in_state", "nearest_within_miles", "nearest_reverse_asymmetry", "nearest_radius_pobox", "nearest_by_table_distance"])
def test_rows_of_a_search_are_not_broadcast(spark, name):
    """Cells and pairs have more rows than the size of the table tells: what is joined to them is joined by shuffle."""
    import re

    kinds = re.findall(r"(\w+Join) \[([^\]]*)\]", plan(QUERIES[name](spark, SF)))
    kinds = [(kind, names) for kind, keys in kinds if (names := {k.split("#")[0] for k in keys.split(", ")}) not in ({"c_custkey"}, {"nearest"})]
    assert any("_y" in names for _, names in kinds) and {kind for kind, _ in kinds} == {"SortMergeJoin"}, kinds


def test_no_pairs_of_parts_and_suppliers_are_made(spark):
    """The remainder that parts and suppliers share is never the only key of a join."""
    import re

    joins = re.findall(r"Join \[([^\]]*)\]", plan(QUERIES["referential_anti"](spark, SF)))
    assert joins and all({k.split("#")[0] for k in keys.split(", ")} != {"m"} for keys in joins)


@pytest.mark.parametrize("name", ["price_lines_with_fees", "price_lines_absent_tables"])
def test_the_pricing_engine_reads_lines_once(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("lineitem.parquet") == 1


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["many_to_many_filtered"](spark, SF))
    assert "EqualTo(l_returnflag,R)" in text and "l_comment" not in text and "l_extendedprice" not in text


def test_entry_points_without_the_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.path_hooks.insert(0, lambda p: (_ for _ in ()).throw(ImportError()) if p.endswith('llm') else (_ for _ in ()).throw(ImportError())); import __spark_entry__ as e; q = e.queries(); assert 'plan_totals' in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/root/repo" if __file__.startswith("/root/repo") else None)
