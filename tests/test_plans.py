"""Physical plans: no nested loops, pruned scans, pushed filters, no Python in relational queries."""

import pytest

from citeloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON = ("Python", "Pandas", "Arrow", "MapInArrow")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j04_range_candidates", "j05_page_works_by_letter", "j06_precise", "j12_book_of", "j13_as_of", "d03_candidates", "p24_out_of_range"])
def test_range_joins_are_equi_joins(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["a07_cells", "a22_allocation", "g01_find_all", "g10_expand_verses", "d08_scope", "x02_shape", "x08_dispersion", "w03_smooth", "q03_share"])
def test_no_python(spark, name):
    text = plan(spark, name)
    assert not any(p in text for p in PYTHON)


def test_scans_read_what_is_asked(spark):
    text = plan(spark, "a06_works")
    assert "l_extendedprice" not in text and "l_tax" not in text and "o_totalprice" not in text and "s_acctbal" not in text
    assert "PushedFilters: [IsNotNull(l_orderkey)" in plan(spark, "j03_not_yet_done") or "PushedFilters" in plan(spark, "s13_work_scan")
    assert "EqualTo(p_brand,Brand#7)" in plan(spark, "s13_work_scan")


def optimized(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_decisions_are_made_once(spark):
    """A filter on a field of a decision copies none of it; a resolved row is built once and never joined back."""
    assert optimized(spark, "d04_unique").count("regexp_extract") <= 12
    text = optimized(spark, "d08_scope")
    assert text.count("Relation [l_") <= 3 and text.count("Join ") <= 20


def test_patterns_run_once(spark):
    text = optimized(spark, "g01_find_all")
    assert text.count("regexp_extract_all") == 0 and text.count("regexp_replace") <= 8


@pytest.mark.parametrize("name", ["x04_permutation_null", "x08_dispersion_null"])
def test_nulls_are_dealt_by_chunk(spark, name):
    text = plan(spark, name)
    assert "work#" in text and "chunk#" in text and "NestedLoop" not in text


def test_pre_aggregation(spark):
    text = plan(spark, "a01_count")
    assert "partial_count" in text
