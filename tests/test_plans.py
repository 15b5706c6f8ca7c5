"""What the steps of some queries look like: each had one that grew faster than its tables, or held too much in a task."""

import pytest

from fieldmark.plans import registry

DATA = "/root/testdata/sf0.001"


def plan(spark, name):
    df = registry.queries()[name](spark, DATA)
    return df, df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["life_list", "event_summary"])
def test_no_sets_of_rows_are_counted(spark, name):
    """distinct counts held three tables of groups in a task."""
    assert "distinct" not in plan(spark, name)[1]


def test_events_of_days_take_one_pass(spark):
    """chains of days went through components, a round of joins after another."""
    df, _ = plan(spark, "occurrence_events")
    assert not any("components" in f for f in df.inputFiles())


def test_places_are_asked_for_once_and_keep_one_box(spark):
    """all points of a cell met all boxes in one task, and were sorted there."""
    text = plan(spark, "smallest_box")[1]
    assert "Window" not in text and "strategy=broadcast" in text


def test_only_taxa_that_can_be_among_the_first_are_smoothed(spark):
    """each week of each taxon was dealt to all weeks around."""
    assert "(most#" in plan(spark, "weekly_top_taxa")[1]


def test_habitats_meet_in_grids_as_fine_as_each_place_allows(spark):
    """cells met in a grid of fixed width, so pairs grew with the square of the rows."""
    df, _ = plan(spark, "habitat_neighbours")
    assert any("habitat-pools" in f for f in df.inputFiles())
