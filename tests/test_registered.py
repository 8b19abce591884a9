import pytest

from checks import registry
from checks.compare import compare, database

FOLDER = "/root/testdata/sf0.001"
NAMES = ["get_g02_page_objects", "agg_a03_term_rollup", "win_n02_ring_neighbours", "harvest_h10_annotations",
         "ingest_w06_merged_targets", "pred_p12_object_all", "stream_t03_admission", "sink_k05_site_rss"]


def test_every_query_has_a_name_and_most_have_sql():
    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) - len(sql) <= 5


@pytest.mark.parametrize("name", NAMES)
def test_registered_query_agrees_with_sql(spark, name):
    good, note = compare(spark, database(FOLDER), name, FOLDER)
    assert good, note
