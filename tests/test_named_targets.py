"""Rows of a few named targets are not brought to one task by the join with those targets."""

from core_helpers import INSTANCE
from linkloom.operators.filters import named_objects
from linkloom.operators.pages import edge_rows
from linkloom.plans.spec import QuerySpec


def spec(by, **options):
    return QuerySpec.build("pages", by, instance=INSTANCE, limit="no-limit", **options)


def test_rows_keep_their_partitions_when_targets_are_named(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = edge_rows(small, spec("thorped", o="red"))
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=broadcast)" in plan.split("Sort")[0]
        assert sorted((r["src"], r["dst"], r["o_title"]) for r in rows.collect()) == [
            ("https://a.example/1", INSTANCE + "~/red", None), ("https://a.example/2", INSTANCE + "~/red", None)
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_title_of_a_named_page(small):
    rows = edge_rows(small, spec("linked", o="https://b.example/2", match="exact")).collect()
    assert [(r["src"], r["o_title"]) for r in rows] == [("https://a.example/2", "B two")]


def test_objects_by_a_part_of_their_text_are_not_named(small):
    assert named_objects(small, "termsOnly", "exact", ["red"]) == [INSTANCE + "~/red"]
    assert named_objects(small, "notTerms", "fuzzy", ["b.example"]) is None
    assert named_objects(small, "all", "very-fuzzy", ["red"]) is None
    assert named_objects(small, "all", "exact", []) is None
