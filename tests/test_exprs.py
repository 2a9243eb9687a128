import pytest
from pyspark.sql import functions as F

from tracewell.functions import exprs as X


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "kind, extra, expected",
    [("PageLoad", None, True), ("PageVisible", None, True), ("PageHidden", None, False), ("Click", None, True), ("Focus", None, False), ("Mutation", None, False), ("Input", None, True), ("Input", '{"userTriggered":false}', False), ("Input", '{"userTriggered":true}', True), ("Play", None, False), ("MediaInteraction", None, True), (None, None, False)],
)
def test_user_activity(spark, kind, extra, expected):
    assert value(spark, X.is_activity(F.lit(kind).cast("string"), F.lit(extra).cast("string"))) is expected


def test_raw_activity_counts_media(spark):
    n = lambda x: F.lit(x).cast("int")
    assert value(spark, X.is_activity_raw(n(3), n(7), n(0), F.lit(None).cast("boolean")))
    assert not value(spark, X.is_activity_raw(n(3), n(2), n(5), F.lit(None).cast("boolean")))
    assert not value(spark, X.is_activity_raw(n(3), n(5), n(None), F.lit(False)))


@pytest.mark.parametrize("t, s, k, name", [(3, 0, None, "Mutation"), (3, 2, 2, "Click"), (3, 2, 99, "MouseInteraction:99"), (3, 7, 0, "Play"), (69, None, None, "PageLoad"), (42, None, None, "42"), (3, 55, None, "55")])
def test_kind_names(spark, t, s, k, name):
    n = lambda x: F.lit(x).cast("int")
    assert value(spark, X.kind_name(n(t), n(s), n(k))) == name


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: X.offset_stamp(F.lit(61_005)), "[01:01.005]"),
        (lambda: X.offset_stamp(F.lit(-5)), "[00:00.000]"),
        (lambda: X.offset_stamp(F.lit(6_000_000), F.lit("S2")), "[S2 100:00.000]"),
        (lambda: X.coarse_duration(F.lit(185_000)), "3m05s"),
        (lambda: X.coarse_duration(F.lit(3_720_000)), "1h02m"),
        (lambda: X.age(F.lit(276_480_000)), "3d 4h"),
        (lambda: X.route_key(F.lit("http://a/b?x=1#c?d")), "http://a/b#c?d"),
        (lambda: X.escape_value(F.lit("a\\b\n\t")), "a\\\\b\\n\\t"),
        (lambda: X.collapse(F.lit(" a \u00a0\n b ")), "a b"),
        (lambda: X.truncate(F.lit("abcdef"), 4), "abc…"),
        (lambda: X.rounded(F.lit(-2.5)), -2),
        (lambda: X.canonical_ts(F.lit(3), F.lit(1), F.lit(100), F.array(F.lit(-50), F.lit(-7))), 93),
        (lambda: X.is_slice_id(F.lit("17000000000001-ab12\n")), False),
        (lambda: X.device(F.lit("Mozilla (Macintosh)"), F.lit(5), F.lit(800), F.lit(600)), "tablet"),
    ],
)
def test_texts(spark, column, expected):
    assert value(spark, column()) == expected
