"""Edge cases of the expression columns."""

import pytest
from pyspark.sql import functions as F

from gridlore.functions import settings
from gridlore.functions import text as X


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {t}" for k, t in TYPES(given))) if given else spark.range(1)
    return row.select(column.alias("out")).first()["out"]


def TYPES(given):
    for k, v in given.items():
        yield k, {str: "string", float: "double", int: "long", bool: "boolean", list: "array<string>", type(None): "string"}[type(v)]


def test_normalise_space_takes_unicode_white_space(spark):
    assert value(spark, X.normalise_space(F.col("t")), t="  a\t\n b ") == "a b"


@pytest.mark.parametrize("n", [79, 80, 81, 200])
def test_title_is_cut_over_80(spark, n):
    got = value(spark, X.thread_title(F.col("t")), t="x" * n)
    assert got == ("x" * n if n <= 80 else "x" * 77 + "…")


def test_truncate_counts_code_points(spark):
    assert value(spark, X.truncate(F.col("t"), 4), t="🙂🙂🙂🙂🙂") == "🙂…"


@pytest.mark.parametrize("x, want", [(2.5, 3), (-2.5, -2), (0.49, 0), (-0.5, 0)])
def test_halves_go_up(spark, x, want):
    assert value(spark, X.round_half_up(F.col("x")), x=x) == want


def test_percent_of_nothing_is_zero(spark):
    assert spark.range(0).agg(X.percent(F.count("*"), F.count("*")).alias("p")).first()["p"] == 0


@pytest.mark.parametrize("x, digits, want", [(0.125, 0, "13%"), (None, 0, "—"), (float("nan"), 1, "—"), (0.0634, 1, "6.3%"), (12.5, 0, "1250%")])
def test_percent_text(spark, x, digits, want):
    assert value(spark, X.percent_text(F.col("x").cast("double"), digits), x=x) == want


def test_clamp_and_bands(spark):
    rows = spark.createDataFrame([(2.0,), (-1.0,), (None,), (float("nan"),), (0.85,), (0.7,), (0.5,)], "x double").select(X.unit_clamp(F.col("x")), X.score_band(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [(1.0, "red"), (0.0, "emerald"), (0.0, "emerald"), (0.0, "emerald"), (0.85, "red"), (0.7, "rose"), (0.5, "amber")]


@pytest.mark.parametrize("key, want", [("asset_id", "Asset Id"), ("ipAddress", "Ip Address"), ("", ""), (None, ""), ("SCADA_link", "SCADA Link"), ("a-b", "A-B")])
def test_humanize(spark, key, want):
    assert value(spark, X.humanize_key(F.col("k")), k=key) == want


@pytest.mark.parametrize("zone, want", [("Level 3.5 – DMZ", "L3"), ("DMZ", "DMZ"), (None, "L2"), ("level 0", "L2"), ("Process area", "L0"), ("Enterprise", "L4")])
def test_zone_layer_is_ordered(spark, zone, want):
    assert value(spark, X.zone_layer(F.col("z")), z=zone) == want


@pytest.mark.parametrize("ts, want", [("2024-01-01 11:59:30", "30s ago"), ("2024-01-01 12:00:30", "in 30s"), ("2024-01-01 10:00:00", "2h ago"), ("2023-12-30 12:00:00", "2d ago"), (None, "—"), ("2024-01-01 11:59:00.400", "1m ago")])
def test_relative_time(spark, ts, want):
    assert value(spark, X.relative_time(F.try_to_timestamp(F.col("t")), F.lit("2024-01-01 12:00:00").cast("timestamp")), t=ts) == want


@pytest.mark.parametrize("json, want", [("null", "—"), ("[]", "—"), ('["a","b"]', "a, b"), ('[{"a":1}]', '[{"a":1}]'), ('{"a":1}', '{"a":1}'), ('"x"', "x"), ("7", "7")])
def test_cell_text(spark, json, want):
    assert value(spark, X.cell_text(F.parse_json(F.col("j"))), j=json) == want


def test_history_line(spark):
    assert value(spark, X.history_line(F.col("r"), F.col("c")), r="system", c=" a\r\nb ") == "Assistant: a\nb"


def test_labels(spark):
    assert value(spark, X.labelled(F.col("s"), X.STATUS_LABELS), s="odd") == "odd"
    assert value(spark, X.labelled(F.col("s"), X.STATUS_LABELS), s=None) == "—"
    assert value(spark, X.tone(F.col("s"), X.SEVERITY_TONES), s=None) == "slate"
    assert value(spark, X.health_tone(F.col("s")), s="OK") == "good"


def test_titles_and_plurals(spark):
    assert value(spark, X.display_title(F.col("t"), F.lit(7)), t="  ") == "Conversation #7"
    assert value(spark, X.plural(F.lit(1), "row")) == "1 row"
    assert value(spark, X.plural(F.lit(0), "row")) == "0 rows"
    assert value(spark, X.short_name(F.col("t")), t="Pump trip · site 4") == "Pump trip"
    assert value(spark, X.parse_time(F.col("t")), t="N/A") is None


def test_settings():
    merged = settings.deep_merge({"a": {"x": 1, "y": [1, 2]}, "b": 1}, {"a": {"y": [3]}, "b": {"z": 1}})
    assert merged == {"a": {"x": 1, "y": [3]}, "b": {"z": 1}}
    default = "http://127.0.0.1:8090"
    assert settings.engine_url(" ", default) == default
    assert settings.engine_url("localhost:8000/", default) == default
    assert settings.engine_url("host:8000", default) == "http://host:8000"
    assert settings.engine_url("host:8000", default, any_host=True) == default
    assert settings.engine_url("HTTPS://host:443/a//", default) == "https://host/a"
    assert settings.connection_state(False, True, True, True, False) == "connected"
    assert settings.connection_state(False, True, True, False, True) == "persisted"
    assert settings.connection_state(False, True, False, False, False) == "offline"
    assert settings.connection_state(True, True, False, False, False) == "demo"
    assert settings.is_connected("persisted") and not settings.is_connected("degraded")
