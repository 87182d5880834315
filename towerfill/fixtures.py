"""The ``tower`` view: tower-shaped rows derived from the driver's ``events`` table.

The driver tables hold no nulls and no tower variables, so correctness
queries run on this view (one row per event, five series, twelve months,
about a quarter of ``co2_flux`` null).  The body is the same SQL for Spark and
DuckDB; only the datetime stretch and the JSON access differ.  This module only
shapes input rows; every operator under test runs in the library.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from towerfill.timeline import Timeline

TOWER_BODY = """SELECT event_id, event_type AS series_id, {DT} AS datetime, k,
 CASE WHEN user_id % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE value - 40.0E0 END AS co2_flux,
 CAST(k % 3 AS INT) AS co2_flux_qc,
 10.0E0 + (event_id % 200) / 10.0E0 AS air_temperature,
 CAST(k AS DOUBLE) AS relative_humidity,
 (event_id % 50) / 10.0E0 AS wind_speed,
 CAST((event_id * 7) % 1080 - 360 AS DOUBLE) / 2.0E0 AS wind_dir,
 CAST((event_id * 10) % 610 - 300 AS DOUBLE) AS obukhov_length,
 CAST(greatest(0, (event_id * 17) % 1000 - 200) AS DOUBLE) AS downwelling_shortwave_flux_total,
 greatest(0, (event_id * 17) % 1000 - 200) * k / 100.0E0 AS downwelling_shortwave_flux_diffuse,
 CAST((event_id * 17) % 1000 AS DOUBLE) AS downwelling_shortwave_flux,
 ((event_id * 17) % 1000) * 0.2E0 AS upwelling_shortwave_flux,
 300.0E0 + k AS downwelling_longwave_flux,
 350.0E0 + event_id % 40 AS upwelling_longwave_flux,
 CASE WHEN user_id % 5 = 1 THEN CAST(NULL AS DOUBLE) ELSE value * 2.0E0 - 20.0E0 END AS sensible_heat_flux,
 (k - 10) * 3.0E0 AS latent_heat_flux
FROM (SELECT *, {K} AS k FROM {EVENTS}) e"""

SPARK_DT = ("timestampadd(MICROSECOND, 12 * timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts), "
            "timestamp_ntz'2024-01-01 00:00:00')")
SPARK_K = "CAST(get_json_object(props, '$.k') AS INT)"
DUCK_DT = ("TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(12 * date_diff('microsecond', "
           "TIMESTAMP '2024-01-01 00:00:00', ts))")
DUCK_K = "CAST(json_extract_string(props, '$.k') AS INT)"

# Series key and total order of the tower view.
TOWER = Timeline(series=("series_id",), time="datetime", tiebreak=("event_id",))

TOWER_VARIABLES = [
    "k", "co2_flux", "co2_flux_qc", "air_temperature", "relative_humidity", "wind_speed", "wind_dir",
    "obukhov_length", "downwelling_shortwave_flux_total", "downwelling_shortwave_flux_diffuse",
    "downwelling_shortwave_flux", "upwelling_shortwave_flux", "downwelling_longwave_flux",
    "upwelling_longwave_flux", "sensible_heat_flux", "latent_heat_flux",
]


def tower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tower view over ``{sf_dir}/events.parquet`` (lazy; columns pruned by Catalyst)."""
    name = "towerfill_events_" + hashlib.md5(sf_dir.encode()).hexdigest()[:12]
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.createOrReplaceTempView(name)
    return spark.sql(TOWER_BODY.format(DT=SPARK_DT, K=SPARK_K, EVENTS=name))


def duck_tower_cte() -> str:
    """``tower AS (...)`` for an oracle ``WITH`` clause (DuckDB dialect)."""
    return "tower AS (" + TOWER_BODY.format(DT=DUCK_DT, K=DUCK_K, EVENTS="events") + ")"
