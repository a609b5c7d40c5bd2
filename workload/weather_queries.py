"""Season days, weather effects, recovery after rain, box statistics."""

from __future__ import annotations

from stationlake.model import SPECIES, WEATHER_SPECIES, daily_columns, subset
from stationlake.plans import climatology as cl
from stationlake.plans import weather as we
from workload import sql
from workload.climatology_queries import SEASONS, days_and_seasons
from workload.registry import register

CAP = sql.capital()
COLUMNS = subset(daily_columns(), WEATHER_SPECIES)

# Bins for the stand-in measures, in place of millimetres and km/h.
BINS = {
    "Rain": ("precipitation_mm", ([-1, 0, 2, 1000], ["Dry", "Light rain", "Rainy"])),
    "Wind": ("wind_speed_avg_kmh", ([-1, 4, 5, 6, 1000], ["<4", "4–5", "5–6", ">6"])),
    "Temperature": (
        "temperature_max_c",
        ([-50, 10, 20, 30, 40, 50], ["<10 °C", "10–20", "20–30", "30–40", ">40 °C"]),
    ),
}


def _pick(species) -> str:
    return "CASE s.pollen_type " + " ".join(
        f"WHEN '{s}' THEN d.{s}_pollen_avg" for s in species
    ) + " END"


def season_days_sql(species=WEATHER_SPECIES) -> str:
    names = ", ".join(f"'{s}'" for s in species)
    return f"""
season_days AS (
  SELECT * REPLACE ({CAP} AS pollen_type),
    grains / nullif(avg(grains) OVER (PARTITION BY city, pollen_type, year), 0) AS ratio
  FROM (
    SELECT d.*, s.pollen_type, s.year, s.season_start, s.season_end, {_pick(species)} AS grains
    FROM obs_daily d JOIN seasons s
      ON s.city = d.city AND d.date_local BETWEEN s.season_start AND s.season_end
    WHERE s.pollen_type IN ({names})
  )
)"""


def season_days_of(spark, sf, site="r_name", columns=COLUMNS):
    return cl.season_days(*days_and_seasons(spark, sf, site), columns)


@register(
    "season_days_ratio",
    sql.query([*SEASONS, season_days_sql()], "SELECT * FROM season_days", ["grains", "ratio"]),
)
def _(spark, sf):
    return season_days_of(spark, sf)


def _bin(column: str, edges, labels) -> str:
    cases = " ".join(
        f"WHEN {column} > {lo} AND {column} <= {hi} THEN '{label}'"
        for lo, hi, label in zip(edges, edges[1:], labels)
    )
    return f"CASE {cases} END"


BINNED = "binned AS (SELECT *, {} FROM season_days)".format(
    ", ".join(f'{_bin(c, *b)} AS "{n}"' for n, (c, b) in BINS.items())
)


@register(
    "weather_effect_bins",
    sql.query(
        [*SEASONS, season_days_sql(), BINNED],
        " UNION ALL ".join(
            f"""SELECT '{v}' AS variable, pollen_type, "{v}" AS "group", avg(ratio) AS mean, count(*) AS size
                FROM binned WHERE "{v}" IS NOT NULL GROUP BY ALL HAVING count(*) >= 15"""
            for v in BINS
        ),
        ["mean"],
        longs=["size"],
    ),
)
def _(spark, sf):
    return we.weather_effect(we.with_weather_bins(season_days_of(spark, sf), BINS), list(BINS))


@register(
    "rainy_vs_dry",
    sql.query(
        [*SEASONS, season_days_sql(), BINNED],
        """SELECT city, avg(ratio) FILTER (WHERE "Rain" = 'Rainy')
             / nullif(avg(ratio) FILTER (WHERE "Rain" = 'Dry'), 0) AS rain_effect
           FROM binned GROUP BY ALL""",
        ["rain_effect"],
    ),
)
def _(spark, sf):
    return we.rainy_to_dry(we.with_weather_bins(season_days_of(spark, sf), BINS), ["city"])


def _effect(name: str, above: str, below: str) -> str:
    return f"""SELECT pollen_type, city, '{name}' AS effect,
      avg(ratio) FILTER (WHERE {above}) / nullif(avg(ratio) FILTER (WHERE {below}), 0) AS times
    FROM season_days JOIN cuts USING (pollen_type, city) GROUP BY ALL"""


@register(
    "weather_effect_thirds",
    sql.query(
        [
            *SEASONS,
            season_days_sql(),
            """cuts AS (
              SELECT pollen_type, city,
                quantile_cont(wind_speed_avg_kmh, 1.0/3) AS calm, quantile_cont(wind_speed_avg_kmh, 2.0/3) AS windy,
                quantile_cont(temperature_max_c, 1.0/3) AS cool, quantile_cont(temperature_max_c, 2.0/3) AS warm
              FROM season_days GROUP BY ALL)""",
        ],
        " UNION ALL ".join(
            [
                _effect("Rain (rainy vs dry)", "precipitation_mm >= 2", "precipitation_mm < 0.1"),
                _effect("Wind (windy vs calm)", "wind_speed_avg_kmh >= windy", "wind_speed_avg_kmh <= calm"),
                _effect("Temperature (warm vs cool)", "temperature_max_c >= warm", "temperature_max_c <= cool"),
            ]
        ),
        ["times"],
    ),
)
def _(spark, sf):
    return we.paired_effects(season_days_of(spark, sf))


# Rain events need dry days, which the nation level has at every scale.
NATION = [sql.SITE_LINES, sql.obs_daily("n_name"), sql.seasons()]


def _series(species: str) -> str:
    leads = ", ".join(
        f"lead({species}_pollen_avg, {k}) OVER w AS a{k}" for k in range(1, 8)
    )
    return f"""SELECT city, date_local, '{species}' AS pollen_type, precipitation_mm AS rain,
        {species}_pollen_avg AS v, lag(precipitation_mm) OVER w AS rain_before,
        lag({species}_pollen_avg) OVER w AS before, {leads}, row_number() OVER w AS rn,
        count(*) OVER (PARTITION BY city) AS n
      FROM obs_daily WINDOW w AS (PARTITION BY city ORDER BY date_local)"""


EVENTS = f"""
series AS ({" UNION ALL ".join(_series(s) for s in WEATHER_SPECIES)}),
rain_events AS (
  SELECT x.city, {sql.capital("x.pollen_type")} AS pollen_type, x.date_local, v / before AS "drop",
    CASE {" ".join(f"WHEN a{k} >= 0.8::DOUBLE * before THEN {k}" for k in range(1, 8))} END AS recovery_days
  FROM series x JOIN seasons s ON x.city = s.city AND x.pollen_type = s.pollen_type
    AND x.date_local BETWEEN s.season_start AND s.season_end
  WHERE rn > 1 AND rn + 7 <= n AND rain >= 2 AND rain_before < 0.1 AND before >= 1
)"""


def events_of(spark, sf):
    return we.rain_events(*days_and_seasons(spark, sf, "n_name"))


@register(
    "rain_events",
    sql.query([*NATION, EVENTS], "SELECT * FROM rain_events", ["drop"], ["recovery_days"]),
)
def _(spark, sf):
    return events_of(spark, sf)


@register(
    "rain_event_summary",
    sql.query(
        [*NATION, EVENTS],
        """SELECT pollen_type, count(*) AS events, median("drop") AS median_drop,
             median(recovery_days)::DOUBLE AS median_recovery_days,
             avg(coalesce(recovery_days <= 2, false)::INTEGER) AS recovered_within,
             avg((recovery_days IS NULL)::INTEGER) AS not_recovered
           FROM rain_events GROUP BY ALL""",
        ["median_drop", "median_recovery_days", "recovered_within", "not_recovered"],
        longs=["events"],
    ),
)
def _(spark, sf):
    return we.rain_event_summary(events_of(spark, sf))


@register(
    "recovery_curve",
    sql.query(
        [*NATION, EVENTS],
        """SELECT pollen_type, k AS days_after_rain, count(*) AS n,
             avg(coalesce(recovery_days <= k, false)::INTEGER) AS share
           FROM rain_events, (SELECT unnest(range(0, 8)) AS k) GROUP BY ALL""",
        ["share"],
        ["days_after_rain"],
        ["n"],
    ),
)
def _(spark, sf):
    return we.recovery_curve(events_of(spark, sf))


@register(
    "recovery_by_site",
    sql.query(
        [*NATION, EVENTS],
        """SELECT pollen_type, city, count(*) AS n,
             avg(coalesce(recovery_days <= 2, false)::INTEGER) AS within_2_days, count(*) < 8 AS weak
           FROM rain_events GROUP BY ALL""",
        ["within_2_days"],
        longs=["n"],
    ),
)
def _(spark, sf):
    return we.recovery_by_site(events_of(spark, sf))


@register(
    "boxplot_stats",
    sql.query(
        [
            *SEASONS,
            season_days_sql(SPECIES),
            """box AS (SELECT pollen_type, city, quantile_cont(grains, 0.25) AS q1,
                 quantile_cont(grains, 0.5) AS median, quantile_cont(grains, 0.75) AS q3
               FROM season_days WHERE grains >= 1 GROUP BY ALL)""",
        ],
        """SELECT pollen_type, city, q1, median, q3, count(*) AS n,
             min(grains) FILTER (WHERE grains >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
             max(grains) FILTER (WHERE grains <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
             count(*) FILTER (WHERE grains < q1 - 1.5 * (q3 - q1) OR grains > q3 + 1.5 * (q3 - q1)) AS outliers
           FROM season_days JOIN box USING (pollen_type, city) WHERE grains >= 1 GROUP BY ALL""",
        ["q1", "median", "q3", "whisker_low", "whisker_high"],
        longs=["n", "outliers"],
    ),
)
def _(spark, sf):
    days = season_days_of(spark, sf, columns=daily_columns())
    return we.box_statistics(days, ["pollen_type", "city"])
