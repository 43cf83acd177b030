"""Queries of the state machines over the events table; SQL where recursion can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import LOGS_SQL, logs
from ..streaming import batch
from ..streaming.machines import BothLimits, Dedup, PatternAlert, RateLimit, Silence, Volume, Watch
from .registry import DAY, END, T0, TEMPLATE, _logs, query

HOUR = 3_600_000


def _arriving(spark, d):
    return logs(spark, d).withColumn("arrival", F.col("ts"))


def _brief(spark, d):
    """Entries whose message is their type alone, so that runs repeat."""
    return _arriving(spark, d).withColumn("message", F.col("fields")["type"])


BRIEF = f"SELECT id, ts, host, app, severity, f_type AS message FROM ({LOGS_SQL})"


@query(
    "dedup_runs",
    f"""WITH RECURSIVE logs AS ({BRIEF}), starts AS (
            SELECT host, app, severity, message, min(ts) AS start FROM logs GROUP BY ALL
            UNION ALL
            SELECT s.host, s.app, s.severity, s.message, min(l.ts) AS start FROM starts s JOIN logs l ON l.host = s.host AND l.app = s.app AND l.severity = s.severity AND l.message = s.message AND l.ts >= s.start + {DAY}
            GROUP BY s.host, s.app, s.severity, s.message, s.start),
        runs AS (SELECT s.*, count(*) - 1 AS n, max(l.ts) AS last FROM starts s JOIN logs l ON l.host = s.host AND l.app = s.app AND l.severity = s.severity AND l.message = s.message AND l.ts >= s.start AND l.ts < s.start + {DAY} GROUP BY ALL)
        SELECT start AS ts, host, app, severity, message, CAST(0 AS BIGINT) AS repeats FROM runs
        UNION ALL SELECT last, host, app, severity, message || ' [repeated ' || n || ' more times over ' || (last - start) // 1000 || 's]', n FROM runs WHERE n > 0""",
)
def _(spark, d):
    return batch.fold(_brief(spark, d), Dedup(window=DAY), until=END + 2 * DAY)


@query(
    "pattern_alerts",
    f"""WITH RECURSIVE matched AS (SELECT host, id, ts, message, row_number() OVER w AS rn, lag(ts, 4) OVER w AS front FROM ({LOGS_SQL}) WHERE severity = 3 WINDOW w AS (PARTITION BY host ORDER BY ts, id)),
        able AS (SELECT * FROM matched WHERE ts - front <= {6 * HOUR}),
        fired AS (
            SELECT host, min(rn) AS rn, min(ts) AS ts FROM able GROUP BY host
            UNION ALL
            SELECT f.host, min(a.rn) AS rn, min(a.ts) AS ts FROM fired f JOIN able a ON a.host = f.host AND a.rn >= f.rn + 5 AND a.ts - f.ts >= {12 * HOUR} GROUP BY f.host, f.rn, f.ts)
        SELECT f.ts, 'errors' AS rule, f.host, CAST(5 AS INTEGER) AS count, CAST({6 * HOUR // 1000} AS BIGINT) AS window_secs, m.message AS sample FROM fired f JOIN matched m ON m.host = f.host AND m.rn = f.rn""",
)
def _(spark, d):
    return batch.fold(_arriving(spark, d).where("severity = 3"), PatternAlert("errors", 5, 6 * HOUR, 12 * HOUR))


#: One row a window and host from the host's first window on, folded by recursion: base, seen, odd and fired as in the machine.
VOLUME = f"""WITH RECURSIVE logs AS ({LOGS_SQL}), found AS (SELECT host, ts // {HOUR} AS number, count(*) AS n FROM logs GROUP BY ALL),
    spans AS (SELECT host, min(number) AS first, (SELECT max(number) FROM found) AS last FROM found GROUP BY host),
    dense AS (SELECT s.host, w.number, coalesce(f.n, 0) AS n, w.number - s.first AS k FROM spans s, LATERAL (SELECT unnest(range(s.first, s.last + 1)) AS number) w LEFT JOIN found f ON f.host = s.host AND f.number = w.number),
    folded AS (
        SELECT host, k, CAST(n AS DOUBLE) AS base, 1 AS seen, 0 AS odd, CAST(NULL AS BIGINT) AS fired, NULL::VARCHAR AS kind, CAST(0 AS BIGINT) AS ts, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS baseline FROM dense WHERE k = 0
        UNION ALL
        SELECT host, k, CASE WHEN fold THEN (1 - alpha) * base + alpha * n ELSE base END, CASE WHEN fold THEN seen + 1 ELSE seen END, odd, CASE WHEN fires THEN ts ELSE fired END, CASE WHEN fires THEN CASE WHEN surge THEN 'surge' ELSE 'drop' END END, ts, n, CAST(floor(base + 0.5::DOUBLE) AS BIGINT)
        FROM (SELECT *, odd = 0 OR odd >= 12 AS fold, CASE WHEN seen = 0 THEN 1::DOUBLE WHEN seen < 12 THEN 1::DOUBLE / (seen + 1) ELSE 2::DOUBLE / 13 END AS alpha, (surge OR fell) AND (fired IS NULL OR ts - fired >= {6 * HOUR}) AS fires
            FROM (SELECT * REPLACE (CASE WHEN surge OR fell THEN odd + 1 ELSE 0 END AS odd)
                FROM (SELECT d.host, d.k, d.n, (d.number + 1) * {HOUR} AS ts, f.base, f.seen, f.odd, f.fired, ready AND d.n >= 3::DOUBLE * f.base AS surge, ready AND d.n <= 0.2::DOUBLE * f.base AS fell
                    FROM (SELECT *, seen >= 12 AND base >= 0.5::DOUBLE AS ready FROM folded) f JOIN dense d ON d.host = f.host AND d.k = f.k + 1))))
    SELECT ts, kind, host, n, baseline FROM folded WHERE kind IS NOT NULL"""


@query("volume_alerts", VOLUME)
def _(spark, d):
    return batch.volume(_arriving(spark, d), Volume(HOUR, 12, 0.5, 3.0, 0.2, 6 * HOUR))


@query("volume_alerts_by_expression", VOLUME)
def _(spark, d):
    return batch.volume_by_expression(_arriving(spark, d), Volume(HOUR, 12, 0.5, 3.0, 0.2, 6 * HOUR))


@query("new_patterns", _logs(f"SELECT * FROM (SELECT {TEMPLATE} AS template, min(ts) AS ts, arg_min(host, (ts, id)) AS host FROM logs WHERE severity <= 5 GROUP BY 1) WHERE ts >= {T0 + 60_000}"))
def _(spark, d):
    return batch.watch(_arriving(spark, d), Watch(learn_until=T0 + 60_000, factor=0), list(range(6))).select("template", "ts", "host")


@query(
    "pattern_surges",  # two templates with five quiet windows each stay below ten notices a minute
    f"""WITH RECURSIVE logs AS ({LOGS_SQL}), rows AS (SELECT *, {TEMPLATE} AS template FROM logs WHERE severity <= 4),
        dealt AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY ts, id) AS rn FROM rows),
        folded AS (
            SELECT template, rn, CAST(1 AS BIGINT) AS n, ts AS start, 0::DOUBLE AS usual, CAST(0 AS BIGINT) AS windows, CAST(NULL AS BIGINT) AS surged, false AS told FROM dealt WHERE rn = 1
            UNION ALL
            SELECT template, rn, n, start, usual, windows, CASE WHEN told THEN ts ELSE surged END, told
            FROM (SELECT *, windows >= 10 AND n >= 3 AND n >= 2::DOUBLE * greatest(usual, 1::DOUBLE) AND (surged IS NULL OR ts - surged >= {5 * HOUR}) AS told
                FROM (SELECT template, rn, ts, surged, start + passed * {HOUR} AS start, CASE WHEN passed > 0 THEN 1 ELSE n + 1 END AS n, windows + least(passed, 64) AS windows,
                        CASE WHEN passed > 0 THEN list_reduce(list_prepend(CASE WHEN windows = 0 THEN CAST(n AS DOUBLE) ELSE 0.9::DOUBLE * usual + 0.1::DOUBLE * n END, list_transform(range(least(passed, 64) - 1), lambda i: 1::DOUBLE)), lambda a, b: 0.9::DOUBLE * a) ELSE usual END AS usual
                    FROM (SELECT d.template, d.rn, d.ts, f.n, f.start, f.usual, f.windows, f.surged, (d.ts - f.start) // {HOUR} AS passed FROM folded f JOIN dealt d ON d.template = f.template AND d.rn = f.rn + 1))))
        SELECT d.ts, 'surge' AS kind, d.template, d.host, d.severity, f.n, CAST(floor(f.usual + 0.5::DOUBLE) AS BIGINT) AS usual, d.message AS sample FROM folded f JOIN dealt d ON d.template = f.template AND d.rn = f.rn WHERE f.told""",
)
def _(spark, d):
    return batch.watch(_arriving(spark, d), Watch(learn_until=END, window=HOUR, factor=2.0, least=3), per_minute=10)


@query(
    "silence_events",
    f"""WITH logs AS ({LOGS_SQL}), gaps AS (SELECT host, ts AS last, lead(ts) OVER (PARTITION BY host ORDER BY ts, id) AS next FROM logs WHERE host <> 'host1')
        SELECT last + {DAY // 8} + 1 AS ts, 'silent' AS kind, host, CAST({DAY // 8} + 1 AS BIGINT) AS silent_for, CAST({DAY // 8} AS BIGINT) AS threshold FROM gaps WHERE last + {DAY // 8} + 1 <= coalesce(next, {END})
        UNION ALL SELECT next, 'recovered', host, 0, {DAY // 8} FROM gaps WHERE last + {DAY // 8} + 1 <= next AND next < last + {7 * DAY} + 1""",
)
def _(spark, d):
    return batch.fold(_arriving(spark, d), Silence(DAY // 8, {"host1": 0}), until=END)


@query(
    "rate_limit_hosts",
    f"""WITH RECURSIVE logs AS ({LOGS_SQL}), rows AS (SELECT id, host, ts AS arrival, row_number() OVER (PARTITION BY host ORDER BY ts, id) AS rn FROM logs),
        folded AS (
            SELECT id, host, arrival, rn, 2::DOUBLE AS tokens, true AS allowed FROM rows WHERE rn = 1
            UNION ALL
            SELECT id, host, arrival, rn, tokens - CASE WHEN tokens >= 1 THEN 1 ELSE 0 END, tokens >= 1
            FROM (SELECT r.id, r.host, r.arrival, r.rn, least(3::DOUBLE, f.tokens + (r.arrival - f.arrival) / 1000::DOUBLE * (1::DOUBLE / 3600)) AS tokens FROM folded f JOIN rows r ON r.host = f.host AND r.rn = f.rn + 1))
        SELECT id, host, arrival, allowed FROM folded""",
)
def _(spark, d):
    return batch.fold(_arriving(spark, d), RateLimit(1 / 3600, 3))


@query(
    "rate_limit_all",
    f"""WITH RECURSIVE logs AS ({LOGS_SQL}), rows AS (SELECT id, host, CAST(substr(host, 5) AS INTEGER) + 1 AS i, ts AS now, row_number() OVER (ORDER BY ts, id) AS rn FROM logs),
        lists AS MATERIALIZED (SELECT list(now ORDER BY rn) AS nows, list(i ORDER BY rn) AS hosts, count(*) AS n FROM rows),
        folded AS (
            SELECT CAST(0 AS BIGINT) AS now, CAST(0 AS BIGINT) AS rn, [3::DOUBLE for x in range(10)] AS had, [CAST(NULL AS BIGINT) for x in range(10)] AS seen, 8::DOUBLE AS whole, CAST(NULL AS BIGINT) AS since, false AS allowed
            UNION ALL
            SELECT now, rn, [CASE WHEN x + 1 = i THEN CASE WHEN NOT one THEN t WHEN two THEN t - 1 ELSE t - 1 + 1 END ELSE had[x + 1] END for x in range(10)], [CASE WHEN x + 1 = i THEN now ELSE seen[x + 1] END for x in range(10)],
                CASE WHEN NOT one THEN whole WHEN two THEN w - 1 ELSE w END, CASE WHEN one THEN now ELSE since END, two
            FROM (SELECT *, t >= 1 AS one, t >= 1 AND w >= 1 AS two
                FROM (SELECT l.nows[f.rn + 1] AS now, l.hosts[f.rn + 1] AS i, f.rn + 1 AS rn, f.had, f.seen, f.whole, f.since, least(3::DOUBLE, f.had[l.hosts[f.rn + 1]] + (l.nows[f.rn + 1] - coalesce(f.seen[l.hosts[f.rn + 1]], l.nows[f.rn + 1])) / 1000::DOUBLE * (1::DOUBLE / 3600)) AS t, least(8::DOUBLE, f.whole + (l.nows[f.rn + 1] - coalesce(f.since, l.nows[f.rn + 1])) / 1000::DOUBLE * (5::DOUBLE / 3600)) AS w
                    FROM folded f, lists l WHERE f.rn < l.n)))
        SELECT r.id, r.host, r.now AS arrival, f.allowed FROM folded f JOIN rows r USING (rn)""",
)
def _(spark, d):
    return batch.fold(_arriving(spark, d), BothLimits(1 / 3600, 3, 5 / 3600, 8))
