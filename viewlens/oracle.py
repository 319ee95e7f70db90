"""The registered queries as SQL over the same tables, for DuckDB to check."""

from __future__ import annotations

ACTIVITY = """
activity AS (
    SELECT
        CAST(user_id AS VARCHAR) AS "USER_ID",
        CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "TIMESTAMP",
        event_type AS "ACTIVITY_TYPE",
        json_extract_string(props, '$.k') AS "TITLE_ID",
        CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 0
             ELSE CAST(trunc(value) AS INTEGER) END AS "DURATION",
        CAST(NULL AS VARCHAR) AS "DEVICE_TYPE",
        CAST(NULL AS VARCHAR) AS "LOCATION",
        'title_' || json_extract_string(props, '$.k') AS "TITLE",
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'genre_' || (event_id % 6) END AS "GENRES",
        strftime(DATE '2000-01-01' + CAST(event_id % 365 AS INTEGER), '%Y-%m-%d') AS "RELEASE_DATE",
        json_extract_string(props, '$.k') AS "MOVIE_ID",
        event_id - event_id % 1024 + event_id % 1024 * 7919 % 1024 AS arrival,
        event_id
    FROM events
)"""

TIMED = """,
timed AS (
    SELECT * FROM (
        SELECT *, try_strptime("TIMESTAMP", '%Y-%m-%d %H:%M:%S') AS event_timestamp FROM activity
    ) WHERE event_timestamp IS NOT NULL
)"""

VIEWED = """,
viewed AS (
    SELECT *, CAST(event_timestamp AS DATE) AS day, strftime(event_timestamp, '%Y-%m-%d') AS day_text,
           strftime(event_timestamp, '%H') AS hour_text, CAST(hour(event_timestamp) AS INTEGER) AS hour
    FROM timed WHERE "DURATION" IS NOT NULL
)"""

_RECORD = (
    '"USER_ID", "TIMESTAMP", "ACTIVITY_TYPE", "TITLE_ID", "DURATION", "DEVICE_TYPE", "LOCATION", '
    '"TITLE", "GENRES", "RELEASE_DATE", "MOVIE_ID"'
)
_JSON_RECORD = "to_json({" + ", ".join(f"{c.strip()}: {c.strip()}" for c in _RECORD.split(",")) + "})"

_COUNT = "count(*)"
_SUM = 'CAST(sum("DURATION") AS BIGINT)'
_AVG = 'avg(CAST("DURATION" AS DOUBLE))'
_USERS = 'count(DISTINCT "USER_ID")'
_ROW_TIME = "strftime(max(event_timestamp), '%Y-%m-%d %H:%M:%S')"


def _latest(column: str) -> str:
    return f"struct_extract(max({{'p': arrival, 'v': \"{column}\"}}) FILTER (WHERE \"{column}\" IS NOT NULL), 'v')"


_LATEST_ATTRIBUTES = f'{_latest("GENRES")} AS genres, {_latest("RELEASE_DATE")} AS release_date'
_MAX_ATTRIBUTES = 'max("GENRES") AS genres, max("RELEASE_DATE") AS release_date'
_LATEST_WATCHED = (
    f'{_latest("TITLE")} AS most_watched_title, {_latest("GENRES")} AS most_watched_genre'
)
_TITLE = f"{_COUNT} AS total_views, {_AVG} AS avg_duration, {_SUM} AS total_duration"
_DAY = f"{_COUNT} AS total_views, {_SUM} AS total_watch_time, {_AVG} AS avg_watch_time"
_WINDOW_START = "strftime(day, '%Y-%m-%d %H:%M:%S')"

_PEAK = """,
peak AS (
    SELECT day, hour AS peak_hour FROM (
        SELECT day, hour, row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, hour) AS place
        FROM viewed GROUP BY day, hour
    ) WHERE place = 1
)"""


def _top(name: str, column: str) -> str:
    return f""",
{name} AS (
    SELECT day, value FROM (
        SELECT day, "{column}" AS value, row_number() OVER (
            PARTITION BY day ORDER BY count(*) DESC, sum("DURATION") DESC, "{column}") AS place
        FROM viewed WHERE "{column}" IS NOT NULL GROUP BY day, "{column}"
    ) WHERE place = 1
)"""


_TOPS = _top("top_title", "TITLE") + _top("top_genre", "GENRES")


def _activity(select: str) -> str:
    return f"WITH {ACTIVITY}\n{select}"


def _timed(select: str) -> str:
    return f"WITH {ACTIVITY}{TIMED}\n{select}"


def _viewed(select: str, more: str = "") -> str:
    return f"WITH {ACTIVITY}{TIMED}{VIEWED}{more}\n{select}"


def _titles(aggregates: str) -> str:
    return _viewed(f'SELECT "TITLE" AS title, {aggregates} FROM viewed GROUP BY "TITLE"')


_DOCUMENTED = _viewed(
    f"""SELECT d.day AS view_date, d.total_unique_users, d.total_views, d.total_watch_time, d.avg_watch_time,
       t.value AS most_watched_title, g.value AS most_watched_genre, p.peak_hour
FROM (SELECT day, {_USERS} AS total_unique_users, {_DAY} FROM viewed GROUP BY day) d
LEFT JOIN top_title t USING (day) LEFT JOIN top_genre g USING (day) JOIN peak p USING (day)""",
    _PEAK + _TOPS,
)

_DAILY_ROWTIME = _viewed(
    f"""SELECT strftime(d.day, '%Y-%m-%d') AS view_date, d.* EXCLUDE (day), p.peak_hour
FROM (SELECT day, {_USERS} AS total_unique_users, {_DAY}, {_LATEST_WATCHED}, {_ROW_TIME} AS update_time
      FROM viewed GROUP BY day) d JOIN peak p USING (day)""",
    _PEAK,
)

_DAILY_WINDOWED = _viewed(
    f"""SELECT strftime(day, '%Y-%m-%d') AS view_date, {_USERS} AS total_unique_users, {_DAY}, {_LATEST_WATCHED},
       '00' AS window_hour
FROM viewed GROUP BY day"""
)

_MERGEABLE = _viewed(
    f"""SELECT day AS view_date, {_USERS} AS total_unique_users, {_DAY}, TRUE AS same_from_rows, TRUE AS within_bound
FROM viewed GROUP BY day"""
)

_HOURLY = _viewed(
    f"""SELECT day_text AS view_date, {_USERS} AS total_unique_users, {_DAY}, {_LATEST_WATCHED},
       hour_text AS hour_of_day
FROM viewed GROUP BY day_text, hour_text"""
)

_TITLE_WINDOWED = _viewed(
    f"""SELECT "TITLE" AS title, {_TITLE}, {_LATEST_ATTRIBUTES}, {_WINDOW_START} AS window_start
FROM viewed GROUP BY day, "TITLE\""""
)

_DAILY_TITLE_SELECT = f"""SELECT day AS view_date, "TITLE" AS title, {_COUNT} AS daily_views,
       {_SUM} AS total_watch_time, {_AVG} AS avg_watch_time, {_USERS} AS unique_viewers, {_MAX_ATTRIBUTES}
FROM viewed GROUP BY day, "TITLE\""""

_TITLE_MAX = _titles(f"{_TITLE}, {_MAX_ATTRIBUTES}")

#: The key's Murmur2 hash, byte by byte from its hexadecimal form, and offsets in order of arrival.
_M = "1540483477) % 4294967296"
LOGGED = f""",
logged AS (
    SELECT * EXCLUDE (d, n, w, h), CAST((xor(h, h >> 15) & 2147483647) % 6 AS INTEGER) AS "partition"
    FROM (SELECT * REPLACE (((xor(h, h >> 13) * {_M}) AS h) FROM (
        SELECT * REPLACE (CASE WHEN n % 4 > 0 THEN (xor(h, CAST(list_sum(list_transform(range(n % 4),
            lambda i: CAST('0x' || substr(d, 2 * (n - n % 4 + i) + 1, 2) AS BIGINT) << (8 * i))) AS BIGINT)) * {_M} ELSE h END AS h)
        FROM (SELECT *, list_reduce(list_transform(w, lambda k: (xor(k, k >> 24) * {_M}), lambda h, k: xor((h * {_M}, k),
                                    xor(2538058380, n)) AS h
        FROM (SELECT *, list_transform(range(n // 4), lambda j: (CAST('0x' || substr(d, 8 * j + 7, 2) || substr(d, 8 * j + 5, 2)
                   || substr(d, 8 * j + 3, 2) || substr(d, 8 * j + 1, 2) AS BIGINT) * {_M}) AS w
        FROM (SELECT *, hex(encode("USER_ID")) AS d, octet_length(encode("USER_ID")) AS n FROM activity)))))
), log AS (
    SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY arrival) - 1 AS "offset" FROM logged
)"""


def _log(select: str) -> str:
    return f"WITH {ACTIVITY}{LOGGED}\n{select}"


def _avro_text(column: str) -> str:
    return f"""'02' || printf('%02X', 2 * octet_length(encode("{column}"))) || hex(encode("{column}"))"""


ORACLE: dict[str, str] = {
    "activity_record": _activity(
        f"""SELECT * REPLACE ('view' AS "ACTIVITY_TYPE") FROM (SELECT {_RECORD} FROM activity)"""
    ),
    "activity_source": _log(f'SELECT {_RECORD}, "partition", "offset" FROM log'),
    "avro_messages": _log(f'SELECT {_RECORD}, "partition", "offset" FROM log'),
    "keyed_log": _log('SELECT event_id, "USER_ID" AS key, "partition", "offset" FROM log'),
    # the header, then for each field its branch and its length doubled, as both are below 64
    "avro_dead_letters": _log(
        f"""SELECT "USER_ID" AS key, left('0000000007' || {" || ".join(map(_avro_text, ("USER_ID", "TIMESTAMP", "ACTIVITY_TYPE", "TITLE_ID")))}, 40) AS value,
       "partition", "offset" FROM log WHERE "offset" % 13 = 0"""
    ),
    "keyed_messages": _activity(f'SELECT "USER_ID" AS key, CAST({_JSON_RECORD} AS VARCHAR) AS value FROM activity'),
    "log_replay": _TITLE_MAX,
    "latest_by_log_position": _titles(_LATEST_ATTRIBUTES),
    "dead_letters": _log(
        f"""SELECT "USER_ID" AS key, left(CAST({_JSON_RECORD} AS VARCHAR), 20) AS value, "partition", "offset"
FROM log WHERE "offset" % 13 = 0"""
    ),
    "metrics_json": _viewed(
        """SELECT CAST(to_json({'view_date': strftime(view_date, '%Y-%m-%d'), 'title': title}) AS VARCHAR) AS key,
       CAST(to_json({'view_date': strftime(view_date, '%Y-%m-%d'), 'title': title, 'daily_views': daily_views,
                     'total_watch_time': total_watch_time, 'avg_watch_time': avg_watch_time,
                     'unique_viewers': unique_viewers, 'genres': genres, 'release_date': release_date}) AS VARCHAR) AS value
FROM results""",
        f""",
results AS ({_DAILY_TITLE_SELECT})""",
    ),
    "param_query": _viewed(
        f'SELECT "TITLE" AS title, {_TITLE}, {_LATEST_ATTRIBUTES} FROM viewed WHERE "DURATION" >= 1 GROUP BY "TITLE"'
    ),
    "param_query_hourly": _HOURLY,
    "upsert_latest": _TITLE_MAX,
    "upsert_latest_rows": _activity(
        """SELECT "USER_ID", "TITLE", "DURATION", "GENRES" FROM (
    SELECT *, row_number() OVER (PARTITION BY "USER_ID" ORDER BY event_id DESC) AS place FROM activity
) WHERE place = 1"""
    ),
    "changelog_read": _TITLE_MAX,
    "event_time": _timed(
        """SELECT "USER_ID", "TIMESTAMP", arrival, strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') AS event_timestamp
FROM timed"""
    ),
    "event_time_t_format": _timed(
        """SELECT "USER_ID", strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S') AS "TIMESTAMP", arrival,
       strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') AS event_timestamp
FROM timed"""
    ),
    "event_time_rejects": _activity(
        f"""SELECT {_RECORD}, arrival FROM activity WHERE try_strptime("TIMESTAMP", '%Y-%m-%d %H:%M:%S') IS NULL"""
    ),
    "filter_duration": _activity(f'SELECT {_RECORD}, arrival FROM activity WHERE "DURATION" IS NOT NULL'),
    "scalar_time": _timed(
        """SELECT arrival, CAST(event_timestamp AS DATE) AS view_date, strftime(event_timestamp, '%Y-%m-%d') AS view_date_text,
       strftime(event_timestamp, '%H') AS hour_text, CAST(hour(event_timestamp) AS INTEGER) AS hour_of_day
FROM timed"""
    ),
    "scalar_epoch_roundtrip": _timed(
        """SELECT arrival, "TIMESTAMP", strftime(epoch_ms(epoch_ms(event_timestamp)), '%Y-%m-%d %H:%M:%S') AS same_time
FROM timed"""
    ),
    "scalar_duration": """SELECT event_id, duration, CAST(trunc(CAST(duration AS DOUBLE)) AS INTEGER) AS duration_seconds
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN '0.0'
                            ELSE CAST(value AS VARCHAR) END AS duration FROM events)""",
    "agg_count": _titles(f"{_COUNT} AS total_views"),
    "agg_avg": _titles(f"{_AVG} AS avg_duration"),
    "agg_sum": _titles(f"{_SUM} AS total_duration"),
    "agg_max_string": _titles(_MAX_ATTRIBUTES),
    "agg_latest_by_offset": _titles(_LATEST_ATTRIBUTES),
    "agg_count_distinct": _titles(f"{_USERS} AS unique_viewers"),
    "agg_approx_distinct": _viewed(
        f"SELECT day AS view_date, {_USERS} AS total_unique_users, TRUE AS within_bound FROM viewed GROUP BY day"
    ),
    "agg_approx_distinct_bound": _viewed(
        f"SELECT day AS view_date, {_USERS} AS exact_users, TRUE AS within_bound FROM viewed GROUP BY day"
    ),
    "agg_approx_distinct_mergeable": _MERGEABLE,
    "stream_daily_users_mergeable": _MERGEABLE,
    "agg_rowtime": _titles(f"{_ROW_TIME} AS update_time"),
    "agg_most_watched": _viewed(
        """SELECT d.day AS view_date, t.value AS most_watched_title, g.value AS most_watched_genre
FROM (SELECT DISTINCT day FROM viewed) d LEFT JOIN top_title t USING (day) LEFT JOIN top_genre g USING (day)""",
        _TOPS,
    ),
    "agg_peak_hour": _viewed("SELECT day AS view_date, peak_hour FROM peak", _PEAK),
    "tumbling_day": _viewed(
        f"""SELECT {_WINDOW_START} AS window_start, strftime(day + 1, '%Y-%m-%d %H:%M:%S') AS window_end,
       {_COUNT} AS total_views
FROM viewed GROUP BY day"""
    ),
    "title_metrics_windowed": _TITLE_WINDOWED,
    "daily_engagement_windowed": _DAILY_WINDOWED,
    "daily_engagement_windowed_approx": f"SELECT *, TRUE AS within_bound FROM ({_DAILY_WINDOWED})",
    "title_metrics_rowtime": _titles(f"{_TITLE}, {_LATEST_ATTRIBUTES}, {_ROW_TIME} AS update_time"),
    "daily_engagement_rowtime": _DAILY_ROWTIME,
    "title_metrics_latest": _titles(f"{_TITLE}, {_LATEST_ATTRIBUTES}"),
    "hourly_engagement": _HOURLY,
    "hourly_engagement_approx": f"SELECT *, TRUE AS within_bound FROM ({_HOURLY})",
    "title_metrics_max": _TITLE_MAX,
    "daily_title_engagement": _viewed(_DAILY_TITLE_SELECT),
    "daily_engagement_documented": _DOCUMENTED,
    "stored_title_metrics_windowed": _TITLE_WINDOWED,
    "stored_daily_title_engagement": _viewed(_DAILY_TITLE_SELECT),
    "stream_title_metrics": _titles(f"{_TITLE}, {_LATEST_ATTRIBUTES}, {_USERS} AS unique_viewers"),
    "stream_tumbling_day": _viewed(
        f"""SELECT "TITLE" AS title, {_TITLE}, {_MAX_ATTRIBUTES}, {_WINDOW_START} AS window_start
FROM viewed GROUP BY day, "TITLE\""""
    ),
    "stream_title_metrics_windowed": _TITLE_WINDOWED,
    "stream_daily_engagement_windowed": _DAILY_WINDOWED,
    "stream_daily_engagement_rowtime": _DAILY_ROWTIME,
    "stream_hourly_engagement": _HOURLY,
    "stream_daily_title_engagement": _viewed(_DAILY_TITLE_SELECT),
    "stream_daily_engagement_documented": _DOCUMENTED,
    "stream_daily_documented_changes": _DOCUMENTED,
    "stream_title_metrics_max": _TITLE_MAX,
    "stream_from_savepoint": _TITLE_WINDOWED,
    "stream_rescaled": _DAILY_ROWTIME,
    "state_changes": _viewed(_DAILY_TITLE_SELECT),
    "upsert_bucketed": _viewed(_DAILY_TITLE_SELECT),
    "stream_json_changelog": f"""SELECT CAST(to_json({{'title': title}}) AS VARCHAR) AS key,
       CAST(to_json({{'title': title, 'total_views': total_views, 'avg_duration': avg_duration,
                      'total_duration': total_duration, 'genres': genres, 'release_date': release_date}}) AS VARCHAR) AS value
FROM ({_TITLE_MAX})""",
    "stream_late_row_table": _viewed(
        """SELECT event_id, "USER_ID", "TITLE", "DURATION", strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') AS event_timestamp
FROM (SELECT *, max(event_timestamp) FILTER (WHERE event_id % 50 <> 7) OVER () - INTERVAL 1 DAY AS mark FROM timed_days)
WHERE event_id % 50 = 7 AND day + 1 <= mark""",
        """,
timed_days AS (SELECT * FROM viewed)""",
    ),
    "query_status": _viewed(
        """SELECT 'titles' AS query, 'stopped' AS status, CAST(3 AS BIGINT) AS batches, (SELECT count(*) FROM events) AS input_rows,
       count(DISTINCT "TITLE") AS state_rows, CAST(NULL AS BOOLEAN) AS broken FROM viewed
UNION ALL SELECT 'failing', 'failed', 0, 0, 0, TRUE"""
    ),
    # a late row is kept if its day ends after the watermark, a day behind the newest time in order
    "stream_late_rows": _viewed(
        """SELECT CAST(count(*) FILTER (WHERE NOT late OR day + 1 > mark) AS BIGINT) AS kept,
       CAST(count(*) FILTER (WHERE late AND day + 1 <= mark) AS BIGINT) AS dropped
FROM (SELECT day, event_id % 50 = 7 AS late,
             max(event_timestamp) FILTER (WHERE event_id % 50 <> 7) OVER () - INTERVAL 1 DAY AS mark FROM viewed)"""
    ),
}
