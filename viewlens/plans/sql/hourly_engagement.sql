-- Engagement per date and hour, parsing event time under :time_format.
WITH timed AS (
    SELECT *, try_to_timestamp(TIMESTAMP, :time_format) AS viewed_at
    FROM {activity}
    WHERE DURATION IS NOT NULL
)
SELECT
    date_format(hour_start, 'yyyy-MM-dd') AS view_date,
    total_unique_users, total_views, total_watch_time, avg_watch_time,
    most_watched_title, most_watched_genre,
    date_format(hour_start, 'HH') AS hour_of_day
FROM (
    SELECT
        date_trunc('HOUR', viewed_at) AS hour_start,
        approx_count_distinct(USER_ID, 0.02) AS total_unique_users,
        count(*) AS total_views,
        sum(CAST(DURATION AS BIGINT)) AS total_watch_time,
        avg(CAST(DURATION AS DOUBLE)) AS avg_watch_time,
        max(CASE WHEN TITLE IS NOT NULL THEN struct(arrival, TITLE) END).TITLE AS most_watched_title,
        max(CASE WHEN GENRES IS NOT NULL THEN struct(arrival, GENRES) END).GENRES AS most_watched_genre
    FROM timed
    WHERE viewed_at IS NOT NULL
    GROUP BY date_trunc('HOUR', viewed_at)
)
