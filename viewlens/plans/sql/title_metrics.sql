-- Views and durations per title, parsing event time under :time_format
-- and keeping views of at least :min_duration seconds.
SELECT
    TITLE AS title,
    count(*) AS total_views,
    avg(CAST(DURATION AS DOUBLE)) AS avg_duration,
    sum(CAST(DURATION AS BIGINT)) AS total_duration,
    max(CASE WHEN GENRES IS NOT NULL THEN struct(arrival, GENRES) END).GENRES AS genres,
    max(CASE WHEN RELEASE_DATE IS NOT NULL THEN struct(arrival, RELEASE_DATE) END).RELEASE_DATE AS release_date
FROM {activity}
WHERE DURATION >= :min_duration
  AND try_to_timestamp(TIMESTAMP, :time_format) IS NOT NULL
GROUP BY TITLE
