"""SQL text of the helper views, for the DuckDB oracle side.

The Spark side builds the same tables with the DataFrame API
(``duelframe.plans.contest``); these strings only serve the differential
check, where DuckDB runs them on the same Parquet files.
"""

NUMBERED = """numbered AS (
  SELECT event_type, ts, event_id, user_id, value,
         ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn
  FROM events)"""

CONTEST = """contest AS (
  SELECT a.event_type AS league, b.event_id AS game_key,
         CAST(datediff('day', DATE '2024-01-01', CAST(b.ts AS DATE)) AS BIGINT) AS day_num,
         CASE WHEN a.value > b.value THEN a.user_id ELSE b.user_id END AS w_id,
         CASE WHEN a.value > b.value THEN b.user_id ELSE a.user_id END AS l_id,
         GREATEST(a.value, b.value) AS w_score,
         LEAST(a.value, b.value) AS l_score,
         CASE WHEN b.event_id % 5 = 0 THEN 'N'
              WHEN b.event_id % 5 = 4 THEN 'A' ELSE 'H' END AS w_loc
  FROM numbered a JOIN numbered b
    ON a.event_type = b.event_type AND b.rn = a.rn + 1 AND a.rn % 2 = 0
  WHERE a.user_id <> b.user_id AND a.value <> b.value)"""

TEAM_GAME = """team_game AS (
  SELECT league, game_key, day_num, w_id AS team_id, l_id AS opp_id,
         w_score AS points, l_score AS allowed, w_loc AS loc, 1 AS win FROM contest
  UNION ALL
  SELECT league, game_key, day_num, l_id, w_id, l_score, w_score,
         CASE w_loc WHEN 'H' THEN 'A' WHEN 'A' THEN 'H' ELSE 'N' END, 0 FROM contest)"""

TENURE = """tenure AS (
  SELECT DISTINCT user_id AS team_id, CONCAT('M', CAST(user_id % 20 AS VARCHAR)) AS manager,
         0 AS first_day, CASE WHEN user_id % 3 = 0 THEN 14 ELSE 2147483647 END AS last_day
  FROM events
  UNION ALL
  SELECT DISTINCT user_id, CONCAT('M', CAST((user_id + 7) % 20 AS VARCHAR)), 16, 2147483647
  FROM events WHERE user_id % 3 = 0)"""

PUBLICATION = """publication AS (
  SELECT league, pub_day, team_id, ordinal FROM (
    SELECT e.event_type AS league, d.pub_day, e.user_id AS team_id,
           ROW_NUMBER() OVER (PARTITION BY e.event_type, d.pub_day
                              ORDER BY ROUND(SUM(e.value), 2) DESC, e.user_id) AS ordinal
    FROM events e JOIN (
      SELECT event_type, UNNEST(generate_series(7, MAX(datediff('day', DATE '2024-01-01', CAST(ts AS DATE))), 7)) AS pub_day
      FROM events GROUP BY event_type) d
      ON e.event_type = d.event_type AND datediff('day', DATE '2024-01-01', CAST(e.ts AS DATE)) < d.pub_day
    GROUP BY e.event_type, d.pub_day, e.user_id) t)"""

PERIODS_SEASON = """periods AS (
  SELECT league, pub_day AS period_start,
         COALESCE(LEAD(pub_day) OVER (PARTITION BY league ORDER BY pub_day) - 1, pub_day + 6) AS period_end
  FROM (SELECT DISTINCT league, pub_day FROM publication) p)"""

PERIODS_FILE = """periods AS (
  SELECT league, pub_day AS period_start,
         COALESCE(LEAD(pub_day) OVER (ORDER BY league, pub_day) - 1, pub_day + 6) AS period_end
  FROM (SELECT DISTINCT league, pub_day FROM publication) p)"""

RANKED = """ranked AS (
  SELECT p.league, p.period_start, p.period_end, u.team_id, u.ordinal
  FROM periods p LEFT JOIN publication u
    ON p.league = u.league AND p.period_start = u.pub_day)"""

ACTIVE_RANK = """active AS (
  SELECT t.*, r.ordinal
  FROM team_game t LEFT JOIN ranked r
    ON t.league = r.league AND t.team_id = r.team_id
   AND r.period_start <= t.day_num AND t.day_num <= r.period_end)"""

CONF = """conf AS (
  SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def with_views(*ctes: str, body: str) -> str:
    """``WITH`` the given views, then ``body``. A body that starts with
    ``, name AS (...)`` continues the view list before its ``SELECT``."""
    return "WITH " + ",\n".join(ctes) + "\n" + body.lstrip("\n")


GAME_VIEWS = (NUMBERED, CONTEST)
TEAM_VIEWS = (NUMBERED, CONTEST, TEAM_GAME)
