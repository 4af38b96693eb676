"""The same logical inputs as common table expressions, for the SQL beside each query."""

FRAMES = """frames AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
 epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS t_ms, value AS raw, event_type, event_id FROM events)"""
PROFILE = (
    FRAMES
    + """, tops AS (SELECT video_id, list_sort(list(raw))[CAST(floor((count(*) - 1) * 0.99 + 0.5) AS INT) + 1] AS top FROM frames GROUP BY video_id),
prof AS (SELECT f.*, CAST(CASE WHEN top > 0 THEN least(raw / top, 1.0) ELSE 0.0 END AS FLOAT) AS score, event_type = 'error' AS is_scene_cut
 FROM frames f JOIN tops USING (video_id))"""
)
SCORES = PROFILE + """, scores AS (SELECT video_id, event_type, row_number() OVER (PARTITION BY video_id, event_type ORDER BY t_ms, event_id) - 1 AS w, score FROM prof)"""
DIMENSION = "dim(label, category, severity) AS (VALUES ('error','alarm','critical'), ('signup','distress','critical'), ('purchase','vehicle','warning'), ('view','machine','info'), ('click','human','info'))"
EVENTS = (
    PROFILE
    + f""", {DIMENSION}, ev AS (SELECT video_id, event_id AS pos, label, category, severity, t_ms / 1000.0::DOUBLE AS "start",
 t_ms / 1000.0::DOUBLE + raw * 600 AS "end", score FROM prof JOIN dim ON event_type = label)"""
)
TRUTH = FRAMES + ", gt AS (SELECT video_id, t_ms FROM frames WHERE event_type = 'error'), pred AS (SELECT video_id, t_ms FROM frames WHERE event_type = 'purchase')"
MARKS = """marks AS (SELECT vec_id, CAST(list_sum([CASE WHEN embedding[i + 1] > embedding[i + 2] THEN 1::HUGEINT << i ELSE 0::HUGEINT END FOR i IN range(63)]) AS BIGINT) AS dhash FROM embeddings)"""
MARKED = PROFILE + f", {MARKS}, mprof AS (SELECT p.*, m.dhash FROM prof p JOIN marks m ON m.vec_id = (p.video_id * 31 + p.idx) % (SELECT count(*) FROM embeddings))"
