"""Meeting analytics in SQL over a star built from conversations: meetings, key moments, themes, action items.

Stand-ins: a conversation is a meeting; a turn is a key moment whose type follows its number; the theme follows the
conversation's number, a second one its length; user turns are action items owned by their number modulo seven.
"""

from __future__ import annotations

from .registry import Registry
from .relational import dec

R = Registry()
M = """meetings AS (SELECT conv_id AS id, count(*) AS turns, CAST(sum(length(text)) AS DOUBLE) AS duration, CASE conv_id % 4 WHEN 0 THEN 'external' WHEN 1 THEN 'internal' WHEN 2 THEN 'support' ELSE 'sales' END AS call_type, CASE conv_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS sentiment, CAST(1 + conv_id % 5 AS DOUBLE) AS score FROM conversations GROUP BY conv_id),
moments AS (SELECT conv_id AS id, turn, text, CASE (turn + conv_id) % 5 WHEN 0 THEN 'churn_signal' WHEN 1 THEN 'technical_issue' WHEN 2 THEN 'feature_gap' WHEN 3 THEN 'praise' ELSE 'concern' END AS type FROM conversations),
themes AS (SELECT conv_id AS id, concat('theme', CAST(conv_id % 6 AS STRING)) AS theme, true AS is_primary FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, concat('theme', CAST((conv_id + count(*)) % 6 AS STRING)), false FROM conversations GROUP BY conv_id HAVING count(*) % 6 <> 0),
actions AS (SELECT conv_id AS id, turn AS item_index, concat('owner', CAST(turn % 7 AS STRING)) AS owner FROM conversations WHERE role = 'user'),
products AS (SELECT conv_id AS id, CASE WHEN turn % 2 = 0 THEN 'Comply' ELSE 'Detect' END AS product FROM conversations GROUP BY 1, 2)"""


def q(name: str, covers: str, body: str, oracle: str | None = None) -> None:
    R.sql(name, covers, f"WITH {M} {body}", f"WITH {M} {oracle}" if oracle else None)


q("mt_theme_volume", "A-03 insight-1", f"SELECT theme, count(*) AS n, CAST(sum(CASE WHEN is_primary THEN 1 ELSE 0 END) AS BIGINT) AS primaries, {dec('100.0 * sum(CASE WHEN is_primary THEN 1 ELSE 0 END) / count(*)')} AS pct FROM themes GROUP BY theme")
q("mt_theme_sentiment", "J-01 insight-2", f"SELECT theme, sentiment, count(*) AS n, {dec('avg(score)')} AS mean FROM themes JOIN meetings USING (id) GROUP BY theme, sentiment")
q("mt_net_sentiment", "A-06 insight-3", f"SELECT theme, count(DISTINCT t.id) AS meetings, {dec('100.0 * (count(*) FILTER (WHERE sentiment = ' + chr(39) + 'positive' + chr(39) + ') - count(*) FILTER (WHERE sentiment = ' + chr(39) + 'negative' + chr(39) + ')) / nullif(count(*), 0)')} AS net FROM themes t JOIN meetings m ON m.id = t.id WHERE is_primary GROUP BY theme")
q("mt_churn_density", "A-06 insight-4", f"SELECT theme, count(*) AS signals, {dec('1.0 * count(*) / count(DISTINCT k.id)', 4)} AS density FROM moments k JOIN themes t ON t.id = k.id AND t.is_primary WHERE type = 'churn_signal' GROUP BY theme")
q("mt_call_type_pct", "A-08 insight-5", f"SELECT call_type, count(*) AS n, {dec('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM meetings GROUP BY call_type")
q("mt_call_type_theme", "J-01 insight-6", "SELECT call_type, theme, count(*) AS n FROM meetings JOIN themes USING (id) WHERE is_primary GROUP BY call_type, theme")
q("mt_watchlist", "J-02 S-01 insight-7", "SELECT m.id, call_type, sentiment, count(*) FILTER (WHERE type = 'churn_signal') AS churn, count(*) FILTER (WHERE type = 'concern') AS concerns FROM meetings m JOIN moments k ON k.id = m.id JOIN themes t ON t.id = m.id AND t.is_primary WHERE sentiment = 'negative' GROUP BY m.id, call_type, sentiment HAVING count(*) FILTER (WHERE type = 'churn_signal') > 0 ORDER BY churn DESC, m.id LIMIT 20")
q("mt_bleed", "J-11 insight-8", "SELECT id FROM meetings WHERE id IN (SELECT id FROM themes WHERE theme = 'theme1') AND id IN (SELECT id FROM moments WHERE type = 'churn_signal')")
q("mt_feature_gaps", "A-06 insight-9", "SELECT product, count(*) AS gaps, count(DISTINCT k.id) AS meetings FROM moments k JOIN products p ON p.id = k.id WHERE type = 'feature_gap' GROUP BY product")
q("mt_cooccurrence", "J-08 insight-10", "SELECT a.theme AS a, b.theme AS b, count(*) AS n FROM themes a JOIN themes b ON a.id = b.id AND a.theme < b.theme GROUP BY 1, 2")
q("mt_pricing_fan_out", "J-26 S1", f"SELECT theme, count(*) AS n, {dec('sum(duration)')} AS total FROM themes t JOIN moments k ON k.id = t.id JOIN meetings m ON m.id = t.id GROUP BY theme")
q("mt_pricing_once", "A-16 S1", f"SELECT theme, {dec('sum(duration)')} AS total FROM (SELECT DISTINCT theme, t.id, duration FROM themes t JOIN moments k ON k.id = t.id JOIN meetings m ON m.id = t.id) x GROUP BY theme")
q("mt_actions_per_meeting", "A-07 S4", f"SELECT theme, count(*) AS items, {dec('1.0 * count(*) / nullif(count(DISTINCT a.id), 0)', 4)} AS per_meeting FROM actions a JOIN themes t ON t.id = a.id AND is_primary GROUP BY theme")
q("mt_durations", "A-11 S5", f"SELECT call_type, {dec('min(duration)')} AS lo, {dec('avg(duration)')} AS mean, {dec('max(duration)')} AS hi FROM meetings GROUP BY call_type")
q("mt_moments", "A-08 S7", f"SELECT type, count(*) AS n, {dec('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM moments GROUP BY type")
q("mt_text_samples", "J-02 S3 E1", "SELECT theme, id, turn, left(text, 40) AS sample FROM (SELECT theme, k.id, turn, text, row_number() OVER (PARTITION BY theme ORDER BY length(text) DESC, k.id, turn) AS rn FROM moments k JOIN themes t ON t.id = k.id AND is_primary WHERE type = 'churn_signal') x WHERE rn <= 3")
q("mt_pivots", "A-06 E2", "SELECT call_type, count(DISTINCT m.id) AS n FROM meetings m JOIN moments k ON k.id = m.id WHERE sentiment = 'positive' AND type IN ('concern', 'technical_issue') GROUP BY call_type")
q("mt_profile_mode", "A-09 P4", "SELECT theme, count(*) AS n, mode() WITHIN GROUP (ORDER BY call_type) AS usual FROM themes JOIN meetings USING (id) GROUP BY theme", "SELECT theme, n, call_type AS usual FROM (SELECT theme, call_type, sum(count(*)) OVER (PARTITION BY theme) AS n, row_number() OVER (PARTITION BY theme ORDER BY count(*) DESC, call_type) AS rn FROM themes JOIN meetings USING (id) GROUP BY 1, 2) x WHERE rn = 1".replace("sum(count(*)) OVER (PARTITION BY theme) AS n", "CAST(sum(count(*)) OVER (PARTITION BY theme) AS BIGINT) AS n"))
q("mt_participants_bucketed", "A-16 O1", f"SELECT CASE WHEN turns <= 3 THEN 'small' WHEN turns <= 6 THEN 'medium' ELSE 'large' END AS band, count(*) AS n, {dec('avg(score)', 4)} AS mean FROM meetings GROUP BY 1")
q("mt_owners", "A-06 O2", "SELECT owner, count(*) AS items, count(DISTINCT id) AS meetings FROM actions GROUP BY owner ORDER BY items DESC, owner LIMIT 5")
q("mt_examples", "A-13 chart-examples", "SELECT theme, id FROM (SELECT theme, t.id, row_number() OVER (PARTITION BY theme ORDER BY score DESC, t.id) AS rn FROM themes t JOIN meetings m ON m.id = t.id) x WHERE rn = 1")
q("mt_product_signals", "J-26 chart-product-signals", "SELECT product, count(k1.turn) AS tech, count(k2.turn) AS churn FROM products p LEFT JOIN moments k1 ON k1.id = p.id AND k1.type = 'technical_issue' LEFT JOIN moments k2 ON k2.id = p.id AND k2.type = 'churn_signal' GROUP BY product")
q("mt_profile_left", "J-04 A-04 store-insights", "SELECT theme, count(DISTINCT t.id) AS meetings, count(k.turn) FILTER (WHERE k.type = 'praise') AS praise, count(k.turn) FILTER (WHERE k.type = 'concern') AS concern FROM themes t LEFT JOIN moments k ON k.id = t.id AND t.is_primary GROUP BY theme")
q("mt_escalation", "A-04 A-05 guide-Su2", "SELECT call_type, count(*) FILTER (WHERE type = 'churn_signal') AS churn, count(*) FILTER (WHERE type = 'technical_issue') AS tech FROM meetings m JOIN moments k ON k.id = m.id GROUP BY call_type HAVING count(*) FILTER (WHERE type = 'churn_signal') + count(*) FILTER (WHERE type = 'technical_issue') > 0")
q("mt_competitors", "PF-04 guide-S1", "SELECT m.call_type, count(*) AS n FROM moments k JOIN meetings m ON m.id = k.id WHERE text ILIKE '%tion%' OR text ILIKE '%than%' GROUP BY m.call_type")

QUERIES, ORACLES, COVERS = R.queries, R.oracles, R.covers
