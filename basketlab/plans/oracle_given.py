"""DuckDB oracle SQL of the operators on given labels, scores and ids."""
from __future__ import annotations

from basketlab.plans import oracle_reco
from basketlab.plans.fixtures_sql import with_fixtures
from basketlab.plans.oracle_aggregates import q as agg_q
from basketlab.plans.oracle_seg import _profile_sql, q as seg_q

GIVEN = {
    "given": """
  SELECT session_id, is_converted AS label,
         CAST(('0x' || substr(md5(session_id), 1, 3)) AS INTEGER) / 4096.0 AS p
  FROM fx_sessions""",
    "cm": """
  SELECT count(*) FILTER (WHERE label = 0 AND p < 0.5) AS tn,
         count(*) FILTER (WHERE label = 0 AND p >= 0.5) AS fp,
         count(*) FILTER (WHERE label = 1 AND p < 0.5) AS fn,
         count(*) FILTER (WHERE label = 1 AND p >= 0.5) AS tp
  FROM given""",
    "per": """
  SELECT 'not converted' AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall,
         CAST(tn + fp AS DOUBLE) AS support FROM cm
  UNION ALL
  SELECT 'converted', tp / (tp + fp), tp / (tp + fn), CAST(tp + fn AS DOUBLE) FROM cm""",
    "perf": "SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM per",
    "steps": """
  SELECT p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM given GROUP BY p""",
    "curve": """
  SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         lead(pos) OVER (ORDER BY p DESC) AS next_pos, lead(neg) OVER (ORDER BY p DESC) AS next_neg,
         row_number() OVER (ORDER BY p DESC) AS nth
  FROM steps WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""",
    "bends": """
  SELECT row_number() OVER (ORDER BY p DESC) AS i, fp, tp FROM curve
  WHERE nth = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""",
}

R9 = "round({0}, 9) AS {0}"

ORACLE = {
    "scorecard_on_given_scores": with_fixtures("""
SELECT tn, fp, fn, tp, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall,
       round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM cm""", GIVEN),
    "report_on_given_scores": with_fixtures("""
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, support,
       round(f1, 9) AS f1 FROM perf
UNION ALL
SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), sum(support),
       round(avg(f1), 9) FROM perf
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
       round(sum(recall * support) / sum(support), 9), sum(support),
       round(sum(f1 * support) / sum(support), 9) FROM perf""", GIVEN),
    "auc_on_given_scores": with_fixtures("""
SELECT round(sum(pos * (2.0 * ((SELECT sum(neg) FROM steps) - fp) + neg))
             / (2.0 * (SELECT sum(pos) FROM steps) * (SELECT sum(neg) FROM steps)), 9) AS roc_auc
FROM curve""", GIVEN),
    "roc_on_given_scores": with_fixtures("""
SELECT CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT i, round(fp / (SELECT sum(neg) FROM steps), 9), round(tp / (SELECT sum(pos) FROM steps), 9)
FROM bends WHERE i % 5 = 0""", GIVEN),
    "chosen_k_on_given_sweep": with_fixtures("""
, sweep AS (SELECT CAST(user_id % 7 + 2 AS INTEGER) AS k,
                   round(avg(CASE WHEN age > 40 THEN 1 ELSE 0 END), 6) AS silhouette
            FROM fx_users GROUP BY 1),
b AS (SELECT k, silhouette FROM sweep WHERE k >= 3 ORDER BY silhouette DESC, k LIMIT 1),
g AS (SELECT k, silhouette FROM sweep ORDER BY silhouette DESC, k LIMIT 1)
SELECT b.k, b.silhouette, g.k AS global_k, g.silhouette AS global_silhouette,
       g.k < 3 AS global_rejected FROM b, g"""),
    "segments_by_tier": seg_q("""
, n AS (SELECT cluster, base_name || repeat(' II', CAST(row_number() OVER (
               PARTITION BY base_name ORDER BY cluster) - 1 AS INTEGER)) AS name, size FROM named)
SELECT t.user_id, t.cluster, n.name, n.size FROM tiers t JOIN n USING (cluster)""",
                              _profile_sql()),
    "rejected_sessions": agg_q("""
SELECT session_id, CASE WHEN h IN ('d') THEN 'hour must be 0 to 23; age must be at least 0'
                        WHEN h = 'f' THEN 'hour must be 0 to 23'
                        ELSE 'age must be at least 0' END AS reason
FROM (SELECT *, substr(md5(session_id), 1, 1) AS h FROM session_features)
WHERE h IN ('d', 'e', 'f')""", "session_features"),
    "recommendations_for_ids": oracle_reco.q("""
SELECT CAST(user_id AS VARCHAR) AS requested, 'found' AS status, rank, product_id, score, strategy
FROM recs
UNION ALL
SELECT CAST(user_id + 1000000000 AS VARCHAR), 'unknown', NULL, NULL, NULL, NULL
FROM fx_users WHERE user_id % 10 = 0""",
                                             oracle_reco.reco_sql(
        5, "SELECT user_id FROM fx_users WHERE user_id % 10 <> 0")),
    "reloaded_recommendations": oracle_reco.ORACLE["recommendations"],
}
