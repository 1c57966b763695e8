"""Oracle SQL of the evaluation formulas, written independently of the Spark form."""

from __future__ import annotations


def auc_sql(source: str, keys=(), score: str = "probability", label: str = "label") -> str:
    """Mid-rank AUC and threshold-wise average precision per key."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    lead = f"{k}, " if keys else ""
    group = f"GROUP BY {k}" if keys else ""
    same = " AND ".join(f"a.{x} = t.{x}" for x in keys) or "TRUE"
    return f"""
    SELECT {', '.join('a.' + x for x in keys) + ', ' if keys else ''}a.positives, a.negatives, a.roc_auc, t.pr_auc FROM (
      SELECT {lead}CAST(SUM({label}) AS BIGINT) AS positives, CAST(SUM(1 - {label}) AS BIGINT) AS negatives,
             CASE WHEN SUM({label}) > 0 AND SUM(1 - {label}) > 0 THEN
               (SUM(CASE WHEN {label} = 1 THEN mid ELSE 0 END) - SUM({label}) * (SUM({label}) + 1) / 2.0::DOUBLE)
               / CAST(SUM({label}) * SUM(1 - {label}) AS DOUBLE) END AS roc_auc
      FROM (SELECT *, RANK() OVER ({part} ORDER BY {score})
                   + (COUNT(*) OVER (PARTITION BY {lead}{score}) - 1) / 2.0::DOUBLE AS mid FROM {source}) m {group}) a
    LEFT JOIN (
      SELECT {lead}CASE WHEN MAX(tp) > 0 THEN SUM(hits * CAST(tp AS DOUBLE) / (tp + fp)) / MAX(tp) END AS pr_auc FROM (
        SELECT {lead}{score}, hits, SUM(hits) OVER ({part} ORDER BY {score} DESC) AS tp,
               SUM(misses) OVER ({part} ORDER BY {score} DESC) AS fp
        FROM (SELECT {lead}{score}, SUM({label}) AS hits, SUM(1 - {label}) AS misses FROM {source} GROUP BY {lead}{score}) c) d
      {group}) t ON {same}"""


def binary_sql(source: str, keys=(), score: str = "probability", label: str = "label") -> str:
    lead = ", ".join(keys) + ", " if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
    SELECT *, (tp + tn) / n::DOUBLE AS accuracy, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS recall,
           CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE END AS specificity,
           CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0 END AS f1
    FROM (SELECT {lead}COUNT(*) AS n, COUNT(*) FILTER (WHERE {label} = 1) AS positive, COUNT(*) FILTER (WHERE {label} <> 1) AS negative,
                 COUNT(*) FILTER (WHERE {label} = 1 AND {score} >= 0.5) AS tp, COUNT(*) FILTER (WHERE {label} <> 1 AND {score} >= 0.5) AS fp,
                 COUNT(*) FILTER (WHERE {label} <> 1 AND {score} < 0.5) AS tn, COUNT(*) FILTER (WHERE {label} = 1 AND {score} < 0.5) AS fn,
                 AVG(({score} - {label}) * ({score} - {label})) AS brier FROM {source} {group}) b"""
