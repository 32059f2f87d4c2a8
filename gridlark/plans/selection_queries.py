"""Queries of selections: quotas with box limits and reasons, tolerance joins, ordered choices with a fallback, group choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators import quota
from gridlark.plans.queries import _DECIDED, _decided, query
from gridlark.plans.source_queries import ORACLES, QUERIES
from gridlark.tables import Written

__all__ = ["ORACLES", "QUERIES"]


# Images by class at most 60; boxes at most 90 of a class, 30 of class 0, any number of class 3. What the quota leaves out gets its
# reason on all of its boxes.
@query(f"""WITH RECURSIVE {_DECIDED},
im AS (SELECT scene, image_id, round_even(avg(round(quality, 9)), 9) AS mean, list_transform(range(0, 6), lambda i: 0) AS z,
       [count(*) FILTER (WHERE class_id = 0), count(*) FILTER (WHERE class_id = 1), count(*) FILTER (WHERE class_id = 2), count(*) FILTER (WHERE class_id = 3), count(*) FILTER (WHERE class_id = 4), count(*) FILTER (WHERE class_id = 5)] AS n
       FROM dc WHERE accepted GROUP BY scene, image_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY mean DESC, image_id) AS rn FROM im),
st AS (
  SELECT DISTINCT scene, CAST(0 AS BIGINT) AS rn, [0, 0, 0, 0, 0, 0]::BIGINT[] AS i, [0, 0, 0, 0, 0, 0]::BIGINT[] AS b, CAST(NULL AS BIGINT) AS image_id, false AS sel FROM rk
  UNION ALL
  SELECT rk.scene, rk.rn, CASE WHEN f.ok THEN list_transform(range(1, 7), lambda c: st.i[c] + least(rk.n[c], 1)) ELSE st.i END,
         CASE WHEN f.ok THEN list_transform(range(1, 7), lambda c: st.b[c] + rk.n[c]) ELSE st.b END, rk.image_id, f.ok
  FROM st JOIN rk ON rk.scene = st.scene AND rk.rn = st.rn + 1,
  LATERAL (SELECT len(list_filter(range(1, 7), lambda c: rk.n[c] > 0 AND (st.i[c] >= 60 OR (c <> 4 AND st.b[c] + rk.n[c] > CASE c WHEN 1 THEN 30 ELSE 90 END)))) = 0 AS ok) f
), no AS (SELECT scene, image_id FROM st WHERE image_id IS NOT NULL AND NOT sel)
SELECT dc.image_id, pred_idx, accepted AND no.image_id IS NULL AS accepted, array_to_string(CASE WHEN no.image_id IS NULL THEN reasons ELSE list_append(reasons, 'balanced_class_quota') END, '|') AS reasons
FROM dc LEFT JOIN no ON no.image_id = dc.image_id AND no.scene = dc.scene""")
def l11_box_quota(spark: SparkSession, d: str) -> DataFrame:
    rows = _decided(spark, d).select(F.col("scene").alias("group"), "image_id", "pred_idx", "class_id", "quality_score", "accepted", "reasons")
    rows = Written(spark, "decided").table(rows)  # read by the quota and by what follows from it
    chosen = quota.class_quota(rows, 60, 90, {0: 30, 3: 0})
    return quota.with_quota(rows, chosen, earlier_rejects=True).select("image_id", "pred_idx", "accepted", F.array_join("reasons", "|").alias("reasons"))
