"""The jobs as queries: each runs twice over whole tables into one new folder, and gives the output read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girthline.functions.arrays import as_text
from girthline.queries import CAND3, MEASURED3, E
from girthline.sources.scratch import fresh_path

from . import shot_symptoms, trapping_sets

#: As in trapping_sets.json.
SEARCH = {"check": "l_partkey", "variable": "l_orderkey", "girth": 4, "amax": 3, "bounds": [0, 0, 5, 3], "leaves": True, "singletons": True}


def twice(job: Callable[..., DataFrame], spark: SparkSession, table: str, label: str, settings: dict) -> DataFrame:
    folder = fresh_path(spark, label)
    job(spark, table, f"{folder}/output", f"{folder}/checkpoint", settings)
    return job(spark, table, f"{folder}/output", f"{folder}/checkpoint", settings)


def job1_shot_symptoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = twice(shot_symptoms.run, spark, f"{sf_dir}/documents.parquet", "job1", {})
    return x.withColumn("checks", F.array_join("checks", ",")).withColumn("weight", F.col("weight").cast("long")).withColumn("width", F.col("width").cast("long"))


def job2_trapping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = twice(trapping_sets.run, spark, f"{sf_dir}/lineitem.parquet", "job2", SEARCH)
    return x.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "kind", as_text(F.col("vs")).alias("vs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_shot_symptoms": job1_shot_symptoms, "job2_trapping_sets": job2_trapping_sets}

SQL: dict[str, str] = {
    "job1_shot_symptoms": r"""
    WITH d AS (SELECT row_number() OVER () AS v, doc_id, text FROM documents),
    l AS (SELECT v, unnest(string_split(text, chr(10))) AS line FROM d),
    f AS (SELECT v, md5(line) AS c FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY v, line HAVING count(*) % 2 = 1),
    s AS (SELECT v, list_sort(list(c)) AS cs FROM f GROUP BY v),
    x AS (SELECT doc_id, coalesce(cs, []) AS cs FROM d LEFT JOIN s USING (v))
    SELECT md5(array_to_string(cs, ',')) AS symptom, len(cs)::BIGINT AS weight, array_to_string(cs, ',') AS checks, count(*) AS shots, min(doc_id) AS first_id,
           count(*) / (SELECT count(*) FROM d)::DOUBLE AS p, least(len(cs), 50)::BIGINT AS width
    FROM x GROUP BY cs""",
    "job2_trapping_sets": f"""
    WITH {E}, {CAND3}, {MEASURED3},
    one AS (SELECT a.v AS v1, b.v AS v2, x.dv + y.dv - 2 AS b FROM e a JOIN e b ON a.c = b.c AND a.v < b.v JOIN d x ON x.v = a.v JOIN d y ON y.v = b.v
      WHERE x.dv + y.dv - 2 <= 3 GROUP BY a.v, b.v, x.dv, y.dv HAVING count(*) = 1),
    q AS (SELECT v1, v2, b FROM one WHERE b BETWEEN 1 AND 3 UNION ALL SELECT v1, v2, b FROM s WHERE b BETWEEN 1 AND 3),
    kq AS (SELECT v1, v2, b, e.c, count(*) AS t FROM q JOIN e ON e.v IN (v1, v2) GROUP BY ALL),
    o1 AS (SELECT v1, v2, b, e.v, count_if(t = 1) AS odd, count_if(t = 2) AS even FROM kq JOIN e ON e.c = kq.c WHERE e.v NOT IN (v1, v2) GROUP BY ALL),
    l3 AS (SELECT DISTINCT list_sort([v1, v2, o1.v]) AS l, b + dv - 2 AS b FROM o1 JOIN d ON d.v = o1.v WHERE odd = 1 AND even = 0 AND b + dv - 2 <= 3)
    SELECT 1::BIGINT AS a, dv AS b, 'leafy' AS kind, v::VARCHAR AS vs FROM d WHERE dv <= 3
    UNION ALL SELECT 2, b, 'leafless', v1 || ',' || v2 FROM s WHERE b <= 3 UNION ALL SELECT 2, b, 'leafy', v1 || ',' || v2 FROM one
    UNION ALL SELECT 3, b, 'leafless', v1 || ',' || v2 || ',' || v3 FROM m WHERE elementary AND b <= 3
    UNION ALL SELECT 3, b, 'leafy', array_to_string(l, ',') FROM l3""",
}
