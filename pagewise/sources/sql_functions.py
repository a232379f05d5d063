"""The lookups of the original as SQL functions with parameters, for use from ``spark.sql``.

``register`` makes temporary functions over a log's tables; their names begin
with a prefix of the caller's, so several logs can stand beside each other:

* ``<prefix>_label(code, scheme)``: the category label;
* ``<prefix>_profile(reader)``, ``<prefix>_shelf(reader, scheme)``, ``<prefix>_progress(reader)``: rows of one reader.

A table function also takes a column: ``FROM reader r, LATERAL x_shelf(r.user_id, 'alt')`` is a join.  Spark
inlines the bodies, so a constant reader reaches the scans as a pushed filter.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagewise.functions.category import category_label
from pagewise.schema import SHELF_KEY
from pagewise.sources.binding import ReadingLog


def register(spark: SparkSession, log: ReadingLog, prefix: str) -> None:
    kind = log.reader.schema["user_id"].dataType.simpleString()
    log.reader.createOrReplaceTempView(f"{prefix}_t_reader")
    labelled = {f"label_{s}": category_label("b_category", s) for s in ("kdc", "alt")}
    log.shelf.withColumns(labelled).createOrReplaceTempView(f"{prefix}_t_shelf")
    per_book = log.record.groupBy(*SHELF_KEY).agg(F.sum("r_page").alias("cur_sum"))
    per_book.createOrReplaceTempView(f"{prefix}_t_progress")
    codes = spark.range(0, 1000, 100).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("b_category"))
    for scheme, name in (("kdc", "label_kdc"), ("alt", "label_alt")):
        codes = codes.withColumn(name, category_label("b_category", scheme))
    pairs = {s: " ".join(f"WHEN '{r.b_category}' THEN '{r[f'label_{s}']}'" for r in codes.collect()) for s in ("kdc", "alt")}  # ten codes
    other = {s: spark.range(1).select(category_label(F.lit(None).cast("string"), s).alias("x")).first().x for s in ("kdc", "alt")}
    case = {s: f"CASE code {pairs[s]} ELSE '{other[s]}' END" for s in ("kdc", "alt")}
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_label(code STRING, scheme STRING) RETURNS STRING "
        f"RETURN CASE scheme WHEN 'alt' THEN {case['alt']} ELSE {case['kdc']} END"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_profile(reader {kind}) RETURNS TABLE(user_nm STRING, user_email STRING) "
        f"RETURN SELECT user_nm, user_email FROM {prefix}_t_reader WHERE user_id = {prefix}_profile.reader"
    )
    isbn = log.shelf.schema["b_isbn"].dataType.simpleString()
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_shelf(reader {kind}, scheme STRING) "
        f"RETURNS TABLE(b_isbn {isbn}, b_end_yn STRING, b_title STRING, b_author STRING, b_category STRING, b_page INT, b_dicount BIGINT, b_create_dt STRING, b_update_dt STRING) "
        f"RETURN SELECT b_isbn, b_end_yn, b_title, b_author, CASE {prefix}_shelf.scheme WHEN 'alt' THEN label_alt ELSE label_kdc END, b_page, b_dicount, "
        f"date_format(b_create_dt, 'yyyy-MM-dd'), date_format(b_update_dt, 'yyyy-MM-dd') FROM {prefix}_t_shelf WHERE user_id = {prefix}_shelf.reader"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_progress(reader {kind}) "
        f"RETURNS TABLE(b_isbn {isbn}, b_title STRING, b_author STRING, cur_page BIGINT, b_page INT, to_page BIGINT, b_create_dt DATE) "
        f"RETURN SELECT s.b_isbn, s.b_title, s.b_author, coalesce(p.cur_sum, 0), s.b_page, s.b_page - coalesce(p.cur_sum, 0), s.b_create_dt "
        f"FROM {prefix}_t_shelf s LEFT JOIN {prefix}_t_progress p ON s.user_id = p.user_id AND s.b_isbn = p.b_isbn "
        f"WHERE s.user_id = {prefix}_progress.reader AND s.b_end_yn = 'N'"
    )
