"""The shared test tables in the roles of businesses, reviews, photos and vectors.

Each role is one projection, written once for Spark (``*_df``) and once as a SQL common table
expression (``WITH_*``). Texts are varied by id so that every branch of the review filter occurs.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"


_TEXT = "CASE doc_id % 11 WHEN 0 THEN '' WHEN 1 THEN '  !!! ' WHEN 2 THEN substr(text, 1, 10) WHEN 3 THEN NULL ELSE concat(' ', text, ' ') END"
_REVIEWS = f"SELECT CAST(d.doc_id AS STRING) AS review_id, nullif(d.source, 'src7') AS business_id, {_TEXT} AS text, CAST(l.quality AS DOUBLE) AS stars, d.doc_id AS ord FROM documents d LEFT JOIN labels l USING (doc_id)"
_CATS = "CASE s_suppkey % 4 WHEN 0 THEN ' Restaurants, Food,, ' WHEN 1 THEN 'Hotels ,NIGHTLIFE' WHEN 2 THEN concat('Cafes, Coffee & Tea,', n_name) ELSE concat(n_name, ', ', r_name, ',') END"
_ATTRS = """concat('{"WiFi":"', CASE s_suppkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'None' ELSE '' END, '","GoodForKids":"', n_nationkey % 2, '","Alcohol":"full","BusinessParking":"{', chr(39), 'garage', chr(39), ': False, ', chr(39), 'lot', chr(39), ': True}"}')"""
_HOURS = """CASE WHEN s_suppkey % 5 = 0 THEN '{}' WHEN s_suppkey % 7 = 0 THEN 'closed' ELSE concat('{"Monday":"9:0-', s_suppkey % 12, ':0","Friday":"8:0-20:0"}') END"""
_BUSINESS = f"SELECT concat('src', s_suppkey) AS business_id, s_name AS name, n_name AS city, r_name AS state, round(s_acctbal, 2) AS stars, CAST(s_suppkey AS BIGINT) AS review_count, CASE s_suppkey % 6 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END AS is_open, {_CATS} AS categories_text, {_ATTRS} AS attributes, {_HOURS} AS hours, s_suppkey AS ord FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_PHOTOS = "SELECT CAST(page_id AS STRING) AS photo_id, concat('src', page_id % 20) AS business_id, CASE WHEN page_id % 5 = 0 THEN '   ' ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS caption, regexp_extract(html, 'lang=.([a-z]+)', 1) AS label, concat('photos/', page_id, '.jpg') AS image_path, contains(html, '</html>') AS image_valid, page_id AS ord FROM pages"
_VECTORS = "SELECT vec_id, concat('g', label) AS business_id, embedding FROM embeddings"

WITH_REVIEWS = "reviews AS (" + _REVIEWS + ")"
WITH_BUSINESS = "business AS (" + _BUSINESS + ")"
WITH_PHOTOS = "photos AS (" + _PHOTOS + ")"
WITH_VECTORS = "vectors AS (" + _VECTORS + ")"
#: categories of ``business`` as a list
SQL_CATS = f"list_filter(list_transform(string_split(categories_text, ','), lambda x: lower({sql_strip('x')})), lambda x: x <> '')"
#: first rule that a review breaks, over its stripped text ``t``
SQL_REASON = r"CASE WHEN coalesce(review_id, '') = '' OR coalesce(business_id, '') = '' THEN 'missing_identifier' WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '^[^\p{L}\p{N}]+$') THEN 'symbol_only' WHEN length(t) < 20 THEN 'too_short' END"
WITH_REASONED = f"reasoned AS (SELECT *, {SQL_REASON} AS filter_reason FROM (SELECT *, coalesce({sql_strip('text')}, '') AS t FROM reviews))"


def _select(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    # a view's plan is taken over when the statement is analysed, which is here
    views = {n: f"placeloom_{n}_{uuid.uuid4().hex}" for n in names}
    for n, view in views.items():
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createTempView(view)
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b(?! [a-z]\b)", rf"\1 {view} {n}", sql)
        sql = re.sub(rf"\b(FROM|JOIN) {n}(?= [a-z]\b)", rf"\1 {view}", sql)
    try:
        return spark.sql(sql)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, _REVIEWS, "documents", "labels")


def business_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, _BUSINESS, "supplier", "nation", "region")


def photos_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, _PHOTOS, "pages")


def vectors_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, _VECTORS, "embeddings")
