"""One query for each operator of the place engine over the shared tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import modelout as M
from ..functions import text as X
from ..operators import align, catalog, contract, model_calls, parse, planning, retrieval, similarity, stats, tallies, vectors
from ..sources import archive_tables, images, row_sink, tables
from ..sources.images import png_bytes as _png_bytes  # noqa: F401 (tests make files with it)
from . import roles as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_V = f"WITH {R.WITH_REVIEWS}, {R.WITH_REASONED}"
_VALID = f"{_V}, valid AS (SELECT * FROM reasoned WHERE filter_reason IS NULL)"
_B = f"WITH {R.WITH_BUSINESS}, b AS (SELECT *, {R.SQL_CATS} AS cats FROM business)"
_P = f"WITH {R.WITH_PHOTOS}"
_CAPTION = R.sql_strip("caption")
_MAP_B = "json_valid(attributes)"
_KIND = """CASE WHEN list_has_any(cats, ['cafes', 'coffee & tea']) THEN 'Cafe' WHEN list_has_any(cats, ['restaurants', 'food']) THEN 'Restaurant' WHEN list_has_any(cats, ['hotels', 'hotel']) THEN 'Hotel'
 WHEN list_has_any(cats, ['arts & entertainment', 'museums', 'landmarks & historical buildings', 'parks']) THEN 'Attraction' WHEN list_has_any(cats, ['shopping']) THEN 'Shopping' WHEN list_has_any(cats, ['nightlife']) THEN 'Nightlife' ELSE 'POI' END"""
_RELEVANT = "list_has_any(cats, ['" + "', '".join(catalog.RELEVANT) + "'])"
_DESCRIPTION = """concat_ws(' | ', nullif(name, ''), nullif(array_to_string(cats, ', '), ''), nullif(city, ''), nullif(state, ''), 'rated ' || CAST(stars AS VARCHAR),
 concat('Alcohol: full, BusinessParking: {''garage'': False, ''lot'': True}, GoodForKids: ', json_extract_string(attributes, '$.GoodForKids'), ', WiFi: ', json_extract_string(attributes, '$.WiFi')),
 CASE WHEN hours LIKE '{"M%' THEN concat('hours: Friday ', json_extract_string(hours, '$.Friday'), ', Monday ', json_extract_string(hours, '$.Monday')) END)"""
_LABELS = """array_to_string(list_sort(list_filter(['Alcohol', 'BusinessParking', 'GoodForKids', CASE WHEN json_extract_string(attributes, '$.WiFi') = 'free' THEN 'WiFi' END, CASE WHEN hours LIKE '{"M%' THEN 'hours' END], lambda x: x IS NOT NULL)), '|')"""


def _reasoned(spark, sf_dir):
    return parse.with_reason(R.reviews_df(spark, sf_dir))


def _valid(spark, sf_dir):
    return parse.valid_reviews(_reasoned(spark, sf_dir))


def _businesses(spark, sf_dir):
    """With categories as an array; attributes and hours stay JSON text."""
    return R.business_df(spark, sf_dir).withColumn("categories", X.categories(F.col("categories_text")))


def _images(spark, sf_dir):
    return align.valid_images(R.photos_df(spark, sf_dir))


def _bar(col):
    return F.array_join(col, "|")


def _long(col):
    return F.col(col).cast("long").alias(col) if isinstance(col, str) else col.cast("long")


# ---- reviews


@_query(f"""{_V} SELECT count(*) AS input_reviews, CAST(count_if(filter_reason IS NULL) AS BIGINT) AS valid_reviews, CAST(count_if(filter_reason = 'missing_identifier') AS BIGINT) AS filtered_missing_identifier,
CAST(count_if(filter_reason = 'empty') AS BIGINT) AS filtered_empty, CAST(count_if(filter_reason = 'symbol_only') AS BIGINT) AS filtered_symbol_only, CAST(count_if(filter_reason = 'too_short') AS BIGINT) AS filtered_too_short FROM reasoned""")
def review_filter_cascade(spark, sf_dir):
    return parse.review_counts(_reasoned(spark, sf_dir))


@_query(f"{_VALID} SELECT review_id, business_id, stars, t AS text FROM valid")
def review_valid_rows(spark, sf_dir):
    return _valid(spark, sf_dir).select("review_id", "business_id", "stars", "text")


@_query(f"{_VALID} SELECT business_id, count(*) AS valid_review_count, round(avg(stars), 6) AS average_review_stars FROM valid GROUP BY business_id")
def review_stats_by_group(spark, sf_dir):
    return parse.review_stats(_valid(spark, sf_dir)).withColumn("average_review_stars", F.round("average_review_stars", 6))


@_query(rf"WITH {R.WITH_REVIEWS} SELECT business_id, count(*) AS n FROM reviews WHERE regexp_matches({R.sql_strip('text')}, '^[^\p{{L}}\p{{N}}]+$') GROUP BY business_id")
def symbol_only_docs(spark, sf_dir):
    return R.reviews_df(spark, sf_dir).filter(X.symbols_only(X.strip(F.col("text")))).groupBy("business_id").agg(F.count("*").alias("n"))


@_query(f"{_VALID}, r AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY ord) AS i FROM valid) SELECT review_id, business_id, i AS place FROM r WHERE i <= 5")
def first_n_reviews_per_group(spark, sf_dir):
    from pyspark.sql import Window

    first = align.first_of_each(_valid(spark, sf_dir), "business_id", 5)
    return first.select("review_id", "business_id", F.row_number().over(Window.partitionBy("business_id").orderBy("ord")).cast("long").alias("place"))


@_query(f"{_VALID}, images AS (SELECT DISTINCT business_id FROM ({R._PHOTOS}) WHERE image_valid), r AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY ord) AS i FROM valid WHERE business_id IN (SELECT business_id FROM images)) SELECT review_id, business_id FROM r WHERE i <= 3")
def semi_join_reviews(spark, sf_dir):
    return align.bounded_reviews(_valid(spark, sf_dir), _images(spark, sf_dir), 3).select("review_id", "business_id")


@_query("""WITH d AS (SELECT doc_id, lang, source FROM documents) SELECT count(*) AS input_documents, CAST(count_if(lang IS NOT NULL AND lang <> '' AND lang <> 'fr') AS BIGINT) AS parsed_documents, CAST(count_if(lang IS NULL OR lang = '' OR lang = 'fr') AS BIGINT) AS missing_lang FROM d""")
def parse_counters(spark, sf_dir):
    return parse.parse_counts(R.table(spark, sf_dir, "documents").select(F.when(F.col("lang") != "fr", F.col("lang")).alias("lang")), "lang", "documents")


@_query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def limited_records(spark, sf_dir):
    return parse.first_rows(R.table(spark, sf_dir, "documents").select("doc_id", "lang"), 25, "doc_id")


# ---- businesses and catalog


@_query(f"SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(concat(p_type, ' , ', upper(p_brand), ',,\t', p_name), ','), lambda x: lower({R.sql_strip('x')})), lambda x: x <> ''), '|') AS categories FROM part")
def category_normalize(spark, sf_dir):
    text = F.concat("p_type", F.lit(" , "), F.upper("p_brand"), F.lit(",,\t"), "p_name")
    return R.table(spark, sf_dir, "part").select("p_partkey", _bar(X.categories(text)).alias("categories"))


@_query(f"{_B} SELECT business_id, {_KIND} AS category FROM b")
def primary_category_rules(spark, sf_dir):
    return _businesses(spark, sf_dir).select("business_id", catalog.main_kind(F.col("categories")).alias("category"))


@_query(f"{_B} SELECT business_id FROM b WHERE is_open IS DISTINCT FROM 0 AND {_RELEVANT}")
def allowlist_filter(spark, sf_dir):
    return catalog.selected(_businesses(spark, sf_dir)).select("business_id")


@_query(f"{_B} SELECT business_id FROM b WHERE {_RELEVANT} ORDER BY ord LIMIT 7")
def allowlist_with_closed_limited(spark, sf_dir):
    return catalog.selected(_businesses(spark, sf_dir), 7, include_closed=True).select("business_id")


@_query(f"""{_B} SELECT 'poi_' || business_id AS poi_id, business_id, name, {_KIND} AS category, city, state, stars AS rating, review_count, array_to_string(list_sort(list_distinct(cats)), '|') AS tags,
concat_ws(' ', nullif(name, ''), {_KIND}, nullif(city, ''), nullif(state, '')) AS description FROM b WHERE is_open IS DISTINCT FROM 0 AND {_RELEVANT}""")
def poi_projection(spark, sf_dir):
    frame = catalog.selected(_businesses(spark, sf_dir)).withColumns({"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    return catalog.places(frame).select("poi_id", "business_id", "name", "category", "city", "state", "rating", "review_count", _bar("tags").alias("tags"), "description")


def _catalog(spark, sf_dir):
    return catalog.selected(_businesses(spark, sf_dir)).select("business_id", F.concat(F.lit("poi_"), "business_id").alias("poi_id"))


@_query(f"""{_VALID}, business AS ({R._BUSINESS}), b AS (SELECT *, {R.SQL_CATS} AS cats FROM business), c AS (SELECT business_id FROM b WHERE is_open IS DISTINCT FROM 0 AND {_RELEVANT}),
r AS (SELECT valid.*, row_number() OVER (PARTITION BY business_id ORDER BY ord) AS i FROM valid JOIN c USING (business_id)) SELECT review_id, 'poi_' || business_id AS poi_id, business_id, stars AS rating, t AS text FROM r WHERE i <= 5""")
def subset_reviews(spark, sf_dir):
    return catalog.place_reviews(_valid(spark, sf_dir), _catalog(spark, sf_dir)).select("review_id", "poi_id", "business_id", "rating", "text")


@_query(f"""WITH {R.WITH_PHOTOS}, {R.WITH_BUSINESS}, b AS (SELECT *, {R.SQL_CATS} AS cats FROM business), c AS (SELECT business_id FROM b WHERE is_open IS DISTINCT FROM 0 AND {_RELEVANT})
SELECT 'photo_' || photo_id AS item_id, 'poi_' || business_id AS poi_id, business_id, photo_id, concat('photos/', photo_id, '.jpg') AS image_path, caption, label FROM photos JOIN c USING (business_id)""")
def subset_photos(spark, sf_dir):
    return catalog.place_photos(R.photos_df(spark, sf_dir), _catalog(spark, sf_dir)).drop("source")


@_query(f"""{_B} SELECT business_id, {_DESCRIPTION} AS business_description FROM b""")
def business_description(spark, sf_dir):
    b = _businesses(spark, sf_dir)
    text = A.description(F.col("name"), F.col("categories"), F.col("city"), F.col("state"), F.col("stars"), A.as_map(F.col("attributes")), A.as_map(F.col("hours")))
    return b.select("business_id", text.alias("business_description"))


@_query(f"""{_B} SELECT business_id, {_LABELS} AS labels FROM b""")
def attr_labels(spark, sf_dir):
    return R.business_df(spark, sf_dir).select("business_id", _bar(A.dimension_labels(A.as_map(F.col("attributes")), A.as_map(F.col("hours")))).alias("labels"))


@_query(f"""WITH {R.WITH_BUSINESS} SELECT business_id, concat('attr_BusinessParking_garage=false|attr_BusinessParking_lot=true|attr_GoodForKids=', json_extract_string(attributes, '$.GoodForKids'), '|attr_WiFi=', json_extract_string(attributes, '$.WiFi')) AS flat FROM business""")
def attr_flatten(spark, sf_dir):
    entries = F.array_sort(F.map_entries(A.flattened(A.as_map(F.col("attributes")))))
    return R.business_df(spark, sf_dir).select("business_id", _bar(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("flat"))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events")
def json_attr_map(spark, sf_dir):
    return R.table(spark, sf_dir, "events").select("event_id", A.as_map(F.col("props")).alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.size("m").cast("long").alias("n_keys"))


@_query("""SELECT event_id, concat('{"k":"', json_extract_string(props, '$.k'), '","type":"', event_type, '"}') AS stable FROM events""")
def nested_fields_as_json(spark, sf_dir):
    m = F.map_concat(F.create_map(F.lit("type"), F.col("event_type")), A.as_map(F.col("props")))
    return R.table(spark, sf_dir, "events").select("event_id", A.sorted_json(m).alias("stable"))


@_query("""SELECT event_id, concat('{"user": ', user_id, ', "ok": ', CASE WHEN value > 5 THEN 'true' ELSE 'null' END, '}') AS attrs FROM events""")
def python_literal_attrs(spark, sf_dir):
    text = F.concat(F.lit("{u'user': "), F.col("user_id").cast("string"), F.lit(", 'ok': "), F.when(F.col("value") > 5, "True").otherwise("None"), F.lit("}"))
    return A.with_literals(R.table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", "attrs").drop("text")


# ---- alignment


@_query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, round(arg_max(o_totalprice, o_orderkey), 2) AS o_totalprice FROM orders GROUP BY o_custkey")
def dedup_last_wins(spark, sf_dir):
    rows = R.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    return align.last_of_each(rows, "o_custkey", "o_orderkey")


@_query(f"{_P}, r AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY ord) AS i FROM photos) SELECT photo_id, business_id FROM r WHERE i <= 3")
def first_n_photos_per_group(spark, sf_dir):
    return align.first_of_each(R.photos_df(spark, sf_dir), "business_id", 3).select("photo_id", "business_id")


@_query(f"{_P} SELECT 'strong_' || photo_id AS pair_id, photo_id, business_id, image_path, {_CAPTION} AS caption, label, 'strong' AS alignment_type FROM photos WHERE image_valid AND {_CAPTION} <> ''")
def strong_alignment(spark, sf_dir):
    return align.strong(R.photos_df(spark, sf_dir), _images(spark, sf_dir))


@_query(f"""WITH {R.WITH_PHOTOS}, {R.WITH_BUSINESS}, b AS (SELECT *, {R.SQL_CATS} AS cats FROM business) SELECT 'medium_' || photo_id AS pair_id, photo_id, business_id, image_path, {_DESCRIPTION} AS business_description, {_LABELS} AS labels, 'medium' AS alignment_type
FROM photos JOIN b USING (business_id) WHERE image_valid""")
def medium_alignment(spark, sf_dir):
    out = align.medium(R.photos_df(spark, sf_dir), _images(spark, sf_dir), _businesses(spark, sf_dir))
    return out.withColumn("labels", _bar("attribute_dimension_labels")).drop("attribute_dimension_labels")


_WEAK = f"""{_VALID}, photos AS ({R._PHOTOS}),
p AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY ord) AS i FROM photos WHERE image_valid), v AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY ord) AS i FROM valid),
pg AS (SELECT business_id, string_agg(photo_id, '|' ORDER BY i) AS photo_ids, string_agg(image_path, '|' ORDER BY i) AS image_paths FROM p WHERE i <= 5 GROUP BY business_id),
vg AS (SELECT business_id, string_agg(review_id, '|' ORDER BY i) AS review_ids, string_agg(t, '|' ORDER BY i) AS review_texts FROM v WHERE i <= 5 GROUP BY business_id),
weak AS (SELECT 'weak_' || business_id AS pair_id, business_id, photo_ids, image_paths, review_ids, review_texts, 'weak' AS alignment_type FROM pg JOIN vg USING (business_id))"""


def _weak(spark, sf_dir):
    return align.weak(R.photos_df(spark, sf_dir), _images(spark, sf_dir), _valid(spark, sf_dir))


@_query(f"{_WEAK} SELECT * FROM weak")
def weak_alignment(spark, sf_dir):
    return _weak(spark, sf_dir).select("pair_id", "business_id", *[_bar(c).alias(c) for c in ("photo_ids", "image_paths", "review_ids", "review_texts")], "alignment_type")


@_query(f"{_WEAK} SELECT p.business_id, p.photo_id, p.image_path, v.review_id, v.t AS review_text FROM p JOIN v ON p.business_id = v.business_id WHERE p.i <= 5 AND v.i <= 5")
def candidate_expansion(spark, sf_dir):
    return similarity.candidates(_weak(spark, sf_dir))


@_query(f"{_VALID}, photos AS ({R._PHOTOS}) SELECT business_id FROM (SELECT DISTINCT business_id FROM photos WHERE image_valid INTERSECT SELECT DISTINCT business_id FROM valid)")
def set_intersection_keys(spark, sf_dir):
    return _images(spark, sf_dir).select("business_id").intersect(_valid(spark, sf_dir).select("business_id"))


# ---- similarity: even vectors are images, odd ones texts, labels are groups

_PAIRS = f"""WITH {R.WITH_VECTORS}, e AS (SELECT *, row_number() OVER (PARTITION BY business_id, vec_id % 2 ORDER BY vec_id) AS i FROM vectors),
pairs AS (SELECT a.business_id, a.vec_id AS photo, b.vec_id AS review, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM e a JOIN e b ON a.business_id = b.business_id WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND a.i <= 20 AND b.i <= 20)"""


def _scored(spark, sf_dir):
    v = R.vectors_df(spark, sf_dir)
    photos = v.filter("vec_id % 2 = 0").select(F.col("vec_id").cast("string").alias("photo_id"), "business_id", F.concat(F.lit("v"), "vec_id").alias("image_path"), F.lit(True).alias("image_valid"), F.col("vec_id").alias("ord"))
    texts = v.filter("vec_id % 2 = 1").select(F.col("vec_id").cast("string").alias("review_id"), "business_id", F.concat(F.lit("t"), "vec_id").alias("text"), F.col("vec_id").alias("ord"))
    weak = align.weak(photos, align.valid_images(photos), texts, 20, 20)
    named = lambda prefix, name: v.select(F.concat(F.lit(prefix), "vec_id").alias(name), F.col("embedding").alias("vector"))
    return similarity.scored(similarity.candidates(weak), named("v", "image_path"), named("t", "review_text"))


@_query(f"{_PAIRS} SELECT business_id, photo, review, round(s, 6) AS similarity FROM pairs")
def cosine_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("business_id", F.col("photo_id").cast("long").alias("photo"), F.col("review_id").cast("long").alias("review"), F.round("clip_similarity", 6).alias("similarity"))


@_query(f"{_PAIRS} SELECT business_id, CAST(photo AS VARCHAR) AS photo_id, concat('v', photo) AS image_path, CAST(review AS VARCHAR) AS review_id, concat('t', review) AS review_text, round(s, 6) AS clip_similarity, 'cosine' AS clip_model, 'weak_denoised' AS alignment_type FROM pairs WHERE s >= 0.25")
def clip_threshold_retained(spark, sf_dir):
    return similarity.retained(_scored(spark, sf_dir)).withColumn("clip_similarity", F.round("clip_similarity", 6))


@_query(f"{_PAIRS} SELECT count(*) AS count, round(min(s), 6) AS min, round(avg(s), 6) AS mean, round(max(s), 6) AS max FROM pairs")
def similarity_distribution(spark, sf_dir):
    s = similarity.summary(_scored(spark, sf_dir))
    return s.select(F.col("scored_pairs").alias("count"), *[F.round(c, 6).alias(c) for c in ("min", "mean", "max")])


@_query(f"{_PAIRS} SELECT count(*) AS input_pairs, count(s) AS scored_pairs, CAST(count_if(s IS NULL) AS BIGINT) AS skipped_candidates, CAST(count_if(s >= 0.25) AS BIGINT) AS retained_pairs, printf('%.2f%%', 100.0 * CAST(count_if(s >= 0.25) AS BIGINT) / count(*)) AS retention_rate FROM pairs")
def denoise_summary(spark, sf_dir):
    return similarity.summary(_scored(spark, sf_dir)).select("input_pairs", "scored_pairs", "skipped_candidates", "retained_pairs", "retention_rate")


@_query(f"{_WEAK} SELECT 'skipped' AS status, (SELECT count(*) FROM weak) AS input_groups, (SELECT count(*) FROM p JOIN v ON p.business_id = v.business_id WHERE p.i <= 5 AND v.i <= 5) AS input_pairs, CAST(0 AS BIGINT) AS retained_pairs")
def skipped_denoise_summary(spark, sf_dir):
    return similarity.skipped_summary(_weak(spark, sf_dir), "no scorer").select("status", "input_groups", "input_pairs", "retained_pairs")


@_query("SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 7 AS BIGINT) AS batch FROM part")
def batch_numbers(spark, sf_dir):
    return similarity.batch_number(R.table(spark, sf_dir, "part").select("p_partkey"), 7, "p_partkey").select("p_partkey", F.col("batch").cast("long").alias("batch"))


@_query(f"{_WEAK} SELECT p.photo_id, v.review_id, round((length(v.t) % 100) / 100.0, 6)::DOUBLE AS clip_similarity FROM p JOIN v ON p.business_id = v.business_id WHERE p.i <= 5 AND v.i <= 5")
def injected_scorer(spark, sf_dir):
    scores = similarity.scored_by(similarity.candidates(_weak(spark, sf_dir)), lambda path, text: F.length(text) % 100 / 100.0)
    return scores.select("photo_id", "review_id", F.round("clip_similarity", 6).alias("clip_similarity"))


# ---- statistics


@_query(f"""{_B}, x AS (SELECT unnest(cats) AS value, ord, unnest(range(0, len(cats))) AS p FROM b) SELECT value, count(*) AS n FROM x GROUP BY value ORDER BY n DESC, min(ord * 100 + p), value LIMIT 20""")
def category_topk(spark, sf_dir):
    return stats.top_values(_businesses(spark, sf_dir), "categories", "ord")


@_query(f"{_P} SELECT label, count(*) AS n FROM photos WHERE image_valid AND {_CAPTION} <> '' AND label <> '' GROUP BY label")
def label_distribution(spark, sf_dir):
    return stats.label_counts(align.strong(R.photos_df(spark, sf_dir), _images(spark, sf_dir)))


@_query(f"{_P} SELECT count(*) AS caption_count, min(length({_CAPTION})) AS min_chars, round(avg(length({_CAPTION})), 6) AS mean_chars, max(length({_CAPTION})) AS max_chars FROM photos WHERE image_valid AND {_CAPTION} <> ''")
def caption_length_stats(spark, sf_dir):
    return stats.caption_lengths(align.strong(R.photos_df(spark, sf_dir), _images(spark, sf_dir))).withColumn("mean_chars", F.round("mean_chars", 6))


@_query(f"""{_WEAK}, business AS ({R._BUSINESS}), b AS (SELECT *, {R.SQL_CATS} AS cats FROM business) SELECT cats[1] AS value, count(*) AS n FROM weak JOIN b USING (business_id) WHERE len(cats) > 0 GROUP BY cats[1] ORDER BY n DESC, min(ord), value LIMIT 20""")
def weak_first_category(spark, sf_dir):
    return stats.weak_first_categories(_weak(spark, sf_dir), _businesses(spark, sf_dir))


@_query(f"{_V}, photos AS ({R._PHOTOS}), business AS ({R._BUSINESS}) SELECT (SELECT count(DISTINCT city) FROM business WHERE city <> '') AS cities, (SELECT count(DISTINCT business_id) FROM reasoned WHERE filter_reason IS NULL) AS businesses_with_reviews, (SELECT count(DISTINCT business_id) FROM photos WHERE image_valid) AS businesses_with_valid_images")
def distinct_counts(spark, sf_dir):
    one = lambda df, c, name: stats.distinct_values(df, c).select(F.col("n").alias(name), F.lit(1).alias("k"))
    cities = one(R.business_df(spark, sf_dir), "city", "cities")
    reviews = one(_valid(spark, sf_dir), "business_id", "businesses_with_reviews")
    return cities.join(reviews, "k").join(one(_images(spark, sf_dir), "business_id", "businesses_with_valid_images"), "k").drop("k")


@_query(f"{_P} SELECT count(*) AS photos, CAST(count_if(image_valid) AS BIGINT) AS valid_images, round(CAST(count_if(image_valid) AS BIGINT) / count(*), 6) AS valid_image_ratio FROM photos")
def valid_ratio(spark, sf_dir):
    n = R.photos_df(spark, sf_dir).agg(F.count("*").alias("photos"), F.count_if("image_valid").alias("valid_images"))
    return n.withColumn("valid_image_ratio", F.round(stats.ratio(F.col("valid_images"), F.col("photos")), 6))


_TALLIES = """WITH x AS (SELECT 'rows' AS what, NULL AS value, NULL AS number FROM documents UNION ALL SELECT 'lang', lang, NULL FROM documents WHERE lang <> '' UNION ALL SELECT 'source', source, NULL FROM documents WHERE source <> ''
 UNION ALL SELECT 'word', w, NULL FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' UNION ALL SELECT 'chars', NULL, length(text) FROM documents WHERE text IS NOT NULL)"""


def _document_tallies(spark, sf_dir):
    """Tallies of the documents for each source, stored, and added up."""
    values = {"lang": F.col("lang"), "source": F.col("source"), "word": F.split("text", " ")}
    by_source = tallies.tallies(R.table(spark, sf_dir, "documents"), values, {"chars": F.length("text")}, "doc_id", part=F.col("source"))
    return tallies.summed(tables.stored(by_source, "document-tallies"))


@_query(f"{_TALLIES} SELECT what, count(*) AS n, count(DISTINCT value) AS distinct_values, CAST(sum(number) AS BIGINT) AS total, min(number) AS least, max(number) AS most, round(sum(number) / count(*), 6) AS mean FROM x GROUP BY what")
def statistics_of_parts(spark, sf_dir):
    return tallies.figures(_document_tallies(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@_query("SELECT w AS value, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS p FROM documents) WHERE w <> '' GROUP BY w ORDER BY n DESC, min({'o': doc_id, 'p': p}), w LIMIT 20")
def top_words_of_parts(spark, sf_dir):
    return tallies.top(_document_tallies(spark, sf_dir), "word")


@_query("SELECT coalesce(nullif(event_type, 'view'), 'unknown') AS error_type, count(*) AS n FROM events GROUP BY 1")
def failure_types(spark, sf_dir):
    return stats.failure_types(R.table(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("view")).alias("error_type")))


_CONTRACT = {"documents": {"doc_id", "text", "lang", "absent"}, "pages": {"page_id", "url", "html"}, "labels": {"doc_id", "toxic", "zeal", "absent"}, "part": {"p_partkey", "p_name", "P_NAME"}}
_LOST = {"documents": "absent", "pages": "", "labels": "absent,zeal", "part": "P_NAME"}


@_query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n_rows, '{lost}' AS missing FROM {name}" for name, lost in _LOST.items()))
def column_contract(spark, sf_dir):
    """Each table as it is read: its rows, and the columns that it lacks."""
    out = None
    for name, required in _CONTRACT.items():
        df = R.table(spark, sf_dir, name)
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(",".join(contract.missing_columns(df, required))).alias("missing"))
        out = one if out is None else out.union(one)
    return out


@_query("SELECT photo_id, image_path FROM (SELECT CAST(page_id AS VARCHAR) AS photo_id, CASE WHEN page_id % 9 = 0 THEN '' ELSE concat('a/b/', page_id, '.jpg') END AS image_path, page_id FROM pages) WHERE page_id % 9 = 0 OR page_id % 4 = 1")
def missing_image_paths(spark, sf_dir):
    pages = R.table(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").cast("string").alias("photo_id"), F.when(F.col("page_id") % 9 == 0, "").otherwise(F.concat(F.lit("a/b/"), "page_id", F.lit(".jpg"))).alias("image_path"))
    # files of the same names in another folder are no help
    files = pages.filter("page_id % 4 <> 1").select(F.concat(F.lit("a/b/"), "page_id", F.lit(".jpg")).alias("file")).union(pages.select(F.concat(F.lit("a/c/"), "page_id", F.lit(".jpg"))))
    return contract.without_file(rows, "image_path", files)


@_query(f"{_B} SELECT business_id, name, city, state, stars, review_count, is_open, array_to_string(cats, '|') AS categories, CAST(json_array_length(json_keys(attributes)) AS BIGINT) AS n_attributes FROM b")
def business_records(spark, sf_dir):
    made = parse.identified(parse.businesses(R.business_df(spark, sf_dir).withColumnRenamed("categories_text", "categories")), "business_id")
    return made.select("business_id", "name", "city", "state", "stars", "review_count", F.col("is_open").cast("int").alias("is_open"), _bar("categories").alias("categories"), F.size(A.as_map(F.col("attributes"))).cast("long").alias("n_attributes"))


@_query("SELECT CAST(page_id AS VARCHAR) AS photo_id, concat('src', page_id % 20) AS business_id, concat('root/', page_id, '.jpg') AS image_path, '' AS caption FROM pages")
def photo_records(spark, sf_dir):
    raw = R.table(spark, sf_dir, "pages").select(F.col("page_id").alias("photo_id"), F.concat(F.lit("src"), F.col("page_id") % 20).alias("business_id"))
    return parse.photos(raw, "root/").select("photo_id", "business_id", "image_path", "caption")


_TWO_PROMPTS = {**M.PROMPTS, "short_v2": "Name the place type as JSON."}


@_query(f"SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '{_TWO_PROMPTS['short_v2']}' ELSE '{next(iter(M.PROMPTS.values()))}' END AS prompt FROM orders")
def prompt_versions(spark, sf_dir):
    """A known second version, the first, an unknown one and none."""
    p = F.col("o_orderpriority")
    version = F.when(p == "1-URGENT", "short_v2").when(p == "2-HIGH", next(iter(M.PROMPTS))).when(p == "3-MEDIUM", "unknown")
    return R.table(spark, sf_dir, "orders").select("o_orderkey", M.prompt(version, _TWO_PROMPTS).alias("prompt"))


# ---- retrieval

_TOKENS = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z0-9_]+'), lambda x: lower(x)))"
_SEARCH = """WITH q AS (SELECT query_id, toks, unnest(toks) AS token FROM ({queries})), i AS (SELECT item_id, unnest(toks) AS token FROM ({items})),
m AS (SELECT query_id, item_id, round(count(*) / any_value(len(toks)), 4) AS score, string_agg(token, '|' ORDER BY token) AS matched FROM q JOIN i USING (token) GROUP BY query_id, item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM m)"""
_PARTS = f"SELECT p_partkey AS item_id, {_TOKENS.format('concat_ws(chr(32), p_name, p_type, p_brand)')} AS toks FROM part"
_DOCS = f"SELECT doc_id AS item_id, {_TOKENS.format('text')} AS toks FROM documents"
_ONE = f"SELECT 0 AS query_id, {_TOKENS.format(repr('Small red ring, economy Brand 4!'))} AS toks"
_MANY = f"SELECT item_id AS query_id, {_TOKENS.format('text')} AS toks FROM benchmark"
_BATCH = _SEARCH.format(queries=_MANY, items=_DOCS)


def _batch(spark, sf_dir, k):
    """Each benchmark item searched in all documents."""
    docs = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("ord"), "text")
    return retrieval.search(R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), docs, k)


@_query(_SEARCH.format(queries=_ONE, items=_PARTS) + " SELECT CAST(query_id AS BIGINT) AS query_id, item_id, score, matched, rank, 'hybrid_keyword_baseline' AS retrieval_mode FROM r WHERE rank <= 10")
def keyword_search_single(spark, sf_dir):
    items = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_partkey").alias("ord"), retrieval.item_text(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.lit(None).cast("string")).alias("text"))
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit("Small red ring, economy Brand 4!").alias("text"))
    return retrieval.hybrid_search(asked, items, 10).withColumn("matched", _bar("matched"))


@_query(_BATCH + " SELECT query_id, item_id, score, matched, rank FROM r WHERE rank <= 5")
def keyword_search_batch(spark, sf_dir):
    return _batch(spark, sf_dir, 5).withColumn("matched", _bar("matched"))


def _judged_sql(which=""):
    """Wanted are the documents that hold an item's text."""
    return f"""{_BATCH}, l AS (SELECT query_id, list(item_id ORDER BY rank) AS ranked FROM r WHERE rank <= 5 GROUP BY query_id),
w AS (SELECT b.item_id AS query_id, list(d.doc_id ORDER BY d.doc_id) AS wanted FROM benchmark b JOIN documents d ON contains(d.text, b.text) {which} GROUP BY b.item_id),
e AS (SELECT b.item_id AS query_id, coalesce(wanted, []) AS wanted, coalesce(ranked, []) AS ranked FROM benchmark b LEFT JOIN w ON w.query_id = b.item_id LEFT JOIN l ON l.query_id = b.item_id)"""


def _judged(spark, sf_dir, wanted, least=0):
    """query_id, wanted (made of the documents that hold the text, for items of ``least`` different words or more) and ranked (the first five) of each benchmark item."""
    asked = R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    lists = _batch(spark, sf_dir, 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l")).select("query_id", F.col("l.item_id").alias("ranked"))
    held = retrieval.holding(asked, docs, least).groupBy("query_id").agg(wanted.alias("wanted"))
    return asked.select("query_id").join(held, "query_id", "left").join(lists, "query_id", "left").select("query_id", "wanted", F.coalesce("ranked", F.array().cast("array<bigint>")).alias("ranked"))


@_query(_judged_sql(f"WHERE len({_TOKENS.format('b.text')}) > 2") + " SELECT query_id, round(coalesce(len(list_intersect(wanted, ranked)) / nullif(len(wanted), 0), 0), 6) AS recall FROM e")
def recall_at_k(spark, sf_dir):
    """Items of three different words or more."""
    judged = _judged(spark, sf_dir, F.collect_list("item_id"), 3)
    return judged.select("query_id", F.round(retrieval.recall_at_k(F.col("wanted"), F.col("ranked"), 5), 6).alias("recall"))


@_query(_judged_sql() + " SELECT query_id, CAST(coalesce(list_contains(ranked, wanted[1]), false) AS BIGINT) AS hit FROM e")
def top_k_hit(spark, sf_dir):
    """Whether the first document that holds an item is among its five best, for items of any length."""
    judged = _judged(spark, sf_dir, F.min("item_id"))  # a short text is held by most documents
    return judged.select("query_id", retrieval.top_k_hit(F.col("wanted"), F.col("ranked"), 5).cast("long").alias("hit"))


_COSINE = "round(list_inner_product(a.v, b.v), 9)"
_UNIT = "SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@_query()
def vector_search(spark, sf_dir):
    """The ten nearest of each twentieth vector, from as many cells as a recall of 0.95 takes on some of the queries."""
    rows = R.table(spark, sf_dir, "embeddings")
    asked, index = rows.filter("vec_id % 20 = 0"), vectors.Index(rows, "vec_id", "embedding")
    probes = index.probes_for(asked, "vec_id", "embedding", not_itself=True)
    return index.search(asked, "vec_id", "embedding", probes=probes, not_itself=True).select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


@_query(f"""WITH u AS ({_UNIT}), s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_COSINE} AS score FROM u a JOIN u b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, item_id, row_number() OVER w AS rank, round(score, 6) AS score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, item_id) QUALIFY row_number() OVER w <= 10""")
def vector_search_all_cells(spark, sf_dir):
    rows = R.table(spark, sf_dir, "embeddings")
    found = vectors.Index(rows, "vec_id", "embedding").search(rows.filter("vec_id % 20 = 0"), "vec_id", "embedding", not_itself=True)
    return found.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


@_query(_BATCH + f""", u AS ({_UNIT}), s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_COSINE} AS score FROM u a JOIN u b ON a.vec_id IN (SELECT item_id FROM benchmark)),
n AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s),
f AS (SELECT query_id, item_id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM (SELECT query_id, item_id, rank FROM r WHERE rank <= 10 UNION ALL SELECT query_id, item_id, rank FROM n WHERE rank <= 10) GROUP BY query_id, item_id)
SELECT query_id, item_id, score, row_number() OVER w AS rank, 'hybrid_rank_fusion' AS retrieval_mode FROM f WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, item_id) QUALIFY row_number() OVER w <= 10""")
def hybrid_rank_fusion(spark, sf_dir):
    """Benchmark items against documents, by words and by the vectors of the same ids."""
    rows = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    asked = R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(rows, "query_id", "left")
    docs = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("ord"), "text")
    return vectors.hybrid_search(asked, docs, vectors.Index(rows, "query_id"), 10)


_PASSAGES = f"""WITH q AS (SELECT item_id, text, {_TOKENS.format('text')} AS toks FROM benchmark), d AS (SELECT doc_id, text, {_TOKENS.format('text')} AS toks FROM documents),
e AS (SELECT q.item_id, list(d.doc_id) AS wanted FROM q JOIN d ON contains(d.text, q.text) AND len(q.toks) > 0 GROUP BY q.item_id),
qt AS (SELECT item_id, len(toks) AS n, unnest(toks) AS token FROM q), dt AS (SELECT doc_id, unnest(toks) AS token FROM d),
m AS (SELECT item_id, doc_id, round(count(*) / any_value(n), 4) AS score FROM qt JOIN dt USING (token) GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM m),
l AS (SELECT item_id, list(doc_id) AS ranked FROM r WHERE rank <= 5 GROUP BY item_id)
SELECT q.item_id, CAST(coalesce(len(wanted), 0) AS BIGINT) AS n_wanted, round(coalesce(len(list_intersect(wanted, ranked)) / len(wanted), 0), 6) AS recall FROM q LEFT JOIN e USING (item_id) LEFT JOIN l USING (item_id)"""


@_query(_PASSAGES)
def passage_recall(spark, sf_dir):
    """Each benchmark item is searched in all documents; those that hold its text are wanted."""
    asked = R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("ord"), "text")
    wanted = retrieval.holding(asked, docs).groupBy("query_id").agg(F.collect_set("item_id").alias("wanted"))
    ranked = retrieval.search(asked, docs, 5).groupBy("query_id").agg(F.collect_list("item_id").alias("ranked"))
    none = F.array().cast("array<bigint>")
    out = asked.select("query_id").join(wanted, "query_id", "left").join(ranked, "query_id", "left").select("query_id", F.coalesce("wanted", none).alias("wanted"), F.coalesce("ranked", none).alias("ranked"))
    return out.select(F.col("query_id").alias("item_id"), F.size("wanted").cast("long").alias("n_wanted"), F.round(retrieval.recall_at_k(F.col("wanted"), F.col("ranked"), 5), 6).alias("recall"))


# ---- planning: a customer is a trip, its orders are candidates

_PREFS = "SELECT c_custkey AS trip_id, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'Unknown city') AS city, CASE WHEN c_custkey % 3 = 0 THEN '2 days' ELSE '1 day' END AS duration, 'medium' AS budget, CASE WHEN c_custkey % 2 = 0 THEN 'compact' ELSE 'relaxed' END AS pace FROM customer"
_SLOT = "CASE WHEN pace = 'relaxed' THEN ['10:00-12:00', '14:00-15:30', '16:00-17:30', '19:00-20:30'] ELSE ['09:00-10:30', '11:00-12:30', '14:00-15:30', '16:00-17:30'] END[1 + i % 4]"
_REASON = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN concat('Matches user interest in ', lower(o_orderpriority), '.') ELSE 'Selected from visual search candidates and user preferences.' END"
_STOPS = f"WITH p AS ({_PREFS}), s AS (SELECT o_custkey AS trip_id, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)"


def _trips(spark, sf_dir):
    c = R.table(spark, sf_dir, "customer")
    wishes = c.select(
        F.col("c_custkey").alias("trip_id"), F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("city"), F.when(F.col("c_custkey") % 3 == 0, "2 days").alias("duration"), F.when(F.col("c_custkey") % 2 == 0, "compact").alias("pace"), F.array(F.lit("2-High"), F.lit("1-URGENT")).alias("interests")
    )
    return wishes


def _itineraries(spark, sf_dir):
    stops = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trip_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("category"))
    return planning.itineraries(stops, _trips(spark, sf_dir))


@_query(_PREFS)
def preferences_defaults(spark, sf_dir):
    return planning.preferences(_trips(spark, sf_dir)).drop("interests")


@_query(f"{_STOPS} SELECT trip_id, string_agg({_SLOT}, '|' ORDER BY i) AS times FROM s JOIN p USING (trip_id) GROUP BY trip_id")
def itinerary_slots(spark, sf_dir):
    return _itineraries(spark, sf_dir).filter(F.size("itinerary") > 0).select("trip_id", _bar("itinerary.time").alias("times"))


@_query(f"{_STOPS} SELECT trip_id, string_agg({_REASON}, '|' ORDER BY i) AS reasons FROM s JOIN p USING (trip_id) GROUP BY trip_id")
def itinerary_reasons(spark, sf_dir):
    return _itineraries(spark, sf_dir).filter(F.size("itinerary") > 0).select("trip_id", _bar("itinerary.reason").alias("reasons"))


@_query(f"{_STOPS} SELECT trip_id, concat(upper(pace[1]), lower(pace[2:]), ' ', duration, ' itinerary for ', city, '.') AS summary, CASE WHEN trip_id IN (SELECT trip_id FROM s) THEN 0.72 ELSE 0.3 END::DOUBLE AS confidence FROM p")
def itinerary_summary(spark, sf_dir):
    return _itineraries(spark, sf_dir).select("trip_id", "summary", "confidence")


# ---- model output, made from conversations

_IDS = "SELECT conv_id, turn, text, role FROM conversations"


@_query("""SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN concat('{"a": ', conv_id, '}') ELSE concat('{"a": ', conv_id, '}', chr(10), '{"b": 1}') END AS body FROM conversations""")
def strip_fence(spark, sf_dir):
    one = F.concat(F.lit('{"a": '), "conv_id", F.lit("}"))
    two = F.concat(one, F.lit('\n{"b": 1}'))
    fenced = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" \n```json\n"), two, F.lit("\n```\n "))).when(F.col("turn") % 3 == 1, F.concat(F.lit("```\n"), two)).otherwise(F.concat(F.lit(" "), one, F.lit(" ")))
    return R.table(spark, sf_dir, "conversations").select("conv_id", "turn", M.without_fence(fenced).alias("body"))


@_query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN concat(conv_id, '|', role) WHEN 2 THEN role ELSE CAST(conv_id AS VARCHAR) END AS items FROM conversations""")
def ensure_list(spark, sf_dir):
    quoted = F.concat(F.lit('"'), "role", F.lit('"'))
    value = F.when(F.col("turn") % 4 == 0, F.lit("null")).when(F.col("turn") % 4 == 1, F.concat(F.lit("["), "conv_id", F.lit(","), quoted, F.lit("]"))).when(F.col("turn") % 4 == 2, quoted).otherwise(F.col("conv_id").cast("string"))
    return R.table(spark, sf_dir, "conversations").select("conv_id", "turn", _bar(M.as_list(value)).alias("items"))


@_query("""SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 OR role = 'user' AND turn = 2 THEN 'museum' ELSE 'cafe' END AS merchant_type, CASE WHEN conv_id % 5 = 0 OR role = 'user' AND turn = 2 THEN 'cultural|educational' ELSE 'cozy|minimal|warm lighting' END AS style,
CASE WHEN conv_id % 5 = 0 OR role = 'user' AND turn = 2 THEN 0.62 ELSE 0.78 END::DOUBLE AS confidence FROM conversations""")
def fallback_understanding(spark, sf_dir):
    urls = F.array(F.concat(F.lit("http://x/"), F.when(F.col("conv_id") % 5 == 0, "MUSEUM.jpg").otherwise("a.jpg")))
    said = F.when((F.col("role") == "user") & (F.col("turn") == 2), "a Museum please")
    answer = R.table(spark, sf_dir, "conversations").select("conv_id", "turn", M.answer_without_model(urls, said).alias("a"))
    return answer.select("conv_id", "turn", "a.structured_info.merchant_type", _bar("a.structured_info.style").alias("style"), "a.confidence")


@_query("""SELECT conv_id, turn, concat('{"model":"m","messages":[{"role":"user","content":[{"type":"text","text":"look"},{"type":"text","text":', to_json(text), '},{"type":"image_url","image_url":{"url":"http://x/', conv_id, '.jpg"}}]}],"temperature":0.1,"top_p":0.9,"max_tokens":512}') AS payload FROM conversations""")
def chat_payload(spark, sf_dir):
    urls = F.array(F.concat(F.lit("http://x/"), "conv_id", F.lit(".jpg")))
    return R.table(spark, sf_dir, "conversations").select("conv_id", "turn", M.chat_payload(F.lit("m"), F.lit("look"), F.col("text"), urls).alias("payload"))


@_query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence, CASE WHEN turn % 2 = 0 THEN concat('s', conv_id) ELSE text END AS image_summary, CASE WHEN turn % 2 = 0 THEN concat('cup|', role) ELSE '' END AS objects, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS style FROM conversations""")
def model_responses(spark, sf_dir):
    good = F.concat(F.lit('```json\n{"image_summary":"s'), "conv_id", F.lit('","confidence":0.9,"objects":[{"type":"cup"},null,"'), "role", F.lit('"],"style":"'), "role", F.lit('"}\n```'))
    said = R.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, good).otherwise(F.col("text")).alias("said"))
    out = M.with_responses(said, "said", "r")
    return out.select("conv_id", "turn", "r.confidence", "r.image_summary", _bar("r.structured_info.objects").alias("objects"), _bar("r.structured_info.style").alias("style"))


def _archived(spark, sf_dir, gzip):
    """All texts as files in archives, one archive for each partition; the table of what is in them."""
    folder = tables.scratch(spark, "archives")
    files = R.table(spark, sf_dir, "documents").select(F.concat(F.lit("photos/"), "doc_id", F.lit(".jpg")).alias("member"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    archive_tables.write_archives(files, folder, gzip=gzip).agg(F.sum("files")).collect()
    return archive_tables.members(archive_tables.entries(spark, folder))


def _file_id():
    return F.regexp_extract("member", "([0-9]+)[.]jpg$", 1).cast("long").alias("doc_id")


_FILES = "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS content FROM documents"


@_query(f"SELECT 'tar' AS kind, * FROM ({_FILES}) UNION ALL SELECT 'tar.gz', * FROM ({_FILES})")
def archive_round_trip(spark, sf_dir):
    out = None
    for kind in ("tar", "tar.gz"):
        read = archive_tables.contents(_archived(spark, sf_dir, kind == "tar.gz"))
        read = read.select(F.lit(kind).alias("kind"), _file_id(), F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("content"))
        out = read if out is None else out.unionByName(read)
    return out


@_query(f"SELECT * FROM ({_FILES}) WHERE doc_id IN (SELECT doc_id FROM labels)")
def archive_wanted_members(spark, sf_dir):
    """Only the files of the ids that another table names are read."""
    ids = R.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("photo_id"))
    found = archive_tables.wanted(_archived(spark, sf_dir, True), (), photo_ids=ids)
    return archive_tables.contents(found).select(_file_id(), F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("content"))


@_query("""SELECT doc_id, n_lines, octet_length(encode(text)) - breaks AS n_bytes FROM (SELECT *, breaks + CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 0 ELSE 1 END AS n_lines
FROM (SELECT doc_id, text, length(text) - length(replace(text, chr(10), '')) AS breaks FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))) WHERE n_lines > 0""")
def archive_lines(spark, sf_dir):
    """The lines of all files, each file read in ranges."""
    lines = archive_tables.lines(_archived(spark, sf_dir, False), 1 << 15).withColumn("n", F.octet_length("line"))
    return lines.select(_file_id(), "n").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_bytes"))


def _stub_model(payload: dict) -> str:
    """Says the first line of what the user says; is busy for texts of some lengths."""
    import json

    said = next((x["text"] for x in payload["messages"][0]["content"][1:] if x["type"] == "text"), "")
    if len(said) % 7 == 0:
        raise OSError("busy")
    return json.dumps({"image_summary": said.split("\n")[0], "confidence": 0.9, "style": payload["model"], "objects": [{"name": "n"}, str(len(said))]})


@_query("""SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) % 7 = 0 THEN 0.78 ELSE 0.9 END::DOUBLE AS confidence,
CASE WHEN length(coalesce(text, '')) % 7 = 0 THEN 'Image likely shows a cozy cafe scene suitable for OTA visual search.' ELSE string_split(coalesce(text, ''), chr(10))[1] END AS image_summary,
CASE WHEN length(coalesce(text, '')) % 7 = 0 THEN 'coffee|table|indoor seating' ELSE concat('n|', length(coalesce(text, ''))) END AS objects,
CASE WHEN length(coalesce(text, '')) % 7 = 0 THEN 'vLLM request failed; fallback used: busy' END AS note FROM conversations WHERE NOT contains(lower(coalesce(text, '')), 'museum')
UNION ALL SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0 THEN 0.62 ELSE 0.9 END::DOUBLE, CASE WHEN length(text) % 7 = 0 THEN 'Image likely shows a museum or cultural attraction.' ELSE string_split(text, chr(10))[1] END,
CASE WHEN length(text) % 7 = 0 THEN 'building|exhibition|indoor space' ELSE concat('n|', length(text)) END, CASE WHEN length(text) % 7 = 0 THEN 'vLLM request failed; fallback used: busy' END FROM conversations WHERE contains(lower(text), 'museum')""")
def model_answers(spark, sf_dir):
    """Every turn as a request to a model; equal ones are asked once, those that fail get the answer without a model."""
    asked = R.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array().cast("array<string>").alias("image_urls"), F.col("text").alias("user_text"), F.lit(None).cast("string").alias("version"))
    done = model_calls.understood(asked, _stub_model, tables.scratch(spark, "answers"), attempts=2, pause=0.0)
    a = F.col("answer")
    return done.select("conv_id", "turn", a["confidence"].alias("confidence"), a["image_summary"].alias("image_summary"), _bar(a["structured_info"]["objects"]).alias("objects"), F.when(a["raw_model_output"].startswith("vLLM"), a["raw_model_output"]).alias("note"))


# ---- files: written to the shared folder first


@_query()
def jsonl_line_counts(spark, sf_dir):
    """Lines of four kinds, written as text and classified: records, blank, bad and non-object lines."""
    d = R.table(spark, sf_dir, "documents")
    line = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 7 == 1, "[1]").when(F.col("doc_id") % 7 == 2, '{"a":1} x').otherwise(F.to_json(F.struct("doc_id", "lang")))
    path = tables.scratch(spark, "lines")
    d.select(line.alias("value")).write.text(path)
    return tables.line_counts(tables.json_lines(spark, path))


ORACLES["jsonl_line_counts"] = "SELECT count(*) AS total_lines, CAST(count_if(doc_id % 7 > 2) AS BIGINT) AS records, CAST(count_if(doc_id % 7 IN (1, 2)) AS BIGINT) AS malformed_lines FROM documents"


@_query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, sf_dir):
    return whole_round_trip(spark, R.table(spark, sf_dir, "documents"))


def whole_round_trip(spark, docs):
    """``docs`` written as JSON lines and read back, with all rows and columns."""
    path = tables.scratch(spark, "records")
    tables.write_json_lines(docs, path)
    return tables.json_records(tables.json_lines(spark, path), ", ".join(f"{c} {t}" for c, t in docs.dtypes)).select(*docs.columns)


@_query("SELECT p_partkey, p_name, array_to_string([p_brand, p_type], '|') AS tags, p_retailprice FROM part")
def csv_round_trip(spark, sf_dir):
    path = tables.scratch(spark, "table") + ".csv"
    tables.write_table(R.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.array("p_brand", "p_type").alias("tags"), "p_retailprice"), path, "csv")
    return tables.read_table(spark, path, "p_partkey long, p_name string, tags array<string>, p_retailprice double").withColumn("tags", _bar("tags"))


@_query("SELECT doc_id, text, lang, source, n_chars, 'parquet' AS format FROM documents UNION ALL SELECT doc_id, text, lang, source, n_chars, 'csv_fallback' FROM documents")
def row_sink_round_trip(spark, sf_dir):
    """All documents through the committing sink, as Parquet and with a compression that this installation lacks."""
    out = None
    for compression, want in (("zstd", "parquet"), ("lzo", "csv_fallback")):
        path = tables.scratch(spark, "rows")
        assert row_sink.write_rows(R.table(spark, sf_dir, "documents"), path, compression=compression)["actual_format"] == want
        read = row_sink.read_rows(spark, path).withColumn("format", F.lit(want))
        out = read if out is None else out.unionByName(read)
    return out


@_query("SELECT item_id, text, [text, NULL, ''] AS words FROM benchmark")
def csv_fallback_round_trip(spark, sf_dir):
    """A table that Spark cannot write as Parquet: it is CSV in the same place, says so, and is read as what it is."""
    path, codec = tables.scratch(spark, "table") + ".parquet", spark.conf.get("spark.sql.parquet.compression.codec")
    df = R.table(spark, sf_dir, "benchmark").withColumn("words", F.array("text", F.lit(None).cast("string"), F.lit("")))
    spark.conf.set("spark.sql.parquet.compression.codec", "lzo")
    try:
        done = tables.write_table(df, path)
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", codec)
    assert done["actual_format"] == "csv_fallback" and done["error"] and not tables.is_parquet(spark, path)
    return tables.read_table(spark, path)


_IMAGES = "SELECT CAST(page_id AS VARCHAR) AS photo_id, page_id % 4 < 2 AS image_valid, CASE WHEN page_id % 4 < 2 THEN length(html) % 97 + 1 ELSE 0 END AS image_width, CASE page_id % 4 WHEN 2 THEN 'missing' WHEN 3 THEN 'corrupted' ELSE '' END AS status FROM pages"


@_query(_IMAGES)
def image_index(spark, sf_dir):
    """A photo for each page, its file written by tasks: images as wide as the page is long, none, or the page itself."""
    root, kind = tables.scratch(spark, "images"), F.col("page_id") % 4
    pages = R.table(spark, sf_dir, "pages")
    content = F.when(kind < 2, images.blank_png(F.length("html") % 97 + 1)).otherwise(F.encode("html", "UTF-8"))
    archive_tables.write_files(pages.filter(kind != 2).select(F.concat(F.lit("photos/"), "page_id", F.lit(".png")).alias("member"), content.alias("content")), root).agg(F.sum("bytes")).collect()
    photos = pages.select(F.col("page_id").cast("string").alias("photo_id"), F.lit("b").alias("business_id"), F.concat(F.lit("photos/"), "page_id", F.lit(".png")).alias("image_path"))
    index = images.image_index(photos, root)
    return index.select("photo_id", "image_valid", F.coalesce("image_width", F.lit(0)).cast("long").alias("image_width"), F.regexp_extract(F.coalesce("validation_error", F.lit("")), "^[a-z]+", 0).alias("status"))


@_query(f"SELECT count(*) AS total_images, CAST(count_if(image_valid) AS BIGINT) AS valid_images, CAST(count_if(status = 'missing') AS BIGINT) AS missing_images, CAST(count_if(status = 'corrupted') AS BIGINT) AS corrupted_images FROM ({_IMAGES})")
def image_counts(spark, sf_dir):
    return images.image_counts(image_index(spark, sf_dir).withColumn("validation_error", F.nullif("status", F.lit(""))))


@_query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def parquet_round_trip(spark, sf_dir):
    path = tables.scratch(spark, "table") + ".parquet"
    part = R.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    assert tables.write_table(part, path)["actual_format"] == "parquet" and tables.is_parquet(spark, path)
    return tables.read_table(spark, path)


@_query("SELECT DISTINCT concat('p', page_id % 50) AS photo_id FROM pages WHERE page_id % 50 <> 7")
def json_photo_ids(spark, sf_dir):
    path = tables.scratch(spark, "items")
    k = F.col("page_id") % 50
    tables.write_json_lines(R.table(spark, sf_dir, "pages").select(F.when(k == 7, "").otherwise(F.concat(F.lit("p"), k)).alias("photo_id"), "url"), path)
    return tables.photo_ids(spark, path)
