"""Registered queries: one per operator / pipeline of the inventory.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole tables.  Output is normalised for comparison with the SQL oracle
(``geolex.plans.oracle``): integral columns as ``bigint``, doubles rounded
to 6 decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolex.functions import stats as st
from geolex.functions import text as tx
from geolex.operators import archives, nearest, places, predict, profiles, report, split, tfidf, wordmodel
from geolex.plans import jobs as J
from geolex.plans import standins as S
from geolex.sources import readers
from geolex.session import materialize, tasks_for
from geolex.sources.schemas import ATTAINMENT_VALUE_COLUMNS, LEVEL_COLUMNS


def finish(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        cols.append(c.alias(f.name))
    return df.select(*cols)


Q = dict[str, Callable[[SparkSession, str], DataFrame]]
_REG: Q = {}


def query(name: str):
    def deco(fn):
        _REG[name] = lambda spark, d, _fn=fn: finish(_fn(spark, d))
        return fn
    return deco


# ------------------------------------------------------------- text scalars
def _customer_names(spark, d):
    """Place-like strings derived from every customer row."""
    c = S.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = S.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = S.table(spark, d, "region").select("r_regionkey", "r_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


SUFFIXES = ("", " County", " Census Area", " Borough", " Municipio", " municipality", " Countyline Road")


def _suffix(k):
    out = F.lit(SUFFIXES[0])
    for i, s in enumerate(SUFFIXES):
        out = F.when(k % len(SUFFIXES) == i, F.lit(s)).otherwise(out) if i else out
    return out


@query("t1_collapse_tail")
def q_t1(spark, d):
    c = S.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    raw = F.concat(F.lower("c_mktsegment"), F.repeat(F.lower(F.substring("c_mktsegment", -1, 1)),
                                                     (F.col("c_custkey") % 5).cast("int")))
    return c.select("c_custkey", raw.alias("raw")).select("c_custkey", "raw", tx.collapse_tail("raw").alias("collapsed"))


@query("t2_place_name")
def q_t2(spark, d):
    base = _customer_names(spark, d)
    k = F.col("c_custkey")
    nm = F.replace(F.col("n_name"), F.lit("_"), F.lit(" "))
    raw = F.concat(nm, F.repeat(F.substring(nm, -1, 1), (k % 3).cast("int")), _suffix(k))
    return base.select("c_custkey", raw.alias("raw")).select("c_custkey", "raw", tx.place_name("raw").alias("place"))


@query("t3_split_location")
def q_t3(spark, d):
    base = _customer_names(spark, d)
    k = F.col("c_custkey")
    nm = F.col("n_name")
    loc = (F.when(k % 4 == 0, F.concat(nm, _suffix(k), F.lit(", "), F.col("r_name")))
           .when(k % 4 == 1, F.concat(nm, F.lit(",  "), F.col("r_name"), F.lit("AA, USA")))
           .when(k % 4 == 2, nm)
           .otherwise(F.lit(None).cast("string")))
    parts = tx.split_location("loc")
    return (base.select("c_custkey", loc.alias("loc"))
            .select("c_custkey", "loc", parts.getField("state").alias("state"),
                    parts.getField("county").alias("county")))


@query("t4_tokens")
def q_t4(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    toks = tx.tokens("text")
    return docs.select("doc_id", F.size(toks).alias("n_tokens"),
                       F.size(F.array_distinct(F.transform(toks, lambda t: tx.lower(t)))).alias("n_distinct_lower"),
                       tx.text_length("text").alias("n_chars"))


@query("t5_strip_stop_words")
def q_t5(spark, d):
    p = S.post_lines(spark, d)
    out = tx.strip_stop_words("text", S.STOP_WORDS)
    return p.select("user_id", "line_no", out.alias("text"), tx.text_length(out).alias("n_chars"),
                    tx.text_length("text").alias("n_chars_before"))


@query("t9_token_classes")
def q_t9(spark, d):
    p = S.post_lines(spark, d)
    toks = p.select(F.explode(tx.tokens(tx.lower("text"))).alias("tok"))
    return toks.groupBy(tx.token_class("tok").alias("token_class")).agg(F.count(F.lit(1)).alias("n"))


@query("t11_trim_words")
def q_t11(spark, d):
    docs = S.table(spark, d, "documents").select("text")
    toks = docs.select(F.explode(tx.tokens("text")).alias("tok"))
    w = toks.select(tx.trim_word("tok").alias("word")).filter(F.col("word") != "")
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("t12_strip_special")
def q_t12(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    clean = tx.strip_special("text")
    return docs.select("doc_id", clean.alias("clean"), tx.text_length(clean).alias("n_chars"))


@query("t14_sentences")
def q_t14(spark, d):
    s = tfidf.sentence_docs(S.table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", F.col("sent_no").cast("long").alias("sent_no"), "text",
                    F.size(tx.tokens("text")).alias("n_tokens"))


@query("t14_abbreviations")
def q_t14a(spark, d):
    return J.sentence_model(spark, d)[0]


@query("t14_sentence_starters")
def q_t14s(spark, d):
    return J.sentence_model(spark, d)[1]


@query("t14_learned_sentences")
def q_t14l(spark, d):
    return J.learned_sentences(spark, d)


@query("t15_parse_vector")
def q_t15(spark, d):
    e = S.table(spark, d, "embeddings").select("vec_id", "embedding")
    rendered = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), " "), F.lit("]"))
    parsed = e.select("vec_id", tx.parse_vector(rendered).alias("v"))
    return parsed.select("vec_id", F.posexplode("v").alias("pos", "value"))


@query("t16_parse_lat_long")
def q_t16(spark, d):
    c = S.table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    txt = F.when(k % 9 == 0, F.lit("n/a")).otherwise(
        F.concat(S.lat_of(k).cast("string"), F.lit(", "), S.lon_of(k).cast("string")))
    ll = tx.parse_lat_long("t")
    return c.select("c_custkey", txt.alias("t")).select("c_custkey", ll.getField("lat").alias("lat"),
                                                         ll.getField("long").alias("long"))


# ------------------------------------------------------- sources / decode
@query("s3_decode_events")
def q_s3(spark, d):
    ev = S.table(spark, d, "events").select("event_id", "props")
    rec = readers.decode_json("props", T.StructType([T.StructField("k", T.LongType())]))
    return ev.select("event_id", rec.getField("k").alias("k"))


@query("p2_located_posts")
def q_p2(spark, d):
    p = S.located_posts(spark, d)
    return p.select("post_id", "user_id", "location", "state", "county",
                    F.get("coordinates", 0).alias("lat"), F.get("coordinates", 1).alias("lon"))


@query("p3_strict_located")
def q_p3(spark, d):
    from geolex.sources.readers import decode_lines
    raw = decode_lines(S.raw_post_json(spark, d), "value")
    raw = raw.withColumn("post_id", F.concat_ws(":", F.col("user.id").cast("string"), F.col("created_at")))
    flat = places.keep_located(places.flatten_posts(raw), strict=True)
    return flat.select("post_id", "user_id", "location")


def _post_files(spark, d):
    """Raw posts as JSON-lines files in nested folders, with delete notices."""
    path = J.sink_path(spark, "posts")
    lines = S.raw_post_json(spark, d)
    deleted = lines.select("user_id", F.concat(F.lit('{"delete":{"id":'), F.col("user_id").cast("string"), F.lit("}}"))
                           .alias("value")).distinct()
    both = lines.select("user_id", "value").unionByName(deleted)
    (both.select("value", (F.col("user_id") % 3).alias("day"), (F.col("user_id") % 2).alias("hour"))
     .write.partitionBy("day", "hour").text(path))
    return readers.read_posts(spark, path, recursive=True)


@query("s1_read_posts")
def q_s1(spark, d):
    """S1 + S3: nested JSON-lines files -> posts (lines that are none are dropped)."""
    posts = _post_files(spark, d)
    return posts.filter("user IS NOT NULL").select(
        F.col("user.id").alias("user_id"), F.col("user.lang").alias("lang"), F.col("user.location").alias("location"),
        "created_at", "text")


@query("s3_corrupt_lines")
def q_s3c(spark, d):
    """Corrupt lines, and valid lines without a post, of the same files."""
    return _post_files(spark, d).agg(
        F.count_if(F.col("_corrupt").isNotNull()).alias("n_corrupt"),
        F.count_if(F.col("_corrupt").isNull() & F.col("user").isNull()).alias("n_notices"))


@query("s4_zip_county_csv")
def q_s4(spark, d):
    path = J.sink_path(spark, "zip_county")
    S.zip_county(spark, d).withColumn("ratio", F.lit("1.0")).write.csv(path, header=True)
    return readers.read_zip_county(spark, path)


def _attainment_file(spark, d):
    """The attainment table as CSV files, one of them with four preamble rows."""
    path = J.sink_path(spark, "attainment")
    J.attainment(spark, d).write.csv(path, header=True, emptyValue="")
    preamble = ["Educational attainment", "Adults 25 and older,,", '"Source: survey, 5 years"', ","]
    spark.createDataFrame([(x,) for x in preamble], "value string").coalesce(1).write.mode("append").text(path)
    return readers.read_attainment(spark, path)


@query("s5_attainment_csv")
def q_s5(spark, d):
    """S5 file -> P8 -> P7."""
    return places.clean_attainment(_attainment_file(spark, d), counties_only=True)


@query("x6_attainment_counts")
def q_x6(spark, d):
    """X6 + A9: rows read, and rows that are counties."""
    rows = places.clean_attainment(_attainment_file(spark, d), counties_only=False)
    return rows.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("FIPS") % 1000 != 0).alias("n_valid"))


@query("s6_stop_word_file")
def q_s6(spark, d):
    """S6 + P10: a stop-word file with CRLF ends, anti-joined with the words of all posts."""
    path = J.sink_path(spark, "stop_words")
    spark.createDataFrame([(w + "\r",) for w in S.STOP_WORDS], "value string").write.text(path)
    words = S.post_lines(spark, d).select(F.explode(tx.tokens(tx.lower("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return wordmodel.drop_stop_words(counts, readers.read_stop_words(spark, path))


@query("s7_s11_word_model_csv")
def q_s7(spark, d):
    """S11 writes the X3 model as CSV, S7 reads it back by the file contract."""
    from geolex.sources import sinks
    path = J.sink_path(spark, "word_model")
    sinks.write_table(J.word_model_all(spark, d), path, fmt="csv", sep=",")
    return readers.read_word_model(spark, path)


@query("s9_region_profile_json")
def q_s9(spark, d):
    """Region profile written as JSON lines (suffix dispatch), read back."""
    from geolex.sources import sinks
    df = profiles.profile_totals(S.persons(spark, d), "fip", order_col="line_no")
    path = J.sink_path(spark, "region_profile") + ".json"
    sinks.write_table(df, path)
    return spark.read.schema(df.schema).json(path)


@query("s10_county_records_tsv")
def q_s10(spark, d):
    """County records written tab separated with a header, read back."""
    from geolex.sources import sinks
    df = J.x1_county_records(spark, d)
    path = J.sink_path(spark, "county_records") + ".csv"
    sinks.write_table(df, path)
    return spark.read.csv(path, header=True, sep="\t", schema=df.schema)


# ---------------------------------------------------------------- places
@query("p8_clean_attainment")
def q_p8(spark, d):
    return places.clean_attainment(S.attainment_raw(spark, d), counties_only=True)


@query("j9_place_names")
def q_j9(spark, d):
    return places.place_names(S.attainment_raw(spark, d))


@query("j10_zip_table")
def q_j10(spark, d):
    return places.zip_table(S.zip_county(spark, d), "one")


@query("j3_nearest_zip")
def q_j3(spark, d):
    return places.nearest_zip(S.supplier_points(spark, d), S.zip_centroids(spark, d), J.RADIUS_MILES)


@query("j3_three_nearest_zips")
def q_j3k(spark, d):
    return nearest.nearest_zips(S.supplier_points(spark, d), S.zip_centroids(spark, d), J.RADIUS_MILES, 3)


@query("j6_points_to_counties")
def q_j6(spark, d):
    return J.x5_points_to_counties(spark, d)


@query("x5_located_counties")
def q_x5(spark, d):
    return J.x5_located_counties(spark, d)


@query("x5_located_counts")
def q_x5_counts(spark, d):
    return J.x5_located_counts(spark, d)


@query("a9_ingest_counts")
def q_a9i(spark, d):
    return J.ingest_counts(spark, d)


@query("s3_quarantined_lines")
def q_s3q(spark, d):
    return J.quarantined_lines(spark, d)


@query("s3_person_lines")
def q_s3p(spark, d):
    """S3's second shape, strictly: person records as JSON-lines files, read back with FAILFAST."""
    from geolex.sources import sinks
    people = S.persons(spark, d)
    path = J.sink_path(spark, "persons") + ".json"
    sinks.write_table(people, path)
    return readers.read_persons(spark, path, schema=people.schema, mode="FAILFAST").drop("_corrupt")


@query("j5_resolve_places")
def q_j5(spark, d):
    return J.resolved_posts(spark, d).select("post_id", "state", "county", "fips", "resolved_by")


@query("x1_person_records")
def q_x1p(spark, d):
    return J.x1_person_records(spark, d).select("post_id", "fip", "user_id", "text", "filtered_text",
                                                "url_count", "emoji_count", *LEVEL_COLUMNS)


@query("j4_unmatched_zips")
def q_j4(spark, d):
    return places.unmatched_zips(J.located_resolved(spark, d))


@query("x1_county_words")
def q_x1w(spark, d):
    return J.x1_county_words(spark, d)


@query("x1_person_tsv")
def q_x1t(spark, d):
    """X1's person records (free text included) written tab separated and read back."""
    from geolex.sources import sinks
    df = J.x1_person_records(spark, d).select("post_id", "fip", "user_id", "text", "filtered_text", "url_count",
                                              "emoji_count", *LEVEL_COLUMNS)
    path = J.sink_path(spark, "persons") + ".csv"
    sinks.write_table(df, path)
    return spark.read.csv(path, header=True, sep="\t", schema=df.schema)


@query("x1_county_records")
def q_x1c(spark, d):
    return J.x1_county_records(spark, d)


# -------------------------------------------------------------- profiles
@query("a4_person_records")
def q_a4(spark, d):
    return S.persons(spark, d)


@query("a1_region_words")
def q_a1w(spark, d):
    p = S.post_lines(spark, d)
    posts = p.select("fip", tx.strip_stop_words("text", S.STOP_WORDS).alias("text"))
    counts = materialize(profiles.word_counts(posts, "fip", "text", classify=True), "a1_counts")
    return profiles.shares(counts, "fip", few_keys=True)


@query("a1_region_totals")
def q_a1t(spark, d):
    return profiles.region_totals(S.persons(spark, d), "fip")


@query("a2_region_word_share")
def q_a2w(spark, d):
    return profiles.profile_words(S.persons(spark, d), "fip", cut=True, few_keys=True)


@query("a2_region_profile")
def q_a2t(spark, d):
    return profiles.profile_totals(S.persons(spark, d), "fip", order_col="line_no")


@query("a2_archived_word_share")
def q_a2a(spark, d):
    return archives.stored_shares(J.archive_store(spark, d))


@query("a1_archived_totals")
def q_a1a(spark, d):
    return archives.stored_totals(J.archive_store(spark, d))


@query("a3_user_word_share")
def q_a3w(spark, d):
    return profiles.profile_words(S.persons(spark, d), "user_id", cut=True)


@query("a3_user_profile")
def q_a3t(spark, d):
    return profiles.profile_totals(S.persons(spark, d), "user_id", order_col="line_no", carry=["fip"])


# ------------------------------------------------------------ word model
def _x2_observations(spark, d):
    train = J.train_counts(J._x2_counts(spark, d))
    return wordmodel.observations(profiles.shares(train, "fip", few_keys=True), S.targets(S.region_levels(spark, d)),
                                  S.STOP_WORDS, tasks=tasks_for(train))


@query("a5_word_observations")
def q_a5(spark, d):
    return wordmodel.tested_words(_x2_observations(spark, d), J.WORD_COUNT_THRESHOLD).withColumnRenamed("count", "n")


@query("a6_bonferroni_factor")
def q_a6(spark, d):
    return wordmodel.bonferroni_factor(wordmodel.tested_words(_x2_observations(spark, d), J.WORD_COUNT_THRESHOLD))


@query("r1_word_regression")
def q_r1(spark, d):
    return J.word_model_all(spark, d)


@query("r6_word_model")
def q_r6(spark, d):
    """The corrected p-value is the raw one times the number of words (10^4 and
    more), so it is compared to 3 decimals: the two engines' covariances differ
    in the last bits."""
    return J.word_model_train(spark, d).withColumn("pval", F.round("pval", 3))


@query("a12_model_wide")
def q_a12(spark, d):
    wide = wordmodel.model_wide(J.word_model_train(spark, d))
    return wide.withColumns({f"pval_{k}": F.round(f"pval_{k}", 3) for k in range(4)})


@query("r3_tail_p_values")
def q_r3(spark, d):
    """R3 on a correlation and a number of points made of each part's key: logarithms, so that the
    far tail is compared in its leading digits."""
    k = F.col("p_partkey")
    pairs = S.table(spark, d, "part").select("p_partkey", ((100 + k * 7919 % 891) / F.lit(1000.0)).alias("r"),
                                             (3 + k * 104729 % 301).alias("n"))
    return pairs.select("p_partkey", "n", "r", F.log10(st.corr_p_value("r", "n")).alias("log10_p"))


@query("w4_top_words")
def q_w4(spark, d):
    return J.top_words(spark, d, ascending=False)


@query("w5_bottom_words")
def q_w5(spark, d):
    return J.top_words(spark, d, ascending=True)


# ------------------------------------------------- split / predict / eval
@query("r7_train_test_split")
def q_r7(spark, d):
    return J.labelled_persons(spark, d).select("user_id", "line_no", "fip", "is_train")


@query("r8_three_way_split")
def q_r8(spark, d):
    p = S.post_lines(spark, d).select("user_id", "line_no")
    return split.hash_split3(p, J.POST_KEY)


@query("a9_split_counts")
def q_a9(spark, d):
    return split.split_counts(J.labelled_persons(spark, d))


@query("r9_classify_users")
def q_r9(spark, d):
    return J.held_out_predictions(spark, d)


@query("r10_evaluate")
def q_r10(spark, d):
    return J.evaluation(spark, d)


@query("a10_mean_error")
def q_a10(spark, d):
    return predict.mean_error(J.evaluation(spark, d))


@query("x4_score_saved_model")
def q_x4(spark, d):
    return predict.mean_error(J.score_with_model(spark, d))


@query("x4_score_bucketed_tables")
def q_x4b(spark, d):
    return predict.mean_error(J.score_bucketed(spark, d))


@query("x3_word_usage_by_level")
def q_x3u(spark, d):
    return J.word_usage(spark, d)


# ----------------------------------------------------------------- tf-idf
@query("a13_term_frequency")
def q_a13(spark, d):
    docs = tfidf.sentence_docs(S.dealt_documents(spark, d, "doc_id", "text"), "doc_id", "text")
    clean = docs.select("doc_id", "sent_no", tx.strip_special("text").alias("text"))
    return tfidf.term_frequencies(tfidf.term_counts(clean, ["doc_id", "sent_no"]), ["doc_id", "sent_no"])


@query("a14_document_frequency")
def q_a14(spark, d):
    docs = tfidf.sentence_docs(S.dealt_documents(spark, d, "doc_id", "text"), "doc_id", "text")
    clean = docs.select("doc_id", "sent_no", tx.strip_special("text").alias("text"))
    counts = materialize(tfidf.term_counts(clean, ["doc_id", "sent_no"]), "term_counts")
    return tfidf.inverse_document_frequencies(counts)


@query("r11_tfidf")
def q_r11(spark, d):
    return J.sentence_tfidf(spark, d)


# ----------------------------------------------------------------- report
@query("w1_top_regions")
def q_w1(spark, d):
    return report.top_regions(J.lineitem_wide(spark, d), J.LINEITEM_LEVELS, "fips", 10)


@query("w1_attainment_top")
def q_w1a(spark, d):
    """W1 on the attainment table: FIPS, state, area and the four levels of each ranked row."""
    att = places.clean_attainment(J.attainment(spark, d), counties_only=True)
    return report.top_regions(att, ATTAINMENT_VALUE_COLUMNS[-4:], "FIPS", 10, keep=["State", "Area"])


@query("w3_order_by_level")
def q_w3(spark, d):
    return report.order_by_level(J.lineitem_wide(spark, d), "l_extendedprice", "fips")


@query("m6_bin_edges")
def q_m6(spark, d):
    e = report.bin_edges(J.lineitem_wide(spark, d), J.LINEITEM_LEVELS, 16)
    return e.select("level", "lo", "hi", F.posexplode("edges").alias("edge_no", "edge"))


@query("x9_level_bins")
def q_x9(spark, d):
    return J.level_bins(spark, d)


def queries() -> Q:
    return dict(_REG)
