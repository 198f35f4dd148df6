"""Composed jobs (X1-X9) over the stand-in inputs.

Each returns a DataFrame; jobs that read an intermediate table more than once
write it first (``session.materialize``), which runs when the job is called.
Parameters carry the reference's defaults.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolex.functions import text as tx
from geolex.operators import archives, places, predict, profiles, report, sentences, split, tfidf, usage, wordmodel
from geolex.plans import standins as S
from geolex.session import ensure_checkpoint_dir, materialize, remember_cut, tasks_for
from geolex.sources import ingest, readers, sinks

# --- fixed values (reference defaults) --------------------------------------
WORD_COUNT_THRESHOLD = 3
ALPHA = 0.05
POSITIVE_IMPORTANCY = 0.1
TRAIN_FRACTION = 0.7
REPORT_LEVEL, REPORT_MIN_N, REPORT_MAX_P, TOP_N = 3, 15, 0.2, 20
RADIUS_MILES = 10.0
# --- end of fixed values ----------------------------------------------------

POST_KEY = ("user_id", "line_no")


def sink_path(spark: SparkSession, name: str) -> str:
    """A new path for a file that a job writes and reads back; ``remove_cuts`` deletes it."""
    return remember_cut(os.path.join(ensure_checkpoint_dir(spark), "sinks", f"{name}-{uuid.uuid4().hex}"))


# ---------------------------------------------------------------- X3 / X4
def fit_region_model(region_counts: DataFrame, targets: DataFrame, trim: bool, corrected: bool) -> DataFrame:
    """Region word shares -> observations -> per-word regression.

    ``trim`` and no correction is X3's learning step; no trim with
    Bonferroni and the importance gate is X2's."""
    words = profiles.shares(region_counts, "fip", few_keys=True)
    obs = wordmodel.observations(words, targets, S.STOP_WORDS, trim=trim, tasks=tasks_for(region_counts))
    return wordmodel.fit_word_model(obs, WORD_COUNT_THRESHOLD, ALPHA, POSITIVE_IMPORTANCY,
                                    bonferroni=corrected, gate=corrected)


def word_model_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region profile of all posts -> stop words, trim, NaN -> per-word
    regression for the four levels (no correction, no gate)."""
    counts = materialize(profiles.word_counts(S.persons(spark, sf_dir), "fip"), "fip_word_counts")
    return fit_region_model(counts, S.targets(S.region_levels(spark, sf_dir)), trim=True, corrected=False)


def top_words(spark: SparkSession, sf_dir: str, ascending: bool = False) -> DataFrame:
    """X3 report: W4 (or W5 with ``ascending``)."""
    return wordmodel.top_words(word_model_all(spark, sf_dir), REPORT_LEVEL, REPORT_MIN_N,
                               REPORT_MAX_P, TOP_N, ascending)


def score_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3's model is written as CSV (S11), read back (S7) -> A12 -> users
    (A3) -> R9 -> R10.  The posts are read once: one ``(user, fip, word)`` count table
    feeds the region and the user profiles, and tells each user's latest region."""
    marked = materialize(profiles.marked_word_counts(S.persons(spark, sf_dir), ["user_id", "fip"], "line_no"),
                         "user_fip_word_counts")
    counts = profiles.words_of(marked)
    targets = S.targets(S.region_levels(spark, sf_dir))
    path = sink_path(spark, "word_model")
    sinks.write_table(fit_region_model(profiles.rollup_counts(counts, "fip"), targets, trim=True, corrected=False),
                      path, fmt="csv", sep=",")
    model = readers.read_word_model(spark, path)
    preds = classify_users(marked, model)
    return predict.evaluate(preds, targets)


def bucketed(df: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    path = sink_path(df.sparkSession, name)
    return sinks.write_bucketed(df, os.path.basename(path).replace("-", "_"), path, ["word", "salt"], buckets)


def buckets_for(counts: DataFrame) -> int:
    """Buckets for stored counts: in proportion to their size, no fewer than shuffle partitions."""
    return max(tasks_for(counts), int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def score_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 over saved tables: user counts and model are bucketed by word and salt, so models that are
    fitted again score the stored users without another shuffle of their counts."""
    marked = materialize(profiles.marked_word_counts(S.persons(spark, sf_dir), ["user_id", "fip"], "line_no"),
                         "user_fip_word_counts")
    counts = profiles.words_of(marked)
    targets = S.targets(S.region_levels(spark, sf_dir))
    model = fit_region_model(profiles.rollup_counts(counts, "fip"), targets, trim=True, corrected=False)
    buckets = buckets_for(marked)
    saved_model = bucketed(predict.salted_model(wordmodel.model_wide(model)), "word_model", buckets)
    saved_counts = bucketed(predict.salted_counts(user_counts(marked)), "user_counts", buckets)
    preds = predict.classify(saved_counts, profiles.latest_of(marked, "user_id", "fip"), saved_model, on=("word", "salt"))
    return predict.evaluate(preds, targets)


def word_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words the education groups of regions use differently (over all posts, untrimmed words)."""
    counts = materialize(profiles.word_counts(S.persons(spark, sf_dir), "fip"), "fip_word_counts")
    groups = materialize(usage.level_groups(S.targets(S.region_levels(spark, sf_dir))), "level_groups")
    return usage.word_usage(counts, groups)


# ---------------------------------------------------------------------- X2
def labelled_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.hash_split(S.persons(spark, sf_dir), POST_KEY, TRAIN_FRACTION)


def _x2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(is_train, user_id, fip, word, cnt, last)``: every post read and tokenised once."""
    return materialize(profiles.marked_word_counts(labelled_persons(spark, sf_dir), ["is_train", "user_id", "fip"],
                                                   "line_no"), "split_word_counts")


def train_counts(marked: DataFrame) -> DataFrame:
    return profiles.rollup_counts(profiles.words_of(marked).filter(F.col("is_train")), "fip")


def word_model_train(spark: SparkSession, sf_dir: str, marked: DataFrame | None = None) -> DataFrame:
    """X2 learn: train split -> region profile -> stop words -> n > 3 ->
    regression, Bonferroni, importance gate."""
    marked = _x2_counts(spark, sf_dir) if marked is None else marked
    return fit_region_model(train_counts(marked), S.targets(S.region_levels(spark, sf_dir)), trim=False, corrected=True)


def user_counts(marked: DataFrame) -> DataFrame:
    """``(user_id, word, cnt)`` of the stored marked counts, which hold hardly more than one row per user and
    word: dealt out by user first, over tasks in proportion to their size, not as the files are packed."""
    words = profiles.words_of(marked)
    return profiles.rollup_counts(words.repartition(tasks_for(marked), "user_id"), "user_id")


def classify_users(marked: DataFrame, model: DataFrame) -> DataFrame:
    """A3 -> J8/M4/W7: one row per user with words: fip, scores, level.

    The user's region is that of the latest post (D12; of posts with the same
    number the largest fip), which the marked counts know.  Counts and model are dealt out
    by word and salt over tasks in proportion to the stored counts."""
    return predict.classify(predict.salted_counts(user_counts(marked)), profiles.latest_of(marked, "user_id", "fip"),
                            predict.salted_model(wordmodel.model_wide(model)), on=("word", "salt"), tasks=tasks_for(marked))


def held_out_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _x2_counts(spark, sf_dir)
    return classify_users(marked.filter(~F.col("is_train")), word_model_train(spark, sf_dir, marked))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 evaluate: R10 on the test users."""
    return predict.evaluate(held_out_predictions(spark, sf_dir), S.targets(S.region_levels(spark, sf_dir)))


# ---------------------------------------------------------------------- X7
def sentence_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tfidf.sentence_docs(S.dealt_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text")
    return tfidf.tfidf(docs, ["doc_id", "sent_no"], "text", cut=True)


def sentence_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus' abbreviations and sentence starters, from one written table of counts."""
    counts = materialize(sentences.end_counts(S.table(spark, sf_dir, "documents").select("text")), "end_counts")
    abbrevs = materialize(sentences.abbreviations(counts), "abbreviations")
    return abbrevs, materialize(sentences.sentence_starters(counts, abbrevs), "sentence_starters")


def learned_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.learned_sentences(docs, "doc_id", "text", *sentence_model(spark, sf_dir))


# ---------------------------------------------------------------------- X1
def attainment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attainment table, written once: one row per county and state, which
    gazetteer, known counties and levels all read."""
    return materialize(S.attainment_raw(spark, sf_dir), "attainment")


def located_resolved(spark: SparkSession, sf_dir: str, att_raw: DataFrame | None = None) -> DataFrame:
    """X1 up to J5: JSON posts -> located -> county/state/coordinates -> fips (null if
    unresolved)."""
    att_raw = attainment(spark, sf_dir) if att_raw is None else att_raw
    names = places.place_names(att_raw)
    zips_one = places.zip_table(S.zip_county(spark, sf_dir), "one")
    known = places.attainment_levels(places.clean_attainment(att_raw, counties_only=False))
    posts = S.located_posts(spark, sf_dir)
    return places.resolve_places(posts, names, zips_one, S.zip_centroids(spark, sf_dir),
                                 known.select("fips"), RADIUS_MILES)


def resolved_posts(spark: SparkSession, sf_dir: str, att_raw: DataFrame | None = None) -> DataFrame:
    """X1 up to P6."""
    return located_resolved(spark, sf_dir, att_raw).filter(F.col("fips").isNotNull())


def x1_person_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    att_raw = attainment(spark, sf_dir)
    levels = places.attainment_levels(places.clean_attainment(att_raw, counties_only=False))
    posts = resolved_posts(spark, sf_dir, att_raw)
    return profiles.person_records(posts, levels, S.STOP_WORDS, key="fips", keep=["post_id"])


def x1_county_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.region_totals(x1_person_records(spark, sf_dir), "fip")


def x1_county_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1's central output: word shares per county of the resolved posts, long form."""
    return profiles.profile_words(x1_person_records(spark, sf_dir), "fip", cut=True, few_keys=True)


# ---------------------------------------------------------------------- X5
def x5_points_to_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points -> nearest zip (J3) -> every county of that zip."""
    near = places.nearest_zip(S.supplier_points(spark, sf_dir), S.zip_centroids(spark, sf_dir),
                              RADIUS_MILES, ["point_id"])
    zips_all = places.zip_table(S.zip_county(spark, sf_dir), "all")
    return places.zip_to_fips(near.withColumn("zip", F.col("zip").cast("string")), zips_all)


#: Values come back from the delimited file as they were written, white space and line ends included.
EXACT_CSV = dict(header=True, sep="\t", quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False)


def located_counties(records: DataFrame, centroids: DataFrame, zips_all: DataFrame) -> tuple[DataFrame, int]:
    """X5 on the located records: T16 -> J3 -> J6 -> S10, read back, and the number of rows written: one row
    per post and county of the zip nearest to the coordinates that its location text states."""
    flat = places.flatten_posts(records)
    at = tx.parse_lat_long("location")
    keep = ["user_id", "text", "created_at"]
    points = flat.select(*keep, at["lat"].alias("lat"), at["long"].alias("lon")).dropna(subset=["lat", "lon"])
    near = places.nearest_zip(points, centroids, RADIUS_MILES, keep)
    found = places.zip_to_fips(near.withColumn("zip", F.col("zip").cast("string")), zips_all).select("fips", *keep)
    path = sink_path(records.sparkSession, "located-counties") + ".csv"
    n = ingest.observed_write(found, lambda df: df.write.options(**EXACT_CSV).csv(path))
    return records.sparkSession.read.options(**EXACT_CSV, multiLine=True).schema(found.schema).csv(path), n


def ingest_located(spark: SparkSession, sf_dir: str) -> ingest.Ingested:
    """P1 -> P3 in one pass over the raw lines: the records of strictly located posts, the corrupt lines, the counts."""
    return ingest.ingest_posts(S.raw_post_json(spark, sf_dir), sink_path(spark, "located-posts"),
                               keep=places.keep_located_raw(strict=True), carry=("user_id", "line_no"),
                               shape=S.stated_coordinates)


def x5_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ingest.Ingested, int]:
    """The whole X5: the delimited file, what was ingested, and the number of records in the file."""
    taken = ingest_located(spark, sf_dir)
    found, n = located_counties(taken.records.drop("user_id", "line_no"), S.zip_centroids(spark, sf_dir),
                                places.zip_table(S.zip_county(spark, sf_dir), "all"))
    return found, taken, n


def x5_located_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x5_run(spark, sf_dir)[0]


def x5_located_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5's A9, counted by the jobs that write the records: lines read (those that are no JSON included), and
    records of the delimited file."""
    _, taken, n = x5_run(spark, sf_dir)
    return spark.createDataFrame([(taken.counts["total"], n)], "n_total long, n_valid long")


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pass over the raw lines: total, corrupt, without a post, not located, and valid records."""
    counts = ingest_located(spark, sf_dir).counts
    names = ("total", "corrupt", "notice", "dropped", "valid")
    return spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"n_{n} long" for n in names))


def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrupt lines, from the quarantine's own file of text lines and their origin."""
    path = sink_path(spark, "quarantine")
    sinks.write_table(ingest_located(spark, sf_dir).quarantine, path, fmt="json")
    return spark.read.schema("user_id long, line_no long, value string").json(path)


# ---------------------------------------------------------------- archives
ARCHIVES = 3


def archive_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts of every document in the archive of its id, added archive by archive; the second one
    is added again, as an archive that has grown."""
    path = sink_path(spark, "archives")
    people = S.persons(spark, sf_dir)
    for n in (*range(ARCHIVES), 1):
        archives.add_archive(people.filter(F.col("user_id") % ARCHIVES == n), f"part-{n}", path)
    return archives.stored_counts(spark, path, kind="string")


# ---------------------------------------------------------------------- X9
def level_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual and predicted level of every region binned for a map.

    The evaluation (one row per region) goes through the prediction file
    (S11): vectors rendered as text, read back and parsed (T15)."""
    path = sink_path(spark, "predictions") + ".csv"
    ev = evaluation(spark, sf_dir)
    sinks.write_table(ev.select("fip", F.array(*[f"y{k}" for k in range(4)]).alias("edu_info"),
                                F.array(*[f"pred_{k}" for k in range(4)]).alias("pred"), "error"), path)
    rows = spark.read.csv(path, header=True, sep="\t", schema="fip string, edu_info string, pred string, error double")
    parsed = rows.select("fip", tx.parse_vector("edu_info").alias("y"), tx.parse_vector("pred").alias("p"))
    ev = parsed.select("fip", *[F.get("y", k).alias(f"y{k}") for k in range(4)],
                       *[F.get("p", k).alias(f"pred_{k}") for k in range(4)])
    actual = report.level_bins(ev, "fip", [f"y{k}" for k in range(4)]).withColumn("kind", F.lit("actual"))
    pred = report.level_bins(ev, "fip", [f"pred_{k}" for k in range(4)]).withColumn("kind", F.lit("predicted"))
    return actual.unionByName(pred)


LINEITEM_LEVELS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lineitem_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide numeric table for W1/W3/M6: key = order * 10 + line number."""
    li = S.table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fips"), *LINEITEM_LEVELS)

