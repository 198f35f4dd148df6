"""Language ID by compression.

Each learned language has a raw-content dictionary for zstandard: text of that
language.  A text is lower-cased and cut into segments (so that the dictionary, and not the
text's own beginning, explains each of them), every segment is encoded with
every language's dictionary, and the language with the fewest bytes wins.  The
margin is the share of bytes that the winner saves on the second; where it is
narrow the answer is rejected.  Frames are whole bytes, so short texts often tie:
the languages that tie on a text too short for its bytes to show ``MIN_MARGIN``
are measured again by the bytes that the text adds to each of ``PIECES`` evenly
spaced pieces of their dictionaries, and that margin decides.

The dictionaries are fitted on a bounded sample of labelled rows: per language
the ``SAMPLE_ROWS`` distinct texts with the smallest hashes, cut to
``DICTIONARY`` bytes of evenly spaced segments, and less where there are so many
languages that all dictionaries together would pass ``ALL_DICTIONARIES``.
Everything predicted is read whole.

Rules: rows whose label is null, or that ``held_out`` sets apart, are not
learned from.  A text that is null or has no letter is ``und`` with score 0 and
is rejected, as is every text when nothing could be learned.  With one
learned language every text with a letter is that language, with margin 1.
Ties go to the language that sorts first.  The score is 1/2 at margin 0 and
rises to 1.  Rows are independent, so repeated rows, null ids and extra columns
do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolex.llm.common import cut, held_out, named, packed, ship, table, unpacked

SAMPLE_ROWS, SALTS = 256, 16
DICTIONARY, ALL_DICTIONARIES = 64 << 10, 16 << 20
SAMPLE_SEGMENT, SEGMENT, LEVEL = 1024, 4096, 6
#: Pieces of a dictionary, and their most bytes, that measure ties.
PIECES, PIECE = 16, 2048
FINE = dict(window_log=17, chain_log=13, hash_log=13, search_log=4, min_match=4, target_length=64,
            strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
#: Margins below this are rejected.
MIN_MARGIN = 0.002


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, text): per language the distinct texts with the smallest hashes.  Only
    (language, hash) pairs are ranked; the chosen few then fetch their texts."""
    labelled = docs.filter("lang IS NOT NULL AND length(text) > 0").select(
        "lang", "text", F.xxhash64("text").alias("_h"))
    chosen = labelled.select("lang", "_h").distinct()
    for salt in (F.pmod("_h", F.lit(SALTS)), F.lit(0)):  # so a language's last window has SALTS * rows at most
        first = Window.partitionBy("lang", salt).orderBy("_h")
        chosen = chosen.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= rows).drop("_n")
    chosen = chosen.select(F.col("lang").alias("_lang"), F.col("_h").alias("_chosen"))
    chosen = cut(chosen, "op5-sample")  # so that its size is known before any text moves
    return (labelled.join(chosen, (F.col("lang") == F.col("_lang")) & (F.col("_h") == F.col("_chosen")), "left_semi")
            .groupBy("lang", "_h").agg(F.first("text").alias("text")))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Language to dictionary; ``docs`` has text, lang and doc_id."""
    chosen = sample(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    chosen = chosen.select("lang", "_h", F.lower("text").cast("binary").alias("text"))

    def build(key, rows):
        """Evenly spaced segments of all sampled texts, up to a dictionary's size."""
        texts = rows.sort_values("_h")["text"]
        segments = [t[i:i + SAMPLE_SEGMENT] for t in texts for i in range(0, len(t), SAMPLE_SEGMENT)]
        step = max(1.0, sum(map(len, segments)) / DICTIONARY)
        picked = b"".join(segments[int(i * step)] for i in range(int(len(segments) / step)))
        return rows.iloc[:1][["lang"]].assign(dictionary=[picked[:DICTIONARY]])

    ship(docs.sparkSession)
    built = chosen.groupBy("lang").applyInPandas(build, "lang string, dictionary binary")
    size = min(DICTIONARY, ALL_DICTIONARIES // max(1, built.select("lang").distinct().count()))
    made = built.select("lang", F.substring("dictionary", 1, size).alias("dictionary"))
    return {r.lang: bytes(r.dictionary) for r in made.orderBy("lang").collect()}  # at most ALL_DICTIONARIES bytes


class Judge:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.coders = []
        for lang, content in sorted(dictionaries.items()):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.coders.append((lang, zstandard.ZstdCompressor(
                dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)))
        self.dictionaries = sorted(dictionaries.items())
        self.fine = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**FINE))
        self.pieces: dict[int, list[tuple[bytes, int]]] = {}  # a language's pieces and their sizes

    def added(self, k: int, raw: bytes) -> int:
        """The bytes that ``raw`` adds to the pieces of the k-th language's dictionary."""
        if k not in self.pieces:
            content = self.dictionaries[k][1]
            cuts = [content[at:at + PIECE] for at in (len(content) * i // PIECES for i in range(PIECES))]
            self.pieces[k] = [(cut, len(self.fine.compress(cut))) for cut in cuts]
        return max(1, sum(len(self.fine.compress(piece + raw)) - size for piece, size in self.pieces[k]))

    def __call__(self, text: str) -> tuple[str, float, float]:
        """(language, score, margin)."""
        if not self.coders or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        raw = text.lower().encode()
        segments = [raw[i:i + SEGMENT] for i in range(0, len(raw), SEGMENT)]
        sizes = [sum(map(len, map(coder.compress, segments))) for _, coder in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(sizes[:best] + sizes[best + 1:], default=0)
        margin = 1 - sizes[best] / second if second else 1.0
        if margin < MIN_MARGIN and sizes[best] * MIN_MARGIN < 1:
            tied = [k for k, size in enumerate(sizes) if size == sizes[best]]
            sizes = [self.added(k, raw) for k in tied]
            first, second = sorted(sizes)[:2]
            best, margin = tied[sizes.index(first)], 1 - first / second
        return self.coders[best][0], min(1.0, 0.5 + 5 * margin), margin


def language(spark: SparkSession, dictionaries: dict[str, bytes], text: Column) -> Column:
    """struct(lang, score, margin) of each text."""
    ship(spark)
    shipped = spark.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("lang string, score double, margin double")
    def judge_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(shipped.value)
        for texts in batches:
            made = [judge((t or b"").decode("utf-8", "replace")) for t in texts]
            yield pd.DataFrame(made, columns=["lang", "score", "margin"])

    return judge_all(F.coalesce(text, F.lit("")).cast("binary"))


def rejected(answer: str) -> Column:
    return (F.col(answer)["lang"] == "und") | (F.col(answer)["margin"] < MIN_MARGIN)


def classify(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, rejected) of every row."""
    answers = docs.select(named(doc_id).alias("doc_id"),
                          language(docs.sparkSession, dictionaries, named(text)).alias("_answer"))
    return answers.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                          F.col("_answer.lang").alias("lang_pred"), "_answer.score", "_answer.margin",
                          rejected("_answer").alias("rejected"))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language is rejected."""
    answers = packed(docs).withColumn("_answer", language(docs.sparkSession, learn(docs), F.col("_row")["text"]))
    return unpacked(answers.filter(~rejected("_answer")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(docs))
