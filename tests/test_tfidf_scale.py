"""Terms are counted where their documents are; only rows of rare terms are shuffled to their idf."""
import re

from geolex.operators import tfidf
from geolex.plans import standins
from tests.conftest import SF001
from tests.test_plans import plan_of


def test_terms_are_counted_where_their_documents_are(spark):
    docs = tfidf.sentence_docs(standins.dealt_documents(spark, SF001, "doc_id", "text"), "doc_id", "text")
    plan = plan_of(tfidf.term_counts(docs, ["doc_id", "sent_no"]))
    assert len(re.findall(r"Exchange hashpartitioning\(", plan)) == 1 and "hashpartitioning(doc_id" in plan


def test_frequent_and_rare_terms_all_meet_their_idf(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "FREQUENT", 4)
    texts = ["the cat. the dog", "the cat sat", "a bird", "the end", "the end", "the"]
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate([*texts, texts[0]])] + [(None, 0, "the null"), (0, 0, "the cat")],
                                 "doc_id long, sent_no int, text string")
    ids = ["doc_id", "sent_no"]
    got = tfidf.tfidf(docs, ids, cut=True)
    assert "BroadcastHashJoin" in plan_of(got) and "LeftAnti" in plan_of(got)
    plain = tfidf.tfidf(docs, ids, cut=False)
    order = lambda df: sorted((str(r.doc_id), r.term, r.tf, r.idf, r.tfidf) for r in df.collect())
    assert order(got) == order(plain) and len(order(got)) > 10
