from pyspark.sql import functions as F

from chronolex.functions import stemming
from chronolex.operators import search

#: fixed values: examples of the paper
KNOWN = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "hopefulness": "hope", "formaliti": "formal", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "inference": "infer", "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "as": "as", "x1s": "x1s", "": ""}


def test_paper_examples():
    assert {w: stemming.stem(w) for w in KNOWN} == KNOWN


def test_search_by_stem(spark):
    docs = spark.createDataFrame([(1, None, "They were hoping for relations", 1, "a"), (2, None, "A hope", 2, "a"), (3, None, None, 3, None), (4, "nothing", "here", 4, "a")], "doc_id long, title string, text string, ts long, source_id string")
    q = spark.createDataFrame([(9, "hopes relational", 100, None, None, None), (8, None, 100, None, None, None)], "query_id long, text string, before long, after long, exclude_source string, exclude_doc long")
    assert {r.doc_id for r in search.bm25(q, search.postings(search.words(docs, stem=True)), stem=True).collect()} == {1, 2}
    assert search.bm25(q, search.postings(search.words(docs))).count() == 0
    assert spark.createDataFrame([(None,)], "w array<string>").select(stemming.stems(F.col("w")).alias("s")).first().s is None
