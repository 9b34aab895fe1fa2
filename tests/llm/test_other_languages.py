"""Texts outside the known languages, and of several of them, in language identification (6)."""

import corpus_pipeline
from pyspark.sql import functions as F

from tidepanel.llm import language_id as li
from tidepanel.llm.common import table

FOREIGN = {
    "ru": "Это простое предложение на русском языке о погоде и людях, которые живут в городе. ",
    "pt": "Os meninos foram para a escola com os seus amigos e depois voltaram para casa. ",
    "it": "Il ragazzo andava a scuola con i suoi amici e poi tornava a casa della nonna. ",
    "zh": "这是一个关于天气和城市里的人们的简单句子，我们今天去学校，明天回家。",
    "nl": "De jongen ging met zijn vrienden naar school en daarna weer naar huis toe. ",
}


def planted(spark):
    """Documents, then foreign texts under a wrong, a right and no declaration from 10^6, halves
    of two languages from 2 * 10^6, short quotes in a text of its own from 3 * 10^6."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    rows, i = [], 0
    for tag, t in FOREIGN.items():
        for said in ("es", "de", tag, None):
            for k in (1, 30):
                rows.append((1_000_000 + i, t * k, said, "src0"))
                i += 1
    long = {x: docs.filter((F.col("lang") == x) & (F.length("text") > 4000)).orderBy("doc_id").first().text[:4000] for x in ("en", "de", "fr")}
    rows += [(2_000_000, long["en"][:2000] + " " + long["de"][:2000], "en", "src0"), (2_000_001, long["fr"][:2000] + FOREIGN["ru"] * 30, "fr", "src0"),
             (2_000_002, " ".join(long[x][:1300] for x in long), None, "src0")]
    rows += [(3_000_000, long["en"] + " " + long["de"][:500], "en", "src0"), (3_000_001, long["de"] + " " + FOREIGN["ru"], "pl", "src0"), (3_000_002, long["fr"], None, "src0")]
    return docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))


def test_foreign_and_mixed_texts_are_rejected(spark):
    docs = planted(spark)
    got = {r.doc_id: r for r in li.identify(docs, host=F.col("source")).collect()}
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert all(got[i].language == li.OTHER for i in got if 1_000_000 <= i < 2_000_000)
    assert not any(1_000_000 <= i < 3_000_000 for i in kept)
    assert {3_000_000, 3_000_001, 3_000_002} <= kept
    assert [got[3_000_000 + i].language for i in range(3)] == ["en", "de", "fr"]


def test_known_texts_are_kept(spark):
    docs = planted(spark).filter("doc_id < 1000000 and size(split(text, ' ')) >= 10")
    kept = corpus_pipeline.language(spark, docs, "").count()
    assert kept > 0.98 * docs.count()


def test_rows_that_declare_another_language_train_it(spark):
    """A declared foreign collection is one class, and its wrong declarations do not take
    texts of a known language along."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("n_chars > 300").select("doc_id", "text", "lang", "source")
    swap = F.when(F.col("lang") == "fr", F.lit("oc")).when((F.col("lang") == "de") & (F.col("doc_id") % 5 == 0), F.lit("nl")).otherwise(F.col("lang"))
    got = li.identify(docs.withColumn("said", swap), declared="said", host=F.col("source"), keep=("lang",)).collect()
    right = sum(r.language == (li.OTHER if r.lang == "fr" else r.lang) for r in got)
    assert right > 0.98 * len(got)
