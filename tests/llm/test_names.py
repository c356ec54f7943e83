"""Extra columns keep their values whatever their names, and no row of several is taken at random."""

from pyspark.sql import functions as F

from amplitract.llm import mixing, quality_rules


def test_helper_columns_leave_the_users_alone(spark):
    rows = [(k, f"some words of text number {k} " * 20, "en", "s", 1) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("_by_words", "by_words", "mix_rid", "mix_size", "mix_times", "mix_copy", "label_bad", "known_key")
    docs = docs.select("*", *[F.lit(100 + k).alias(n) for k, n in enumerate(names)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    for out in (quality_rules.judge(docs, labels), mixing.mix_documents(docs)):
        found = out.select(*names).distinct().collect()
        assert [tuple(r) for r in found] == [tuple(100 + k for k in range(len(names)))]
    assert mixing.mix_documents(docs).columns == docs.columns


def test_contradicting_labels_all_count(spark):
    """Half of the labels of each id say good and half bad, in any order of rows: the same rules come of them."""
    good = " ".join(f"word{k}" for k in range(120))
    bad = good.replace("word1", "#$%& |")
    rows = [(k, bad if k % 2 else good) for k in range(400)] + [(k, good) for k in range(0, 400, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(400)] + [(k, k % 2) for k in range(0, 400, 39)], "doc_id long, quality int")
    fits = [str(quality_rules.fit_rules(docs.repartition(n), labels.repartition(n))) for n in (1, 5, 9)]
    assert fits[0] == fits[1] == fits[2] and "symbols" in fits[0], fits
