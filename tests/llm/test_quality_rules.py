import re
from collections import Counter

from pyspark.sql import functions as F

from mapweave.llm.quality_rules import fit, judge, quality_rules

SCHEMA = "doc_id long, text string, quality_rules string, h string, k string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k for i, x in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[x] > 1 for k in (i, i + 1, i + 2)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def clean(i, n=120):
    return " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(n))


def rows():
    texts = [clean(i) for i in range(300)] + [" ".join(f"@@{(i * 31 + k * k * 7) % 1009}%%" for k in range(90)) for i in range(60)]
    texts += [None, "", " \n\t ", "a\nb\na\n \na", "x y z " * 40, "a b c a b c d", "é𝄞 #*$ %&|<>\x0b\x0ca\x85b\xa0c", "long text # " * 20000, "a b a b a b a b", "p q r s p q r"]
    return [(i, t, "a", "b", "c") for i, t in enumerate(texts)] + [(0, texts[0], "", "", "")]


def test_base_columns_and_verdicts(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(301, 0), (None, 1)], "doc_id long, quality int")
    got = quality_rules(docs.drop("quality_rules"), labels).select("doc_id", "text", "h", "quality_rules.*").collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(r.text), r.text[:60]
        if r.doc_id < 300:
            assert r.kept, r.llr
        elif r.doc_id < 360 or r.base_failed:
            assert not r.kept


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame(rows(), SCHEMA).drop("quality_rules")
    assert all(r.q.kept != r.q.base_failed for r in quality_rules(docs, labels, into="q").collect())
    weights, threshold = fit(docs.limit(0), labels)
    assert judge(docs.limit(0), weights, threshold).count() == 0


def test_all_trusted_documents_count(spark):
    """Trusted documents of a rare language lie last in the order of hashes: they are kept, as they count; both joins give the same."""
    last = spark.range(21_000).orderBy(F.xxhash64("id").desc()).limit(400).withColumn("rare", F.lit(True))
    word = F.when(F.col("id") >= 21_000, "junk").when(F.col("rare"), "rare").otherwise("often")
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(59)), lambda j: F.concat(word, F.pmod(F.col("id") * 7 + j * j, F.lit(997)).cast("string"))))
    docs = spark.range(24_000).join(last, "id", "left").select(F.col("id").alias("doc_id"), "rare", text.alias("text")).cache()
    labels = spark.range(21_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    weights, threshold = fit(docs, labels)
    kept = judge(docs, weights, threshold, into="q").groupBy("rare", (F.col("doc_id") >= 21_000).alias("junk")).agg(F.avg(F.col("q.kept").cast("int")).alias("share")).collect()
    shares = {(bool(r.rare), r.junk): r.share for r in kept}
    assert shares[True, False] > 0.9 and shares[False, False] > 0.99 and shares[False, True] == 0
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "null key")], "doc_id long, text string"))
    assert fit(odd, labels) == fit(odd, labels, broadcast_rows=0)
