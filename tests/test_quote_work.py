"""What quotes that agree cost: keys from the beginning of a text, words cut out once a pair, no numbering."""

from pyspark.sql import functions as F

from citeloom.functions import names as N
from citeloom.operators import cards as C
from citeloom.plans import registry


def test_a_key_is_that_of_the_whole_text(spark):
    filler = [" ", "--", "é", "́", "漢", "ﬁ"]
    texts = [None, "", *(f * n + "Añb 1 " * m + "x" * k for f in filler for n in (0, 3, 399, 400, 401, 900) for m in (0, 1, 40, 100, 200) for k in (0, 1, 400))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").repartition(4)
    whole = F.substring(N.norm_title_alnum(N.unaccented(F.coalesce("x", F.lit("")))), 1, 220)
    assert df.select("i", whole.alias("w"), N.canonical_quote_key(F.col("x")).alias("k")).where("not (w <=> k)").count() == 0
    # no more than the beginning is read where that suffices
    assert df.where("length(x) > 400").select(F.length(N.canonical_quote_key(F.col("x"))).alias("n")).where("n = 220").count() > 100


def test_a_pairs_words_are_cut_out_once(spark):
    plan = spark.createDataFrame([("a b c d e f", "b c d e f g")], "kept string, new string").select(C.agree(F.col("kept"), F.col("new")).alias("x"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # within the loop over the shorter key's words nothing is split
    loop = text[text.index("filter(") :]
    assert "split(" not in loop[: loop.index("array_contains") + 60] and plan.head()[0]


def test_quotes_are_not_numbered(spark, monkeypatch):
    monkeypatch.setattr(C, "numbered", lambda *_: (_ for _ in ()).throw(AssertionError("numbered")))
    assert registry.QUERIES["u9_distinct_quotes"](spark, "/root/testdata/sf0.001").count() > 0
