"""The query of generated cards against its SQL where quotes of one item and type are copies of a long text."""

from compare import connect, rows_of, rows_of_sql

from citeloom.plans import registry


def test_copies_of_long_texts_keep_their_cards(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    ids = [1 + 97 * 30 * i for i in range(4)] + [2, 5]
    rows = [(i, text if i % 4 else text + " end", "en", "s", len(text)) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    name = "c4_generated_cards"
    con = connect("/root/testdata/sf0.001")
    for t in ("documents", "labels"):
        con.sql(f"create or replace view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = rows_of(registry.QUERIES[name](spark, str(tmp_path)))
    assert len(got) == len(ids) and got == rows_of_sql(con, registry.ORACLE_SQL[name])[1]
