"""Texts in Python: a few at a time, whatever a batch holds."""

import pyarrow as pa

from citeloom.operators import anchors as A


def test_pieces_of_a_batch():
    n = 3 * A.AT_ONCE + 1
    pieces = list(A.in_pieces(iter([pa.RecordBatch.from_arrays([pa.array(range(n))], ["k"]), pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["k"])])))
    assert [x for p in pieces for x in p.column(0).to_pylist()] == list(range(n)) and max(p.num_rows for p in pieces) <= A.AT_ONCE


def test_texts_over_several_pieces(spark):
    n = 2 * A.AT_ONCE + 5
    rows = [(i, None if i == 7 else f" [3] Él{i} is. Ⅳ it" + "!" * (i % 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = sorted((r.doc_id, r.pos, r.sentence) for r in A.sentences(df).collect())
    assert found == sorted((i, p, s) for i, t in rows if t for p, s in ((0, f"[3] Él{i} is."), (1, "Ⅳ it" + "!" * (i % 2))))
    forms = {r.doc_id: (r.ascii_form, r.biblio_form) for r in A.normal_forms(df, "doc_id", "text").collect()}
    assert forms == {i: (A.ascii_form(t), A.biblio_form(t)) for i, t in rows} and len(forms) == n
