"""Every document gives a text, markup or not."""

import hashlib

from millrace.plans.reference import QUERIES


def test_every_document_gives_a_row(spark, tmp_path):
    texts = [(1, "<b>a</b> &amp; b"), (2, "  plain \n\n text "), (3, ""), (4, None), (5, " ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    got = {r.doc_id: r.text_md5 for r in QUERIES["document_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: md5("a & b"), 2: md5("plain text"), 3: md5(""), 4: md5(""), 5: md5("")}
