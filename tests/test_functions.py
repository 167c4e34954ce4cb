import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.functions import answers as A
from corvane.functions import text as T
from corvane.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    assert one(spark, V.dot(arr(1, 2, 3), arr(4, 5, 6))) == 32
    assert one(spark, V.euclidean_distance(arr(0, 0), arr(3, 4))) == 5
    assert one(spark, V.cosine_similarity(arr(1, 0, 0), arr(0.5, 0.5, 0))) == pytest.approx(0.707107, abs=1e-6)
    assert one(spark, V.normalize(arr(3, 4))) == [0.6, 0.8]
    assert one(spark, V.normalize(arr(0, 0))) == [0, 0]
    assert one(spark, V.cosine_similarity(arr(0, 0), arr(1, 0), strict=False)) is None
    with pytest.raises(Exception, match="zero vector"):
        one(spark, V.cosine_similarity(arr(0, 0), arr(1, 0)))
    with pytest.raises(Exception, match="dimension"):
        one(spark, V.checked_vector(arr(1, 2), 3))
    with pytest.raises(ValueError):
        V.check_metric("manhattan")


@pytest.mark.parametrize("text", ["", "  a  b ", "a  b\x1cc\x85d", "\n\t", "één  twee"])
def test_normalize_like_python(spark, text):
    assert one(spark, T.normalize_text(F.lit(text))) == " ".join(text.split())


def test_ids_and_formats(spark):
    digest = hashlib.md5(b"Hello world").hexdigest()[:7]
    assert one(spark, T.chunk_id(F.lit("doc1"), F.lit(0), F.lit("Hello world"))) == f"doc1_chunk_0_{digest}" == "doc1_chunk_0_3e25960"
    assert one(spark, T.document_id(F.lit("/x y/My file.txt"))) == "My_file.txt"
    assert one(spark, T.detect_format(F.lit("/a/b.MarkDown"))) == "markdown"
    assert one(spark, T.detect_format(F.lit("/a/b.xyz"))) is None
    with pytest.raises(Exception, match="unsupported"):
        one(spark, T.detect_format(F.lit("/a/b.xyz"), strict=True))


def test_markdown(spark):
    text = "# T\n\nsome **bold** and *it* and ~~old~~ `code` [a](http://b)\n\n![pic](u)\n* x\n2. y\n> q\n\n| a | b |\n|---|---|\n| 1 | 2 |\n```py\nz = [1](2)\n```\n"
    assert one(spark, T.markdown_to_text(F.lit(text))) == "# T some bold and it and old code a pic x y q a b 1 2 [CODE] z = [1](2) [/CODE]"
    assert one(spark, T.markdown_to_text(F.lit("## T\n[a](b)\n```\nx\n```"), False, False, True)) == "T a (b)"
    assert one(spark, T.html_to_text(F.lit("<p>a&amp;b<script>x</script></p> <b>c</b>"))) == "a&b c"


def test_answers(spark):
    assert sorted(one(spark, A.citations(F.lit("A [1] b [2] c [1]")))) == [1, 2]
    assert one(spark, A.citations(F.lit(None).cast("string"))) == []
    assert one(spark, A.invalid_citations(F.lit("[1] [99]"), F.lit(3))) == [99]
    rows = spark.createDataFrame([(0.95,), (0.88,), (0.82,)], "score double")
    assert rows.agg(A.confidence_aggregate().alias("c")).first()["c"] == pytest.approx(0.851459, abs=1e-6)
    assert rows.limit(0).agg(A.confidence_aggregate().alias("c")).first()["c"] == 0
    assert [one(spark, A.confidence_level(F.lit(x))) for x in (0.49, 0.5, 0.75)] == ["Low", "Medium", "High"]
    assert "2 sources" in one(spark, A.confidence_explanation(F.lit(0.8), F.lit(2)))
