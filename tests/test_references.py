import pyarrow as pa

from chronolake.functions import text as X


def test_references_without_a_semicolon(spark):
    """Cut-off references are text where only whole ones are decoded; by default they are read as browsers read them."""
    raw = "<p>a&amp b &am c &amp; d &copy;&quo &#65; &#x42; &ampx; &nothing; &lt</p><script>x&amp</script>&"
    assert X.filing_text(raw, bare=False) == "a&amp b &am c & d ©&quo A B &ampx; &nothing; &lt\n &"
    assert X.filing_text("a&amp b") == "a& b"
    got = spark.createDataFrame([("<b>x&amp y</b>",), (None,)], "html string").select(X.strip_html("html", bare=False).alias("t")).collect()
    assert [r.t for r in got] == ["x&amp y", None]


def test_normal_texts_are_passed_on():
    """Normal texts aren't copied; a batch with others is right in all its parts."""
    normal, mixed = pa.array(["é", None, "a"] * 300), pa.array(["ﬁ", None, "é"] + ["x"] * 300 + ["é"])
    assert X.nfkc.func(normal) is normal
    assert X.nfkc.func(mixed).to_pylist() == ["fi", None, "é"] + ["x"] * 300 + ["é"]
