from pyspark.sql import functions as F

from clinicweave.functions import text, vocab


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_flatten_json_list(spark):
    rows = {'["a","b"]': "a b", "[]": "", "plain": "plain", "[not json": "[not json", '["x",null,""]': "x null", "[1,true]": "1 true", " spaced ": "spaced", None: ""}
    for value, want in rows.items():
        assert one(spark, value, text.flatten_json_list) == want


def test_camel_and_tags(spark):
    assert one(spark, "pediatricsAndCTScan", text.split_camel) == "pediatrics And CT Scan"
    assert one(spark, "ICUs", text.split_camel) == "IC Us"
    assert one(spark, "generalSurgery and icu", lambda c: text.tags(c, vocab.SPECIALTIES)) == ["general_surgery", "icu"]
    assert one(spark, None, lambda c: text.tags(c, vocab.SPECIALTIES)) == []
    assert one(spark, "prevention", lambda c: text.tags(c, vocab.EQUIPMENT)) == []


def test_states_and_pins(spark):
    assert one(spark, " UP ", text.normal_state) == "uttar pradesh"
    assert one(spark, "Ambernath", text.normal_state) == "ambernath"
    assert one(spark, "  ", text.normal_state) is None
    assert one(spark, "800001.0", text.clean_pin) == "800001"


def test_sentences_and_quotes(spark):
    found = one(spark, "First one. No.\nSecond line here| - third part", text.sentences)
    assert found == ["First one.", "Second line here", "third part"]
    quote = lambda c: text.shortest_with(text.sentences(c), text.strings(["part", "one"]))
    assert one(spark, "A part here. B part here. part longer than those", quote) == "A part here."
    assert one(spark, "x" * 300, text.shorten) == "x" * 239 + "..."


def test_tokens(spark):
    assert one(spark, "The X-ray, of THE heart; heart", text.tokens) == ["x", "ray", "heart", "heart"]
    assert one(spark, None, text.tokens) == []
