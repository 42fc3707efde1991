"""Golden cases of the scalar functions."""

import math

import pytest

from factloom.functions import htmlx, jsonx, stats, text, urls


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', '{"a":NaN}', "[1e999]", "[-Infinity]", "{"])
def test_strict_json_refuses(bad):
    with pytest.raises(ValueError):
        jsonx.loads(bad)


def test_canonical_text_and_slots():
    assert jsonx.canonical({"b": None, "a": ["ø", 1.0]}) == '{"a":["ø",1.0],"b":null}'
    assert jsonx.slot_id("1", "f", "s") == jsonx.digest('["1","f","s",null,null]'.encode())


def test_claim_id_column_is_the_slot_id(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([('a"b', "f", "s", None), ("ø\\", "f", "s", "k")], "a string, f string, s string, k string")
    got = rows.select(jsonx.claim_id(F.col("a"), F.col("f"), F.col("s"), F.col("k")).alias("x")).collect()
    assert [r.x for r in got] == [jsonx.slot_id('a"b', "f", "s"), jsonx.slot_id("ø\\", "f", "s", "k")]


def test_spans_are_exact_source_text():
    source = ' { "a" : [ 1.0 , {"k": "\\u00c5x"} ] , "b":2 } '
    cut = lambda path: source[slice(*jsonx.span(source, path))]
    assert cut(["a", 0]) == "1.0" and cut(["a", 1, "k"]) == '"\\u00c5x"' and cut(["b"]) == "2" and jsonx.span(source, ["c"]) is None and jsonx.span(source, ["a", "0"]) is None
    assert source[slice(*jsonx.value_span(source, "a"))] == '[ 1.0 , {"k": "\\u00c5x"} ]'


@pytest.mark.parametrize("said, number", [("Org.nr 923 609 016", "923609016"), ("Organisasjonsnummer: 923.609.016", "923609016"), ("ORG.NR. NO923609016 MVA", "923609016"), ("organization number 923609016", "923609016"), ("Phone 923609016", ""), ("Org.nr 9236090165", "")])
def test_org_numbers(spark, said, number):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(said,)], "t string").select(F.concat_ws(",", text.org_numbers(F.col("t"))).alias("n")).first().n == number


@pytest.mark.parametrize("body, name, found", [("Bø AS leverer", "bø as", True), ("Bøas", "bø", False), ("a.b", "a.b", True), ("axb", "a.b", False), ("x", "", False), ("ÅPNET", "åpnet", True), ("q\\Eq", "q\\Eq", True)])
def test_names(spark, body, name, found):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(body, name)], "t string, n string").select(text.names(F.col("t"), F.col("n")).alias("x")).first().x is found


def test_two_sentence_splits_agree(spark):
    from pyspark.sql import functions as F

    said = ["One two. Three four! Five? Six", "kunder som Bertel O. Steen og Eplehuset. Ny setning.", "Se f.eks. Oslo. Og mer", "a. b. C", "", "Nr. 5 er best. 6 er god."]
    got = spark.createDataFrame([(s,) for s in said], "t string").select(text.sentences(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [text.split_sentences(s) for s in said]
    assert text.split_sentences(said[1]) == ["kunder som Bertel O. Steen og Eplehuset.", "Ny setning."]


def test_stems():
    assert text.name_stem("Fjordheim Bygg AS") == "fjordheimbygg" and text.ascii_fold("Ærlig Øl på Café") == "aerlig ol pa cafe" and text.email_domain(" post@Firma.NO ") == "firma.no" and text.email_domain("a@b@c.no") is None


@pytest.mark.parametrize("url, want", [("https://a.no", "https://a.no/"), ("https://A.no:443/x?y#z", "https://a.no/x?y"), ("http://a.no", None), ("https://u:p@a.no", None), ("https://a.no:8443", None), ("https://a.no./", None), ("https://bø.no/", "https://xn--b-5ga.no/"), ("https://a.no/ x", None), (None, None)])
def test_safe_url(url, want):
    assert urls.safe_url(url) == want


@pytest.mark.parametrize("link, want", [
    ("https://nb-no.facebook.com/FjordheimBygg/about", "https://facebook.com/FjordheimBygg"), ("//www.facebook.com/FjordheimBygg", "https://facebook.com/FjordheimBygg"),
    ("https://no.linkedin.com/company/Fjordheim-Bygg-AS/admin/feed?trk=x", "https://linkedin.com/company/Fjordheim-Bygg-AS"), ("https://twitter.com/FjordheimBygg", "https://x.com/FjordheimBygg"),
    ("https://linkedin.com/company/Bj%C3%B8rn-Bygg-AS", "https://linkedin.com/company/Bjørn-Bygg-AS"), ("https://facebook.com/sharer/sharer.php?u=x", None), ("https://facebook.com/people/Navn/1000", "https://facebook.com/people/Navn/1000"),
    ("https://instagram.com/p/abc", None), ("https://www.youtube.com/@kanal", "https://youtube.com/@kanal"), ("https://x.com/i/status", None), ("https://linkedin.com/in/person", None), ("https://facebook.com.evil.no/x", None), ("https://example.no/x", None),
])
def test_social_profiles(link, want):
    assert (urls.profile(link) or (None,))[0] == want


@pytest.mark.parametrize("name, handle, score", [("Fjordheim Bygg AS", "FjordheimBygg", 0.98), ("Fjordheim Bygg AS", "fjordheim", 0.95), ("Falck Norge AS", "falck", 0.0), ("Nordpump AS", "nordpumpgroup", 0.0), ("Norsk Bygg AS", "norskbygg", 0.98), ("Norsk Bygg AS", "norskbyggoslo", 0.0), ("Narvikgården AS", "narvikgaarden", 0.98)])
def test_handle_scores(name, handle, score):
    assert urls.handle_score(name, handle) == score


def test_domains():
    assert urls.registrable("www.a.b.no") == "b.no" and urls.registrable("x.co.uk") == "x.co.uk" and urls.registrable("co.uk") is None and urls.registrable("no") is None
    assert urls.same_site("mail.a.no", "www.a.no") and not urls.same_site("a.no", "b.no")
    assert urls.page_key("https://www.a.no/om-oss/#team") == urls.page_key("https://a.no/om-oss")


def test_visible_text_and_regions():
    page = "<p>a</p><p>b<b>c</b></p><span hidden>x</span><script>y</script><!-- z --> d&nbsp;e"
    assert htmlx.visible_text(page) == "a bc d e"
    found = htmlx.regions("<div><p>æ one</p>\n<footer>Two <i>x</i></footer><blockquote><p>q</p></blockquote><p>open")
    assert [(n["tag"], n["text"]) for n in found if n["tag"] in htmlx.BLOCKS] == [("p", "æ one"), ("footer", "Two x")]
    source = "<div>\n<p>æ one</p></div>"
    node = htmlx.regions(source)[0]
    assert source[node["start"] : node["end"]] == "<p>æ one</p>"


def test_exact_statistics():
    assert stats.mcnemar(5, 0) == 0.0625 and stats.mcnemar(0, 0) == 1 and stats.mcnemar(5, 5) == 1
    low, high = stats.clopper_pearson(0, 10)
    assert low == 0 and math.isclose(high, 1 - 0.025**0.1, abs_tol=1e-12)
    low, high = stats.clopper_pearson(10, 10)
    assert high == 1 and math.isclose(low, 0.025**0.1, abs_tol=1e-12)
