import pytest

from panelwright.llm import language
from tests.llm.helpers import SCHEMA

EN = "the quick brown fox jumps over the lazy dog and then the other one with that which was there"
DE = "der schnelle braune fuchs springt über den faulen hund und dann ist das andere nicht mehr da"


def model(spark):
    docs = [(i, (EN if i % 2 else DE), ("en" if i % 2 else "de"), "s", 1) for i in range(20)] + [(99, None, "en", "s", 1), (98, "?", None, "s", 1)]
    return language.fit(spark.createDataFrame(docs, SCHEMA))


def page(text, lang=None):
    return f"<html{f' lang={lang!r}' if lang else ''}><head><style>p{{}}</style><script>der die das</script></head><body><!-- der --><p>{text}</p></body></html>"


def test_parts_of_a_page():
    assert language.visible(b"a<b>b</b><!-- c --><script>d</script>&amp;e").split() == [b"a", b"b", b"&e"]
    assert language.declared(b'<HTML class="x" LANG="de-AT">') == "de" and language.declared(b"<html><p lang=en>") == ""
    assert language.declared(b'<meta http-equiv="content-language" content="fr">') == "fr"
    assert language.host_of("https://www.a.example.de:80/x?y") == ("a.example.de", "de")
    assert language.host_of("http://10.0.0.1/") == ("10.0.0.1", "") and language.host_of(None) == ("", "") and language.host_of("http://[") == ("", "")


def test_evidence_is_combined(spark):
    rows = [(i, f"http://a.example.de/{i}", page(DE, "de")) for i in range(30)]
    rows += [(100 + i, f"http://b.example.com/{i}", page(EN, "en")) for i in range(30)]
    rows += [(200, "http://a.example.de/x", page("", None)), (201, "http://c.example.de/x", page("", None)), (202, "http://b.example.com/x", page("", None))]
    rows += [(203, "http://b.example.com/y", page("", "de")), (204, "http://a.example.de/y", page(EN + " " + EN, "de")), (205, None, None), (205, None, None), (206, "", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, host int, ll string")
    got = {r.page_id: r for r in language.identify(df, model(spark)).collect()}
    assert {got[i].language for i in range(30)} == {"de"} and {got[100 + i].language for i in range(30)} == {"en"}
    assert (got[200].language, got[201].language, got[202].language) == ("de", "de", "en")  # host, suffix, host
    assert got[204].language == "en" and got[204].declared == "de"  # the text outweighs what surrounds it
    assert all(0 < r.probability <= 1 for r in got.values()) and got[200].probability > got[201].probability
    assert language.identify(df, model(spark)).count() == len(rows)


def test_posterior_by_hand(spark):
    import math

    rows = [(1, "http://h.x.de/", page(DE, "de")), (2, "http://h.x.de/2", page(EN, "en")), (3, "http://g.x.de/", page("", "de"))]
    m = model(spark)
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(rows, "page_id bigint, url string, html string"), m).collect()}
    lls = {i: m.log_likelihood(language.visible(h.encode())) for i, _, h in rows}
    post = {i: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v] for i, v in lls.items()}
    score = []
    for j in range(2):
        own = post[3][j]
        all_ = sum(p[j] for p in post.values())
        root = (all_ - own + 0.5) / (3 - 1 + 1)
        mid = (all_ - own + 5 * root) / (3 - 1 + 5)
        prior = (own - own + 5 * mid) / (1 - 1 + 5)
        said = (post[1][j] + post[3][j] - own + 1) / (all_ - own + 4)
        score.append(lls[3][j] - max(lls[3]) + math.log(said) + math.log(prior))
    best = max(range(2), key=lambda j: score[j])
    assert got[3].language == m.languages[best]
    assert abs(got[3].probability - 1 / sum(math.exp(s - score[best]) for s in score)) < 1e-5


def test_empty_tables(spark):
    m = model(spark)
    assert language.identify(spark.createDataFrame([], "page_id bigint, url string, html string"), m).count() == 0
    none = language.fit(spark.createDataFrame([], SCHEMA))
    got = language.identify(spark.createDataFrame([(1, "http://a.de", page(EN))], "page_id bigint, url string, html string"), none).collect()
    assert [r.language for r in got] == [None]


def test_declaration_after_long_markup():
    long = b"<html><head><!--" + b" x" * 50_000 + b"--><style>" + b"p{} " * 20_000 + b"</style>"
    assert language.declared(long + b'<meta http-equiv="content-language" content="fr"></head>') == "fr"
    assert language.declared(b"<!--" + b" x" * 50_000 + b"--><html class='a' lang='de'>") == "de"
    assert language.declared(b"<meta http-equiv=content-language content=fr><html lang=de>") == "de"
    assert language.declared(b"<meta " * 100_000) == "" and language.declared(b"<meta " + b"content-language " * 100_000) == ""


def test_every_language_is_kept(spark, monkeypatch):
    text = lambda k: " ".join(chr(97 + k % 26) + chr(97 + k // 26) + w for w in ("qua", "zol", "mi"))
    docs = [(i, text(k), f"l{k:03d}", "s", 1) for i, k in enumerate([*range(109), *range(109), 109])]
    m = language.fit(spark.createDataFrame(docs, SCHEMA))
    assert m.languages == [f"l{k:03d}" for k in range(110)]
    assert m.log_likelihood(text(109).encode()).argmax() == 109
    monkeypatch.setattr(language, "MAX_MODEL_BYTES", 8 * language.GRAMS * 109)
    with pytest.raises(ValueError, match="109 languages"):
        language.fit(spark.createDataFrame(docs, SCHEMA))
