import pytest

from brackwater.operators.filters import Both, Doc, Either, FilterError, Meta, Not, Tag, compile_filter, parse, request_filter

ROWS = [(1, 10, [1], {"lang": "es", "n": "a b"}), (2, 10, [1, 2], {"lang": "en"}), (3, 11, [], {}), (4, 11, None, None), (5, None, [2], {"lang": "es"})]
IDS = {"red": 1, "blue": 2}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "chunk_id long, document_id long, tags array<long>, metadata map<string,string>")


@pytest.mark.parametrize("text,tree", [
    ("tag:a OR tag:b AND tag:c", Either(Tag("a"), Both(Tag("b"), Tag("c")))),
    ("(tag:a or tag:b) and NOT doc:+7", Both(Either(Tag("a"), Tag("b")), Not(Doc(7)))),
    ('META.Key:"two words"', Meta("Key", "two words")),
    ('ta"g:x y"z', Tag("x yz")),
    ("tag:", Tag("")),
    ("tag:a:b", Tag("a:b")),
    ("not not tag:a", Not(Not(Tag("a")))),
    ("tag:a(", None), ("", None), ("tag:a tag:b", None), ("tag", None), ("doc:x", None), ("doc:-1", None), ("meta.:x", None), ("who:x", None), ('tag:"a', None), ("NOT", None), ("tag:a AND", None), ('"and"', None), (")", None),
])
def test_parse(text, tree):
    if tree is None:
        with pytest.raises(FilterError):
            parse(text)
    else:
        assert parse(text) == tree


@pytest.mark.parametrize("text,ids", [
    ("tag:red", {1, 2}), ("tag:RED", set()), ("NOT tag:red", {3, 4, 5}), ("doc:10", {1, 2}), ("NOT doc:10", {3, 4, 5}), ("meta.lang:es", {1, 5}), ("meta.LANG:es", set()),
    ("NOT meta.lang:es", {2, 3, 4}), ('meta.n:"a b"', {1}), ("tag:red AND NOT tag:blue OR doc:11", {1, 3, 4}), ("NOT tag:unknown", {1, 2, 3, 4, 5}), ("doc:99999999999999999999999", None),
])
def test_rows(rows, text, ids):
    if ids is None:
        with pytest.raises(FilterError):
            compile_filter(text, IDS)
    else:
        assert {r.chunk_id for r in rows.where(compile_filter(text, IDS)).collect()} == ids


def test_requests(rows):
    def hit(**request):
        return {r.chunk_id for r in rows.where(request_filter(tag_ids=IDS, **request)).collect()}

    assert request_filter() is None
    assert hit(tags=["red", "blue"]) == {1, 2, 5}
    assert hit(tags=["red", "blue"], match_all=True) == {2}
    assert hit(tags=["red", "no"], match_all=True) == hit(tags=["no"]) == hit(subdomain_known=False) == set()
    assert hit(tags=["red", "no"]) == {1, 2}
    assert hit(document_ids=[11], filter_text="NOT tag:red") == {3, 4}
