import pytest

from graphloom.operators import limits as L


def test_texts_and_names():
    assert L.name("é" * 512) == "é" * 512 and L.body("") == "" and L.texts([]) is None and L.texts(None) is None and L.texts(("a",)) == ["a"]
    for call, bad in ((L.name, ""), (L.name, 3), (L.name, "é" * 513), (L.body, None), (L.body, "x" * 65_537), (L.texts, "a"), (L.texts, ["a", 1]), (L.occurred, -1), (L.occurred, True)):
        with pytest.raises(ValueError):
            call(bad)


def test_limits():
    assert (L.search_limit(), L.search_limit(0), L.search_limit(5000), L.top_k(), L.top_k(500), L.depth(), L.depth(0), L.depth(99)) == (20, 1, 1000, 10, 100, 1, 0, 16)
    assert L.occurred(None) is None and L.occurred(0) == 0
    with pytest.raises(ValueError):
        L.items([0] * 1001)
    with pytest.raises(ValueError):
        L.vector([])
