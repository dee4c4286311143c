import pytest

from codequarry.config import ConfigError, config_from, expanded

BASE = {"store": {"url": "file:///tmp/x"}, "files": {"root": "/r"}}


def test_defaults():
    c = config_from(BASE)
    assert (c.chunking.max_tokens, c.chunking.overlap_tokens, c.embedding.provider, c.embedding.size, c.store.index) == (1000, 100, "local", 384, "code-chunks")
    assert c.files.include == ["src/**/*"]


def test_variables():
    env = {"A": "1", "E": ""}
    assert expanded({"x": ["${A}", "${B:-two}", "${E:-d}", "${C}"]}, env) == {"x": ["1", "two", "", ""]}


@pytest.mark.parametrize("change, path", [({"store": {"url": "no url"}}, "store.url"), ({"files": {}}, "files.root"), ({"embedding": {"provider": "x"}}, "embedding.provider"), ({"rag": {"provider": "x"}}, "rag.provider"), ({"chunking": {"max_tokens": 0}}, "chunking.max_tokens")])
def test_problems_are_named(change, path):
    with pytest.raises(ConfigError, match=path):
        config_from(BASE | change)
