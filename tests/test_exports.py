import importlib

import pytest


@pytest.mark.parametrize("name", ["functions", "operators", "sources", "streaming"])
def test_exports(name):
    module = importlib.import_module(f"zonalis.{name}")
    assert module.__all__ == sorted(module.__all__) and all(callable(getattr(module, x)) or x.isupper() for x in module.__all__)
