import pytest

pytest.importorskip("plumage.llm")
