import pytest

from perkolat.llm import neardup


@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    """The rounds of leaders change the work, not the groups: few of them, so that all that is left meets pair by pair."""
    monkeypatch.setattr(neardup, "LEADERS", 2)
