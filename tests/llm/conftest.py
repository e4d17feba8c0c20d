import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="session")
def vocabulary():
    from tracelake.llm.queries import vocabulary
    return vocabulary()
