import pytest


@pytest.fixture(scope="session")
def docs_small():
    """Nulls, empty, white space only, ties, repeats, one-word and long texts."""
    base = "the quick brown fox jumps over the lazy dog while seven grey geese watch from a wall near the old mill"
    return [
        (1, base, "en", "a", 10), (2, base, "en", "b", 10), (3, None, "en", None, None), (4, "", None, "a", 0), (5, " \n\t ", "de", "b", 4),
        (6, "Wort", "de", "c", 4), (7, "a\nb\na\n\n a", "en", "c", 9), (8, base.upper() + " ends here", "en", "a", 1), (9, base + " and one", "en", "a", 1),
        (10, ("x " * 5000) + "é ü\x0bz", "fr", "hot", 1), (11, "éa éb éc éa éb éc\nq", "fr", "hot", 1), (11, "éa éb éc éa éb éc\nq", "fr", "hot", 1), (None, "no id here # $ |", "en", "hot", 1),
    ]
