"""Texts for tests."""

WORDS = "the of and river stone light garden winter answer bridge copper market window silver forest".split()


def prose(i: int, n: int = 60) -> str:
    """A text of n words that differs from number to number."""
    return " ".join(f"{WORDS[(i * 7 + j * j) % len(WORDS)]}{(i * 31 + j * 17) % 97}" for j in range(n)) + "."
