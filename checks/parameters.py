"""Word lists of the checked queries, shared by both sides."""

from itertools import product

# Syllables of the test texts, whose words are chains of them.
SYLLABLES = ("th", "er", "in", "on", "an", "re", "nd", "ed", "ti", "es", "or", "st", "at", "he", "ha", "ou")
PAIRS = tuple("".join(x) for x in product(SYLLABLES, repeat=2))
RARE = tuple("".join(x) for x in product(SYLLABLES, repeat=3))[::17]


def scored(words: tuple[str, ...]) -> tuple[tuple[str, int], ...]:
    """Scores 2, 1, -1, -2 in turn."""
    return tuple((word, (2, 1, -1, -2)[i % 4]) for i, word in enumerate(words))


TAXONOMY = (
    ("risk", ("threat", "evil")),
    ("value", ("free", "best")),
    ("tone", ("hate", "sad", "honor")),
    *((f"theme_{i}", RARE[i::4]) for i in range(4)),
)
LEXICON = (
    ("best", 2), ("honor", 1), ("free", 1), ("great", 1),
    ("threat", -1), ("sad", -1), ("hate", -2), ("evil", -2),
    *scored(RARE),
)
TOKEN_LEXICON = tuple({**dict(scored(PAIRS)), "best": 2, "thing": 1, "rest": 1, "threat": -1, "then": -1, "hand": -2}.items())
EXTRA_STOPWORDS = ("les", "und", "que")
TURNS = 3
# Letters for which others are put, to have texts in other scripts.
LATIN = "etaoinsr"
CHINESE = "的一是不了人我在"
JAPANESE = "のにはをたがデ一"
