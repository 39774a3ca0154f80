"""Word lists used as defaults; every operator takes its own list as a parameter."""

# English words dropped from tokens.
ENGLISH_STOPWORDS = tuple(
    """
    the a an and or but in on at to for
    of with by from is was are were be been
    being have has had do does did will would
    could should may might shall can need must
    it its this that these those i you he she
    we they me him her us them my your his
    our their mine yours hers ours theirs
    what which who whom whose where when how why
    not no nor as if than too very just about
    also so then there here all each every both
    few more most other some such only own same
    into over after before between under again further
    once during while up down out off through
    """.split()
)

# Part-of-speech tags kept by default (common and proper nouns).
NOUN_TAGS = ("NNG", "NNP")
