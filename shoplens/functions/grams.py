"""Which words of a long list a text contains, by an index of character grams.

Every word of the list is filed under one of its grams, the one that fewest other words
share; grams have six characters, those of shorter words three. The grams of a text name
the few words that it may contain, and only these are looked for. So a text costs its
length and its candidates, whatever the length of the list. All of it is expressions on
the row: the index is literal arrays, read at the place that a gram's CRC-32 gives.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAMS = (6, 3)  # characters, longest first
FEW = 300  # up to so many words of a length are looked for one by one, which costs less than the grams (measured: equal at about 300)
_SEPARATOR = "\x00"


def _numbers(values: Sequence[int]) -> Column:
    """One literal; as many literals as values would slow down planning."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>") if values else F.array().cast("array<int>")


def _candidates(text: Column, words: Sequence[str], places: Sequence[int], size: int) -> Column:
    """Places of the words, out of those at ``places``, whose chosen gram of ``size`` characters the text holds."""
    grams = {i: [words[i][at : at + size] for at in range(len(words[i]) - size + 1)] for i in places}
    shared = Counter(g for own in grams.values() for g in set(own))
    buckets = 8 * len(places) + 1
    filed = sorted((zlib.crc32(min(own, key=lambda g: (shared[g], g)).encode()) % buckets, i) for i, own in grams.items())
    sizes = Counter(b for b, _ in filed)
    begins = [0]
    for b in range(buckets):
        begins.append(begins[-1] + sizes[b])
    starts, members = _numbers(begins), _numbers([i for _, i in filed])
    held = _numbers([int(sizes[b] > 0) for b in range(buckets)])

    def bucket(gram: Column) -> Column:
        return (F.crc32(gram) % buckets).cast("int")

    # An empty match before every character, which captures the gram that begins there.
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    known = F.array_distinct(F.transform(F.filter(found, lambda g: F.get(held, bucket(g)) == 1), bucket))
    return F.flatten(F.transform(known, lambda b: F.slice(members, F.get(starts, b) + 1, F.get(starts, b + 1) - F.get(starts, b))))


def contained(text: Column, words: Sequence[str]) -> Column:
    """Ascending places, in the list of distinct ``words``, of those that ``text`` contains; NULL for NULL."""
    if any(_SEPARATOR in w for w in words):
        raise ValueError("words with a NUL character are not supported")
    listed = F.split(F.lit(_SEPARATOR.join(words)), _SEPARATOR) if words else F.array().cast("array<string>")
    parts, left = [], list(range(len(words)))
    for size in GRAMS:
        # A regular expression counts characters beyond the basic plane otherwise than Python does.
        own = [i for i in left if len(words[i]) >= size and max(words[i]) <= "￿"]
        if len(own) > FEW:
            parts.append(_candidates(text, words, own, size))
            left = sorted(set(left) - set(own))
    places = F.concat(_numbers(left), *parts)
    return F.when(text.isNotNull(), F.array_sort(F.filter(places, lambda w: F.contains(text, F.get(listed, w)))))
