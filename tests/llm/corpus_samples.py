"""Small texts for the tests of this folder."""

from __future__ import annotations

import random

WORDS = "river stone cloud amber field quiet lantern garden silver morning copper winter meadow harbor thunder willow".split()


def prose(seed: int, words: int) -> str:
    """Distinct made-up sentences: a number is woven in, so that no long string repeats by chance."""
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(10**6)) if i % 4 == 0 else "") for i in range(words))


#: Rows that every operator must take: nulls, empty and blank texts, repeated rows, no letters, equal ids.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "...!?"), (5, prose(5, 300)), (5, prose(5, 300)), (5, prose(6, 80)), (None, prose(5, 300)), (None, None), (7, "é" * 400)]
