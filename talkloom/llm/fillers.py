"""Filled pauses told from words by boosted trees over a token's letters.

A token counts by its shape: small letters, each run of one letter written once ("ummm" is
um, "uuh" is uh), so that drawn-out spellings need no list. The trees are fitted on shapes
that transcribers write, and judge every shape of at most MOST_LETTERS letters that known
filled pauses have; what has other letters or more of them is a word. These shapes are few,
so that the trees' verdicts are compiled into one regular expression, which runs in the
scan and agrees with the trees on every token.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import product

from .boost import Boosted

# Shapes of filled pauses, of English, German and French transcripts.
FILLED = "uh um uhm er erm eh ehm äh ähm öh öhm euh".split()
# Shapes of words and answers made of the same letters; "hm", "mm", "huh", "mhm" and "uhuh" are answers.
WORDS = """m u r e h ä ö eu hm mh mhm hmhm huh uhu uhuh uhum umhm humhm hum hume mum mume rum hem her here he heh hehe me meh mehr mere mer mem eme emu ere em ur uhr urm ume ruh ruhe rue
    hue hure hur hurh ure ehe ehre reh rem reme re ru rühre öhr öhre möhre möhr mähre ähre ähr röhre höre hör hö mö hä mäh är ör mär eur euer eure""".split()
MOST_LETTERS = 4
FEATURES = ["letters", "vowels", "opens_with_vowel", "runs", "h_at", "m_at", "r_at", "last_is_vowel", "first"]
VOWELS = "äöeaiouü"


def shape(token: str) -> str:
    """A token in small letters, with each run of one letter written once."""
    return re.sub(r"(.)\1+", r"\1", token.lower())


def features(token: str) -> list[float]:
    """What the trees look at: FEATURES of a token's shape; places are counted from 0, -1 for a letter that does not occur."""
    s = shape(token)
    vowel = [c in VOWELS for c in s]
    return [float(x) for x in (len(s), sum(vowel), vowel[0], 1 + sum(a != b for a, b in zip(vowel, vowel[1:])), s.find("h"), s.find("m"), s.find("r"), vowel[-1], VOWELS.find(s[0]))]


def fit(filled: list[str] = FILLED, words: list[str] = WORDS) -> Boosted:
    """Trees that tell filled pauses (score above 0) from words."""
    tokens = [*filled, *words]
    return Boosted(FEATURES, trees=15, depth=4, rate=0.6, least=1).fit([features(t) for t in tokens], [t in filled for t in tokens])


@cache
def filled_shapes() -> frozenset[str]:
    """All shapes that the trees take for filled pauses."""
    letters = sorted(set("".join(FILLED)))
    shapes = [s for n in range(1, MOST_LETTERS + 1) for s in map("".join, product(letters, repeat=n)) if s == shape(s)]
    return frozenset(s for s, score in zip(shapes, fit().predict([features(s) for s in shapes])) if score > 0)


def pattern(shapes: frozenset[str] | None = None) -> str:
    """A regular expression for exactly the tokens of these shapes (by default filled_shapes()), to be used blind to case.

    Shapes that begin alike share that beginning, so that few letters are tried at a word.
    """
    def branch(ends: set[str]) -> str:
        return "|".join(f"{first}+{rest({e[1:] for e in ends if e and e[0] == first})}" for first in sorted({e[0] for e in ends if e}))

    def rest(ends: set[str]) -> str:
        more = branch(ends)
        return f"(?:{more}){'?' if '' in ends else ''}" if more else ""

    return branch(set(filled_shapes() if shapes is None else shapes))
