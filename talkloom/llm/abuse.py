"""Scoring documents for abusive, hateful or sexual content.

Words are looked up by Levenshtein automata intersected with the lexicon's trie, after
undoing common disguises (letters of other scripts, digits for letters, masking stars,
stretched, hyphenated or spaced-out words). What is found is scored in its context by the
cues of lexicon.py: an insult counts by whom it is aimed at, a word for vermin by whom it
names, a profanity on its own or a quoted insult hardly.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import spread
from . import lexicon as L
from .tokenizer import load_definition

LOOKALIKES = str.maketrans("авеёзіјкмнопрстухѕԁɡһαεικνορτυχ", "abeezijkmhonpctyxsdghaeiknoptux")
LEET = str.maketrans("013457@$!8", "oieastasib")
INVISIBLE = re.compile("[" + "".join(map(chr, [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, 0x34F])) + "]")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_\-]){2,}[^\W\d_](?![^\W_])")
#: Cheaper than SPACED, and found in every text in which that is.
MAYBE_SPACED = re.compile(r"[ .*_\-][^\W\d_][ .*_\-][^\W\d_](?![^\W_])")
TOKEN = re.compile(r"18\+|[\w@$](?:(?:[\w@$*'’\-]|!(?=\w))*[\w$*])?|[.!?\n|:;\"“”«»„]|[぀-ヿ一-鿿]+")
# Which marks close what a mark opens.
CLOSING = {'"': '"', "“": "”", "„": "“”", "”": "”", "«": "»", "»": "«"}
STRETCHED = re.compile(r"(.)\1{2,}")
#: Letters: the longest quotation, the shortest line that may be wrapped. Words: the window of sexual words, and how far from a quotation it may be spoken of.
QUOTED, WRAPPED, LEWD_WINDOW, SPOKEN_WINDOW = 400, 40, 14, 15
#: How much of a find counts that stands in quotation marks and is spoken of.
REPORTED = 0.3
#: Classes that make a case without more words; they take edits only in words of ALONE_LETTERS or more.
ALONE, ALONE_LETTERS = {"foreign", "kys"}, 6


class LexiconAutomaton:
    """Levenshtein automata of the lexicon's words, run side by side along their trie and made deterministic as they are used.

    A state is the set of places that a word's letters so far can lead to: a node of the
    trie with the least edits needed, or between two swapped letters. An edit is a letter
    too much, missing or wrong, or two neighbours swapped; "*" in a word stands for any
    letter. Arcs are worked out when a letter is first read in a state, and kept; a state
    without places ends the walk. `most`: the most edits of any word.
    """

    KEPT = 100_000

    def __init__(self, words: dict[str, str], most: int, rank: dict[str, int]):
        self.most, self.rank = most, rank
        self.child: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for w in words:
            node = 0
            for c in w:
                nxt = self.child[node].get(c)
                if nxt is None:
                    nxt = self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.word.append(None)
                node = nxt
            self.word[node] = w
        self.words = words
        self.start = self._closed({(0, ""): 0})
        self.arcs: dict[tuple, dict[str, tuple | None]] = {}
        self.ends: dict[tuple, tuple] = {}

    def _closed(self, places: dict[tuple[int, str], int]) -> tuple | None:
        """The state of some places and of those that missing letters lead to."""
        todo = [p for p in places if not p[1]]
        while todo:
            p = todo.pop()
            e = places[p] + 1
            if e <= self.most:
                for n in self.child[p[0]].values():
                    if places.get((n, ""), 9) > e:
                        places[(n, "")] = e
                        todo.append((n, ""))
        return tuple(sorted((n, s, e) for (n, s), e in places.items())) or None

    def _arc(self, state: tuple, c: str) -> tuple | None:
        out: dict[tuple[int, str], int] = {}

        def put(node: int, swapped: str, e: int) -> None:
            if e <= self.most and out.get((node, swapped), 9) > e:
                out[(node, swapped)] = e

        for node, swapped, e in state:
            nexts = self.child[node]
            if swapped:  # read y of "yx" for "xy": now x must come, and y after it in the trie
                for x, n in nexts.items():
                    if c in (x, "*") and swapped in self.child[n]:
                        put(self.child[n][swapped], "", e)
                continue
            put(node, "", e + 1)
            for x, n in nexts.items():
                put(n, "", e + (c != x and c != "*"))
                if c != x and c in self.child[n]:
                    put(node, c, e + 1)
        return self._closed(out)

    def find(self, word: str) -> Iterable[tuple[int, int, str, str]]:
        """(edits, rank of the class, lexicon word, class) of the words within `most` edits, the nearest first."""
        state: tuple | None = self.start
        for c in word:
            arcs = self.arcs.get(state)
            if arcs is None:
                if len(self.arcs) >= self.KEPT:
                    self.arcs.clear()
                    self.ends.clear()
                arcs = self.arcs[state] = {}
            if c not in arcs:
                arcs[c] = self._arc(state, c)
            state = arcs[c]
            if state is None:
                return ()
        if state not in self.ends:
            self.ends[state] = tuple(sorted((e, self.rank[self.words[self.word[n]]], self.word[n], self.words[self.word[n]]) for n, s, e in state if not s and self.word[n]))
        return self.ends[state]


def fold(word: str) -> str:
    """Small letters without accents; the voicing marks of Japanese stay, as they tell letters apart."""
    if word.isascii():
        return word.lower()
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word.lower()) if c in "゙゚" or not unicodedata.combining(c)))


class Cue:
    """One cue of lexicon.py as a pattern over a clause " word word ", with the words that any match needs."""

    _COMMON = set("you u a an the are is were was re all to and they them those these that this he she it i we your their my our in on of no be not would will should must so just with for up one go what like put me back how where set home near old out such".split())

    def __init__(self, kind: str, weight: float, cue: str, unless: str = ""):
        self.kind, self.weight = kind, weight
        self.unless = {w.replace("_", " ") for w in unless.split()}
        out, self.literals, self.needed = [], set(), []
        for slot in cue.split(" "):
            if slot[0] == "~":
                out.append(rf"(?:[^. ]+ ){{0,{slot[1:]}}}?")
                continue
            tail = slot[-1] if slot[-1] in "?*" else ""
            words = self._words(slot[: len(slot) - len(tail)])
            self.literals |= {x for w in words for x in w.split("_")}
            out.append(f"(?:{'|'.join(map(self._pattern, words))}){tail}")
            if not tail:
                self.needed.append({min(w.split("_"), key=self._usual) for w in words})
        self.pattern = re.compile("(?<= )" + "".join(out))
        #: Words one of which any match needs: of the slot with the rarest.
        self.anchors = min(self.needed, key=lambda ws: (max(map(self._usual, ws)), len(ws)))
        self.whole = [ws for ws in self.needed if not any(w.endswith("%") for w in ws)]

    @classmethod
    def _usual(cls, word: str) -> int:
        return 3 if word == "#unk" or word in cls._COMMON else 0 if word[0] == "#" else 2 if word.endswith("%") else 1

    @staticmethod
    def _words(slot: str) -> list[str]:
        """The alternatives of a slot, with the names of SLOTS written out."""
        out: list[str] = []
        for w in slot.split("|"):
            out += Cue._words(L.SLOTS[w[1:]]) if w[0] == "@" else [w]
        return list(dict.fromkeys(out))

    @staticmethod
    def _pattern(word: str) -> str:
        return "".join(re.escape(w[:-1]) + r"\S* " if w.endswith("%") else re.escape(w) + " " for w in word.split("_"))

    def finds(self, clause: str, words: set[str]) -> Iterable[tuple[int, int]]:
        """(first letter, letter after the last) of the matches in a clause of these words."""
        if not any(map(words.isdisjoint, self.whole)):
            for m in self.pattern.finditer(clause):
                if self.unless.isdisjoint(_last_words(clause, m.start())):
                    yield m.start(), m.end()


def _last_words(clause: str, end: int) -> set[str]:
    """The last word before a place of a clause, and the last two."""
    one = clause.rfind(" ", 0, max(0, end - 1)) + 1
    two = clause.rfind(" ", 0, max(0, one - 1)) + 1
    return {clause[one : end - 1], clause[two : end - 1]}


class _Index(dict):
    """Word -> the cues that need it; those that need a word's beginning are kept by that."""

    def __init__(self, cues: list[Cue]):
        super().__init__()
        self.starts: dict[str, list[Cue]] = {}
        for cue in cues:
            for w in cue.anchors:
                (self.starts if w.endswith("%") else self).setdefault(w.rstrip("%"), []).append(cue)

    def of(self, word: str) -> tuple[Cue, ...]:
        return (*self.get(word, ()), *(c for s, cs in self.starts.items() if word.startswith(s) for c in cs))


CUES = [Cue(kind, weight, c, unless) for kind, weight, cs, unless in L.CUES for c in cs]
#: Over words as written, not over canonical ones.
FOREIGN_CUES = [Cue("insult", 0.9, c) for c in L.FOREIGN_CUES]
LITERALS = {w for cue in CUES for w in cue.literals}
RUNS = re.compile("|".join(L.FOREIGN_RUNS))
SPOKEN_OF = set(L.SPOKEN_OF.split())
NOT_CURSES = tuple("kanker" + w for w in L.KANKER_MEDICAL.split())


class Word(NamedTuple):
    """A token as it is scored."""

    tag: str  # "#" and its class, "#unk" for a word nobody knows, "." where a clause ends, '"' for a quotation mark, or else the folded token
    plain: str  # the folded token
    cues: tuple[Cue, ...]  # cues that need the tag
    foreign: tuple[Cue, ...]  # cues that need the folded token


def everyday_words(vocabulary: Iterable[str]) -> frozenset[str]:
    """The words in small letters that a byte-level vocabulary holds in one piece: words so usual are no misspelling and no unknown name."""
    return frozenset(p[1:] for p in vocabulary if p[0] == "Ġ" and len(p) > 3 and p[1:].isascii() and p[1:].isalpha() and p[1:].islower())


class Scorer:
    """Scores single texts; remembers what it has worked out per word.

    everyday: words that are taken as they are (by default those of a public vocabulary).
    """

    def __init__(self, everyday: Iterable[str] | None = None, words: dict[str, str] | None = None, remembered: int = 200_000):
        self.words = words or L.forms()
        self.everyday = frozenset(everyday if everyday is not None else everyday_words(load_definition()["vocab"])) - self.words.keys()
        rank = {c: i for i, c in enumerate(L.CLASSES)}
        edited = {w: c for w, c in self.words.items() if len(w) >= (ALONE_LETTERS if c in ALONE else 4) and "-" not in w}
        self.exact = LexiconAutomaton(self.words, 0, rank)
        self.near = LexiconAutomaton(edited, 1, rank)
        self.far = LexiconAutomaton({w: c for w, c in edited.items() if len(w) >= 9}, 2, rank)
        self.index, self.foreign = _Index(CUES), _Index(FOREIGN_CUES)
        self.seen: dict[str, tuple[tuple[Word, ...], bool]] = {}
        self.remembered = remembered

    def is_everyday(self, word: str) -> bool:
        """Whether a word, its base form or its two parts are everyday words."""
        v = self.everyday
        if word in v or word in LITERALS:
            return True
        for end in ("s", "es", "ed", "d", "ing", "ly", "er", "y", "ies", "'s"):
            stem = word[: -len(end)]
            if word.endswith(end) and len(stem) > 2 and (stem in v or stem + "e" in v or stem + "y" in v or (stem[-1] == stem[-2] and stem[:-1] in v)):
                return True
        return any(word[:k] in v and word[k:] in v and max(k, len(word) - k) > 3 for k in range(3, len(word) - 2))

    def words_of(self, run: str) -> tuple[tuple[Word, ...], bool]:
        """The words of a run of letters and marks without blanks, and whether any of them may take part in a find."""
        words = tuple(map(self.word, TOKEN.findall(run)))
        got = words, any(w.cues or w.foreign or w.tag in L.LEWD_WORTH for w in words)
        if len(self.seen) >= self.remembered:
            self.seen.clear()
        self.seen[run] = got
        return got

    def word(self, token: str) -> Word:
        if token in ".!?|;:":
            return Word(".", ".", (), ())
        if token in CLOSING:
            return Word('"', token, (), ())
        tag, plain = self._canonical(token)
        return Word(tag, plain, self.index.of(tag), () if plain.startswith(NOT_CURSES) else self.foreign.of(plain))

    def _canonical(self, token: str) -> tuple[str, str]:
        word = fold(token).replace("’", "'")
        if not word.isascii() and any("a" <= c <= "z" for c in word):
            word = word.translate(LOOKALIKES)
        letters = sum(c.isalpha() for c in word)
        if not letters or len(word) < 3:
            return word, word
        if word in self.words:
            return "#" + self.words[word], word
        tries = [word]
        if "-" in word:
            tries.append(word.replace("-", ""))
        if letters < len(word) and any(c in "0134578@$!" for c in word):
            tries += [t.translate(LEET) for t in tries] + [t.replace("1", "l").translate(LEET) for t in tries]
        tries += [r for t in tries if STRETCHED.search(t) for r in (STRETCHED.sub(r"\1\1", t), STRETCHED.sub(r"\1", t))]
        for t in tries[1:]:
            if t in self.words:
                return "#" + self.words[t], word
        if "*" in word and letters > 1 and (found := self.exact.find(word)):
            return "#" + found[0][3], word
        if any(self.is_everyday(t) for t in (*tries, word.split("@")[0])):
            return word, word
        for t in tries:
            if hit := self.misspelt(t):
                return "#" + hit, word
        return ("#unk" if len(word) > 3 and word.isascii() and word.isalpha() else word), word

    def misspelt(self, word: str) -> str | None:
        """The class of the lexicon word that a word misspells: by one edit in lexicon words from 4 letters on, by two from 9 on; None for everyday words."""
        if len(word) < 4 or not (word.isalpha() and word.isascii()):
            return None
        found = self.near.find(word) or self.far.find(word)
        return found[0][3] if found else None

    def joined(self, letters: str) -> str:
        """Spaced-out letters as one word, or as two where they are an article or a lexicon word and a lexicon word."""
        word = fold(letters).translate(LOOKALIKES)
        if word in self.words:
            return letters
        for k in range(1, len(word)):
            if word[k:] in self.words and (word[:k] in ("a", "i", "u") or word[:k] in self.words):
                return letters[:k] + " " + letters[k:]
        return letters

    def lines(self, text: str) -> Iterable[tuple[str, list[Word]]]:
        """The lines in which anything may be found, and their words."""
        if not text.isascii():
            text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
        if MAYBE_SPACED.search(text):
            text = SPACED.sub(lambda m: self.joined(re.sub(r"[ .*_\-]", "", m[0])), text)
        seen, words_of = self.seen, self.words_of
        for line in unwrapped(text) if "\n" in text else (text,):
            runs = [seen.get(r) or words_of(r) for r in line.split()]
            if any([r[1] for r in runs]):
                yield line, [w for r in runs for w in r[0]]

    def score(self, text: str | None) -> dict:
        """score from 0 to 1 (the strongest context window), and the strongest of each kind; zeros for null and empty texts."""
        kinds = dict.fromkeys(("insult", "threat", "hate", "sexual"), 0.0)
        for line, words in self.lines(text) if text else ():
            quoted = None
            for kind, weight, first, last in self.finds(words):
                if kinds[kind] < weight:
                    if quoted is None:
                        quoted = quotations(line)
                    kinds[kind] = max(kinds[kind], weight * reported(words, quoted, first, last))
            kinds["sexual"] = max(kinds["sexual"], lewdness(words))
        if text and not text.isascii() and kinds["insult"] < 0.9 and RUNS.search(unicodedata.normalize("NFKC", text)):
            kinds["insult"] = 0.9
        return {"score": max(kinds.values())} | kinds

    @staticmethod
    def finds(words: list[Word]) -> Iterable[tuple[str, float, int, int]]:
        """(kind, weight, first word, last word) of all that cues find in a line; quotation marks do not part words."""
        ends = [i for i, w in enumerate(words) if w.tag == "."]
        done = -1
        for i, w in enumerate(words):
            if i <= done or not (w.cues or w.foreign):
                continue
            k = bisect_right(ends, i)
            begin, done = ends[k - 1] + 1 if k else 0, ends[k] if k < len(ends) else len(words)
            places = [j for j in range(begin, done) if words[j].tag != '"']
            for cues, said in ((0, [words[j].tag for j in places]), (1, [words[j].plain for j in places])):
                wanted = {id(c): c for j in places for c in words[j][2 + cues]}
                if wanted:
                    clause, there = f" {' '.join(said)} ", set(said)
                    starts = list(accumulate((len(w) + 1 for w in said), initial=1))
                    for cue in wanted.values():
                        for a, b in cue.finds(clause, there):
                            yield cue.kind, cue.weight, places[bisect_right(starts, a) - 1], places[bisect_right(starts, b - 1) - 1]


def unwrapped(text: str):
    """The lines of a text; one that ends within a sentence goes on in the next if that begins with a small letter, or with any letter where the line is so long that it may be wrapped."""
    whole: list[str] = []
    for line in map(str.strip, text.split("\n")):
        goes_on = whole and whole[-1] and line and whole[-1][-1] not in ".!?:;|" and (line[0].islower() or (len(whole[-1]) >= WRAPPED and line[0].isalpha()))
        if whole and not goes_on:
            yield " ".join(whole)
            whole = []
        whole.append(line)
    yield " ".join(whole)


def quotations(line: str) -> list[tuple[int, int]]:
    """(opening, closing) place among the words of the quotation marks that pair up within QUOTED letters; others mean nothing (inches, lost marks).

    A straight mark right after a letter or digit only closes, one right before a letter after a space opens anew.
    """
    pairs: list[tuple[int, int]] = []
    opened: tuple[int, int, str] | None = None
    for i, m in enumerate(TOKEN.finditer(line) if any(c in line for c in CLOSING) else ()):
        mark = m[0]
        if mark not in CLOSING:
            continue
        before, after = line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1]
        if opened and m.start() - opened[1] > QUOTED:
            opened = None
        straight = mark == '"'
        opens_anew = straight and not before.strip() and after.strip() not in ("", ".", ",", "!", "?", ";", ":", ")")
        if opened and mark in CLOSING[opened[2]] and not opens_anew:
            pairs.append((opened[0], i))
            opened = None
        elif not (straight and before.strip() and before not in "([-—*:,"):
            opened = (i, m.start(), mark)
    return pairs


def reported(words: list[Word], quoted: list[tuple[int, int]], first: int, last: int) -> float:
    """How much of a find counts: less where it stands in quotation marks and is spoken of before or after them (said, wrote, the word, means ...)."""
    k = bisect_right(quoted, (first, len(words))) - 1
    if k < 0 or last > quoted[k][1]:
        return 1.0
    a, b = quoted[k]
    near = {w.plain for w in (*words[max(0, a - SPOKEN_WINDOW) : a], *words[b + 1 : b + 1 + SPOKEN_WINDOW])}
    return 1.0 if SPOKEN_OF.isdisjoint(near) else REPORTED


def lewdness(words: list[Word]) -> float:
    """The most that the different sexual words within LEWD_WINDOW words of each other come to, by LEWD_WORTH."""
    hits = [(i, L.LEWD_WORTH[w.tag], w.plain if w.tag != "#xxx" else w.tag) for i, w in enumerate(words) if w.tag in L.LEWD_WORTH]
    best, now, k = 0.0, 0.0, 0
    there: dict[str, int] = {}
    for i, worth, word in hits:
        while i - hits[k][0] > LEWD_WINDOW:
            there[hits[k][2]] -= 1
            now -= hits[k][1] * (there[hits[k][2]] == 0)
            k += 1
        there[word] = there.get(word, 0) + 1
        now += worth * (there[word] == 1)
        best = max(best, now)
    return min(1.0, best)


#: Documents that score so much are cases.
THRESHOLD = 0.75
KINDS = ["score", "insult", "threat", "hate", "sexual"]
_scorers: dict[str, Scorer] = {}


def score_documents(documents: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, source, score, insult, threat, hate, sexual of every document; zeros for null, empty and blank texts.

    Whole texts are read. Ties cannot occur, as each row is scored on its own; repeated rows stay.
    vocabulary_path: the vocabulary file whose pieces tell everyday words (a bounded file, shipped once).
    """
    everyday = documents.sparkSession.sparkContext.broadcast(everyday_words(load_definition(vocabulary_path)["vocab"]))
    key = f"{vocabulary_path}"

    @F.pandas_udf(", ".join(f"{k} double" for k in KINDS))
    def scores(texts: pd.Series) -> pd.DataFrame:
        if key not in _scorers:
            _scorers[key] = Scorer(everyday.value)
        score = _scorers[key].score
        return pd.DataFrame([score(t) for t in texts], columns=KINDS, dtype=float)

    return spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", scores("text").alias("s")).select("doc_id", "source", "s.*")


def abusive_found(documents: DataFrame) -> DataFrame:
    """doc_id of the documents that score THRESHOLD or more."""
    return score_documents(documents).where(F.col("score") >= THRESHOLD).select("doc_id")


def abuse_rates(documents: DataFrame) -> DataFrame:
    """source ('unknown' for null), n_documents, n_flagged, share_flagged, mean_score, and the flagged of each kind."""
    s = score_documents(documents).withColumn("source", F.coalesce("source", F.lit("unknown")))
    flagged = F.col("score") >= THRESHOLD
    return s.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(flagged).alias("n_flagged"), F.avg(flagged.cast("double")).alias("share_flagged"), F.avg("score").alias("mean_score"),
        *[F.count_if(F.col(k) >= THRESHOLD).alias(f"n_{k}") for k in KINDS[1:]])
