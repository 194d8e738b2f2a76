"""Byte-level BPE as an automaton compiled from the merges, and encoding of whole corpora with it."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import spread

#: Words of at most so many bytes are remembered, at most so many per worker; others are encoded anew each time.
REMEMBERED_BYTES, REMEMBERED_WORDS = 48, 200_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary files: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """A deterministic automaton over tokens that accepts just the BPE encodings.

    A state is the last token read; an arc is labelled with the token it reads. At first
    all arcs between bytes are open. add_merge applies one merge gadget: it adds the
    merged token's label and state, and closes the arcs at which the merge would have
    joined what stands left and right of the boundary. Written out, 50,000 states with
    50,000 arcs each would not fit; so each gadget leaves only its parts and its time, and
    open() works an arc out of those when it is first asked for, and keeps it.

    The boundary between tokens a and b stays iff at no time a merge joins a piece on a's
    right edge with a piece on b's left edge while both exist: a piece exists from its own
    merge until the merge that takes it into a larger piece. Of equal merges the leftmost
    goes first, so that a merge inside a goes before, and one inside b after, the same
    merge across the boundary.
    """

    END = 1 << 60

    def __init__(self, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.made: dict[tuple[int, int], tuple[int, int]] = {}  # pair of tokens -> (time, merged token)
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (left, right, time)
        self.label: dict[int, bytes] = {}
        self.trie: list[dict[int, int]] = [{}]  # byte arcs from node to node
        self.token: list[int] = [-1]  # the token that ends in a node, or -1
        self.arcs: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.words: dict[str, list[int]] = {}

    def add_label(self, token: int, label: bytes) -> None:
        node = 0
        for b in label:
            nxt = self.trie[node].get(b)
            if nxt is None:
                nxt = self.trie[node][b] = len(self.trie)
                self.trie.append({})
                self.token.append(-1)
            node = nxt
        self.token[node] = token
        self.label[token] = label

    def add_merge(self, left: int, right: int, token: int) -> None:
        time = len(self.made)
        self.made[left, right] = (time, token)
        self.parts.setdefault(token, (left, right, time))
        self.add_label(token, self.label[left] + self.label[right])

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The pieces on an edge of a token, each with the time of the merge that ends it."""
        if (got := self.edges.get((token, right))) is None:
            got, piece, end = [], token, self.END
            while True:
                got.append((piece, end))
                if piece not in self.parts:
                    break
                left_part, right_part, end = self.parts[piece]
                piece = right_part if right else left_part
            self.edges[token, right] = got
        return got

    def open(self, a: int, b: int) -> bool:
        """Whether b may follow a."""
        if (got := self.arcs.get((a, b))) is None:
            got = True
            for x, x_end in self._edge(a, True):
                for y, y_end in self._edge(b, False):
                    m = self.made.get((x, y))
                    if m is not None and m[0] < x_end and m[0] <= y_end:
                        got = False
                        break
                if not got:
                    break
            if len(self.arcs) > 2_000_000:
                self.arcs.clear()
            self.arcs[a, b] = got
        return got

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as itself."""
        if token not in self.parts:
            return True
        left, right, time = self.parts[token]
        return self.open_before(left, right, time)

    def open_before(self, a: int, b: int, until: int) -> bool:
        """Whether the boundary between a and b stays until a time."""
        return all(
            m is None or m[0] >= until or not (m[0] < x_end and m[0] <= y_end)
            for x, x_end in self._edge(a, True) for y, y_end in self._edge(b, False) for m in [self.made.get((x, y))]
        )

    def encode_word(self, word: bytes) -> list[int]:
        """The one path of open arcs that reads the word.

        From each place whose last token is known the trie is walked; a token that it
        passes becomes the last token of the place where it ends if its arc is open.
        Every beginning of a word has one encoding, so each place gets one token.
        """
        n = len(word)
        last = [-1] * (n + 1)
        trie, token = self.trie, self.token
        for i in range(n):
            a = last[i]
            if i and a < 0:
                continue
            node = 0
            for j in range(i, n):
                node = trie[node].get(word[j])
                if node is None:
                    break
                t = token[node]
                if t >= 0 and last[j + 1] < 0 and (not i or self.open(a, t)):
                    last[j + 1] = t
        out, i = [], n
        while i:
            out.append(last[i])
            i -= len(self.label[last[i]])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """The token ids of a text; none for a null or empty one. Strings of special tokens are ordinary text."""
        out: list[int] = []
        if not text:
            return out
        words = self.words
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= REMEMBERED_BYTES:
                    if len(words) >= REMEMBERED_WORDS:
                        words.clear()
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text whose encoding ids is: the labels of the arcs one after the other."""
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


def load_definition(path: str | None = None) -> dict:
    """vocabulary, merges and pre-split pattern of a byte-level BPE vocabulary file (by default byte_bpe_50k)."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "pattern": public_tokenizers.PATTERN}


def compile_automaton(definition: dict) -> MergeAutomaton:
    """The automaton of a vocabulary: the byte labels, then one gadget after the other.

    A merged token whose own bytes are encoded otherwise can never be read and loses its label in the trie.
    """
    vocab, letters = definition["vocab"], byte_letters()
    auto = MergeAutomaton(definition["pattern"])
    for letter, b in letters.items():
        if letter in vocab:
            auto.add_label(vocab[letter], bytes([b]))
    for left, right in definition["merges"]:
        auto.add_merge(vocab[left], vocab[right], vocab[left + right])
    for node, t in enumerate(auto.token):
        if t >= 0 and not auto.whole(t):
            auto.token[node] = -1
    return auto


_compiled: dict[str, MergeAutomaton] = {}


class Encoder:
    """Ships a vocabulary (a bounded file) to the workers and compiles it there once per worker."""

    def __init__(self, spark, path: str | None = None):
        self.definition = spark.sparkContext.broadcast(load_definition(path))
        self.key = uuid.uuid4().hex

    def automaton(self) -> MergeAutomaton:
        if self.key not in _compiled:
            _compiled.clear()
            _compiled[self.key] = compile_automaton(self.definition.value)
        return _compiled[self.key]


def encode_column(spark, text: Column, path: str | None = None) -> Column:
    """The token ids of a text column as array<int>, empty for null and empty texts."""
    encoder = Encoder(spark, path)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encode = encoder.automaton().encode
        return texts.map(encode)

    return ids(text)


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of every document; no special tokens, an empty list for empty and null text.

    Whole texts of any length; other columns are ignored; one row per input row.
    """
    return spread(documents.select("doc_id", "text")).select("doc_id", encode_column(documents.sparkSession, F.col("text"), path).alias("ids"))
