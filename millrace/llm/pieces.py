"""Problem 10: documents over a size limit cut into overlapping pieces at natural boundaries.

Lexical-cohesion segmentation. Ends of paragraphs, lines, sentences and words are the places where a cut may be; the
similarity of the blocks of words before and after a place, slid over the text, falls in a valley where the topic
changes. Within the size window of a piece the deepest valley among all ends of paragraphs, lines and sentences is
taken, stronger kinds having a small bonus; ends of words are places only where a window holds no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from millrace.llm.bpe import Encoder, encoder, shipped, slices, vocabulary_path

#: Words of a block on either side of a place.
BLOCK = 30
CUT, WORD, SENTENCE, LINE, PARAGRAPH, TEXT = range(6)
#: What a kind adds to the depth of a valley (of 2 at most).
BONUS = np.array([0, 0, 0, 0.05, 0.1, 0])
KINDS = ["cut", "word", "sentence", "line", "paragraph", "text"]
_ends = regex.compile(r"[.!?…。！？｡؟।][\"'”’»)\]]*$").search
_wide = regex.compile(r"[。！？｡][”’」』）]*$").search


_known: dict[str, int] = {}
_topics: dict[str, int] = {}
_rows = np.zeros((1024, 9), np.int64)


def _traits_of(w: str) -> tuple:
    """Whether a word begins with white space, ends with it, is nothing else; line breaks of a blank word; return at its end, line feed at its beginning; kind of sentence end; wide full stop; number of its topic (-1: too short)."""
    blank, bare = w.isspace(), w.strip().lower()
    breaks = w.count("\n") + w.count("\r") - w.count("\r\n") if blank else 0
    ends = SENTENCE if not w[-1].isalnum() and _ends(w) else 0
    topic = _topics.setdefault(bare, len(_topics)) if len(bare) > 2 else -1
    return w[0].isspace(), w[-1].isspace(), blank, breaks, w[-1] == "\r", w[0] == "\n", ends, w[-1] > "\u2000" and bool(_wide(w)), topic


class Traits:
    """What the words of a text tell about places, by columns. A worker remembers what it worked out; a cache only."""

    def __init__(self, words: list[str]):
        global _rows
        if len(_known) > 1_000_000:
            _known.clear(), _topics.clear()
        new = [w for w in set(words) if w not in _known]
        while len(_known) + len(new) > len(_rows):
            _rows = np.concatenate((_rows, np.zeros_like(_rows)))
        for w in new:
            _rows[len(_known)] = _traits_of(w)
            _known[w] = len(_known)
        self.n = len(words)
        of = np.fromiter(map(_known.__getitem__, words), np.int64, self.n)
        self.begins, self.stops, self.blank, self.breaks, self.cr, self.nl, self.ends, self.wide, self.topic = _rows[of].T


def boundaries(traits: Traits, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, token, kind) of the places before a word where a cut may be; tokens: how many lie before each word."""
    n = traits.n
    t = traits
    place = np.zeros(n, bool)
    place[1:] = (t.begins[1:] > 0) & (t.stops[:-1] == 0)
    wide = np.zeros(n, bool)
    wide[1:] = (t.wide[:-1] > 0) & ~place[1:]
    # line breaks of the run of blank words that begins at a place; one that two words share counts once
    breaks = t.breaks.copy()
    breaks[1:] -= (t.cr[:-1] > 0) & (t.nl[1:] > 0) & (t.blank[:-1] > 0) & (t.blank[1:] > 0)
    total = np.concatenate(([0], np.cumsum(breaks)))
    solid = np.append(np.flatnonzero(t.blank == 0), n)
    at = np.flatnonzero(place | wide)
    run = total[solid[np.searchsorted(solid, at)]] - total[at]
    kinds = np.where(wide[at], SENTENCE, np.where(run > 1, PARAGRAPH, np.where(run > 0, LINE, np.where(t.ends[at - 1] > 0, SENTENCE, WORD))))
    return at, tokens[at], kinds


def likenesses(bag: np.ndarray) -> np.ndarray:
    """Cosine of the BLOCK words before and after each place 0..n. bag: number of each word, below 0 where one is too short to tell a topic.

    Each pair of equal words counts for the run of places that lie between them or behind both, within a block's reach:
    two steps of a running sum. So the blocks slide over the whole text in a few array operations.
    """
    n = len(bag)
    dot, left = np.zeros(n + 2), np.zeros(n + BLOCK + 2)
    at = np.flatnonzero(bag >= 0)
    np.add.at(left, at + 1, 1.0)
    np.add.at(left, at + BLOCK + 1, -1.0)
    order = at[np.argsort(bag[at], kind="stable")]
    word = bag[order]
    for lag in range(1, 2 * BLOCK):
        # occurrences of a word stand in order, so beyond a lag without near ones there are none
        i, j = order[:-lag], order[lag:]
        near = (word[:-lag] == word[lag:]) & (j - i < 2 * BLOCK)
        if not near.any():
            break
        i, j = i[near], j[near]
        np.add.at(dot, np.maximum(i + 1, j - BLOCK + 1), 1.0)
        np.add.at(dot, np.minimum(j, i + BLOCK) + 1, -1.0)
        both = j - i < BLOCK
        np.add.at(left, j[both] + 1, 2.0)
        np.add.at(left, i[both] + BLOCK + 1, -2.0)
    dot, left = np.cumsum(dot)[: n + 1], np.cumsum(left)
    right = left[BLOCK:][: n + 1]  # the words behind a place are those before the place a block further on
    norm = np.sqrt(np.maximum(left[: n + 1] * right, 0))
    return np.where(norm > 0.5, dot / np.where(norm > 0.5, norm, 1), 0.0)


def depth(like: np.ndarray) -> np.ndarray:
    """How deep each place lies below the peaks on both sides of it."""
    left = np.maximum.accumulate(like)
    right = np.maximum.accumulate(like[::-1])[::-1]
    return left + right - 2 * like


class Splitter:
    """An encoded text with its places, cut for one or more budgets."""

    def __init__(self, e: Encoder, words: list[str]):
        self.e, self.words = e, words
        self.tokens = np.concatenate(([0], np.cumsum(np.fromiter(map(len, map(e.words.__getitem__, words)), np.int64, len(words)))))
        self.offsets: np.ndarray | None = None
        self.like: np.ndarray | None = None

    def deepest(self, lo: int, hi: int) -> int:
        """The place from lo to hi where the deepest valley of the strong kinds lies, else of all."""
        strong = np.flatnonzero(self.kinds[lo:hi] >= SENTENCE) + lo
        places = strong if len(strong) else np.arange(lo, hi)
        if len(places) == 1:
            return int(places[0])
        if self.like is None:
            self.like = likenesses(self.traits.topic)
        # of equal ones the last: a longer piece
        score = depth(self.like[self.at[places]]) + BONUS[self.kinds[places]]
        return int(places[len(score) - 1 - int(score[::-1].argmax())])

    def pieces(self, limit: int, overlap: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(first token, end, kind of the end, bytes) of each piece; none for a text within the limit."""
        n = int(self.tokens[-1])
        if n <= limit:
            return
        bytes_of = self.e.bytes_of
        if self.offsets is None:
            self.traits = Traits(self.words)
            self.at, self.pos, self.kinds = boundaries(self.traits, self.tokens)
            self.ids = np.fromiter(chain.from_iterable(map(self.e.words.__getitem__, self.words)), np.int64, n)
            # the words are the whole text, cut
            self.raw, self.offsets = "".join(self.words).encode("utf-8", "surrogatepass"), np.concatenate(([0], np.cumsum(self.e.lengths[self.ids])))
        ids = self.ids
        pos, kinds = self.pos, self.kinds
        start = 0
        while True:
            if n - start <= limit:
                yield start, n, TEXT, self.raw[self.offsets[start] :]
                return
            end, kind = 0, CUT
            # the upper half of the window first, then the rest behind the overlap
            for low in (max(start + overlap, start + limit // 2), start + overlap):
                lo, hi = np.searchsorted(pos, low, side="right"), np.searchsorted(pos, start + limit, side="right")
                if lo < hi:
                    place = self.deepest(int(lo), int(hi))
                    end, kind = int(pos[place]), int(kinds[place])
                    break
            if not end:
                end = start + limit
                while end > start + overlap + 1 and bytes_of[int(ids[end])][0] & 0xC0 == 0x80:  # not within a character
                    end -= 1
            yield start, end, kind, self.raw[self.offsets[start] : self.offsets[end]]
            start = end - overlap


def _whole(raw: bytes) -> bytes:
    """UTF-8 as it stands; where a piece begins or ends within a character, with replacement marks."""
    tail = raw[-4:]
    lead = next((i for i in range(len(tail) - 1, -1, -1) if tail[i] & 0xC0 != 0x80), -1)
    size = 1 if lead < 0 or tail[lead] < 0x80 else 2 if tail[lead] < 0xE0 else 3 if tail[lead] < 0xF0 else 4
    if raw[0] & 0xC0 == 0x80 or lead >= 0 and len(tail) - lead < size:
        return raw.decode("utf-8", "replace").encode()
    return raw


def split_corpus(df: DataFrame, key: str, text: str, budgets: list[tuple[int, str, int, int]]) -> DataFrame:
    """budget_id, <key>, piece_no, token_start, n_tokens, ends_at, piece_text: the pieces of each document over the limit, for (budget, tokenizer, limit, overlap) of each budget.

    Consecutive pieces share just ``overlap`` tokens and together cover the text; ``ends_at`` tells the kind of
    boundary, ``cut`` where the window holds none. Where a shared run begins within a character, the text shows a
    replacement mark there. Null, empty and short texts give no row; an overlap must be smaller than half the limit.
    """
    assert all(0 <= o < limit / 2 for _, _, limit, o in budgets), "an overlap must be smaller than half the limit"
    kind = df.schema[key].dataType.simpleString()
    vocabularies = {name: shipped(df, vocabulary_path(name)) for name in {b[1] for b in budgets}}
    least = min((limit for _, _, limit, _ in budgets), default=0)
    schema = [("budget_id", pa.int32()), ("k", None), ("piece_no", pa.int32()), ("token_start", pa.int32()), ("n_tokens", pa.int32()), ("ends_at", pa.string()), ("piece_text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in slices(batch, "t", 2_000_000):
                rows = []
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                # a token is a byte at least
                keys, texts = zip(*[(k, t) for k, t in zip(keys, texts) if t and 4 * len(t) > least] or [((), ())])
                for name, vocabulary in vocabularies.items():
                    e = encoder(vocabulary)
                    for k, words in zip(keys, e.encode_words(list(texts))):
                        doc = Splitter(e, words)
                        for budget, n, limit, overlap in budgets:
                            if n == name:
                                rows.extend((budget, k, i, a, b - a, KINDS[c], _whole(raw)) for i, (a, b, c, raw) in enumerate(doc.pieces(limit, overlap), 1))
                if rows:
                    yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip(schema, zip(*rows))})

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"budget_id int, k {kind}, piece_no int, token_start int, n_tokens int, ends_at string, piece_text string")
    return out.withColumnRenamed("k", key)
