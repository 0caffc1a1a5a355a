"""Problem 2: freely typed values mapped to the entries of a reference list, unmatched ones reported.

A multi-pattern automaton over the canonical names and aliases finds the mentions embedded in a value; of overlapping
ones the longest wins. Values without a mention go to a token-set similarity: each word of an entry must be met by a
word of the value, whatever their order, with a few edits for longer words or as an abbreviation.

The reference list is shipped to the tasks, as long as it has MOST_ENTRIES entries at most; a longer one raises an error.
Values are resolved where they are read, each distinct value once per task: no shuffle. A typed word meets the words of
the list by an index of segments, not one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.names import osa
from millrace.session import is_blank

#: Reference lists beyond this many entries are not shipped.
MOST_ENTRIES = 100_000
#: Values a task remembers; a cache only.
REMEMBERED = 500_000

# Letters that don't decompose, and short forms of words in place names and roles.
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})
PLACE_SHORT = {"st": "saint", "ste": "saint", "mt": "mount", "ft": "fort", "pt": "port"}
ROLE_SHORT = {"eng": "engineer", "engr": "engineer", "dev": "developer", "mgr": "manager", "admin": "administrator", "coord": "coordinator", "spec": "specialist", "rep": "representative", "asst": "assistant", "ops": "operations", "qa": "quality assurance", "hr": "human resources", "sre": "site reliability engineer", "ml": "machine learning", "bi": "business intelligence"}
#: Words that change nothing in what is meant.
ROLE_NOISE = set("senior junior sr jr lead principal staff graduate experienced mid entry level intermediate trainee intern head chief i ii iii iv v all genders m f d w x remote hybrid onsite on site night day shift part full time contract permanent temporary fixed term urgent hiring months month the of and a an in for to".split())
PLACE_NOISE = set("hybrid remote onsite on site office near area greater district city of the region center centre downtown metro hq and or in at street road avenue floor days week per building suite".split())


def normal(text: str) -> str:
    """Words in lower case without accents, one blank between them."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower().translate(LETTERS)) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", plain))


def allowed_for(n: int) -> int:
    return 1 if n < 5 else 2 if n < 9 else 3


def allowed(word: str) -> int:
    return allowed_for(len(word))


def cuts(n: int) -> list[tuple[int, int]]:
    """Begins and ends of the segments of a word of n letters: two more than the edits it allows, as an exchange of neighbours may touch two (several that all cross borders may be missed)."""
    k = min(n, allowed_for(n) + 2)
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


def stands_for(short: str, whole: str) -> bool:
    """Whether a typed word of up to three letters is a short form of a longer one: its first letter, and the others in order."""
    it = iter(whole)
    return len(short) < min(4, len(whole)) and short[0] == whole[0] and all(c in it for c in short)


def abbreviates(word: str, whole: str) -> bool:
    """A beginning of three letters or more, or the first letter and others in order, most vowels left out."""
    if not 2 < len(word) < len(whole) - 1 or word[0] != whole[0]:
        return False
    it = iter(whole)
    return whole.startswith(word) or all(c in it for c in word) and sum(c in "aeiou" for c in word) * 2 <= sum(c in "aeiou" for c in whole) and len(word) < 8


@dataclass
class Entry:
    ref_id: int
    names: list[str]
    #: Names of what surrounds the entry, which tell entries of one name apart.
    around: list[str] = field(default_factory=list)
    #: An entry that only stands if no other is mentioned.
    weak: bool = False


class Resolver:
    """ref_id of the entry that a typed value means, 0 if none.

    short: short forms and what they stand for; noise: words that change nothing. coined: the names are made of
    recurring beginnings and endings, as places are, so a word that is made of two others' isn't a misspelling.
    """

    def __init__(self, entries: list[Entry], short: dict[str, str], noise: set[str], coined: bool = False, least: float = 0.8):
        self.short, self.noise, self.coined, self.least = short, noise, coined, least
        self.entries = entries
        self.of: dict[str, list[Entry]] = {}
        for e in entries:
            for n in dict.fromkeys(normal(x) for x in e.names if x):
                # as it stands, with short forms written out, and joined to one word
                for form in dict.fromkeys((n, self.expand(n), n.replace(" ", ""))):
                    if form:
                        self.of.setdefault(form, []).append(e)
        self.automaton = ahocorasick.Automaton()
        for n in self.of:
            self.automaton.add_word(f" {n} ", n)
        if self.of:
            self.automaton.make_automaton()
        self.sets = {n: n.split() for n in self.of}
        self.heads = {w[0] for w in self.sets.values() if len(w) > 1}
        self.vocabulary = sorted({w for ws in self.sets.values() for w in ws})
        self.joined = {n.replace(" ", "") for n in self.of if " " in n}
        self.holding: dict[str, list[str]] = {}
        for n, ws in self.sets.items():
            for w in set(ws):
                self.holding.setdefault(w, []).append(n)
        self.around = {normal(a) for e in entries for a in e.around if a}
        self.around_words = {w for a in self.around for w in a.split()}
        self.stems, self.endings = self._branches(self.vocabulary), {x[::-1] for x in self._branches([v[::-1] for v in self.vocabulary])}
        self.near: dict[str, dict[str, int]] = {}
        self.known: dict[str, int] = {}
        # each word under its segments, one more than the edits it allows: of two words within them one stands unchanged
        self.segments: dict[tuple[int, int, str], list[str]] = {}
        self.initials: dict[str, list[str]] = {}
        for v in self.vocabulary:
            for i, (a, b) in enumerate(cuts(len(v))):
                self.segments.setdefault((len(v), i, v[a:b]), []).append(v)
            self.initials.setdefault(v[0], []).append(v)

    def within(self, word: str) -> Iterator[tuple[str, int]]:
        """Words of the list within the edits that they allow, with the distance: looked up by shifted substrings, verified in a band."""
        met: dict[str, None] = {}
        for n in range(max(1, len(word) - 3), len(word) + 4):
            k = allowed_for(n)
            if abs(n - len(word)) > k:
                continue
            for i, (a, b) in enumerate(cuts(n)):
                # a transposition over a border counts as two edits of neighbours, so one place more
                for at in range(max(0, a - k), min(len(word) - (b - a), a + k) + 1):
                    met.update(dict.fromkeys(self.segments.get((n, i, word[at : at + b - a]), ())))
        for v in met:
            if (d := osa(word, v, allowed(v))) <= allowed(v):
                yield v, d

    def expand(self, text: str) -> str:
        return " ".join(self.short.get(w, w) for w in text.split())

    @staticmethod
    def _branches(words: list[str]) -> set[str]:
        """Beginnings of three letters or more after which the words go on in different ways."""
        after: dict[str, set[str]] = {}
        for w in words:
            for i in range(3, len(w)):
                after.setdefault(w[:i], set()).add(w[i])
        return {b for b, nxt in after.items() if len(nxt) > 1}

    def well_formed(self, word: str) -> bool:
        """Made of a beginning and an ending that the reference's words are made of: another name, not a misspelt one."""
        return any(word[:i] in self.stems and word[i:] in self.endings and word[i - 1] != word[i] for i in range(3, len(word) - 2))

    def similar(self, word: str) -> dict[str, int]:
        """Words of the reference that a typed word may be, with the edits between them."""
        got = self.near.get(word)
        if got is None:
            got = {}
            if word in self.holding:
                got[word] = 0
                if not self.coined and len(word) < 6:
                    got |= {v: 1 for v in self.initials.get(word[0], ()) if v not in self.joined and abbreviates(word, v)}
            elif not (self.coined and self.well_formed(word)):
                got.update(self.within(word))
                if not self.coined:
                    got |= {v: 1 for v in self.initials.get(word[0], ()) if v not in got and v not in self.joined and abbreviates(word, v)}
            if len(self.near) > REMEMBERED:
                self.near.clear()
            self.near[word] = got
        return got

    def pick(self, found: list[Entry], text: str) -> int:
        """One of several entries of the same name: the one whose surroundings are mentioned; 0 for none."""
        if not found:
            return 0
        if len(found) == 1:
            return found[0].ref_id
        words = text.split()
        best, score = 0, 0.0
        for e in found:
            s = 0.0
            for a in {normal(x) for x in e.around if x}:
                if f" {a} " in f" {text} ":
                    s += 2
                elif len(a) > 3 and any(osa(w, p, 2) <= 2 for p in a.split() if len(p) > 4 for w in words):
                    s += 1
            if s > score:
                best, score = e.ref_id, s
            elif s == score:
                best = 0
        return best

    def mentions(self, text: str) -> list[str]:
        """Names in the text, longest first where they overlap, in order of length."""
        padded = f" {text} "
        hits = sorted(((end - len(n) - 1, end, n) for end, n in self.automaton.iter(padded)), key=lambda h: (h[0] - h[1], h[0])) if self.of else []
        taken: list[tuple[int, int]] = []
        out = []
        for a, b, n in hits:
            # neighbours share the blank between them
            if all(b <= x + 0 or a >= y for x, y in taken):
                taken.append((a, b))
                before = padded[:a].split()
                # "Lower X" isn't X where the list knows names that begin with "Lower"
                if before and len(n.split()) == 1 and before[-1] not in self.around_words and self.leads(before[-1]):
                    continue
                out.append(n)
        return out

    def leads(self, word: str) -> bool:
        return word in self.heads or len(word) > 3 and word not in self.noise and any(v in self.heads for v in self.similar(word))

    def resolve(self, value: str) -> int:
        got = self.known.get(value)
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            got = self.known[value] = self._resolve(value)
        return got

    def _resolve(self, value: str) -> int:
        text = self.expand(normal(value))
        weak = 0
        for n in self.mentions(text):
            strong = [e for e in self.of[n] if not e.weak]
            if strong and (r := self.pick(strong, text)):
                return r
            weak = weak or next((e.ref_id for e in self.of[n] if e.weak), 0)
        return self.by_words(text) or self.by_heads(text) or weak

    def by_heads(self, text: str) -> int:
        """The entry meant where a short word stands for the first word of longer names ("N Bay" for "North Bay"): only if just one is found."""
        words = text.split()
        found: set[int] = set()
        for i, w in enumerate(words[:-1]):
            if len(w) < 4 and w not in self.heads and not w.isdigit():
                for h in self.heads:
                    if stands_for(w, h):
                        full = " ".join((*words[:i], h, *words[i + 1 :]))
                        found |= {r for n in self.mentions(full) if h in n.split() for r in [self.pick([e for e in self.of[n] if not e.weak], full)] if r}
        return found.pop() if len(found) == 1 else 0

    def by_words(self, text: str) -> int:
        words = [w for w in text.split() if not w.isdigit()]
        matches = [self.similar(w) for w in words]
        candidates = {n for m in matches for v in m for n in self.holding[v]}
        # what surrounds entries counts against none of them
        loose = [i for i, w in enumerate(words) if w in self.noise or w in self.around_words or self.about(w)]
        scored = []
        for n in candidates:
            left, cost, size = set(range(len(words))), 0, 0
            for v in sorted(self.sets[n], key=len, reverse=True):
                at = min((i for i in left if v in matches[i]), key=lambda i: matches[i][v], default=None)
                if at is None:
                    break
                left.discard(at)
                cost += matches[at][v]
                size += len(v)
            else:
                rest = sum(len(words[i]) for i in left if i not in loose)
                s = (size - cost / 2) / (size + rest)
                if s >= self.least and cost <= max(1, size // 4, min(2, size // 3)):
                    scored.append((s, size, n))
        if not scored:
            return 0
        scored.sort(key=lambda x: (-x[0], -x[1], x[2]))
        best = [x for x in scored if x[:2] == scored[0][:2]]
        found = {e.ref_id: e for _, _, n in best for e in self.of[n]}
        strong = [e for e in found.values() if not e.weak] or list(found.values())
        return self.pick(strong, text)

    def about(self, word: str) -> bool:
        return len(word) > 4 and any(osa(word, a, 2) <= 2 for a in self.around_words if abs(len(a) - len(word)) <= 2 and len(a) > 4)


def _shippable(rows: list) -> None:
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries: too many to be shipped to the tasks")


def place_entries(ref: DataFrame) -> list[Entry]:
    rows = ref.select("ref_id", "city", "region_code", "region_name", "country_code", "country_name", "aliases").limit(MOST_ENTRIES + 1).collect()
    _shippable(rows)
    return [Entry(r.ref_id, [r.city, *(r.aliases or [])], [r.region_code, r.region_name, r.country_code, r.country_name], weak=r.country_code is None and r.region_code is None) for r in rows if r.city]


def role_entries(ref: DataFrame) -> list[Entry]:
    rows = ref.select("ref_id", "role_name", "aliases").limit(MOST_ENTRIES + 1).collect()
    _shippable(rows)
    return [Entry(r.ref_id, [r.role_name, *(r.aliases or [])]) for r in rows if r.role_name]


def canonical_values(df: DataFrame, key: str, fields: dict[str, tuple]) -> DataFrame:
    """<key>, field_name, ref_id: one row per non-blank value of each field, ref_id 0 if no entry is meant. fields: name to the arguments of its Resolver.

    Repeated rows and values come out as often as they stand; other columns are ignored; an empty list of entries
    leaves all values unmatched.
    """
    kind = df.schema[key].dataType.simpleString()
    values = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("value")) for f in fields])
    rows = df.select(F.col(f"`{key}`").alias("k"), F.inline(values)).where(~is_blank(F.col("value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolvers = {f: Resolver(*x) for f, x in fields.items()}
        for b in batches:
            ids = [resolvers[f].resolve(v) for f, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.int64())], names=["k", "field_name", "ref_id"])

    return rows.mapInArrow(run, f"k {kind}, field_name string, ref_id long").withColumnRenamed("k", key)
