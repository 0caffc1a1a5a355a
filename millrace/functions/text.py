"""Scalar functions on text as Column expressions: they stay in the JVM and in generated code."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F

from millrace.session import utrim

# Words that carry no identity.
COMPANY_SUFFIXES = ["inc", "llc", "ltd", "corp", "corporation", "co", "gmbh", "the", "technologies", "group", "solutions", "systems", "labs", "software", "digital"]
HINT_SUFFIXES = ["inc", "llc", "ltd", "corp", "corporation", "co", "gmbh", "the"]
LEVEL_WORDS = ["senior", "junior", "mid", "lead", "principal", "staff", "sr", "jr", "i", "ii", "iii", "iv"]
REMOTE_WORDS = ["remote", "worldwide", "anywhere", "work from home", "wfh", "global"]
SKILL_SYNONYMS = {"py": "python", "python3": "python", "js": "javascript", "ts": "typescript", "node": "nodejs", "reactjs": "react", "k8s": "kubernetes", "gcp": "google cloud", "amazon web services": "aws"}
COMPANY_ALIASES = {"ibm": "international business machines", "meta": "facebook", "gm": "general motors"}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def key_text(c: Column) -> Column:
    """Lower case, white space collapsed, all but ASCII letters, digits and blanks deleted; blanks at the ends may remain. Null counts as empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(utrim(_text(c))), r"(?U)\s+", " "), "[^a-z0-9 ]+", "")


def normalize_text(c: Column) -> Column:
    """key_text without blanks at the ends."""
    return F.trim(key_text(c))


def tokens(c: Column) -> Column:
    """Words of a normalised text; an empty array for an empty one."""
    return F.filter(F.split(c, " +"), lambda t: t != "")


def identity_hash(title: Column, company: Column, location: Column) -> Column:
    return F.sha1(F.concat_ws("|", key_text(title), key_text(company), key_text(location)))


def _words_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", " "))


def company_domain_hint(c: Column) -> Column:
    """The token that the employer's domain is expected to hold: one legal suffix dropped, blanks removed."""
    return F.replace(F.regexp_replace(_words_only(c), rf" +(?:{'|'.join(HINT_SUFFIXES)})$", ""), F.lit(" "), F.lit(""))


def normalize_company(c: Column) -> Column:
    """Words without punctuation and without the suffixes at the end, which may leave nothing."""
    return F.trim(F.regexp_replace(_words_only(c), rf"(?:(?:^| )(?:{'|'.join(COMPANY_SUFFIXES)}))+$", ""))


def company_entity(c: Column) -> Column:
    name = normalize_company(c)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COMPANY_ALIASES.items() for x in kv]), name), name)


def location_words(c: Column) -> Column:
    """Words of a place as one text, the words for remote work removed."""
    bare = F.regexp_replace(F.lower(_text(c)), rf"\b(?:{'|'.join(REMOTE_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def location_bucket(c: Column) -> Column:
    """The words of a place, else "remote" if one of the words for it stands there, else nothing."""
    words = location_words(c)
    return F.when(words != "", words).when(F.lower(_text(c)).rlike("|".join(REMOTE_WORDS)), "remote").otherwise("")


def title_stem(c: Column) -> Column:
    """The first two words, those for a level left out."""
    kept = F.filter(tokens(normalize_text(c)), lambda t: ~t.isin(*LEVEL_WORDS))
    return F.array_join(F.slice(kept, 1, 2), " ")


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct runs of n words of a text; all words joined, if there are fewer; empty for no words. Put it behind a generator where it has several uses."""
    words = tokens(normalize_text(c))
    # the inner lambda sees the words through an array, so they are cut once
    runs = F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
    ))
    return F.array_distinct(runs[0])


def fingerprint(s: Column) -> Column:
    """Hash of sorted shingles; empty for none."""
    return F.when(F.size(s) > 0, F.sha1(F.array_join(F.array_sort(s), "|"))).otherwise("")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values: 1 if both are empty, 0 if one is."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def description_fingerprint(c: Column) -> Column:
    """Hash of the sorted shingles of a text; empty for a text without words."""
    return F.transform(F.array(shingles(c)), fingerprint)[0]


def skill(c: Column) -> Column:
    """A skill in one spelling."""
    plain = normalize_text(F.replace(F.replace(F.lower(_text(c)), F.lit("c++"), F.lit("cpp")), F.lit("c#"), F.lit("csharp")))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SKILL_SYNONYMS.items() for x in kv]), plain), plain)


def any_term(c: Column, terms: list[str]) -> Column:
    """Whether one of the terms stands in the text between word boundaries; false for no terms."""
    quoted = ["".join(ch if ch.isalnum() or ch in " _" else "\\" + ch for ch in t.lower()) for t in terms if t]
    return F.lower(_text(c)).rlike(rf"\b(?:{'|'.join(quoted)})\b") if quoted else F.lit(False)


def experience(c: Column) -> Column:
    """Years asked for, from the first of four tiers that the text mentions."""
    low = F.lower(_text(c))
    out = F.when(F.lit(False), "")
    for n, word in ((5, "years"), (3, "years"), (2, "years"), (1, "year")):
        out = out.when(low.contains(f"{n}+ year") | low.contains(f"{n} {word}"), f"{n}+ {word}")
    return out.otherwise("")


def keyword_list(c: Column) -> Column:
    """Values of a list typed with commas, semicolons or slashes."""
    return F.filter(F.transform(F.split(_text(c), "[,;/]"), utrim), lambda x: (x != "") & (x != "MISSING"))


# How far descriptions are shown, and what ends the text of a guest page.
SHOWN, GUEST_WINDOW, GUEST_END = 4000, 12_000, "show more show less"


def _plain(c: Column) -> Column:
    bare = F.regexp_replace(_text(c), r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.regexp_replace(bare, r"(?s)<[a-zA-Z/!][^>]*>", " ")


def html_text(c: Column) -> Column:
    """Text of markup: scripts, styles and tags dropped, common entities decoded, white space collapsed."""
    bare = _plain(c)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return utrim(F.regexp_replace(bare, r"(?U)\s+", " "))


def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def description_text(c: Column, limit: int = SHOWN) -> Column:
    """Text of a description's markup with all entities decoded, numeric ones too, cut at ``limit`` characters. Texts without an entity don't leave the JVM's result."""
    bare = _plain(c)
    decoded = F.when(bare.contains("&"), F.pandas_udf(_unescape, "string")(bare)).otherwise(bare)
    return F.substring(utrim(F.regexp_replace(decoded, r"(?U)\s+", " ")), 1, limit)


def page_text(c: Column, limit: int = SHOWN) -> Column:
    """Text of a page's markup, entities as they stand."""
    return F.substring(utrim(F.regexp_replace(_plain(c), r"(?U)\s+", " ")), 1, limit)


def guest_text(c: Column, limit: int = SHOWN) -> Column:
    """Text of a guest page's description: of its first GUEST_WINDOW characters, up to the words that end it."""
    text = utrim(F.regexp_replace(_plain(F.substring(_text(c), 1, GUEST_WINDOW)), r"(?U)\s+", " "))
    at = F.instr(F.lower(text), GUEST_END)
    return F.substring(utrim(F.when(at > 0, F.left(text, at - 1)).otherwise(text)), 1, limit)


def _json_object(s: pd.Series) -> pd.Series:
    def of(text: str | None) -> str | None:
        if not text:
            return None
        fenced = re.search(r"```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", text, re.DOTALL)
        body = fenced.group(1) if fenced else text
        depth, begin = 0, body.find("{")
        for i in range(max(begin, 0), len(body)):
            depth += (body[i] == "{") - (body[i] == "}")
            if not depth:
                try:
                    return json.dumps(json.loads(body[begin : i + 1]), ensure_ascii=False) if begin >= 0 else None
                except ValueError:
                    return None
        return None

    return s.map(of, na_action="ignore")


def json_object(c: Column) -> Column:
    """The first object in an answer's text, fenced or bare, as JSON; null where there is none that parses. Counting braces has no built-in, so texts go by in Arrow batches."""
    return F.when(c.contains("{"), F.pandas_udf(_json_object, "string")(c))
