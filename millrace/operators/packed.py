"""Problem 1: several values packed in one text field.

Quoted spans are taken out first and replaced by indexed placeholders, the rest is split on the delimiters, and each
placeholder is turned back into its span by array lookup. All steps are built-in expressions: one scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.session import SPACES, utrim

#: Placeholders are OPEN, index, CLOSE. An OPEN that stands in the data becomes OPEN + "x" before masking, and "x" is no
#: digit, so no text can look like a placeholder.
OPEN, CLOSE = "", ""

#: A double-quoted span anywhere; a single-quoted one only where an item can begin and end (else it is an apostrophe).
#: Possessive runs keep the matcher from recursing, so a span may be of any length. A doubled mark belongs to the span
#: only if another mark follows to close it; where escapes leave none, the first mark that isn't escaped closes.
QUOTED = (
    r"""(?s)"[^"\\]*+(?:(?:\\.|""(?=[^"]*+"))[^"\\]*+)*+"|"[^"\\]*+(?:\\.[^"\\]*+)*+\"|"""
    r"""(?<![^\s,;|\[{(])'[^'\\]*+(?:\\.[^'\\]*+)*+'(?=\s*(?:[,;|\]})]|$))"""
)

#: Unquoted values are words of letters, digits and "_": whatever else stands between them separates.
WORDS = rf"(?U)[^\p{{L}}\p{{N}}_{OPEN}{CLOSE}]+"
#: Unquoted values are keys with inner blanks, "|", ":", "." and "-": only list marks and control characters separate.
KEYS = rf"[,;，；、\t\r\n][,;，；、{SPACES}]*"
#: What may stand before the first and after the last value, for each kind of delimiter.
ENDS = {KEYS: ",;，；、" + SPACES}

LISTED = r"(?s)^\s*(?:\[.*\]|\{.*\})\s*$"


def _unquote(span: Column, listed: Column) -> Column:
    body = F.substring(span, F.lit(2), F.length(span) - 2)
    json = F.get(F.from_json(F.concat(F.lit("["), span, F.lit("]")), "array<string>"), F.lit(0))
    plain = F.regexp_replace(F.replace(body, F.lit('""'), F.lit('"')), r"""\\(["'\\])""", "$1")
    loose = F.regexp_replace(F.replace(body, F.lit('""'), F.lit('"')), r"(?s)\\(.)", "$1")
    back = body.contains("\\")
    value = F.when(back & listed & span.startswith('"'), F.coalesce(json, loose)).when(back & listed, loose).otherwise(plain)
    return F.replace(value, F.lit(OPEN + "x"), F.lit(OPEN))


def _restore(item: Column, spans: Column, listed: Column) -> Column:
    """The value of an item in which placeholders stand for spans."""
    index = F.regexp_extract(item, f"^{OPEN}(\\d+){CLOSE}$", 1)
    mixed = F.aggregate(
        spans,
        F.struct(item.alias("t"), F.lit(0).alias("i")),
        lambda a, s: F.struct(
            F.replace(a["t"], F.concat(F.lit(OPEN), a["i"].cast("string"), F.lit(CLOSE)), _unquote(s, listed)).alias("t"),
            (a["i"] + 1).alias("i"),
        ),
        lambda a: F.replace(a["t"], F.lit(OPEN + "x"), F.lit(OPEN)),
    )
    whole = F.transform(F.array(F.get(spans, index.cast("int"))), lambda s: _unquote(s, listed))[0]
    return utrim(F.when(~item.contains(OPEN), item).when(index != "", whole).otherwise(mixed))


def _items(df: DataFrame, field: Column, text: str, delimiters: dict[str, str]) -> DataFrame:
    """df with __listed, __spans and __items: the split text, placeholders in the place of spans, no empty item.

    Each step is a generator over one element, which keeps the optimizer from copying it into each of its uses.
    """

    def step(frame: DataFrame, name: str, c: Column) -> DataFrame:
        return frame.select("*", F.explode(F.array(c)).alias(name))

    t, body, spans = F.coalesce(F.col(text), F.lit("")), F.col("__body"), F.col("__spans")
    df = step(df, "__listed", t.rlike(LISTED))
    df = step(df, "__body", F.replace(F.when(F.col("__listed"), F.regexp_replace(t, r"(?s)^\s*[\[{]|[\]}]\s*$", "")).otherwise(t), F.lit(OPEN), F.lit(OPEN + "x")))
    quoted = body.rlike("[\"']")
    df = step(df, "__spans", F.when(quoted, F.regexp_extract_all(body, F.lit(QUOTED), F.lit(0))).otherwise(F.array().cast("array<string>")))
    # the pieces around the spans are one more than the spans; spans without content leave no placeholder
    between = F.transform(
        F.split(body, QUOTED, -1),
        lambda p, i: F.when(i == 0, p).when(F.get(spans, i - 1).rlike(r"(?U)^.\s*.$"), p).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE), p)),
    )
    df = step(df, "__masked", utrim(F.when(F.size(spans) > 0, F.array_join(between, "")).otherwise(body)))
    items = F.array().cast("array<string>")
    for name, d in delimiters.items():
        bare = d.removeprefix("(?U)")
        inner = F.trim(F.col("__masked"), F.lit(ENDS[d])) if d in ENDS else F.regexp_replace(F.col("__masked"), f"(?U)^{bare}|{bare}$", "")
        items = F.when(field == name, F.when(inner != "", F.split(inner, d)).otherwise(F.array().cast("array<string>"))).otherwise(items)
    return step(df, "__items", items)


def explode_texts(df: DataFrame, field: str, text: str, delimiters: dict[str, str]) -> DataFrame:
    """df without its text, with item_no (from 1) and item_value: one row per non-empty value in stored order, repeats kept.

    delimiters: values of the field column to the pattern that separates unquoted values. Brackets of a list are
    dropped, quote marks and escapes undone, outer whitespace removed. Null, blank and empty lists give no row. An
    unclosed quote mark is ordinary text; a span that touches unquoted text stays one value with it.
    """
    keep = [c for c in df.columns if c != text]
    rows = _items(df.where(F.col(text).isNotNull()), F.col(field), text, delimiters).select(*keep, "__listed", "__spans", F.posexplode("__items").alias("__pos", "__item"))
    return rows.select(*keep, (F.col("__pos") + 1).cast("int").alias("item_no"), _restore(F.col("__item"), F.col("__spans"), F.col("__listed")).alias("item_value"))


def with_values(df: DataFrame, text: str, delimiters: str, out: str) -> DataFrame:
    """df without its text, with ``out``: the array of its values as ``explode_texts`` gives them; no row is lost."""
    keep = [c for c in df.columns if c != text]
    rows = _items(df, F.lit("f"), text, {"f": delimiters})
    return rows.select(*keep, F.transform("__items", lambda x: _restore(x, F.col("__spans"), F.col("__listed"))).alias(out))


def explode_packed(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """One row per value: key, field_name, item_no (from 1), item_value. fields: name to the delimiters of its values.

    Null, blank and empty lists give no row; other columns of df, whatever their names, take no part.
    """
    texts = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("__text")) for f in fields])
    return explode_texts(df.select(F.col(f"`{key}`"), F.inline(texts)), "field_name", "__text", fields)


JOB_LISTS = {"seen_sources": WORDS, "evidence": WORDS, "block_key": KEYS}
