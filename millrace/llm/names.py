"""Problem 4: variant spellings of the names of organisations.

A name is parsed into the words that make it its own, and its trade. Variants that only reorder, join or decorate these
have one key. Misspelt ones meet by a pigeonhole segment join: the joined words of a key are cut into k+1 segments,
which are looked up among the position-shifted substrings of the others in an inverted index; of two texts within k
edits one segment stands unchanged. Pairs that meet are verified with a banded edit distance. Short forms (one word
of two, an initial, no trade) are linked where just one organisation can be meant, misspelt ones too; those that are no
part of a longer name are organisations of their own.

Every variant then points to the best supported key it is near to, and all that point to one root are one organisation.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.session import cut, is_blank

# Legal forms, and what job boards add to names.
LEGAL = {"inc", "llc", "ltd", "corp", "corporation", "co", "company", "gmbh", "ag", "plc", "sa", "limited", "incorporated", "group", "holding", "holdings"}
ADDED = {"the", "and", "careers", "career", "jobs", "hiring", "recruiting", "recruitment", "talent", "team", "hq", "headquarters"}

EDITS = 2
#: A word is a trade if it is the last word of this share of its names, and stands beside words of so many different beginnings (two letters).
LAST_SHARE, BEGINNINGS = 0.8, 3
#: Least share of all names that a trade ends: it bounds what reaches the driver to its reciprocal.
LEAST_SHARE = 1e-5


def tokens_of(name: str) -> tuple[list[str], bool]:
    """Words in lower case without accents, legal forms and additions; whether the name is joined from words ("AlphaBeta")."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    # a zero among letters is an o
    plain = re.sub(r"(?<=[A-Za-z])0|0(?=[A-Za-z])", lambda m: "o", plain)
    joined = bool(re.search(r"[a-z][A-Z]", plain))
    words = [w for w in re.findall(r"[a-z0-9]+", plain.lower())]
    core = [w for w in words if w not in ADDED]
    while len(core) > 1 and core[-1] in LEGAL:
        core.pop()
    return core or words, joined


def short_for(word: str, trade: str) -> bool:
    """Whether a word may be a typed abbreviation: a beginning of three letters or more, or letters left out of the trade in order."""
    if len(word) < 3 or len(word) >= len(trade):
        return False
    if trade.startswith(word):
        return True
    it = iter(trade)
    return all(c in it for c in word) and word[-1] in trade[-3:] and sum(c in "aeiou" for c in word) <= max(1, sum(c in "aeiou" for c in trade) - 1)


def osa(a: str, b: str, k: int) -> int:
    """Edit distance with transpositions of neighbours, within a band of k; k + 1 if it is larger."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    big = k + 1
    before, last = None, [j if j <= k else big for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [i if i <= k else big] + [big] * len(b)
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            c = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if before is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, before[j - 2] + 1)
            row[j] = c
        if min(row) > k:
            return big
        before, last = last, row
    return min(last[-1], big)


def trade_of(words: list[str], trades: list[str]) -> tuple[str | None, int]:
    """The trade a name states and the place of its word: an exact word, else a misspelt or shortened one; None for a trade that several may be, (None, -1) if there is none."""
    exact = [(w, i) for i, w in enumerate(words) if w in trades]
    if exact:
        return exact[-1]
    for i in reversed(range(len(words))) if len(words) > 1 else ():
        w = words[i]
        if len(w) < 3:
            continue
        near = sorted((d, t) for t in trades if (d := osa(w, t, 1 if len(t) < 5 else 2)) <= (1 if len(t) < 5 else 2))
        if len(near) == 1 or len(near) > 1 and near[0][0] < near[1][0]:
            return near[0][1], i
        short = [t for t in trades if short_for(w, t)]
        if len(short) > 1:  # the first letter tells most
            short = [t for t in short if t[0] == w[0]] or short
        if short and len(words) > 2:
            # of several trades none is taken, but the word is no part of the name itself
            return (short[0] if len(short) == 1 else None), i
    # a name of three words or more whose trade isn't known: its last word tells what it does
    if len(words) > 2 and len(words[-1]) > 3:
        return words[-1], len(words) - 1
    return None, -1


def _trades(names: DataFrame) -> list[str]:
    """Words that end the names they stand in, and stand beside many different words there: measures that don't depend on how many names there are.

    Own words of a name stand beside their few companions and those's misspellings, which begin alike; trades stand
    beside many. Misspellings and short forms of a trade with more companions are no trades of their own.
    """

    def cut_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for name in df["company"]:
                words = tokens_of(name)[0]
                rows.extend((w, i == len(words) - 1, sorted({x[:2] for x in words if x != w})) for i, w in enumerate(words) if len(w) >= 4)
            yield pd.DataFrame(rows, columns=["w", "last", "sides"])

    held = names.select("company").mapInPandas(cut_names, "w string, last boolean, sides array<string>")
    n = names.count()
    found = held.groupBy("w").agg(F.count_if("last").alias("ends"), F.count("*").alias("n"), F.flatten(F.collect_set("sides")).alias("sides"))
    found = found.select("w", "ends", "n", F.size(F.array_distinct("sides")).alias("sides")).where((F.col("sides") >= BEGINNINGS) & (F.col("ends") >= LAST_SHARE * F.col("n")) & (F.col("ends") >= LEAST_SHARE * n))
    trades: list[str] = []
    for r in found.orderBy(F.desc("sides"), F.desc("ends"), "w").collect():
        if not any(short_for(r.w, t) or osa(r.w, t, 2) <= 2 for t in trades):
            trades.append(r.w)
    return sorted(trades)


def parsed_names(names: DataFrame, trades: list[str]) -> DataFrame:
    """company, form, words (sorted), trade, key, and word and word_trade of a name that can be read in two ways.

    form: full, joined (one word of two), single or initial (one word of several, or an initial); either: two words of
    which one may be a misspelt trade or not. Its words and key are those of a full name, word and word_trade those of a single one.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for name in df["company"]:
                words, joined = tokens_of(name)
                trade, at = trade_of(words, trades)
                own = [w for i, w in enumerate(words) if i != at]
                word = word_trade = None
                if len(own) == 1 and joined and not trade:
                    form = "joined"
                elif any(len(w) == 1 for w in own) and len(own) > 1:
                    form = "initial"
                elif len(own) == 1 and len(words) == 2 and at >= 0 and words[at] not in trades and min(map(len, words)) > 3:
                    form, word, word_trade, own, trade = "either", own[0], trade, words, None
                elif len(own) == 1:
                    form = "single"
                else:
                    form = "full"
                own = sorted(own)
                rows.append((name, form, own, trade, " ".join(own) + "|" + (trade or ""), word, word_trade))
            yield pd.DataFrame(rows, columns=["company", "form", "words", "trade", "key", "word", "word_trade"])

    return names.mapInPandas(parse, "company string, form string, words array<string>, trade string, key string, word string, word_trade string")


def segment_pairs(texts: DataFrame, tiers: list[tuple[int, int]] = ((1, EDITS),)) -> DataFrame:  # type: ignore[assignment]
    """x, y (x < y), d: pairs of the distinct texts (column s) within k edits, by one common segment near its place. With a column u, one of the two has it true.

    tiers: least length of the shorter text and the edits allowed from there on, both rising; shorter texts take no part, and those of no more letters than edits meet only what has them all.
    Segments and substrings are built-in expressions; the banded distance takes pairs in Arrow batches.
    """
    most = max(e for _, e in tiers)

    def edits(n: Column) -> Column:
        out = F.lit(None).cast("int")
        for least, e in tiers:
            out = F.when(n >= least, F.lit(e)).otherwise(out)
        return out

    def cuts(n: Column, e: Column) -> Column:
        """Begin and length of the e + 1 segments of a text of n letters, empty ones left out."""
        at = lambda i: F.floor(i * n / (e + 1)).cast("int")
        every = F.transform(F.sequence(F.lit(0), e), lambda i: F.struct(i.cast("int").alias("i"), at(i).alias("a"), (at(i + 1) - at(i)).alias("l")))
        return F.filter(every, lambda c: c["l"] > 0)

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), use)[0]

    def segments(s: Column) -> Column:
        n = F.length(s)
        return F.transform(cuts(n, edits(n)), lambda c: F.struct(n.alias("n"), c["i"].alias("i"), F.substring(s, c["a"] + 1, c["l"]).alias("g")))

    def substrings(s: Column) -> Column:
        whole = F.length(s)

        def of_length(n: Column) -> Column:
            def near(e: Column) -> Column:
                # edits before a segment shift it by so many places at most
                def of_cut(c: Column) -> Column:
                    begin, end = F.greatest(F.lit(0), c["a"] - e), F.least(whole - c["l"], c["a"] + e)
                    return F.when(begin <= end, F.transform(F.sequence(begin, end), lambda p: F.struct(n.cast("int").alias("n"), c["i"].alias("i"), F.substring(s, p + 1, c["l"]).alias("g"))))

                return F.when(whole - n <= e, F.flatten(F.filter(F.transform(cuts(n, e), of_cut), lambda x: x.isNotNull())))

            return once(edits(n), near)

        # the indexed text is the shorter one
        every = F.transform(F.sequence(F.greatest(F.lit(1), whole - most), whole), of_length)
        return F.array_distinct(F.flatten(F.filter(every, lambda x: x.isNotNull())))

    def distances(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y):
            short = min(len(a), len(b))
            e = max((k for least, k in tiers if short >= least), default=-1)
            d = osa(a, b, e) if e >= 0 else e + 1
            out.append(d if d <= e else None)
        return pd.Series(out, dtype="Int32")

    marked = "u" in texts.columns
    wanted = F.col("ux") | F.col("uy") if marked else F.lit(True)
    held = texts.where(F.length("s") >= min(n for n, _ in tiers))
    index = held.select(F.col("s").alias("x"), *[F.col("u").alias("ux")] * marked, F.inline(segments(F.col("s"))))
    probe = texts.where(F.length("s") >= 1).select(F.col("s").alias("y"), *[F.col("u").alias("uy")] * marked, F.inline(substrings(F.col("s"))))
    # a segment that thousands of texts hold is split by AQE; Levenshtein distance bounds the other from above by its double
    met = index.join(probe, ["n", "i", "g"]).where((F.col("x") != F.col("y")) & wanted & (F.levenshtein("x", "y", 2 * most) >= 0))
    pairs = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).dropDuplicates()
    return pairs.withColumn("d", F.pandas_udf(distances, "int")("x", "y")).where("d is not null")


def _either_way(pairs: DataFrame) -> DataFrame:
    return pairs.select("x", "y", "d").unionAll(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "d"))


def word_pairs(texts: DataFrame) -> DataFrame:
    """x, y, d, either way round: misspellings among single words (column s; u as in segment_pairs): one edit from eight letters on, two from twelve on; shorter words one edit apart are mostly different names."""
    return _either_way(segment_pairs(texts, [(8, 1), (12, 2)]))


def _resolved(tree: DataFrame) -> DataFrame:
    """key, root: each key's last root, from key and the next one; a root is its own."""
    while True:  # each step halves what is left of a chain, and support rises along it, so it ends
        up = tree.select(F.col("key").alias("root"), F.col("root").alias("next"))
        step = cut(tree.join(up, "root", "left").select("key", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        tree = step.drop("moved")
        if step.where("moved").isEmpty():
            return tree


def _tree(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """key, root: each key points to the best supported one it is near to, within one trade (or where one states none).

    nodes: key, trade, n, rows and s, one row for each text that a key may be spelled as; both: pairs of near texts, either way.
    """
    support = F.struct("n", "rows", "key")
    here = nodes.select(F.col("key").alias("from"), F.col("trade").alias("ft"), F.col("s").alias("x"), support.alias("fs"))
    there = nodes.select(F.col("key").alias("to"), F.col("trade").alias("tt"), F.col("s").alias("y"), support.alias("ts"))
    same = here.join(there.withColumnRenamed("y", "x"), "x").withColumn("d", F.lit(0))
    near = here.join(both, "x").join(there, "y").select("x", "from", "ft", "fs", "to", "tt", "ts", "d").unionByName(same.select("x", "from", "ft", "fs", "to", "tt", "ts", "d"))
    # a name without trade may only point to one with a trade, and only if one trade is near
    near = near.where("from <> to and (ft <=> tt or (ft is null and tt is not null))")
    near = near.where(F.col("ft").isNull() & F.col("tt").isNotNull() | (F.col("fs") < F.col("ts")))
    choice = near.groupBy("from").agg(F.min_by("to", F.struct("d", F.struct((-F.col("ts.n")).alias("n"), (-F.col("ts.rows")).alias("r"), "to"))).alias("to"), F.min("d").alias("d"), F.count_distinct(F.when(F.col("ft").isNull(), F.col("tt"))).alias("trades"))
    parent = choice.where("trades <= 1").select(F.col("from").alias("key"), F.col("to").alias("parent"))
    tree = nodes.select("key").distinct().join(parent, "key", "left").select("key", F.coalesce("parent", "key").alias("root"))
    return _resolved(cut(tree))


def organisations(companies: DataFrame, k: int = EDITS) -> DataFrame:
    """company, root: each distinct non-blank name as stored, and the organisation it stands for. companies: company and any other columns."""
    names = companies.where(~is_blank(F.col("company"))).groupBy("company").agg(F.count("*").alias("rows"))
    named = parsed_names(names.select("company"), _trades(names)).join(names, "company")
    named = cut(named)
    # keys of full names, with their support
    whole = named.where("form in ('full', 'either')")
    full = whole.groupBy("key", "words", "trade").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    glues = F.explode(F.array_distinct(F.array(F.array_join("words", ""), F.array_join(F.reverse("words"), "")))).alias("s")
    # 1: misspelt full names
    joined = full.select("key", "trade", "n", "rows", glues)
    tree = _tree(joined, _either_way(segment_pairs(joined.select("s").distinct(), [(1, k)])))
    # names that can be read in two ways and are near to no other full name are read the other way
    size = tree.groupBy("root").agg(F.count("*").alias("keys"))
    lone = cut(whole.groupBy("key").agg(F.count_if(F.col("form") == "full").alias("sure")).join(tree, "key").join(size, "root").where("sure = 0 and keys = 1").select("key"))
    named = cut(named.join(lone.withColumn("__lone", F.lit(True)), "key", "left").select(
        "company", "rows", F.when(F.col("__lone"), "single").when(F.col("form") == "either", "full").otherwise(F.col("form")).alias("form"),
        *[F.when(F.col("__lone"), b).otherwise(F.col(a)).alias(a) for a, b in (("words", F.array("word")), ("trade", F.col("word_trade")), ("key", F.concat(F.col("word"), F.lit("|"), F.coalesce("word_trade", F.lit("")))))],
    ))
    full = full.join(lone, "key", "left_anti")
    tree = cut(tree.join(lone, "key", "left_anti"))
    roots = full.join(tree, "key").where("key = root").select("root", "words", "trade", "n", "rows")
    spelled = named.where("form = 'full'").join(tree, "key").select("company", "root")
    # 2: short forms: all words of one root joined, in either order; one word, or an initial and a word, perhaps with a trade
    part = roots.select("root", F.col("trade").alias("rt"), "words", "n", "rows", F.explode("words").alias("s"))
    targets = cut(part.unionAll(roots.select("root", F.col("trade").alias("rt"), "words", "n", "rows", glues)).dropDuplicates(["root", "s"]))
    # the same of the other spellings of a root
    other = full.join(tree, "key").where("key <> root").join(roots.select("root", F.col("trade").alias("rt"), F.col("n").alias("rn"), F.col("rows").alias("rr")), "root").select("root", "rt", "words", F.col("rn").alias("n"), F.col("rr").alias("rows"), F.explode("words").alias("s"))
    variants = other.join(targets.select("root", "s"), ["root", "s"], "left_anti").dropDuplicates(["root", "s"])
    # an initial takes its word to look it up, and all it has as its own text
    own = F.when(F.col("form") == "initial", F.get(F.filter("words", lambda w: F.length(w) > 1), F.lit(0))).otherwise(F.col("words")[0])
    letter = F.when(F.col("form") == "initial", F.get(F.filter("words", lambda w: F.length(w) == 1), F.lit(0)))
    brief = named.where("form <> 'full'").groupBy("key", "trade", own.alias("s"), letter.alias("letter"), F.array_join("words", "").alias("text")).agg(F.count("*").alias("bn"), F.sum("rows").alias("brows"))
    fits = "(trade is null or trade <=> rt) and (letter is null or exists(words, x -> x <> {} and startswith(x, letter)))"

    def meant(rows: DataFrame, by: DataFrame) -> DataFrame:
        return rows.join(by, "s").where(fits.format("s")).groupBy("key").agg(F.count_distinct("root").alias("n"), F.min("root").alias("root"))

    exact = cut(meant(brief, targets))
    exact = cut(exact.unionAll(meant(brief.join(exact, "key", "left_anti"), variants)))
    # 3: what is no part of a full name may be a misspelt part of just one that is better supported, or else an organisation of its own
    rest = cut(brief.join(exact, "key", "left_anti"))
    texts = targets.select("s", F.lit(False).alias("u")).unionAll(rest.select("s", F.lit(True))).unionAll(rest.select("text", F.lit(True))).groupBy("s").agg(F.max("u").alias("u"))
    both = cut(word_pairs(texts))
    close = rest.join(both, F.col("s") == F.col("x")).join(targets.withColumnRenamed("s", "ts"), F.col("y") == F.col("ts"))
    close = close.where(fits.format("ts") + " and (bn < n or bn = n and brows < rows)").groupBy("key").agg(F.count_distinct("root").alias("n"), F.min("root").alias("root"))
    linked = exact.unionAll(close).where("n = 1").select("key", "root")
    alone = rest.join(linked, "key", "left_anti").select("key", "trade", F.col("bn").alias("n"), F.col("brows").alias("rows"), F.col("text").alias("s"))
    heads = linked.unionAll(_tree(alone, both))
    return spelled.unionAll(named.where("form <> 'full'").join(heads, "key").select("company", "root"))


def company_pairs(companies: DataFrame, k: int = EDITS) -> DataFrame:
    """company_a, company_b: each pair of different stored strings that mean the same organisation, the smaller first by code point.

    Blank names take no part; names that can mean several organisations are linked to none; empty input gives no rows.
    """
    held = cut(organisations(companies, k))
    a, b = held.select("root", F.col("company").alias("company_a")), held.select("root", F.col("company").alias("company_b"))
    return a.join(b, "root").where("company_a < company_b").select("company_a", "company_b")
