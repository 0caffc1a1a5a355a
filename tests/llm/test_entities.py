import itertools
import random
import re

from pyspark.sql import functions as F

from millrace.llm import canonical as C, near_duplicates as N
from millrace.llm.history import ChunkStore, chunks_of, match_batches
from millrace.llm.names import _resolved, company_pairs, osa, segment_pairs
from millrace.llm.near_duplicates import near_duplicate_rows
from millrace.llm import postings as P
from millrace.llm.shingles import word_hashes
from millrace.llm.survivors import survivors


def runs(text, n):
    w = re.sub(r"[^a-z0-9 ]+", "", re.sub(r"\s+", " ", text.strip().lower())).split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def alike(a, b, n, t):
    x, y = runs(a, n), runs(b, n)
    return bool(x and y) and len(x & y) >= t * len(x | y) - 1e-9


def edited(rng, base):
    w = base.split()
    for _ in range(rng.randrange(0, 6)):
        i = rng.randrange(len(w))
        rng.choice([lambda: w.__setitem__(i, f"x{rng.randrange(99)}"), lambda: w.insert(i, "also"), lambda: w.pop(i) if len(w) > 3 else None])()
    return " ".join(w)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    bases = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 8, 30, 60]))) for _ in range(n // 5)]
    return [edited(rng, rng.choice(bases)) for _ in range(n)] + ["one", "one", "two words", "", "  ", "???", None, "A! b c", "a b c", "long " * 3000]


def test_near_duplicates_are_those_of_brute_force(spark):
    rows = list(enumerate(texts(1, 200)))
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "id long, body string, s1 string")
    for n, t in ((3, 0.6), (5, 0.8)):
        want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if a and b and alike(a, b, n, t)}
        got = [tuple(r) for r in near_duplicate_rows(df, "id", "body", t, n).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert near_duplicate_rows(df.where("id < 0"), "id", "body").count() == 0


def test_copies_across_blocks_and_partitions(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, edited(rng, "a b c d e f g h i j k l m n o p q r s t") + f" z{i % 7}") for i in range(120)] + [(i, "x y z " * 9) for i in range(120, 140)]
    monkeypatch.setattr(P, "BLOCK", 8)
    df = spark.createDataFrame(rows, "id long, body string").repartition(7)
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if alike(a, b, 3, 0.6)}
    got = [tuple(r) for r in near_duplicate_rows(df, "id", "body", 0.6, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # posted bytes hardly change with the number of partitions
    texts = P.prepared(spark.createDataFrame([(i, " ".join(f"w{rng.randrange(14)}" for _ in range(90))) for i in range(3000)], "id long, body string").coalesce(1), "body", 3, ["id"]).cache()
    size = [N.post_sets(texts, 3, 0.6, N.shingle_counts(texts, 3, 270_000), n).agg(F.sum(F.length("blob"))).first()[0] for n in (8, 400)]
    assert size[1] < 1.3 * size[0]


def batch_rows(rows):
    return [(i, b, h, t if t and t.strip() else None, k) for i, b, h, t, k in rows]


def wanted(rows, t=0.6):
    want = set()
    for a, b in itertools.combinations(rows, 2):
        if a[1] or b[1]:
            if a[2] and b[2] and a[2].lower() == b[2].lower() or a[3] and b[3] and set(a[4] or ()) & set(b[4] or ()) and alike(a[3], b[3], 3, t):
                want.add((a[0], b[0]))
    return want


SCHEMA = "job_row_id long, batch_no int, job_id_hash string, body string, keys array<string>"


def test_batches_against_history(spark):
    rng = random.Random(2)
    rows = batch_rows([(i, max(0, i - 150) // 30 + (i >= 150), rng.choice(["Aa", "AA", "b", None, f"h{i}"]) if i % 9 == 0 else None, t, rng.choice([["k|1"], ["k|2", "d|x"], ["d|x"], [], None])) for i, t in enumerate(texts(3, 240))])
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in match_batches(df, "job_row_id", 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted(rows)
    assert match_batches(df.where("batch_no = 0"), "job_row_id").count() == 0 and match_batches(df.limit(0), "job_row_id").count() == 0


def test_short_texts_and_hot_chunks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 8)
    rng = random.Random(6)
    base = lambda: [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 4, 6, 8, 10, 15, 30]))]
    rows = []
    for i in range(0, 800, 2):
        a = base()
        b = list(a)
        b[rng.choice([0, len(b) - 1, rng.randrange(len(b))])] = "other"
        rows += [(i, 0, None, " ".join(a), ["k|1"]), (i + 1, 1 + i % 2, None, " ".join(b), ["k|1"])]
    rows += [(i, i % 3, None, edited(rng, "a b c d e f g h i j k l m n o p q r s t"), ["k|1"]) for i in range(800, 860)]
    rows += [(i, i % 3, None, "same words again " * 20, ["k|1"]) for i in range(860, 870)]
    want = wanted(rows)
    assert len(want) > 300 and {tuple(r) for r in match_batches(spark.createDataFrame(rows, SCHEMA), "job_row_id", 0.6).collect()} == want


def test_store_is_appended_and_repeats_are_harmless(spark, tmp_path):
    rows = [(1, 0, "h", "the quick brown fox jumps over the lazy dog near the river bank today", ["k"]), (2, 1, None, "the quick brown fox jumps over the lazy dog near the river bank tonight", ["k"]), (3, 1, "H", "nothing of that kind stands in here at all, not a word", ["k"])]
    late = [(4, 2, None, "a quick brown fox jumps over the lazy dog near the river bank today", ["k"]), (5, 2, None, "the quick brown fox jumps over the lazy dog near the river bank today", ["other"])]
    path = str(tmp_path / "store")
    assert {tuple(r) for r in match_batches(spark.createDataFrame(rows, SCHEMA), "job_row_id", 0.6, path).collect()} == {(1, 2), (1, 3)}
    # a later session opens the store and brings a batch; a batch that is run again changes nothing
    store = ChunkStore(spark, path)
    for _ in range(2):
        store.land(spark.createDataFrame(late, SCHEMA), "job_row_id")
        store.append(2)
        store.match(2)
        assert {tuple(r) for r in store.pairs([2]).collect()} == {(1, 4), (2, 4)}
    assert spark.table(store.table).groupBy("batch_no", "part").count().where("count > 1").count() == 0


def test_chunks_do_not_depend_on_the_text_before():
    words = lambda *texts: chunks_of(*word_hashes(list(texts)))
    one = set(words("red green blue one two three four five")[0].tolist())
    for first in ("x", "y z", "some more words stand here"):
        h, doc, _ = words(first, "red green blue one two three four five")
        assert set(h[doc == 1].tolist()) == one


def test_survivors(spark):
    cols = "job_row_id long, canonical_job_id string, source_authority int, last_seen_at double, location string, description string, apply_url_direct string, valid_through string, experience_needed string, employer_domain string, seen_sources string, n string"
    rows = [
        (1, " K ", None, 1.7e9, "A", None, "MISSING", None, " ", "x", "a;b", "q"),
        (2, "k", 3, None, "", "d", "missing", None, "", None, "a,a", "q"),
        (3, "k", 3, 1.7e12, None, None, None, None, None, None, None, "q"),
        (4, "k", 3, 1.7e9, None, None, "u", None, None, None, "b;c", "q"),
        (5, "alone", 3, 1.7e9, "A", "A", "A", "A", "A", "A", "a", "q"),
        (6, None, 3, 1.7e9, "A", "A", "A", "A", "A", "A", "a", "q"),
        (7, " ", 3, 1.7e9, "A", "A", "A", "A", "A", "A", "a", "q"),
    ]
    df = spark.createDataFrame(rows, cols)
    got = {(r.canonical_key, r.field_name): r.job_row_id for r in survivors(df).collect()}
    assert got == {("k", "record"): 3, ("k", "location"): 1, ("k", "description"): 2, ("k", "apply_url_direct"): 4, ("k", "employer_domain"): 1, ("k", "seen_sources"): 4}
    values = {r.field_name: r.item_value for r in survivors(df, values=True).collect()}
    assert values["location"] == "A" and values["seen_sources"] == "b;c"
    assert survivors(df.limit(0)).count() == 0


def test_edit_distance():
    assert [osa(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abcde"), ("", "ab"), ("abcd", "wxyz"))] == [0, 1, 2, 2, 3]


def test_company_names(spark):
    trades = "optics marine paper foods media energy".split()
    syllables = ["ba", "ke", "lo", "mi", "tu", "ra", "zo", "ne", "pi", "sta"]
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(syllables) for _ in range(4)).capitalize()
    names = [f"{word()} {word()} {rng.choice(trades).capitalize()}" for _ in range(120)]
    a, b, t = names[0].split()
    variants = [names[0], f"{names[0]}, Inc.", f"The {names[0]}", names[0].lower(), f"{b} {a} {t}", f"{a}{b}", a, f"{a[0]}. {b} {t}", f"{a[0]}{a[2]}{a[1]}{a[3:]} {b} {t}", f"{a} & {b} {t} - Careers"]
    other = f"{a} {b} {'Energy' if t != 'Energy' else 'Paper'}x"[:-1]
    rows = [(v, "d") for v in names + variants + variants[:2]] + [(None, "d"), ("", "d"), ("missing", "d"), ("x" * 5000, "d")]
    df = spark.createDataFrame(rows, "company string, root string")
    got = {tuple(r) for r in company_pairs(df).collect()}
    want = {tuple(sorted(p)) for p in itertools.combinations(sorted(set(variants)), 2)}
    assert want <= got and all(x < y for x, y in got) and len(got - want) <= 2
    # a second firm of that name in another trade: short forms may mean either, so they mean none
    two = {tuple(r) for r in company_pairs(df.unionByName(spark.createDataFrame([(other, "d")], "company string, root string"))).collect()}
    assert not any(other in p for p in two) and not any(f"{a}{b}" in p for p in two)
    assert company_pairs(df.limit(0)).count() == 0


def test_company_names_of_one_word(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "ra", "zo", "ne"]) for _ in range(4)).capitalize()
    names = [f"{word()} {word()} {rng.choice(['Optics', 'Marine', 'Logistics'])}" for _ in range(80)]
    # one word, with or without a trade, misspelt; a full name with its misspelt word and its misspelt glued form; an initial
    groups = [["Vexaquilon Inc", "VEXAQUILON", "The Vexaquilon", "Vexaqilon Inc."], ["Dwynfarth Logistics", "dwynfarth Logistics, Inc.", "Dwynfarth Logistcs", "Dwynfrath Logistics"], ["Ghostvik Yslanda Marine", "Ghostvik Yslanda Marine Inc", "Gohstvik", "GhostvikYslnda"], ["Q. Hurvanth Optics", "Q Hurvanth Optics Inc"]]
    df = spark.createDataFrame([(n,) for n in [*names, *itertools.chain(*groups), "Tarvek", "Tarvik"]], "company string")
    got = {tuple(r) for r in company_pairs(df).collect()}
    want = {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}
    assert want <= got
    # six letters are too few to be misspelt
    ours = {n for g in groups for n in g} | {"Tarvek", "Tarvik"}
    assert {p for p in got if set(p) & ours} == want


def test_doubtful_company_names(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "ra", "zo", "ne"]) for _ in range(4)).capitalize()
    names = [f"{word()} {word()} {t}" for t in ("Media", "Marine", "Optics", "Robotics") for _ in range(20)]
    # a word near to a trade is a misspelt trade only if the name isn't near to a full one
    groups = [["Megita Gabusa Optics", "MEGIA GABUSA"], ["Fulonq Marrine", "Fulonq Marine"], ["Zasidu Mevagu Robotics Ltd", "Zasiidu Mevagu Rootics"], ["Stagestu Kovesq Aviation", "STAGESTU KOVESQ", "Kovesq Stagestu"]]
    got = {tuple(r) for r in company_pairs(spark.createDataFrame([(n,) for n in [*names, *itertools.chain(*groups)]], "company string")).collect()}
    ours = {n for g in groups for n in g}
    assert {p for p in got if set(p) & ours} == {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}


def test_segment_pairs_are_those_of_brute_force(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 12))) for _ in range(150)})
    df = spark.createDataFrame([(w,) for w in words], "s string")
    for tiers in ([(1, 1)], [(4, 1), (7, 2)]):
        edits = lambda n: max((e for least, e in tiers if n >= least), default=-1)  # noqa: E731,B023
        want = {(a, b) for a, b in itertools.combinations(words, 2) if 0 <= (e := edits(min(len(a), len(b)))) and plain_distance(a, b) <= e}
        assert want <= {(r.x, r.y) for r in segment_pairs(df, tiers).collect()}


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        last = row
    return last[-1]


def test_long_chains_reach_their_root(spark):
    chain = spark.createDataFrame([(f"k{i}", f"k{max(i - 1, 0)}") for i in range(41)], "key string, root string")
    assert {r.root for r in _resolved(chain).collect()} == {"k0"}


PLACES = [C.Entry(1, ["Port Abelby"], ["NX", "Northax", "QQ", "Quellonia"]), C.Entry(2, ["Port Abelby"], ["SX", "Southax", "RR", "Rellonia"]), C.Entry(3, ["Corvholm", "The Gull"], ["NX", "Northax", "QQ", "Quellonia"]), C.Entry(4, ["Remote", "Anywhere"], weak=True), C.Entry(5, ["Saint Dørnby"], ["SX", "Southax", "RR", "Rellonia"])]
ROLES = [C.Entry(1, ["Data Engineer", "ETL Dev"]), C.Entry(2, ["Data Scientist"]), C.Entry(3, ["Sales Manager"])]


def test_places_and_roles():
    p = C.Resolver(PLACES, C.PLACE_SHORT, C.PLACE_NOISE, True)
    cases = {"port abelby, northax": 1, "RR: Port Abelby": 2, "Port Ableby (Southax)": 2, "Corvholm": 3, "Hybrid - Corvhlm, QQ": 3, "The Gull!": 3, "remote": 4, "Remote / Corvholm": 3, "St. Dornby 12345": 5, "PortAbelby NX": 1, "Elsewhere": 0, "Lower Corvholm Xyz": 3, "": 0, "x" * 20000: 0}
    assert {v: p.resolve(v) for v in cases} == cases
    assert p.resolve("Port Abelby") == 0  # either is meant
    # a short first word stands for that of just one name of the list
    north = C.Resolver([C.Entry(1, ["North Bay"]), C.Entry(2, ["New Harbour"]), C.Entry(3, ["Lower Corvdale"])], C.PLACE_SHORT, C.PLACE_NOISE, True)
    assert [north.resolve(v) for v in ("N Bay", "n. harbour", "Lwr Corvdale", "S Bay")] == [1, 2, 3, 0]
    r = C.Resolver(ROLES, C.ROLE_SHORT, C.ROLE_NOISE)
    cases = {"Senior data enginer (all genders)": 1, "Engineer, Data": 1, "ETL dev": 1, "Sales Mgr.": 3, "Florist": 0, "Sr Dtaa Scientist II": 2, "Data": 0}
    assert {v: r.resolve(v) for v in cases} == cases


def test_canonical_values(spark):
    df = spark.createDataFrame([(1, "Corvholm", None, "x"), (1, "Corvholm", "MISSING", "x"), (2, " ", "florist", "x")], "job_row_id long, location string, role string, field_name string")
    fields = {"location": (PLACES, C.PLACE_SHORT, C.PLACE_NOISE, True), "role": (ROLES, C.ROLE_SHORT, C.ROLE_NOISE)}
    assert sorted(tuple(r) for r in C.canonical_values(df, "job_row_id", fields).collect()) == [(1, "location", 3), (1, "location", 3), (2, "role", 0)]
    assert {r.ref_id for r in C.canonical_values(df, "job_row_id", {"location": ([], {}, set())}).collect()} == {0}
