from millrace.operators.packed import CLOSE, JOB_LISTS, KEYS, OPEN, WORDS, explode_packed, explode_texts

WORD_CASES = [
    (None, []),
    ("", []),
    ("  \n", []),
    ("[]", []),
    ("a, b;;c|d/e+f\tg、h；i j", list("abcdefghij")),
    ("['a', 'b, c', \"it's\"]", ["a", "b, c", "it's"]),
    ('["a", "feed \\"b\\""]', ["a", 'feed "b"']),
    ('["x\\u00e9\\ny"]', ["xé\ny"]),
    ('{a,"b, c"}', ["a", "b, c"]),
    ('"a, ""b""" ; c', ['a, "b"', "c"]),
    ('"", a, a', ["a", "a"]),
    (f'"{OPEN}0{CLOSE}",b', [f"{OPEN}0{CLOSE}", "b"]),
    (",".join(["w"] * 3000), ["w"] * 3000),
]
KEY_CASES = [
    ("a b|c d, x.y|z;apply:x.y|z\n", ["a b|c d", "x.y|z", "apply:x.y|z"]),
    ('k|a;"R;400";', ["k|a", "R;400"]),
    ("o'neil|a;d'or|b", ["o'neil|a", "d'or|b"]),
    ("'a;b';c", ["a;b", "c"]),
    (" ; a b ;\xa0; 'c' ;", ["a b", "c"]),
    ('x"a b"y;"open', ["xa by", '"open']),
]


def test_values(spark):
    for cases, delimiters in ((WORD_CASES, JOB_LISTS["evidence"]), (KEY_CASES, KEYS)):
        df = spark.createDataFrame([(i, "f", c[0]) for i, c in enumerate(cases)], "i int, f string, t string")
        rows = explode_texts(df, "f", "t", {"f": delimiters}).collect()
        for i, (text, want) in enumerate(cases):
            got = sorted((r.item_no, r.item_value) for r in rows if r.i == i)
            assert got == list(enumerate(want, 1)), text


def test_explode_numbers_items_and_ignores_other_columns(spark):
    df = spark.createDataFrame([(1, "a;b", None, "k|a", "z"), (1, None, None, None, "z")], "job_row_id long, seen_sources string, evidence string, block_key string, item_value string")
    rows = sorted(tuple(r) for r in explode_packed(df, "job_row_id", JOB_LISTS).collect())
    assert rows == [(1, "block_key", 1, "k|a"), (1, "seen_sources", 1, "a"), (1, "seen_sources", 2, "b")]
    assert explode_packed(df.limit(0), "job_row_id", JOB_LISTS).count() == 0


def test_long_quoted_spans(spark):
    mark = '"'
    rows = [(1, mark + "a" * 1_000_000 + mark + ",b"), (2, mark + "x" + '""' * 100_000 + "y" + mark + ",b"), (3, "'" + r"\'" * 50_000 + "q" + "',b"), (4, mark + "open " * 100_000), (5, mark + r"a\"" * 20_000 + mark + ";b")]
    df = spark.createDataFrame(rows, "job_row_id long, evidence string").selectExpr("*", "null as seen_sources", "null as block_key")
    got = {}
    for r in explode_packed(df.where("job_row_id <> 4"), "job_row_id", {"evidence": WORDS}).collect():
        got.setdefault(r.job_row_id, []).append(r.item_value)
    assert got[1] == ["a" * 1_000_000, "b"] and got[2] == ["x" + mark * 100_000 + "y", "b"] and got[3] == ["'" * 50_000 + "q", "b"] and got[5][-1] == "b"
    assert explode_packed(df.where("job_row_id = 4"), "job_row_id", {"evidence": WORDS}).count() == 100_000


def test_doubled_marks_at_the_end(spark):
    cases = {'"abc""': ["abc"], '"a""b""': ['a"b'], '"a"",""b",c': ['a",""b'.replace('""', '"'), "c"], '""': [], '"" , x': ["x"]}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "job_row_id long, evidence string")
    got = {i: [] for i in range(len(cases))}
    for r in explode_packed(df, "job_row_id", {"evidence": WORDS}).orderBy("job_row_id", "item_no").collect():
        got[r.job_row_id].append(r.item_value)
    assert list(got.values()) == list(cases.values())
