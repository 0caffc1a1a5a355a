import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm.bpe import Encoder, encode_corpus, vocabulary_path
from millrace.llm.packing import best_two_fit, fill_report, pack_corpus
from millrace.llm.pieces import BLOCK, KINDS, Splitter, likenesses, split_corpus

TEXTS = [None, "", "  \n\n ", "Closed", "a" * 5000, "don't  stop\r\n\r\nnow", "‍😀é" * 30, "<|endoftext|>", "aaaaaa aaaa", "字" * 400, "One. Two! 三。四。\n" * 80, "word " * 2000]


@pytest.fixture(scope="module")
def enc():
    return Encoder(vocabulary_path())


def test_ids_are_those_of_the_public_library(enc):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    assert enc.encode(TEXTS) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_round_trip(texts):
    e = Encoder.__dict__.get("_shared") or Encoder(vocabulary_path())
    Encoder._shared = e
    for t, ids in zip(texts, e.encode(texts)):
        assert b"".join(e.bytes_of[i] for i in ids) == t.encode("utf-8", "surrogatepass")


def test_encode_corpus(spark, enc):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_corpus(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(TEXTS))] == enc.encode(TEXTS) and got[0] == [] and got[1] == [] and got[None] == enc.encode(["a"])[0]
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_containers_hold_each_item_once_within_capacity(sizes):
    bins = best_two_fit(sizes, 40)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 40 for b in bins)
    # no two containers but the last could be one
    fill = sorted(sum(sizes[i] for i in b) for b in bins)
    assert len(fill) < 3 or fill[1] * 2 > 40 - 1


def test_two_documents_replace_the_smallest():
    # greedy fills 60 + 35 and leaves 5; 20 + 19 fits the gap of 40 better than 35
    bins = best_two_fit([60, 35, 20, 19], 99)
    assert sorted(map(sorted, bins)) == [[0, 2, 3], [1]]


def test_pack_corpus(spark, enc):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + ["Closed"] * 30)], "doc_id long, text string")
    rows = pack_corpus(df.coalesce(2), "doc_id", "text", [(1, "byte_bpe_50k", 64), (2, "byte_bpe_50k", 1000)]).collect()
    size = {i: len(x) for i, x in enumerate(enc.encode(TEXTS + ["Closed"] * 30))}
    for b, cap in ((1, 64), (2, 1000)):
        mine = [r for r in rows if r.budget_id == b]
        load: dict = {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert max(load.values()) <= cap
        for d, n in size.items():
            own = sorted((r.piece_no, r.token_start, r.n_tokens) for r in mine if r.doc_id == d)
            assert sum(x[2] for x in own) == n and (n > cap or len(own) == 1)
            assert own[0][1] == 0 and all(p[1] + p[2] == q[1] for p, q in zip(own, own[1:]))
    assert pack_corpus(df.limit(0), "doc_id", "text", [(1, "byte_bpe_50k", 64)]).count() == 0


def test_fill_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "word " * rng.randrange(1, 90)) for i in range(600)], "doc_id long, text string")
    budgets = [(1, "byte_bpe_50k", 128), (2, "byte_bpe_50k", 2000)]
    for n in (1, 6, 24):
        for r in fill_report(pack_corpus(df.repartition(n), "doc_id", "text", budgets), budgets).collect():
            assert r.least <= r.containers and r.fill >= 0.98


def test_blocks_slide_over_the_text():
    rng = random.Random(5)
    bag = np.array([rng.choice([-1, 0, 1, 2, 3, 4, 9]) for _ in range(400)])
    like = likenesses(bag)
    for k in range(0, 401, 7):
        a, b = (Counter(x for x in part.tolist() if x >= 0) for part in (bag[max(0, k - BLOCK) : k], bag[k : k + BLOCK]))
        norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        assert abs(like[k] - (sum(a[w] * b[w] for w in a) / norm if norm else 0)) < 1e-9


def test_pieces_cover_the_text(spark, enc):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = split_corpus(df, "doc_id", "text", [(1, "byte_bpe_50k", 100, 20), (2, "byte_bpe_50k", 30, 0)]).collect()
    ids = enc.encode(TEXTS)
    for b, limit, overlap in ((1, 100, 20), (2, 30, 0)):
        for d, x in enumerate(ids):
            own = sorted((r for r in rows if r.budget_id == b and r.doc_id == d), key=lambda r: r.piece_no)
            if len(x) <= limit:
                assert not own
                continue
            assert own[0].token_start == 0 and own[-1].token_start + own[-1].n_tokens == len(x) and own[-1].ends_at == "text"
            assert [r.piece_no for r in own] == list(range(1, len(own) + 1)) and all(0 < r.n_tokens <= limit for r in own)
            assert all(p.token_start + p.n_tokens - q.token_start == overlap for p, q in zip(own, own[1:]))
            assert all(r.piece_text == b"".join(enc.bytes_of[i] for i in x[r.token_start : r.token_start + r.n_tokens]).decode("utf-8", "replace") for r in own)
    kinds = {r.doc_id: {q.ends_at for q in rows if q.doc_id == r.doc_id} - {"text"} for r in rows}
    assert kinds[4] == {"cut"} and kinds[10] <= {"line", "sentence"} and kinds[11] == {"word"} and set().union(*kinds.values()) <= set(KINDS)


def test_deepest_valley_is_chosen(enc):
    text = " ".join(["The red fox chases every rabbit around."] * 6 + ["Quarterly ledgers reconcile invoices against payments."] * 6)
    s = Splitter(enc, enc.encode_words([text])[0])
    first = next(s.pieces(80, 0))
    assert first[3].decode().endswith("around.") and first[3].decode().count("fox") == 6
