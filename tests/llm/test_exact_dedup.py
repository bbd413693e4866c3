import numpy as np
from helpers import prose
from rillgraph.llm import exact_dedup as E


def test_against_brute_force(docs):
    r = np.random.default_rng(1)
    base = [prose(r, int(n)) for n in r.integers(1, 40, 60)]
    texts = [base[i] for i in r.integers(0, 60, 300)] + [t[:70] + "x" + t[71:] for t in base if len(t) > 72]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    want = {(i, first[t]) for i, t in enumerate(texts) if first[t] != i}
    assert {tuple(x) for x in E.duplicates(docs(texts)).collect()} == want
    assert {x.doc_id for x in E.exact_dedup(docs(texts)).collect()} == set(first.values())


def test_case_and_spaces_count(docs):
    assert E.duplicates(docs(["a b", "A b", "a  b", "a b "])).count() == 0


def test_odd(odd):
    out = E.exact_dedup(odd)
    assert out.columns == odd.columns
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=str)
    assert sum(t == "one two three" for _, t in got) == 1 and (6, "one two three") in got
    assert sum(t is None for _, t in got) == 2
    assert len(got) == 9 and all(x._key == "own" for x in out.collect())


def test_null_ids_of_one_text_leave_one_row(docs):
    assert E.exact_dedup(docs([(None, "a"), (None, "a"), (None, "b")])).count() == 2


def test_empty(empty):
    assert E.duplicates(empty).count() == 0 and E.exact_dedup(empty).count() == 0
