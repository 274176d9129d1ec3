import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from vacantia.llm import pii

from .conftest import EDGE_ROWS


def plain(text):
    """The patterns as they are stated, tried by the regex engine from left to right."""
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c in "0123456789"]
        total = sum(d if i % 2 == 0 else (2 * d if 2 * d < 10 else 2 * d - 9) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            spans.append(("phone", *m.span()))
    return spans


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-%+0129 ()٣\n", max_size=60))
def test_base_spans(text):
    assert sorted(pii.base_spans(text)) == sorted(plain(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111-1111 1111", "1.2.3.4", ".5", "+1 (555) 123-4567", "a.b@c-d.e", "@", "256", " ", "x"]), max_size=8))
def test_base_spans_of_joined_parts(parts):
    assert sorted(pii.base_spans("".join(parts))) == sorted(plain("".join(parts)))


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    rows = by_id(pii.personal_data(table).collect())
    for doc_id, text in texts.items():
        spans, row = plain(text), rows[doc_id]
        order = {"email": 0, "ip": 1, "card": 2, "phone": 3}
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]])))
        assert row["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(filter(None, row["spans"].split(",")))
        assert [row[f"n_{k}"] for k in order] == [sum(s[0] == k for s in spans) for k in order]


def test_contexts_find_identifiers_that_no_pattern_knows(make_documents):
    draw = random.Random(4)
    filler = "river stone green walk under light table seven morning paper".split()
    rows = []
    for i in range(40):
        before, after = (" ".join(draw.choices(filler, k=6)) for _ in range(2))
        rows.append((i, f"{before} please call +1 ({200 + i}) 555-{1000 + 37 * i} today {after}"))
    rows.append((100, "tomorrow please call 0172-5550-199 today or never"))
    rows.append((101, "the part 0172-5550-199 was sold and 9999-8888-777 too"))
    rows.append((102, "invoice number 7777-8888-999 of the year"))
    got = by_id(pii.personal_data(make_documents(rows)).collect())
    start = rows[40][1].index("0172")
    assert got[100]["spans"] == f"phone:{start}:{start + 13}" and got[100]["n_phone"] == 0
    assert got[101]["spans"] == "phone:9:22"  # the same identifier elsewhere
    assert got[102]["spans"] == ""
    assert all(got[i]["n_phone"] == 1 and got[i]["spans"].count(":") == 2 for i in range(40))


def test_learnt_identifiers_are_seeds_of_the_next_round(make_documents):
    rows = [(i, f"we say call me on +1 ({200 + i}) 555-{1000 + 37 * i} now please") for i in range(30)]
    # Known by the first context, these carry a second one, which then finds the last.
    rows += [(50 + i, f"we say call me on 0172-5550-1{i:02} now please") for i in range(10)]
    rows += [(70 + i, f"her line is 0172-5550-1{i:02} at home") for i in range(10)]
    rows.append((90, "her line is 0349-1234-567 at home"))
    one = by_id(pii.personal_data(make_documents(rows), rounds=1).collect())
    two = by_id(pii.personal_data(make_documents(rows), rounds=2).collect())
    assert one[55]["spans"] and one[75]["spans"] and not one[90]["spans"]
    assert two[90]["spans"] == "phone:12:25"


def test_edges(make_documents):
    rows = [*EDGE_ROWS, (None, "mail a@b.cd"), (8, "1.2.3.4 1.2.3.4"), (9, "9" * 100_000), (10, "@" * 50_000 + "a@" * 20_000)]
    got = pii.personal_data(make_documents(rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r["n_email"] for r in got if r["doc_id"] is None) == [0, 0, 1]
    assert by_id(got)[8]["spans"] == "ip:0:7,ip:8:15" and by_id(got)[9]["spans"] == ""
    assert by_id(got)[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(make_documents([])).collect() == []


def test_contexts_find_spaced_and_long_identifiers(make_documents):
    rows = [(i, f"so please call +1 ({200 + i}) 555-{1000 + 37 * i} today") for i in range(40)]
    rows += [(50 + i, f"write to box{i}@mail.example.org at once") for i in range(40)]
    long = "a" * 50 + "7@intranet"
    rows += [(100, "so please call 0172 5550 199 today"), (101, "so please call (0172) 5550 299 today")]
    rows += [(102, f"write to {long} at once"), (103, "tables 12 34 56 78 here")]
    got = by_id(pii.personal_data(make_documents(rows)).collect())
    assert got[100]["spans"] == "phone:15:28" and got[101]["spans"] == "phone:15:30"
    assert got[102]["spans"] == f"email:9:{9 + len(long)}" and got[103]["spans"] == ""


def test_rounds_go_on_while_they_add(make_documents):
    rows = [(i, f"chain zero +1 ({200 + i}) 555-{1000 + 37 * i} xzero") for i in range(160)]
    steps, sizes = ["zero", "one", "two", "three"], [60, 20, 7]
    for k, (one, two, size) in enumerate(zip(steps, steps[1:], sizes)):
        for i in range(size):
            number = f"0{k}72-5550-1{i:02}"
            rows += [(1000 + 100 * k + i, f"chain {one} {number} x{one}"), (2000 + 100 * k + i, f"chain {two} {number} x{two}")]
    rows.append((9000, "chain three 0349-1234-567 xthree"))
    three = by_id(pii.personal_data(make_documents(rows), rounds=3).collect())
    every = by_id(pii.personal_data(make_documents(rows)).collect())
    assert not three[9000]["spans"] and every[9000]["spans"] == "phone:12:25"
