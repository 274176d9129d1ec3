import random

from vacantia.llm.decontaminate import WINDOW, canonical, contaminated

from .conftest import EDGE_ROWS

ITEM = "If Anna buys 12 apples for 3 dollars each then how much money does Anna pay in total"
OTHER = "which river runs through the old town before it reaches the wide northern sea at last"


def run(spark, make_documents, rows, items=((1, ITEM), (2, OTHER))):
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, text_key string")
    return {
        (r["doc_id"], r["item_id"]): r for r in contaminated(make_documents(rows), benchmark).collect()
    }


def test_copies_and_changed_values_are_found(spark, make_documents):
    changed = ITEM.replace("Anna", "Peter").replace("12", "7").replace("3 dollars", "45 euros")
    unequal = ITEM.replace("Anna", "Peter", 1).replace("12", "7")
    got = run(spark, make_documents, [
        (1, f"Some words before it. {ITEM}. And words after."), (2, f"Well. {changed} and so on"),
        (3, unequal), (4, "nothing of the kind stands in this text at all"),
        (5, OTHER.upper()), (6, OTHER[: len(OTHER) // 2]),
    ])
    assert set(got) == {(1, 1), (2, 1), (5, 2)}
    assert not got[1, 1]["reparameterised"] and got[2, 1]["reparameterised"]
    assert got[2, 1]["share"] == 1.0


def test_one_changed_word_breaks_five_windows(spark, make_documents):
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    text = " ".join(words)
    edited = " ".join([*words[:30], "changed", *words[31:]])
    twice = " ".join([*words[:15], "changed", *words[16:30], "again", *words[31:45], "more", *words[46:]])
    got = run(spark, make_documents, [(1, edited), (2, twice)], [(9, text)])
    assert {k: round(r["share"] * 56) for k, r in got.items()} == {(1, 9): 51}


def plain(rows, items):
    """Shares of windows by sets of canonical words, for texts without changed values."""
    def windows(text):
        parts = list(canonical([text]))
        if not parts:
            return set()
        joined, _, _, starts, ends, _, slots = parts[0]
        words = ["#" if s else joined[a:b].lower() for a, b, s in zip(starts, ends, slots)]
        made = [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
        return {w for w in made if sum(x != "#" for x in w) >= 3}

    of_items = {i: windows(t) for i, t in items}
    return {
        (d, i) for d, t in rows for own in [windows(t)] for i, w in of_items.items()
        if w and len(own & w) >= 0.8 * len(w)
    }


def test_given_tables_against_sets_of_windows(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(documents, benchmark).collect()}
    assert got == plain(rows, items) and len(got) > 10


def test_places_of_words_run_over_many_texts():
    draw = random.Random(5)
    texts = [" ".join(draw.choices(["on", "Off.", "12", "km", "", "3.5", "Ann"], k=draw.randint(0, 9))) for _ in range(50)]
    alone = [next(iter(canonical([t]))) for t in texts]
    joined, text, place, starts, ends, hashes, slots = next(iter(canonical(texts)))
    for i, (own, _, own_place, a, b, own_hashes, own_slots) in enumerate(alone):
        at = text == i
        assert place[at].tolist() == own_place.tolist()
        assert hashes[at].tolist() == own_hashes.tolist() and slots[at].tolist() == own_slots.tolist()
        assert [joined[x:y] for x, y in zip(starts[at], ends[at])] == [own[x:y] for x, y in zip(a, b)]


def test_edges(spark, make_documents):
    rows = [*EDGE_ROWS, (None, ITEM), (8, ITEM), (8, ITEM)]
    items = [(1, ITEM), (None, OTHER), (3, None), (4, ""), (5, "too short here"), (6, ITEM)]
    got = run(spark, make_documents, rows, items)
    assert set(got) == {(None, 1), (8, 1), (None, 6), (8, 6)}
    assert run(spark, make_documents, [], items) == {}
    assert run(spark, make_documents, rows, []) == {}


SOLD = (
    "Natalia sold clips to 48 of her friends in April, and then she sold half as many clips in May. "
    "Natalia then gave 5 clips away. How many clips are left in the box on her table"
)


def test_slots_hold_whatever_the_case_and_the_place_in_a_sentence(spark, make_documents):
    renamed = SOLD.replace("Natalia", "Peter")
    got = run(spark, make_documents, [
        (1, renamed), (2, SOLD.lower()), (3, SOLD.upper()), (4, renamed.lower().replace(" ", "\n")),
        (5, SOLD.replace("Natalia", "Mary Ann")), (6, renamed.replace("48", "twenty-five").replace("5", "six")),
        (7, SOLD.replace("Natalia", "McDonald")), (8, SOLD.replace("48", "several")),
        (9, " ".join(SOLD.split()[:12])),
    ], [(1, SOLD), (2, "Anna Maria Smith has sold two of them, but Anna kept the rest of the clips for later")])
    assert {d for d, i in got if i == 1} == {1, 2, 3, 4, 5, 6, 7, 8}
    assert all(got[d, 1]["share"] == 1 for d in (2, 3)) and got[8, 1]["share"] < got[1, 1]["share"]
    assert got[1, 1]["reparameterised"] and not got[3, 1]["reparameterised"]


def test_names_of_several_words_are_one_slot(spark, make_documents):
    item = "it is said that Anna Maria bought two hundred apples, then Anna Maria went to the old market"
    got = run(spark, make_documents, [
        (1, item.replace("Anna Maria", "Bob").replace("two hundred", "350")),
        (2, item.lower().replace("anna maria", "john smith")),
    ], [(1, item)])
    assert set(got) == {(1, 1), (2, 1)} and all(r["share"] == 1 for r in got.values())


def test_items_without_a_regular_window(spark, make_documents):
    items = [(1, "What is 12 + 35 - 7 * 4 ?"), (2, "小明有苹果。他吃了多少？"), (3, "Who wrote Hamlet?"), (4, "7 * 8 = ?")]
    got = run(spark, make_documents, [
        (1, "Now: what is 12 + 35 - 7 * 4 ? Well."), (2, "问题：小明有苹果。\n他吃了多少？好"), (3, "Tell me. Who wrote hamlet? I know"),
        (4, "First: 7 * 8 = 56"), (5, "what is 12 + 36 - 7 * 5 ?"), (6, "they who wrote Hamlet well"), (7, "小红有梨。她想要什么？"),
    ], items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4)} and not any(r["reparameterised"] for r in got.values())


def test_one_altered_value_costs_only_its_windows(spark, make_documents):
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    words[10] = words[40] = "1995"
    altered = " ".join([*words[:40], "1996", *words[41:]])
    roles = "she buys 3 apples at the market and then walks home for 3 days with all of them"
    got = run(spark, make_documents, [
        (1, altered), (2, roles.replace("3", "5", 1).replace("3", "4")),
    ], [(1, " ".join(words)), (2, roles)])
    assert set(got) == {(1, 1), (2, 2)} and all(r["share"] == 1 and r["reparameterised"] for r in got.values())


def test_windows_with_their_own_values_count_beside_inconsistent_names(spark, make_documents):
    item = "we know that Anna went to the old market and " + " ".join(OTHER.split()) + " where nobody ever saw that Anna again"
    got = run(spark, make_documents, [(1, item.replace("Anna", "Peter", 1))], [(1, item)])
    assert 0.8 <= got[1, 1]["share"] < 1
