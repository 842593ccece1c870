"""Template decontamination against an exact search and planted rephrasings."""

from loomseg.llm import decontaminate as dc

SF = "/root/testdata/sf0.001"
ITEM = "If Alice Smith buys 3 apples for $2 each and gives 3 of them away how much did Alice Smith pay in total for all of the fruit"


def _bare(text):
    return [w for w in (x.strip(".,!?;:|*#%&$\"'()").lower() for x in (text or "").split()) if w]


def test_finds_every_verbatim_passage_and_nothing_else(spark):
    docs = [(d.doc_id, _bare(d.text)) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [_bare(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for w in items:
        grams = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for d, words in docs:
            if len(grams & {tuple(words[i : i + 8]) for i in range(len(words) - 7)}) >= 0.3 * len(grams):
                want.add(d)
    assert want
    assert {r.doc_id for r in dc.op6_decontaminate(spark, SF).collect()} == want


def test_slots(spark, odd):
    texts = {
        1: "Intro here. " + ITEM + ". The end.",
        2: "So. " + ITEM.replace("Alice Smith", "Bob").replace("3", "14").replace("$2", "$7.50"),
        3: "So. " + ITEM.replace("buys 3", "buys 5").replace("gives 3", "gives 9"),
        4: ITEM.replace("apples", "pears").replace("fruit", "food").replace("away", "back").replace("much", "little").replace("each", "now"),
        5: None,
        6: "",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'x' AS h", "1 AS windows")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (None, "a b c d")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.rephrased for r in dc.contamination(docs, items, least=0.6).collect()}
    assert got == {(1, 7): False, (2, 7): True}
    kept = dc.drop_contaminated(docs, items, least=0.6)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert dc.contamination(odd, items).count() == 0
    assert dc.contamination(odd.limit(0), items).count() == 0 and dc.drop_contaminated(odd, items.limit(0)).count() == odd.count()


def test_items_of_few_literal_words(spark):
    sums, order, digits = "Compute 12 + 34 * 56 - 78 / 9", "Order 3 7 12 5 9 from 18 to 4", "31 41 59 26 53 58 97 93 23 84"
    mixed = "please add up all of these numbers and then tell me what comes out " + " ".join(map(str, range(100, 160)))
    texts = {
        1: f"so {sums} now",  # a capital inside a sentence is a name here: met by plain words
        2: "Well. Compute 5 + 6 * 7 - 8 / 10 now",
        3: f"so {order} now",
        4: "Well. Order 2 8 11 6 10 from 20 to 5 now",
        5: f"so {digits} now",
        6: "so 1 2 3 4 5 6 7 8 9 10 now",  # other values without a literal word: any list of numbers
        7: "please add up all of these numbers and then tell me what comes out of it",  # lead-in only
        8: mixed,
        9: "so too short now",
        10: "so Compute 5 + 6 of them",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, sums), (2, order), (3, digits), (4, mixed), (5, "too short"), (6, ""), (7, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.rephrased for r in dc.contamination(docs, items).collect()}
    assert got == {(1, 1): False, (2, 1): True, (3, 2): False, (4, 2): True, (5, 3): False, (8, 4): False, (9, 5): False}
