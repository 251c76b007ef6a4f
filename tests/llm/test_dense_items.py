"""Benchmark items of mostly numbers and names are searched too."""

from quern.llm.decontaminate import contaminated

ITEMS = {
    1: ("Anna Smith paid 12 dollars, Tom Brown paid 15 dollars, Eva Green paid 20 dollars.", "Lena Jones paid 3 dollars, Max White paid 4 dollars, Ida Black paid 7 dollars."),
    2: ("Compute 12 + 45 * 3 - 8 / 2 and round to 2.", "Compute 7 + 31 * 4 - 9 / 5 and round to 5."),
    3: ("Rank: Paris 2.1, London 8.9, Rome 2.8, Madrid 3.2, Oslo 0.7, Bonn 0.3", "Rank: Paris 1.4, Osaka 2.7, Nara 0.4, Kobe 1.5, Tokyo 13.9, Gifu 0.9"),
    4: ("Add 12 14 16 18", "add 2 4 6 8"),
}


def test_dense_items_are_found(spark):
    items = [(i, a) for i, (a, _) in ITEMS.items()] + [(5, "31 41 59 26 53 58 97 93 23 84")]
    docs = [(10 * i + k, f"Some words before it. {t} And some words that come after.") for i, pair in ITEMS.items() for k, t in enumerate(pair)]
    docs += [(50, "see 31 41 59 26 53 58 97 93 23 84 there"), (51, "see 1 2 3 4 5 6 7 8 9 10 there"), (60, "Compute 7 + 31 * 4 - 9 / 6 and round to 5."), (61, "They paid 12 dollars and Tom paid 15 dollars.")]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    rows = contaminated(d, b).collect()
    assert {(r["doc_id"], r["item_id"]): r["exact"] for r in rows} == {(10 * i + k, i): k == 0 for i in ITEMS for k in (0, 1)} | {(50, 5): True}
    assert len(rows) == 9 and all(0 < r["n_windows"] <= r["item_windows"] for r in rows)
