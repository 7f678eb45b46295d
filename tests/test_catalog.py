from decimal import Decimal

import pytest

from lavka.functions.cards import card_columns
from lavka.operators import catalog, changes, names


def ids(rows):
    return [r.product_id for r in rows.collect()]


@pytest.mark.parametrize("options, expected", [
    ({}, [1, 2, 3, 4, 5]),
    ({"order": "asc"}, [1, 2, 3, 5, 4]),  # a missing stock is last ...
    ({"order": "desc"}, [4, 3, 5, 1, 2]),  # ... and first
    ({"text": "kari"}, [1, 4, 5]),
    ({"text": " ТУФЛИ "}, [2]),
    ({"text": "обувь"}, [2, 4]),
    ({"text": "%"}, [1, 2, 3, 4, 5]),
    ({"text": "%", "literal": True}, [3]),
    ({"text": "a_b"}, [3]),
    ({"text": "_", "literal": True}, [3]),
    ({"text": "k\\s", "literal": True}, [4]),
    ({"text": "back\\\\s"}, [4]),
    ({"text": "  "}, [1, 2, 3, 4, 5]),
    ({"supplier": "Alfa"}, [1, 4]),
    ({"supplier": "Beta"}, []),  # stored with blanks, compared exactly
    ({"supplier": ""}, [1, 2, 3, 4, 5]),
    ({"supplier": "Alfa", "text": "copy", "order": "desc"}, [4]),
])
def test_list(catalog_shop, options, expected):
    assert ids(catalog.list_catalog(*catalog_shop, **options)) == expected


def test_lookup(spark, catalog_shop):
    assert ids(catalog.product_by_id(*catalog_shop, 3)) == [3]
    assert ids(catalog.product_by_id(*catalog_shop, 9)) == []
    keys = spark.createDataFrame([(3,), (3,), (9,), (1,)], "product_id long")
    assert sorted(ids(catalog.products_by_id(*catalog_shop, keys))) == [1, 3]


def test_cards(catalog_shop):
    cards = {r.product_id: r for r in card_columns(catalog.catalog_rows(*catalog_shop)).collect()}
    assert [cards[i].highlight for i in range(1, 6)] == [
        "big_discount", "out_of_stock", "plain", "out_of_stock", "plain"]
    assert cards[1].price_label == "Цена: 100.00 80.00 руб." and cards[1].discount_label == "20 %"
    assert cards[3].price_label == "Цена: 10.01 руб." and cards[3].discount_label == "—"
    assert cards[4].price_label == "Цена: 0.00 руб." and cards[4].stock == 0
    assert cards[1].header == "Boots | Red boots" and cards[3].header == "100% wool"
    assert (cards[2].manufacturer, cards[3].manufacturer, cards[3].supplier) == (" ", "—", "—")
    assert (cards[2].description, cards[5].description, cards[4].unit) == ("—", "—", "—")
    assert (cards[4].photo, cards[1].colour) == ("picture.png", "#2E8B57")
    assert cards[5].net_price == Decimal("0.97")


def test_name_lists(shop):
    listed = names.name_list(shop["suppliers"], "supp_id", "supp_name").collect()
    assert [r[0] for r in listed] == [" Beta ", "Alfa", "Alfa", None]
    makers = names.manufacturer_names(shop["products"]).collect()
    assert [r[0] for r in makers] == ["Kari", "kari"]
    assert [r[0] for r in names.pickup_list(shop["pickup_points"]).collect()] == [1, 2]


def test_collation_is_linguistic_on_request(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "A"), (3, "a"), (4, "B")], "id long, name string")
    assert [r[0] for r in names.name_list(rows, "id", "name").collect()] == ["A", "B", "a", "b"]
    by_language = [r[0] for r in names.name_list(rows, "id", "name", "UNICODE").collect()]
    assert [n.lower() for n in by_language] == ["a", "a", "b", "b"]


def test_change_feed(spark):
    before = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", 3)], "k long, x string, y int")
    after = spark.createDataFrame([(1, "a", 5), (2, None, 2), (4, "d", 4)], "k long, x string, y int")
    feed = changes.change_feed(before, after, "k").collect()
    assert sorted(map(tuple, feed)) == [(1, "changed", "y"), (3, "removed", ""), (4, "added", "")]


def test_search_stays_in_the_jvm_and_prunes(shop, catalog_shop):
    plan = catalog.list_catalog(*catalog_shop, text="kari")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_indexed_search_equals_the_scan(spark, catalog_shop):
    """Wildcards, escapes, Cyrillic, short patterns, empty columns; candidates are few and verified."""
    from lavka.operators import trigrams

    rows = catalog.catalog_rows(*catalog_shop)
    index = trigrams.trigram_index(rows)
    texts = [" boots", "BOO", "туфли", "Туф", "100%", "100% wo", "r_d b", "a_b", "back\\slash", "back\\\\slash", "zzz", "oo", " ",
             "kari", "Обувь", "шт.", "b%t", "Red%boots", "l\\%fa", "No art", "o article"]
    for text in texts:
        for literal in (False, True):
            found = trigrams.indexed_search(rows, index, text, literal)
            assert sorted(map(str, found.collect())) == sorted(map(str, catalog.search(rows, text, literal).collect())), text
    assert trigrams.pattern_runs(spark, "%Re_d%BOOTS\\%x%") == ["boo", "oot", "ots", "s%x", "ts%"]
    assert trigrams.pattern_runs(spark, "%ab%c_d%") == []
    assert trigrams.candidates(index, ["boo", "oot"]).count() >= 1
    assert trigrams.candidates(index, ["art", "icl", "rti"]).count() == 1
    plan = trigrams.candidates(index, ["boo"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(run), EqualTo(run,boo)]" in plan or "In(run, [boo])" in plan or "EqualTo(run,boo)" in plan
