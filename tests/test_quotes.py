import random
import unicodedata

import pytest

from folioquery import constants as K
from folioquery.operators import containment
from folioquery.operators.quotes import quotes
from folioquery.sources.tables import price_catalogue

PRICES = """categoria,servicio,paquete,precio_usd,modalidad,plazo_entrega,incluye
A,Poda de seto (hasta dos metros),U,desde 30,P,un día,"uno, dos"
A,Poda de árbol prolongada,U,desde 210,P,tres días,x
B,Césped en rollo,U,90,P,dos días,x
C,Riego (goteo),U,120,P,cuatro días,x
C,Pro,Q,310,P,una semana,x
D,Mantenimiento Lite,M,15,M,siempre,x
D,Mantenimiento Pro,M,25,M,siempre,x
E,Visita de jardinería,U,20,H,a convenir,x
E,Estanque,U,a convenir,P,un mes,x
"""
REQUESTS = "quote_id long, services array<string>, months int, plan string"


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("prices") / "prices.csv"
    path.write_text(PRICES, encoding="utf-8")
    return price_catalogue(spark, str(path)).cache()


def quote(spark, catalogue, *requests):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], REQUESTS)
    return [r for r in quotes(df, catalogue).orderBy("quote_id").collect()]


def test_catalogue_order(catalogue):
    rows = catalogue.orderBy("cat_ord").collect()
    assert [r.cat_ord for r in rows] == list(range(1, 10)) and rows[0].incluye == "uno, dos"


def test_quotes(spark, catalogue):
    tree, turf, folded, none, first, plans, nothing = quote(
        spark, catalogue,
        (["Poda de árbol prolongada"], 4, "Pro"), (["Césped en rollo"], 0, None),
        (["poda de seto", "VISITA DE JARDINERIA"], -1, "Pro"),
        (["piscina"], 2, "Oro"), (["Pro", "quiero riego (goteo) en casa", ""], 0, None), ([], 2, None), (None, 0, None))
    assert tree.lines[0].price == 210 and tree.maintenance.total == 100 and tree.total == 310
    assert tree.subtotal == 210 and tree.note == K.FROM_PRICE_NOTE and tree.payment_terms == K.PAYMENT_TERMS
    assert (turf.total, turf.maintenance, turf.note, turf.unmatched) == (90, None, None, None)
    assert (folded.total, len(folded.lines), folded.maintenance) == (50, 2, None)
    assert (none.total, none.lines) == (0, [])
    assert none.unmatched == ["piscina", "Mantenimiento Oro"]
    # The first entry in file order wins, also for a short name inside a longer word and for an empty request.
    assert [x.price for x in first.lines] == [210, 120, 30]
    assert (plans.subtotal, plans.total, plans.maintenance.plan) == (0, 50, "Mantenimiento Pro")
    assert (nothing.lines, nothing.total, nothing.unmatched) == ([], 0, None)


def test_names_in_letters_that_come_apart(spark):
    cat = spark.createDataFrame([(1, "한국 정원", "7", "d"), (2, "ൊ x", "8", "d")],
                                "cat_ord long, servicio string, precio_usd string, plazo_entrega string")
    hangul, malayalam = quote(spark, cat, (["하"], 0, None), (["ാ x"], 0, None))
    assert (hangul.total, malayalam.total) == (7, 8)


def test_quotes_read_the_catalogue_a_few_times_only(spark, catalogue):
    df = quotes(spark.createDataFrame([(1, ["Pro"], 1, "Pro")], REQUESTS), catalogue)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") <= 15


def test_containment_against_all_pairs(spark):
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abÁ ") for _ in range(n))
    names = [word(rnd.randrange(1, 9)) for _ in range(60)]
    asked = [word(rnd.randrange(0, 14)) for _ in range(200)]
    rows = [(i, name, "1", "d") for i, name in enumerate(names)]
    cat = spark.createDataFrame(rows, "cat_ord long, servicio string, precio_usd string, plazo_entrega string")
    got = quotes(spark.createDataFrame([(i, [a], 0, None) for i, a in enumerate(asked)], REQUESTS), cat).collect()
    for r in got:
        want = next((n for n in names if fold(asked[r.quote_id]) in fold(n) or fold(n) in fold(asked[r.quote_id])), None)
        assert (r.lines[0].service if r.lines else None) == want


def test_price_that_is_no_number_fails(spark):
    cat = spark.createDataFrame([(1, "x", "a convenir", "d")],
                                "cat_ord long, servicio string, precio_usd string, plazo_entrega string")
    df = spark.createDataFrame([(1, ["x"], 0, None)], REQUESTS)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        quotes(df, cat).collect()
    assert quotes(df, cat, strict=False).first().lines[0].price is None


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_automaton_and_joins_find_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(containment, "AUTOMATON_BYTES", limit)
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abñ ") for _ in range(n))
    names = {word(rnd.randrange(1, 6)) for _ in range(60)} | {""}
    asked = {word(rnd.randrange(0, 25)) for _ in range(80)} | {"", "zzz"}
    name_rows = spark.createDataFrame([(n, i) for i, n in enumerate(sorted(names, key=hash))], "name string, ord long")
    got = containment.first_contained(spark.createDataFrame([(a,) for a in asked], "request string"), name_rows.where("name <> ''"))
    order = {r.name: r.ord for r in name_rows.collect() if r.name}
    want = {(a, min(o for n, o in order.items() if n in a)) for a in asked if any(n in a for n in order)}
    assert {tuple(r) for r in got.collect()} == want
    only_empty = containment.first_contained(spark.createDataFrame([("x",), ("",)], "request string"), name_rows.where("name = ''"))
    assert {r.request for r in only_empty.collect()} == {"x", ""}
    assert containment.first_contained(spark.createDataFrame([("x",)], "request string"), name_rows.limit(0)).collect() == []
