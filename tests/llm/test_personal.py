import itertools

import pytest

from rankloom.llm import personal

FINDER = personal.Finder(set())


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("write to a.b+jobs@mail.example or A (at) mail.example", ["email", "email"]), ("x[at]mail[dot]test now", ["email"]), ("disp@tch schedule", []), ("Mentioned @nightshift in the thread", []),
        ("+44 (0)7700 900053", ["phone"]), ("call 020 7946 0812 or 030/23125-505", ["phone", "phone"]), ("(988) 555-0142, evenings", ["phone"]), ("509-555-0100 ext. 21", ["phone"]), ("01.99.00.15.44", ["phone"]), ("15515550139", ["phone"]),
        ("ID QQ 52 37 41 C", ["id"]), ("ZZ8258576 and KX-061-641-36", ["id", "id"]), ("666-55-2250", ["id"]), ("0399 8742 8529", ["id"]), ("00/643/98919", ["id"]), ("Insurance number X4 200 1074", ["id"]),
        ("batch 2097-67037 against revision 2.30.662", []), ("ticket 6450-11137", []), ("invoice run 13.69.2097", []), ("2014-2018", []), ("Saved 49,576 in 2019", []),
        ("at 121 Windle Road, Seraville, 19942", ["address"]), ("Flat 27, 156 Lantern Ave, Port Veyra", ["address"]), ("Hafenstraße 114, 38103 Port Veyra", ["address"]), ("196, avenue du Vieux Four, 33538 Riomanso", ["address"]),
        ("Calle del Molino 137, 2º B, 91708 Tallowby", ["address"]), ("lives in Port Veyra", []), ("Im Jahr 2012 und", []),
        ("Reported to Ms. Wekizavolt", ["name"]), ("S. Kuzexuheld's deputy", ["name"]), ("with Mekoyikost, Noor as mentor", ["name"]), ("Took over from Robert Wiyoxerund", ["name"]), ("the Robert Holdings", []), ("Deborah said so", []),
        ("", []), (None, []),
    ],
)
def test_find(text, kinds):
    assert [k for _, _, k in FINDER.find(text)] == kinds


def test_own_names():
    assert [k for _, _, k in FINDER.find("r  voblyjobund was here", ["R Voblyjobund"])] == ["name"]
    assert FINDER.find("Vobly Staffing Ltd was here", ["Vobly Staffing Ltd"]) == []


def test_long_text():
    assert FINDER.find("x" * 200_000) == [] and len(FINDER.find("call 020 7946 0812. " * 5000)) == 5000


S = personal.Surrogates(b"secret")


def test_coreference_and_form():
    full, swapped, short = S.name("James Smith"), S.name("SMITH, JAMES"), S.name("J. Smith")
    given, family = full.split()
    assert swapped == f"{family.upper()}, {given.upper()}" and short == f"{given[0]}. {family}"
    assert S.phone("+44 20 7946 0056")[-8:] == S.phone("020 7946 0056")[-8:]
    assert personal.plain_email(S.email("a.b[at]mail[dot]example")) == S.email("a.b@mail.example")
    assert S.email("A.B@MAIL.EXAMPLE").lower() == S.email("a.b@mail.example")
    assert S.name("Anna").endswith("a") and S.name("Иван Петров")[0] in "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ"
    assert personal.Surrogates(b"other").name("James Smith") != full


def test_numbers_stay_distinct():
    made = {S.digits(f"{i:04d}") for i in range(10_000)}
    assert len(made) == 10_000
    assert S.ident("QQ 52 37 41 C")[2] == " " and len({S.ident(f"QQ{i:06d}C") for i in range(2000)}) == 2000


def rows(spark, texts):
    return spark.createDataFrame([("unit", f"s{i}", i, t, None) for i, t in enumerate(texts)], "place string, stem string, pos int, text string, names string")


def test_mask(spark):
    df = rows(spark, ["Ask James Smith on 020 7946 0812.", "Smith, James again", None, "", "nothing here"])
    out = {r["pos"]: r["text"] for r in personal.mask(df, set(), b"k").collect()}
    assert out[2] is None and out[3] == "" and out[4] == "nothing here"
    s = personal.Surrogates(b"k")
    assert out[0] == f"Ask [NAME {s.name('James Smith')}] on [PHONE {s.phone('020 7946 0812')}]." and "Smith" not in out[1]
    assert {(r["pos"], r["kind"]) for r in personal.places(personal.find_items(df, set(), b"k")).collect()} == {(0, "name"), (0, "phone"), (1, "name")}
    assert personal.mask(df.where("false"), set(), b"k").count() == 0


def test_lines_and_spans(spark):
    text = "nothing\nAsk James Smith\n\nor a@mail.example"
    df = spark.createDataFrame([("raw_text", "s", None, text, None)] * 2, "place string, stem string, pos int, text string, names string")
    got = personal.find_items(df, set(), b"k").collect()
    assert [(r["pos"], [text.split("\n")[r["pos"] - 1][x["start"] : x["end"]] for x in r["items"]]) for r in got] == [(2, ["James Smith"]), (4, ["a@mail.example"])] * 2
    out = personal.mask(df, set(), b"k").distinct().collect()
    assert sorted(r["pos"] for r in out) == [1, 2, 3, 4]


def test_surrogates_are_distinct_in_the_end(spark):
    """One syllable leaves few surrogates, so many of 900 names collide, and some of those made anew do again."""
    family = [f"{a}{b}{c}{d}ward" for a, b, c, d in itertools.product("BDFGKL", "aeiou", "lmnrst", "aeiou")]
    df = rows(spark, [f"Ask James {n} now, {i} Oak Street" for i, n in enumerate(family, 1)])
    again, syllables = personal.distinct_surrogates(personal.find_items(df, set(), b"k"), b"k", 1)
    before, after = personal.Surrogates(b"k", None, 1), personal.Surrogates(b"k", again, syllables)
    assert len({before.token(n) for n in family}) < len(family) == len({after.token(n) for n in family})
    assert len({after.address(f"{i} Oak Street").lower() for i in range(1, len(family) + 1)}) == len(family)


def test_too_many_collisions_lengthen_the_names(spark, monkeypatch):
    monkeypatch.setattr(personal, "MOST_COLLISIONS", 3)
    df = rows(spark, [f"Ask James {a}{b}{c}ward now" for a, b, c in itertools.product("BDFGKLMNP", "aeiou", "lmnrst")])
    again, syllables = personal.distinct_surrogates(personal.find_items(df, set(), b"k"), b"k", 1)
    assert syllables > 1 and len(again) <= 3


def test_initials_are_a_permutation():
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщэюя"):
        assert sorted(S.initial(c) for c in alphabet) == sorted(alphabet)


def test_nicknames_stand_for_the_same_person():
    assert S.name("Bob Hanszolt") == S.name("Robert Hanszolt") and S.name("Liz Tarn").split()[0].endswith("a")


def test_key(spark, monkeypatch):
    monkeypatch.delenv("RANKLOOM_KEY", raising=False)
    one, two = (spark.createDataFrame([(x, None)], "stem string, name string") for x in "ab")
    assert personal.secret(spark, one) == personal.secret(spark, one) != personal.secret(spark, two)
    monkeypatch.setenv("RANKLOOM_KEY", "x")
    assert personal.secret(spark, one) == b"x"


def test_common_given_names(spark):
    df = spark.createDataFrame([(f"Karlotta Surname{i}",) for i in range(8)] + [(None,)], "name string")
    assert "karlotta" in personal.common_given_names(df)


ADDRESSES = (
    [f"12 Oak {w}" for w in "Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Close Boulevard Blvd Way Place Square Sq Terrace Crescent Row Walk Hill Parade Gardens Grove Mews Alley Quay".split()]
    + [f"12{gap}{w} Haute" for w in "rue avenue chemin place boulevard allée impasse quai route cours square passage".split() for gap in (", ", " ", "", " bis ", "ter")]
    + [f"Linden{w} 77" for w in "straße strasse str. weg allee gasse platz ufer damm ring steig markt".split()]
    + [f"{w} Mühle 5" for w in ("Am", "An der", "An den", "Im", "In der", "Auf der", "Auf dem", "Zum", "Zur", "Unter den", "Alte", "Neue", "Große", "Kleine")]
    + [f"{w} Mayor 12" for w in "Calle C/ Plaza Avda Avda. Avenida Paseo Camino Carretera Ronda Travesía Via Viale Piazza Corso".split()]
)


@pytest.mark.parametrize("form", ["{}", "lives ({})", "home:\n{}, 10117 Berlin"])
def test_quick_looks_let_every_form_of_address_through(form):
    texts = [form.format(a) for a in ADDRESSES]
    assert [t for t in texts if not personal._ADDRESS.search(t)] == []
    assert [t for t in texts if "address" not in {k for _, _, k in personal.Finder(set()).find(t)}] == []


@pytest.mark.parametrize(
    "text,kind",
    [("ref AB-12-345", "id"), ("A-12-34", "id"), ("ABC-1234-12-123", "id"), ("QQ\n523741C", "id"), ("ZZ123456", "id"), ("X4 200 107", "id"), ("123-45-6789", "id"), ("12/345/67890", "id"), ("0399 8742 8529", "id"), ("passport:123456", "id")]
    + [("+1 234 5678", "phone"), ("+12345678", "phone"), ("+1 (0) 2345678", "phone"), ("0012345678", "phone"), ("(123) 456 789", "phone"), ("012 345 678", "phone"), ("01 23 45 67 89", "phone"), ("123.456.7890", "phone"), ("12345678901", "phone")],
)
def test_quick_looks_let_the_shortest_numbers_through(text, kind):
    assert [k for _, _, k in personal.Finder(set()).find(text)] == [kind]
