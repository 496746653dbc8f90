import itertools

import pytest

from rankloom.llm import canon, names

SAME = [
    ["Bogdan Katherine Falifligick", "Falifligick, Bogdan", "Bgdan K. Falifligick", "BOGDAN KATHERINE FALIFLIGICC", "Falifligick, Bogdan, MSc", "Bogdan Falif-ligick", "Dr. Bogdan Falifligick"],
    ["Kidohoharn Staffing Ltd", "KIDOHOHARN STAFFING LIMITED", "Kidohoharn, Stffg. Ltd"],
    ["Zofia Linh Lizuxoteld", "z lizuxoteld", "Lizuxoteld, Zofia L", "Zofia Lizu xoteld"],
    ["Robert Hanszolt", "Bob Hanszolt", "HANSZOLT, ROB"],
    ["Zofia Kidohoharn", "Kidohoharn, Zofia"],
    ["Robert Hanszolt Jr"],
    ["Lucía Brantefeld", "Lucia Brantefeld"],
    ["Kidohoharn Talent Ltd"],
]


def test_entities(spark):
    rows = [(f"s{i}{j}", n) for i, g in enumerate(SAME) for j, n in enumerate(g)]
    rows += [("e1", ""), ("e2", None), ("e3", "N/A"), ("e4", "unknown"), ("s00", SAME[0][0])]
    df = spark.createDataFrame([(a, b, "k") for a, b in rows], "stem string, name string, entity string")
    ent = {r["stem"]: r["entity"] for r in names.link_names(df).collect()}
    assert set(ent) == {f"s{i}{j}" for i, g in enumerate(SAME) for j in range(len(g))}
    want = {tuple(sorted(p)) for i, g in enumerate(SAME) for p in itertools.combinations([f"s{i}{j}" for j in range(len(g))], 2)}
    got = {(r["a"], r["b"]) for r in names.linked_pairs(names.link_names(df)).collect()}
    assert got == want
    assert names.link_names(df.where("false")).count() == 0


def test_ambiguous_initials_stay_alone(spark):
    df = spark.createDataFrame([("a", "James Tolvarick"), ("b", "Joseph Tolvarick"), ("c", "J. Tolvarick"), ("d", "Tolvarick, J.")], "stem string, name string")
    assert {(r["a"], r["b"]) for r in names.linked_pairs(names.link_names(df)).collect()} == {("c", "d")}


def test_similar_tokens_find_all_single_edits(spark):
    words = ["falifligick", "falifligicc", "falfligick", "faliflgiick", "xfalifligick", "kidohoharn", "kidohaharn", "mokitarund"]
    from rankloom.functions.edits import edits

    got = {(r["a"], r["b"]) for r in names.similar_tokens(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got >= {tuple(sorted(p)) for p in itertools.combinations(words, 2) if edits(*p, 1) <= 1}


TERMS = [(t, t) for t in ("kiln planning", "kiln training", "fleet brokerage", "archive documentation", "inventory forecasting", "junodeck", "junopoint", "umbermesh")] + [("records training", "archive training"), ("archive training", "archive training"), ("jnd-pro", "junodeck")]


@pytest.mark.parametrize(
    "value,want",
    [
        ("KILN PLANNING", "kiln planning"), (" planning - kiln ", "kiln planning"), ("kin planing (3 yrs)", "kiln planning"), ("good fleet.brokerage v2", "fleet brokerage"), ("inv. fcst", "inventory forecasting"),
        ("archive docs", "archive documentation"), ("juno deck", "junodeck"), ("jnuodeck 2019", "junodeck"), ("urnberrnesh", "umbermesh"), ("Expert in records training", "archive training"), ("records documentation", "archive documentation"),
        ("JND-PRO", "junodeck"), ("kilnplanning,", "kiln planning"), ("documentation of archive", "archive documentation"),
        ("railway planning", ""), ("beekeeping", ""), ("misc", ""), ("???", ""), ("etc.", ""), ("x" * 20_000, ""),
    ],
)
def test_matches(value, want):
    assert canon.Index(TERMS).match(value)[0] == want


def test_match_values(spark):
    values = spark.createDataFrame([("Kiln planning",), ("Kiln planning",), (None,), ("  ",), (" ",), ("zzz",)], "entered string")
    terms = spark.createDataFrame([*TERMS, (None, "x")], "term string, canon string")
    assert {(r["entered"], r["match"]) for r in canon.match_values(values, terms).collect()} == {("Kiln planning", "kiln planning"), ("zzz", "")}
    assert [r["match"] for r in canon.match_values(values, terms.where("false")).where("entered = 'zzz'").collect()] == [""]
    assert canon.match_values(values.where("false"), terms).count() == 0


def test_a_long_list_is_refused(spark, monkeypatch):
    monkeypatch.setattr(canon, "MOST_TERMS", 3)
    with pytest.raises(ValueError):
        canon.match_values(spark.createDataFrame([("a",)], "entered string"), spark.createDataFrame(TERMS, "term string, canon string"))


def test_common_tokens_still_make_candidates(spark, monkeypatch):
    # A limit of 1 stands for a table in which given and family names are in more classes than the limit.
    monkeypatch.setattr(names, "RARE", 1)
    group = ["Robert Nguyen", "Bob Nguyen", "Robret Nguyen", "Robert Nguyyen", "Nguyen, Rob"]
    other = ["Susan Nguyen", "Sue Nguyen", "Robert Hanszolt", "Susan Hanszolt", "S Hanszolt", "Robert Nguyen Jr"]
    df = spark.createDataFrame([(n, n) for n in group + other], "stem string, name string")
    got = {(r["a"], r["b"]) for r in names.linked_pairs(names.link_names(df)).collect()}
    want = [*itertools.combinations(group, 2), ("Susan Nguyen", "Sue Nguyen"), ("Susan Hanszolt", "S Hanszolt")]
    assert got == {tuple(sorted(p)) for p in want}


@pytest.mark.parametrize("rare", [0, 3, 200])
def test_candidates_hold_all_pairs_that_compare_takes(spark, monkeypatch, rare):
    import random

    monkeypatch.setattr(names, "RARE", rare)
    rng = random.Random(5)
    given, family = ["robert", "bobby", "rob", "r", "susan", "s", "eun", "xander", "alexander", "jr"], ["nguyen", "n", "thisefihhund", "kidohoharn", "li", "hanszolt"]

    def typo(w):
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeh") + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]]) or w
        return w

    made = [[typo(rng.choice(given)) for _ in range(rng.choice([0, 1, 1, 2]))] + [typo(rng.choice(family))] for _ in range(150)]
    made += [[typo(rng.choice(family)), *rng.choice([["staffing", "ltd"], ["talent"], ["stffng", "limited"], ["north", "search"]])] for _ in range(40)]
    made += [[m[0] + m[1], *m[2:]] for m in made[:20] if len(m) > 1]
    classes = {" ".join(sorted(t)): t for t in made}
    got = {(r["ka"], r["kb"]) for r in names.candidate_pairs(spark.createDataFrame(list(classes.items()), "key string, tokens array<string>")).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(classes), 2) if names.compare(classes[a], classes[b], [1.0] * len(classes[a]), [1.0] * len(classes[b]))[0]}
    assert len(want) > 100 and got >= want


def test_similar_tokens_find_all_that_are_alike(spark):
    import random

    rng = random.Random(3)
    words = {"thisefihhund", "thisephihund", "bob", "bobby", "robert", "xander", "xanderxx", "benny", "lenny", "jim", "kim"}
    for w in ("thisefihhund", "lizuxot", "quorvan", "tolvarick", "w" * 20 + "kidohoharnfalifligickmok" * 2):
        for _ in range(40):
            x = w
            for _ in range(2):
                i = rng.randrange(len(x))
                x = rng.choice([x[:i] + x[i + 1 :], x[:i] + rng.choice("abc") + x[i:], x[:i] + rng.choice("abc") + x[i + 1 :], x[:i] + x[i : i + 2][::-1] + x[i + 2 :]])
            words.add(x)
    got = {(r["a"], r["b"]) for r in names.similar_tokens(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got == {p for p in itertools.combinations(sorted(words), 2) if names._alike(*p)}
    assert ("thisefihhund", "thisephihund") in got


def test_an_entry_behind_many_rivals_is_found():
    rivals = [f"documentation {w}" for w in "kit box bin map jam pen log bus gym hut oak yam zip web".split()]
    index = canon.Index([(t, t) for t in ("documentation telecommunications", *rivals)])
    place = [" ".join(index.terms[i][0]) for _, i in index.cosines(["documentation", "tcms"])].index("documentation telecommunications")
    assert place >= 12 and index.match("documentation tcms")[0] == "documentation telecommunications"
