from rankloom.llm import truncated

WHOLE = [
    "The night crew documented the seed library because volumes had doubled, and the result was faster sign-off.",
    "We looked after the booking desk throughout the relocation.\n\nKind regards,\nAnn Lee",
    "- Suggests we hold until the budget is confirmed\n- Would fit the night crew in Oldenmere",
    "Bei uns wurde die Lagerzählung eingeführt, obwohl das Budget knapp war.",
]
CUT = {
    100: "The night crew documented the seed library because volumes had doub", 101: "The night crew documented the seed library because", 102: "The night crew documented the seed library because volumes...",
    103: "- Suggests we hold until the bud", 104: "Bei uns wurde die Lagerzählung eingeführt, obwohl das…", 105: "The night crew documented the seed lib�", 106: "The night crew documented the seed library because volumes   ",
}


def test_cut_texts(spark):
    rows = [(i * 4 + j, w) for i in range(12) for j, w in enumerate(WHOLE)] + list(CUT.items()) + [(200, None), (201, ""), (202, " \n\t "), (203, "负责仓库排班。"), (204, "x" * 100_000)]
    df = spark.createDataFrame([(a, b, "s%d" % (a % 2), "k") for a, b in rows], "doc_id bigint, text string, source string, evidence string")
    found = truncated.find_truncated(df)
    got = {r["doc_id"]: r["truncated"] for r in found.collect()}
    assert {k for k, v in got.items() if v} == set(CUT)
    assert not {200, 201, 202} & set(got) and {203, 204} <= set(got)
    share = {r["source"]: (r["n_docs"], r["n_truncated"]) for r in truncated.by_source(df, found).collect()}
    assert share["s0"][1] + share["s1"][1] == len(CUT) and share["s0"][0] + share["s1"][0] == len(got)
    assert truncated.find_truncated(df.where("false")).count() == 0
