"""Who a question is about, and a worded answer from the artifact's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import if_small


def resolve_names(questions: DataFrame, people: DataFrame, most: int = 6) -> DataFrame:
    """(question_id, key, name, score, pos): the people a question names.

    questions: (question_id, question), a few rows; people: (key, name). 3 for the whole name, 2 for two of its tokens of more than two letters,
    1 for the last alone; with a hit of 2 or more those of 1 are dropped. Each name once, the longest match first, then by key.
    """
    q = if_small(questions.select("question_id", F.lower("question").alias("__q")))
    p = people.where("name is not null and trim(name) <> ''").select("key", "name", F.lower("name").alias("__n"))
    tokens = F.filter(F.split("__n", r"\s+"), lambda t: F.length(t) > 2)
    j = p.withColumn("__t", tokens).join(q, F.expr("instr(__q, __n) > 0 or exists(__t, t -> instr(__q, t) > 0)"))
    present = F.filter("__t", lambda t: F.instr(F.col("__q"), t) > 0)
    j = j.withColumn("__p", present)
    score = F.when(F.instr("__q", F.col("__n")) > 0, 3).when(F.size("__p") >= 2, 2).when((F.size("__p") == 1) & (F.get("__p", F.lit(0)) == F.element_at("__t", -1)), 1)
    length = F.when(F.instr("__q", F.col("__n")) > 0, F.length("__n")).otherwise(F.aggregate("__p", F.lit(0), lambda a, t: a + F.length(t)))
    hit = j.withColumn("score", score).withColumn("__l", length).where("score is not null")
    best = hit.groupBy("question_id").agg(F.max("score").alias("__b"))
    kept = hit.join(best, "question_id").where("score >= 2 or __b < 2")
    once = kept.groupBy("question_id", "name").agg(F.min_by(F.struct("key", "score", "__l"), F.struct(-F.col("score"), -F.col("__l"), F.col("key"))).alias("f")).select("question_id", "name", "f.key", "f.score", "f.__l")
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("__l"), F.asc("key"))
    return once.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("question_id", "key", "name", "score", "pos")


def _cells(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("question_id", F.col("name").alias(f"{name}_name"), F.explode("evidence").alias("e")).select(
        "question_id", f"{name}_name", F.col("e.id").alias("id"), F.col("e.requirement").alias("requirement"), F.col("e.required").alias("required"), F.col("e.matched").alias(f"{name}_matched")
    )


def answers(questions: DataFrame, rows: DataFrame, most_differences: int = 5, board: int = 5) -> DataFrame:
    """(question_id, about, answer): about is the stems an answer is on, in order; of one cohort's artifact rows.

    Two or more people named: how the first two stand and where just one of them has evidence, required criteria first. One: how that one stands. None:
    the first ``board`` of the cohort. Questions are a few rows and are broadcast.
    """
    named = resolve_names(questions, rows.select(F.col("stem").alias("key"), "name")).where("pos <= 2").select("question_id", "key", "pos")
    met = rows.join(named, F.col("stem") == F.col("key"))
    number = lambda c: F.coalesce(F.col(c).cast("decimal(28,2)").cast("string"), F.lit("none"))
    standing = F.concat(
        F.col("name"), F.lit(" is number "), F.col("rank").cast("string"), F.lit(" with "), number("final_score"), F.lit(", meets "), F.col("required_coverage"), F.lit(" required criteria (keyword "),
        number("keyword_score"), F.lit(", semantic "), number("semantic_score"), F.lit(")."),
    )
    said = met.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pos", "stem", standing.alias("text")))).alias("s"))
    a, b = (_cells(met.where(F.col("pos") == n), x) for n, x in ((1, "a"), (2, "b")))
    apart = a.join(b.drop("requirement", "required"), ["question_id", "id"]).where("a_matched <> b_matched")
    w = Window.partitionBy("question_id").orderBy(F.desc_nulls_last("required"), F.asc("id"))
    only = F.when(F.col("a_matched"), F.col("a_name")).otherwise(F.col("b_name"))
    line = F.concat(F.when(F.col("required"), "required").otherwise("preferred"), F.lit(": "), F.coalesce("requirement", F.lit("")), F.lit(" (only "), only, F.lit(")"))
    lines = apart.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_differences).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("d"))
    entry = F.concat(F.lit("number "), F.col("rank").cast("string"), F.lit(" "), F.col("name"), F.lit(" ("), number("final_score"), F.lit(")"))
    first = rows.where(F.col("rank") <= board).agg(F.array_sort(F.collect_list(F.struct("rank", "stem", entry.alias("text")))).alias("t"))
    j = questions.select("question_id").join(said, "question_id", "left").join(lines, "question_id", "left").crossJoin(F.broadcast(first))
    text = lambda c, f, by: F.array_join(F.transform(c, lambda x: x[f]), by)
    people = F.concat(text("s", "text", " "), F.when(F.col("d").isNotNull(), F.concat(F.lit(" They differ in: "), text("d", "line", "; "), F.lit("."))).otherwise(F.lit("")))
    return j.select(
        "question_id", F.when(F.col("s").isNotNull(), F.transform("s", lambda x: x["stem"])).otherwise(F.transform("t", lambda x: x["stem"])).alias("about"),
        F.when(F.col("s").isNotNull(), people).otherwise(F.concat(F.lit("First are "), text("t", "text", "; "), F.lit("."))).alias("answer"),
    )
