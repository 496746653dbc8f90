"""Job descriptions taken apart into weighted requirements, as one plan over their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators.ingest import keep_first, keywords_in
from rankloom.settings import DEFAULT, Settings

# Fixed values.
REQUIRED_HEAD = r"(?i)required|must[- ]have|essential|minimum|core (skills|requirements)|soft skills|what you.ll need|responsibilit|qualification|requirements"
PREFERRED_HEAD = r"(?i)preferred|nice[- ]to[- ]have|bonus|good[- ]to[- ]have|desirable|plus|optional|advantage|we.d love"
PREFERRED_LINE = r"(?i)\b(nice to have|preferred|bonus|a plus|optional|desirable|exposure to|familiarity with .{0,30}\bis a plus)\b"
REQUIRED_LINE = r"(?i)\b(must|required|essential|strong|proficien\w+)\b"
DUTY = r"(?i)responsibilit|what you.ll do|the role|day[- ]to[- ]day|duties"
QUALIFICATION = r"(?i)qualification|education|eligibilit|who (can|should) apply"
ROLE = r"(?i)\b(developer|engineer|intern|internship|manager|analyst|designer|scientist|architect|consultant|specialist|lead|associate|executive)\b"
OFFER = r"(?i)^(about|we are|company|benefits|perks|how to apply|location|stipend|salary|duration|apply)\b"


def visible_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) without the lines that hold any part of an HTML comment."""
    lines = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no")
    opened = F.sum(F.col("line").contains("<!--").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    closed = F.coalesce(F.sum(F.col("line").contains("-->").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("__in", opened > closed).where("not __in").drop("__in")


def requirements(texts: DataFrame, vocab: DataFrame, key: str = "jd_id", text: str = "text", s: Settings = DEFAULT) -> DataFrame:
    """(key, req_idx, req_id, text, kind, required, keywords, weight) of the bullets of each description.

    A header's class holds for the bullets under it: preferred is tried before required; a header of neither class leaves the last class, but then
    a bullet's own wording decides. Repeated bullets count once; other lines, short bullets and those on the offer are left out.
    """
    lines = visible_lines(texts, key, text).withColumn("t", F.trim("line"))
    plain = F.trim(F.regexp_replace("t", r"^[#*\s]+|[*:\s]+$", ""))
    caps = (F.upper(plain) == plain) & plain.rlike(r"\p{Lu}") & F.size(F.split(plain, r"\s+")).between(2, 5) & (plain.rlike(REQUIRED_HEAD) | plain.rlike(PREFERRED_HEAD) | plain.rlike(DUTY))
    header = F.col("t").startswith("#") | T.section_of(T.plain_header(F.col("t"))).isNotNull() | caps
    mode = F.when(plain.rlike(PREFERRED_HEAD), F.lit(False)).when(plain.rlike(REQUIRED_HEAD), F.lit(True))
    kind = F.when(plain.rlike(DUTY), "responsibility").when(plain.rlike(QUALIFICATION), "qualification").otherwise("skill")
    marked = lines.withColumn("h", F.coalesce(header, F.lit(False))).withColumn("m", F.when(F.col("h"), mode)).withColumn("x", F.when(F.col("h"), mode.isNotNull())).withColumn("k", F.when(F.col("h"), kind))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, d: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(d))
    state = marked.select(key, "line_no", "h", "t", last("m", True).alias("sect"), last("x", False).alias("explicit"), last("k", "skill").alias("kind"))
    body = T.without_bullet(F.col("t"))
    bullets = state.where(~F.col("h") & F.col("t").rlike(T.BULLET)).withColumn("text", body).where((F.length("text") >= 10) & ~F.col("text").rlike(OFFER))
    own = F.when(F.col("text").rlike(PREFERRED_LINE), False).when(F.col("text").rlike(REQUIRED_LINE), True).otherwise(F.col("sect"))
    once = keep_first(bullets.withColumn("required", F.when(F.col("explicit"), F.col("sect")).otherwise(own)), [key], "text", "line_no")
    n = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    rows = once.withColumn("req_idx", n - 1).withColumn("req_id", F.format_string("R%02d", n))
    words = keywords_in(rows, [key, "req_id"], "text", vocab)
    weight = F.when(F.col("required"), s.required_weight).otherwise(s.preferred_weight)
    return rows.join(words, [key, "req_id"], "left").select(key, "req_idx", "req_id", "text", "kind", "required", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), weight.alias("weight"))


def titles(texts: DataFrame, key: str = "jd_id", text: str = "text") -> DataFrame:
    """(key, title, company): the first two filled lines of the first twelve, swapped if only the second names a role; the key for want of a title."""
    lines = visible_lines(texts, key, text)
    w = Window.partitionBy(key).orderBy("line_no")
    top = lines.withColumn("__i", F.row_number().over(w)).where("__i <= 12").withColumn("t", F.trim(F.regexp_replace("line", "[#*]", ""))).where("t <> ''")
    two = top.withColumn("__j", F.row_number().over(w)).where("__j <= 2").groupBy(key).agg(F.max(F.when(F.col("__j") == 1, F.col("t"))).alias("a"), F.max(F.when(F.col("__j") == 2, F.col("t"))).alias("b"))
    swap = F.coalesce(F.col("b").rlike(ROLE) & ~F.col("a").rlike(ROLE), F.lit(False))
    part = lambda c: F.trim(F.split_part(c, F.lit("|"), F.lit(1)))
    out = two.select(key, part(F.when(swap, F.col("b")).otherwise(F.col("a"))).alias("title"), part(F.when(swap, F.col("a")).otherwise(F.coalesce("b", F.lit("")))).alias("company"))
    return texts.select(key).distinct().join(out, key, "left").select(key, F.coalesce("title", F.col(key).cast("string")).alias("title"), F.coalesce("company", F.lit("")).alias("company"))
