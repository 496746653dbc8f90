"""Problem 4: variant spellings of names that stand for the same person or agency.

Names are brought to a class key (case, accents, titles, order and punctuation away). Similar tokens are found by a prefix-filtered join
of their q-grams, whose prefixes are long enough that none within the edits the comparison allows is missed. Classes that share an equal or
similar token are candidates, those that share a common one if another token agrees as well; a soft token
similarity, in which rare tokens weigh more, verifies them. Links between full names form components; names with a mere
initial join a component only if no other fits.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.edits import edits
from rankloom.operators.components import connected_components
from rankloom.session import cut, spread, stored

#: Letters of a q-gram: with 3 the shortest tokens that are allowed one edit or two have to share a q-gram still.
Q = 3
#: Tokens in more name classes than this bring together only names whose other tokens are alike, too.
RARE = 200
LEAST_SCORE = 0.6

# Fixed values.
_FILLERS = frozenset("- -- ? ??? n/a na nil none null unknown anonymous applicant candidate name tbd test xxx".split()) | {"not given", "no name", "not provided", "see cv", "on request"}
_TITLES = frozenset("dr prof mr mrs ms miss mx sir herr frau mme mlle sr sra dipl ing msc bsc ma ba mba phd md meng beng mphil llm".split())
_LEGAL = frozenset("ltd limited gmbh inc llc plc sa ag bv co corp corporation company".split())
_TRADES = ("staffing", "recruitment", "recruiting", "talent", "personnel", "agency", "resourcing", "search", "partners", "people", "consulting", "services", "group", "solutions", "jobs")
_NICKNAMES = {
    n: full
    for full, short in {
        "alexander": "alex sandy xander", "aleksandra": "ola sasha", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "charles": "chuck charlie chas",
        "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "deb debbie debby", "edward": "ed eddie ted teddy ned", "elizabeth": "liz beth betty eliza lizzie betsy libby",
        "francesca": "fran franca", "frederick": "fred freddie freddy", "gabriela": "gabi gaby", "geoffrey": "geoff jeff", "gregory": "greg", "guadalupe": "lupe lupita",
        "ignacio": "nacho", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hannes jo hans", "joseph": "joe joey jos", "katherine": "kate kathy katie kat kathie",
        "leonard": "len lenny leo", "margaret": "maggie meg peggy marge", "matthew": "matt matty", "michael": "mike mick mickey", "nicholas": "nick nicky", "patricia": "pat patty trish tricia",
        "philippa": "pippa pip", "rebecca": "becky becca", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie", "ronald": "ron ronnie", "samuel": "sam sammy",
        "stephen": "steve stevie", "susan": "sue susie suzie", "theodore": "theo", "thomas": "tom tommy", "tomasz": "tomek", "valentina": "val", "victoria": "vicky tori vicki", "wilhelmina": "mina minnie willa",
        "william": "bill will billy willy liam", "zofia": "zosia", "yusuf": "yus", "dmitri": "dima mitya", "francisco": "paco pancho", "david": "dave davy", "jonathan": "jon", "timothy": "tim", "peter": "pete", "kenneth": "ken", "lawrence": "larry", "donald": "don", "gerald": "gerry jerry", "raymond": "ray", "dorothy": "dot dottie", "barbara": "barb babs", "catherine": "cathy cate",
    }.items()
    for n in short.split()
}

_FULL = frozenset(_NICKNAMES.values())


def plain(text: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in s if not unicodedata.combining(c)).translate(str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "’": "'", "­": ""}))


def tokens_of(name: str | None) -> list[str]:
    """Tokens of a name, given names first where a comma tells; none for a filler. Hyphened parts become one token."""
    if name is None or plain(name).strip(" .,;") in _FILLERS:
        return []
    s = plain(unicodedata.normalize("NFKC", name))
    parts = [re.findall(r"[^\W\d_]+(?:[-'‐][^\W\d_]+)*", p) for p in s.split(",")]
    parts = [[re.sub(r"[-'‐]", "", w) for w in p] for p in parts]
    if not any(w in _LEGAL or _trade(w) for p in parts for w in p):
        parts = [[w for w in p if w not in _TITLES] for p in parts]
    parts = [p for p in parts if p]
    if len(parts) > 1 and parts[1] in (["jr"], ["sr"]):
        parts = [parts[0] + parts[1], *parts[2:]]
    words = [w for p in parts[1:] + parts[:1] for w in p] if len(parts) > 1 and not any(w in _LEGAL or _trade(w) for p in parts for w in p) else [w for p in parts for w in p]
    return words if sum(map(len, words)) > 1 else []


def _trade(word: str) -> str | None:
    """The trade word of agencies that a word is, in full or without vowels."""
    for t in _TRADES:
        if word == t:
            return t
        if len(word) >= 4 and t[0] == word[0] and len(word) < len(t):
            it = iter(t)
            if not set(word) & set("aeiou") and all(c in it for c in word):
                return t
    return None


def organisation(tokens: list[str]) -> bool:
    return any(t in _LEGAL for t in tokens) or any(_trade(t) for t in tokens[1:])


def _alike(a: str, b: str) -> float:
    """How well one token stands for another: 1 equal, less for nicknames, typos and initials, 0 not. Remembered, as tokens come again."""
    if a == b:
        return 1.0
    s = _compared.get((a, b))
    if s is None:
        if len(_compared) > 200_000:
            _compared.clear()
        s = _compared[a, b] = _likeness(a, b)
    return s


_compared: dict[tuple[str, str], float] = {}


def _likeness(a: str, b: str) -> float:
    if len(a) == 1 or len(b) == 1:
        return 0.7 if a[0] == b[0] else 0.0
    x, y = _NICKNAMES.get(a, a), _NICKNAMES.get(b, b)
    if x == y:
        return 0.9
    short = min(len(x), len(y))
    most = 0 if short < 3 else 1 if short < 7 else 2
    # A typo in a nickname still stands for the full name.
    d = min(edits(x, y, most), edits(a, y, most), edits(x, b, most), edits(a, b, most)) if most else 9
    return 1 - d / (short + 1) if d <= most else 0.0


def compare(a: list[str], b: list[str], wa: list[float], wb: list[float]) -> tuple[str, float]:
    """('full' | 'initial' | '', score) of two token lists with their weights.

    One pair of matching tokens, the heavier the better, is the family or firm name. What remains has to agree in order: the first
    given names, then the others as far as both have them.
    """
    (org, spans_a), (org_b, spans_b) = _prepared(a), _prepared(b)
    if org != org_b:
        return "", 0.0
    # A letter says little, however rare it is.
    wa, wb = ([1.0 if len(t) == 1 else v for t, v in zip(ts, ws)] for ts, ws in ((a, wa), (b, wb)))
    # A given name that is known by its nicknames can't outweigh a family name.
    wa, wb = ([min(v, max(ws) / 2) if t in _NICKNAMES or t in _FULL else v for t, v in zip(ts, ws)] for ts, ws in ((a, wa), (b, wb)))
    pivots = []
    for i, j, word in spans_a:
        for k, m, other in spans_b:
            # A token written apart on one side is compared as a whole, not one that is apart on both.
            if (j - i == 1 or m - k == 1) and abs(len(word) - len(other)) < 11 and (s := _alike(word, other)) > 0.75:
                x, y = max(wa[i:j]), max(wb[k:m])
                pivots.append((s * (max(x, y) if j - i == m - k else min(x, y)), i, j, k, m))
    best = ("", 0.0)
    for _, i, j, k, m in sorted(pivots, reverse=True):
        rest = a[:i] + a[j:], b[:k] + b[m:]
        heavy = max(max(wa[i:j]), max(wb[k:m])), min(max(wa[i:j]), max(wb[k:m]))
        kind, score = _firms(*rest) if org else _people(a, b, *rest, wa[:i] + wa[j:], wb[:k] + wb[m:], *heavy)
        if kind and score > best[1]:
            best = (kind, score)
    return best


def _prepared(tokens: list[str]) -> tuple[bool, list[tuple[int, int, str]]]:
    """Whether a name is a firm's, and its spans with their letters; remembered, as names are compared with many others."""
    key = " ".join(tokens)
    found = _known.get(key)
    if found is None:
        if len(_known) > 50_000:
            _known.clear()
        found = _known[key] = organisation(tokens), [(i, j, "".join(tokens[i:j])) for i, j in _spans(tokens)]
    return found


_known: dict[str, tuple[bool, list[tuple[int, int, str]]]] = {}


def _spans(tokens: list[str]) -> list[tuple[int, int]]:
    """Tokens and pairs of neighbours of four letters or more; those that part the generations aren't among them."""
    return [(i, j) for i in range(len(tokens)) for j in (i + 1, i + 2) if j <= len(tokens) and sum(map(len, tokens[i:j])) > 3 and not {"jr", "sr"} & set(tokens[i:j])]


def _firms(ra: list[str], rb: list[str]) -> tuple[str, float]:
    """Firms of like names have to be in the same trade."""
    ta, tb = ({_trade(w) or w for w in r if w not in _LEGAL} for r in (ra, rb))
    ok = ta == tb or (len(ta) == len(tb) == 1 and _alike(*ta, *tb) > 0.7)
    return ("full", 1.0) if ok else ("", 0.0)


def _people(a, b, ra, rb, va, vb, base: float, floor: float) -> tuple[str, float]:
    """What remains beside the family names ``ra`` and ``rb`` with weights ``va`` and ``vb``; base and floor: weights of the latter."""
    if any((t in ra) != (t in rb) for t in ("jr", "sr")):
        return "", 0.0
    (ra, va), (rb, vb) = _given(ra, va), _given(rb, vb)
    if not ra or not rb:
        return ("full", 1.0) if not ra and not rb else ("", 0.0)
    got = lost = 0.0
    first = _alike(ra[0], rb[0]) > 0.75
    for n, (x, y) in enumerate(zip(ra, rb)):
        s = _alike(x, y)
        # Unless the first given names agree, an initial stands for none that weighs as much as the family name, if another could be left.
        sure = first or len(x) == 1 and _is_initial(a) or len(y) == 1 and _is_initial(b)
        if s == 0.0 or (s == 0.7 and max(va[n], vb[n]) > floor and not sure):
            return "", 0.0
        got += s * max(va[n], vb[n])
        lost += (1 - s) * max(va[n], vb[n])
    if not first and any(v > floor for v in (*va[len(rb) :], *vb[len(ra) :])):
        return "", 0.0
    lost += 0.5 * (sum(va[len(rb) :]) + sum(vb[len(ra) :]))
    score = (base + got) / (base + got + lost)
    if score < LEAST_SCORE:
        return "", score
    return ("initial" if _is_initial(a) or _is_initial(b) else "full"), score


def _given(words: list[str], weights: list[float]) -> tuple[list[str], list[float]]:
    kept = [(w, v) for w, v in zip(words, weights) if w not in ("jr", "sr")]
    return [w for w, _ in kept], [v for _, v in kept]


def _classes(names: DataFrame, name: str) -> DataFrame:
    """(name, key, tokens) of the distinct names that aren't fillers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n in batch["__name"]:
                t = tokens_of(n)
                if t:
                    out.append((n, ("o " if organisation(t) else "p ") + " ".join(sorted(t)), t))
            yield pd.DataFrame(out, columns=["__name", "key", "tokens"])

    return names.select(F.col(name).alias("__name")).where(F.col(name).isNotNull()).distinct().mapInPandas(run, "__name string, key string, tokens array<string>")


def _edits_allowed(word: str) -> int:
    """Edits and swaps that ``_alike`` allows a token at most; a nickname those of its full name."""
    n = max(len(word), len(_NICKNAMES.get(word, word)))
    return 0 if n < 3 else 1 if n < 7 else 2


def _grams(word: str) -> list[str]:
    """The q-grams of a word with its ends marked, each with a number if it comes again, so that they form a set."""
    marked = "^" * (Q - 1) + word + "$" * (Q - 1)
    seen: Counter = Counter()
    out = []
    for i in range(len(word) + Q - 1):
        g = marked[i : i + Q]
        out.append(f"{g}{seen[g] or ''}")
        seen[g] += 1
    return out


def _signatures(ordered: list[str], most: int) -> list[str]:
    """Keys of a set of q-grams, rarest first: two sets whose words are up to ``most`` edits or swaps apart have one in common.

    An edit changes up to Q q-grams and a swap Q + 1, so all but ``most`` * (Q + 1) are shared, and two of the rarest ``most`` * (Q + 1) + 2 of
    each side, too. Each two of them make a key; where only one has to be shared, words of equal length, each one does as well.
    """
    spare = most * (Q + 1)
    prefix = ordered[: spare + 2]
    out = ["".join(p) for p in combinations(sorted(prefix), 2)]
    return out + prefix if len(ordered) < spare + 2 else out


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """(a, b, alike), a < b, of all tokens that ``_alike`` takes for one another; of those with ``one`` false, if given, none among themselves.

    A prefix-filtered set-similarity join: q-grams are put in order of their frequency among the tokens, each token posts keys made of its
    rarest ones, and tokens with a common key and fitting lengths are compared.
    """

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(form, t, o, g) for t, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for form in sorted({t, _NICKNAMES.get(t, t)}) for g in _grams(form)]
            form, token, one, gram = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(form, pa.string()), pa.array(token, pa.string()), pa.array(one, pa.bool_()), pa.array(gram, pa.string())], names=["form", "token", "one", "gram"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for form, t, o, grams in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n, most = len(form), max(_edits_allowed(t), _edits_allowed(form))
                rows += [(k, t, o, n) for k in _signatures([g["gram"] for g in grams], most)]
            key, token, one, n = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(token, pa.string()), pa.array(one, pa.bool_()), pa.array(n, pa.int32())], names=["key", "token", "one", "n"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, b, s) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (s := _alike(a, b)) > 0]
            a, b, s = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(s, pa.float64())], names=["a", "b", "alike"])

    words = tokens if "one" in tokens.columns else tokens.select("token", F.lit(True).alias("one"))
    apart = stored(spread(words.where("length(token) > 1").select("token", "one")).mapInArrow(take_apart, "form string, token string, one boolean, gram string"))
    common = apart.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = apart.join(common, "gram").groupBy("form", "token", "one").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    index = ordered.mapInArrow(post, "key string, token string, one boolean, n int")
    index = stored(index.select(F.xxhash64("key").alias("key"), "token", "one", "n"))
    a = index.where("one").select("key", F.col("token").alias("a"), F.col("n").alias("na"))
    b = index.select("key", F.col("token").alias("b"), "n", "one")
    met = a.join(b, "key").where("abs(na - n) <= 2 and (a < b or not one)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # A swap counts as two edits here; nicknames are compared by their full names.
    full = F.create_map(*[F.lit(x) for kv in _NICKNAMES.items() for x in kv])
    named = lambda c: F.coalesce(F.element_at(full, F.col(c)), F.col(c))
    short = F.least(F.length(named("a")), F.length(named("b")))
    bound = F.when(short < 7, 2).otherwise(4)
    near = lambda x, y: F.levenshtein(x, y, 4).between(F.lit(0), bound)
    nick = F.element_at(full, F.col("a")).isNotNull() | F.element_at(full, F.col("b")).isNotNull()
    met = met.where(nick | near(F.col("a"), F.col("b")))
    return stored(met.mapInArrow(verify, "a string, b string, alike double"))


def _places(tokens: list[str]) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, token, rest, one) of each token of a name that may be its family or firm name, and of neighbours run together.

    ``compare`` takes two names only if such tokens are alike, the kinds are equal and so are the rests or alike: of people the first
    token left, of firms the trade.
    """
    org = organisation(tokens)
    kind = "o" if org else "p" + "".join(t for t in ("jr", "sr") if t in tokens)
    for i, j in _spans(tokens):
        left = tokens[:i] + tokens[j:]
        rest = " ".join(sorted({_trade(w) or w for w in left if w not in _LEGAL})) if org else next((w for w in left if w not in ("jr", "sr")), "")
        yield kind, "".join(tokens[i:j]), rest, j - i == 1


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """(ka, kb), ka < kb, of the classes (key, tokens) that ``compare`` could take for one: none that it would take is left out.

    Classes that share an equal or similar token are paired. Where one of the two tokens is in more than RARE classes, the rests have
    to be alike as well, so that a hot name isn't paired with all others of that name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, *place) for k, t in zip(batch["key"], batch["tokens"]) for place in _places(list(t))]
            yield pd.DataFrame(out, columns=["key", "kind", "token", "rest", "one"])

    posts = cut(classes.select("key", "tokens").mapInPandas(run, "key string, kind string, token string, rest string, one boolean").distinct())
    words = posts.select("token", "one").unionByName(posts.where("length(rest) > 1 and instr(rest, ' ') = 0").select(F.col("rest").alias("token"), F.lit(True).alias("one")))
    words = words.groupBy("token").agg(F.max("one").alias("one"))
    near = similar_tokens(words)
    size = posts.groupBy("token").agg(F.count_distinct("key").alias("n"), F.max("one").alias("one"))
    hot = cut(size.where(F.col("n") > RARE).select("token"))

    # Two neighbours run together are compared with one token only.
    own = size.where("one").select(F.col("token").alias("a"), F.col("token").alias("b"))
    pivots = near.where("alike > 0.75").select("a", "b").unionByName(own)
    pivots = pivots.join(hot.select(F.col("token").alias("a"), F.lit(True).alias("ha")), "a", "left").join(hot.select(F.col("token").alias("b"), F.lit(True).alias("hb")), "b", "left")
    pivots = cut(pivots.select("a", "b", F.coalesce("ha", "hb", F.lit(False)).alias("hot")))
    left = posts.select(F.col("key").alias("ka"), F.col("token").alias("ta")).distinct()
    right = posts.select(F.col("key").alias("kb"), F.col("token").alias("tb")).distinct()
    cold = left.join(pivots.where("not hot"), F.col("ta") == F.col("a")).join(right, F.col("tb") == F.col("b")).where("a <> b or ka < kb").select("ka", "kb")

    # Tokens both ways, rests one way: of any two names one leads to the other.
    ways = pivots.where("hot").select("a", "b")
    ways = ways.unionByName(ways.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    rests = posts.select("rest").distinct()
    letters = rests.where("length(rest) > 1 and instr(rest, ' ') = 0").select("rest", F.substring("rest", 1, 1).alias("to"))
    alike = rests.select("rest", F.col("rest").alias("to")).unionByName(letters).unionByName(near.select(F.col("a").alias("rest"), F.col("b").alias("to")))
    spots = posts.select("kind", F.col("token").alias("a"), "rest").distinct().join(ways, "a").join(alike, "rest")
    there = posts.select("kind", F.col("token").alias("b"), F.col("rest").alias("to"), F.col("key").alias("kb"))
    # Only spots that meet another are joined with the names that stand there.
    spots = spots.join(there.select("kind", "b", "to").distinct(), ["kind", "b", "to"])
    here = posts.select("kind", F.col("token").alias("a"), "rest", F.col("key").alias("ka"))
    warm = spots.join(there, ["kind", "b", "to"]).join(here, ["kind", "a", "rest"]).select("ka", "kb")
    return cold.unionByName(warm).where("ka <> kb").select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).distinct()


def link_names(people: DataFrame, key: str = "stem", name: str = "name") -> DataFrame:
    """(``key``, name_class, entity): the spelling class of each row's name and the entity it belongs to.

    Names of one entity have the same ``entity``. Null, empty and filler names have no row; repeated rows count once; a
    key that stands under several names has a row for each. Extra columns are left out. An empty table gives an empty one.
    Equal spellings are one class throughout, however often they occur, so hot names cost nothing.
    """
    rows = people.select(F.col(key).alias("__key"), F.col(name).alias("__n")).where("__n is not null").distinct()
    known = cut(_classes(people, name))
    classes = cut(known.groupBy("key").agg(F.min("tokens").alias("tokens")))

    single = classes.select("key", F.explode(F.array_distinct("tokens")).alias("token"))
    df = single.groupBy("token").agg(F.count("*").alias("df"))
    total = F.lit(max(1, classes.count()))
    weights = single.join(df, "token").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("token", F.log(1 + total / F.col("df")).alias("w")))).alias("w"))
    full = cut(classes.join(weights, "key").withColumn("weights", F.expr("transform(tokens, t -> w[t])")).drop("w"))
    candidates = candidate_pairs(classes)
    fa = full.select(F.col("key").alias("ka"), F.col("tokens").alias("xa"), F.col("weights").alias("wa"))
    fb = full.select(F.col("key").alias("kb"), F.col("tokens").alias("xb"), F.col("weights").alias("wb"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ka, kb, xa, wa, xb, wb in batch[["ka", "kb", "xa", "wa", "xb", "wb"]].itertuples(index=False, name=None):
                kind, score = compare(list(xa), list(xb), list(wa), list(wb))
                if kind:
                    short = "a" if kind == "initial" and _is_initial(list(xa)) else "b"
                    both = kind == "initial" and _is_initial(list(xa)) and _is_initial(list(xb))
                    out.append((ka, kb, kind if kind == "full" else "both" if both else short, score))
            yield pd.DataFrame(out, columns=["ka", "kb", "kind", "score"])

    links = cut(candidates.join(fa, "ka").join(fb, "kb").mapInPandas(verify, "ka string, kb string, kind string, score double"))

    settled = connected_components(links.where("kind = 'full'").select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    settled = cut(settled)
    label = classes.select("key").join(settled.select(F.col("node").alias("key"), "component"), "key", "left").select("key", F.coalesce("component", "key").alias("component"))
    # A name with an initial belongs to the only component that fits it, if there is just one.
    mere = links.where("kind in ('a', 'b')").select(F.expr("if(kind = 'a', ka, kb)").alias("i"), F.expr("if(kind = 'a', kb, ka)").alias("f"))
    fits = cut(mere.join(label, F.col("f") == F.col("key")).groupBy("i").agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
    lone = links.where("kind = 'both'").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    taken = fits.select("i")
    lone = lone.join(taken, F.col("a") == F.col("i"), "left_anti").join(taken, F.col("b") == F.col("i"), "left_anti")
    extra = connected_components(lone).select(F.col("node").alias("n2"), F.col("component").alias("c2"))
    entity = (
        label.join(fits, F.col("key") == F.col("i"), "left")
        .join(extra, F.col("key") == F.col("n2"), "left")
        .select("key", F.coalesce(F.when(F.col("lo") == F.col("hi"), F.col("lo")), F.col("c2"), F.col("component")).alias("entity"))
    )
    named = rows.join(known.select("__name", F.col("key").alias("name_class")), F.col("__n") == F.col("__name"))
    out = named.join(entity, F.col("name_class") == F.col("key")).select(F.col("__key").alias(key), "name_class", "entity")
    return out.distinct()


def _is_initial(tokens: list[str]) -> bool:
    """Whether a name has no second token of more than one letter beside the family name."""
    return sum(len(t) > 1 and t not in ("jr", "sr") for t in tokens) < 2


def linked_pairs(entities: DataFrame, key: str = "stem") -> DataFrame:
    """(a, b), a < b, of the keys of one entity; as many rows as the result asks for."""
    one = entities.select(F.col(key).alias("a"), "entity").distinct()
    two = one.select(F.col("a").alias("b"), F.col("entity").alias("e2"))
    return one.join(two, (F.col("entity") == F.col("e2")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
