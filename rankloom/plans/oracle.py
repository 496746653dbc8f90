"""SQL of the queries that SQL can express, for DuckDB over views named as the tables."""

from __future__ import annotations

from rankloom.functions.text import DATES, JUNIOR, SECTIONS, STOP_WORDS, YEARS
from rankloom.operators.audit import LEXICON
from rankloom.operators import describe as D
from rankloom.plans.queries import FAMILIES, TARGETS, TOOLS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower({{t}}), '[a-z0-9+#.]+'), lambda x: len(x) > 1 and not list_contains([{_STOP}], x))"
_CAND = "select distinct stem, name, formats_available, skills, raw_text from candidates"
_REQ = "select distinct jd_id, req_idx, id req_id, text, required, keywords, weight from requirements"
_SC = "select distinct run_id, jd_id, stem, keyword_score, semantic_score, n_hard_miss, covered, required_total from scores"
_EV = "select distinct run_id, jd_id, stem, req_id, required, kw_hit, kw_terms, sem_raw, sem_cal, unit_text, ce_score from evidence"
_TERM = "(contains({t}, {v}) and regexp_matches({t}, '(^|[^a-z0-9+#.])' || regexp_replace({v}, '([\\\\.\\[\\]{{}}()*+?^$|#])', '\\\\\\1', 'g') || '($|[^a-z0-9+#])'))"
_LINES = f"(select stem, unnest(range(len(l))) line_no, unnest(l) line from (select stem, string_split(replace(raw_text, chr(13), ''), chr(10)) l from ({_CAND}) where raw_text is not null))"
_FINAL = "round(cast((0.5 * coalesce(keyword_score, 0) + 0.5 * coalesce(semantic_score, 0)) * greatest(0.5, 1 - 0.12 * n_hard_miss) * 100 as decimal(28, 8)), 2)::double"
_RANKED = f"(select *, row_number() over (partition by run_id order by final_score desc nulls last, stem) rank from (select *, {_FINAL} final_score from ({_SC})))"
_NUM = "case when not isnan({c}) then {c} end"
_KW, _CAL, _RAW, _CE = (_NUM.format(c=c) for c in ("kw_hit", "sem_cal", "sem_raw", "ce_score"))
_FLAGGED = (
    f"(select *, coalesce({_KW} >= 0.5, false) or coalesce({_CAL} >= 0.55, false) matched,"
    f" coalesce(required and {_KW} = 0 and {_CAL} < 0.45, false) hard_miss,"
    " case when kw_hit >= 0.5 and coalesce(sem_cal >= 0.55, false) then 'both channels' when kw_hit >= 0.5 then 'keyword only' else 'semantic only' end how"
    f" from ({_EV}))"
)


def _calibrated(rows: str, groups: str, value: str) -> str:
    v = _NUM.format(c=value)
    return f"(select r.*, case when {v} is not null then 1 / (1 + exp(-(case when s_ < 1e-6 then 0 else ({v} - m_) / s_ end))) end cal from (select *, avg({v}) over g m_, stddev_pop({v}) over g s_ from {rows} window g as (partition by {groups})) r)"


_CASES = " ".join(f"when h in ({', '.join(repr(s) for s in syns)}) then '{sec}'" for sec, syns in SECTIONS.items())
_HEADER = (
    "case when s <> '' and len(s) <= 45 and len(regexp_split_to_array(trim(s), '\\s+')) <= 5 and not regexp_matches(line, '^\\s*(?:[-*]\\s+|[•●▪‣]\\s*)') and not regexp_matches(s, '[\\w.+-]+@[\\w-]+\\.[\\w.]+')"
    " then trim(regexp_replace(regexp_replace(lower(s), '[^a-z& ]', ' ', 'g'), ' +', ' ', 'g')) end"
)
_SECTIONED = f"(select *, coalesce(last_value(sec ignore nulls) over (partition by stem order by line_no rows unbounded preceding), 'summary') section from (select *, case {_CASES} end sec from (select *, {_HEADER} h from (select *, regexp_replace(trim(line), '^:+|:+$', '', 'g') s from {_LINES}))))"

_NOISE = (
    "regexp_matches({t}, '(?i)linkedin\\.com|github\\.com|https?://|@[\\w-]+\\.\\w+|\\+\\d[\\d\\s-]{{7,}}') or regexp_matches({t}, '" + DATES.replace("{", "{{").replace("}", "}}") + "')"
    " or len(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) < len({t}) * 0.5"
)
_FAMILY = " ".join(f"when contains(s, '{p.replace('_', ' ')}') then '{f}'" for f, ps in FAMILIES for p in ps)
_VOCAB_HITS = f"(select distinct stem, canon from (select stem, lower(raw_text) t from ({_CAND}) where raw_text is not null), vocab where {_TERM.format(t='t', v='lower(term)')})"
_ALIAS = f"(select distinct stem, v.canon from (select stem, lower(trim(unnest(skills), ' ')) term from ({_CAND})) c join (select distinct lower(term) term, canon from vocab) v using (term))"

_HITS = f"""(with p as (select run_id, jd_id, stem, req_id, keywords from ({_SC}) join ({_REQ}) using (jd_id)),
a as (select distinct stem, unnest(keywords) term from p),
own as (select distinct stem, unnest(skills) term from ({_CAND})),
h as (select a.stem, a.term from a left join ({_CAND}) c on c.stem = a.stem where (a.stem, a.term) in (select stem, term from own) or coalesce({_TERM.format(t='lower(c.raw_text)', v='lower(a.term)')}, false)),
l as (select stem, list(distinct term) has from h group by stem)
select run_id, jd_id, stem, req_id, case when len(keywords) > 0 then len(list_intersect(list_distinct(keywords), coalesce(has, []))) / len(list_distinct(keywords)) else 0.0 end kw_hit,
len(list_intersect(list_distinct(keywords), coalesce(has, []))) n_terms from p left join l using (stem))"""

_BM25 = f"""(with tk as (select stem, {_TOKENS.format(t="coalesce(raw_text, '')")} w from ({_CAND})),
tf as (select stem, term, count(*) tf from (select stem, unnest(w) term from tk) group by all),
m as (select run_id, stem, coalesce(len(w), 0) dl from (select distinct run_id, stem from scores) left join tk using (stem)),
t as (select run_id, count(*) n, avg(dl) avgdl from m group by all),
c as (select run_id, stem, dl, term, tf from m join tf using (stem)),
i as (select run_id, term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) idf from (select run_id, term, count(*) df from c group by all) join t using (run_id)),
me as (select run_id, avg(idf) mi from i group by all),
q as (select run_id, term, count(*) qtf from (select run_id, unnest({_TOKENS.format(t='text')}) term from (select distinct run_id, jd_id from runs) join ({_REQ}) using (jd_id)) group by all),
w as (select run_id, term, qtf, avgdl, case when idf < 0 then 0.25 * mi else idf end w from q join i using (run_id, term) join me using (run_id)),
s as (select run_id, stem, sum(qtf * w * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) b from c join w using (run_id, term) group by all),
f as (select m.run_id, m.stem, coalesce(b, 0.0) b from m left join s using (run_id, stem))
select run_id, stem, b, case when hi - lo <= 1e-9 then 0.5 else (b - lo) / (hi - lo) end norm from f join (select run_id, min(b) lo, max(b) hi from f group by all) using (run_id))"""

_NARROW = f"""(with rk as (select run_id, stem, final_score, rank, count(*) over (partition by run_id) n from {_RANKED} where final_score is not null),
ed as (select run_id, final_score edge, greatest(2, round_even(n * 0.15, 0))::bigint least from rk where rank = greatest(1, floor(n * 0.35))),
ab as (select run_id, stem, least from rk join ed using (run_id) where final_score >= edge),
nm as (select jd_id, req_id, list_sort(list(distinct k)) tools from (select jd_id, req_id, lower(trim(unnest(keywords), ' ')) k from ({_REQ}) where required) where k in (select skill from skills where category in {TOOLS}) group by all),
sh as (select e.run_id, e.req_id, e.stem, least, tools from (select distinct run_id, jd_id, req_id, stem from ({_EV}) where kw_hit = 0 and {_RAW} >= 0.62) e join ab using (run_id, stem) join nm using (jd_id, req_id)),
ct as (select run_id, req_id, count(*) excluded_count, any_value(tools) tools, any_value(least) least from sh group by run_id, req_id having count(*) >= any_value(least)),
sk as (select distinct stem, lower(trim(unnest(skills), ' ')) skill from ({_CAND})),
fr as (select run_id, req_id, skill, count(*) m, any_value(excluded_count) x from sh join (select run_id, req_id, excluded_count from ct) using (run_id, req_id) join sk using (stem) where skill is not null and not list_contains(tools, skill) group by run_id, req_id, skill),
tp as (select run_id, req_id, string_agg(skill, ',' order by p) alternatives from (select *, row_number() over (partition by run_id, req_id order by m desc, skill) p from fr where m >= x * 0.4) where p <= 5 group by all)
select run_id, req_id, array_to_string(tools, ',') tools, excluded_count, coalesce(alternatives, '') alternatives from ct left join tp using (run_id, req_id))"""

_WORDS = ", ".join(f"('{c}', '{t}')" for c, ts in LEXICON.items() if c != "feminine_coded" for t in ts)
_CODED = f"(select doc_id, category, term from documents, (values {_WORDS}) v(category, term) where contains(lower(text), term) and regexp_matches(lower(text), '(^|[^a-z])' || term || '($|[^a-z])'))"
_GRADED = f"(select *, case when covered = required_total then 2 when covered * 2 >= required_total then 1 else 0 end grade from {_RANKED})"


def _ndcg(rows: str, groups: str, score: str) -> str:
    return f"""(with g as (select {groups}, grade, row_number() over (partition by {groups} order by {score} desc nulls last, stem) p, row_number() over (partition by {groups} order by grade desc, stem) q from {rows})
select {groups}, case when sum(grade / log2(q + 1.0)) filter (q <= 10) = 0 then 0.0 else sum(grade / log2(p + 1.0)) filter (p <= 10) / sum(grade / log2(q + 1.0)) filter (q <= 10) end ndcg from g group by {groups})"""


_GRID = """(select row_number() over (order by a, b, c) - 1 config_id, a / 100.0 w_kw, b / 100.0 penalty, c / 10.0 floor_ from (select unnest(range(30, 71, 5)) a), (select unnest([0, 6, 12, 18, 25]) b), (select unnest([4, 5, 6]) c))"""
_RERANK = f"""(with r as (select * from {_RANKED}),
ce as (select run_id, stem, avg(1 / (1 + exp(-ce_score))) ce from ({_EV}) where required and coalesce(unit_text, '') <> '' and {_CE} is not null and (run_id, stem) in (select run_id, stem from r where rank <= 10) group by all),
m as (select run_id, stem, keyword_score, n_hard_miss, rank prior_rank, ce is not null reranked, case when ce is null then semantic_score else 0.5 * coalesce(semantic_score, 0) + 0.5 * ce end semantic_score from r left join ce using (run_id, stem)),
f as (select *, {_FINAL} final_score from m)
select run_id, stem, row_number() over (partition by run_id order by final_score desc nulls last, prior_rank) rank, prior_rank, final_score, reranked from f)"""


_ABLATION = "(select row_number() over (order by w_kw) - 1 config_id, w_kw, 0.12 penalty, 0.5 floor_ from (select unnest([0.0, 0.5, 1.0]) w_kw))"
_TARGETED = ", ".join(f"('{t}', '{a}', '{b}')" for t, (a, b) in TARGETS.items())
_WITH_FAMILY = f"(select r.*, family = target hit, family = close near from {_RANKED} r join (select distinct run_id, title from runs) using (run_id) join (values {_TARGETED}) t(title, target, close) using (title) join (select stem, case {_FAMILY} else 'unknown' end family from (select distinct stem, trim(regexp_replace(regexp_replace(lower(stem), '[_-]+', ' ', 'g'), ' +', ' ', 'g')) s from candidates)) using (stem))"


def _related(grade: str) -> str:
    value = "hit::int" if grade == "strict" else "case when hit then 2 when near then 1 else 0 end"
    return f"(select *, {value} grade from {_WITH_FAMILY})"


def _configured(grade: str, grid: str) -> str:
    return f"(select *, round((w_kw * coalesce(keyword_score, 0) + (1 - w_kw) * coalesce(semantic_score, 0)) * greatest(floor_, 1 - penalty * n_hard_miss), 9) sc from {_related(grade)}, {grid})"


def _share(value: str, digits: int, by: int) -> str:
    return f"round(cast(case when not isnan({value}) then {value} end * {by} as decimal(28, 8)), {digits})::double"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_BULLET_SQL = "^\\s*(?:[-*]\\s+|[•●▪‣]\\s*)"
_BODY = f"(select *, trim(regexp_replace(line, '{_BULLET_SQL}', ''), ' ') t from {_SECTIONED} where sec is null and section not in ('education', 'certifications', 'achievements'))"
_UNITS = f"""(with p as (select stem, line_no, section, generate_subscripts(l, 1) a, unnest(l) t from (select stem, line_no, section, case when len(t) > 400 then string_split(regexp_replace(t, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) else [t] end l from {_BODY} where len(t) >= 25 and not ({_NOISE.format(t='t')}))),
w as (select stem, line_no, section, a, generate_subscripts(l, 1) b, trim(unnest(l), ' ') t from (select *, regexp_extract_all(trim(t, ' '), '(?s)\\s*(?:.{{1,400}}$|.{{1,399}} |.{{400}})') l from p)),
f as (select stem, section, min(line_no) first_ from {_SECTIONED} group by all)
select w.*, first_ from w join f using (stem, section) where len(t) >= 25)"""
_NAME_LINES = f"""(select stem, line_no, case when upper(t) = t then array_to_string(list_transform(regexp_extract_all(lower(t), '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(x[1]) || x[2:]), '') else t end name from (select *, trim(line, ' ') t, regexp_split_to_array(trim(replace(trim(line, ' '), '.', ''), ' '), '\\s+') ws from {_SECTIONED} where line_no < 6)
where t <> '' and len(t) <= 45 and not regexp_matches(t, '[\\pL\\pN_.+-]+@[\\pL\\pN_-]+\\.[\\pL\\pN_.]+') and not regexp_matches(t, '\\+?\\d[\\d\\s\\-()]{{7,}}\\d') and not regexp_matches(t, '(?i)https?://\\S+|(?:www\\.|linkedin\\.com|github\\.com)') and sec is null
and len(ws) between 2 and 4 and len(list_filter(ws, lambda w: not regexp_full_match(replace(w, '-', ''), '\\p{{L}}+'))) = 0)"""
_NAMES = f"""(select stem, coalesce(name, case when len(ws) >= 2 then array_to_string(list_transform(ws, lambda w: upper(w[1]) || lower(w[2:])), ' ') else stem end) name from (
select *, list_filter(regexp_split_to_array(list_extract(regexp_split_to_array(stem, '(?i)resume|_\\d+_|__'), -1), '[_\\s-]+'), lambda w: regexp_full_match(w, '\\p{{L}}{{2,}}')) ws from (select distinct stem from candidates)) left join (select stem, arg_min(name, line_no) name from {_NAME_LINES} group by stem) using (stem))"""
_NAMES_READ = f"(select stem, truth, name got from (select stem, max(name) truth from candidates where trim(name, ' ') <> '' group by stem) join {_NAMES} using (stem))"
_POSTS = "(select distinct doc_id, text from documents where doc_kind = 'job_post')"
_POST_LINES = f"""(select doc_id, line_no, line from (select *, sum(contains(line, '<!--')::int) over (partition by doc_id order by line_no) opened, coalesce(sum(contains(line, '-->')::int) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) closed
from (select doc_id, unnest(range(len(l))) line_no, unnest(l) line from (select doc_id, string_split(text, chr(10)) l from {_POSTS} where text is not null))) where opened <= closed)"""
_HEAD_OF = _HEADER.replace("line", "t")
_PARSED = f"""(with l as (select doc_id, line_no, trim(line, ' ') t from {_POST_LINES}),
p as (select *, trim(regexp_replace(t, '^[#*\\s]+|[*:\\s]+$', '', 'g'), ' ') plain, regexp_replace(trim(t, ' '), '^:+|:+$', '', 'g') s from l),
h as (select *, coalesce(t like '#%' or (case {_CASES.replace(' h in', ' hh in')} end) is not null or (upper(plain) = plain and regexp_matches(plain, '\\p{{Lu}}') and len(regexp_split_to_array(plain, '\\s+')) between 2 and 5
  and (regexp_matches(plain, '{_q(D.REQUIRED_HEAD)}') or regexp_matches(plain, '{_q(D.PREFERRED_HEAD)}') or regexp_matches(plain, '{_q(D.DUTY)}'))), false) is_head from (select *, {_HEAD_OF} hh from p)),
m as (select *, case when is_head then case when regexp_matches(plain, '{_q(D.PREFERRED_HEAD)}') then false when regexp_matches(plain, '{_q(D.REQUIRED_HEAD)}') then true end end mode,
  case when is_head then case when regexp_matches(plain, '{_q(D.DUTY)}') then 'responsibility' when regexp_matches(plain, '{_q(D.QUALIFICATION)}') then 'qualification' else 'skill' end end kind_ from h),
f as (select *, coalesce(last_value(mode ignore nulls) over w, true) sect, coalesce(last_value(case when is_head then mode is not null end ignore nulls) over w, false) explicit_, coalesce(last_value(kind_ ignore nulls) over w, 'skill') kind from m window w as (partition by doc_id order by line_no rows unbounded preceding)),
b as (select doc_id, line_no, kind, sect, explicit_, trim(regexp_replace(t, '{_BULLET_SQL}', ''), ' ') text from f where not is_head and regexp_matches(t, '{_BULLET_SQL}')),
o as (select *, row_number() over (partition by doc_id, lower(text) order by line_no) n from b where len(text) >= 10 and not regexp_matches(text, '{_q(D.OFFER)}')),
r as (select *, row_number() over (partition by doc_id order by line_no) i from o where n = 1)
select doc_id, (i - 1)::int req_idx, printf('R%02d', i) req_id, text, kind, case when explicit_ then sect when regexp_matches(text, '{_q(D.PREFERRED_LINE)}') then false when regexp_matches(text, '{_q(D.REQUIRED_LINE)}') then true else sect end required from r)"""


def oracle() -> dict[str, str]:
    near = f"(select a.run_id, a.stem a, b.stem b from {_RANKED} a join {_RANKED} b on a.run_id = b.run_id and b.rank = a.rank + 1)"
    return {
        "token_counts": f"select stem, len({_TOKENS.format(t='raw_text')}) n_tokens from ({_CAND}) where raw_text is not null",
        "readable_candidates": f"select stem from ({_CAND}) where len(raw_text) >= 120",
        "first_requirements": f"select jd_id, req_id from (select *, row_number() over (partition by jd_id, lower(text) order by req_idx) n from ({_REQ}) where text is not null) where n = 1",
        "best_formats": f"select stem, (list_filter(['xml', 'docx', 'txt', 'pdf'], lambda f: list_contains(formats_available, f)))[1] best, array_to_string(list_sort(list_distinct(formats_available)), ',') formats from ({_CAND}) where len(formats_available) > 0",
        "line_sections": f"select stem, line_no, section, sec is not null is_header from {_SECTIONED}",
        "sentence_counts": "select stem, unit_idx, len(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) n_sentences from (select distinct stem, unit_idx, text from units)",
        "noise_lines": f"select stem, line_no from {_LINES} where len(line) > 0 and ({_NOISE.format(t='line')})",
        "first_emails": f"select stem, regexp_extract(raw_text, '[\\pL\\pN_.+-]+@[\\pL\\pN_-]+\\.[\\pL\\pN_.]+') email from ({_CAND}) where regexp_matches(raw_text, '[\\pL\\pN_.+-]+@[\\pL\\pN_-]+\\.[\\pL\\pN_.]+')",
        "stem_families": f"select stem, case {_FAMILY} else 'unknown' end family from (select distinct stem, trim(regexp_replace(regexp_replace(lower(stem), '[_-]+', ' ', 'g'), ' +', ' ', 'g')) s from candidates)",
        "vocabulary_matches": f"select stem, canon from {_VOCAB_HITS}",
        "requirement_keywords": f"""select jd_id, req_id, array_to_string(list_distinct_, '|') keywords from (select jd_id, req_id, list(canon order by n desc, t) list_distinct_ from (
            select jd_id, req_id, canon, max(len(term)) n, arg_max(term, (len(term), 0)) t from ({_REQ}), vocab where {_TERM.format(t='lower(text)', v='lower(term)')} group by all) group by all)""",
        "alias_lookup": f"select stem, canon from {_ALIAS}",
        "keyword_hits": f"select run_id, stem, req_id, round(kw_hit, 9) kw_hit, n_terms from {_HITS}",
        "bm25_scores": f"select run_id, stem, round(b, 6) bm25, round(norm, 6) bm25_norm from {_BM25}",
        "keyword_channel": f"select run_id, stem, round(0.7 * hit + 0.3 * norm, 9) keyword_score from (select run_id, stem, coalesce(sum(kw_hit * weight) / nullif(sum(weight), 0), 0) hit from {_HITS} join ({_REQ}) using (jd_id, req_id) group by run_id, stem) join {_BM25} using (run_id, stem)",
        "similar_vectors": """with s as (select a.vec_id query_id, b.vec_id % 25 key, b.vec_id u, list_dot_product(a.embedding::double[], b.embedding::double[]) sim from embeddings a, embeddings b where a.vec_id % 20 = 0),
            r as (select *, row_number() over (partition by query_id, key order by sim desc, u) n from s)
            select query_id, key, round(avg(sim), 6) raw, arg_min(u, n) best_unit from r where n <= 2 group by query_id, key""",
        "calibrated": f"select run_id, stem, req_id, round(cal, 6) sem_cal from {_calibrated(f'(select distinct run_id, jd_id, stem, req_id, sem_raw from ({_EV}))', 'run_id, req_id', 'sem_raw')}",
        "semantic_channel": f"select run_id, stem, round(sum(cal * weight) / case when sum(weight) = 0 then 1.0 else sum(weight) end, 6) semantic_score from {_calibrated(f'(select distinct run_id, jd_id, stem, req_id, sem_raw from ({_EV}))', 'run_id, req_id', 'sem_raw')} join ({_REQ}) using (jd_id, req_id) where cal is not null group by run_id, stem",
        "required_coverage": f"select run_id, stem, n_hard_miss, covered, required_total, round(greatest(0.5, 1 - 0.12 * n_hard_miss), 6)::double factor from (select run_id, stem, count(*) filter (hard_miss) n_hard_miss, count(*) filter (required and matched) covered, count(*) filter (required) required_total from {_FLAGGED} group by all)",
        "final_ranks": f"select run_id, stem, final_score, rank from {_RANKED}",
        "leaderboard": f"select run_id, rank, stem, final_score, covered || '/' || required_total coverage from {_RANKED} where rank <= 15",
        "reranked": f"select * from {_RERANK}",
        "score_spread": f"select run_id, min(final_score) lowest, max(final_score) highest, round(max(final_score) - min(final_score), 6) spread from {_RANKED} group by all",
        "matched_top8": f"select run_id, stem, pos, req_id, how from (select *, row_number() over (partition by run_id, stem order by required desc, sem_cal desc nulls last, req_id) pos from {_FLAGGED} where matched) where pos <= 8",
        "missing_top6": f"select run_id, stem, pos, req_id, hard_miss from (select *, row_number() over (partition by run_id, stem order by required desc, sem_cal asc nulls last, req_id) pos from {_FLAGGED} where not matched) where pos <= 6",
        "semantic_only": f"select run_id, stem, count(*) filter (matched) n_matched, count(*) filter (matched and how = 'semantic only') n_semantic_only, count(*) n_total from {_FLAGGED} group by all",
        "next_candidates": f"select run_id, stem, rank, lead(stem) over w next_key, lead(final_score) over w next_score from {_RANKED} window w as (partition by run_id order by rank)",
        "neighbour_deltas": f"select n.run_id, n.a, n.b, x.req_id, x.matched a_matched, y.matched b_matched from {near} n join {_FLAGGED} x on x.run_id = n.run_id and x.stem = n.a join {_FLAGGED} y on y.run_id = n.run_id and y.stem = n.b and y.req_id = x.req_id where x.matched <> y.matched",
        "narrow_requirements": f"select * from {_NARROW}",
        "coded_words": f"select * from {_CODED}",
        "listed_words": f"""select jd_id, req_id, category, term, substr(text, at_, len(term)) as_written,
            trim(regexp_replace(substr(text, greatest(1, at_ - 60), least(at_ - 1, 60) + len(term) + 60), '\\s+', ' ', 'g')) context from (
            select *, len(regexp_extract(lower(text), '^((?s).*?(?:^|[^a-z]))' || term || '(?:$|[^a-z])', 1)) + 1 at_ from (select distinct jd_id, req_id, text from ({_REQ})), (select category, skill term from skills)
            where contains(lower(text), term) and regexp_matches(lower(text), '(^|[^a-z])' || term || '($|[^a-z])'))""",
        "findings": f"""select run_id, type, severity, term, excluded_count from (select *, row_number() over (partition by run_id, type, lower(term) order by case severity when 'high' then 0 else 1 end, -excluded_count, term) n from (
            select run_id, 'coded_language' "type", 'medium' severity, regexp_extract(text, '(?i)(?:^|[^a-z])(' || w.term || ')(?:$|[^a-z])', 1) term, 0 excluded_count from (select distinct run_id, jd_id from runs) join (select distinct jd_id, text from ({_REQ})) using (jd_id), (values {_WORDS}) w(category, term)
            where regexp_matches(lower(text), '(^|[^a-z])' || w.term || '($|[^a-z])')
            union all select run_id, 'experience_contradiction', 'high', regexp_extract(text, '{YEARS}', 0), 0 from (select distinct run_id, jd_id, title from runs) join ({_REQ}) using (jd_id) where regexp_matches(title, '{JUNIOR}') and try_cast(nullif(regexp_extract(text, '{YEARS}', 1), '') as int) > 1
            union all select run_id, 'overly_narrow', 'medium', tools, excluded_count from {_NARROW})) where n = 1""",
        "rescued_by_semantics": f"select run_id, stem from {_RANKED} where rank <= 20 and (run_id, stem) not in (select run_id, stem from (select run_id, stem, row_number() over (partition by run_id order by keyword_score desc nulls last, stem) n from {_RANKED}) where n <= 20)",
        "family_ndcg": f"select run_id, round(a.ndcg, 6) strict, round(b.ndcg, 6) graded from {_ndcg(_related('strict'), 'run_id', 'final_score')} a join {_ndcg(_related('graded'), 'run_id', 'final_score')} b using (run_id)",
        "best_weights": f"""select row_number() over (order by strict desc, config_id) rank, config_id, w_kw::double w_kw, penalty::double penalty, floor_::double floor, strict, graded from {_GRID} join (
            select config_id, round(avg(a.ndcg), 6) strict, round(avg(b.ndcg), 6) graded from {_ndcg(_configured('strict', _GRID), 'config_id, run_id', 'sc')} a join {_ndcg(_configured('graded', _GRID), 'config_id, run_id', 'sc')} b using (config_id, run_id) group by config_id) using (config_id)
            qualify rank <= 8""",
        "channel_ablation": f"""select w_kw::double w_kw, round(avg(a.ndcg), 6) strict, round(avg(b.ndcg), 6) graded from {_ABLATION} join {_ndcg(_configured('strict', _ABLATION), 'config_id, run_id', 'sc')} a using (config_id) join {_ndcg(_configured('graded', _ABLATION), 'config_id, run_id', 'sc')} b using (config_id, run_id) group by w_kw""",
        "parser_validation": f"""select count(*) n, round(avg("precision"), 6) mean_precision, round(avg(recall), 6) mean_recall, (select count(*) filter (lower(trim(truth, ' ')) = lower(trim(got, ' '))) from {_NAMES_READ}) names_equal, (select count(*) from {_NAMES_READ}) names_total from (
            with t as (select stem, list(canon) l from {_ALIAS} group by stem), g as (select stem, list(canon) m from {_VOCAB_HITS} group by stem)
            select round(len(list_intersect(coalesce(l, []), coalesce(m, []))) / nullif(len(coalesce(m, [])), 0), 6) "precision", round(len(list_intersect(coalesce(l, []), coalesce(m, []))) / nullif(len(coalesce(l, [])), 0), 6) recall from t full join g using (stem))""",
        "names_read": f"select stem, truth, got from {_NAMES_READ}",
        "candidate_names": f"select stem, name from {_NAMES}",
        "candidate_units": f"select stem, row_number() over (partition by stem order by first_, line_no, a, b) - 1 unit_idx, t text, section from {_UNITS}",
        "visible_lines": f"select doc_id, line_no from {_POST_LINES} where len(trim(line, ' ')) > 0",
        "parsed_requirements": f"""select doc_id, r.req_idx, r.req_id, r.text, kind, required, coalesce(keywords, '') keywords, case when required then 1.0 else 0.5 end::double weight from {_PARSED} r left join (
            select doc_id, req_id, array_to_string(list(canon order by n desc, t), '|') keywords from (select doc_id, req_id, canon, max(len(term)) n, arg_max(term, (len(term), 0)) t from {_PARSED}, vocab where {_TERM.format(t='lower(text)', v='lower(term)')} group by all) group by all) k using (doc_id, req_id)""",
        "parsed_titles": f"""select d.doc_id, coalesce(trim(split_part(case when swap then b else a end, '|', 1), ' '), d.doc_id::varchar) title, coalesce(trim(split_part(case when swap then a else coalesce(b, '') end, '|', 1), ' '), '') company from {_POSTS} d left join (
            select *, coalesce(regexp_matches(b, '{_q(D.ROLE)}') and not regexp_matches(a, '{_q(D.ROLE)}'), false) swap from (select doc_id, max(t) filter (j = 1) a, max(t) filter (j = 2) b from (
            select doc_id, t, row_number() over (partition by doc_id order by line_no) j from (select doc_id, line_no, trim(regexp_replace(line, '[#*]', '', 'g'), ' ') t, row_number() over (partition by doc_id order by line_no) i from {_POST_LINES}) where i <= 12 and t <> '') group by doc_id)) using (doc_id)""",
        "compared_leaders": f"""select run_id, a, b, pos, req_id, text, required, case when am then a else b end "only" from (select *, row_number() over (partition by run_id, a, b order by required desc nulls last, req_id) pos from (
            select n.run_id, n.a, n.b, x.req_id, x.required, x.jd_id, x.matched am from (select a.run_id, a.stem a, b.stem b from {_RANKED} a join {_RANKED} b on a.run_id = b.run_id and a.rank = 1 and b.rank = 2) n
            join {_FLAGGED} x on x.run_id = n.run_id and x.stem = n.a join {_FLAGGED} y on y.run_id = n.run_id and y.stem = n.b and y.req_id = x.req_id where x.matched <> y.matched)) left join (select distinct run_id, req_id, text from (select distinct run_id, jd_id from runs) join ({_REQ}) using (jd_id)) using (run_id, req_id) where pos <= 12""",
        "artifact_candidates": f"""with s as (select distinct run_id, stem, bm25_norm, explanation, explanation_source from scores), c as (select run_id, stem, count(*) n_cells from {_FLAGGED} group by all)
            select run_id, rank, stem, final_score, {_share('keyword_score', 2, 100)} keyword_score, {_share('semantic_score', 2, 100)} semantic_score, {_share('(semantic_score - keyword_score)', 2, 100)} delta, {_share('bm25_norm', 3, 1)} bm25, concat_ws('/', covered, required_total) required_coverage, n_hard_miss::bigint hard_misses, coalesce(n_cells, 0) n_cells
            from {_RANKED} join s using (run_id, stem) left join c using (run_id, stem)""",
        "skill_overlap": f"""with t as (select stem, list(canon) l from {_ALIAS} group by stem), g as (select stem, list(canon) m from {_VOCAB_HITS} group by stem)
            select stem, round(len(list_intersect(coalesce(l, []), coalesce(m, []))) / nullif(len(coalesce(m, [])), 0), 6) "precision", round(len(list_intersect(coalesce(l, []), coalesce(m, []))) / nullif(len(coalesce(l, [])), 0), 6) recall from t full join g using (stem)""",
        "ndcg_by_run": f"select run_id, round(ndcg, 6) ndcg from {_ndcg(_GRADED, 'run_id', 'final_score')}",
        "weight_search": f"select config_id, round(avg(ndcg), 6) mean_ndcg from {_ndcg(f'(select *, round((w_kw * coalesce(keyword_score, 0) + (1 - w_kw) * coalesce(semantic_score, 0)) * greatest(floor_, 1 - penalty * n_hard_miss), 9) sc from {_GRADED}, {_GRID})', 'config_id, run_id', 'sc')} group by config_id",
        "supplier_scorecard": f"select *, row_number() over (order by score desc, l_suppkey) rank from (select l_suppkey, round(avg(cal), 6) score, count(*) n_brands from {_calibrated('(select p_brand, l_suppkey, sum(l_quantity) raw from lineitem join part on l_partkey = p_partkey group by all)', 'p_brand', 'raw')} group by l_suppkey)",
        "user_event_scorecard": f"select user_id, round(avg(cal), 6) score, count(*) n_types from {_calibrated('(select event_type, user_id, sum(value) raw from events group by all)', 'event_type', 'raw')} group by user_id",
    }
