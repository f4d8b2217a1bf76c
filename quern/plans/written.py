"""Queries over texts that are written around the driver's documents, and the same in SQL.

The documents hold no headers, headings, CJK text, definitions or time
expressions.  Here every document or benchmark item gets such parts by its id, in
the same way in Spark and in SQL, so operators on them run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import lexicon as L
from quern.functions import text as T
from quern.operators import generate, profile, query
from quern.plans.catalogue import _queries, _register, _table

_MARK = "\x9f====\x9f"
_HEADS = ["1. Introduction", "Materials and methods:", "RESULTS", "1 资料与方法"]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _by(c: Column, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(c, F.lit(len(values))).cast("int"))


def _sql_by(c: str, values: list[str]) -> str:
    return f"[{', '.join(map(_quoted, values))}][({c} % {len(values)}) + 1]"


def _articles(spark, sf_dir) -> DataFrame:
    """Documents as articles: header lines, most with a mark before the body, a heading, the text, and a tail."""
    i, line = F.col("doc_id"), F.lit("\n")
    head = F.concat(F.lit("ISSN: "), i.cast("string"), F.lit("\nPublisher:  House "), (i % 7).cast("string"), F.lit(" \nISSN: 0\nother: x\n"))
    mark = F.when(i % 6 == 0, "").otherwise(_MARK + "\n")
    body = F.concat(_by(i, _HEADS), line, T.text_of("text"), line, F.when(i % 3 == 0, "Discussion:\nso\n").otherwise(""))
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(head, mark, body, F.when(i % 5 == 0, "").otherwise("References\nx")).alias("text"))


_ARTICLES = f"""articles as (select doc_id, 'ISSN: ' || doc_id || chr(10) || 'Publisher:  House ' || (doc_id % 7) || ' ' || chr(10) || 'ISSN: 0' || chr(10) || 'other: x' || chr(10)
  || case when doc_id % 6 = 0 then '' else chr(159) || '====' || chr(159) || chr(10) end || {_sql_by("doc_id", _HEADS)} || chr(10) || coalesce(text, '') || chr(10)
  || case when doc_id % 3 = 0 then 'Discussion:' || chr(10) || 'so' || chr(10) else '' end || case when doc_id % 5 = 0 then '' else 'References' || chr(10) || 'x' end as text from documents),
lined as (select doc_id, text, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) as lines from articles)"""


@_register("article_regions", f"""
with {_ARTICLES}, marked as (select doc_id, lines, coalesce(list_position(list_transform(lines, lambda x: regexp_matches(trim(x), '{L.BODY_MARK}')), true), 0) as mark from lined),
bodies as (select doc_id, mark, lines[mark + 1:] as body from marked), tails as (select *, coalesce(list_position(list_transform(body, lambda x: regexp_matches(trim(x), '{L.TAIL_HEAD}')), true), 0) as tail from bodies)
select doc_id, md5(array_to_string(body, chr(10))) as body, md5(array_to_string(case when mark > 0 and tail > 0 then body[1:tail - 1] else body end, chr(10))) as core, mark > 0 and tail > 0 as tail_cut from tails
""")  # fmt: skip
def article_regions(spark, sf_dir):
    own = _articles(spark, sf_dir).select("doc_id", T.regions(F.col("text")).alias("r"))
    return own.select("doc_id", F.md5("r.body").alias("body"), F.md5("r.core").alias("core"), "r.tail_cut")


_KEYS = "(" + ", ".join(map(_quoted, L.HEADER_KEYS)) + ")"


def header_sql(table: str) -> str:
    """The known fields of the first 80 lines of ``table`` (doc_id, lines), the first of each key."""
    pattern = "'^\\s*([A-Za-z][A-Za-z /()]*?):\\s*(.+?)\\s*$'"
    return f"""numbered as (select doc_id, unnest(range(1, least(80, len(lines)) + 1)) as i, lines from {table}),
fields as (select doc_id, i, regexp_extract(lines[i], {pattern}, 1) as key, regexp_extract(lines[i], {pattern}, 2) as value from numbered)
select d.doc_id as id, f.key, f.value from {table} d left join (select * from fields where key in {_KEYS} qualify row_number() over (partition by doc_id, key order by i) = 1) f using (doc_id)"""


_LINED = "lined as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)) as lines from documents)"


@_register("header_fields", f"with {_LINED}, {header_sql('lined')}")
def header_fields(spark, sf_dir):
    """A document without fields has one row, of nulls."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode_outer(T.header_fields(F.col("text"))).alias("key", "value"))


@_register("article_headers", f"with {_ARTICLES}, {header_sql('lined')}")
def article_headers(spark, sf_dir):
    return _articles(spark, sf_dir).select(F.col("doc_id").alias("id"), F.explode_outer(T.header_fields(F.col("text"))).alias("key", "value"))


_NAMES = "|".join(sorted(L.SECTION_CLASSES, key=len, reverse=True))
_CLASSES = [*dict.fromkeys(L.SECTION_CLASSES.values()), "cjk_section"]


def section_sql(table: str) -> str:
    """Counters of the heading lines of ``table`` (doc_id, lines)."""
    named = " ".join(f"when '{name}' then '{kind}'" for name, kind in L.SECTION_CLASSES.items())
    counts = ", ".join(f"(count(*) filter (where kind = '{c}'))::bigint as {c}" for c in _CLASSES)
    return f"""heads as (select doc_id, trim(unnest(lines)) as s from {table}),
kinds as (select doc_id, case when s = '' or length(s) > 80 then null when regexp_matches(s, '^\\d+(\\.\\d+)*\\s+[\\x{{4e00}}-\\x{{9fff}}]') then 'cjk_section'
  else case lower(regexp_extract(s, '(?i)^(?:[0-9]+[.)]?\\s*)?({_NAMES})\\s*[:\\-]?$', 1)) {named} end end as kind from heads),
counted as (select doc_id, {counts} from kinds group by doc_id)
select *, (intro > 0 and methods > 0 and results > 0 and (discussion > 0 or conclusion > 0))::int as imrad_like, ({" + ".join(_CLASSES)})::bigint as n_headings from counted"""


@_register("profile_sections", f"with {_LINED}, {section_sql('lined')}")
def profile_sections(spark, sf_dir):
    return profile.section_matrix(_table(spark, sf_dir, "documents"))


@_register("article_sections", f"with {_ARTICLES}, {section_sql('lined')}")
def article_sections(spark, sf_dir):
    return profile.section_matrix(_articles(spark, sf_dir))


_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
_WIDE = "'Ｗ' || doc_id || '：　' || repeat('高血压 與 病，', (doc_id % 40)::int) || coalesce(text, '')"
_RUNS = "regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]+')"


@_register("wide_texts", f"""
with own as (select doc_id, {_WIDE} as text from documents), measured as (select *, len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]'))::double / length(text) as share from own),
grams as (select doc_id, flatten(list_transform({_RUNS}, lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1)), list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))) as t from own)
select doc_id, md5(trim(regexp_replace(translate(text, {_quoted(_FULL)}, {_quoted(_HALF)}), '\\s+', ' ', 'g'))) as cleaned, case when share >= 0.20 then 'zh' when share >= 0.02 then 'mixed' else 'en' end as chunk_lang, case when share > 0.5 then 'zh' when share > 0.05 then 'mixed' else 'en' end as query_lang,
  array_to_string(t, ' ') as cjk_tokens, (floor((len(regexp_extract_all(text, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]')) / 1.57::double + (length(text) - len(regexp_extract_all(text, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]'))) / 5.03::double) * 1.3) + 1)::bigint as tokens
from measured join grams using (doc_id)
""")  # fmt: skip
def wide_texts(spark, sf_dir):
    i = F.col("doc_id")
    own = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Ｗ"), i.cast("string"), F.lit("：　"), F.repeat(F.lit("高血压 與 病，"), (i % 40).cast("int")), T.text_of("text")).alias("text"))
    c = F.col("text")
    return own.select("doc_id", F.md5(T.clean(c)).alias("cleaned"), T.language(c).alias("chunk_lang"), T.query_language(c).alias("query_lang"), F.array_join(T.cjk_tokens(c), " ").alias("cjk_tokens"), T.estimate_tokens(c).alias("tokens"))


@_register("sentence_units", """
with own as (select doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.;!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') as s from documents)
select doc_id, len(s)::int as n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::int as longest from own
""")  # fmt: skip
def sentence_units(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return own.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"))


def estimate_sql(text: str) -> str:
    wide = f"len(regexp_extract_all({text}, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]'))"
    return f"(case when length({text}) > 0 then floor(({wide} / 1.57::double + (length({text}) - {wide}) / 5.03::double) * 1.3) + 1 else 0 end)::bigint"


def truncate_sql(text: str, budget: str) -> str:
    """``text`` cut to about ``budget`` estimated tokens, at a sentence end if there is one."""
    wide = f"len(regexp_extract_all({text}, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]'))"
    share = f"({wide}::double / greatest(length({text}), 1))"
    keep = f"floor(({budget}) * (1.57::double * {share} + 5.03::double * (1 - {share})) / 1.3::double)::int"
    head = f"substring({text}, 1, greatest({keep}, 0))"
    whole = f"regexp_extract({head}, '(?s)^(.*[.!?。！？；;])', 1)"
    return f"(case when {estimate_sql(text)} <= ({budget}) then {text} when {keep} <= 0 then '' when {whole} <> '' then {whole} else rtrim({head}) end)"


@_register("truncated_texts", f"with own as (select doc_id, {_WIDE} as text from documents) select doc_id, {truncate_sql('text', '60')} as cut from own")
def truncated_texts(spark, sf_dir):
    i = F.col("doc_id")
    own = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Ｗ"), i.cast("string"), F.lit("：　"), F.repeat(F.lit("高血压 與 病，"), (i % 40).cast("int")), T.text_of("text")).alias("text"))
    return own.select("doc_id", T.truncate_at_sentence(F.col("text"), 60).alias("cut"))


_PHRASES = ["heart failure (HF) and HF.", "a high frequency (HF) unit;", "RCT of randomized controlled trials (RCT)", "nothing", "long " * 20 + "phrase (LP) LP"]
_DEFINED = f"coalesce(text, '') || ' ; ' || {_sql_by('doc_id', _PHRASES)}"
_NOISE = "(" + ", ".join(map(_quoted, dict.fromkeys(L.NO_ACRONYMS))) + ")"


@_register("acronym_expansions", f"""
with own as (select doc_id, {_DEFINED} as text from documents),
found as (select doc_id, unnest(list_filter(regexp_extract_all(regexp_replace(text, '([A-Za-z0-9_]+)', ' \\1 ', 'g'), ' ([A-Z0-9]{{2,12}}) ', 1), lambda t: regexp_matches(t, '[A-Z]') and t not in {_NOISE})) as acronym from own),
counted as (select acronym, count(*) as n, count(distinct doc_id) as n_docs from found group by acronym),
pairs as (select doc_id, length(text) as chars, generate_subscripts(regexp_extract_all(text, '{L.DEFINITION}', 1), 1) as pos, unnest(regexp_extract_all(text, '{L.DEFINITION}', 1)) as phrase, unnest(regexp_extract_all(text, '{L.DEFINITION}', 2)) as acronym from own),
best as (select acronym, phrase from pairs where length(phrase) <= {L.LONGEST_PHRASE} qualify row_number() over (partition by acronym order by chars desc, doc_id desc, pos) = 1)
select acronym, n, n_docs, phrase as expansion_example from counted left join best using (acronym) order by n desc, acronym limit 20
""")  # fmt: skip
def acronym_expansions(spark, sf_dir):
    own = _table(spark, sf_dir, "documents").select("doc_id", F.concat(T.text_of("text"), F.lit(" ; "), _by(F.col("doc_id"), _PHRASES)).alias("text"))
    return profile.most_common(profile.acronym_table(own), "acronym", 20)


_TIMES = [" since 2015", " 2012-2018", " in the last 3 years", " before 2001", " 近五年", " 2019年以后", " in 2020", "", " 表格 中文"]
_ASKED = f"(select item_id as query_id, coalesce(text, '') || {_sql_by('item_id', _TIMES)} as text from benchmark)"
_YEAR = "(19[89]\\d|20[0-2]\\d)"


@_register("year_filters", f"""
with asked as {_ASKED}, read as (select query_id, text, case when regexp_matches(text, '(?:^|\\D){_YEAR}-{_YEAR}(?:\\D|$)') then [least(regexp_extract(text, '(?:^|\\D){_YEAR}-{_YEAR}', 1), regexp_extract(text, '(?:^|\\D){_YEAR}-{_YEAR}', 2))::int, greatest(regexp_extract(text, '(?:^|\\D){_YEAR}-{_YEAR}', 1), regexp_extract(text, '(?:^|\\D){_YEAR}-{_YEAR}', 2))::int]
  when regexp_matches(text, '(?:^|\\D){_YEAR}年以后') then [regexp_extract(text, '{_YEAR}年以后', 1)::int, 2026] when regexp_matches(text, '(?i)\\b(?:since|after|from)\\s+{_YEAR}(?:\\D|$)') then [regexp_extract(text, '(?i)\\b(?:since|after|from)\\s+{_YEAR}', 1)::int, 2026]
  when contains(text, '近五年') then [2022, 2026] when regexp_matches(text, '(?i)\\b(?:last|past|recent)\\s+\\d{{1,2}}\\s+years?\\b') then [2027 - regexp_extract(text, '(?i)\\b(?:last|past|recent)\\s+(\\d{{1,2}})\\s+years?\\b', 1)::int, 2026]
  when regexp_matches(text, '(?i)\\b(?:before|until|prior\\s+to)\\s+{_YEAR}(?:\\D|$)') then [1992, regexp_extract(text, '(?i)\\b(?:before|until|prior\\s+to)\\s+{_YEAR}', 1)::int] when regexp_matches(text, '(?:^|\\D){_YEAR}(?:\\D|$)') then [regexp_extract(text, '(?:^|\\D){_YEAR}(?:\\D|$)', 1)::int, regexp_extract(text, '(?:^|\\D){_YEAR}(?:\\D|$)', 1)::int] end as span from asked)
select query_id, coalesce(array_to_string(range(span[1], span[2] + 1), ','), '') as years, case when regexp_matches(text, '(?i)(?:^|[^a-z])tables?(?:[^a-z]|$)|表格') then true end as is_table, case when regexp_matches(text, '(?i)中文|chinese') then 'zh' end as filter_lang from read
""")  # fmt: skip
def year_filters(spark, sf_dir):
    asked = _queries(spark, sf_dir).select("query_id", F.concat(T.text_of("text"), _by(F.col("query_id"), _TIMES)).alias("text"))
    return query.enhance(asked).select("query_id", F.array_join("years", ",").alias("years"), "is_table", "filter_lang")


_NAMED = [" MI and Heart Failure", " 服用aspirin后 二甲双胍", " eGFR, ＨＦ; T2DM", " MIDAS", " hmgr inhibitor 2型糖尿病"]
_TABLE = "names as (select * from (values " + ", ".join(
    [f"({_quoted(a)}, 'abbreviation', {_quoted(t)}, false)" for a, t in L.ABBREVIATIONS.items()]
    + [f"({_quoted(z)}, 'zh_term', {_quoted(t)}, false)" for z, t in L.cjk_terms().items()]
    + [f"({_quoted(a)}, 'alias', {_quoted(t)}, true)" for a, t in L.aliases().items() if not any("一" <= c <= "鿿" for c in a)]
) + ") as t(surface, kind, term, folded))"


@_register("query_mentions", f"""
with asked as (select item_id as query_id, trim(regexp_replace(translate(coalesce(text, '') || {_sql_by('item_id', _NAMED)}, {_quoted(_FULL)}, {_quoted(_HALF)}), '\\s+', ' ', 'g')) as t from benchmark), {_TABLE}
select query_id, surface, kind, term, 'curated' as origin from asked, names
where case when kind = 'zh_term' then contains(t, surface) else regexp_matches(case when folded then lower(t) else t end, '(?:^|[^A-Za-z0-9])' || regexp_escape(surface) || '(?:$|[^A-Za-z0-9])') end
""")  # fmt: skip
def query_mentions(spark, sf_dir):
    return query.mentions(_queries(spark, sf_dir).select("query_id", F.concat(T.text_of("text"), _by(F.col("query_id"), _NAMED)).alias("text")))


_FORMS = [" MI", "  HTN risk", " heart failure", ""]


@_register("query_texts", f"""
with asked as (select item_id as query_id, (item_id % 4)::int as k, trim(regexp_replace(coalesce(text, '') || {_sql_by('item_id', _FORMS)}, '\\s+', ' ', 'g')) as cleaned from benchmark),
main as (select *, case k when 0 then regexp_replace(cleaned, ' MI$', ' myocardial infarction (MI)') when 1 then regexp_replace(cleaned, ' HTN risk$', ' hypertension (HTN) risk') else cleaned end as vector_query from asked)
select query_id, cleaned, 'en' as lang, vector_query, case k when 0 then 'myocardial infarction mi ami heart attack' when 1 then 'hypertension htn high blood pressure' when 2 then 'heart failure hf chf cardiac' else '' end as keyword_query,
  case k when 2 then vector_query || ' | ' || replace(cleaned, 'heart failure', 'hf') else vector_query end as variants, case k when 0 then 'myocardial infarction' when 1 then 'hypertension' when 2 then 'heart failure' else '' end as terms from main
""")  # fmt: skip
def query_texts(spark, sf_dir):
    done = query.enhance(_queries(spark, sf_dir).select("query_id", F.concat(T.text_of("text"), _by(F.col("query_id"), _FORMS)).alias("text")))
    return done.select("query_id", "cleaned", "lang", "vector_query", "keyword_query", F.array_join("variants", " | ").alias("variants"), F.array_join("canonical_terms", ",").alias("terms"))


@_register("json_replies", """
with kinds as (select item_id, (item_id % 6)::int as k, '[1, ' || item_id || ']' as ids from benchmark)
select item_id as id, case when k = 5 then null when k = 3 then '{"a": {"b": [1, ' || item_id || ']}}' when k = 4 then '{"a": true, "b": "x"}' else '{"usable_ids": ' || ids || '}' end as json from kinds
""")  # fmt: skip
def json_replies(spark, sf_dir):
    i = F.col("item_id").cast("string")
    forms = [("{%s", "usable_ids", "}"), ("```json\n{%s", "usable_ids", ",}\n```"), ("Well, “this”: {%s", "usable_ids", "} is it.")]
    whole = [F.concat(F.lit(a % '"' + key + '": [1, '), i, F.lit("]" + b)) for a, key, b in forms]
    whole += [F.concat(F.lit('<think>{"x"</think>{“a”: {"b": [1, '), i), F.lit("so {'a': True, b: 'x'}"), F.concat(F.lit("none in "), i)]
    reply = F.get(F.array(*whole), F.pmod("item_id", F.lit(len(whole))).cast("int"))
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), generate.json_udf(reply).alias("json"))


@_register("answer_citations", """
with own as (select doc_id, coalesce(text, '') || ' 【 ' || (doc_id % 9) || '】 [12] [' || (doc_id % 9) || ']' as text from documents),
numbers as (select doc_id, list_sort(list_distinct([12, (doc_id % 9)::int] || list_transform(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: x::int))) as n from own)
select doc_id, array_to_string(n, ',') as cited from numbers
""")  # fmt: skip
def answer_citations(spark, sf_dir):
    i = (F.col("doc_id") % 9).cast("string")
    own = F.concat(T.text_of("text"), F.lit(" 【 "), i, F.lit("】 [12] ["), i, F.lit("]"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.citations(generate.tidy_answer(own)), ",").alias("cited"))
