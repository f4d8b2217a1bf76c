"""The operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.chat_format import format_conversations
from quern.llm.common import table
from quern.llm.decontamination import leaks
from quern.llm.html_extraction import extract_pages
from quern.llm.line_dedup import dedup_lines
from quern.llm.ngram_join import jaccard_classes
from quern.llm.packing import pack
from quern.llm.personal_data import personal_data, written_spans
from quern.llm.ppm_scoring import score_documents
from quern.llm.quality_rules import fit_quality_model, quality_rules
from quern.llm.rolling_median import rolling_medians
from quern.llm.token_alignment import align_tokens
from quern.llm.token_counts import token_counts
from quern.llm.toxicity import toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    done = format_conversations(turns.unionByName(extra))
    return done.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", (F.col("rewritten_at") >= 0).alias("rewrites_history"))


_OP1_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked as (
  select *, length('<s>[INST][/INST]</s>')
    + length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) as chars
  from rows
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars, false as rewrites_history
from marked group by conv_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


_OP3_SQL = r"""
with recursive worded as (
  select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents
), sets as (
  select r, doc_id, list_sort(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as s from worded
), classes as (
  select s, min(doc_id) as copy_id, count(*) as n_copies from sets where len(s) > 0 group by s
), shingles as (
  select copy_id, len(s) as n, unnest(s) as x from classes
), pairs as (
  select a.copy_id as a, b.copy_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as n from shingles a join shingles b on a.x = b.x and a.copy_id < b.copy_id group by all
), links as (
  select a, b from pairs where n >= 0.8 * (na + nb - n) - 1e-9 union all select b, a from pairs where n >= 0.8 * (na + nb - n) - 1e-9
), reached as (
  select copy_id as a, copy_id as b from classes union select r.a, l.b from reached r join links l on r.b = l.a
), groups as (
  select a as copy_id, min(b) as class_id from reached group by a
), counts as (
  select a as copy_id, count(*) as n_links from links group by a
)
select t.doc_id, coalesce(g.class_id, t.doc_id) as class_id, coalesce(c.copy_id, t.doc_id) as copy_id,
  coalesce(c.n_copies, 1)::bigint as n_copies, coalesce(n.n_links, 0)::bigint as n_links, len(t.s)::bigint as n_shingles
from sets t left join classes c on t.s = c.s left join groups g on g.copy_id = c.copy_id left join counts n on n.copy_id = c.copy_id
"""


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


#: The driver's pages have their article in one element of that name; what the trees keep must be its blocks.
_OP4_SQL = r"""
with parts as (select page_id, url, list_transform(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'), lambda x:
  trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as p from pages),
texts as (select page_id, url, array_to_string(list_filter(p, lambda x: x <> ''), chr(10) || chr(10)) as text from parts)
select page_id, url, text, length(text)::bigint as n_chars from texts
"""


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules(docs.select("doc_id", "text"), fit_quality_model(docs, labels))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


_OP8_SQL = r"""
with lines as (
  select doc_id, text, i - 1 as pos, string_split(text, chr(10))[i] as line
  from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as t(i)
), worded as (
  select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from lines where regexp_matches(line, '[^\x20\x09-\x0D]')
), summed as (
  select *, row_number() over own as seq, sum(words) over own as upto from worded window own as (partition by doc_id order by pos)
), ends as (
  select a.doc_id, a.seq as first, min(b.seq) as last from summed a join summed b on a.doc_id = b.doc_id and b.seq between a.seq and a.seq + 49 and b.upto - a.upto + a.words >= 50 group by all
  union
  select b.doc_id, max(a.seq), b.seq from summed a join summed b on a.doc_id = b.doc_id and a.seq between b.seq - 49 and b.seq and b.upto - a.upto + a.words >= 50 group by b.doc_id, b.seq
), runs as (
  select e.doc_id, min(s.pos) as first, max(s.pos) as last, string_agg(s.line, chr(10) order by s.seq) as body
  from ends e join summed s on s.doc_id = e.doc_id and s.seq between e.first and e.last group by e.doc_id, e.first, e.last
), later as (
  select doc_id, first, last from (select *, row_number() over (partition by body order by doc_id, first) as n from runs) where n > 1
), gone as (
  select distinct l.doc_id, l.pos from lines l join later r on l.doc_id = r.doc_id and l.pos between r.first and r.last
)
select l.doc_id, coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null), '') as text,
  count(*)::bigint as n_lines, count(g.pos)::bigint as n_deleted
from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as long) as n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(written_spans("base").cast("binary"), 256).alias("base_sha256"), written_spans("spans").alias("spans"))


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op12's base spans."""
    return op12_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


_PERSONAL_DATA_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
found as (
  select doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') as emails, regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') as ips,
    list_transform(regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as cards,
    list_transform(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) as phones
  from t
)
select doc_id, len(emails)::bigint as n_email,
  len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 or length(ltrim(y, '0')) = 3 and ltrim(y, '0') > '255')) = 0))::bigint as n_ip,
  len(list_filter(cards, lambda d: length(d) between 12 and 19 and list_sum(list_transform(range(1, length(d) + 1), lambda i:
    case when (length(d) - i) % 2 = 1 then 2 * d[i]::int - case when d[i] > '4' then 9 else 0 end else d[i]::int end)) % 10 = 0))::bigint as n_card,
  len(list_filter(phones, lambda n: n between 9 and 15))::bigint as n_phone
from found
"""


def op13_rolling_exact_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_medians(table(spark, sf_dir, "clicks"))


_OP13_SQL = """
with ordered as (
  select click_id, ts, kind, case when value is not null and isfinite(value) then floor(100 * value + 0.5)::bigint end as c,
    row_number() over (partition by click_id order by ts, kind nulls first, value nulls first) as r
  from clicks where ts is not null
), framed as (
  select click_id, kind, c, count(c) over w as n, median(c) over w as m, mad(c) over w as d
  from ordered where r = 1 window w as (partition by kind order by ts range between interval '59 minutes 59.999999 seconds' preceding and current row)
), whole as (select *, (2 * m)::bigint as median2, (4 * d)::bigint as mad4 from framed)
select click_id, kind, n, case when n >= 2 then median2 end as median2, case when n >= 2 then mad4 end as mad4,
  case when n >= 2 then 2 * abs(2 * c - median2) > 3 * mad4 end as far from whole
"""


def _rounded(df: DataFrame, column: str, digits: int = 3) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 returns beside the model's score."""
    return _rounded(op5_lm_scoring(spark, sf_dir).drop("score"), "base_score")


_CRC = """gen(i, c, k) as (select i, i::ubigint, 0 from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from gen where k < 8),
crcs as (select list(c order by i) as tab from gen where k = 8),
held as (select doc_id, coalesce(xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::ubigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint) % 10 = 0, true) as held_out from (select distinct doc_id from documents), crcs)"""
_LM_BASE_SQL = rf"""
with recursive {_CRC},
words as (select row_number() over () as r, d.doc_id, held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), '') as w from documents d join held h on d.doc_id is not distinct from h.doc_id),
tokens as (select r, doc_id, held_out, unnest(w) as w from words), counts as (select w, count(*) as c from tokens where not held_out group by w), size as (select sum(c) as n, count(*) as v from counts)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n)::bigint as train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::double) / (n + 0.1::double * (v + 1)))), 3) as base_score
from tokens left join counts using (w), size group by r, doc_id, held_out
"""


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 returns beside the method's verdict."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_QUALITY_BASE_SQL = r"""
with own as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as w from documents),
lines as (select r, line, count(*) as n from (select r, unnest(string_split(text, chr(10))) as line from own) where regexp_matches(line, '[^ 	-
]') group by all),
windows as (select r, i, array_to_string(w[i:i + 7], ' ') as x from (select r, w, unnest(range(1, len(w) - 6)) as i from own where len(w) >= 8)),
again as (select r, i from windows qualify count(*) over (partition by r, x) > 1),
marked as (select r, count(distinct i + k) as n from again, range(8) t(k) group by r),
summed as (select own.r, doc_id, len(w)::bigint as n_words, list_sum(list_transform(w, lambda x: length(x)))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(d.n, 0)::bigint as n_dup_lines, coalesce(m.n, 0)::bigint as n_repeat_words
  from own left join (select r, sum(n - 1) as n from lines group by r) d using (r) left join marked m using (r))
select doc_id, n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from summed
"""


def packing_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of op7's pieces whether every id lies in one of them, and whether all sequences are within their length and gapless."""
    pieces = op7_packing(spark, sf_dir)
    sequences = pieces.groupBy("sequence_id").agg(F.sum("length").alias("ids"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("places"), F.count("*").alias("n"))
    sound = sequences.select("sequence_id", ((F.col("ids") == F.col("end")) & (F.col("end") <= 4096) & (F.col("places") == F.col("n"))).alias("sound"))
    per = pieces.join(sound, "sequence_id").groupBy("doc_id").agg(F.sum("length").alias("held"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens"))).alias("due"), F.min("sound").alias("sound"), F.count_if(F.col("start") == 0).alias("rows"))
    return per.select("doc_id", "rows", (F.col("held") == F.col("due")).alias("covered"), "sound")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_html_extraction": op4_html_extraction,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_token_alignment": op11_token_alignment,
    "op12_personal_data": op12_personal_data,
    "op13_rolling_exact_median": op13_rolling_exact_median,
    "lm_base_scores": lm_base_scores,
    "personal_data_counts": personal_data_counts,
    "quality_base": quality_base,
    "packing_cover": packing_cover,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": _OP1_SQL, "op4_html_extraction": _OP4_SQL, "op3_ngram_jaccard_join": _OP3_SQL, "op8_line_dedup": _OP8_SQL, "op13_rolling_exact_median": _OP13_SQL, "personal_data_counts": _PERSONAL_DATA_SQL, "lm_base_scores": _LM_BASE_SQL, "quality_base": _QUALITY_BASE_SQL,
    "packing_cover": "select doc_id, count(*) as rows, true as covered, true as sound from documents group by doc_id",
}
