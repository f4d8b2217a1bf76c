"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import lexicon as L

CJK = "[一-鿿]"
#: Ext-A characters count as CJK where tokens are estimated.
CJK_WIDE = "[㐀-䶿一-鿿]"
LATIN_WORD = "[a-z0-9]+(?:[-'][a-z0-9]+)*"
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def bound(c: Column, f) -> Column:
    """f(c) with c evaluated once: what a lambda takes from outside is evaluated again for each element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def occurrences(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def latin_tokens(c: Column, stop_words: Iterable[str] = L.STOP_WORDS) -> Column:
    """Lower-case words of two characters or more that aren't stop words, in order."""
    found = F.regexp_extract_all(F.lower(text_of(c)), F.lit(f"({LATIN_WORD})"), F.lit(1))
    stop = list(stop_words or ())
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(stop) if stop else F.length(t) >= 2)


def cjk_tokens(c: Column) -> Column:
    """Each CJK character, and each pair of neighbours within a run."""
    runs = F.regexp_extract_all(text_of(c), F.lit(f"({CJK}+)"), F.lit(1))
    grams = lambda r, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - (n - 1), F.lit(1))), lambda i: F.substr(r, i, F.lit(n)))
    return F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 1), F.when(F.length(r) >= 2, grams(r, 2)).otherwise(F.array().cast("array<string>")))))


def tokens(c: Column, stop_words: Iterable[str] = L.STOP_WORDS) -> Column:
    return F.concat(latin_tokens(c, stop_words), cjk_tokens(c))


def half_width(c: Column) -> Column:
    return F.translate(c, _FULL, _HALF)


def clean(c: Column) -> Column:
    """Half-width characters, one space for white space, trimmed; case and punctuation stay."""
    return F.trim(F.regexp_replace(half_width(text_of(c)), r"\s+", " "))


def language(c: Column, zh: float = 0.20, mixed: float = 0.02, inclusive: bool = True) -> Column:
    """zh, mixed or en by the share of CJK characters; chunks and queries differ in thresholds."""
    share = occurrences(text_of(c), CJK) / F.greatest(F.length(text_of(c)), F.lit(1))
    over = (lambda t: share >= t) if inclusive else (lambda t: share > t)
    return F.when(over(zh), "zh").when(over(mixed), "mixed").otherwise("en")


def query_language(c: Column) -> Column:
    return language(c, 0.5, 0.05, inclusive=False)


def estimate_tokens(c: Column, cjk: float = L.CHARS_PER_TOKEN_CJK, other: float = L.CHARS_PER_TOKEN_OTHER, safety: float = L.SAFETY) -> Column:
    """floor((CJK / 1.57 + others / 5.03) * 1.3) + 1; 0 for an empty text."""
    n = occurrences(c, CJK_WIDE)
    return F.when(F.length(c) > 0, F.floor((n / F.lit(cjk) + (F.length(c) - n) / F.lit(other)) * F.lit(safety)) + 1).otherwise(0).cast("long")


def char_shingles(c: Column, n: int = 4) -> Column:
    """The set of n-character runs of the lower-cased text without white space; a text up to n characters is one itself."""
    t = F.regexp_replace(F.lower(text_of(c)), r"\s+", "")
    runs = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length(t) > n, F.array_distinct(runs)).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))


def word_shingles(c: Column, n: int = 5) -> Column:
    """The set of runs of n words of the lower-cased text; a text of fewer words is one itself."""
    words = F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    run = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))
    own = lambda w: F.when(F.size(w) >= n, F.array_distinct(run(w))).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    return bound(words, own)


def word_runs(c: Column, n: int = 5) -> Column:
    """The runs of ``word_shingles`` as hashes of their words' hashes, all of them."""
    words = F.transform(F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.xxhash64(x))
    run = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n))))
    return bound(words, lambda w: F.when(F.size(w) >= n, run(w)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def lines(c: Column) -> Column:
    return F.split(F.regexp_replace(text_of(c), "\r\n?", "\n"), "\n")


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, their lines stripped and joined by a space."""
    parts = F.split(F.regexp_replace(text_of(c), "\r\n?", "\n"), r"\n[ \t]*(?:\n[ \t]*)+")
    joined = F.transform(parts, lambda p: F.trim(F.array_join(F.filter(F.transform(F.split(p, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")))
    return F.filter(joined, lambda p: p != "")


def sentences(c: Column) -> Column:
    """Split after . ; ! ? and white space."""
    return F.filter(F.split(text_of(c), r"(?<=[.;!?])\s+"), lambda s: F.trim(s) != "")


def regions(c: Column) -> Column:
    """struct(body, core, tail_cut): lines after the body mark, and up to the first tail heading."""
    own = lines(c)
    marks = F.filter(F.transform(own, lambda x, i: F.when(F.trim(x).rlike(L.BODY_MARK), i)), lambda i: i.isNotNull())
    start = F.get(marks, F.lit(0))
    body = F.when(start.isNull(), own).otherwise(F.slice(own, start + 2, F.greatest(F.size(own) - start - 1, F.lit(0))))
    tails = F.filter(F.transform(body, lambda x, i: F.when(F.trim(x).rlike(L.TAIL_HEAD), i)), lambda i: i.isNotNull())
    end = F.get(tails, F.lit(0))
    cut = start.isNotNull() & end.isNotNull()
    core = F.when(cut, F.slice(body, F.lit(1), end)).otherwise(body)
    return F.struct(F.array_join(body, "\n").alias("body"), F.array_join(core, "\n").alias("core"), cut.alias("tail_cut"))


def truncate_at_sentence(c: Column, budget: Column | int, cjk: float = L.CHARS_PER_TOKEN_CJK, other: float = L.CHARS_PER_TOKEN_OTHER, safety: float = L.SAFETY) -> Column:
    """Cut to about ``budget`` estimated tokens: after the last sentence end of the final tenth, else of all, else hard."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    share = occurrences(c, CJK_WIDE) / F.greatest(F.length(c), F.lit(1))
    keep = F.floor(budget * (F.lit(cjk) * share + F.lit(other) * (1 - share)) / F.lit(safety)).cast("int")
    head = F.substr(c, F.lit(1), F.greatest(keep, F.lit(0)))
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?。！？；;])", 1)
    late = F.length(whole) > F.floor(keep * 0.9)
    return F.when(estimate_tokens(c) <= budget, c).when(keep <= 0, F.lit("")).when(late | (F.length(whole) > 0), whole).otherwise(F.rtrim(head))


def mojibake_count(c: Column) -> Column:
    total = F.lit(0)
    for mark in L.MOJIBAKE:
        total = total + occurrences(c, "\\Q" + mark + "\\E")
    return total


def header_fields(c: Column, keys: list[str] = L.HEADER_KEYS, limit: int = 80) -> Column:
    """map of the ``Key: value`` lines among the first ``limit``, known keys only, the first of each."""
    pattern = r"^\s*([A-Za-z][A-Za-z /()]*?):\s*(.+?)\s*$"
    known = F.array(*map(F.lit, keys))
    found = F.transform(F.slice(lines(c), 1, limit), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("k"), F.regexp_extract(x, pattern, 2).alias("v")))
    found = F.filter(found, lambda x: F.array_contains(known, x.k))
    first = lambda all_: F.filter(all_, lambda x, i: F.array_position(F.transform(all_, lambda y: y.k), x.k) == i + 1)
    return F.map_from_entries(bound(found, first))


def section_class(line: Column) -> Column:
    """The class of a heading line, cjk_section for a numbered CJK heading, null for any other line."""
    s = F.trim(line)
    names = "|".join(sorted(L.SECTION_CLASSES, key=len, reverse=True))
    name = F.lower(F.regexp_extract(s, rf"(?i)^(?:[0-9]+[.)]?\s*)?({names})\s*[:\-]?$", 1))
    table = F.create_map(*(F.lit(x) for pair in L.SECTION_CLASSES.items() for x in pair))
    return F.when((s == "") | (F.length(s) > 80), None).when(s.rlike(rf"^\d+(\.\d+)*\s+{CJK}"), "cjk_section").when(name != "", F.try_element_at(table, name))


def acronyms(c: Column) -> Column:
    """Upper-case words of 2 to 12 characters that aren't numbers or noise, in order."""
    found = F.regexp_extract_all(text_of(c), F.lit(r"(?<![A-Za-z0-9_])([A-Z0-9]{2,12})(?![A-Za-z0-9_])"), F.lit(1))
    noise = F.array(*map(F.lit, L.NO_ACRONYMS))
    return F.filter(found, lambda t: t.rlike("[A-Z]") & ~F.array_contains(noise, t))


#: ``L.DEFINITION`` in two steps, both in one pass: what stands before an acronym in brackets from its first letter, hyphen or white space on,
#: and in that the leftmost phrase.  No quantifier gives back what it took, since nothing that follows one begins with such a character.
_BEFORE_ACRONYM = r"(?<![A-Za-z\- \t])[A-Za-z\- \t]++\([A-Z][A-Z0-9\-]{1,11}\)"
_DEFINITION = r"([A-Za-z][A-Za-z\-]*+(?:[ \t]++[A-Za-z][A-Za-z\-]*+){1,7}+)[ \t]*+\(([A-Z][A-Z0-9\-]{1,11})\)"


def acronym_definitions(c: Column) -> Column:
    """array of struct(phrase, acronym) from ``full name (ACRO)``, as ``L.DEFINITION`` finds them; phrases up to 70 characters."""
    found = F.regexp_extract_all(text_of(c), F.lit(_BEFORE_ACRONYM), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(*(F.regexp_extract(x, _DEFINITION, i).alias(name) for i, name in ((1, "phrase"), (2, "acronym")))))
    return F.filter(pairs, lambda x: (x.phrase != "") & (F.length(x.phrase) <= L.LONGEST_PHRASE))


def first_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(c), "((?:19|20)[0-9]{2})", 1), F.lit(""))


def is_table(c: Column) -> Column:
    return F.contains(c, F.lit("\t"))


def citations(c: Column) -> Column:
    """The numbers of ``[n]`` marks, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))


def https_url(c: Column) -> Column:
    """s3://bucket/key as https://bucket.s3.amazonaws.com/key without its query."""
    return F.regexp_replace(F.regexp_replace(c, r"^s3://([^/]+)/", "https://$1.s3.amazonaws.com/"), r"\?.*$", "")


def url_md5(c: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(c, r"[?&]md5=([0-9a-fA-F]{32})", 1), F.lit("")))


def id_prefix(c: Column) -> Column:
    """What stands before the first underscore."""
    return F.substring_index(c, "_", 1)


def pmc_id(c: Column) -> Column:
    return F.concat(F.lit("PMC"), F.regexp_replace(F.upper(c), "^PMC", ""))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def any_term(c: Column, terms: list[str]) -> Column:
    """Whether any term is a part of the text, case aside."""
    low = F.lower(text_of(c))
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t.lower()))
    return out
