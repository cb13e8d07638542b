"""Text predicates and features as native Columns: whole-stage code, no Python in the hot path.

Null counts as the empty string throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
REFERENCE_HEADINGS = ("reference", "references", "references and notes", "bibliography", "works cited", "literature cited")
YEAR = r"(?i)\b(?:18|19|20)\d{2}[a-z]?\b"
DOI = r"(?i)\bdoi\b|10\.\d{4,9}/|https?://"
JOURNAL = (
    r"(?i)\b(?:j\.|journal|chem|phys|soc|rev\.?|lett\.?|commun\.?|proc\.?|science|nature|"
    r"acs|springer|elsevier|wiley|vol\.?|volume|pages?|pp\.?|issue|no\.?)\b"
)
PAGE_RANGE = r"\b\d{1,4}\s*[-–]\s*\d{1,5}\b"
REF_INDEX = r"^(?:\(?\[?\d{1,3}\]?\)?[.)]?\s+)"
AUTHOR_START = (
    r"^(?:\(?\[?\d{1,3}\]?\)?[.)]?\s+)?"
    r"(?:[A-Z][A-Za-z'`.-]+,\s*(?:[A-Z]\.\s*)+"
    r"|[A-Z][A-Za-z'`.-]+(?:\s+[A-Z][A-Za-z'`.-]+){0,2}\s*,\s*(?:[A-Z]\.\s*)+)"
)
COPYRIGHT_TAIL = r"(?i)\b(?:copyright|all rights reserved|trademarks?|registered|unregistered|intellectual property rights?)\b"
COPYRIGHT_SIGNALS = (
    "all rights reserved", "copyright", "trademark", "trademarks", "registered trademark", "registered and unregistered", "intellectual property rights", "key symbol", "periodicals",
)
DISCLAIMERS = (
    "redistribution of this document", "accepts no liability", "written permission", "this material is distributed", "advised to seek independent professional advice",
)
EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
URL_LIKE = r"(?i)^(?:(?:https?://|ftp://|www\.)\S+|(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?:/[A-Za-z0-9._~:/?#\[\]@!$&()*+,;=%-]*)?)$"
EN_WORD = r"[A-Za-z]+(?:[-'][A-Za-z]+)?"
EN_CHUNK = r"[A-Za-z][A-Za-z0-9'./%+\-]*(?:\s+[A-Za-z][A-Za-z0-9'./%+\-]*)*"
PLACEHOLDER = r"<[ft]\d+-[0-9a-z]{3}/>|\[\[FORMULA_\d+\]\]|@@P\d+@@"
PROSE_CUE = (
    r"(?i)\b(a|an|the|this|that|these|those|is|are|was|were|be|been|being|has|have|had|do|does|did|"
    r"can|could|may|might|must|should|would|will|our|their|its|during|through|within|than|"
    r"therefore|however|because|while|where|which|whose|method|function|equation|theory|"
    r"energy|calculation|model|procedure|results|using|used|shows|demonstrates)\b"
)
INDEXED_SYMBOL = r"[A-Za-z_][A-Za-z0-9_]*\([A-Za-z0-9_,]+\)"
FORTRAN_LOOP = r"(?i)\bDO\d+[A-Z]\s*="
FORTRAN_FLOAT = r"(?i)\b\d+(?:\.\d+)?D[+-]?\d+\b"
ALL_CAPS_CODE = r"^[A-Z][A-Z0-9_.-]{3,}$"
CODE_OPERATOR = r"[(){}\[\]=*<>+/,;:]"
HEADING_START = r"^(?:\(?\d+(?:\.\d+)*\)?[.)]?\s+|[A-Z][A-Z\s\-]{3,}|[•\-*]\s+)"
CONTINUATION_STARTS = (
    "and", "or", "but", "with", "without", "whereas", "while", "which", "that", "than", "then", "thus", "therefore", "however", "nevertheless", "moreover", "furthermore", "second",
)
CONTINUATION_ENDS = (
    "the", "a", "an", "of", "to", "for", "with", "and", "or", "but", "that", "these", "those", "this", "two", "three", "four", "five", "several", "many", "more", "less",
)
SUSPICIOUS_ENDS = ("is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "can", "could", "may", "might", "should", "would", "must", "will", "shall")
SHORT_FRAGMENT = r"^[A-Za-z][A-Za-z0-9._/-]{0,7}$"
EDGE_PUNCTUATION = "()[]<>\"'“”‘’,;"
PROMPT_ECHO = (
    r"(?i)^(?:请\s*(?:提供|输入|给出|粘贴|发送)\s*(?:待翻译的?)?\s*(?:原文|文本|内容|source)(?:[。.!！?？\s]*)|"
    r"(?:please\s+)?(?:provide|send|enter|paste)\s+(?:the\s+)?(?:source\s+)?(?:text|content)(?:\s+to\s+translate)?(?:[。.!！?？\s]*))$"
)
PROMPT_ECHO_CHARS = 48
AUTHOR_NAME = r"\b(?:[A-Z]\.\s*)?[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'`´.-]{1,}\b"
# -----------------------------------------------------------------------------


_W = r"[\p{L}\p{N}_]"
_LEFT, _RIGHT = f"(?<!{_W})", f"(?!{_W})"
_EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def edged(pattern: str, right: str = _RIGHT) -> str:
    """The pattern with its first word edge before a word character and its last one as ``right``, by Unicode letters and digits.

    Java's own edge differs by version, and from that of the fixed values, in what it takes for a word character.
    """
    head, *rest = pattern.split(r"\b")
    return head + _LEFT + _EDGE.join(rest[:-1]) + (right if len(rest) > 1 else "") + rest[-1]


_YEAR, _PAGE_RANGE, _PROSE_CUE, _COPYRIGHT_TAIL = map(edged, (YEAR, PAGE_RANGE, PROSE_CUE, COPYRIGHT_TAIL))
_JOURNAL, _AUTHOR_NAME = edged(JOURNAL, _EDGE), edged(AUTHOR_NAME, _EDGE)
_DOI = DOI.replace(r"\bdoi\b", f"{_LEFT}doi{_RIGHT}")
_FORTRAN_LOOP = edged(FORTRAN_LOOP)
# Java walks a repeated group by recursion, which a long text takes beyond the stack.  Possessive groups don't recurse; none
# of these ever needs to give back what it took.
_URL_LIKE = URL_LIKE.replace(r"\.)+[A-Za-z]{2,}", r"\.)++[A-Za-z]{2,}")
_EN_CHUNK = EN_CHUNK.replace("]*)*", "]*+)*+")
_HEADING_START = HEADING_START.replace(r"(?:\.\d+)*", r"(?:\.\d+)*+")
_AUTHOR_START = AUTHOR_START.replace(r"(?:[A-Z]\.\s*)+", r"[A-Z]\.")  # one initial decides
#: Unicode white space.  Java tests the single characters by one table, and the others only where they can be.
SPACES = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
#: A token with an operator or underscore (as in an indexed symbol), in capitals, or with both a letter and a digit (as in a float).
CODEISH = r"(?<!\S)(?:(?=\S*[(){}\[\]=*<>+/,;:_])|(?=[A-Z][A-Z0-9_.-]{3,}(?!\S))|(?=\S*[A-Za-z])(?=\S*\d))\S+"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _chars(c: Column, outside: str) -> Column:
    """How many characters are in a class; ``outside``: its complement.  Makes no string for each character."""
    return F.length(F.regexp_replace(c, f"{outside}+", ""))


def _signs(c: Column, signs: str) -> Column:
    """How many characters are one of ``signs``."""
    if len(signs) <= 2:
        return sum((F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in signs[1:]), F.length(c) - F.length(F.replace(c, F.lit(signs[0]), F.lit(""))))
    return F.length(c) - F.length(F.translate(c, signs, ""))


def _after(cheap: Column, dear: Column) -> Column:
    """Both; ``dear`` is only evaluated where ``cheap`` holds, which shared parts of plain conjunctions are not."""
    return F.when(cheap, dear).otherwise(False)


def _years(t: Column) -> Column:
    return _after(t.contains("19") | t.contains("20") | t.contains("18"), t.rlike(_YEAR))


def _dois(t: Column) -> Column:
    low = F.lower(t)
    return _after(low.contains("doi") | low.contains("10.") | low.contains("://"), t.rlike(_DOI))


def normalize_text(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_text(c), f"{SPACES}+", " "))


def strip_edges(c: Column) -> Column:
    """Trimmed of white space, then of brackets, quotes, commas and semicolons."""
    return F.btrim(F.regexp_replace(_text(c), r"(?U)^\s+|(?<!\s)\s++$", ""), F.lit(EDGE_PUNCTUATION))


def words(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(EN_WORD), F.lit(0))


def last_word(c: Column) -> Column:
    """The last ASCII word, lower-cased; empty where there is none."""
    return F.coalesce(F.lower(F.try_element_at(words(c), F.lit(-1))), F.lit(""))


def english_word_count(c: Column) -> Column:
    return _count(_text(c), EN_WORD)


def natural_word_count(c: Column) -> Column:
    """Number of words of at least three letters (hyphens count)."""
    return F.size(F.filter(words(c), lambda w: F.length(w) >= 3))


def zh_char_count(c: Column) -> Column:
    return _chars(_text(c), r"[^一-鿿]")


def english_chunk_word_lengths(c: Column) -> Column:
    """The number of words of each run of English, without empty runs."""
    runs = F.regexp_extract_all(_text(c), F.lit(_EN_CHUNK), F.lit(0))
    return F.filter(F.transform(runs, lambda r: _count(r, EN_WORD)), lambda n: n > 0)


def strip_placeholders(c: Column) -> Column:
    return F.regexp_replace(_text(c), PLACEHOLDER, " ")


def placeholder_sequence(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(PLACEHOLDER), F.lit(0))


def alpha_count(c: Column) -> Column:
    return _chars(_text(c), r"\P{L}")


def preview_text(c: Column, limit: int = 220) -> Column:
    """Normalised text; longer than the limit, one character less and an ellipsis."""
    t = normalize_text(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(limit - 1))), F.lit("…")))


# Rules take any text.  With ``clean`` they take text that is normalised already, so that a plan normalises it once.


def _clean(c: Column, clean: bool) -> Column:
    return _text(c) if clean else normalize_text(c)


# --- references ----------------------------------------------------------------


def normalize_reference_heading(c: Column, clean: bool = False) -> Column:
    low = F.replace(F.lower(_clean(c, clean)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[^a-z ]+", " "), " +", " "))


def is_reference_heading(c: Column, clean: bool = False) -> Column:
    low = F.lower(_text(c))
    return _after(_any([low.contains(x) for x in ("reference", "bibliography", "cited")]), normalize_reference_heading(c, clean).isin(*REFERENCE_HEADINGS))


def is_reference_entry(c: Column, clean: bool = False) -> Column:
    """A year, DOI, journal word, page range, list index or author start in one of five combinations."""
    t = _clean(c, clean)
    commas = _signs(t, ",;")
    year, doi = _years(t), _dois(t)
    led = t.rlike(REF_INDEX) | t.rlike(_AUTHOR_START)
    # the dear patterns stand last and once
    certain = (doi & (year | (commas >= 1))) | (led & (year | doi | (commas >= 2)))
    return (t != "") & (certain | _after(led | (year & (commas >= 1)), t.rlike(_PAGE_RANGE) | t.rlike(_JOURNAL)))


def is_reference_continuation(c: Column, clean: bool = False) -> Column:
    t = _clean(c, clean)
    dated = _years(t) & ((F.length(t) <= 240) | (_signs(t, ",") >= 1))
    return (t != "") & (t.rlike(r"^[a-z(\\\[\"'`\)\],.;:]") | dated | _dois(t) | t.rlike(_PAGE_RANGE) | t.rlike(_JOURNAL))


# --- metadata ------------------------------------------------------------------


def is_url_fragment(c: Column) -> Column:
    t = strip_edges(c)
    return (t != "") & ~t.rlike(r"(?U)\s") & t.rlike(_URL_LIKE)


def is_email_fragment(c: Column) -> Column:
    return strip_edges(c).rlike(f"^(?:{EMAIL})$")


def is_short_copyright_tail(c: Column, clean: bool = False) -> Column:
    t = _clean(c, clean)
    # the lower-case text is made once
    signal = F.exists(F.array(F.lower(t)), lambda low: _any([low.contains(x) for x in COPYRIGHT_SIGNALS]) & ~_any([low.contains(x) for x in DISCLAIMERS]))
    return _after(F.length(t).between(1, 220), _after(signal, t.rlike(_COPYRIGHT_TAIL) & (_count(t, EN_WORD) <= 32)))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def is_hard_metadata(c: Column, clean: bool = False) -> Column:
    t = _clean(c, clean)
    return _after(~t.contains(" ") & (t != ""), is_url_fragment(t) | is_email_fragment(t)) | is_short_copyright_tail(t, clean=True)


# --- code and prose --------------------------------------------------------------


def is_code_literal(c: Column, clean: bool = False) -> Column:
    """Tokens that look like code outweigh prose; texts of under 24 characters, with CJK or outside 2 to 64 tokens are not code."""
    t = _clean(c, clean)
    n = _signs(t, " ") + 1
    loop = t.rlike(_FORTRAN_LOOP)
    codeish = _count(t, CODEISH) >= F.when(loop, 2).otherwise(F.greatest(F.lit(3), F.floor(n / 2)))
    upper = _chars(t, r"\P{Lu}") / F.greatest(F.lit(1), alpha_count(t))
    dense = (_signs(t, "(){}[]=*<>+/,;:") >= F.greatest(F.lit(6), F.floor(F.length(t) / 18))) | (natural_word_count(t) <= 4) | ((upper >= 0.55) & ~t.rlike(_PROSE_CUE))
    # the least number of such tokens, by the signs, digits and capitals that each of them needs; a loop has an equals sign.  Java tests
    # single characters of a class by one table, ranges one by one
    signs = F.length(F.regexp_replace(t, r"[^(){}\[\]=*<>+/,;:_0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ]+", ""))
    likely = F.when(t.contains("="), 2).otherwise(F.greatest(F.lit(3), F.floor(n / 2))) <= signs
    return _after((F.length(t) >= 24) & n.between(2, 64), _after(likely, _after(codeish, ~t.rlike(r"[一-鿿]") & (loop | dense))))


def is_english_prose(c: Column, code: Column | None = None) -> Column:
    """``code``: is_code_literal() of the text, where that is known already; it decides for texts without placeholders."""
    t = F.trim(strip_placeholders(c))
    linked = t.contains("@") | t.contains("http://") | t.contains("https://") | _after(~t.contains(" "), is_url_fragment(t))
    literal = is_code_literal(t) if code is None else F.when(_text(c).rlike(PLACEHOLDER), is_code_literal(t)).otherwise(code)
    return _after((F.length(t) >= 30) & ~linked, _after((_count(t, EN_WORD) >= 8) & (alpha_count(t) >= 30), ~literal))


def is_short_fragment(c: Column) -> Column:
    return F.trim(_text(c)).rlike(SHORT_FRAGMENT)


def is_garbled(c: Column) -> Column:
    """A replacement character, or over 35 % of the visible characters neither alphanumeric nor common punctuation."""
    t = F.trim(strip_placeholders(c))
    visible = _chars(t, r"\s")
    weird = _chars(t, r"[\s\p{L}\p{N}.,;:!?()\[\]{}'\"_/+*&%$#=@-]")
    return (t == "") | t.contains("�") | (weird / F.greatest(F.lit(1), visible) > 0.35)


def is_cjk_dominant(c: Column, clean: bool = False) -> Column:
    t = _clean(c, clean)
    cjk = zh_char_count(t)
    # ten such characters have twenty bytes more than characters; few texts come to the patterns
    return _after((F.length(t) >= 16) & (F.octet_length(t) - F.length(t) >= 20), _after(cjk >= 10, cjk >= F.greatest(2 * _chars(t, "[^A-Za-z]"), 2 * _count(t, EN_WORD))))


def is_author_list(c: Column) -> Column:
    """Three or more comma-separated segments, all but one of them names of two to five words."""
    t = F.trim(strip_placeholders(c))
    parts = F.transform(F.split(F.replace(t, F.lit(" and "), F.lit(", ")), f",|;|{_LEFT}and{_RIGHT}"), lambda s: F.btrim(s, F.lit(" *†‡§,;")))
    parts = F.filter(parts, lambda s: s != "")
    named = F.size(F.filter(parts, lambda s: F.regexp_count(s, F.lit(_AUTHOR_NAME)).between(2, 5)))
    free = ~t.contains("@") & ~t.contains("http://") & ~t.contains("https://")
    return (t != "") & (F.length(t) <= 240) & free & (F.size(parts) >= 3) & (named >= F.greatest(F.lit(3), F.size(parts) - 1))


def has_balanced_math(c: Column) -> Column:
    """An even number of dollar signs without a backslash before them."""
    return _count(_text(c), r"(?<!\\)\$") % 2 == 0


def is_protocol_shell(c: Column) -> Column:
    t = F.trim(_text(c))
    echo = (F.length(t) <= PROMPT_ECHO_CHARS) & t.rlike(PROMPT_ECHO)
    keyed = _any([t.contains(x) for x in ('"translated_text"', '"translations"', "“translated_text”", "“translations”")])
    return (t != "") & (echo | (t.startswith("{") & keyed))


# --- continuation ------------------------------------------------------------------


def starts_like_continuation(c: Column, clean: bool = False) -> Column:
    """A lower-case start, or a listed word as the last word of the first 32 characters."""
    t = _clean(c, clean)
    return (t != "") & (t.rlike("^[a-z]") | last_word(F.left(t, F.lit(32))).isin(*CONTINUATION_STARTS))


def ends_like_continuation(c: Column, clean: bool = False) -> Column:
    t = _clean(c, clean)
    return (t != "") & (t.endswith("-") | (~t.rlike("[.!?:;]$") & last_word(t).isin(*CONTINUATION_ENDS)))


def starts_like_heading_or_list(c: Column, clean: bool = False) -> Column:
    return _clean(c, clean).rlike(_HEADING_START)


def last_token_is_suspicious(c: Column) -> Column:
    return last_word(c).isin(*SUSPICIOUS_ENDS)
