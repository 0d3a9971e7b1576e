"""Scalar text functions, as expressions; Python runs only for what Spark has no built-in for, and only on texts that need it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whitespace as Python's str.split() and \s see it.
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"
#: A letter, digit or underscore of any script.
WORD = r"[\p{L}\p{N}_]"
#: Fixed value: HTML and JATS tags whose attributes are well formed, so that "a<b and c>d" stays.
MARKUP = r"""(?i)</?(?:i|b|u|em|strong|sub|sup|scp|span|p|jats:[a-z-]+)(?:\s+[a-z:-]+=(?:"[^"]*"|'[^']*'))*\s*/?>"""
#: The most digits after the point of a new arXiv id, the form of DOIs, and how addresses may start.
ARXIV_DIGITS = 5
DOI_FORM = r"10\.\d{4,9}/\S+"
SCHEMES = ("", "http://", "https://")


def squeeze(c: Column) -> Column:
    """Runs of whitespace become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def strip_markup(c: Column, by: str = "") -> Column:
    return F.regexp_replace(c, MARKUP, by)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


#: What html.unescape() takes for a character reference, each by itself.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _unescape(references: pa.Array) -> pa.Array:
    import html

    import pyarrow.compute as pc

    flat = references.flatten().dictionary_encode()
    plain = pa.array([html.unescape(t) for t in flat.dictionary.to_pylist()], pa.string())
    counts = pc.fill_null(pc.list_value_length(references), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *counts.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, plain.take(flat.indices), mask=references.is_null() if references.null_count else None)


def unescape(c: Column) -> Column:
    """Character references become characters; only the references go through Python, not the text around them."""
    some = F.contains(c, F.lit("&"))
    plain = _unescape(F.when(some, F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))))
    between = F.split(c, REFERENCE, -1)
    return F.when(some, F.array_join(F.zip_with(between, plain, lambda text, character: F.concat(text, F.coalesce(character, F.lit("")))), "")).otherwise(c)


@cache
def _combining() -> str:
    """A character class of all combining marks."""
    import unicodedata

    marks, spans = [i for i in range(0x110000) if unicodedata.combining(chr(i))], []
    for i in marks:
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{z:x}}}" for a, z in spans) + "]"


@cache
def _decompose():
    """A function of a column; the class of marks is made on the driver and sent along."""
    marks = _combining()

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        return pc.replace_substring_regex(pc.utf8_normalize(texts.cast(pa.string()), form="NFKD"), pattern=marks, replacement="")

    return run


def without_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; ASCII texts are their own."""
    plain = c.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, c).otherwise(_decompose()(F.when(~plain, c)))


def norm_title(c: Column) -> Column:
    """A title's form for comparison: no accents, markup, case or punctuation; letters of every script stay."""
    return F.trim(F.regexp_replace(F.lower(strip_markup(without_accents(F.coalesce(c, F.lit(""))), " ")), r"[^\p{L}\p{N}]+", " "))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is reckoned once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _after(c: Column, lead: str) -> Column:
    """What follows the first `lead`, whatever its case; null if there is none."""
    return _let(c, lambda x: F.when(F.locate(lead, F.lower(x)) > 0, F.substring(x, F.locate(lead, F.lower(x)) + len(lead), F.length(x))))


def _before(c: Column, mark: str) -> Column:
    return F.substring_index(F.lower(c), mark, 1)


def _bare_doi(item: Column) -> Column:
    """A trimmed reference without the resolver or the word that announces a DOI."""
    resolver = _before(item, "doi.org/").isin([scheme + host for scheme in SCHEMES for host in ("", "dx.")])
    named = F.when(F.startswith(F.lower(item), F.lit("doi:")), _after(item, "doi:"))
    return _trimmed(F.coalesce(F.when(resolver, _after(item, "doi.org/")), named, item))


def norm_doi(c: Column) -> Column:
    """Lower-case DOI without its prefix or resolver; null if it doesn't start with 10."""
    return _let(_trimmed(c), lambda item: _let(F.lower(_bare_doi(item)), lambda bare: F.when(F.startswith(bare, F.lit("10.")), bare)))


def _arxiv_path(item: Column, *sections: str) -> Column:
    """What an arXiv address names in one of its sections, without file ending and parameters; null for anything else."""
    name = lambda path: F.rtrim(F.get(F.split(_after(path, "/"), "[?#]"), F.lit(0)), F.lit("/"))
    return _let(_after(item, "arxiv.org/"), lambda path: F.when(_before(path, "/").isin(*sections), _no_pdf(name(path))))


def _no_pdf(c: Column) -> Column:
    return _let(c, lambda x: F.when(F.endswith(F.lower(x), F.lit(".pdf")), F.left(x, F.length(x) - 4)).otherwise(x))


def _arxiv_form(digits: int | None) -> str:
    """The form of arXiv ids, new and old ones; new ones have four digits after the point at least, and any number of them for None."""
    return rf"\d{{4}}\.\d{{4,{digits or ''}}}|[a-z-]+(?:\.[a-z]{{2}})?/\d{{7}}"


def norm_arxiv(c: Column, digits: int | None = ARXIV_DIGITS) -> Column:
    """arXiv id from an id or address, without version; null if it is none. Old ids keep their case."""
    said = _let(_trimmed(c), lambda item: F.coalesce(_arxiv_path(item, "abs", "pdf", "html"), item))
    bare = _let(said, lambda x: F.when(F.startswith(F.lower(x), F.lit("arxiv:")), _trimmed(_after(x, "arxiv:"))).otherwise(x))
    return blank_to_null(F.regexp_extract(bare, rf"(?i)^({_arxiv_form(digits)})(?:v[0-9]+)?$", 1))


def arxiv_of_doi(doi: Column) -> Column:
    """The id in arXiv's own DOIs, else null."""
    return blank_to_null(F.regexp_extract(doi, r"(?i)^10\.48550/arxiv\.(.+)$", 1))


def shorten(c: Column, n: int) -> Column:
    """Squeezed text of n characters at most, the last an ellipsis where some went; null is empty."""
    text = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…")))


def authors_label(c: Column, most: int = 6) -> Column:
    """The first names, and how many more there are."""
    more = F.size(c) - most
    return F.concat(F.array_join(F.slice(c, 1, most), ", "), F.when(more > 0, F.concat(F.lit(", … (+"), more.cast("string"), F.lit(")"))).otherwise(""))


def literal_cell(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula, kept as text."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def redact(c: Column) -> Column:
    """Secrets in an address's parameters are hidden."""
    return F.regexp_replace(c, r"(?i)((?:api[_-]?key|apikey|key|token|secret|password|mailto|email)=)[^&#\s]+", "$1***")


def abstract_of_index(c: Column) -> Column:
    """Text of an inverted index (word -> positions), in order of position and, in a tie, of word."""
    pairs = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["word"]), " ")


def _arxiv_reference(item: Column, digits: int | None) -> Column:
    """The id of a user's reference that is an arXiv id or nothing but an address of one, else null."""
    elsewhere = F.contains(F.lower(item), F.lit("arxiv.org/")) & ~(_before(item, "arxiv.org/").isin(*SCHEMES) & _arxiv_path(item, "abs", "pdf").isNotNull() & ~item.rlike("[?#]|/$"))
    return F.when(~elsewhere, norm_arxiv(_no_pdf(item), digits))


def _reference(c: Column, digits: int | None) -> Column:
    """(kind, value) of a user's reference."""

    def read(item: Column) -> Column:
        told = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        doi = _let(_bare_doi(item), lambda bare: F.when(bare.rlike(f"^{DOI_FORM}$"), told("doi", F.lower(bare))))
        arxiv = _let(_arxiv_reference(item, digits), lambda known: F.when(known.isNotNull(), told("arxiv", known)))
        return F.coalesce(doi, arxiv, F.when(item.rlike("^[0-9a-f]{40}$"), told("s2", item)), told("title", item))

    return _let(_trimmed(c), read)


def reference_kind(c: Column, digits: int | None = ARXIV_DIGITS) -> Column:
    """doi, arxiv, s2 or title: what a user's reference looks like."""
    return F.coalesce(_reference(c, digits)["kind"], F.lit("title"))


def reference_value(c: Column, digits: int | None = ARXIV_DIGITS) -> Column:
    """A user's reference in normal form."""
    return _reference(c, digits)["value"]


def clamped(c: Column) -> Column:
    """A number within [0, 1] from text; null if it is none; what is not a number at all (NaN) counts as 1."""
    x = c.try_cast("double")
    return F.when(F.isnan(x), 1.0).when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def slug(text: str, most: int = 40) -> str:
    """A folder name for a topic."""
    import re
    import unicodedata

    ascii_only = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return "-".join(re.findall("[A-Za-z0-9]+", ascii_only)).lower()[:most].rstrip("-") or "review"
