"""Labels, marks and tokens as Column expressions.

All but ``nfc`` run inside generated code. Regular expressions carry ``(?U)`` where letters beyond ASCII count.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

MARK = r"\[[^\]]*\]|\{[^}]*\}"
_NAME = r"(?U)^\p{Lu}[\w']*$"
_ELIDED_NAME = r"(?U)^(?=[^']*\p{Ll})[^'\p{Lu}]*'\p{Lu}[\w']*$"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a lambda would compute an outer expression once an element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfc(c: Column) -> Column:
    """Unicode NFC; Spark has no built-in. Texts of code points below U+0300 are NFC as they are, so only others go through Arrow."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.coalesce(run(F.when(c.rlike("[^\\x00-\\x{2FF}]"), c)), c)


#: code points of the first plane that full case folding does not simply lower (a capital sigma is lowered by its place in a word)
_FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x10000)) if c.lower() != c.casefold()} | {"Σ": "σ"}
_COMMON = {"ß": "ss", "ẞ": "ss"}


def _class(chars) -> str:
    """A character class of ranges: a class that names every character by itself is tried character by character."""
    runs: list[list[int]] = []
    for n in sorted(map(ord, chars)):
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def casefold(c: Column) -> Column:
    """Full case folding. ASCII is only lowered; only texts with a code point that folds in a way of its own are taken apart."""

    def fold(x: Column) -> Column:
        rare = {k: v for k, v in _FOLDED.items() if k not in _COMMON}
        table = F.create_map(*[F.lit(y) for kv in rare.items() for y in kv])
        for k, v in _COMMON.items():
            x = F.replace(x, F.lit(k), F.lit(v))
        apart = F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), F.lower(ch))), "")
        return F.when(x.rlike(_class(rare)), apart).otherwise(F.lower(x))

    return let(c, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), fold(x)).otherwise(F.lower(x)))


def upper_each(c: Column) -> Column:
    """Upper case letter for letter, as SQL's: a letter whose capital is several code points keeps to one."""
    one = lambda ch: F.coalesce(*[F.when(F.length(x) == 1, x) for x in (F.upper(ch), F.initcap(ch))], ch)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(F.replace(c, F.lit("ß"), F.lit("ẞ")), ""), one), "")).otherwise(F.upper(c))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_label(c: Column) -> Column:
    """Apostrophes made plain, white space collapsed. Text not known to be NFC goes through ``nfc`` first."""
    return collapse(F.translate(c, V.APOSTROPHES, "'" * len(V.APOSTROPHES)))


def fold_key(c: Column) -> Column:
    """Case folded, without one elided and then one plain leading article. Not idempotent: apply once."""
    s = casefold(norm_label(c))
    s = F.regexp_replace(s, r"(?U)^(?:l'|'l)\s*", "")
    return F.trim(F.regexp_replace(s, r"(?U)^(?:" + "|".join(V.ARTICLES) + r")\s+", ""))


def pieces(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), norm_label), lambda p: p != "")


def _word_kind(w: Column, i: Column) -> Column:
    """2 a name word, 1 a connector, 0 neither."""
    low = F.lower(w)
    return (
        F.when(low.isin(*V.PREPOSITIONS, *V.TITLES), 1)
        .when((i > 0) & low.isin(*V.INFIX_ARTICLES), 1)
        .when(w.rlike(_NAME) | w.rlike(_ELIDED_NAME), 2)
        .otherwise(0)
    )


def is_capitalized_name(c: Column) -> Column:
    words = F.filter(F.split(collapse(c), " "), lambda w: w != "")
    kinds = F.transform(words, _word_kind)
    return (F.size(words) > 0) & ~F.exists(kinds, lambda k: k == 0) & F.exists(kinds, lambda k: k == 2)


def is_deictic(c: Column) -> Column:
    return F.get(F.split(F.lower(norm_label(c)), " "), F.lit(0)).isin(*V.DEICTIC_HEADS)


def mixed_bundle_pieces(c: Column) -> Column:
    """The un-named pieces of a comma label that has both named and un-named ones, else an empty array."""
    p = pieces(c)
    none = F.array().cast("array<string>")
    mixed = lambda rest: F.when((F.size(p) >= 2) & (F.size(rest) > 0) & (F.size(rest) < F.size(p)), rest).otherwise(none)
    return F.when(c.contains(","), let(F.filter(p, lambda x: ~is_capitalized_name(x)), mixed)).otherwise(none)


def fix_elision(c: Column) -> Column:
    """Contract an elidable determiner before a vowel, keeping its case."""
    by_end = {e: "|".join(sorted({w[:-1] for w in V.ELIDABLE if w.endswith(e)}, key=len, reverse=True)) for e in "oa"}
    stems = "|".join(f"(?:{s})(?={e})" for e, s in by_end.items())
    return F.regexp_replace(c, rf"(?iU)\b({stems})[oa]\s+([{V.VOWELS}]\w*)", "$1'$2")


def marks(line: Column) -> Column:
    """The marks of a line, in order."""
    return F.regexp_extract_all(line, F.lit(MARK), F.lit(0))


def splice_marks(line: Column, before: Column) -> Column:
    """The line with a number behind each mark's opening delimiter, counted on from ``before``, the marks of the scene's earlier lines."""
    z = F.arrays_zip(F.split(line, MARK, -1).alias("p"), marks(line).alias("k"))
    number = lambda k, i: F.concat(F.substring(k, 1, 1), (before + i + 1).cast("string"), F.lit(":"), F.substring(k, 2, 1 << 30))
    return F.array_join(F.transform(z, lambda x, i: F.concat(x["p"], F.coalesce(number(x["k"], i), F.lit("")))), "")


def mark_kind(mark: Column) -> Column:
    return F.when(F.substring(mark, 1, 1) == "{", "name").otherwise("pron")


def mark_surface(mark: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(mark, r"^.|.$", ""), r"^\++", "")


def _collapsed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ ", "")


_AT = "\u0001"


def mark_gaps(line: Column) -> Column:
    """The lengths of what stands between the marks of a white-space-collapsed line, marks' surfaces counted to what follows them.

    The sum up to a mark is the column of its surface in the un-marked line. A sentinel takes each mark's place, once over the line;
    white space that only a supplied subject parts counts once, before it.
    """
    s = F.regexp_replace(line, r"\[\+[^\]]*\]", _AT)
    s = F.regexp_replace(s, r"\[\+*([^\]]*)\]|\{\+*([^}]*)\}", _AT + "$1$2")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), f" (?<=(?:^| ){_AT}{{1,9}} )", "")
    return F.transform(F.split(F.regexp_replace(s, "^ ", ""), _AT), F.length)


def mark_columns(line: Column) -> Column:
    """For each mark the column of its surface in the un-marked line; for many marks a line, sum ``mark_gaps`` in a window instead."""
    upto = lambda n: F.transform(F.sequence(F.lit(1), F.size(n) - 1), lambda i: F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    return let(mark_gaps(line), lambda n: F.when(F.size(n) > 1, upto(n)).otherwise(F.array().cast("array<int>")))


def strip_to_source(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(line, r"\[\+[^\]]*\]", ""), r"\[\+*([^\]]*)\]|\{\+*([^}]*)\}", "$1$2")
    return _collapsed(bare)


def unbrace(c: Column) -> Column:
    return F.translate(c, "{}`", "[]")


def bullets(text: Column) -> Column:
    lines = F.filter(F.split(text, r"\R"), lambda x: x.rlike(r"^\s*[-*]\s+.*\S"))
    return F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*[-*]\s+(.*\S)\s*$", 1))


def markup_problem(reply: Column, source: Column) -> Column:
    """Why a marked line does not round-trip to its source, or null."""
    plain = F.regexp_replace(F.translate(reply, "{}", ""), r"\[\+[^\]]*\]", "")
    count = lambda ch: F.length(reply) - F.length(F.translate(reply, ch, ""))
    return (
        F.when(reply.isNull(), "missing")
        .when(collapse(F.translate(plain, "[]", "")) != collapse(source), "differs")
        .when(count("{") != count("}"), "unbalanced")
        .when(F.translate(reply, " ", "").contains("{}"), "empty mark")
        .when(reply.rlike(r"(\[\+[^\]]*\])\s*\1"), "doubled")
    )


def content_tokens(c: Column) -> Column:
    words = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0)), F.lower))
    return F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(*V.CONTENT_STOP))


def heads_name(bare: Column, fuller: Column) -> Column:
    """Does ``bare`` stand in ``fuller`` not governed by the word before it."""
    led = lambda toks: F.transform(toks, lambda t, i: (t == bare) & ((i == 0) | ~F.lower(F.get(toks, F.greatest(i - 1, F.lit(0)))).isin(*V.GOVERNORS)))
    return F.exists(let(F.split(collapse(fuller), " "), led), lambda x: x)


def strip_possessive(c: Column) -> Column:
    return F.regexp_replace(c, "'s$", "")


def sentences(c: Column) -> Column:
    return F.split(F.trim(c), r"(?<=[.!?])\s+")


def name_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ']*"), F.lit(0))


def mark_terms(text: Column, terms: Column) -> Column:
    """``*``-wrap every licensed term, the longest first, unless it is wrapped already or stands inside a word.

    Terms are filed under their first letters, so a word is tried against those of its own letter only.
    """
    ordered = F.array_sort(F.array_distinct(F.filter(terms, lambda t: t != "")), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    first = lambda t: F.lower(F.substring(t, 1, 1))

    def pattern(sorted_terms: Column) -> Column:
        files = F.array_distinct(F.transform(sorted_terms, first))
        own = lambda c: F.array_join(F.transform(F.filter(sorted_terms, lambda t: first(t) == c), quoted), "|")
        return F.concat(F.lit(r"(?iU)(?<![*\w])(?:"), F.array_join(F.transform(files, lambda c: F.concat(F.lit("(?="), quoted(c), F.lit(")(?:"), own(c), F.lit(")"))), "|"), F.lit(r")(?![*\w])"))

    return F.when(F.size(ordered) > 0, F.regexp_replace(text, let(ordered, pattern), F.lit("*$0*"))).otherwise(text)


#: what opens a line that is no prose: fixed values
NO_PROSE = r"^[*\-\[{#]"


def prose(text: Column) -> Column:
    """A text's lines that are neither blank, bullets, marks nor headings, white space at their ends taken off."""
    lines = F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(NO_PROSE))


def latin_words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit("[a-z][a-z'-]*"), F.lit(0))


def is_verb_like(word: Column) -> Column:
    """Has a word the form of a third person singular, and is none of the words that only look so?"""
    return (F.length(word) > 3) & word.endswith("s") & ~word.rlike("(?:ss|ous|is)$") & ~word.contains("'") & ~word.isin(*V.NO_VERBS)


def capitalised_runs(text: Column) -> Column:
    """Every stretch of capitalised words of a text, with the word before it."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(?:^|\s)((?:\S+\s+)?\p{Lu}\S*+(?:\s+\p{Lu}\S*+)*+)"), F.lit(1)), collapse)


def is_echo(name: Column, surface: Column) -> Column:
    """Does a name only repeat the surface, apostrophes at its ends and case aside?"""
    bare = lambda c: F.lower(F.regexp_replace(F.trim(c), "^'+|'+$", ""))
    return bare(name) == bare(surface)


#: numbered lines and the lines allowed beside them: fixed values
NUMBERED = r"^\s*(\d+)[:.\s]\s*(.*\S)\s*$"
FENCE = "```"


def numbered(text: Column) -> Column:
    """A reply's ``n text`` lines as a map, the last of a number winning."""
    lines = F.filter(F.split(text, r"\R"), lambda x: x.rlike(NUMBERED))
    number = lambda x: F.regexp_extract(x, NUMBERED, 1).cast("int")
    last = F.filter(lines, lambda x, i: ~F.exists(F.slice(lines, i + 2, F.size(lines)), lambda y: number(y) == number(x)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(number(x).alias("key"), F.regexp_extract(x, NUMBERED, 2).alias("value"))))


def extraneous(text: Column) -> Column:
    """A reply's lines that are neither numbered, blank nor a code fence."""
    lines = F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith(FENCE) & ~x.rlike(NUMBERED))


def numbered_source(lines: Column) -> Column:
    """Structs (line, text), in order of line, as ``n text`` lines."""
    return F.array_join(F.transform(F.array_sort(lines), lambda x: F.concat(x["line"].cast("string"), F.lit(" "), x["text"])), "\n")


def in_scene(lo: Column, hi: Column, start: Column, end: Column) -> Column:
    return (lo <= start) & (end <= hi)


def edge_party(node: Column, name: Column) -> Column:
    """An end's node, or its name where it has none."""
    return F.coalesce(F.nullif(node, F.lit("")), name)


def grammar(line: Column, pattern: str, *names: str) -> list[Column]:
    """Named groups of one line format, empty matches as null."""
    return [F.nullif(F.regexp_extract(line, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)]
