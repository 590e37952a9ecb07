"""Information-theoretic sanitisation of personal data, in DataFrame expressions only.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers found by pattern. How strongly a term
reveals one is estimated from the corpus: with p the share of documents, the pointwise mutual information
log(p(entity, term) / (p(entity) p(term))) over the entity's own information -log p(entity). At 1 the term gives the entity
away whole, at 0 it says nothing of it. Terms count as together with an entity within a window of letters about it. Terms
over a threshold are generalised, over a higher one removed.

The patterns say the same as plain ones (see ``find``) in a form that reads a text in linear time without a stack: possessive
runs, starts fixed by look-behind, a chain of digits taken only at the lengths that can pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import cut, spread_join

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: a text without it has no find
_SIGN = {"email": "@", "ip": ".", "phone": "+"}
_EDGE = r"[\s,;:!?()\"']"
#: words between white space or marks, so never a part of an address
TERM = rf"(?<={_EDGE})\p{{L}}{{3,}}+(?=\.?{_EDGE})"
WORD = r"\p{L}{3,}+"
WINDOW = 80
MIN_DOCS = 2
GENERALISE, REMOVE = 0.8, 0.95


def running(x: Column) -> Column:
    """Running sums of an array of longs; in blocks of the root of its size, since appending copies."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long"))
    sums = lambda a: F.aggregate(a, F.array().cast("array<bigint>"), lambda acc, v: F.array_append(acc, last(acc) + v))

    def blocked(a: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(a))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / step).cast("int") - 1), lambda j: sums(F.slice(a, j * step + 1, step)))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, sums(F.transform(b, last)), lambda own, head: F.transform(own, lambda v: v + head - last(own)))))

    return let(x, lambda a: F.when(F.size(a) == 0, a).otherwise(blocked(a)))


def located(text: Column, pattern: str, window: int = 0) -> Column:
    """Non-overlapping finds from the left: value, start and end in code points, and up to ``window`` letters on both sides (with a blank for the text's own ends)."""
    finds = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(k: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def rows(g: Column) -> Column:
            ends = running(F.zip_with(k, F.slice(g, F.lit(1), F.size(k)), lambda a, b: (F.length(a) + F.length(b)).cast("long")))
            return let(ends, lambda e: F.transform(k, lambda v, i: _struct(v, F.get(e, i), g, i, window)))

        return let(gaps, rows)

    kind = "array<struct<value:string,start:bigint,end:bigint" + (",left:string,right:string>>" if window else ">>")
    return let(finds, lambda k: F.when(F.size(k) == 0, F.array().cast(kind)).otherwise(place(k)))


def _struct(value: Column, end: Column, gaps: Column, i: Column, window: int) -> Column:
    cols = [value.alias("value"), (end - F.length(value)).alias("start"), end.alias("end")]
    if window:
        cols += [F.right(F.concat(F.lit(" "), F.get(gaps, i)), F.lit(window)).alias("left"), F.left(F.concat(F.get(gaps, i + 1), F.lit(" ")), F.lit(window)).alias("right")]
    return F.struct(*cols)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    def each(d: Column) -> Column:
        n = F.length(d)
        twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        worth = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(d, i, F.lit(1)).cast("int"), lambda x: F.when((n - i) % 2 == 1, twice(x)).otherwise(x)))
        return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0

    return let(_digits(v), each)


def _passes(kind: str, v: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.ltrim(p, F.lit("0")), lambda s: (F.length(s) < 3) | ((F.length(s) == 3) & (s <= "255")))
        return F.forall(F.split(v, r"\."), small)
    if kind == "card":
        return _luhn(v)
    if kind == "phone":
        return F.length(_digits(v)).between(8, 15)
    return F.lit(True)


def _finds(text: Column, kind: str, window: int) -> Column:
    got = F.filter(located(text, PATTERNS[kind], window), lambda f: _passes(kind, f["value"]))
    sign = _SIGN.get(kind)
    return got if sign is None else F.when(F.contains(text, F.lit(sign)), got)


def _context(kind: str, f: Column) -> Column:
    """An entity's name and the terms about it, with their places in the text."""
    name = F.lower(f["value"]) if kind == "email" else f["value"] if kind == "ip" else _digits(f["value"])
    shift = lambda terms, by: F.transform(terms, lambda t: F.struct(F.lower(t["value"]).alias("term"), (t["start"] + by).alias("start"), (t["end"] + by).alias("end")))
    left = shift(located(f["left"], TERM), f["start"] - F.length(f["left"]))
    right = shift(located(f["right"], TERM), f["end"])
    return F.struct(F.concat(F.lit(f"{kind}:"), name).alias("entity"), F.concat(left, right).alias("terms"))


_SPAN = "struct<kind:string,start:bigint,end:bigint>"


def _read(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h1, h2, base, contexts): one pass over the texts; the rest works on what it found."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    h = [F.xxhash64("doc_id", "text", F.lit(s)).alias(f"h{s}") for s in (1, 2)]
    d = d.select("doc_id", *h, *[_finds(text, k, window).alias(k) for k in KINDS])
    span = lambda k: F.transform(k, lambda f: F.struct(F.lit(k).alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    context = lambda k: F.transform(k, lambda f: _context(k, f))
    empty = F.array()
    base = F.concat(*[F.coalesce(span(k), empty.cast(f"array<{_SPAN}>")) for k in KINDS])
    none = empty.cast("array<struct<entity:string,terms:array<struct<term:string,start:bigint,end:bigint>>>>")
    about = F.concat(*[F.coalesce(context(k), none) for k in KINDS])
    return cut(d.select("doc_id", "h1", "h2", base.alias("base"), about.alias("contexts")), "entities")


def disclosures(docs: DataFrame, read: DataFrame, least: float = GENERALISE, text_col: str = "text") -> DataFrame:
    """(entity, term, disclosure) of terms that stand by an entity in ``MIN_DOCS`` documents or more and reveal ``least`` of its information."""
    pair = F.array_distinct(F.flatten(F.transform("contexts", lambda c: F.transform(c["terms"], lambda t: F.struct(c["entity"].alias("entity"), t["term"].alias("term"))))))
    pairs = read.select(F.inline(pair)).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= MIN_DOCS)
    entities = read.select(F.explode(F.array_distinct(F.transform("contexts", lambda c: c["entity"]))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    entities = entities.where(F.col("n_entity") >= MIN_DOCS)
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0)))
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total = F.lit(float(read.count()))
    known = cut(pairs, "pairs")
    terms = cut(known.select("term").distinct().join(terms, "term"), "terms")
    got = cut(spread_join(known, terms, ["term"]).where("n_term is not null"), "terms-known")
    got = spread_join(got, entities, ["entity"])
    shared = F.log(F.col("both") * total / (F.col("n_term") * F.col("n_entity")))
    own = F.log(total / F.col("n_entity"))
    return cut(got.where(own > 0).select("entity", "term", (shared / own).alias("disclosure")).where(F.col("disclosure") >= least), "disclosures")


def find(docs: DataFrame, window: int = WINDOW, least: float = GENERALISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h1, h2, base, spans, levels) for every row.

    ``base``: (kind, start, end) in code points, end exclusive, by kind as in ``KINDS`` and then by start; each kind's finds
    are leftmost and do not overlap, those of other kinds may. E-mail: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip: four
    runs of digits parted by dots, each at most 255; card: digits with at most one blank or hyphen between, 16 to 19 of
    them, that pass Luhn's check; phone: ``\\+[0-9][\\x20().0-9-]+[0-9]`` of 8 to 15 digits; what fails is left out, nothing is tried again
    inside it. ``spans`` adds kind ``term``: words by an entity that reveal ``least`` or more of its information, and
    ``levels`` says how much, in the order of these.

    A null or empty text has no finds; rows that repeat id and text get the same; a null id is kept. An entity that
    all documents hold has no information to reveal. Other columns are ignored; an empty table gives an empty one.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    read = _read(d, window, "doc_id", "text")
    say = disclosures(d, read, least)
    at = read.select("h1", "h2", F.inline("contexts")).select("h1", "h2", "entity", F.inline("terms"))
    said = spread_join(at, say, ["entity", "term"]).where("disclosure is not null")
    said = said.groupBy("h1", "h2", "start", "end").agg(F.max("disclosure").alias("level"))
    said = said.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "level"))).alias("said"))
    out = read.join(said, ["h1", "h2"], "left")
    added = F.transform("said", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    spans = F.concat("base", F.coalesce(added, F.array().cast(f"array<{_SPAN}>")))
    levels = F.coalesce(F.transform("said", lambda s: s["level"]), F.array().cast("array<double>"))
    return out.select("doc_id", "h1", "h2", "base", spans.alias("spans"), levels.alias("levels"))


def sanitise(docs: DataFrame, window: int = WINDOW, least: float = GENERALISE, remove: float = REMOVE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_generalised, n_removed): entities become their kind, revealing terms ``<term>``; those that reveal ``remove`` or more go.

    Where finds overlap the first one counts. Null texts stay null; otherwise as ``find``.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    got = find(d, window, least)
    n = F.size("base")
    marks = F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(F.get("levels", i - n) >= remove, "").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">"))).alias("put")))
    got = got.select("h1", "h2", F.array_sort(marks).alias("marks")).dropDuplicates(["h1", "h2"])
    h = [F.xxhash64("doc_id", "text", F.lit(s)).alias(f"h{s}") for s in (1, 2)]
    j = d.select("*", *h).join(got, ["h1", "h2"], "left")
    cutout = lambda a, b: F.substring(F.col("text"), a.cast("int") + 1, (b - a).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("kept"), F.lit(0).alias("gone"))
    step = lambda acc, m: F.when(m["start"] < acc["at"], acc).otherwise(
        F.struct(m["end"].alias("at"), F.concat(acc["out"], F.array(cutout(acc["at"], m["start"]), m["put"])).alias("out"), (acc["kept"] + (m["put"] != "").cast("int")).alias("kept"), (acc["gone"] + (m["put"] == "").cast("int")).alias("gone"))
    )
    whole = F.aggregate(F.coalesce("marks", F.array().cast("array<struct<start:bigint,end:bigint,put:string>>")), start, step)
    j = j.withColumn("x", whole)
    text = F.when(F.col("text").isNotNull(), F.concat(F.array_join("x.out", ""), cutout(F.col("x.at"), F.length("text").cast("long"))))
    return j.select("doc_id", text.alias("text"), F.col("x.kept").alias("n_generalised"), F.col("x.gone").alias("n_removed"))
