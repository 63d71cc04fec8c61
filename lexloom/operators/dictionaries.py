"""Entries of printed dictionaries from their lines of text, and one row for each headword of a source.

A book is parsed as a plan over its lines: its section is cut out, page numbers follow running heads, lines that start
an entry are marked, and the lines up to the next start are put together and taken apart. What depends on earlier
decisions (pages, alphabetical order) is a streamed fold; the rest are windows and column expressions. `volume` keeps
several texts apart, so that many books of a layout are parsed in one plan.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entries as D
from ..functions.text import clean_gloss, headword_key, let, part_of_speech, plain_quotes, squash
from .folds import folded

#: A parsed entry, before headwords are normalised.
RECORD = ["source", "ord", "head", "variants", "gloss_en", "gloss_fr", "pos", "page", "notes"]
#: Bounds of a headword: letters, letters and spaces, words.
LEAST_LETTERS, MOST_LETTERS, MOST_WORDS = 2, 44, 4


@dataclass(frozen=True)
class Layout:
    """How entries stand in a section of a book.

    begins, ends: patterns of the lines around the section; heads: of running heads, with the page number as group 1;
    noise: lines that belong to no entry; start, record: see functions/entries.py; order: `recent` or `letter`, how a
    start must stand in the alphabet; bare: whether a line of digits alone is a page number.
    """

    source: str
    begins: str
    ends: str
    start: Callable[[Column], Column]
    record: Callable[[Column], Column]
    heads: tuple[str, ...] = ()
    noise: str = r"^$"
    order: str | None = None
    first_page: int | None = 1
    low: int = 0
    high: int = 999
    bare: bool = False
    quotes: bool = False
    hyphens: bool = False


def _pages(layout: Layout, first: int | None) -> Callable[[], Callable]:
    """A step that tells the page of a line: a head counts one page up unless its number is up to three ahead; a bare number may be up to twelve ahead."""

    def begin() -> Callable[[bool, int | None, int | None], int | None]:
        page = first

        def step(head: bool, number: int | None, bare: int | None) -> int | None:
            nonlocal page
            known = page or 0
            within = lambda n, ahead: n is not None and known < n <= known + ahead and layout.low <= n <= layout.high
            if head:
                page = number if within(number, 3) else known + 1
            elif within(bare, 12) or (page is None and bare is not None and layout.low <= bare <= layout.high):
                page = bare
            return page

        return step

    return begin


def _plausible(last: int = 5, ahead: int = 4) -> Callable[[], Callable]:
    """A step that accepts a head whose first letter is between the least of the last accepted ones and `ahead` letters after the greatest."""

    def begin() -> Callable[[str | None], bool]:
        letters: deque[int] = deque(maxlen=last)
        bounds = (0, 0x10FFFF)

        def step(head: str | None) -> bool:
            nonlocal bounds
            if not head or not bounds[0] <= ord(head[0]) <= bounds[1]:
                return False
            letters.append(ord(head[0]))
            bounds = (min(letters), max(letters) + ahead)
            return True

        return step

    return begin


def parse(lines: DataFrame, layout: Layout, first_page: int | None = None) -> DataFrame:
    """RECORD of the entries in the layout's section of each volume. lines: (volume, line_no, line)."""
    whole, upto = Window.partitionBy("volume"), Window.partitionBy("volume").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    text = plain_quotes(F.col("line")) if layout.quotes else F.col("line")
    rows = lines.select("volume", "line_no", squash(text).alias("t"), squash("line").alias("plain"))
    rows = rows.withColumn("from", F.min(F.when(F.col("plain").rlike(layout.begins), F.col("line_no"))).over(whole))
    rows = rows.withColumn("to", F.min(F.when(F.col("plain").rlike(layout.ends) & (F.col("line_no") > F.col("from")), F.col("line_no"))).over(whole))
    rows = rows.where("line_no > from AND line_no < to")
    digits = F.when(F.col("t").rlike("^[0-9]{1,3}$"), F.col("t").cast("int")) if layout.bare else F.lit(None).cast("int")
    numbers = [F.when(F.col("t").rlike(h), F.expr(f"try_cast(regexp_extract(t, {_sql(h)}, {min(1, _groups(h))}) AS int)")) for h in layout.heads]
    is_head = F.lit(False)
    for h in layout.heads:
        is_head = is_head | F.col("t").rlike(h)
    rows = rows.withColumn("is_head", is_head).withColumn("number", F.coalesce(F.lit(None).cast("int"), *numbers)).withColumn("bare", digits)
    rows = folded(rows, ["volume"], ["line_no"], ["is_head", "number", "bare"], "page", "int", _pages(layout, first_page if first_page is not None else layout.first_page))
    rows = rows.withColumn("noise", F.col("is_head") | (F.col("t") == "") | F.col("t").rlike(layout.noise)).withColumn("entry", F.when(~F.col("noise"), layout.start(F.col("t"))))
    rows = rows.withColumn("named", D.letters(F.col("entry.head"))).withColumn("named", F.when(F.length("named") >= 2, F.col("named")))
    if layout.order == "recent":
        rows = folded(rows, ["volume"], ["line_no"], ["named"], "starts", "boolean", _plausible())
    elif layout.order == "letter":
        letter = F.coalesce(F.last(F.lower(F.nullif(F.regexp_extract("t", "^([A-Z])[.,]?$", 1), F.lit(""))), ignorenulls=True).over(upto), F.lit("a"))
        near = F.ascii(F.left("named", F.lit(1))).between(F.ascii(letter), F.ascii(letter) + 2)
        rows = rows.withColumn("starts", F.col("named").isNotNull() & (~F.col("entry.loose") | near))
    else:
        rows = rows.withColumn("starts", F.col("named").isNotNull())
    rows = rows.withColumn("segment", F.sum(F.coalesce(F.col("starts"), F.lit(False)).cast("int")).over(upto)).where("segment > 0")
    gathered = rows.groupBy("volume", "segment").agg(F.min("line_no").alias("line_no"), F.min_by("page", "line_no").alias("page"), F.array_sort(F.collect_list(F.when(~F.col("noise"), F.struct("line_no", "t")))).alias("body"))
    joined = F.array_join(F.col("body.t"), " ")
    # one step after the other, so that no pattern is matched again for each part of an entry
    texts = gathered.select("volume", "line_no", "page", (F.regexp_replace(joined, r"(?<=[a-z])- (?=[a-z])", "") if layout.hyphens else joined).alias("text"))
    taken = texts.select("volume", "line_no", "page", layout.start(F.col("text")).alias("e")).where("e IS NOT NULL")
    found = taken.select("volume", "line_no", "page", layout.record(F.col("e")).alias("r")).where("r IS NOT NULL")
    return found.select(F.lit(layout.source).alias("source"), F.struct("volume", "line_no").alias("ord"), "r.head", "r.variants", "r.gloss_en", F.lit("").alias("gloss_fr"), "r.pos", F.coalesce(F.col("page").cast("string"), F.lit("")).alias("page"), "r.notes")


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def _record(head: Column, variants: Column, gloss: Column, pos: Column, notes: dict[str, Column]) -> Column:
    return F.struct(head.alias("head"), variants.alias("variants"), gloss.alias("gloss_en"), pos.alias("pos"), F.create_map(*(x for k, v in notes.items() for x in (F.lit(k), v))).alias("notes"))


def record_1863(etymology: bool) -> Callable[[Column], Column]:
    def made(e: Column, names: Column, told: Column) -> Column:
        pos = F.when(e["mark"] == "?", "").otherwise(part_of_speech(e["mark"]))
        see = F.regexp_extract(e["rest"], r"^See\s+(.+?)\.?\s*$", 1)
        reference = _record(names[0], names, F.lit(""), pos, {"xref": F.when(see != "", see).otherwise(e["rest"]), "type": F.lit("crossref")})
        entry = _record(names[0], names, D.gloss(told["rest"]), pos, {"pos_ocr": F.when(e["mark"] == "?", "garbled").otherwise(""), "etym": clean_gloss(told["etymology"], 100)})
        return F.when(e["rest"].rlike(r"^See\b"), reference).otherwise(entry)

    told = lambda e: D.etymology(e["rest"]) if etymology else F.struct(F.lit("").alias("etymology"), e["rest"].alias("rest"))
    return lambda e: let(D.spellings(e["head"], e["others"]), lambda names: let(told(e), lambda t: made(e, names, t)))


def record_1909(e: Column) -> Column:
    reference = _record(e["head"], F.array(e["head"]), F.lit(""), F.lit(""), {"xref": e["rest"], "type": F.lit("crossref"), "section": F.lit("lexicon")})
    made = lambda names, body: _record(names[0], names, body["gloss"], part_of_speech(e["mark"]), {"origin": body["origin"], "etym": body["etymology"], "section": F.lit("lexicon")})
    entry = let(D.spellings(e["head"], e["others"]), lambda names: let(D.body_1909(e["rest"]), lambda body: made(names, body)))
    return F.when(e["mark"] == "see", reference).otherwise(entry)


def record_supplement(e: Column) -> Column:
    names, tag = D.spellings(e["head"], e["others"]), F.btrim(e["mark"], F.lit(" ."))
    origin = F.when(F.startswith(tag, F.lit("Wasco")), "Wasco").when(F.startswith(tag, F.lit("Canadian")), "French (Canadian)").otherwise(D.named(D.ORIGINS_1909, tag))
    return _record(names[0], names, clean_gloss(e["rest"]), F.lit(""), {"origin": origin, "section": F.lit("supplemental")})


def record_tagged(e: Column) -> Column:
    raw = F.trim(e["head"])
    head = D.repaired(raw)
    names = D.spellings(raw, F.regexp_replace(e["others"], r"\s*,\s*(?:or\s+)?(?:more commonly\s+)?", ", "), ", ")
    fixed = head != raw
    names = F.when(fixed, F.concat(F.array(head), names)).otherwise(names)
    tag, see = F.btrim(e["mark"], F.lit(" .")), F.regexp_extract(e["rest"], r"^See\s+(.+?)\.?\s*$", 1)
    second = r"^\(([A-Za-z?. ]{1,6})\)\s*[.:]?\s*"
    late = (tag == "") & e["rest"].rlike(second)
    inner = F.regexp_extract(e["rest"], second, 1)
    rest = F.when(late, F.regexp_replace(e["rest"], second, "")).otherwise(e["rest"])
    told = F.when(late, F.coalesce(F.nullif(D.named(D.ORIGINS_TAGGED, F.btrim(inner, F.lit(" ."))), F.btrim(inner, F.lit(" ."))), inner)).otherwise(D.named(D.ORIGINS_TAGGED, tag))
    gloss = D.gloss(rest, D.EXAMPLES_TAGGED, D.SENTENCES_TAGGED, 14)
    notes = {"origin": told, "ocr": F.when(fixed, "head digit/capital read as accented vowel").otherwise("")}
    reference = _record(head, names, F.lit(""), F.lit(""), notes | {"xref": see, "type": F.lit("crossref")})
    entry = _record(head, names, gloss, F.lit(""), notes | {"xref": F.lit(""), "type": F.when(F.contains(F.trim(head), F.lit(" ")), "phrase").otherwise("")})
    return F.when(see != "", reference).otherwise(entry)


# Where the sections of the books begin and end, their running heads and page numbers.
_HEADS_1863 = (
    r"^(?:(?:\d{1,3}|\S{1,3})[:;.]?\s+)?DICTIONARY\s+OF\s+TH\S*\s+\S*CHINOOK\s+\S*\s*\W*$",
    r"^PA[ER]T\s+[IiJl1]\W{0,3}\s*CHINOOK\W*\s*\w{0,10}\W{0,3}\s*(?:(\d{1,3}|[A-Z]|\d\)))?\W*$",
)
_HEADS_TAGGED = (r"^(\d{1,3})\s+CHINOOK\s+DICTIONARY\.?$", r"^CHINOOK\s+DICTIONARY\.?\s+(\d{1,3})$")
_NOISE_1909, _NOISE_TAGGED = r"^(?:\d{1,3}|THE CHINOOK JARGON\.?|AND HOW TO USE IT\.?)$", r"^(?:\d{1,3}|CHINOOK\s+DICTIONARY\.?|[A-Z]{1,2})$"
LAYOUTS = [
    Layout("gibbs1863", r"^PART I\.?\s*CHINOOK[-— ]+ENGLISH\.?$", r"(?i)^ENGLISH[-— ]CHINOOK\.?$", D.start_1863, record_1863(True), _HEADS_1863, r"^[A-Z][.,]?$", "letter", 1, 1, 200),
    Layout("hibben1889", r"^PART I\s*\W?\s*CHINOOK\W*ENGLISH\.?$", r"(?i)^PART\s+I[ILT1]\W*\s*ENGLISH\W+CHINOOK\.?$", D.start_1889, record_1863(False), _HEADS_1863, r"^[A-Z][.,]?$", "recent", 3, 1, 200),
    Layout("shaw1909", r'^A"?\s+LEXICON$', r"^SUPPLEMENTAL.*VOCAB", D.start_1909, record_1909, (), _NOISE_1909, None, None, 1, 60, True, False, True),
    Layout("gill1909", r"^CHINOOK[-— ]ENGLISH$", r"^CONVERSATIONAL PHRASES$", D.start_tagged(False), record_tagged, _HEADS_TAGGED, _NOISE_TAGGED, "recent", 47, 40, 140, True, True, True),
    Layout("gill1887", r"^\W?HINOOK[-— ]ENGLISH\W*$", r"^(?:Yoot-skut|Yoot-skut\.) +Short", D.start_tagged(True), record_tagged, _HEADS_TAGGED, _NOISE_TAGGED, "recent", 31, 30, 60, True, True, True),
]
SUPPLEMENT = Layout("shaw1909", r"^SUPPLEMENTAL.*VOCAB", r"^PRONOUNCING.*VOCAB", D.supplement_1909, record_supplement, (), r"^(?:[A-Z]|\d{1,3}|Less Familiar.*)$", None, 30, 1, 60, True, False, True)


def rows_by_source(records: DataFrame) -> DataFrame:
    """One row for each source and headword: (source, headword, variants, gloss_en, gloss_fr, pos, page, notes, n_raw).

    Records whose head is too short, too long or has too many words are left out. Variants, glosses (equal but for case)
    and parts of speech are distinct, in the order in which they come first; the first value of each note and the first
    page that is known stay. Values are made distinct by a partial aggregation, so a hot headword gathers those only.
    """
    shown = records.withColumn("head", D.display(F.col("head"))).withColumn("headword", headword_key(F.col("head")))
    solid = F.replace("headword", F.lit(" "), F.lit(""))
    shown = shown.where((F.length(solid) >= LEAST_LETTERS) & (F.length("headword") <= MOST_LETTERS) & (F.size(F.split("headword", " ")) <= MOST_WORDS))
    item = lambda name, value, same, place: F.struct(F.lit(name).alias("name"), value.alias("value"), same.alias("same"), place.cast("int").alias("place"))
    heads = F.filter(F.concat(F.array("head"), F.transform("variants", D.display)), lambda v: headword_key(v) != "")
    gloss = lambda name: F.array(item(name, F.trim(name), F.lower(F.trim(name)), F.lit(0)))
    values = F.filter(
        F.concat(F.transform(heads, lambda v, i: item("variants", v, v, i)), gloss("gloss_en"), gloss("gloss_fr"), F.transform(F.split("pos", ","), lambda p, i: item("pos", p, p, i)), F.array(item("page", F.col("page"), F.lit("page"), F.lit(0)))),
        lambda x: x["value"] != "",
    )
    notes = F.transform(F.map_entries("notes"), lambda e: item("notes", F.coalesce(e["value"], F.lit("")), e["key"], F.lit(0)))
    keys = ["source", "headword"]
    once = shown.select(*keys, "ord", F.explode(F.concat(values, notes)).alias("x")).groupBy(*keys, "x.name", "x.same").agg(F.min(F.struct("ord", "x.place", "x.value")).alias("first"))
    gathered = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "name", "same"))).alias("all"))
    counts = shown.groupBy(*keys).agg(F.count("*").alias("n_raw"))
    of = lambda name: F.filter("all", lambda x: x["name"] == name)
    told = lambda name: F.transform(of(name), lambda x: x["first"]["value"])
    out = gathered.select(
        *keys, told("variants").alias("variants"), F.array_join(told("gloss_en"), " | ").alias("gloss_en"), F.array_join(told("gloss_fr"), " | ").alias("gloss_fr"), F.array_join(told("pos"), ",").alias("pos"),
        F.coalesce(F.get(told("page"), F.lit(0)), F.lit("")).alias("page"), F.map_from_entries(F.transform(of("notes"), lambda x: F.struct(x["same"], x["first"]["value"]))).alias("notes"),
    )
    return out.join(counts, keys)


def merged(rows: DataFrame, order: dict[str, int], flagged: list[str], most: dict[str, int]) -> DataFrame:
    """One row for each headword of graded rows (source, headword, variants, gloss_en, gloss_fr, pos, conf).

    order: places of the sources; flagged: sources that set the flag; most: how many variants, gloss_en, gloss_fr are
    shown. Variants are from all rows, sources, glosses and parts of speech from those graded A or B. Only as many values
    as are shown are gathered: they are ranked by where they come first before.
    """
    good = F.col("conf").isin("A", "B")
    places = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    item = lambda name, value, same, place: F.struct(F.lit(name).alias("name"), value.alias("value"), same.alias("same"), place.cast("int").alias("place"))
    none = F.array().cast("array<struct<name:string,value:string,same:string,place:int>>")
    when_good = lambda x: F.when(good, x).otherwise(none)
    glosses = lambda name, fold: F.transform(F.split(name, r" \| "), lambda g, i: item(name, g, fold(g), i))
    values = F.concat(
        F.transform("variants", lambda v, i: item("variants", v, v, i)),
        when_good(glosses("gloss_en", F.lower)), when_good(glosses("gloss_fr", lambda g: g)), when_good(F.transform(F.split("pos", ","), lambda p, i: item("pos", p, p, i))),
        F.array(item("weak", F.when(~good, F.col("source")), F.col("source"), F.lit(0)), item("sources", F.when(good, F.col("source")), F.col("source"), F.lit(0))),
    )
    ranked = rows.withColumn("__at", F.element_at(places, F.col("source")))
    long = ranked.select("headword", "__at", F.explode(F.filter(values, lambda x: x["value"] != "")).alias("x"))
    once = long.groupBy("headword", "x.name", "x.same").agg(F.min(F.struct("__at", "x.place", "x.value")).alias("first"))
    number = F.row_number().over(Window.partitionBy("headword", "name").orderBy("first"))
    limits = F.create_map(*(F.lit(x) for pair in most.items() for x in pair))
    shown = once.withColumn("__n", number).where(F.col("__n") <= F.coalesce(F.element_at(limits, F.col("name")), F.lit(2**31 - 1)))
    gathered = shown.groupBy("headword").agg(F.array_sort(F.collect_list(F.struct("first", "name"))).alias("all"))
    told = lambda name: F.transform(F.filter("all", lambda x: x["name"] == name), lambda x: x["first"]["value"])
    own = F.col("source").isin(flagged)
    facts = ranked.groupBy("headword").agg(F.min("conf").alias("best_conf"), F.bool_or(own & good).alias("__flag"), F.bool_or(own & ~good).alias("__weak_flag"))
    weak = F.array_except(told("weak"), told("sources"))
    notes = F.concat_ws("; ", F.when(F.size(weak) > 0, F.concat(F.lit("unvalidated_candidates_in="), F.array_join(weak, "/"))), F.when(F.col("__weak_flag") & ~F.col("__flag"), "flagged_candidate_only"))
    return facts.join(gathered, "headword", "left").select(
        "headword", F.coalesce(F.size(told("sources")), F.lit(0)).alias("n_sources"), F.array_join(told("sources"), "|").alias("sources"), F.col("__flag").alias("flagged"), "best_conf",
        F.array_join(told("variants"), "|").alias("variants"), F.array_join(told("gloss_en"), " | ").alias("gloss_en"), F.array_join(told("gloss_fr"), " | ").alias("gloss_fr"), F.array_join(told("pos"), ",").alias("pos"), notes.alias("notes"),
    )
