"""Text functions of the network store as Column expressions: addresses, streets, ids, labels, answers in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROAD_WORDS = r"(street|st\.?|road|rd\.?|avenue|ave\.?)"
#: Letters with marks and what they stand for; single letters only, as one translation.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Words for street and boulevard before a name.
LABEL_PREFIXES = ("רחוב", "שדרות")
LABELS = (("Street", "ST"), ("Avenue", "AVE"), ("Boulevard", "BLVD"), ("Road", "RD"), ("Drive", "DR"), ("Lane", "LN"), ("Court", "CT"))
FIBRE_COLOURS = ("blue", "orange", "green", "brown", "slate", "white", "red", "black", "yellow", "violet", "rose", "aqua")


def address_key(a: Column) -> Column:
    """Lower case, single blanks, one blank after each comma."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(a)), r"\s+", " "), r",\s*", ", ")


def address_plain(a: Column) -> Column:
    """Lower case, marks off letters, punctuation to blanks, single blanks."""
    bare = F.regexp_replace(F.translate(F.lower(a), MARKED, PLAIN), r"[̀-ͯ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"""[,.\-'"]""", " "), r"\s+", " "))


def street_key(s: Column) -> Column:
    """Lower case, single blanks, no road word at either end."""
    low = F.regexp_replace(F.trim(F.lower(s)), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(low, rf"^{ROAD_WORDS}\s+", ""), rf"\s+{ROAD_WORDS}$", "")


def _found(s: Column, pattern: str, group: int) -> Column:
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def street_of(address: Column) -> Column:
    """Street of '12 Name, City', of 'Name 12' in Hebrew letters, or of 'Name 12, City'; else null."""
    first = F.trim(F.regexp_replace(F.split(address, ",")[0], r"[0-9]+[a-zA-Zא-ת]?", ""))
    rest = F.when(F.contains(address, F.lit(",")) & (first != ""), first)
    english = F.trim(_found(address, r"^[0-9]+[a-zA-Z]?\s+(.+?)(?:,|$)", 1))
    hebrew = F.trim(_found(address, r"^([א-ת\s]+)\s+[0-9]+", 1))
    return F.coalesce(english, hebrew, rest)


def number_of(address: Column) -> Column:
    """House number: after a blank and before a blank, comma or the end; else at the start."""
    return F.coalesce(_found(address, r"\s([0-9]+[א-ת]?)(?:\s|,|$)", 1), _found(address, r"^([0-9]+[א-תa-zA-Z]?)\s", 1))


def street_label(name: Column) -> Column:
    """[NAME ST]: road words shortened, upper case, at most 15 characters."""
    for word, short in LABELS:
        name = F.regexp_replace(name, rf"(?i)\s+{word}$", f" {short}")
    for word in LABEL_PREFIXES:
        name = F.regexp_replace(name, rf"^{word}\s+", "")
    return F.concat(F.lit("["), F.substring(F.upper(F.trim(name)), 1, 15), F.lit("]"))


def equipment_parts(code: Column) -> Column:
    """Struct (city, zone, kind, number) of 'TLV-A1-CL-001'; null where the form does not fit."""
    form = r"^([A-Z]{2,3})-([A-Z][0-9]+)-([A-Z]{2,3})-([0-9]{3,})$"
    part = lambda i: F.regexp_extract(code, form, i)
    return F.when(code.rlike(form), F.struct(part(1).alias("city"), part(2).alias("zone"), part(3).alias("kind"), part(4).cast("int").alias("number")))


def equipment_code(city: Column, zone: Column, kind: Column, number: Column) -> Column:
    return F.concat_ws("-", city, zone, kind, F.lpad(number.cast("string"), 3, "0"))


def splitter_ways(ratio: Column) -> Column:
    """Outputs of '1:8'; 8 where there is no ratio."""
    return F.coalesce(F.nullif(F.regexp_extract(ratio, "1:([0-9]+)", 1), F.lit("")).cast("int"), F.lit(8))


def fibre_colour(n: Column) -> Column:
    """Colour of fibre n in the cycle of twelve."""
    return F.element_at(F.array(*map(F.lit, FIBRE_COLOURS)), (F.pmod(n - 1, F.lit(12)) + 1).cast("int"))


def last_json(text: Column) -> Column:
    """The last object in braces (one level of nesting) that parses; else null."""
    found = F.regexp_extract_all(text, F.lit(r"\{(?:[^{}]|\{[^{}]*\})*\}"), F.lit(0))
    return F.get(F.filter(F.reverse(found), lambda x: F.try_parse_json(x).isNotNull()), F.lit(0))


def rewrite(text: Column, words: dict[str, str]) -> Column:
    """Ordered whole-word replacements, as a skin for a vocabulary."""
    for word, new in words.items():
        text = F.regexp_replace(text, rf"(?i)\b{word}\b", new)
    return text


def wkt_points(wkt: Column) -> Column:
    """Points of POINT, LINESTRING or POLYGON (outer ring); pairs with a part that is no number are left out; other: null."""
    body = F.regexp_extract(wkt, r"(?i)^\s*(?:POINT|LINESTRING|POLYGON)\s*\(+([^()]*)\)", 1)
    pair = F.transform(F.split(body, ","), lambda p: F.filter(F.split(F.trim(p), r"\s+"), lambda x: x != ""))
    number = lambda x: x.try_cast("double")
    made = F.transform(pair, lambda p: F.struct(number(F.get(p, F.lit(0))).alias("x"), number(F.get(p, F.lit(1))).alias("y")))
    return F.when(wkt.rlike(r"(?i)^\s*(POINT|LINESTRING|POLYGON)\s*\("), F.filter(made, lambda s: s["x"].isNotNull() & s["y"].isNotNull()))


def match_tier(value: Column, wanted: Column) -> Column:
    """1 exact, 2 equal but for case, 3 one holds the other, null no match."""
    v, w = F.lower(value), F.lower(wanted)
    return F.when(value == wanted, 1).when(v == w, 2).when(F.contains(v, w) | F.contains(w, v), 3)


def dates_in(text: Column) -> Column:
    return F.to_date(F.nullif(F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")))


def letters(n: Column) -> Column:
    """A, B, ... Z, AA, AB, ... for 1, 2, ..., up to three letters."""
    char = lambda k: F.char((65 + k).cast("int"))
    one, two = n - 1, n - 27
    three = n - 703
    return (
        F.when(n <= 26, char(one % 26))
        .when(n <= 702, F.concat(char(F.floor(two / 26) % 26), char(two % 26)))
        .otherwise(F.concat(char(F.floor(three / 676) % 26), char(F.floor(three / 26) % 26), char(three % 26)))
    )


def longest_first(text: Column, names: list[str]) -> Column:
    """The longest of some names that a text holds, of equally long ones the first in order; null where it holds none."""
    out = F.lit(None).cast("string")
    for name in sorted(names, key=lambda k: (-len(k), k))[::-1]:
        out = F.when(F.contains(F.lower(text), F.lit(name.lower())), F.lit(name)).otherwise(out)
    return out


def last_triple(text: Column) -> Column:
    """The last (subject, predicate, object) of a text, as written."""
    found = F.regexp_extract_all(text, F.lit(r"\([a-z ]+, *[a-z ]+, *[a-z ]+\)"), F.lit(0))
    return F.try_element_at(found, F.lit(-1))


def padded(n: Column, width: int) -> Column:
    """A number with zeros in front, never cut."""
    t = n.cast("string")
    return F.lpad(t, F.greatest(F.lit(width), F.length(t)), F.lit("0"))


def element_type(node: Column) -> Column:
    """Kind of element of a node; a den is a closure, unknown ones are houses."""
    return F.when(node == "den", "closure").when(node.isin("co", "cabinet", "closure", "house"), node).otherwise("house")
