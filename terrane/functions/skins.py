"""One network text in six vocabularies, and answers in them turned back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words of each vocabulary for closures, offices, drops, distribution cables, cables and the trade.
SKINS = {
    "ftth": {},
    "water": {"closure": "valve", "closure_id": "VL", "office": "pumping plant", "co": "plant", "co_id": "PL", "drop": "service pipe", "drop_kind": "service", "drop_id": "svc", "distribution": "main", "cable": "pipe", "trade": "water utility"},
    "electric": {"closure": "transformer", "closure_id": "TR", "office": "substation", "co": "substation", "co_id": "SS", "trade": "electric-grid"},
    "sensor": {"closure": "sensor", "closure_id": "SN", "office": "gateway hub", "co": "gateway", "co_id": "GW", "trade": "sensor-network"},
    "logistics": {"closure": "depot", "closure_id": "DP", "office": "central hub", "co": "hub", "co_id": "HB", "drop": "delivery leg", "drop_kind": "leg", "drop_id": "leg", "cable": "route", "trade": "logistics"},
    "generic": {"closure": "node", "closure_id": "ND", "office": "root node", "co": "root", "co_id": "RT", "drop": "spur", "drop_kind": "spur", "drop_id": "spur", "cable": "link", "trade": "generic network"},
}


def _kinds(old: str, new: str) -> list[tuple[str, str]]:
    return [(rf"kind={old}\b", f"kind={new}"), (f'"kind":"{old}"', f'"kind":"{new}"')]


def _forms(old: str, new: str) -> list[tuple[str, str]]:
    return [(old, new), (old.title(), new.title())]


def rules(name: str) -> list[tuple[str, str]]:
    """Patterns and what takes their place, in order."""
    v = SKINS[name]
    if not v:
        return []
    out = [*_forms("closure", v["closure"]), ("CLOSURE", v["closure"].upper()), (r"\bCL-", v["closure_id"] + "-"), *_forms("central office", v["office"])]
    out += [*_kinds("co", v["co"]), (r"\bCO-([0-9]+)", v["co_id"] + "-$1"), (r"\bCO\b", v["co"])]
    if "drop" in v:
        out += [*_kinds("drop", v["drop_kind"]), (r"\bdrop-", v["drop_id"] + "-"), (r"\bdrop\b", v["drop"])]
    if "distribution" in v:
        out += _kinds("distribution", v["distribution"])
    if "cable" in v:
        out += [*_forms("cable", v["cable"]), ("CABLES", v["cable"].upper() + "S")]
    return [*out, ("FTTH", v["trade"])]


def back_rules(name: str) -> list[tuple[str, str]]:
    """Patterns of ids and of field names of an answer, and the engine's own in their place."""
    v = SKINS[name]
    if not v:
        return []
    out = [(rf"\b{v['closure_id']}-", "CL-"), (rf"\b{v['co_id']}-([0-9]+)", "CO-$1"), (rf'"{v["closure"]}Id"(\s*:)', '"closureId"$1')]
    if "drop" in v:
        out.append((rf"\b{v['drop_id']}-", "drop-"))
    if "cable" in v:
        out.append((rf'"{v["cable"]}Ids"(\s*:)', '"cableIds"$1'))
    return out


def _each(text: Column, skin: Column, made) -> Column:
    """The rules of a row's own vocabulary in turn; unknown ones leave a text alone, a null text stays null."""
    pair = lambda r: F.struct(F.lit(r[0]).alias("old"), F.lit(r[1]).alias("new"))
    own = F.create_map(*[c for name in SKINS if made(name) for c in (F.lit(name), F.array(*map(pair, made(name))))])
    done = F.aggregate(F.try_element_at(own, skin), text, lambda t, r: F.regexp_replace(t, r["old"], r["new"]))
    return F.coalesce(done, text)


def apply(text: Column, skin: Column) -> Column:
    return _each(text, skin, rules)


def undo(answer: Column, skin: Column) -> Column:
    """Ids and field names of an answer in a vocabulary, turned back."""
    return _each(answer, skin, back_rules)
