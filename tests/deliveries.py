"""A table of parcel deliveries with the family `tags`, and texts with what they give, worked out in Python from the rows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple


class Delivery(NamedTuple):
    city: str | None
    kind: str | None
    note: str | None
    van: str
    minute: int
    parcels: int
    weight: float


NAMES = ("tags.city", "tags.kind", "tags.note", "van", "minute", "parcels", "weight")
ROWS = [
    Delivery("Ulm", "mail", None, "V7", 12, 30, 41.5),
    Delivery("Ulm", "food", "cold", "V7", 47, 4, 18.25),
    Delivery("Jena", None, None, "V2", 61, 11, 9.0),
    Delivery(None, "mail", "fragile", "V2", 75, 2, 0.5),
    Delivery("Jena", "mail", "cold", "V7", 119, 30, 22.75),
    Delivery(None, None, "left at door", "V9", 120, 7, 7.0),
    Delivery("Trier", "food", None, "V9", 190, 0, 3.5),
]


def grouped(key: Callable, of: Callable, rows=ROWS) -> list[tuple]:
    """of(group) of each group of rows, with the key's values before it."""
    found = defaultdict(list)
    for r in rows:
        found[key(r)].append(r)
    return [(*k, *of(g)) for k, g in found.items()]


def where(test: Callable, *out: str) -> list[tuple]:
    return [tuple(getattr(r, c) for c in out or ("minute",)) for r in ROWS if test(r)]


def parcels(g):
    return [r.parcels for r in g]


AGGREGATES = {
    "select tags.city, sum(parcels) as total group by tags.city": grouped(lambda r: (r.city,), lambda g: (sum(parcels(g)),)),
    "select tags.city, max(minute) as last, min(weight) as lightest group by tags.city": grouped(lambda r: (r.city,), lambda g: (max(r.minute for r in g), min(r.weight for r in g))),
    "select van, count(minute) as n group by van": grouped(lambda r: (r.van,), lambda g: (len(g),)),
    "select van, avg(parcels) as mean group by van": grouped(lambda r: (r.van,), lambda g: (sum(parcels(g)) // len(g),)),
    "select van, avg(weight) as mean group by van": grouped(lambda r: (r.van,), lambda g: (sum(r.weight for r in g) / len(g),)),
    "select tags.kind, tags.note, sum(parcels) as total group by tags.kind, tags.note": grouped(lambda r: (r.kind, r.note), lambda g: (sum(parcels(g)),)),
    "select tags, count(minute) as n group by tags": grouped(lambda r: (r.city, r.kind, r.note), lambda g: (len(g),)),
    "select van, sum(parcels * minute) as work where weight < 20.0 group by van": grouped(lambda r: (r.van,), lambda g: (sum(r.parcels * r.minute for r in g),), [r for r in ROWS if r.weight < 20]),
    "select van, max(parcels) - min(parcels) as span, sum(parcels) / count(parcels) as mean group by van": grouped(lambda r: (r.van,), lambda g: (max(parcels(g)) - min(parcels(g)), sum(parcels(g)) // len(g))),
    "select (minute / 60) * 60 as hour, sum(parcels) as total group by hour": grouped(lambda r: (r.minute // 60 * 60,), lambda g: (sum(parcels(g)),)),
    "select count(minute) as n, min(minute) as first": [(len(ROWS), min(r.minute for r in ROWS))],
    "select van, sum(parcels) as total where parcels > 900 group by van": [],
}

FILTERS = {
    "minute = 61": lambda r: r.minute == 61,
    "minute != 61": lambda r: r.minute != 61,
    "minute < 75": lambda r: r.minute < 75,
    "minute <= 75": lambda r: r.minute <= 75,
    "minute > 75": lambda r: r.minute > 75,
    "weight >= 9.0": lambda r: r.weight >= 9,
    "van = 'V9' and parcels > 0": lambda r: r.van == "V9" and r.parcels > 0,
    "van = 'V9' or tags.city = 'Ulm'": lambda r: r.van == "V9" or r.city == "Ulm",
    "van = 'V2' or (tags.city = 'Jena' and parcels > 11)": lambda r: r.van == "V2" or (r.city == "Jena" and r.parcels > 11),
    # a null is equal to nothing and different from nothing but null
    "tags.kind = 'mail'": lambda r: r.kind == "mail",
    "tags.kind != 'mail'": lambda r: r.kind is not None and r.kind != "mail",
    "tags.kind = null": lambda r: r.kind is None,
    "tags.kind != null": lambda r: r.kind is not None,
    "tags.note not like 'cold'": lambda r: r.note is not None and "cold" not in r.note,
    # text: parts of it, and expressions
    "tags.note like 'at d'": lambda r: r.note is not None and "at d" in r.note,
    "van not like '7'": lambda r: "7" not in r.van,
    "tags.city regexp '^(Ulm|Tr)'": lambda r: r.city in ("Ulm", "Trier"),
    "tags.city regexp 'm$' and tags.kind != 'food'": lambda r: r.city == "Ulm" and r.kind == "mail",
    "van not regexp '[79]'": lambda r: r.van == "V2",
    # keys that the family lacks, and columns that the table lacks
    "tags.colour = ''": lambda r: True,
    "tags.colour = 'red'": lambda r: False,
    "tags.colour != 'red'": lambda r: True,
    "tags.colour = null": lambda r: True,
    "tags.colour regexp ''": lambda r: True,
    "tags.colour regexp 'r'": lambda r: False,
    "tags.colour not regexp 'r' and van = 'V9'": lambda r: r.van == "V9",
    "depot > 3": lambda r: False,
    "depot <= 3 or minute = 12": lambda r: r.minute == 12,
}

PROJECTIONS = {
    "select van, depot, minute where minute < 20": [("V7", 12)],
    "select distinct van": sorted({(r.van,) for r in ROWS}),
    "select distinct van, tags.city": sorted({(r.van, r.city) for r in ROWS}, key=str),
    "select distinct(van, parcels > 10)": sorted({(r.van, r.parcels > 10) for r in ROWS}),
    "select distinct tags where van = 'V9'": [(r.city, r.kind, r.note) for r in ROWS if r.van == "V9"],
    "select distinct van where weight > 40.0 limit 5": [("V7",)],
    "select van limit 0": [],
    "select parcels / (parcels - 30) as q where van = 'V7'": [(None,), (0,), (None,)],
    "select convert(parcels, float) as f, minute - parcels * 2 as d where van = 'V2'": [(11.0, 39), (2.0, 71)],
    "select cast(minute as double) as f where parcels = 0": [(190.0,)],
    "select weight >= 9.0": [(r.weight >= 9,) for r in ROWS],
}

CASES = AGGREGATES | {f"select minute where {text}": where(test) for text, test in FILTERS.items()} | PROJECTIONS
