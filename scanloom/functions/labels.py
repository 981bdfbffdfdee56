"""Semantic classes: raw label ids, training ids, and their roles."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw class id -> training id; ids that aren't listed are 0.
LEARNING_MAP = {
    0: 0, 1: 0, 10: 1, 11: 2, 13: 5, 15: 3, 16: 5, 18: 4, 20: 5, 30: 6, 31: 7, 32: 8, 40: 9, 44: 10, 48: 11, 49: 12, 50: 13,
    51: 14, 52: 0, 60: 9, 70: 15, 71: 16, 72: 17, 80: 18, 81: 19, 99: 0, 252: 20, 253: 21, 254: 22, 255: 23, 256: 24, 257: 24,
    258: 25, 259: 24,
}
#: Raw vehicle ids, which some data sets don't trust.
VEHICLES = (10, 13, 16, 18, 20)
# Training ids by role.
FOREGROUND = (1, 4, 5, 16, 18)
BACKGROUND = (9, 13, 14, 15)
PLANES = (9, 13, 14)
ROAD, BUILDING, FENCE, VEGETATION = 9, 13, 14, 15
#: Which class a polar cell shows, the first being the strongest.
CELL_ORDER = (FENCE, BUILDING, VEGETATION, ROAD)
#: Node classes of instances: vehicle, trunk, pole.
NODE_CLASSES = {1: (1, 4, 5), 2: (16,), 3: (18,)}


def learning_map(ignore: tuple[int, ...] = ()) -> dict[int, int]:
    """The class map with some raw ids sent to 0."""
    return {raw: 0 if raw in ignore else train for raw, train in LEARNING_MAP.items()}


def class_of(raw: Column) -> Column:
    """The class in the low sixteen bits of a raw label."""
    return raw.bitwiseAND(F.lit(0xFFFF))


def train_label(raw: Column, mapping: dict[int, int] | None = None) -> Column:
    table = LEARNING_MAP if mapping is None else mapping
    pairs = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))
    return F.coalesce(F.try_element_at(pairs, class_of(raw).cast("int")), F.lit(0))


def is_foreground(label: Column) -> Column:
    return label.isin(*FOREGROUND)


def is_background(label: Column) -> Column:
    return label.isin(*BACKGROUND)


def node_class(label: Column) -> Column:
    found = F.lit(None).cast("int")
    for number, members in NODE_CLASSES.items():
        found = F.when(label.isin(*members), F.lit(number)).otherwise(found)
    return found


def cell_priority(label: Column) -> Column:
    found = F.lit(0)
    for rank, train in enumerate(reversed(CELL_ORDER), 1):
        found = F.when(label == train, F.lit(rank)).otherwise(found)
    return found
