"""Display names and labels of parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blades shown under another name.
BLADE_DISPLAY = {
    "Soar Phoenix": "Phoenix Wing",
    "Mail Knight": "Knight Mail",
    "Beat Tyranno": "Tyranno Beat",
}
#: Main blades that are only valid with a lock chip.
NEEDS_LOCK_CHIP = [
    "Brave", "Arc", "Dark", "Reaper", "Brush", "Blast", "Eclipse", "Hunt", "Might", "Flare", "Volt", "Storm", "Emperor",
]
#: Bit abbreviations and spellings shown under another name.
BIT_DISPLAY = {
    "J": "Jolt", "W": "Wedge", "Z": "Zap",
    "BS": "Ball Spike", "FB": "Free Ball", "GR": "Gear Rush", "HN": "High Needle", "HT": "High Taper",
    "LF": "Low Flat", "LO": "Low Orb", "LR": "Low Rush", "RA": "Rubber Accel", "TK": "Trans Kick", "TP": "Taper",
    "UF": "Under Flat", "UN": "Under Needle", "WB": "Wall Ball", "GB": "Gear Ball", "GF": "Gear Flat",
    "GN": "Gear Needle", "GP": "Gear Point", "DB": "Disc Ball",
    "FreeBall": "Free Ball", "Freeball": "Free Ball", "RubberAccel": "Rubber Accel", "GearBall": "Gear Ball",
    "GearFlat": "Gear Flat", "GearNeedle": "Gear Needle", "GearPoint": "Gear Point", "LowOrb": "Low Orb",
}


def renamed(name: Column, names: dict[str, str]) -> Column:
    """The name's display form, or the name itself."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def display_blade(blade: Column) -> Column:
    return renamed(blade, BLADE_DISPLAY)


def display_bit(bit: Column) -> Column:
    return renamed(bit, BIT_DISPLAY)


def display_ratchet(ratchet: Column) -> Column:
    """The ratchet without the letters a blade's name puts before it."""
    return F.regexp_replace(ratchet, r"^[A-Za-z]*(\d+-\d+)$", "$1")


def full_blade(lock_chip: Column, blade: Column) -> Column:
    """The chip before the blade's display name, where there is a chip."""
    return F.concat_ws(" ", F.when(lock_chip != "", lock_chip), display_blade(blade))


def label(*parts: Column) -> Column:
    """The parts that are there, joined by spaces."""
    return F.concat_ws(" ", *parts)
