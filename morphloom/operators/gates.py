"""Two small languages as columns: environments of a morph, and gates over switches and statuses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def environment(spec: dict) -> Column:
    """The condition of an environment over columns right, left, right_class, left_class, host_pos, position.

    spec has one of the members right_in, left_in (lists of segments), right_class,
    left_class, host_pos, position (one value). A missing neighbour satisfies none.
    """
    for member, column in (("right_in", "right"), ("left_in", "left")):
        if member in spec:
            return F.coalesce(F.col(column).isin(list(spec[member])), F.lit(False))
    for member in ("right_class", "left_class", "host_pos", "position"):
        if member in spec:
            return F.coalesce(F.col(member) == spec[member], F.lit(False))
    raise ValueError(f"no environment: {spec}")


ATOM = re.compile(r"^\s*switch:(\w+)\s*(==|!=|~)\s*(\S+)\s*$|^\s*paradigm:(\w+)\s+in\s+\{([^}]*)\}\s*$")


def gate(text: str, switches: str = "switches", statuses: str = "statuses") -> Column:
    """The condition of a gate over maps of switch values and paradigm statuses.

    ``or`` of ``and`` of atoms: ``switch:name == value``, ``!=``, ``~`` (contains),
    ``paradigm:name in {a, b}``. An empty gate is open; an unknown name satisfies
    only ``!=``.
    """
    if not text.strip():
        return F.lit(True)
    anyone = F.lit(False)
    for branch in re.split(r"\bor\b", text):
        every = F.lit(True)
        for part in re.split(r"\band\b", branch):
            found = ATOM.match(part)
            if not found:
                raise ValueError(f"no gate: {part}")
            name, sign, value, paradigm, choices = found.groups()
            if paradigm:
                one = F.element_at(F.col(statuses), F.lit(paradigm)).isin([c.strip() for c in choices.split(",")])
            else:
                have = F.element_at(F.col(switches), F.lit(name))
                one = have == value if sign == "==" else have.contains(value) if sign == "~" else F.coalesce(have != value, F.lit(True))
            every = every & F.coalesce(one, F.lit(False))
        anyone = anyone | every
    return anyone
