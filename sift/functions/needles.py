"""Many needles in one pass over the text.

The needles become one pattern in which common beginnings are written once. At every
place of the text it gives the longest needle that begins there; all others that begin
there are beginnings of that one, which is known beforehand. So one scan tells every
needle that occurs, overlapping ones too, and its cost hardly depends on their number:
where many characters may follow, the pattern halves the choice with a character class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are tried one after the other; more are told apart by halving first.
TRIED = 3

_END = ""


def _literal(character: str) -> str:
    plain = character.isascii() and character.isalnum()
    return character if plain else f"\\x{{{ord(character):x}}}"


def _tree(needles: Sequence[str]) -> dict:
    root: dict = {}
    for needle in needles:
        node = root
        for character in needle:
            node = node.setdefault(character, {})
        node[_END] = {}
    return root


def _choice(branches: list[tuple[str, str]]) -> str:
    """One of several branches, each of which begins with a character of its own."""
    if len(branches) <= TRIED:
        return "|".join(pattern for _, pattern in branches)
    half = len(branches) // 2
    first = "".join(_literal(character) for character, _ in branches[:half])
    left, right = _choice(branches[:half]), _choice(branches[half:])
    return f"(?=[{first}])(?:{left})|{right}"


def _pattern(root: dict) -> str:
    """The longest needle below a node; without recursion, as needles may be long."""
    done: dict[int, str] = {}
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        children = [(c, child) for c, child in sorted(node.items()) if c != _END]
        if not ready:
            stack.append((node, True))
            stack += [(child, False) for _, child in children]
            continue
        branches = [(c, _literal(c) + done.pop(id(child))) for c, child in children]
        choice = _choice(branches)
        if _END in node:
            done[id(node)] = f"(?:{choice})?" if branches else ""
        else:
            done[id(node)] = choice if len(branches) == 1 else f"(?:{choice})"
    return done[id(root)]


def any_of(needles: Sequence[str]) -> str:
    """A pattern that is found in a text if any of the needles occurs in it."""
    return _pattern(_tree(needles))


def _separators(texts: Sequence[str], n: int) -> list[str]:
    """Characters that occur in none of the texts."""
    used = set("".join(texts))
    return [c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used][:n]


def listed(needles: Sequence[str]) -> Column:
    """The needles as an array: one literal, however many there are, folded when planned."""
    (between,) = _separators(needles, 1)
    return F.split(F.lit(between.join(needles)), between)


def positions(text: Column, needles: Sequence[str]) -> Column:
    """Ascending positions, in the list, of all needles that occur; of repeats, each."""
    places: dict[str, list[int]] = {}
    for place, needle in enumerate(needles):
        places.setdefault(needle, []).append(place)
    between, after = _separators(needles, 2)
    pairs = []
    for needle in places:
        beginnings = (needle[:size] for size in range(len(needle) + 1))
        found = sorted(p for b in beginnings for p in places.get(b, ()))
        pairs.append(f"{needle}{after}{','.join(map(str, found))}")
    longest = F.regexp_extract_all(text, F.lit(f"(?=({any_of(list(places))}))"), F.lit(1))
    known = F.str_to_map(F.lit(between.join(pairs)), F.lit(between), F.lit(after))
    found = F.flatten(F.transform(F.array_distinct(longest), lambda n: F.split(F.element_at(known, n), ",")))
    return F.array_sort(F.array_distinct(found.cast("array<int>")))
