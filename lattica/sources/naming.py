"""API names from table and column names: camel and Pascal case, English plurals, reserved words, clashes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Irregular nouns and nouns without a plural, as English has them.
IRREGULAR = {"person": "people", "man": "men", "woman": "women", "child": "children", "foot": "feet", "tooth": "teeth", "goose": "geese", "mouse": "mice", "ox": "oxen", "datum": "data", "index": "indices", "matrix": "matrices", "vertex": "vertices", "criterion": "criteria", "analysis": "analyses", "crisis": "crises", "axis": "axes", "leaf": "leaves", "life": "lives", "knife": "knives", "shelf": "shelves", "half": "halves", "quiz": "quizzes", "status": "statuses", "bus": "buses", "alias": "aliases", "hero": "heroes", "potato": "potatoes", "tomato": "tomatoes"}
UNCOUNTED = frozenset("equipment information rice money species series fish sheep news metadata inventory_data feedback software hardware".split())
RESERVED_TYPES = frozenset("Query Mutation Subscription Int Float String Boolean ID Node PageInfo JSON BigInt Decimal Date DateTime Time Year Bytes UUID Vector".split())
RESERVED_FIELDS = frozenset(["node", "__typename", "__schema", "__type"])
_SINGULAR = {v: k for k, v in IRREGULAR.items()}


def words(name: str) -> list[str]:
    return [w for part in re.split(r"[^0-9A-Za-z]+", name) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[A-Z]+", part)]


def camel(name: str) -> str:
    ws = words(name)
    out = "".join([ws[0].lower(), *(w[:1].upper() + w[1:].lower() for w in ws[1:])]) if ws else "_"
    return f"_{out}" if out[0].isdigit() else out


def pascal(name: str) -> str:
    out = "".join(w[:1].upper() + w[1:].lower() for w in words(name)) or "_"
    return f"_{out}" if out[0].isdigit() else out


def _last(word: str) -> tuple[str, str]:
    """What stands before the last word of a camel-case name, and that word."""
    m = re.search(r"[A-Z]?[a-z]+$", word)
    return (word[: m.start()], word[m.start() :]) if m else (word, "")


def _like(model: str, out: str) -> str:
    return out[:1].upper() + out[1:] if model[:1].isupper() else out


@dataclass
class Names:
    """Names with overrides: `types` by table, `plurals` and `singulars` by word."""

    types: dict[str, str] = field(default_factory=dict)
    plurals: dict[str, str] = field(default_factory=dict)
    singulars: dict[str, str] = field(default_factory=dict)

    def plural(self, name: str) -> str:
        if name.lower() in self.plurals:
            return self.plurals[name.lower()]
        head, w = _last(name)
        low = w.lower()
        if not w or low in UNCOUNTED or low in _SINGULAR:
            return name
        if low in IRREGULAR:
            return head + _like(w, IRREGULAR[low])
        if low.endswith("s") and not re.search(r"(ss|us|is)$", low):
            return name  # already a plural
        if re.search(r"(s|x|z|ch|sh)$", low):
            return name + "es"
        if re.search(r"[^aeiou]y$", low):
            return name[:-1] + "ies"
        return name + "s"

    def singular(self, name: str) -> str:
        if name.lower() in self.singulars:
            return self.singulars[name.lower()]
        head, w = _last(name)
        low = w.lower()
        if not w or low in UNCOUNTED or low in IRREGULAR:
            return name
        if low in _SINGULAR:
            return head + _like(w, _SINGULAR[low])
        if low.endswith("ies") and len(low) > 4:
            return name[:-3] + "y"
        if re.search(r"(ss|x|z|ch|sh)es$", low):
            return name[:-2]
        if low.endswith("s") and not re.search(r"(ss|us|is)$", low):
            return name[:-1]
        return name

    def type_name(self, table: str) -> str:
        out = self.types.get(table) or pascal(self.singular(camel(table)))
        return f"{out}_" if out in RESERVED_TYPES else out

    def field(self, column: str) -> str:
        out = camel(column)
        return f"{out}_" if out in RESERVED_FIELDS else out

    def collection(self, table: str) -> str:
        return self.plural(self.field(table))

    def single(self, table: str) -> str:
        return self.singular(self.field(table))

    def to_one(self, column: str) -> str:
        """A relationship by its first key column: author_id gives author."""
        return self.field(re.sub(r"(?i)(_id|_fk)$", "", column) or column)

    def to_many(self, source: str, column: str, only: bool) -> str:
        many = self.collection(source)
        return many if only else self.to_one(column) + many[:1].upper() + many[1:]

    def through(self, junction: str, left: str, right: str, target: str, attributes: bool) -> str:
        """By the target if the junction's name is made of the two tables' words, else by the junction."""
        known = {x for t in (left, right) for w in words(t) for x in (w.lower(), self.singular(w.lower()), self.plural(w.lower()))}
        simple = all(w.lower() in known for w in words(junction))
        return self.collection(target if simple and not attributes else junction)


class Taken:
    """Names given out in one scope. A clash gets the suffix asked for, then numbers."""

    def __init__(self) -> None:
        self.names: dict[str, str] = {}

    def give(self, name: str, owner: str, suffix: str = "") -> str:
        if name in self.names and self.names[name] != owner and suffix:
            name += suffix
        out, n = name, 2
        while out in self.names and self.names[out] != owner:
            out, n = f"{name}{n}", n + 1
        self.names[out] = owner
        return out
