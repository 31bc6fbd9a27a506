"""Surnames of a roster in its order, found by one that contains or is contained in another."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Members that are compared one by one; more are found by parts of their surnames.
FEW = 48
#: Letters of the longest parts by which surnames are found.
PART = 5
MEMBERS = "array<struct<name:string,bloc:string,role:string>>"


class Roster:
    """Surnames by place; places grow, so that the first of some is the least."""

    def __init__(self, surnames: list[str]):
        self.at: dict[int, str] = dict(enumerate(surnames))
        self.parts: dict[str, list[int]] | None = None
        self.whole: dict[str, list[int]] = {}
        self.lengths: Counter = Counter()

    def add(self, place: int, surname: str) -> None:
        self.at[place] = surname
        if self.parts is not None:
            self._enter(place, surname)

    def remove(self, place: int) -> None:
        surname = self.at.pop(place)
        if self.parts is not None:
            self.lengths[len(surname)] -= 1
            if not self.lengths[len(surname)]:
                del self.lengths[len(surname)]

    def first(self, text: str) -> int | None:
        """The first place whose surname contains the text or is contained in it."""
        if self.parts is None:
            if len(self.at) <= FEW:
                return next((p for p, s in self.at.items() if text in s or s in text), None)
            self.parts = {}
            for p, s in self.at.items():
                self._enter(p, s)
        if not text:
            return next(iter(self.at), None)
        found = []
        for n in self.lengths:
            for part in {text[i : i + n] for i in range(len(text) - n + 1)}:
                found.append(next(self._present(self.whole.get(part)), None))
        if len(text) <= PART:
            found.append(next(self._present(self.parts.get(text)), None))
        else:
            held = [self.parts.get(text[i : i + PART]) for i in range(len(text) - PART + 1)]
            if all(held):
                found.append(next((p for p in self._present(min(held, key=len)) if text in self.at[p]), None))
        return min((p for p in found if p is not None), default=None)

    def _enter(self, place: int, surname: str) -> None:
        self.lengths[len(surname)] += 1
        self.whole.setdefault(surname, []).append(place)
        for part in {surname[i : i + n] for n in range(1, PART + 1) for i in range(len(surname) - n + 1)}:
            self.parts.setdefault(part, []).append(place)

    def _present(self, places: list[int] | None) -> Iterator[int]:
        """Places that are still taken, in order; a list that begins with gone ones loses them."""
        if not places:
            return
        gone = next((i for i, p in enumerate(places) if p in self.at), len(places))
        del places[:gone]
        yield from (p for p in places if p in self.at)


def folded(surnames: list[str], changes: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """What is left of a roster after changes (own surname, replaced surname), in order, as
    pairs: who, a member or, from their number on, a change's designated person; and the
    member whose role it has, -1 for none. The rules are those of ``ordered.fold_roster``."""
    roster, n = Roster(surnames), len(surnames)
    role = dict(enumerate(range(n)))
    for k, (own, gone) in enumerate(changes):
        at, kept = (roster.first(gone) if gone else None), -1
        if at is not None:
            kept = role.pop(at)
            roster.remove(at)
        if roster.first(own) is None:
            roster.add(n + k, own)
            role[n + k] = kept
    return [(p, role[p]) for p in roster.at]


def fold_members(members: pa.Array, keys: pa.Array, changes: pa.Array, own: pa.Array, gone: pa.Array) -> pa.Array:
    """Of each row the members (name, bloc, role) after its changes (name, bloc), both with
    their surnames; null if either is."""
    joined = lambda name: pa.concat_arrays([members.values.field(name), changes.values.field(name)]) if len(members.values) + len(changes.values) else pa.array([], pa.string())
    who, roles, sizes, n = [], [], [], len(members.values)
    spans = lambda a: zip(a.offsets.to_pylist(), a.offsets.to_pylist()[1:])  # noqa: B905, E731
    texts = [(list(spans(a)), a.values.to_pylist()) for a in (keys, own, gone)]
    for row, (m, c) in enumerate(zip(spans(members), spans(changes), strict=True)):
        if not (members[row].is_valid and changes[row].is_valid):
            sizes.append(None)
            continue
        surnames, new, old = (flat[slice(*at[row])] for at, flat in texts)
        left = folded(surnames, list(zip(new, old, strict=True)))
        first = len(surnames)
        who += [m[0] + p if p < first else n + c[0] + p - first for p, _ in left]
        roles += [m[0] + r if r >= 0 else n for _, r in left]
        sizes.append(len(left))
    role = pa.concat_arrays([members.values.field("role"), pa.array([""], pa.string())])
    at, role_at = pa.array(who, pa.int64()), pa.array(roles, pa.int64())
    items = pa.StructArray.from_arrays([joined("name").take(at), joined("bloc").take(at), role.take(role_at)], ["name", "bloc", "role"])
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + (s or 0))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)
    return pc.if_else(pa.array([s is not None for s in sizes]), lists, pa.nulls(len(sizes), lists.type)) if None in sizes else lists
