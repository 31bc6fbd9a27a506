"""Rosters that follow a stream of designations, a state for each body.

The state of a body is its roster at the start and all changes since, so that a change
that comes late, or twice, gives the roster that the batch fold of all changes gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.functions import surnames
from ledgerloom.functions.surnames import MEMBERS
from ledgerloom.functions.text import folded_upper

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGE = ["ord", "article", "pair_no", "name", "bloc", "key", "gone"]
_MEMBER = ["pos", "name", "bloc", "role", "key"]


def _surname(name: Column) -> Column:
    return folded_upper(F.get(F.split(F.coalesce(name, F.lit("")), ","), F.lit(0)))


def folded(members: list[tuple], changes: list[tuple]) -> list[tuple]:
    """Members (name, bloc, role, key) after changes (..., name, bloc, key, gone), in order;
    the rules are those of ``ordered.fold_roster``."""
    left = surnames.folded([m[3] for m in members], [c[-2:] for c in changes])
    person = lambda p: tuple(members[p][:2]) if p < len(members) else tuple(changes[p - len(members)][-4:-2])
    key = lambda p: members[p][3] if p < len(members) else changes[p - len(members)][-2]
    return [(*person(p), members[r][2] if r >= 0 else "", key(p)) for p, r in left]


class _Roster(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start = handle.getListState("start", "name string, bloc string, role string, key string")
        self.changes = handle.getListState("changes", "ord int, article int, pair_no int, name string, bloc string, key string, gone string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        own = initialState[initialState["pos"].notna()].sort_values("pos")
        if len(own):
            self.start.put([tuple(r) for r in own[_MEMBER[1:]].itertuples(index=False)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {tuple(c[:3]): tuple(c) for c in self.changes.get()}
        new = {tuple(int(x) for x in r[:3]): (*(int(x) for x in r[:3]), *r[3:]) for df in rows for r in df[_CHANGE].itertuples(index=False)}
        new = {k: c for k, c in new.items() if k not in known}
        if new:
            self.changes.appendList(list(new.values()))
        both = known | new
        members = folded([tuple(m) for m in self.start.get()], [both[k] for k in sorted(both)])
        yield pd.DataFrame({"body": [key[0]], "members": [[{"name": n, "bloc": b, "role": r} for n, b, r, _ in members]]})

    def close(self) -> None:
        pass


def roster_stream(changes: DataFrame, rosters: DataFrame) -> DataFrame:
    """body, members of each body that a batch of a stream of changes (body, ord, article,
    pair_no, designated, bloc, replaced) touches, after all of its changes so far, in the
    order of ord, article and pair_no, however they are split into batches.

    rosters: body, members at the start; a body that isn't there starts empty. A change
    that comes again has no effect. Bodies are spread by key; a state is one body's.
    To be written in update mode. Its state store is set for the session.
    """
    changes.sparkSession.conf.set(_STORE, _ROCKS)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    events = changes.select(
        "body", *(F.col(c).cast("int").alias(c) for c in _CHANGE[:3]), text("designated").alias("name"), text("bloc").alias("bloc"), _surname(F.col("designated")).alias("key"), _surname(F.col("replaced")).alias("gone"),
    )
    listed = rosters.select("body", F.posexplode_outer("members").alias("pos", "m"))
    start = listed.select("body", "pos", F.coalesce("m.name", F.lit("")).alias("name"), F.coalesce("m.bloc", F.lit("")).alias("bloc"), F.coalesce("m.role", F.lit("")).alias("role"), _surname(F.col("m.name")).alias("key"))
    return events.groupBy("body").transformWithStateInPandas(_Roster(), f"body {dict(changes.dtypes)['body']}, members {MEMBERS}", "Update", "None", start.groupBy("body"))
