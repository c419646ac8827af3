"""Owners of shares as state: a stream that tells, whenever a share gets further owners, who has it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "cloud int, share_fp string, num_users int, users array<int>"


def _grow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = set(state.get[0]) if state.exists else set()
    after = before.union(*(set(b["user_id"].dropna().astype(int)) for b in batches))
    if after != before or not state.exists:
        users = sorted(after)
        state.update((users,))
        yield pd.DataFrame({"cloud": [key[0]], "share_fp": [key[1]], "num_users": [len(users)], "users": [users]})


def owners(shares: DataFrame) -> DataFrame:
    """A stream of (cloud, share_fp, num_users, users) out of one of shares (cloud, share_fp, user_id); the last row of a share holds.

    The state is a share's owners; repeats of a user add no row. Null users own nothing.
    """
    grouped = shares.select("cloud", "share_fp", "user_id").groupBy("cloud", "share_fp")
    return grouped.applyInPandasWithState(_grow, _OUT, "users array<int>", "update", GroupStateTimeout.NoTimeout)
