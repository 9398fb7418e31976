"""Message texts by key, as a lookup in driver code and as an expression."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Texts:
    """Texts by key. Of several entries for a key the last counts; an unknown key has an empty text."""

    def __init__(self, entries: Iterable[tuple[str, str]]):
        self.by_key = dict(entries)

    def __call__(self, key: str, *values) -> str:
        text = self.by_key.get(key, "")
        return text.format(*values) if values else text

    def column(self, key: Column | str) -> Column:
        """The same lookup for a column of keys."""
        if not self.by_key:
            return F.lit("")
        table = F.create_map(*[F.lit(x) for kv in self.by_key.items() for x in kv])
        return F.coalesce(F.element_at(table, F.col(key) if isinstance(key, str) else key), F.lit(""))
