"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import released, shared_folder, written
from ..sources.tables import table

__all__ = ["BLANKS", "BLANK_RUN", "LOWER", "UPPER", "Recent", "lower_ascii", "released", "shared_folder", "table", "without", "written"]

#: ASCII letters, for case folding that leaves every other letter alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but for ``names``, compared as Spark does, without regard to case."""
    drop = {n.lower() for n in names}
    return [f"`{c}`" for c in df.columns if c.lower() not in drop]


class Recent(dict):
    """What a Python worker remembers: two generations of at most ``most`` entries, so that frequent keys outlive rare ones."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:  # long keys hardly come again
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found
