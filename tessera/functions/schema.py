"""One comparison of column lists, shared by every schema check."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class SchemaDiff:
    """How the columns found differ from the columns wanted.

    Columns are names or (name, type) pairs; with pairs a column of the right
    name and another type is ``retyped``.  ``moved`` tells that the same
    columns come in another order.  Without a wanted list only the found
    names themselves are judged (blank, repeated, control characters).
    """

    blank: tuple[int, ...]  # positions from 1
    repeated: tuple[str, ...]
    unprintable: tuple[int, ...]
    missing: tuple[str, ...] = ()
    unexpected: tuple[str, ...] = ()
    retyped: tuple[str, ...] = ()
    moved: bool = False

    def problems(self, *, order: bool = False) -> list[str]:
        """One phrase for each kind of difference; position only on demand."""
        spelled = {
            "blank column names at positions": self.blank,
            "duplicate column names": self.repeated,
            "NUL characters in the names at positions": self.unprintable,
            "missing columns": self.missing,
            "unexpected columns": self.unexpected,
            "columns of another type": self.retyped,
        }
        found = [f"{what} {', '.join(map(str, which))}" for what, which in spelled.items() if which]
        return found + (["another column order"] if order and self.moved and not found else [])


def _split(columns: Sequence) -> tuple[list[str], dict[str, object]]:
    pairs = [c if isinstance(c, tuple) else (c, None) for c in columns]
    return [str(n) for n, _ in pairs], dict(pairs)


def schema_diff(found: Sequence, wanted: Sequence | None = None) -> SchemaDiff:
    """Compare column lists (names, or (name, type) pairs as in ``df.dtypes``)."""
    names, types = _split(found)
    own = dict(
        blank=tuple(i for i, n in enumerate(names, 1) if not n.strip()),
        repeated=tuple(n for n, times in Counter(names).items() if times > 1),
        unprintable=tuple(i for i, n in enumerate(names, 1) if "\0" in n),
    )
    if wanted is None:
        return SchemaDiff(**own)
    expected, kinds = _split(wanted)
    return SchemaDiff(
        **own,
        missing=tuple(n for n in expected if n not in types),
        unexpected=tuple(n for n in types if n not in kinds),
        retyped=tuple(f"{n} ({types[n]}, expected {kinds[n]})" for n in expected
                      if n in types and kinds[n] is not None and types[n] != kinds[n]),
        moved=names != expected,
    )
