"""Access policy on report results. Rules are data; roles are named by the caller."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizpanel.operators.lists import Lists

DENY, MASK, EMPTY, ALLOW = "deny", "mask", "empty", "allow"


class AccessDenied(PermissionError):
    """The role may not see the report; raised before any job starts."""


@dataclass(frozen=True)
class Rule:
    """``deny`` or ``allow`` a report, ``mask`` its columns, or ``empty`` its lists.

    ``targets`` are column names for ``mask`` and list names for ``empty``.
    """

    report: str
    role: str
    effect: str
    targets: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...] = ()

    @classmethod
    def from_rows(cls, rows: Iterable[Mapping[str, object]]) -> Policy:
        return cls(
            tuple(
                Rule(
                    str(r["report"]),
                    str(r["role"]).lower(),
                    str(r["effect"]),
                    tuple(r.get("targets") or ()),
                )
                for r in rows
            )
        )

    def _rules(self, report: str, effect: str) -> list[Rule]:
        return [r for r in self.rules if r.report == report and r.effect == effect]

    def check(self, report: str, role: str) -> None:
        """Raise when the role is denied, or not on the report's allow list."""
        denied = {r.role.lower() for r in self._rules(report, DENY)}
        allowed = {r.role.lower() for r in self._rules(report, ALLOW)}
        if role.lower() in denied or (allowed and role.lower() not in allowed):
            raise AccessDenied(f"role {role!r} may not view {report!r}")

    def _targets(self, report: str, role: str, effect: str) -> set[str]:
        return {
            t
            for r in self._rules(report, effect)
            if r.role.lower() == role.lower()
            for t in r.targets
        }

    def mask(self, df: DataFrame, report: str, role: str) -> DataFrame:
        """Masked columns read 0; the others are untouched."""
        masked = self._targets(report, role, MASK)
        return df.select(
            *[
                F.lit(0).cast(f.dataType).alias(f.name) if f.name in masked else F.col(f.name)
                for f in df.schema.fields
            ]
        )

    def apply(self, lists: Mapping[str, DataFrame], report: str, role: str) -> Lists:
        """Check the report, mask its columns and empty its restricted lists."""
        self.check(report, role)
        emptied = self._targets(report, role, EMPTY)

        def seen(name: str) -> DataFrame:
            return empty_like(lists[name]) if name in emptied else self.mask(lists[name], report, role)

        return Lists({name: (lambda n=name: seen(n)) for name in lists})


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, same columns and types; the scan is dropped from the plan."""
    return df.limit(0)
