"""Column roles of a panel, and the fixed vocabulary of its domain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that results depend on.
MARKETS = ("ar", "cl", "co", "br", "mx", "uy", "int")
PLAN_RANK = {"ini": 1, "ba": 2, "st": 3, "adv": 4, "pr": 5, "pro": 5, "fu": 6}
MODULES = ("tbl", "dv", "idvsls", "kds", "fi", "fe", "sbw", "top")
STATE_SEVERITY = {"ACTIVE": 0, "PAYMENT_VERIFICATION": 1, "PENDING_PAYMENT": 2, "BLOCKING_ALERT": 3, "BLOCKED": 4}
LOW_SEASON = (4, 5, 6, 7)
HIGH_SEASON = (10, 11, 12, 1, 2, 3)
RISK_ORDER = ("no_churn", "bajo", "medio", "alto")
TENURE_EDGES = (0, 3, 6, 12, 24, 48)
#: Labelled rows from which a rate is published.
MIN_ROWS = 100


@dataclass(frozen=True)
class PanelSpec:
    """Which columns of a table play which part; ``conform`` gives them the names that the operators use."""

    id: str = "id"
    period: str = "period"
    created: str | None = "created"
    state: str | None = "state"
    plan: str | None = "plan"
    country: str | None = "country"
    sales: tuple[str, ...] = ()
    additions: tuple[str, ...] = ()
    usage: tuple[str, ...] = ()
    keep: tuple[str, ...] = field(default=())

    def conform(self, df: DataFrame) -> DataFrame:
        """The role columns under their own names, then the metrics; a missing id or period is an error, other roles are left out."""
        for name in (self.id, self.period):
            if name not in df.columns:
                raise ValueError(f"required column {name!r} is missing")
        roles = {"id": self.id, "period": self.period, "created": self.created, "state": self.state, "plan": self.plan, "country": self.country}
        metrics = dict.fromkeys([*self.sales, *self.additions, *self.usage, *self.keep])
        return df.select(*[F.col(v).alias(k) for k, v in roles.items() if v and v in df.columns], *[m for m in metrics if m in df.columns])
