"""Operators on members of forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tail_extension(members: DataFrame, keys: Sequence[str], lead: str, value: str, central: str, native: int = 12, least: float = 1.0, ratio: tuple[float, float] = (0.2, 1.8), widen: float = 96.0) -> DataFrame:
    """Beyond the native leads `value` follows the central series at the member's own median ratio, widened with the lead.

    `keys` name an issue's member; a row has a member's value and the central forecast of its lead. The ratio is taken
    over native leads with a central value of at least `least`, bounded by `ratio`, and 1 without any; it grows by its
    distance from 1 once in `widen` leads. All rows stay; one window, no join.
    """
    near = F.when((F.col(lead) <= native) & (F.col(central) >= least), F.col(value) / F.col(central))
    med = F.median(near).over(Window.partitionBy(*keys))
    own = F.coalesce(F.when(med.isNotNull(), F.least(F.lit(ratio[1]), F.greatest(F.lit(ratio[0]), med))), F.lit(1.0))
    wide = F.col(central) * (1 + (own - 1) * (1 + (F.col(lead) - native) / widen))
    return members.withColumn(value, F.when(F.col(lead) <= native, F.col(value)).otherwise(wide))
