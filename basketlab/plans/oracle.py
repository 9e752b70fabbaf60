"""All oracle SQL strings, keyed like ``registry.QUERIES``."""
from __future__ import annotations

from basketlab.plans.oracle_aggregates import ORACLE as _AGG
from basketlab.plans.oracle_conv import ORACLE as _CONV
from basketlab.plans.oracle_misc import ORACLE as _MISC
from basketlab.plans.oracle_audit import ORACLE as _AUDIT
from basketlab.plans.oracle_given import ORACLE as _GIVEN
from basketlab.plans.oracle_reco import ORACLE as _RECO
from basketlab.plans.oracle_seg import ORACLE as _SEG

ORACLE: dict[str, str] = {}
for _part in (_AGG, _RECO, _AUDIT, _SEG, _CONV, _MISC, _GIVEN):
    ORACLE.update(_part)
