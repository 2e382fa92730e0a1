"""Fusion of routing and ranking scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(score: Column, eps: float = 1e-6) -> Column:
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(eps))


def lp_fusion(m: Column, r: Column, alpha: float = 0.5, p: float = 3.0, eps: float = 1e-6) -> Column:
    return F.pow((1 - alpha) * F.pow(clip(m, eps), F.lit(p)) + alpha * F.pow(clip(r, eps), F.lit(p)), F.lit(1 / p))


def geometric_fusion(m: Column, r: Column, alpha: float = 0.5, eps: float = 1e-6) -> Column:
    return F.pow(clip(m, eps), F.lit(1 - alpha)) * F.pow(clip(r, eps), F.lit(alpha))


def fuse(how: str, m: Column, r: Column, alpha: float = 0.5, p: float = 3.0, eps: float = 1e-6) -> Column:
    """lp_fusion by name; any other name means the geometric one."""
    return lp_fusion(m, r, alpha, p, eps) if how == "lp_fusion" else geometric_fusion(m, r, alpha, eps)


def training_fusion(how: str, m: Column, r: Column, alpha: float = 0.5, p: float = 3.0) -> Column:
    """Fusion as used while a layer is trained: only the ranker is clipped. lp_hinge by name; any other name means the geometric one."""
    r = clip(r)
    return F.pow((1 - alpha) * F.pow(m, F.lit(p)) + alpha * F.pow(r, F.lit(p)), F.lit(1 / p)) if how == "lp_hinge" else F.pow(m, F.lit(1 - alpha)) * F.pow(r, F.lit(alpha))


def path_score(before: Column, p: Column, eps: float = 1e-9) -> Column:
    return before + F.log(F.greatest(p, F.lit(eps)))
