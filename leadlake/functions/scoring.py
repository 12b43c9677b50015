"""Lead score as a column expression (#60, #64)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


from leadlake import constants as K


@dataclass(frozen=True)
class ScoreWeights:
    weights: dict = field(default_factory=lambda: dict(K.SCORE_WEIGHTS))


def _plural(n: Column) -> Column:
    return F.when(n == 1, F.lit("")).otherwise(F.lit("s"))


def score_lead(seo: Column, outreach: Column, weights: ScoreWeights = ScoreWeights()) -> Column:
    """struct(score, reasons): opportunity share + reachability + live-site bonus."""
    w = weights.weights
    opp_points = seo["opportunity_score"]
    # Math.round(opp / 100 * w): integer arithmetic, half rounds up
    opp = F.floor((opp_points * w["opportunity"] * 2 + 100) / 200).cast("int")
    n_issues = F.size(seo["issues"])
    seo_reason = F.when(seo.isNull(), F.lit(None)).when(
        opp > 0,
        F.concat(n_issues.cast("string"), F.lit(" SEO issue"), _plural(n_issues),
                 F.lit(" to pitch (+"), opp.cast("string"), F.lit(")")),
    ).otherwise(F.lit(K.REASON_CLEAN))

    ne = F.size(outreach["emails"])
    np_ = F.size(outreach["phones"])
    ns = F.size(outreach["socials"])
    npp = F.size(outreach["people"])
    raw = (F.when(ne > 0, w["email"]).otherwise(0) + F.when(np_ > 0, w["phone"]).otherwise(0)
           + F.when(ns > 0, w["social"]).otherwise(0) + F.when(npp > 0, w["people"]).otherwise(0))
    reach = F.least(raw, F.lit(w["reach_cap"]))
    reach_reason = F.when(outreach.isNull(), F.lit(None)).when(
        reach > 0,
        F.concat(F.lit("reachable: "), ne.cast("string"), F.lit(" email / "), np_.cast("string"),
                 F.lit(" phone / "), ns.cast("string"), F.lit(" social (+"), reach.cast("string"), F.lit(")")),
    ).otherwise(F.lit(K.REASON_NO_CONTACT))

    status = seo["status_code"]
    live = seo.isNotNull() & (status.isNull() | (status == 0) | (status < 400))
    total = (F.when(seo.isNotNull() & (opp > 0), opp).otherwise(0)
             + F.when(outreach.isNotNull(), reach).otherwise(0)
             + F.when(live, w["live_bonus"]).otherwise(0))
    return F.struct(F.least(total, F.lit(w["cap"])).cast("int").alias("score"),
                    F.flatten(F.array(*[F.when(r.isNotNull(), F.array(r)).otherwise(F.array().cast("array<string>"))
                                        for r in (seo_reason, reach_reason)])).alias("reasons"))


def score_band(score: Column) -> Column:
    """hot (>= 70) / warm (>= 40) / cold (#64)."""
    return (F.when(score >= K.HOT_SCORE, F.lit("hot"))
            .when(score >= K.WARM_SCORE, F.lit("warm"))
            .otherwise(F.lit("cold")))
