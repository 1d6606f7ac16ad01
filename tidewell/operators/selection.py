"""Selection of stories for a run under quotas. A rejected story takes no quota, so a run is one sequential fold, but only
over candidates that can still be selected: the first LOOK of each run are folded in parallel; then those behind them of
which the run, the feed or the publisher has its share are refused without a look at them, and the next ones of the others
are folded, up to 4 LOOK at a time. So no task is given a run of any size, only its next candidates and what it has
selected so far, and profiles are made of no other rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators.graph import checkpoints
from tidewell.operators.stories import PROFILE, decide, hashed_tokens, profile_of

PREFERENCE_LIMIT = 6
#: Candidates of a run that one task looks at.
LOOK = 500
SELECTED = "run_id string, story_id long, final_score double, selected boolean, selection_rank int, reason string, duplicate_of long, duplicate_reason string, duplicate_score double"


def score_v1(df: DataFrame) -> DataFrame:
    return df.withColumn("final_score", (F.col("editorial") + F.col("feed_adjustment") + F.col("preference") - F.when(F.col("excluded"), 80).otherwise(0)).cast("double"))


def score_v2(df: DataFrame) -> DataFrame:
    return df.withColumn("final_score", (F.col("editorial") + F.col("feed_adjustment") + X.clamp(F.col("preference"), -PREFERENCE_LIMIT, PREFERENCE_LIMIT)).cast("double"))


def fold(rows: list[dict], top_n: int, targets: dict[str, int], per_publisher: int, selected: tuple[dict, ...] = ()) -> list[tuple]:
    """Walks ranked rows (story_id, feed, publisher, profile): capacity, category, publisher, duplicate of a selected one, else selected.

    selected are rows that have been selected before these. A row without publisher meets no limit of publishers. Returns (story_id, selected, rank, reason, duplicate of, its reason, its score)."""
    chosen = list(selected)
    by_feed, by_publisher = Counter(r["feed"] for r in chosen), Counter(r["publisher"] for r in chosen)
    out = []
    for r in rows:
        feed, who = r["feed"], r["publisher"]
        if len(chosen) >= top_n:
            why = "capacity"
        elif by_feed[feed] >= targets.get(feed, top_n):
            why = "category_limit"
        elif who and by_publisher[who] >= per_publisher:
            why = "publisher_cap"
        else:
            found = next(((s["story_id"], *d[1:]) for s in chosen if (d := decide(r["profile"], s["profile"]))[0]), None)
            if found is None:
                out.append((r["story_id"], True, len(chosen), "global_rank", None, None, None))
                chosen.append(r)
                by_feed[feed] += 1
                by_publisher[who] += 1
            else:
                out.append((r["story_id"], False, None, "duplicate_suppression", found[0], found[1], round(found[2], 3)))
            continue
        out.append((r["story_id"], False, None, why, None, None, None))
    return out


def _closed(limits: dict[str, int], top_n: int, per_publisher: int, chosen: Column) -> tuple[Column, Column, Column]:
    """Whether a run is full, a row's feed has its share, its publisher has its share, where chosen rows stand."""
    most = reduce(lambda rest, x: F.when(F.col("feed") == x[0], F.lit(x[1])).otherwise(rest), limits.items(), F.lit(top_n))
    of = lambda c: F.size(F.filter(chosen, lambda x: x[c].eqNullSafe(F.col(c))))
    named = F.coalesce(F.col("publisher") != "", F.lit(False))
    return F.size(chosen) >= top_n, of("feed") >= most, named & (of("publisher") >= per_publisher)


def select_stories(candidates: DataFrame, top_n: int = 20, targets: dict[str, int] | None = None, per_publisher: int = 3, profiled: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Decisions on all candidates, by score, editorial score, id; of duplicates, as ``stories.decision`` tells them, the first is selected.

    Candidates have run_id, story_id, feed, publisher, final_score, editorial, published_epoch and the columns of a profile;
    or, with profiled, the first six only, and profiled adds the others to the few rows that are looked at."""
    limits = dict(targets or {})
    checkpoints(candidates.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["final_score", "editorial", "story_id"], ascending=[False, False, True])
        rows = [{**r, "profile": profile_of(r)} for r in g.to_dict("records")]
        new = [not r["held"] for r in rows]
        got = fold([r for r in rows if not r["held"]], top_n, limits, per_publisher, tuple(r for r in rows if r["held"]))
        g = g[new]
        ints = lambda i: pd.array([x[i] for x in got], "Int64")
        return pd.DataFrame({"run_id": g["run_id"].to_numpy(), "story_id": [x[0] for x in got], "final_score": g["final_score"].to_numpy(), "selected": [x[1] for x in got], "selection_rank": ints(2).astype("Int32"), "reason": [x[3] for x in got], "duplicate_of": ints(4), "duplicate_reason": [x[5] for x in got], "duplicate_score": [x[6] for x in got]})

    slim = ("run_id", "story_id", "feed", "publisher", "final_score", "editorial")
    own = [c for c in ("published_epoch", *PROFILE) if c not in slim] if profiled is None else []
    left = candidates.select(*slim, *own).checkpoint()
    order = Window.partitionBy("run_id").orderBy(F.desc("final_score"), F.desc("editorial"), "story_id")
    place = F.struct((-F.col("final_score")).alias("s"), (-F.col("editorial")).alias("e"), F.col("story_id").alias("i"))
    tokens = [hashed_tokens(F.col(c)).alias(c) if c.endswith("_tokens") else c for c in PROFILE if c != "feed"]
    out, passed, held, look = [], [], None, LOOK
    while True:
        # rows behind the first of a run go before the shuffle
        batch = left.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= look).drop("_n").checkpoint()
        whole = batch if profiled is None else profiled(batch)
        rows = whole.select(*slim, "published_epoch", *tokens, F.lit(False).alias("held"))
        rows = rows if held is None else rows.unionByName(held.withColumn("held", F.lit(True)).join(batch.select("run_id").distinct(), "run_id", "left_semi"))
        rows = rows.checkpoint()
        told = rows.groupBy("run_id").applyInPandas(run, SELECTED).checkpoint()
        out.append(told)
        chosen = rows.where("not held").drop("held").join(told.where("selected").select("run_id", "story_id"), ["run_id", "story_id"], "left_semi")
        held = (chosen if held is None else held.unionByName(chosen)).checkpoint()
        have = held.groupBy("run_id").agg(F.collect_list(F.struct(place.alias("place"), "feed", "publisher")).alias("have"))
        ends = batch.groupBy("run_id").agg(F.max(place).alias("end"))
        behind = left.join(ends, "run_id").where(place > F.col("end")).drop("end").join(have, "run_id", "left").withColumn("have", F.coalesce("have", F.array().cast(have.schema["have"].dataType)))
        full, feed, publisher = _closed(limits, top_n, per_publisher, F.col("have"))
        behind = behind.withColumn("shut", full | feed | publisher).drop("have").checkpoint()
        # nothing behind can be selected where the run is full, or its feed or publisher has its share: it is not looked at
        passed.append(behind.where("shut").select(*slim))
        left = behind.where("not shut").drop("shut").checkpoint()
        look = min(2 * look, 4 * LOOK)
        if left.isEmpty():
            break
    rest = reduce(DataFrame.unionByName, passed).join(have, "run_id", "left")
    before = F.filter(F.coalesce("have", F.array().cast(have.schema["have"].dataType)), lambda x: x["place"] < place)
    full, feed, _ = _closed(limits, top_n, per_publisher, F.col("before"))
    why = F.when(full, "capacity").when(feed, "category_limit").otherwise("publisher_cap")
    refused = rest.withColumn("before", before).select("run_id", "story_id", "final_score", F.lit(False).alias("selected"), why.alias("reason"))
    return reduce(DataFrame.unionByName, out).unionByName(refused, allowMissingColumns=True).select(*told.columns)
