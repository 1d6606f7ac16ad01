"""The source portfolio: utility scores, category needs, selection, churn limit, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.functions import values as V

MINIMUM = 2


def utility(metrics: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """Adds category_need, confidence, raw_score and score to sources (source_id, feed, mode, metrics)."""
    fixed = F.sum(F.when(F.col("mode") == "always_on", 1).otherwise(0)).over(Window.partitionBy("feed"))
    df = metrics.withColumn("category_need", F.when(fixed < minimum, 100).otherwise(40))
    raw = 0.2 * F.col("reliability") + 0.1 * F.col("fresh_yield") + 0.2 * F.col("unique_yield") + 0.15 * F.col("confirmation_value") + 0.1 * F.col("selection_value") + 0.15 * F.col("reader_value") + 0.1 * F.col("category_need") - F.col("redundancy_penalty") - F.col("fetch_penalty")
    df = df.withColumn("confidence", F.least(F.lit(1.0), F.col("runs") / 10.0)).withColumn("raw", raw)
    return df.withColumn("score", F.round(F.col("confidence") * F.col("raw") + (1 - F.col("confidence")) * 50, 3)).withColumn("raw_score", F.round("raw", 3)).drop("raw")


def penalties(quality: DataFrame) -> DataFrame:
    """Adds what redundancy and fetching take off; sources without runs have 50 in all metrics and no penalty. quality has runs, mean_duration_ms."""
    seen = F.col("runs") > 0
    df = quality.withColumns({c: F.when(seen, F.col(c)).otherwise(50) for c in ("reliability", "fresh_yield", "unique_yield", "selection_value", "confirmation_value")})
    fetch = X.clamp((100 - F.col("reliability")) * 0.1 + F.coalesce("mean_duration_ms", F.lit(0)) / 10_000, 0.0, 15.0)
    return df.withColumns({"redundancy_penalty": F.greatest(F.lit(0.0), (50 - F.col("unique_yield")) * 0.2), "fetch_penalty": F.when(seen, fetch).otherwise(0.0)})


def portfolio(scored: DataFrame, budget: int, explore: int = 1, minimum: int = MINIMUM) -> DataFrame:
    """Adds role: always_on, category_minimum, budget, explore or none; scored has healthy_probes.

    Minimums by score in each feed, then the budget by score over the rest, then sources with three healthy probes, the
    least known first. Sources are a catalog; the windows without a key see one row for each of them."""
    auto = F.col("mode") == "auto"
    fixed = F.sum(F.when(F.col("mode") == "always_on", 1).otherwise(0)).over(Window.partitionBy("feed"))
    by_score = [F.desc("score"), "source_id"]
    df = scored.withColumn("need", F.greatest(F.lit(0), minimum - fixed)).withColumn("place", F.row_number().over(Window.partitionBy("feed", auto).orderBy(*by_score)))
    df = df.withColumn("role", F.when(F.col("mode") == "always_on", "always_on").when(auto & (F.col("place") <= F.col("need")), "category_minimum"))
    taken = F.count("role").over(Window.partitionBy(F.lit(0)))
    df = df.withColumn("left", F.greatest(F.lit(0), F.lit(max(budget - explore, 0)) - taken)).withColumn("next", F.row_number().over(Window.partitionBy(F.col("role").isNull() & auto).orderBy(*by_score)))
    df = df.withColumn("role", F.coalesce("role", F.when(auto & (F.col("next") <= F.col("left")), "budget")))
    open_ = F.col("role").isNull() & auto & (F.col("healthy_probes") >= 3)
    df = df.withColumn("next", F.row_number().over(Window.partitionBy(open_).orderBy("confidence", *by_score)))
    return df.withColumn("role", F.coalesce("role", F.when(open_ & (F.col("next") <= explore), "explore"), F.lit("none"))).drop("need", "place", "left", "next")


def limited_changes(proposed: DataFrame, previous: DataFrame, ratio: float = 0.2, minimum: int = MINIMUM) -> DataFrame:
    """Adds actual: the proposal of portfolio after at most max(1, floor(ratio * previous)) changes, additions first.

    Additions come in the order in which the portfolio picks, removals of automatic sources by id; what is always on
    stays in, what is blocked goes, and feeds below their minimum then get their proposed sources by score. Without a
    previous portfolio, (source_id), the proposal stands."""
    auto = F.col("mode") == "auto"
    df = proposed.join(previous.select("source_id", F.lit(True).alias("_was")), "source_id", "left").withColumn("_was", F.coalesce("_was", F.lit(False)))
    n = F.count_if("_was").over(Window.partitionBy(F.lit(0)))
    wanted, inside = F.col("role") != "none", (F.col("_was") & (F.col("mode") != "blocked")) | (F.col("mode") == "always_on")
    df = df.withColumns({"_n": n, "_want": wanted, "_in": inside})
    stage = F.when(F.col("_want") & ~F.col("_in"), F.element_at(F.create_map(*(F.lit(x) for kv in (("always_on", 0), ("category_minimum", 1), ("budget", 2), ("explore", 3)) for x in kv)), F.col("role"))).when(~F.col("_want") & F.col("_in") & auto, 4)
    feed_order = F.array_position(F.array(*map(F.lit, V.FEEDS)), F.col("feed"))
    df = df.withColumn("_stage", stage)
    order = ["_stage", F.when(F.col("_stage") == 1, feed_order).otherwise(0), F.when(F.col("_stage") == 3, F.col("confidence")).otherwise(0.0), F.when(F.col("_stage") < 4, -F.col("score")).otherwise(0.0), "source_id"]
    df = df.withColumn("_move", F.when(F.col("_stage").isNotNull(), F.row_number().over(Window.partitionBy(F.col("_stage").isNotNull()).orderBy(*order))))
    moved = F.col("_move") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))
    df = df.withColumn("actual", F.when(F.col("_n") == 0, F.col("_want")).when(F.coalesce(moved, F.lit(False)), ~F.col("_in")).otherwise(F.col("_in")))
    short = F.greatest(F.lit(0), minimum - F.count_if("actual").over(Window.partitionBy("feed")))
    more = ~F.col("actual") & F.col("_want") & auto
    df = df.withColumn("_short", short).withColumn("_next", F.row_number().over(Window.partitionBy("feed", more).orderBy(F.desc("score"), "source_id")))
    return df.withColumn("actual", F.col("actual") | (more & (F.col("_next") <= F.col("_short")))).drop("_was", "_n", "_want", "_in", "_stage", "_move", "_short", "_next")


# Fixed values.
REASONS = {"always_on": "Always on", "blocked": "Blocked by operator", "minimum": "Fills {} minimum", "explore": "Reserved exploration slot", "probe": "Low-evidence probe", "differs": "Shadow proposal differs from legacy input", "plain": "Ranked by marginal source utility"}
# End of fixed values.


def decisions(proposed: DataFrame, automatic: bool, probes: int = 1) -> DataFrame:
    """(source_id, actual_selected, proposed_selected, role, reasons, score, confidence): what is done with each source of a portfolio.

    proposed has the columns of portfolio, enabled, and, where automatic, actual (as of limited_changes). Otherwise what
    is enabled and not blocked is in, and the portfolio is a proposal. Little known sources that are out are probed."""
    wanted, explored = F.col("role") != "none", F.col("role") == "explore"
    actual = F.col("actual") if automatic else (F.col("mode") == "always_on") | (F.col("enabled") & (F.col("mode") != "blocked"))
    df = proposed.withColumn("_actual", actual)
    able = F.lit(automatic) & (F.col("mode") == "auto") & ~F.col("_actual") & (F.col("confidence") < 0.3)
    df = df.withColumn("_probe", able & (F.row_number().over(Window.partitionBy(able).orderBy(F.desc("score"), "source_id")) <= probes))
    before, after = REASONS["minimum"].split("{}")
    said = [
        F.when(F.col("mode") == "always_on", REASONS["always_on"]),
        F.when(F.col("mode") == "blocked", REASONS["blocked"]),
        F.when(wanted & (F.col("category_need") == 100), F.concat(F.lit(before), F.col("feed"), F.lit(after))),
        F.when(explored, REASONS["explore"]),
        F.when(F.col("_probe"), REASONS["probe"]),
        F.when(F.lit(not automatic) & (F.col("enabled") != wanted), REASONS["differs"]),
    ]
    reasons = X.let(F.array_compact(F.array(*said)), lambda r: F.when(F.size(r) > 0, r).otherwise(F.array(F.lit(REASONS["plain"]))))
    role = F.when(F.col("_actual"), F.when(explored & F.lit(automatic), "explore").otherwise("selected")).when(F.col("_probe"), "probe").otherwise("skipped")
    return df.select("source_id", F.col("_actual").alias("actual_selected"), wanted.alias("proposed_selected"), role.alias("role"), reasons.alias("reasons"), "score", "confidence")


def healthy_probes(decided: DataFrame, observations: DataFrame) -> DataFrame:
    """(source_id, healthy_probes): probes of a run in which the source was fetched."""
    ok = observations.where("succeeded").select("run_id", "source_id")
    return decided.where("role = 'probe'").join(ok, ["run_id", "source_id"], "left_semi").groupBy("source_id").agg(F.count("*").alias("healthy_probes"))


def last_portfolio(runs: DataFrame, decided: DataFrame, newest: int = 10) -> DataFrame:
    """The decisions of the newest of the last succeeded runs that has any; runs have run_id, status, finished_epoch."""
    recent = runs.where("status = 'succeeded'").orderBy(F.desc("finished_epoch"), F.desc("run_id")).limit(newest)
    best = recent.join(decided.select("run_id").distinct(), "run_id", "left_semi").agg(F.max_by("run_id", F.struct("finished_epoch", "run_id")).alias("run_id"))
    return decided.join(F.broadcast(best), "run_id")


def frozen_portfolio(decided: DataFrame, run_id: str, build) -> DataFrame:
    """The decisions that a run has; only if it has none those that build() gives, under its name."""
    mine = decided.where(F.col("run_id") == run_id)
    return build().withColumn("run_id", F.lit(run_id)).select(*decided.columns) if mine.isEmpty() else mine


def fetchable(decided: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that are in or probed, with their role."""
    return sources.join(decided.where("actual_selected or role = 'probe'").select("source_id", "role"), "source_id")


def suggestions(decided: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, action, score, confidence): of the latest run, among decisions not dismissed, proposals that differ from what is enabled.

    decided has run_id, created_epoch, dismissed, legacy_enabled."""
    kept = decided.where("not dismissed")
    latest = kept.agg(F.max_by("run_id", F.struct("created_epoch", "run_id")).alias("run_id"))
    differs = kept.join(F.broadcast(latest), "run_id").where("proposed_selected <> legacy_enabled").join(sources.select("source_id"), "source_id", "left_semi")
    return differs.select("source_id", F.when(F.col("proposed_selected"), "add").otherwise("remove").alias("action"), "score", "confidence")


def apply_suggestions(sources: DataFrame, accepted: DataFrame) -> DataFrame:
    """Sources with enabled as the accepted suggestions (source_id, action) say."""
    s = accepted.select("source_id", (F.col("action") == "add").alias("_on"))
    return sources.join(s, "source_id", "left").withColumn("enabled", F.coalesce("_on", "enabled")).drop("_on")


def mode_of_runs(decided: DataFrame) -> DataFrame:
    """(run_id, mode): the portfolio mode of a run's latest decision."""
    return decided.groupBy("run_id").agg(F.max_by("portfolio_mode", F.struct("created_epoch", "source_id")).alias("mode"))


def insights(observations: DataFrame, values: DataFrame, as_of: int, days: int = 90) -> DataFrame:
    """source_quality of the last days by identity: the source's id, or its URL where it has none; values has (source_key, value)."""
    from tidewell.operators.engagement import source_quality

    key = F.coalesce(F.concat(F.lit("id:"), F.col("reader_source_id").cast("string")), F.concat(F.lit("url:"), F.col("source_url")))
    recent = observations.where(F.col("created_epoch") >= as_of - days * 86400).withColumn("source_id", key)
    return source_quality(recent, values.withColumnRenamed("source_key", "source_id"))


def preset(sources: DataFrame, name: str, essentials: list[str] = (), security: list[str] = ()) -> DataFrame:
    """Sources as a preset has them: enabled and always on, or blocked; sources have name, category, enabled."""
    feed = X.feed_of(F.col("category"))
    core = F.col("name").isin(list(security))
    on = {
        "balanced": F.coalesce("enabled", F.lit(True)),
        "essentials": F.col("name").isin(list(essentials)),
        "markets": feed.isin("geopolitics", "business") | core,
        "ai-software": feed.isin("ai", "software") | core,
        "security-watch": (feed == "security") | F.contains(F.lower("category"), F.lit("status")),
    }[name]
    return sources.withColumn("enabled", on).withColumn("mode", F.when(F.col("enabled"), "always_on").otherwise("blocked"))


def source_problems(inputs: DataFrame) -> DataFrame:
    """Adds problems: what is wrong with a source as entered (name, category, url, priority, mode)."""
    bad = lambda c, most: ~F.length(F.trim(F.coalesce(c, F.lit("")))).between(1, most)
    rules = {"name": bad("name", 200), "category": bad("category", 200), "url": bad("url", 2000) | ~F.trim(F.coalesce("url", F.lit(""))).rlike(r"(?i)^[a-z][a-z0-9+.-]*://\S+$"), "priority": ~F.coalesce(F.col("priority").between(1, 5), F.lit(False)), "mode": ~F.coalesce(F.col("mode").isin("auto", "always_on", "blocked"), F.lit(False))}
    return inputs.withColumn("problems", F.array_compact(F.array(*(F.when(c, k) for k, c in rules.items()))))


def upsert_sources(sources: DataFrame, inputs: DataFrame) -> DataFrame:
    """Sources after the valid inputs: enabled follows the mode, URL without fragment and host are derived; keyed by feed_url."""
    from tidewell.operators.merging import upsert

    good = source_problems(inputs).where(F.size("problems") == 0)
    url = F.trim("url")
    enabled = F.when(F.col("mode") == "always_on", True).when(F.col("mode") == "blocked", False).otherwise(F.col("enabled"))
    rows = good.select(url.alias("feed_url"), F.trim("name").alias("name"), F.trim("category").alias("category"), "priority", "mode", enabled.alias("enabled"), F.regexp_replace(url, "#.*$", "").alias("normalized_url"), X.url_host(url).alias("host"))
    return upsert(sources, rows.dropDuplicates(["feed_url"]).select(*sources.columns), ["feed_url"])


def catalog_rows(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Sources with their defaults: the stored ones, or, where there is none, the configured ones, numbered.

    stored: id, name, category, url, priority, enabled, mode, feed_type, language, status; configured: ordinal, name, category, url, priority, enabled."""
    from tidewell.operators.publishing import fallback_rows

    kind = F.when(F.col("feed_type").isin("rss", "atom"), F.col("feed_type")).otherwise("unknown")
    status = F.when(F.col("status").isin("valid", "invalid", "blocked"), F.col("status")).otherwise("unverified")
    language = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("unknown"))
    s = stored.select("id", "name", "category", "url", "priority", "enabled", "mode", kind.alias("feed_type"), language.alias("language"), status.alias("status"))
    on = F.coalesce("enabled", F.lit(True))
    c = configured.select(F.concat(F.lit("fallback-"), F.col("ordinal").cast("string")).alias("id"), "name", "category", "url", F.coalesce("priority", F.lit(3)).cast(s.schema["priority"].dataType).alias("priority"), on.alias("enabled"), F.when(on, "always_on").otherwise("blocked").alias("mode"), *(F.lit(x).alias(n) for x, n in (("unknown", "feed_type"), ("unknown", "language"), ("unverified", "status"))))
    return fallback_rows(s, c)


def confirm_discovered(sources: DataFrame, proposals: DataFrame) -> DataFrame:
    """Sources and the confirmed proposals that are new, off and automatic: the URL must be the discovered one, and unknown so far.

    sources: feed_url, enabled, mode, priority, name; proposals: discovered_url, confirmed_url, name."""
    known = sources.select(X.normalize_url(F.col("feed_url")).alias("url"))
    p = proposals.select(X.normalize_url(F.col("discovered_url")).alias("url"), X.normalize_url(F.col("confirmed_url")).alias("seen"), "name")
    new = p.where("url = seen").groupBy("url").agg(F.min("name").alias("name")).join(known, "url", "left_anti")
    return sources.unionByName(new.select(F.col("url").alias("feed_url"), F.lit(False).alias("enabled"), F.lit("auto").alias("mode"), F.lit(3).cast(sources.schema["priority"].dataType).alias("priority"), "name"))


def run_summary(observations: DataFrame) -> DataFrame:
    """Per run: sources, categories that succeeded, failure rate, share of the largest publisher, unique selected stories."""
    w = F.max("selected") / F.nullif(F.sum("selected"), F.lit(0))
    return observations.groupBy("run_id").agg(F.count("*").alias("sources"), F.count_distinct(F.when(F.col("succeeded") & (F.col("unique_stories") > 0), F.col("category"))).alias("coverage"), F.round(F.avg(F.when(F.col("succeeded"), 0.0).otherwise(1.0)), 6).alias("failure_rate"), F.round(F.coalesce(w, F.lit(0.0)), 6).alias("concentration"), F.sum("selected").alias("unique_selected"))


def autopilot_gate(runs: DataFrame, least_runs: int = 10) -> DataFrame:
    """Whether the newest automatic runs hold against as many manual ones; runs has run_id, automatic and the summary."""
    newest = runs.withColumn("n", F.row_number().over(Window.partitionBy("automatic").orderBy(F.desc("run_id")))).where(F.col("n") <= least_runs)
    side = lambda a, c: F.avg(F.when(F.col("automatic") == a, F.col(c)))
    g = newest.agg(F.count_if("automatic").alias("automatic_runs"), *(x for c in ("coverage", "failure_rate", "concentration", "unique_selected") for x in (F.round(side(True, c), 6).alias(f"auto_{c}"), F.round(side(False, c), 6).alias(f"base_{c}"))))
    ok = (F.col("automatic_runs") >= least_runs) & (F.col("auto_coverage") >= F.col("base_coverage")) & (F.col("auto_failure_rate") <= F.col("base_failure_rate")) & (F.col("auto_concentration") <= F.col("base_concentration") + 0.1) & (F.col("auto_unique_selected") >= 0.95 * F.col("base_unique_selected"))
    return g.withColumn("passed", F.coalesce(ok, F.lit(False)))


def policy_gate(decisions: DataFrame, least_runs: int = 10, top: int = 20) -> DataFrame:
    """Paired runs of two policies: mean overlap of their selections, parity of counts, violations; decisions has run_id, policy, story_id, selected, selection_rank, eligible."""
    r = decisions.groupBy("run_id").agg(*(x for p in ("v1", "v2") for x in (F.count_if((F.col("policy") == p) & F.col("selected")).alias(f"{p}_n"), F.sort_array(F.collect_set(F.when((F.col("policy") == p) & F.col("selected") & (F.col("selection_rank") < top), F.col("story_id")))).alias(f"{p}_top"), F.count_if(F.col("policy") == p).alias(f"{p}_rows"))), F.count_if((F.col("policy") == "v2") & F.col("selected") & ~F.col("eligible")).alias("violations"))
    r = r.where("v1_rows > 0 and v2_rows > 0").withColumn("overlap", F.when(F.greatest(F.size("v1_top"), F.size("v2_top")) == 0, 1.0).otherwise(F.size(F.array_intersect("v1_top", "v2_top")) / F.nullif(F.greatest(F.size("v1_top"), F.size("v2_top")), F.lit(0))))
    out = r.agg(F.count("*").alias("paired_runs"), F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.coalesce(F.max(F.abs(F.col("v1_n") - F.col("v2_n"))), F.lit(0)).cast("long").alias("parity"), F.coalesce(F.sum("violations"), F.lit(0)).cast("long").alias("violations"))
    return out.withColumn("passed", F.coalesce((F.col("paired_runs") >= least_runs) & (F.col("parity") <= 1) & (F.col("violations") == 0), F.lit(False)))
