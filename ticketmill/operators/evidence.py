"""Evidence for clusters from logs, changes, metrics, status pages and versions.

A cluster row is ``(cluster_id, key, window_start, window_end)``. Every signal
operator returns ``(cluster_id, signal_key, role, stream, mode, count, prior,
threshold_hit)``, so signals are independent of each other and are simply
unioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketmill import defaults as D
from ticketmill.functions.once import compute_once
from ticketmill.functions.rules import pool_hint
from ticketmill.functions.status import parse_status_banner
from ticketmill.functions.times import http_date_age_hours, parse_ts
from ticketmill.operators import intervals, ordered
from ticketmill.operators.contains import contains_pairs
from ticketmill.session import scratch_folder, stored

HOUR = 3_600_000_000
SIGNAL = ("cluster_id", "signal_key", "role", "stream", "mode", "count", "prior", "threshold_hit")


def signal_rows(
    df: DataFrame, key: Column, role: Column, stream: Column, mode: Column, count: Column,
    prior: Column | None = None, threshold_hit: Column | None = None,
) -> DataFrame:
    return df.select(
        "cluster_id", key.alias("signal_key"), role.alias("role"), stream.alias("stream"),
        mode.alias("mode"), count.cast("long").alias("count"),
        (F.lit(0) if prior is None else prior).cast("long").alias("prior"),
        (F.lit(False) if threshold_hit is None else threshold_hit).alias("threshold_hit"),
    )


def elevated() -> Column:
    """Whether a signal row corroborates."""
    return F.col("threshold_hit") | F.when(F.col("mode") == "presence", F.col("count") > 0).otherwise(
        (F.col("count") >= 3) & (F.col("count") >= F.greatest(F.lit(3), 2 * F.col("prior")))
    )


def confidence_tier(signals: DataFrame) -> DataFrame:
    """``likely`` for cause and effect, ``consistent with`` for either, else ``none``."""
    rows = signals.select("cluster_id", "role", elevated().alias("up"))
    hit = {role: F.bool_or((F.col("role") == role) & F.col("up")) for role in ("cause", "effect")}
    return (
        rows.groupBy("cluster_id").agg(*[c.alias(r) for r, c in hit.items()])
        .select("cluster_id", _tier().alias("confidence"))
    )


def _tier() -> Column:
    return (
        F.when(F.col("cause") & F.col("effect"), "likely")
        .when(F.col("cause") | F.col("effect"), "consistent with")
        .otherwise("none")
    )


# --- cluster attributes -----------------------------------------------------
def cluster_pool_hint(cluster_tickets: DataFrame) -> DataFrame:
    """Site code from the earliest ticket of the cluster that names a machine."""
    text = F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("description_text", F.lit("")))
    return (
        cluster_tickets.withColumn("_h", pool_hint(text)).filter("_h IS NOT NULL")
        .groupBy("cluster_id").agg(F.min(F.struct("created_at", "id", "_h")).alias("m"))
        .select("cluster_id", F.col("m._h").alias("pool_hint"))
    )


def keywords(sources: Column, stopwords: Sequence[str] = D.STOPWORDS) -> Column:
    """Words of four letters or more that identify a system, sorted."""
    words = F.flatten(F.transform(sources, lambda s: F.split(F.lower(s), "[^a-z0-9]+")))
    long_enough = F.filter(words, lambda w: F.length(w) >= 4)
    return F.array_sort(F.array_distinct(F.array_except(long_enough, F.array(*[F.lit(s) for s in stopwords]))))


def cluster_keywords(
    clusters: DataFrame, cluster_tickets: DataFrame, stopwords: Sequence[str] = D.STOPWORDS,
    rules: Sequence[D.Rule] = D.CLUSTER_RULES,
) -> DataFrame:
    """Keywords from the cluster key, its label and its tickets' system keys.

    System keys come from the ticket classification, a small vocabulary; they
    are made distinct before they are gathered.
    """
    from ticketmill.operators.clusters import cluster_label

    own = clusters.select(
        "cluster_id", F.concat_ws(" ", F.col("key"), cluster_label(F.col("key"), rules)).alias("src")
    )
    theirs = cluster_tickets.select("cluster_id", F.col("system_key").alias("src")).distinct()
    return (
        own.unionByName(theirs)
        .select("cluster_id", F.explode_outer(keywords(F.array("src"), stopwords)).alias("word"))
        .groupBy("cluster_id").agg(F.array_sort(F.collect_set("word")).alias("keywords"))
    )


def _pool_names(pools: DataFrame) -> DataFrame:
    name = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("display_name", F.lit(""))))
    return pools.withColumn("_text", name)


def resolve_pool(hints: DataFrame, pools: DataFrame) -> DataFrame:
    """First pool (by ``ord``) whose name or display name contains the hint."""
    wanted = hints.select("pool_hint", F.lower("pool_hint").alias("_low")).filter("pool_hint IS NOT NULL").distinct()
    pairs = contains_pairs(wanted, "_low", _pool_names(pools), "_text", "ord")
    first = pairs.join(pools.select("ord", "name"), "ord").groupBy("hint").agg(F.min_by("name", "ord").alias("pool"))
    found = wanted.join(first, F.col("_low") == F.col("hint")).select("pool_hint", "pool")
    return hints.join(found, "pool_hint", "left").select("cluster_id", "pool_hint", "pool")


# --- log signals ------------------------------------------------------------
# Catalogs up to this many (signal, event type) rows become a scan filter and a
# broadcast; a larger one is joined as it is.
CATALOG_ROWS = 1_000


# The event columns that the names of a catalog's ``field`` stand for.
EVENT_FIELDS = {
    "EventType": "event_type", "Source": "source", "Severity": "severity", "DesktopId": "desktop_id", "Desktop": "desktop",
    "User": "user",
}


def tag_signals(
    events: DataFrame, catalog: DataFrame, fields: dict[str, str] = EVENT_FIELDS
) -> DataFrame:
    """Events with the signals they belong to; an event counts once per signal.

    A predicate compares its own ``field`` with its value, exactly: ``fields``
    names the event column a field stands for, another name is the column
    itself, and a field the events do not have matches nothing. A catalog
    without ``field`` means the event type. Excluded high-volume events are not
    in the catalog and so never match.
    """
    field = F.coalesce("field", F.lit("event_type")) if "field" in catalog.columns else F.lit("event_type")
    predicates = catalog.select(
        F.col("key").alias("signal_key"), "role", "stream", field.alias("_field"), F.col("value").alias("_value")
    ).where("_value IS NOT NULL").distinct()
    few = predicates.limit(CATALOG_ROWS + 1).collect()
    column = {name: fields.get(name, name) for name in {r["_field"] for r in few}}
    if len(few) <= CATALOG_ROWS:
        return _tag_by_expression(events, few, column)
    names = {r[0] for r in predicates.select("_field").distinct().collect()}  # columns of the events, at most
    column = {name: fields.get(name, name) for name in names}
    given = [F.struct(F.lit(n).alias("_field"), F.col(c).cast("string").alias("_value")) for n, c in sorted(column.items()) if c in events.columns]
    numbered = events.withColumn("_row", F.struct(*events.columns, F.monotonically_increasing_id().alias("_id")))
    met = numbered.select("_row", "stream", F.inline(F.array(*given))).join(predicates, ["stream", "_field", "_value"])
    once = met.select("_row", "signal_key", "role", "stream").distinct() if len(given) > 1 else met
    return once.select(*[F.col("_row")[c].alias(c) for c in events.columns], "signal_key", "role")


def _tag_by_expression(events: DataFrame, predicates: list, column: dict[str, str]) -> DataFrame:
    """The predicates of a small catalog as one expression: no join, and the scan skips everything else."""
    by_signal: dict[tuple, list[Column]] = {}
    hits: list[Column] = []
    values: dict[tuple, set] = {}
    for r in predicates:
        if column[r["_field"]] in events.columns:
            values.setdefault((r["stream"], column[r["_field"]], r["signal_key"], r["role"]), set()).add(r["_value"])
    for (stream, name, key, role), wanted in sorted(values.items()):
        hit = (F.col("stream") == stream) & F.col(name).cast("string").isin(*sorted(wanted))
        by_signal.setdefault((key, role), []).append(hit)
        hits.append(hit)
    if not hits:
        return events.withColumns({"signal_key": F.lit(""), "role": F.lit("")}).where(F.lit(False))
    any_hit, tags = hits[0], []
    for hit in hits[1:]:
        any_hit = any_hit | hit
    for (key, role), parts in sorted(by_signal.items()):
        some = parts[0]
        for part in parts[1:]:
            some = some | part
        tags.append(F.when(some, F.struct(F.lit(key).alias("signal_key"), F.lit(role).alias("role"))))
    return events.where(any_hit).select(*events.columns, F.inline(F.array_compact(F.array(*tags))))


def signal_counts(
    events: DataFrame, clusters: DataFrame, catalog: DataFrame,
    cause_hours: int = D.CAUSE_LOOKBACK_HOURS, effect_hours: int = D.EFFECT_LOOKBACK_HOURS,
    scoped_streams: Sequence[str] = ("horizon",),
) -> DataFrame:
    """Events per (cluster, signal) in the look-back window and, for effects, before it.

    The window is ``[start - lookback, end]`` and the prior window the equally
    long span just before, half-open so that no event is in both. Where the
    cluster has a resolved ``pool``, events of the pool-scoped streams must
    carry that pool id.
    """
    points = _with_scope(tag_signals(events, catalog), scoped_streams).select(
        "signal_key", F.unix_micros("timestamp").alias("at"), "scope"
    )
    signals = catalog.select(F.col("key").alias("signal_key"), "role", "stream").distinct()
    probes = _probes(clusters, catalog, scoped_streams)
    look = F.when(F.col("role") == "cause", cause_hours).otherwise(effect_hours) * F.lit(HOUR)
    start, end = F.unix_micros("window_start") - look, F.unix_micros("window_end") + 1
    span = F.unix_micros("window_end") - start
    counted = ordered.range_counts(
        points, probes, ["signal_key", "scope"], "at", "cluster_id",
        {"count": (start, end), "prior": (start - span, start)},
    )
    is_cause = F.col("role") == "cause"
    return signal_rows(
        counted.join(signals, "signal_key"), F.col("signal_key"), F.col("role"), F.col("stream"),
        F.when(is_cause, "presence").otherwise("elevation"), F.col("count"),
        F.when(is_cause, 0).otherwise(F.col("prior")),
    )


def _each_signal(clusters: DataFrame, signals: DataFrame) -> DataFrame:
    """Every cluster with every signal of the catalog (one small row per signal)."""
    listed = signals.agg(F.array_sort(F.collect_set(F.struct("signal_key", "role", "stream"))).alias("l")).scalar()
    return clusters.withColumn("_s", F.explode(listed)).select(*clusters.columns, "_s.*")


def log_error_rate(
    logs: DataFrame, clusters: DataFrame, app: str, machine: str | None = None,
    session: str | None = None, lookback_hours: int = 1,
) -> DataFrame:
    """Errors and warnings of an application in the window against the time before it."""
    keep = (F.col("app") == app) & F.col("level").isin("Error", "Warning")
    if machine:
        keep &= F.col("machine") == machine
    if session:
        keep &= F.col("session") == session
    points = logs.filter(keep).select(F.lit(app).alias("app"), F.unix_micros("timestamp").alias("at"))
    start, end = F.unix_micros("window_start"), F.unix_micros("window_end")
    counted = ordered.range_counts(
        points, clusters.withColumn("app", F.lit(app)), ["app"], "at", "cluster_id",
        {"count": (start, end + 1), "prior": (start - lookback_hours * HOUR, start)},
    )
    return signal_rows(
        counted, F.lit(f"{app.lower()}.log_errors"), F.lit("effect"), F.lit("seq"), F.lit("elevation"),
        F.col("count"), F.col("prior"),
    )


def sample_log_fields(tagged: DataFrame, display_fields: Sequence[str] = ("desktop", "user")) -> DataFrame:
    """Display shape of an event: time, source, event and the short display names."""
    shown = [F.col(f).alias(f.split("@")[-1].split("_")[-1].lower()) for f in display_fields]
    have = {f.split("@")[-1].split("_")[-1].lower() for f in display_fields}
    stable = [] if "desktop" in have else [F.col("desktop")]
    return tagged.select(
        "signal_key", "timestamp", "source", F.col("event_type").alias("event"), *shown, *stable
    )


def _with_scope(tagged: DataFrame, scoped_streams: Sequence[str]) -> DataFrame:
    """Each event once for all clusters and, in a pool-scoped stream, once for its pool."""
    own = F.when(F.col("stream").isin(*scoped_streams), F.col("desktop_id"))
    return tagged.withColumn("scope", F.explode(F.array_compact(F.array(F.lit("*"), own))))


def _probes(clusters: DataFrame, catalog: DataFrame, scoped_streams: Sequence[str]) -> DataFrame:
    """Every cluster with every signal, and the scope its events must have."""
    signals = catalog.select(F.col("key").alias("signal_key"), "role", "stream").distinct()
    pool = F.col("pool") if "pool" in clusters.columns else F.lit(None).cast("string")
    scope = F.when(F.col("stream").isin(*scoped_streams), F.coalesce("_pool", F.lit("*"))).otherwise("*")
    return _each_signal(clusters.withColumn("_pool", pool), signals).withColumn("scope", scope)


def signal_samples(
    events: DataFrame, clusters: DataFrame, catalog: DataFrame, n: int = 8,
    cause_hours: int = D.CAUSE_LOOKBACK_HOURS, effect_hours: int = D.EFFECT_LOOKBACK_HOURS,
    scoped_streams: Sequence[str] = ("horizon",),
) -> DataFrame:
    """The newest ``n`` events of each (cluster, signal) window, numbered by ``ord``.

    The events are those that :func:`signal_counts` counts: of the cluster's pool
    where it has one. An event's position in its signal's time order, within its
    pool and overall, is an exact running count, so a cluster asks for ``n``
    positions by equality instead of pairing with every event in its window.
    """
    tagged = _with_scope(tag_signals(events, catalog), scoped_streams).withColumn("at", F.unix_micros("timestamp"))
    placed = ordered.rank_in_key(tagged, ["signal_key", "scope"], "at", [F.col("event_id")], "pos")
    probes = _probes(clusters, catalog, scoped_streams)
    look = F.when(F.col("role") == "cause", cause_hours).otherwise(effect_hours) * F.lit(HOUR)
    start, end = F.unix_micros("window_start") - look, F.unix_micros("window_end") + 1
    floor = F.lit(-(2**62))
    upto = ordered.range_counts(
        tagged.select("signal_key", "scope", "at"), probes, ["signal_key", "scope"], "at", "cluster_id",
        {"below": (floor, start), "upto": (floor, end)},
    )
    wanted = upto.filter("upto > below").select(
        "cluster_id", "signal_key", "scope",
        F.posexplode(
            F.sequence(F.col("upto"), F.greatest(F.col("below") + 1, F.col("upto") - n + 1), F.lit(-1).cast("long"))
        ).alias("ord", "pos"),
    )
    return wanted.join(placed.drop("at"), ["signal_key", "scope", "pos"]).drop("pos", "scope")


def pool_counts(
    events: DataFrame, clusters: DataFrame, catalog: DataFrame,
    cause_hours: int = D.CAUSE_LOOKBACK_HOURS, effect_hours: int = D.EFFECT_LOOKBACK_HOURS,
    scoped_streams: Sequence[str] = ("horizon",),
) -> DataFrame:
    """``(cluster_id, name, pool, n)``: all events in the cluster's windows by pool id and pool name.

    Counted per pool at the ends of each window, so no event is paired with a
    cluster; a cluster with a pool looks at that pool alone in scoped streams.
    Which pools a cluster looks at is read from the dyadic nodes of time that a
    pool has events in: those that fill the cluster's window.
    """
    keys = ["signal_key", "pool_id", "pool_name"]
    points = tag_signals(events, catalog).filter("desktop_id IS NOT NULL OR desktop IS NOT NULL").select(
        "signal_key", F.coalesce("desktop_id", F.lit("")).alias("pool_id"), F.coalesce("desktop", F.lit("")).alias("pool_name"),
        F.unix_micros("timestamp").alias("at"),
    )
    look = F.when(F.col("role") == "cause", cause_hours).otherwise(effect_hours) * F.lit(HOUR)
    start, end = F.unix_micros("window_start") - look, F.unix_micros("window_end") + 1
    first, last = (intervals.cell(F.floor(x / 1_000_000)) for x in (start, end - 1))
    asked = _probes(clusters, catalog, scoped_streams)
    longest = asked.agg(F.max(last - first)).first()[0]
    levels = (longest or 0).bit_length() + 1
    # one row per pool, signal and node with events
    active = points.select(*keys, intervals.cell(F.floor(F.col("at") / 1_000_000)).alias("_cell")).distinct().select(
        *keys, F.explode(intervals.above(F.col("_cell"), levels)).alias("_node")
    ).distinct()
    windows = asked.where("window_start <= window_end").withColumn("_node", F.explode(intervals.cover(first, last, levels)))
    known = windows.select("cluster_id", "signal_key", "scope", "_node").join(active, ["signal_key", "_node"]).where(
        "scope = '*' OR scope = pool_id"
    ).select("cluster_id", *keys).distinct()
    probes = asked.join(known, ["cluster_id", "signal_key"])
    counted = ordered.range_counts(points, probes, keys, "at", "cluster_id", {"n": (start, end)})
    return counted.filter("n > 0").groupBy("cluster_id", "pool_id", "pool_name").agg(F.sum("n").alias("n")).select(
        "cluster_id", F.nullif("pool_id", F.lit("")).alias("name"), F.nullif("pool_name", F.lit("")).alias("pool"), "n"
    )


def limit_samples(samples: DataFrame, n: int) -> DataFrame:
    """The first ``n`` samples of each (cluster, signal)."""
    return samples.filter(F.col("ord") < n)


def pools_seen(counted: DataFrame, top: int = 3) -> DataFrame:
    """Most frequent pools among all events of a cluster (:func:`pool_counts`); ties in order of name."""
    named = counted.withColumn("pool", F.coalesce("pool", "name")).groupBy("cluster_id", "pool").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("cluster_id").orderBy(F.col("n").desc(), "pool")
    return named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "cluster_id", "rank", "pool", "n"
    )


def aligned_pools(named: DataFrame, hints: DataFrame) -> DataFrame:
    """Distinct pool names and ids among a cluster's events that contain its machine hint.

    ``named`` has ``cluster_id, name, pool``, as :func:`pool_counts` gives them.
    """
    names = F.array_compact(F.array("name", "pool"))
    asked = hints.filter("pool_hint IS NOT NULL").select("cluster_id", "pool_hint")
    matched = (
        named.select("cluster_id", F.explode(names).alias("pool_name")).join(asked, "cluster_id")
        .filter(F.contains(F.lower("pool_name"), F.lower("pool_hint")))
        .groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("pool_name")), ", ").alias("aligned"))
    )
    return asked.join(matched, "cluster_id", "left").select(
        "cluster_id", "pool_hint", F.coalesce("aligned", F.lit("none matched")).alias("aligned")
    )


# --- pools ------------------------------------------------------------------
def pool_error_signal(clusters: DataFrame, pools: DataFrame) -> DataFrame:
    """Pool errors now, for the hinted pools only where the cluster has a hint."""
    errors = F.coalesce("error_count", F.lit(0)).cast("long")
    stock = pools.withColumn("_e", errors)
    hints = clusters.select("cluster_id", F.lower("pool_hint").alias("_h"))
    # one total per distinct hint, then back to the clusters
    pairs = contains_pairs(hints, "_h", _pool_names(stock), "_text", "ord")
    per_hint = pairs.join(stock.select("ord", "_e"), "ord").groupBy(F.col("hint").alias("_h")).agg(F.sum("_e").alias("_t"))
    everywhere = stock.agg(F.coalesce(F.sum("_e"), F.lit(0))).scalar()
    counted = hints.join(per_hint, "_h", "left").withColumn(
        "_c", F.when(F.col("_h").isNull(), everywhere).otherwise(F.coalesce("_t", F.lit(0)))
    )
    return signal_rows(
        counted, F.lit("vdi.pool_errors"), F.lit("effect"), F.lit("horizon-mcp"), F.lit("presence"), F.col("_c")
    )


def pool_error_samples(pools: DataFrame) -> DataFrame:
    return pools.filter("error_count > 0").select(
        F.coalesce("display_name", "name").alias("pool"), "name", "error_count"
    )


# --- changes ----------------------------------------------------------------
def parsed_changes(changes: DataFrame) -> DataFrame:
    """Change records with start, end (start when absent), and update time."""
    start = parse_ts(F.col("planned_start_date"))
    return changes.withColumns(
        {
            "start": start,
            "end": F.coalesce(parse_ts(F.col("planned_end_date")), start),
            "updated": parse_ts(F.col("updated_at")),
        }
    )


def change_updates(
    clusters: DataFrame, changes: DataFrame, lookback_hours: int = D.CHANGE_LOOKBACK_HOURS
) -> DataFrame:
    """Number of changes updated since the look-back began, whatever their planned window.

    Two look-ups in running totals per cluster: no change is paired with one.
    """
    points = changes.filter("updated IS NOT NULL").select(F.lit("change").alias("all"), F.unix_micros("updated").alias("at"))
    since = F.unix_micros("window_start") - lookback_hours * F.lit(HOUR)
    counted = ordered.range_counts(
        points, clusters.withColumn("all", F.lit("change")), ["all"], "at", "cluster_id", {"count": (since, F.lit(2**62))}
    )
    return counted.select("cluster_id", "count")


def change_overlap(
    clusters: DataFrame, changes: DataFrame, lookback_hours: int = D.CHANGE_LOOKBACK_HOURS,
    require_overlap: bool = True,
) -> DataFrame:
    """Changes whose planned window overlaps the cluster's, updated within the look-back.

    Two intervals overlap where one starts within the other: a change that
    starts in the cluster's window, or a window that starts later within the
    change's. Both are points in intervals (:func:`~ticketmill.operators.intervals.stab`),
    so each pair appears once and a change of any length has few rows. Without
    the overlap rule every change updated since is a pair, for the keyword test
    of a few clusters; where only the number is wanted, :func:`change_updates`
    counts without pairs. Both sides are read many times, so they are written
    once, below the shared checkpoint folder.
    """
    folder = scratch_folder(clusters.sparkSession)
    since = F.col("window_start") - F.make_dt_interval(hours=F.lit(lookback_hours))
    c = stored(clusters.withColumn("since", since), f"{folder}/clusters")
    if not require_overlap:
        newest = changes.agg(F.max("updated")).first()[0]
        until = c.withColumn("_until", F.lit(newest).cast("timestamp"))
        return intervals.stab(changes, "updated", until, "since", "_until").select(*clusters.columns, *changes.columns)
    fresh = F.col("updated") >= F.col("since")
    parsed = stored(changes, f"{folder}/changes")
    planned = parsed.filter("start IS NOT NULL AND end >= start")
    begins = intervals.stab(planned, "start", c, "window_start", "window_end")
    within = intervals.stab(c, "window_start", planned, "start", "end").filter("window_start > start")
    columns = [*clusters.columns, *changes.columns]
    return begins.filter(fresh).select(*columns).unionByName(within.filter(fresh).select(*columns))


def change_keyword_match(pairs: DataFrame) -> DataFrame:
    """Keep pairs where a keyword is in the impacted services or the subject text."""
    impacted = F.lower(F.concat_ws(" ", F.coalesce("impacted_services", F.array().cast("array<string>"))))
    subject = F.lower(
        F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("description_text", F.lit("")))
    )
    hit = F.exists(
        "keywords", lambda k: F.contains(F.col("_i"), F.lower(k)) | F.contains(F.col("_s"), F.lower(k))
    )
    texts = pairs.withColumns({"_i": impacted, "_s": subject})
    return texts.filter((F.coalesce(F.size("keywords"), F.lit(0)) <= 0) | hit).drop("_i", "_s")


def change_feed_signal(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Matched changes per cluster, as a cause on presence."""
    counted = pairs.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    rows = clusters.select("cluster_id").join(counted, "cluster_id", "left")
    return signal_rows(
        rows, F.lit("change_feed"), F.lit("cause"), F.lit("changes"), F.lit("presence"),
        F.coalesce("_n", F.lit(0)),
    )


def change_samples(pairs: DataFrame, limit: int = 6) -> DataFrame:
    """The first ``limit`` matched changes per cluster by change id."""
    order = Window.partitionBy("cluster_id").orderBy("id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


# --- status pages -----------------------------------------------------------
def vendor_statuses(pages: DataFrame) -> DataFrame:
    """Status per vendor page; a page without text was unreachable."""
    parsed = pages.select("vendor", "html", F.inline(F.array(parse_status_banner(F.col("html")))))
    return parsed.select(
        "vendor", F.when(F.col("html").isNull(), "unreachable").otherwise(F.col("status")).alias("status"), "checked"
    )


def vendor_status_signal(clusters: DataFrame, pages: DataFrame) -> DataFrame:
    """Vendors not ``up``, each once: ``unknown`` counts, unreachable does not."""
    down = vendor_statuses(pages).agg(
        F.count_distinct(F.when(~F.col("status").isin("up", "unreachable"), F.col("vendor")))
    ).scalar()
    return signal_rows(
        clusters.withColumn("_n", down), F.lit("saas_status"), F.lit("cause"), F.lit("status-pages"),
        F.lit("presence"), F.col("_n"),
    )


# --- metrics ----------------------------------------------------------------
def pick_metrics(
    words: Column, metrics: Sequence[D.Metric] = D.METRICS, flavour_words: dict = D.METRIC_WORDS, limit: int | None = None
) -> Column:
    """Metric definitions for a cluster's keywords.

    Those of every flavour a word of which occurs in the joined keywords, else
    the first of each flavour; at most ``limit``, if one is given.
    """
    blob = F.lower(F.concat_ws(" ", F.coalesce(words, F.array().cast("array<string>"))))

    def listed(some: Sequence[D.Metric]) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(m.key).alias("metric_key"), F.lit(m.metric).alias("metric"),
                    F.lit(m.threshold).cast("double").alias("threshold"),
                )
                for m in some
            ]
        )

    none = F.slice(listed(metrics[:1]), 1, 0)
    picked = []
    for flavour, its_words in flavour_words.items():
        named = F.lit(False)
        for w in its_words:
            named |= F.contains(blob, F.lit(w))
        picked.append(F.when(named, listed([m for m in metrics if m.flavour == flavour])).otherwise(none))
    chosen = F.concat(*picked)
    firsts = [next(m for m in metrics if m.flavour == f) for f in flavour_words]
    found = F.when(F.size(chosen) > 0, chosen).otherwise(listed(firsts))
    return found if limit is None else F.slice(found, 1, limit)


def metric_elevation(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Peak of each picked metric in the window against the equally long span before.

    ``clusters`` carries ``metrics`` (from :func:`pick_metrics`); the span is at
    least one hour. Peaks are rounded to whole numbers, halves to even.
    """
    ask = clusters.select(
        "cluster_id", "window_start", "window_end", F.inline("metrics")
    ).withColumn(
        "_span", F.greatest(F.lit(HOUR), F.unix_micros("window_end") - F.unix_micros("window_start"))
    ).withColumn("_id", F.concat_ws("|", "cluster_id", "metric_key"))
    series = points.select("metric", F.unix_micros("ts").alias("at"), "value")
    end = F.unix_micros("window_end") + 1
    span = F.col("_span")
    peaks = ordered.range_max(
        series, ask, ["metric"], "at", "value", "_id",
        {"current": (end - span, end), "baseline": (end - 2 * span, end - span)},
    ).drop("metric")
    both = ask.join(peaks, "_id")
    return both.select(
        "cluster_id", "metric_key", F.col("current").alias("current_peak"),
        F.col("baseline").alias("baseline_peak"),
        F.when(F.col("baseline") != 0, F.round(F.col("current") / F.col("baseline"), 4)).alias("ratio"),
        F.coalesce(F.col("current") > F.col("threshold"), F.lit(False)).alias("exceeded"),
    )


def metric_signal(peaks: DataFrame) -> DataFrame:
    def whole(c: str) -> Column:
        return F.coalesce(F.bround(c, 0), F.lit(0.0))

    return signal_rows(
        peaks, F.concat(F.lit("metric."), F.col("metric_key")), F.lit("effect"), F.lit("metrics"),
        F.lit("elevation"), whole("current_peak"), whole("baseline_peak"), F.col("exceeded"),
    )


# --- application versions ---------------------------------------------------
def version_transitions(snapshots: DataFrame) -> DataFrame:
    """Snapshots with the app's previous ``version|last_modified`` and whether it changed."""
    cur = F.concat_ws("|", F.coalesce("version", F.lit("None")), F.coalesce("last_modified", F.lit("None")))
    timed = snapshots.withColumns({"current": cur, "_at": F.unix_micros("observed_at")})
    lagged = ordered.previous_value(timed, ["app"], "_at", ["current"], "current", "previous", ordered.MINUTE)
    return lagged.drop("_at").withColumn(
        "changed", F.coalesce(F.col("previous") != F.col("current"), F.lit(False))
    )


def version_change_signal(
    clusters: DataFrame, snapshots: DataFrame, app_word: str = "engage",
    recency_hours: int = D.VERSION_RECENCY_HOURS,
) -> DataFrame:
    """Recent or observed publishes as a cause, for clusters of the application only.

    Per cluster each app is judged by its newest snapshot up to the window end.
    A changed app counts; an unchanged one only for production and only when
    published within ``recency_hours``.

    A snapshot is the newest of its app until the next one. The times in which
    it counts form one interval, so the apps that count at a window's end are
    the intervals begun by then less those over: two look-ups in running totals
    per cluster, and no app meets a cluster.
    """
    ours = clusters.filter(F.contains(F.lower("key"), F.lit(app_word)))
    moved = version_transitions(snapshots).filter("observed_at IS NOT NULL").withColumns(
        {"_at": F.unix_micros("observed_at"), "_back": -F.unix_micros("observed_at")}
    )
    # the next snapshot of the app: the previous one in falling order
    placed = ordered.rank_in_key(moved, ["app"], "_at", [F.col("current"), F.col("changed").desc()], "_pos")
    until = ordered.previous_value(
        placed.withColumn("_rev", -F.col("_pos")), ["app"], "_back", ["_rev"], "_at", "_next", ordered.MINUTE
    )
    prod = F.contains(F.lower("app"), F.lit("prod"))
    age = http_date_age_hours(F.col("last_modified"), F.col("observed_at"))  # of the publish, when observed
    fresh_until = F.col("_at") + F.round((recency_hours - age) * HOUR).cast("long")
    over = F.when(F.col("changed"), F.lit(2**62)).when(prod, fresh_until + 1)
    judged = compute_once(until, ["_at", "_next"], {"_over": over})
    spans = judged.filter("_over IS NOT NULL").select(
        "_at", F.least("_over", F.coalesce("_next", F.lit(2**62))).alias("_over")
    ).filter("_over > _at")
    spans = stored(spans, f"{scratch_folder(clusters.sparkSession)}/spans")  # for both look-ups
    ends = F.unix_micros("window_end") + 1
    floor = F.lit(-(2**62))

    def upto(times: Column, name: str) -> DataFrame:
        return ordered.range_counts(
            spans.select(F.lit("v").alias("all"), times.alias("at")), ours.withColumn("all", F.lit("v")), ["all"], "at",
            "cluster_id", {name: (floor, ends)},
        ).select("cluster_id", name)

    counted = upto(F.col("_at"), "_begun").join(upto(F.col("_over"), "_gone"), "cluster_id").select(
        "cluster_id", (F.col("_begun") - F.col("_gone")).alias("_n")
    ).filter("_n > 0")
    return signal_rows(
        counted, F.lit(f"{app_word}.version_change"), F.lit("cause"), F.lit("versions"), F.lit("presence"), F.col("_n"),
    )


def version_weight(app: Column, changed: Column) -> Column:
    """1.0 for production, 0.3 otherwise; 0.7 of it when only recent. Informational."""
    base = F.when(F.contains(F.lower(app), F.lit("prod")), 1.0).otherwise(0.3)
    return F.when(changed, base).otherwise(F.round(base * 0.7, 2))


# --- evidence per alert -----------------------------------------------------
def alert_evidence(signals: DataFrame, pools: DataFrame | None = None) -> DataFrame:
    """Per cluster the ``evidence`` struct of the alert table and ``items`` for the digest.

    A cluster has one row per signal of the catalog, so the lists are short.
    """
    item = F.struct(
        F.col("signal_key").alias("key"), "role", "stream", "count", "prior", elevated().alias("elevated")
    )
    up = {role: F.bool_or((F.col("role") == role) & elevated()) for role in ("cause", "effect")}
    out = signals.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(item)).alias("items"), *[c.alias(r) for r, c in up.items()]
    ).withColumn("confidence", _tier())
    none = F.array().cast("array<string>")
    if pools is None:
        out = out.withColumn("pools", none)
    else:
        named = (
            pools.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pool"))).alias("p"))
            .select("cluster_id", F.transform("p", lambda e: e["pool"]).alias("pools"))
        )
        out = out.join(named, "cluster_id", "left").withColumn("pools", F.coalesce("pools", none))
    plain = F.transform(
        "items", lambda s: F.struct(s["key"], s["role"], s["count"], s["prior"], s["elevated"])
    )
    return out.select(
        "cluster_id", F.struct("confidence", plain.alias("signals"), "pools").alias("evidence"), "items"
    )


def all_signals(
    clusters: DataFrame, events: DataFrame | None = None, catalog: DataFrame | None = None,
    app_logs: DataFrame | None = None, app: str | None = None, pools: DataFrame | None = None,
    changes: DataFrame | None = None, pages: DataFrame | None = None, points: DataFrame | None = None,
    snapshots: DataFrame | None = None, app_word: str = "engage",
) -> DataFrame:
    """The signals of every source that is given, one table.

    A missing source removes only its own signals. ``clusters`` may carry
    ``pool`` (events), ``pool_hint`` (pools), ``keywords`` (changes, parsed) and
    ``metrics`` (points); a column that is missing counts as null.
    """
    wanted = {"pool_hint": "string", "keywords": "array<string>"}
    have = clusters.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in clusters.columns})
    parts = []
    if events is not None and catalog is not None:
        parts.append(signal_counts(events, have, catalog))
    if app_logs is not None and app is not None:
        parts.append(log_error_rate(app_logs, have, app))
    if pools is not None:
        parts.append(pool_error_signal(have, pools))
    if changes is not None:
        parts.append(change_feed_signal(have, change_keyword_match(change_overlap(have, changes))))
    if pages is not None:
        parts.append(vendor_status_signal(have, pages))
    if points is not None and "metrics" in clusters.columns:
        parts.append(metric_signal(metric_elevation(points, have)))
    if snapshots is not None:
        parts.append(version_change_signal(have, snapshots, app_word))
    if not parts:
        return clusters.sparkSession.createDataFrame([], clusters.select("cluster_id").schema).select(
            "cluster_id", *[F.lit("").alias(c) for c in SIGNAL[1:5]], *[F.lit(0).cast("long").alias(c) for c in SIGNAL[5:7]],
            F.lit(False).alias(SIGNAL[7]),
        )
    out = parts[0].select(*SIGNAL)
    for part in parts[1:]:
        out = out.unionByName(part.select(*SIGNAL))
    return out


def corroborate(
    clusters: DataFrame, events: DataFrame | None = None, catalog: DataFrame | None = None, **sources
) -> DataFrame:
    """Tier, evidence and items of every cluster from all its signals; see :func:`all_signals`.

    The pools named are the busiest ones among the events. A cluster without any
    signal has tier ``none``. Every source looks at the clusters, so they are
    written once, below the shared checkpoint folder.
    """
    clusters = stored(clusters, f"{scratch_folder(clusters.sparkSession)}/clusters")
    found = all_signals(clusters, events, catalog, **sources)
    seen = None
    if events is not None and catalog is not None:
        seen = pools_seen(pool_counts(events, clusters, catalog))
    proof = alert_evidence(found, seen)
    nothing = F.struct(
        F.lit("none").alias("confidence"), F.array().cast(proof.schema["evidence"].dataType["signals"].dataType).alias("signals"),
        F.array().cast("array<string>").alias("pools"),
    )
    return clusters.select("cluster_id").join(proof, "cluster_id", "left").select(
        "cluster_id", F.coalesce("evidence", nothing).alias("evidence"), "items"
    )


def evidence_json(evidence: Column) -> Column:
    return F.to_json(evidence)
