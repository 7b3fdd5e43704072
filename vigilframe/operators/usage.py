"""Usage, latency, cost and anomaly plans over event logs. Each names the operator of the inventory that it covers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.plans.shared import ensure_checkpoints
from vigilframe.plans.sql import op


@op
def a1_counts_by_key(d):
    """A1: counts by several keys at once."""
    return f"SELECT event_type, CAST(user_id % 10 AS BIGINT) AS user_group, count(*) AS n FROM {d.t('events')} GROUP BY GROUPING SETS ((event_type), (CAST(user_id % 10 AS BIGINT)), ())"


@op
def a2_percentages(d):
    return f"SELECT event_type, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM {d.t('events')} GROUP BY event_type"


@op
def a3_rates(d):
    """A3: share of flagged events of each user; 0 where there are none."""
    return f"SELECT user_id, count(*) AS n, coalesce(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 0.0) AS flag_rate FROM {d.t('events')} GROUP BY user_id"


@op
def a4_unique_prompts(d):
    return f"SELECT lang, count(*) AS n, count(DISTINCT substr({d.sha('text')}, 1, 12)) AS unique_texts FROM {d.t('documents')} GROUP BY lang"


@op
def a5_latency_report(d):
    """A5: interpolated percentiles, population deviation, SLA violations."""
    return f"""SELECT event_type AS operation, count(*) AS n, min(value) AS least, max(value) AS most, avg(value) AS mean, stddev_pop(value) AS deviation,
        {d.pct('value', 0.5)} AS p50, {d.pct('value', 0.95)} AS p95, {d.pct('value', 0.99)} AS p99, count(CASE WHEN value > 80 THEN 1 END) AS sla_violations
        FROM {d.t('events')} GROUP BY event_type"""


@op
def a6_nearest_rank_p99(d):
    return f"""SELECT event_type, value AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r,
        count(*) OVER (PARTITION BY event_type) AS n FROM {d.t('events')}) x WHERE r = greatest(1, CAST(floor(n * 0.99) AS BIGINT))"""


@op
def a7_cumulative_histogram(d):
    return f"""SELECT event_type, b.le AS le, count(CASE WHEN value <= b.le THEN 1 END) AS n FROM {d.t('events')}
        CROSS JOIN (VALUES (1.0), (5.0), (10.0), (25.0), (50.0), (100.0), (250.0), (500.0), (1000.0)) AS b(le) GROUP BY event_type, b.le"""


@op
def a8_gauges_and_counters(d):
    """Last value (gauge) and number (counter) of each label set."""
    return f"SELECT concat(event_type, ',user_group=', CAST(user_id % 5 AS {d.s()})) AS metric, max_by(value, event_id) AS gauge, count(*) AS counter FROM {d.t('events')} GROUP BY event_type, user_id % 5"


@op
def a9_cost_by_model(d):
    """Tokens priced by a rate table; unknown models cost nothing."""
    return f"""SELECT e.event_type AS model, count(*) AS calls, CAST(sum(CAST(floor(e.value) AS BIGINT)) AS BIGINT) AS tokens, sum(coalesce(CAST(floor(e.value) AS BIGINT) / 1000.0 * p.rate, 0)) AS cost
        FROM {d.t('events')} e LEFT JOIN (VALUES ('click', 0.5), ('view', 0.25), ('purchase', 2.0)) AS p(model, rate) ON e.event_type = p.model GROUP BY e.event_type"""


@op
def a9_budget_left(d):
    return f"""SELECT user_id, sum(value) AS spent, greatest(0.0, 3000.0 - sum(value)) AS remaining, sum(value) / 3000.0 AS utilisation, sum(value) > 3000.0 AS over FROM {d.t('events')} GROUP BY user_id"""


@op
def a13_variant_agreement(d):
    """Texts whose variants all get the same verdict, and each variant's block rate."""
    return f"""SELECT o_orderpriority AS variant, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) AS block_rate,
        (SELECT avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) FROM (SELECT o_custkey, count(DISTINCT o_totalprice > 150000) AS n FROM {d.t('orders')} GROUP BY o_custkey) x) AS agreement
        FROM {d.t('orders')} GROUP BY o_orderpriority"""


@op
def a14_bandit_arms(d):
    """Pulls, reward, Beta parameters and the best arm (the first by name on ties)."""
    return f"""SELECT arm, pulls, reward, reward / pulls AS average, 1 + wins AS alpha, 1 + pulls - wins AS beta, row_number() OVER (ORDER BY reward / pulls DESC, arm) = 1 AS best
        FROM (SELECT event_type AS arm, count(*) AS pulls, sum(value) AS reward, count(CASE WHEN value > 50 THEN 1 END) AS wins FROM {d.t('events')} GROUP BY event_type) x"""


@op
def a18_risk_matrix(d):
    """Severity by category, zero-filled."""
    cells = ", ".join(f"count(CASE WHEN o_orderstatus = '{s}' THEN 1 END) AS status_{s.lower()}" for s in "FOP")
    return f"SELECT o_orderpriority AS severity, {cells}, count(*) AS total FROM {d.t('orders')} GROUP BY o_orderpriority"


@op
def a20_feedback_by_label(d):
    return f"""SELECT label, count(*) AS n, avg(rating) AS average, avg(CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END) AS positive
        FROM (SELECT {d.explode(d.arr("event_type", "CASE WHEN value > 50 THEN 'high' ELSE 'low' END"))} AS label, CAST(event_id % 5 + 1 AS BIGINT) AS rating FROM {d.t('events')}) x GROUP BY label"""


@op
def a21_mean_time_to_resolve(d):
    return f"""SELECT l_returnflag AS state, count(*) AS n, avg(({d.us('l_shipdate')} - {d.us('o_orderdate')}) / 1000000.0) AS seconds
        FROM {d.t('lineitem')} JOIN {d.t('orders')} ON l_orderkey = o_orderkey GROUP BY l_returnflag"""


@op
def a22_top_labels(d):
    """Most common, the first seen first on ties."""
    return f"SELECT user_id, n FROM (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS r FROM {d.t('events')} GROUP BY user_id) x WHERE r <= 10"


@op
def a26_cache_statistics(d):
    """An access is a hit if the key was seen in the last day."""
    return f"""SELECT count(*) AS lookups, count(CASE WHEN age <= 86400000000 THEN 1 END) AS hits, count(CASE WHEN age > 86400000000 THEN 1 END) AS expired, count(CASE WHEN age IS NULL THEN 1 END) AS misses
        FROM (SELECT {d.us('ts')} - lag({d.us('ts')}) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS age FROM {d.t('events')}) x"""


@op
def w1_rate_zscore(d):
    """Last interval of each user against the last 100 events, sample deviation, at least three intervals."""
    return f"""WITH g AS (SELECT user_id, event_id, ts, ({d.us('ts')} - lag({d.us('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0 AS gap,
            row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM {d.t('events')}),
        s AS (SELECT user_id, count(gap) AS n, avg(gap) AS mean, stddev_samp(gap) AS dev, max(CASE WHEN back = 1 THEN gap END) AS last_gap FROM g WHERE back <= 99 GROUP BY user_id)
        SELECT user_id, n, CASE WHEN dev > 0 THEN (mean - last_gap) / dev ELSE 0.0 END AS z, CASE WHEN dev > 0 AND (mean - last_gap) / dev > 3 THEN 'flag' ELSE 'ok' END AS verdict FROM s WHERE n >= 3"""


@op
def w2_volume_zscore(d):
    return f"""WITH g AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM {d.t('events')} WHERE value > 0),
        s AS (SELECT user_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS dev, max(CASE WHEN back = 1 THEN value END) AS last_value FROM g WHERE back <= 100 GROUP BY user_id)
        SELECT user_id, n, CASE WHEN dev > 0 THEN (last_value - mean) / dev ELSE 0.0 END AS z FROM s WHERE n >= 3"""


@op
def w3_bursts(d):
    """W3, W25, ST3: events of the user in the hour before each."""
    return f"""SELECT event_id, user_id, n, CASE WHEN n > 5 THEN 'high' WHEN n > 2 THEN 'burst' ELSE 'ok' END AS verdict FROM (SELECT event_id, user_id,
        count(*) OVER (PARTITION BY user_id ORDER BY {d.us('ts')} RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM {d.t('events')}) x WHERE n > 1"""


@op
def w4_length_anomalies(d):
    """More than two population deviations from the mean of the source."""
    return f"""SELECT doc_id, source, n_chars, (n_chars - mean) / dev AS z FROM (SELECT doc_id, source, n_chars, avg(n_chars) OVER (PARTITION BY source) AS mean,
        stddev_pop(n_chars) OVER (PARTITION BY source) AS dev FROM {d.t('documents')}) x WHERE dev > 0 AND abs(n_chars - mean) / dev > 2"""


@op
def w5_half_split_trend(d):
    return f"""SELECT user_id, first_half, second_half, CASE WHEN second_half - first_half > 5 THEN 'rising' WHEN first_half - second_half > 5 THEN 'falling' ELSE 'stable' END AS trend FROM (
        SELECT user_id, avg(CASE WHEN r <= floor(n / 2) THEN value END) AS first_half, avg(CASE WHEN r > floor(n / 2) THEN value END) AS second_half FROM (
        SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM {d.t('events')}) x GROUP BY user_id) y"""


@op
def w6_time_half_trend(d):
    """Severity sums on either side of the middle of the whole span."""
    return f"""WITH m AS (SELECT (min({d.us('ts')}) + max({d.us('ts')})) / 2.0 AS mid FROM {d.t('events')})
        SELECT event_type, count(CASE WHEN {d.us('ts')} < mid THEN 1 END) AS before_mid, count(CASE WHEN {d.us('ts')} >= mid THEN 1 END) AS after_mid FROM {d.t('events')} CROSS JOIN m GROUP BY event_type"""


@op
def w7_token_spikes(d):
    """More than three times the mean of the fifty before, the event itself excluded."""
    return f"""SELECT event_id, user_id, value, before FROM (SELECT event_id, user_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS before
        FROM {d.t('events')}) x WHERE value > 3 * coalesce(before, 0)"""


@op
def w8_embedding_drift(d):
    """Cosine with the vector before, within a label; the first is 1."""
    return f"""SELECT vec_id, label, coalesce(round({d.dot('embedding', 'before')} / sqrt({d.dot('embedding', 'embedding')} * {d.dot('before', 'before')}), 6), 1.0) AS similarity
        FROM (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM {d.t('embeddings')}) x"""


@op
def embedding_validation(d):
    """Six checks of a vector; the score is the share that pass."""
    n = d.size("embedding")
    return f"""SELECT vec_id, {n} = 64 AS right_size, m > 0 AS not_zero, m BETWEEN 0.01 AND 100.0 AS in_bounds, zeros < 0.5 * {n} AS dense, kinds > 1 AS varied,
        ((CASE WHEN {n} = 64 THEN 1 ELSE 0 END) + 1 + (CASE WHEN m > 0 THEN 1 ELSE 0 END) + (CASE WHEN m BETWEEN 0.01 AND 100.0 THEN 1 ELSE 0 END) + (CASE WHEN zeros < 0.5 * {n} THEN 1 ELSE 0 END) + (CASE WHEN kinds > 1 THEN 1 ELSE 0 END)) / 6.0 AS score
        FROM (SELECT vec_id, embedding, sqrt({d.dot('embedding', 'embedding')}) AS m, {d.size(d.filter('embedding', 'e', 'e = 0'))} AS zeros, {d.size(d.distinct('embedding'))} AS kinds FROM {d.t('embeddings')}) x"""


@op
def w9_risk_escalations(d):
    """Events above everything before them in their session."""
    return f"""SELECT event_id, user_id, value FROM (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
        FROM {d.t('events')}) x WHERE value > top"""


@op
def w24_runaway_loops(d):
    """The last five calls of a session are the same tool."""
    w = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    return f"SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, event_type, min(event_type) {w} AS a, max(event_type) {w} AS b, count(*) {w} AS n FROM {d.t('events')}) x WHERE n = 5 AND a = b"


@op
def w29_recent_entries(d):
    return f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {d.t('events')}) x WHERE r <= 5"


@op
def w30_sliding_quota(d):
    """Requests and tokens in the day before each request, and what is used of the quota."""
    w = f"OVER (PARTITION BY user_id ORDER BY {d.us('ts')} RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)"
    return f"SELECT event_id, user_id, count(*) {w} AS requests, CAST(sum(CAST(floor(value) AS BIGINT)) {w} AS BIGINT) AS tokens, count(*) {w} / 10.0 AS utilisation, count(*) {w} > 10 AS over FROM {d.t('events')}"


@op
def w31_version_chain(d):
    """A version for each change of a prompt; equal neighbours are one."""
    return f"""SELECT user_id, event_id, event_type, count(CASE WHEN before IS NULL OR before <> event_type THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS version
        FROM (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {d.t('events')}) x"""


@op
def w33_best_of_n(d):
    """Weighted score, rank by score, stable."""
    return f"""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY 0.7 * l_quantity - 0.3 * l_tax * 100 DESC, l_linenumber) AS place FROM {d.t('lineitem')}"""


@op
def st7_metric_alerts(d):
    """ST7, ST8 in batch form: the mean of each hour against the rule of its metric, at least two samples."""
    return f"""SELECT m.event_type AS metric, m.hour_us, m.n, m.mean, r.severity FROM (SELECT event_type, {d.us("date_trunc('hour', ts)")} AS hour_us, count(*) AS n, avg(value) AS mean FROM {d.t('events')} GROUP BY event_type, {d.us("date_trunc('hour', ts)")}) m
        JOIN (VALUES ('click', 'above', 70.0, 'high'), ('view', 'below', 10.0, 'low'), ('purchase', 'above', 80.0, 'critical')) AS r(metric, condition, threshold, severity)
        ON m.event_type = r.metric AND ((r.condition = 'above' AND m.mean > r.threshold) OR (r.condition = 'below' AND m.mean < r.threshold)) WHERE m.n >= 2"""


@op
def st10_suppressed_alerts(d):
    """ST10: an alert is muted if its source had one in the six hours before."""
    return f"""SELECT event_id, user_id FROM (SELECT event_id, user_id, {d.us('ts')} - lag({d.us('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM {d.t('events')} WHERE value > 60) x WHERE gap < 21600000000"""


@op
def st11_incident_state(d):
    return f"SELECT user_id AS incident, max_by(event_type, event_id) AS state, min(event_id) AS opened, count(*) AS updates FROM {d.t('events')} GROUP BY user_id"


@op
def t3_priority_queue(d):
    """SNK8, T3: by priority, then by time; entries past three tries are dead letters. The window puts all rows into one
    task; `priority_queue` gives the same result by range partitions, and is what the query runs."""
    return f"SELECT event_id, CAST(event_id % 4 AS BIGINT) AS tries, event_id % 4 > 2 AS dead_letter, row_number() OVER (ORDER BY event_type, ts, event_id) AS place FROM {d.t('events')}"


def priority_queue(events: DataFrame) -> DataFrame:
    """t3_priority_queue over all events: ranges of (event_type, ts, event_id) are ordered on their own, and a place is the
    rows of the ranges before plus the row's place in its own. Needs a checkpoint folder."""
    ensure_checkpoints(events.sparkSession)
    order = ("event_type", "ts", "event_id")
    ranged = events.select("event_id", "event_type", "ts").repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition above 33 bits of the row's number in it; the checkpoint fixes both.
    ranged = ranged.select("event_id", F.monotonically_increasing_id().alias("at")).checkpoint()
    part, before, total = F.shiftright("at", 33), {}, 0
    for p, n in sorted(ranged.groupBy(part).count().collect()):
        before[p], total = total, total + n
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[part] if before else F.lit(0)
    tries = (F.col("event_id") % 4).cast("long")
    return ranged.select("event_id", tries.alias("tries"), (tries > 2).alias("dead_letter"), (offset + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("place"))


@op
def snk6_prometheus(d):
    s = d.s()
    return f"SELECT concat('events_total type=', event_type, ' ', CAST(count(*) AS {s})) AS line FROM {d.t('events')} GROUP BY event_type"


@op
def snk9_subscriptions(d):
    """SNK9, ST12: exact and prefix subscriptions."""
    return f"""SELECT s.pattern, count(*) AS n FROM {d.t('events')} e JOIN (VALUES ('click'), ('p*'), ('*')) AS s(pattern)
        ON e.event_type = s.pattern OR (s.pattern LIKE '%*' AND substr(e.event_type, 1, length(s.pattern) - 1) = substr(s.pattern, 1, length(s.pattern) - 1)) GROUP BY s.pattern"""
