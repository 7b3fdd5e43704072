"""Reports, rule extraction and text classification plans."""

from vigilframe.plans.sql import op


@op
def a16_robustness(d):
    """Evasion rate of each technique, the highest first."""
    return f"SELECT event_type AS technique, count(*) AS variants, avg(CASE WHEN value > 70 THEN 1.0 ELSE 0.0 END) AS evasion_rate, row_number() OVER (ORDER BY avg(CASE WHEN value > 70 THEN 1.0 ELSE 0.0 END) DESC, event_type) AS place FROM {d.t('events')} GROUP BY event_type"


@op
def a17_red_team(d):
    """Successes by category, and the resilience over all."""
    return f"""SELECT event_type AS category, count(*) AS attacks, count(CASE WHEN value > 90 THEN 1 END) AS successes, avg(value) AS latency, 1.0 - (SELECT count(CASE WHEN value > 90 THEN 1 END) / CAST(count(*) AS DOUBLE) FROM {d.t('events')}) AS resilience
        FROM {d.t('events')} GROUP BY event_type"""


@op
def a25_session_rollup(d):
    """A session's calls, distinct tools, worst risk, duration and calls a minute."""
    return f"""SELECT user_id, n, tools, worst, (last_us - first_us) / 1000000.0 AS seconds, CASE WHEN last_us > first_us THEN n * 60000000.0 / (last_us - first_us) ELSE 0.0 END AS per_minute FROM (
        SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS tools, max(value) AS worst, min({d.us('ts')}) AS first_us, max({d.us('ts')}) AS last_us FROM {d.t('events')} GROUP BY user_id) x"""


@op
def a29_probe_report(d):
    """Pass rates by category and difficulty, and over all."""
    return f"SELECT event_type, CAST(event_id % 3 AS BIGINT) AS difficulty, count(*) AS probes, avg(CASE WHEN value <= 50 THEN 1.0 ELSE 0.0 END) AS pass_rate FROM {d.t('events')} GROUP BY GROUPING SETS ((event_type, CAST(event_id % 3 AS BIGINT)), (event_type), ())"


@op
def f10_watermark(d):
    """burstiness and seed words of longer texts, weighed into one score."""
    return f"""SELECT doc_id, seeds / CAST(n AS DOUBLE) AS seed_share, 0.4 * (CASE WHEN 10 * seeds > 3 * n THEN 1 ELSE 0 END) + 0.2 * (CASE WHEN kinds BETWEEN 0.4 * n AND 0.8 * n THEN 1 ELSE 0 END) > 0.3 AS marked
        FROM (SELECT doc_id, {d.size('ws')} AS n, {d.size(d.distinct('ws'))} AS kinds, {d.size(d.filter('ws', 'x', "x IN ('the', 'of', 'and', 'to', 'in')"))} AS seeds FROM (SELECT doc_id, {d.all('lower(text)', '[a-z]+')} AS ws FROM {d.t('documents')}) a) b WHERE n >= 50"""


@op
def f14_truncate(d):
    """the longest prefix within 100 tokens of four characters, cut at a blank."""
    return f"SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE {d.rep('substr(text, 1, 400)', ' [^ ]*$', '')} END AS kept FROM {d.t('documents')}"


@op
def f25_claims(d):
    """sentences of each benchmark passage typed by their words."""
    return f"""SELECT item_id, s, CASE WHEN {d.rx('sentence', '[0-9]')} THEN 'statistical' WHEN {d.rx('lower(sentence)', ' (is|are|was|est|ist|es) ')} THEN 'factual' ELSE 'opinion' END AS kind FROM (SELECT item_id, s, {d.at('all_s', 's')} AS sentence FROM (
        SELECT item_id, all_s, {d.explode(d.seq('1', d.size('all_s')))} AS s FROM (SELECT item_id, {d.all('text', '[^.!?]+')} AS all_s FROM {d.t('benchmark')}) a) b) c"""


@op
def f26_instructions(d):
    """sentences of system turns as instructions with a type, each depending on the one before."""
    return f"""SELECT conv_id, s, CASE WHEN {d.rx('lower(sentence)', '^ *(in|on|to|the) ')} THEN 'constraint' WHEN length(sentence) > 60 THEN 'task' ELSE 'note' END AS kind, CASE WHEN s > 1 THEN s - 1 END AS depends_on FROM (SELECT conv_id, s, {d.at('all_s', 's')} AS sentence FROM (
        SELECT conv_id, all_s, {d.explode(d.seq('1', d.size('all_s')))} AS s FROM (SELECT conv_id, {d.all('text', '[^.!?]+')} AS all_s FROM {d.t('conversations')} WHERE role = 'system') a) b) c"""


@op
def j21_conflicting_sentences(d):
    """Sentences of one turn that share at least half of their words."""
    s = f"""(SELECT conv_id, turn, s, {d.distinct(d.all('lower(sentence)', '[a-z]+'))} AS ws FROM (SELECT conv_id, turn, s, {d.at('all_s', 's')} AS sentence FROM (SELECT conv_id, turn, all_s, {d.explode(d.seq('1', d.size('all_s')))} AS s
        FROM (SELECT conv_id, turn, {d.all('text', '[^.!?]+')} AS all_s FROM {d.t('conversations')}) a) b) c)"""
    return f"SELECT x.conv_id, x.turn, x.s AS first_s, y.s AS second_s FROM {s} x JOIN {s} y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.s < y.s WHERE {d.size('x.ws')} >= 3 AND {d.size('y.ws')} >= 3 AND 2 * {d.inter('x.ws', 'y.ws')} >= least({d.size('x.ws')}, {d.size('y.ws')})"


@op
def sc30_instruction_lines(d):
    """SC30, SC31: lines of instruction files that match a rule, with their number; each rule once for a line."""
    return f"""SELECT page_id, n, CASE WHEN {d.rx('line', '<script')} THEN 'script' WHEN {d.rx('line', '<a ')} THEN 'link' ELSE 'text' END AS rule FROM (SELECT page_id, n, {d.at('ls', 'n')} AS line FROM (SELECT page_id, ls, {d.explode(d.seq('1', d.size('ls')))} AS n
        FROM (SELECT page_id, {d.all('html', '[^\\n]+')} AS ls FROM {d.t('pages')}) a) b) c WHERE {d.rx('line', '<script|<a ')}"""


@op
def sc32_rule_enforcement(d):
    """SC32: calls against blocked tools and patterns; a warning doesn't block."""
    return f"""SELECT e.event_id, count(CASE WHEN r.kind = 'block' THEN 1 END) AS violations, count(CASE WHEN r.kind = 'warn' THEN 1 END) AS warnings, count(CASE WHEN r.kind = 'block' THEN 1 END) = 0 AS allowed
        FROM {d.t('events')} e JOIN (VALUES ('block', 'LOGOUT', 90.0), ('warn', 'click', 50.0), ('block', 'purchase', 95.0)) AS r(kind, tool, least_value) ON lower(r.tool) = e.event_type AND e.value > r.least_value GROUP BY e.event_id"""
