"""Policies, permissions, compliance and lineage over tables of the caller's: votes, checks, findings, tool calls, rules.

Every plan names its input tables; plans/inputs.py makes them from the test tables. Rule lists, weights and thresholds are
parameters."""

from vigilframe.operators import detectors  # noqa: F401  registers texts
from vigilframe.plans import inputs  # noqa: F401  registers the inputs
from vigilframe.plans.sql import op

SEVERITIES = ("allow", "warn", "redact", "escalate", "block")
#: What a finding takes off its dimension.
PENALTIES = {"info": 0.0, "low": 0.05, "medium": 0.1, "high": 0.2, "critical": 0.4}


def case(x, table, default):
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


def grade(x, steps=((0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D"))):
    return "CASE " + " ".join(f"WHEN {x} >= {least} THEN '{name}'" for least, name in steps) + " ELSE 'F' END"


@op
def g6_ensemble_vote(d, fraction=0.6):
    """Majority, weighted, unanimous and fractional verdicts of several checkers on an item; the mean confidence of the
    majority's side."""
    return f"""SELECT item, votes, 2 * ayes > votes AS majority, weight > 0.0000001 AS weighted, ayes = votes AS unanimous, ayes >= {fraction} * votes AS by_fraction, {d.r4('CASE WHEN 2 * ayes > votes THEN coalesce(for_, 0.0) ELSE coalesce(against, 0.0) END')} AS confidence
        FROM (SELECT item, count(*) AS votes, count(CASE WHEN safe THEN 1 END) AS ayes, sum(CASE WHEN safe THEN confidence ELSE -confidence END) AS weight, avg(CASE WHEN safe THEN confidence END) AS for_, avg(CASE WHEN NOT safe THEN confidence END) AS against
        FROM {d.t('votes')} v GROUP BY item) x"""


@op
def g7_safety_score(d):
    """100 less the weighted risk of a subject's checks, cut to whole points, with a grade."""
    return f"""SELECT subject, score, {grade('score', ((90, 'A'), (80, 'B'), (70, 'C'), (60, 'D')))} AS grade FROM (SELECT subject, CAST(floor(100.0 * (1.0 - sum(weight * risk) / sum(weight)) + 0.0000001) AS BIGINT) AS score FROM {d.t('checks')} c GROUP BY subject) x"""


@op
def g8_scorecard(d, penalties=PENALTIES, weights=None, least=0.7):
    """A dimension has 1 less the penalty of each finding, 0 at least; the scorecard is their weighted mean."""
    weight = case("dimension", {k: float(v) for k, v in weights.items()}, 1.0) if weights else "1.0"
    return f"""SELECT subject, version, overall, {grade('overall')} AS grade, overall >= {least} AS passed, findings, critical FROM (SELECT subject, version, {d.r4(f'sum({weight} * score) / sum({weight})')} AS overall, CAST(sum(n) AS BIGINT) AS findings, CAST(sum(critical) AS BIGINT) AS critical FROM (
        SELECT subject, version, dimension, greatest(0.0, 1.0 - {d.r4(f"sum({case('severity', penalties, 0.0)})")}) AS score, count(*) AS n, count(CASE WHEN severity = 'critical' THEN 1 END) AS critical FROM {d.t('findings')} f GROUP BY subject, version, dimension) x GROUP BY subject, version) y"""


@op
def g8_scorecard_change(d, old=0, new=1):
    """Findings that only the new version of a subject has, and those that only the old one had."""
    one = lambda v: f"(SELECT DISTINCT subject, dimension, severity, what FROM {d.t('findings')} f WHERE version = {v})"
    same = "a.subject = b.subject AND a.dimension = b.dimension AND a.severity = b.severity AND a.what = b.what"
    return f"""SELECT coalesce(a.subject, b.subject) AS subject, count(CASE WHEN a.subject IS NULL THEN 1 END) AS new_findings, count(CASE WHEN b.subject IS NULL THEN 1 END) AS resolved_findings
        FROM {one(old)} a FULL OUTER JOIN {one(new)} b ON {same} GROUP BY coalesce(a.subject, b.subject)"""


#: tier, least score, priority.
TIERS = (("strict", 0.6, 30), ("review", 0.3, 20), ("normal", 0.1, 10), ("fast", 0.0, 0))


@op
def g9_route(d, tiers=TIERS, default="none"):
    """The tier of the first rule that matches, by priority, then as listed."""
    order = sorted(tiers, key=lambda r: -r[2])
    return f"SELECT request, CASE {' '.join(f"WHEN score >= {least} THEN '{tier}'" for tier, least, _ in order)} ELSE '{default}' END AS tier FROM {d.t('requests')} r"


#: name, kind of condition, argument, action, priority, enabled.
RULES = (
    ("secrets", "regex", r"(?i)\b(?:token|password)\s*[:=]", "block", 40, True), ("mail", "contains", "@", "redact", 30, True), ("long", "length_gt", 4000, "warn", 20, True),
    ("short", "length_lt", 20, "escalate", 10, True), ("common", "contains", "the", "block", 50, False),
)


def condition(d, kind, arg, x="text"):
    return {"contains": f"contains(lower({x}), {d.lit(str(arg).lower())})", "regex": d.rx(x, str(arg)), "length_gt": f"length({x}) > {arg}", "length_lt": f"length({x}) < {arg}"}[kind]


@op
def g10_policy_engine(d, rules=RULES):
    """Of the enabled rules that a text meets, the most severe action wins (the higher priority, if equal), and allows
    the text up to a warning."""
    rules = sorted((r for r in rules if r[5]), key=lambda r: (-SEVERITIES.index(r[3]), -r[4]))
    hits = d.arr(*[f"CASE WHEN {condition(d, kind, arg)} THEN {k} ELSE 0 END" for k, (_, kind, arg, *_) in enumerate(rules, 1)])
    pick = lambda f: "CASE top " + " ".join(f"WHEN {k} THEN {f(r)}" for k, r in enumerate(rules, 1)) + " END"
    least = d.size(d.filter("h", "x", "x > 0"))
    return f"""SELECT id, matched, CASE WHEN matched = 0 THEN 'allow' ELSE {pick(lambda r: d.lit(r[3]))} END AS action, {pick(lambda r: d.lit(r[0]))} AS rule, matched = 0 OR {pick(lambda r: 'true' if SEVERITIES.index(r[3]) <= 1 else 'false')} AS allowed
        FROM (SELECT id, {least} AS matched, {d.at(d.sort(d.filter('h', 'x', 'x > 0')), '1')} AS top FROM (SELECT id, {hits} AS h FROM {d.t('texts')} a) b) c"""


@op
def g11_safety_policy(d, rules=RULES, modes=("enforce", "audit", "permissive")):
    """Violations of a text under each mode; only enforcing blocks, and a permissive policy doesn't even warn."""
    n = " + ".join(f"CASE WHEN {condition(d, kind, arg)} THEN 1 ELSE 0 END" for _, kind, arg, *_, on in rules if on)
    return f"""SELECT id, m.mode AS mode, n AS violations, m.mode <> 'enforce' AS allowed, m.mode <> 'permissive' AS reported FROM (SELECT id, {n} AS n FROM {d.t('texts')} a) x CROSS JOIN {d.values([(m,) for m in modes], 'm', 'mode')} WHERE n > 0"""


@op
def g12_compose(d):
    """Of the rules of several policies under one name the one with the highest priority, then the most severe action,
    wins; a conflict if their actions differ."""
    rank = case("action", {a: k for k, a in enumerate(SEVERITIES)}, -1)
    return f"""SELECT name, policy, action, priority, conflict FROM (SELECT name, policy, action, priority, row_number() OVER (PARTITION BY name ORDER BY priority DESC, {rank} DESC, policy) AS place,
        min(action) OVER (PARTITION BY name) <> max(action) OVER (PARTITION BY name) AS conflict FROM {d.t('policy_rules')} r) x WHERE place = 1"""


@op
def g12_policy_diff(d, old="p0", new="p1"):
    """Rules that only one of two policies has, and those that differ in action or priority."""
    one = lambda p: f"(SELECT name, max(action) AS action, max(priority) AS priority FROM {d.t('policy_rules')} r WHERE policy = {d.lit(p)} GROUP BY name)"
    return f"""SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {one(old)} a FULL OUTER JOIN {one(new)} b ON a.name = b.name
        WHERE a.name IS NULL OR b.name IS NULL OR a.action <> b.action OR a.priority <> b.priority"""


#: Firewall rules in order: name, what it does (transform, flag, block), pattern, replacement.
FIREWALL = (("mail", "transform", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[MAIL]"), ("override", "block", r"(?i)ignore (?:all )?(?:previous|prior)", ""), ("masked", "flag", r"\[MAIL\]", ""), ("keys", "transform", r"[0-9a-f]{32,}", "[KEY]"), ("harm", "block", r"(?i)\bbomb\b", ""))


@op
def g13_firewall(d, rules=FIREWALL):
    """Rules one after the other; a transform rewrites what later rules see, a block ends the chain."""
    inner, stage, flags = f"SELECT id, text AS t0, CAST(NULL AS {d.s()}) AS b0, 0 AS f0 FROM {d.t('texts')} a", 0, 0
    for name, does, pattern, new in rules:
        hit, k = d.rx(f"t{stage}", pattern), stage
        t, b, f = f"t{k}", f"b{k}", f"f{k}"
        if does == "transform":
            t = f"CASE WHEN b{k} IS NULL THEN {d.rep(t, pattern, new)} ELSE t{k} END"
        elif does == "block":
            b = f"CASE WHEN b{k} IS NULL AND {hit} THEN '{name}' ELSE b{k} END"
        else:
            f = f"f{k} + CASE WHEN b{k} IS NULL AND {hit} THEN 1 ELSE 0 END"
        stage += 1
        inner = f"SELECT id, {t} AS t{stage}, {b} AS b{stage}, {f} AS f{stage} FROM ({inner}) s{k}"
    return f"SELECT id, b{stage} IS NULL AS passed, b{stage} AS blocked_by, f{stage} AS flags, CASE WHEN b{stage} IS NULL THEN t{stage} END AS text FROM ({inner}) z"


@op
def g15_guard_policy(d, denied=("computer",), allowed=None, commands=("rm -rf", "sudo"), patterns=(r"(?i)\bcurl\b.*-d",), limit=15):
    """Calls that a policy refuses: the tool, a part of a command, a pattern, or too many calls of a tool in a session."""
    ordered = "row_number() OVER (PARTITION BY session, tool ORDER BY us, seq)"
    why = f"CASE WHEN tool IN ({', '.join(map(d.lit, denied)) or 'NULL'}) THEN 'denied tool'"
    why += f" WHEN tool NOT IN ({', '.join(map(d.lit, allowed))}) THEN 'tool not allowed'" if allowed else ""
    why += "".join(f" WHEN contains(args, {d.lit(c)}) THEN 'blocked command'" for c in commands) + "".join(f" WHEN {d.rx('args', p)} THEN 'pattern'" for p in patterns)
    return f"SELECT session, seq, tool, why FROM (SELECT session, seq, tool, {why} WHEN nth > {limit} THEN 'rate limit' END AS why FROM (SELECT *, {ordered} AS nth FROM {d.t('tool_calls')} c) x) y WHERE why IS NOT NULL"


#: framework, control, the categories that speak against it.
CONTROLS = (("internal", "input safety", ("prompt_injection",)), ("internal", "privacy", ("pii", "secrets")), ("internal", "conduct", ("toxicity", "harmful_content")), ("external", "privacy", ("pii",)), ("external", "logging", ()))


@op
def g16_compliance(d, controls=CONTROLS):
    """Each control's state from the findings of its categories (none, some, high ones); a framework is as its worst."""
    rows = [(f, c, x) for f, c, cats in controls for x in cats or (None,)]
    state = "CASE worst WHEN 2 THEN 'NON_COMPLIANT' WHEN 1 THEN 'PARTIAL' ELSE 'COMPLIANT' END"
    return f"""SELECT framework, control, findings, {state} AS state, {state.replace('worst', 'max(worst) OVER (PARTITION BY framework)')} AS framework_state FROM (
        SELECT c.framework, c.control, coalesce(CAST(sum(f.n) AS BIGINT), 0) AS findings, CASE WHEN coalesce(max(f.risk), 0) >= 3 THEN 2 WHEN coalesce(max(f.risk), 0) >= 1 THEN 1 ELSE 0 END AS worst
        FROM {d.values(rows, 'c', 'framework', 'control', 'category')} LEFT JOIN (SELECT category, count(*) AS n, max(risk) AS risk FROM {d.t('category_findings')} a GROUP BY category) f ON c.category = f.category GROUP BY c.framework, c.control) x"""


@op
def g17_ledger(d):
    """The score of all evidence of a rule (skips and errors aside; 1 without any) and the pass rate, in percent, of the
    latest of each subject."""
    return f"""SELECT a.rule, a.score, b.pass_rate FROM (SELECT rule, coalesce(avg(CASE status WHEN 'passed' THEN 1.0 WHEN 'failed' THEN 0.0 END), 1.0) AS score FROM {d.t('evidence')} e GROUP BY rule) a
        JOIN (SELECT rule, 100.0 * avg(CASE WHEN status = 'passed' THEN 1.0 ELSE 0.0 END) AS pass_rate FROM (SELECT rule, subject, max_by(status, seq) AS status FROM {d.t('evidence')} e GROUP BY rule, subject) x GROUP BY rule) b ON a.rule = b.rule"""


DOMAINS = {"prompt_injection": "Security", "secrets": "Security", "pii": "Privacy", "toxicity": "Conduct", "harmful_content": "Conduct", "hallucination": "Reliability"}


@op
def g18_risk_report(d, domains=DOMAINS):
    """Findings and top risk of each domain, zero where there are none; what belongs to none is Other."""
    names = [(x,) for x in (*dict.fromkeys(domains.values()), "Other")]
    return f"""SELECT n.domain, coalesce(x.findings, 0) AS findings, coalesce(x.risk, 0) AS risk FROM {d.values(names, 'n', 'domain')} LEFT JOIN (SELECT coalesce(m.domain, 'Other') AS domain, count(*) AS findings, max(risk) AS risk
        FROM {d.t('category_findings')} f LEFT JOIN {d.values(list(domains.items()), 'm', 'category', 'domain')} ON f.category = m.category GROUP BY coalesce(m.domain, 'Other')) x ON n.domain = x.domain"""


@op
def g19_explain(d, severe=("high", "critical")):
    """Allow if all checks passed, block if a severe one failed, else flag."""
    bad = f"NOT passed AND severity IN ({', '.join(map(d.lit, severe))})"
    return f"SELECT subject, CASE WHEN bool_and(passed) THEN 'allow' WHEN max(CASE WHEN {bad} THEN 1 ELSE 0 END) = 1 THEN 'block' ELSE 'flag' END AS decision, count(CASE WHEN NOT passed THEN 1 END) AS failed FROM {d.t('check_results')} r GROUP BY subject"


@op
def j14_role_permissions(d, most=64):
    """Permissions of a role and of all roles above it, with the distance; a circle of roles ends after `most` steps
    and gives each permission once."""
    return f"""WITH RECURSIVE up(role, node, depth) AS (SELECT DISTINCT role, role AS node, 0 AS depth FROM (SELECT role FROM {d.t('roles')} r1 UNION SELECT role FROM {d.t('grants')} g1) x
        UNION ALL SELECT up.role, r.parent AS node, up.depth + 1 AS depth FROM up JOIN {d.t('roles')} r ON up.node = r.role WHERE up.depth < {most} AND r.parent <> up.role)
        SELECT up.role, g.permission, min(up.depth) AS depth FROM up JOIN {d.t('grants')} g ON up.node = g.role GROUP BY up.role, g.permission"""


@op
def j15_permissions(d, permissions=(("Read", True), ("Write", True), ("bash", False)), default=False):
    """The calls of each tool, whether it has a permission at all, and whether it may run."""
    return f"""SELECT c.tool, count(*) AS calls, max(CASE WHEN p.tool IS NULL THEN 0 ELSE 1 END) = 1 AS known, max(CASE WHEN coalesce(p.allowed, {str(default).lower()}) THEN 1 ELSE 0 END) = 1 AS allowed
        FROM {d.t('tool_calls')} c LEFT JOIN {d.values([(t, a) for t, a in permissions], 'p', 'tool', 'allowed')} ON c.tool = p.tool GROUP BY c.tool"""


@op
def j16_sensitivity_flows(d):
    """Flows from a more sensitive place to a less sensitive one."""
    return f"SELECT f.src, f.dst, a.sensitivity AS from_level, b.sensitivity AS to_level FROM {d.t('flows')} f JOIN {d.t('places')} a ON f.src = a.name JOIN {d.t('places')} b ON f.dst = b.name WHERE a.sensitivity > b.sensitivity"


@op
def j19_orphans(d):
    """Places that no flow touches."""
    return f"SELECT name FROM {d.t('places')} p WHERE NOT EXISTS (SELECT 1 FROM {d.t('flows')} f WHERE f.src = p.name) AND NOT EXISTS (SELECT 1 FROM {d.t('flows')} g WHERE g.dst = p.name)"


@op
def j20_consent(d, required=("login", "purchase"), now_us=1706400000000000):
    """Required purposes for which a person's latest record is missing, refused or expired."""
    return f"""SELECT u.person, p.purpose, CASE WHEN l.person IS NULL THEN 'missing' WHEN NOT l.granted THEN 'refused' ELSE 'expired' END AS why FROM (SELECT DISTINCT person FROM {d.t('consents')} c0) u CROSS JOIN {d.values([(x,) for x in required], 'p', 'purpose')}
        LEFT JOIN (SELECT person, purpose, max_by(granted, seq) AS granted, max_by(coalesce(expires_us, 9000000000000000000), seq) AS expires_us FROM {d.t('consents')} c1 GROUP BY person, purpose) l ON l.person = u.person AND l.purpose = p.purpose
        WHERE l.person IS NULL OR NOT l.granted OR l.expires_us <= {now_us}"""


@op
def a12_toxicity_confusion(d, words=("idiot", "worthless", "clown", "stupid", "moron", "pathetic", "trash", "loser", "scum", "fool", "hate")):
    """A word rule held against labels."""
    hit = d.rx("lower(text)", f"({'|'.join(words)})")
    return f"""SELECT tp, fp, fn, tn, tp / CAST(greatest(1, tp + fp) AS DOUBLE) AS precision_, tp / CAST(greatest(1, tp + fn) AS DOUBLE) AS recall_ FROM (SELECT count(CASE WHEN hit AND toxic = 1 THEN 1 END) AS tp, count(CASE WHEN hit AND toxic = 0 THEN 1 END) AS fp,
        count(CASE WHEN NOT hit AND toxic = 1 THEN 1 END) AS fn, count(CASE WHEN NOT hit AND toxic = 0 THEN 1 END) AS tn FROM (SELECT {hit} AS hit, toxic FROM {d.t('documents')} x JOIN {d.t('labels')} y ON x.doc_id = y.doc_id) z) c"""


@op
def a28_trace_totals(d):
    """Spans below each root and below each parent, the time of the root, and the sum of its direct children's."""
    return f"""SELECT r.trace, count(c.span) AS spans, count(CASE WHEN c.parent = r.span THEN 1 END) AS children, max(r.stop_at - r.start_at) AS duration, coalesce(sum(CASE WHEN c.parent = r.span THEN c.stop_at - c.start_at END), 0.0) AS child_time
        FROM (SELECT * FROM {d.t('spans')} s0 WHERE parent IS NULL) r LEFT JOIN (SELECT * FROM {d.t('spans')} s1 WHERE parent IS NOT NULL) c ON r.trace = c.trace GROUP BY r.trace"""


#: setting, kind of check, argument, severity.
SETTING_RULES = (("name", "required", None, "error"), ("name", "pattern", "^Supplier", "error"), ("balance", "least", 0, "warning"), ("balance", "most", 9000, "warning"), ("debug", "absent", None, "error"), ("mode", "required", None, "warning"))


@op
def sc56_config_checks(d, rules=SETTING_RULES):
    """SC56: rules over a subject's settings; the share that pass, and whether no error is left."""

    def ok(setting, kind, arg):
        v = f"max(CASE WHEN setting = '{setting}' THEN value END)"
        return {
            "required": f"{v} IS NOT NULL", "absent": f"{v} IS NULL", "pattern": f"coalesce({d.rx(v, str(arg))}, false)",
            "least": f"coalesce(CAST({v} AS DOUBLE) >= {arg}, false)", "most": f"coalesce(CAST({v} AS DOUBLE) <= {arg}, false)",
        }[kind]

    good = [f"CASE WHEN {ok(s, k, a)} THEN 1 ELSE 0 END" for s, k, a, _ in rules]
    errors = [x for x, r in zip(good, rules) if r[3] == "error"]
    return f"SELECT subject, ({' + '.join(good)}) / {float(len(rules))} AS score, {' + '.join(errors)} = {len(errors)} AS safe FROM {d.t('settings')} s GROUP BY subject"


@op
def sc57_project_score(d, weights=(("critical", 15), ("high", 10), ("medium", 5), ("low", 2))):
    """SC57, A19: 100 less the weight of every finding of a project, 0 at least."""
    return f"SELECT subject, greatest(0, 100 - CAST(sum({case('severity', dict(weights), 0)}) AS BIGINT)) AS score, count(*) AS findings FROM {d.t('findings')} f GROUP BY subject"


#: Stages of an attack in the order in which a call is classified; the first of a stage's patterns that is found decides.
STAGES = {
    "destruction": (r"(?i)\brm\s+(-[a-zA-Z]*[rf]|--force|--recursive)", r"(?i)\bgit\s+reset\s+--hard", r"(?i)\bdrop\s+(table|database)\b", r"(?i)\btruncate\s+table\b", r"(?i)\bmkfs\.", r"(?i)\bdd\s+.*of="),
    "exfiltration": (r"(?i)\bcurl\s.*(-d|--data|POST|PUT)", r"(?i)\bwget\s.*--post", r"(?i)\bscp\s+.*@", r"(?i)\bnc\s+-", r"(?i)\brsync\s+.*@", r"(?i)>\s*/dev/tcp/", r"(?i)\bbase64\s", r"(?i)\bpython.*requests\.post\b"),
    "persistence": (r"(?i)\.bashrc|\.bash_profile|\.zshrc", r"(?i)crontab\s+", r"(?i)/etc/cron", r"(?i)\.ssh/authorized_keys", r"(?i)systemctl\s+(enable|start)"),
    "privilege_escalation": (r"(?i)\bsudo\b", r"(?i)\bsu\s+-", r"(?i)\bchmod\s+[0-7]*7", r"(?i)/etc/sudoers", r"(?i)\bchown\b.*root", r"(?i)\bgit\s+push\s+.*--force", r"(?i)--no-verify\b"),
    "credential_access": (r"\.env\b", r"\.ssh/(id_rsa|authorized_keys|config)", r"\.aws/(credentials|config)", r"\.npmrc\b", r"\.pypirc\b", r"\.netrc\b", r"\.gitconfig\b", r"credentials\.json", r"(?i)(api[_-]?key|secret|token|password)\s*[=:]", r"\.kube/config"),
    "reconnaissance": (r"(?i)/etc/(passwd|shadow|hosts|resolv\.conf)", r"(?i)\b(whoami|id|uname|hostname|ifconfig|ip\s+addr)", r"(?i)\b(ps\s+aux|netstat|ss\s+-)", r"(?i)\bfind\s+/\s+", r"(?i)\bls\s+(-la|/root|/home)", r"(?i)\bcat\s+/proc/"),
}
POISON = (r"(?i)(CLAUDE|claude)\.md", r"(?i)\.claude/", r"(?i)system\s*prompt", r"(?i)(ignore|override)\s+(all\s+)?(previous|prior|system)")
WRITERS, RUNNERS = ("write_file", "Write", "Edit", "NotebookEdit", "tee"), ("bash", "Bash", "terminal", "shell", "execute")
READERS = ("read_file", "Read", "cat", "head", "tail", "less", "more")
#: name, severity (4 critical, 3 high), confidence, stages.
CHAINS = (
    ("recon_credential_exfiltrate", 4, 0.95, ("reconnaissance", "credential_access", "exfiltration")), ("credential_exfiltrate", 4, 0.9, ("credential_access", "exfiltration")),
    ("escalate_destroy", 4, 0.9, ("privilege_escalation", "destruction")), ("poison_escalate", 3, 0.85, ("context_poisoning", "privilege_escalation")),
    ("recon_escalate_persist", 4, 0.9, ("reconnaissance", "privilege_escalation", "persistence")), ("poison_credential_exfiltrate", 4, 0.95, ("context_poisoning", "credential_access", "exfiltration")),
)
def values_of(d, x):
    """The string values of a JSON text in order, joined by blanks; escaped quotes and backslashes undone. A key is followed
    by a colon, a value is not."""
    bare = d.rep(d.rep("v", r'^"', ""), r'"\s*[,}\]]$', "")
    plain = f"""replace(replace({bare}, '{chr(92) * (4 if d.t('x') != 'x' else 2)}', '{chr(92) * (2 if d.t('x') != 'x' else 1)}'), '{chr(92) * (2 if d.t('x') != 'x' else 1)}"', '"')"""
    return d.join(d.map(d.all0(x, d.string + r'\s*[,}\]]'), "v", plain), " ")


def staged(d, stages=STAGES):
    """Tool calls with the text of their arguments and the stage that it speaks of."""
    any_ = lambda ps: "(" + " OR ".join(d.rx("said", p) for p in ps) + ")"
    tools = ", ".join(map(d.lit, WRITERS + RUNNERS))
    stage = f"CASE WHEN tool IN ({tools}) AND {any_(POISON)} THEN 'context_poisoning' " + " ".join(f"WHEN {any_(ps)} THEN '{k}'" for k, ps in stages.items()) + " END"
    return f"(SELECT session, seq, us, tool, said, {stage} AS stage FROM (SELECT session, seq, us, tool, {values_of(d, 'args')} AS said FROM {d.t('tool_calls')} t0) t1)"


@op
def w27_stages(d, stages=STAGES):
    """The stage of every tool call that speaks of one."""
    return f"SELECT session, seq, stage FROM {staged(d, stages)} s WHERE stage IS NOT NULL"


@op
def w27_attack_chains(d, chains=CHAINS, seconds=300):
    """Chains whose stages are all there within the window, in whatever order; each once for a session, when first
    complete."""
    names = tuple(dict.fromkeys(s for *_, ss in chains for s in ss))
    seen = ", ".join(f"max(CASE WHEN stage = '{k}' THEN 1 ELSE 0 END) OVER w AS {k}" for k in names)
    done = d.filter(d.arr(*[f"CASE WHEN {' AND '.join(f'{s} = 1' for s in ss)} THEN '{n}' ELSE '' END" for n, *_, ss in chains]), "x", "x <> ''")
    return f"""SELECT session, c.chain, first_us, facts.severity, facts.confidence FROM (SELECT session, chain, min(us) AS first_us FROM (SELECT session, us, {d.explode('done')} AS chain FROM (SELECT session, us, {done} AS done FROM (
        SELECT session, us, {seen} FROM {staged(d)} s WHERE stage IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY us RANGE BETWEEN {seconds * 1000000} PRECEDING AND CURRENT ROW)) x) y) z GROUP BY session, chain) c
        JOIN {d.values([(n, s, c) for n, s, c, _ in chains], 'facts', 'chain', 'severity', 'confidence')} ON c.chain = facts.chain"""


@op
def w25_write_spikes(d, writes=20, seconds=60, writers=WRITERS):
    """Writes that are at least the twentieth of their session within a minute."""
    return f"""SELECT session, seq, n FROM (SELECT session, seq, count(*) OVER (PARTITION BY session ORDER BY us RANGE BETWEEN {seconds * 1000000 - 1} PRECEDING AND CURRENT ROW) AS n
        FROM {d.t('tool_calls')} c WHERE tool IN ({', '.join(map(d.lit, writers))})) x WHERE n >= {writes}"""


@op
def w26_read_then_send(d, last=50):
    """A call that sends data out after a sensitive file was among the last reads of its session."""
    w = "OVER (PARTITION BY session ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    read = f"tool IN ({', '.join(map(d.lit, READERS))})"
    return f"""SELECT session, seq FROM (SELECT session, seq, stage, count(CASE WHEN {read} THEN 1 END) {w} AS reads, max(CASE WHEN {read} AND stage = 'credential_access' THEN nth END) {w} AS sensitive FROM (
        SELECT *, count(CASE WHEN {read} THEN 1 END) OVER (PARTITION BY session ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM {staged(d)} s) x) y WHERE stage = 'exfiltration' AND sensitive > reads - {last}"""


@op
def w28_verify_hash_chain(d):
    """Whether each entry's hash follows from its own fields and the stored hash of the entry before (sixteen zeros at
    the start), and whether the whole session holds."""
    before = "coalesce(lag(entry_hash) OVER (PARTITION BY session ORDER BY seq), '0000000000000000')"
    want = f"substr({d.sha(f"concat_ws(':', ts, entry_id, event_type, tool, risk, {before})")}, 1, 16)"
    return f"SELECT session, seq, valid, min(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY session) = 1 AS intact FROM (SELECT session, seq, entry_hash = {want} AS valid FROM {d.t('audit_entries')} e) x"


#: Tools that run what they are given.
DANGEROUS_TOOLS = ("bash", "shell", "terminal", "execute", "exec", "run_command", "computer", "computer_use", "browser")


@op
def sc8_tool_calls(d, tools=DANGEROUS_TOOLS, rules=None):
    """SC8: a call's name and all its string values, however deep, held against the tool-use rules; calls of a tool that
    runs commands with anything to run are flagged as such."""
    from vigilframe.plans.rules import TOOL_USE

    rules = [r for r in rules or TOOL_USE if "(?!" not in r.pattern]
    shell = f"lower(tool) IN ({', '.join(map(d.lit, tools))}) AND said <> ''"
    names = d.filter(d.arr(*[f"CASE WHEN {d.rx('whole', r.pattern)} THEN {k} ELSE -1 END" for k, r in enumerate(rules)], f"CASE WHEN {shell} THEN {len(rules)} ELSE -1 END"), "x", "x >= 0")
    facts = d.values([(k, r.name, r.risk) for k, r in enumerate(rules)] + [(len(rules), "shell_execution", 2)], "f", "i", "finding", "risk")
    return f"""SELECT session, seq, finding, risk FROM (SELECT session, seq, {d.explode('names')} AS i FROM (SELECT session, seq, {names} AS names FROM (SELECT session, seq, tool, said, concat(tool, ' ', said) AS whole
        FROM (SELECT session, seq, tool, {values_of(d, 'args')} AS said FROM {d.t('tool_calls')} t0) t1) t2) t3) h JOIN {facts} ON h.i = f.i"""
