"""Detectors, scorers and classifiers over texts(id, text): tables of patterns, each turned into arrays of hits in one
projection, so that no detector shuffles. Tables, weights and thresholds are parameters; plans/tables.py has the defaults.

A null text counts as empty. Scores are rounded to four places. Where several rows of a table score alike, the first wins.
"""

from pyspark.sql import functions as F

from vigilframe.operators.scanners import spread
from vigilframe.plans import tables as t
from vigilframe.plans.golden import DETECTOR_TEXTS
from vigilframe.plans.sql import MADE, Duck, op

TEXTS = "SELECT doc_id AS id, coalesce(text, '') AS text FROM documents"


def texts(documents):
    golden = documents.sparkSession.createDataFrame(list(DETECTOR_TEXTS), "id long, text string")
    return spread(documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))).unionByName(golden)


MADE["texts"] = ("documents", texts, lambda: f"{TEXTS} UNION ALL SELECT * FROM {Duck().values(DETECTOR_TEXTS, 'golden', 'id', 'text')}")


def hits(d, x, patterns, weights=None):
    """An array with each pattern's weight (1 by default) where it is found, else 0."""
    return d.arr(*[f"CASE WHEN {d.rx(x, p)} THEN {float(w)} ELSE 0.0 END" for p, w in zip(patterns, weights or [1.0] * len(patterns))])


def counts(d, x, patterns):
    """How often the patterns are found, all together."""
    return "(" + " + ".join(d.rxn(x, p) for p in patterns) + ")"


def found(d, x, patterns):
    """How many of the patterns are found."""
    return "(" + " + ".join(f"CASE WHEN {d.rx(x, p)} THEN 1 ELSE 0 END" for p in patterns) + ")"


def of(table, name, place=0, value=1):
    return tuple(r[value] for r in table if r[place] == name)


def kinds(table, place=0):
    return tuple(dict.fromkeys(r[place] for r in table))


def rows_of(d, source, keys, x, patterns, counted=False):
    """keys, i (the pattern's place from 1) and n (1, or how often it is found) for each pattern that is found."""
    if counted:
        cells = [f"CAST({k} AS BIGINT) * 1000000000 + {d.rxn(x, p)}" for k, p in enumerate(patterns, 1)]
    else:
        cells = [f"CAST({k} AS BIGINT) * 1000000000 + CASE WHEN {d.rx(x, p)} THEN 1 ELSE 0 END" for k, p in enumerate(patterns, 1)]
    some = d.filter(d.arr(*cells), "c", "c % 1000000000 > 0")
    return f"(SELECT {keys}, CAST(floor(c / 1000000000) AS INT) AS i, CAST(c % 1000000000 AS BIGINT) AS n FROM (SELECT {keys}, {d.explode(some)} AS c FROM {source}) m0)"


@op
def sc36_fewshot(d, least=2, threshold=0.5):
    """SC36: worked examples, signs of a jailbreak and of escalation, and their joint confidence."""
    return f"""SELECT id, examples, jailbreak, escalation, confidence, confidence >= {threshold} AND (examples >= {least} OR jailbreak >= 2) AS attack FROM (
        SELECT id, examples, jailbreak, escalation, {d.r4(f"least(1.0, CASE WHEN examples >= {least} THEN 0.3 + 0.1 * least(examples, 5) ELSE 0.0 END + 0.2 * least(jailbreak, 3) + 0.1 * least(escalation, 3) + CASE WHEN examples >= {least} AND jailbreak > 0 THEN 0.2 ELSE 0.0 END)")} AS confidence
        FROM (SELECT id, CAST({counts(d, 'text', t.FEWSHOT_ROLES)} + floor({counts(d, 'text', t.FEWSHOT_HALVES)} / 2) AS BIGINT) AS examples, {found(d, 'text', t.FEWSHOT_JAILBREAK)} AS jailbreak,
        {found(d, 'text', t.FEWSHOT_ESCALATION)} AS escalation FROM {d.t('texts')} a) b) c"""


@op
def sc37_prompt_shield(d, table=t.SHIELD, threshold=0.5, longest=10000, special=0.4):
    """SC37: layers of patterns and one of length and special characters; 1.3 times the confidence if three layers are
    hit, 1.1 times if two."""
    layers = kinds(table)
    marks = d.rep("text", r"[\p{L}\p{N} \t\n\r\x0B\x0C]", "")
    odd = f"CASE WHEN length(text) > {longest} OR (length(text) > 0 AND length({marks}) > {special} * length(text)) THEN 0.3 ELSE 0.0 END"
    arrays = ", ".join(f"{hits(d, 'text', of(table, k), of(table, k, value=3))} AS {k}" for k in layers)
    tops = ", ".join(f"{d.lmax(k)} AS top_{k}" for k in layers)
    triggers = " + ".join(f"CASE WHEN top_{k} > 0 THEN 1 ELSE 0 END" for k in layers)
    names = "CASE " + " ".join(f"WHEN top_{k} = top THEN {d.at(d.strings(of(table, k, value=2)), d.pos(k, 'top'))}" for k in layers) + " ELSE 'length_anomaly' END"
    return f"""SELECT id, score >= {threshold} AS blocked, {d.r4('score')} AS risk_score, CASE WHEN score >= {threshold} THEN attack END AS attack, triggers FROM (
        SELECT id, triggers, {names} AS attack, least(1.0, top * CASE WHEN triggers >= 3 THEN 1.3 WHEN triggers = 2 THEN 1.1 ELSE 1.0 END) AS score FROM (
        SELECT *, greatest(odd, {', '.join(f'top_{k}' for k in layers)}) AS top, {triggers} + CASE WHEN odd > 0 THEN 1 ELSE 0 END AS triggers FROM (
        SELECT *, {tops} FROM (SELECT id, {arrays}, {odd} AS odd FROM {d.t('texts')} a) b) c) e) f"""


def _label(x):
    return f"CASE WHEN {x} >= 0.7 THEN 'high' WHEN {x} >= 0.3 THEN 'medium' ELSE 'low' END"


@op
def sc38_injection_score(d, table=t.INJECTION, sensitivity="medium"):
    """SC38: half the weight of all patterns found, 1 at most; the category is that of the weightiest pattern."""
    return f"""SELECT id, {d.r4('score')} AS score, score >= {t.SENSITIVITY[sensitivity]} AS injection, CASE WHEN top > 0 THEN {d.at(d.strings([r[1] for r in table]), d.pos('h', 'top'))} ELSE 'none' END AS category,
        {_label('score')} AS confidence, {d.size(d.filter('h', 'x', 'x > 0'))} AS patterns FROM (SELECT id, h, least({d.lsum('h')} / 2.0, 1.0) AS score, {d.lmax('h')} AS top FROM (
        SELECT id, {hits(d, 'text', [r[0] for r in table], [r[2] for r in table])} AS h FROM {d.t('texts')} a) b) c"""


@op
def sc40_injection_explained(d, table=t.INJECTION, advice=t.ADVICE):
    """SC40: a row for each category found: its patterns, their weight, advice, and the verdict on the whole text."""
    cats = kinds(table, 1)
    arrays = ", ".join(f"{hits(d, 'text', of(table, c, 1, 0), of(table, c, 1, 2))} AS h{k}" for k, c in enumerate(cats))
    some = d.filter(d.arr(*[f"CASE WHEN {d.lmax(f'h{k}')} > 0 THEN {k} ELSE -1 END" for k in range(len(cats))]), "x", "x >= 0")
    pick = lambda e: "CASE i " + " ".join(f"WHEN {k} THEN {e(k, c)}" for k, c in enumerate(cats)) + " END"
    total = " + ".join(d.lsum(f"h{k}") for k in range(len(cats)))
    return f"""SELECT id, {pick(lambda k, c: d.lit(c))} AS layer, {pick(lambda k, c: d.size(d.filter(f'h{k}', 'x', 'x > 0')))} AS patterns, {d.r4(pick(lambda k, c: d.lsum(f'h{k}')))} AS weight,
        {pick(lambda k, c: d.lit(advice.get(c, f"Review and mitigate '{c}' pattern matches.")))} AS recommendation, {d.size('layers')} AS layers, {d.r4('score')} AS score, {_label('score')} AS confidence
        FROM (SELECT *, {d.explode('layers')} AS i FROM (SELECT *, {some} AS layers, least(({total}) / 2.0, 1.0) AS score FROM (SELECT id, {arrays} FROM {d.t('texts')} a) b) c) e"""


@op
def sc39_injection_vectors(d, table=t.VECTORS, threshold=0.4):
    """SC39: five vectors, each its top weight and 0.15 for every pattern (0.4 at most); how the payload is put together."""
    names = kinds(table)
    low, undone = "lower(text)", f"translate(lower(text), '{t.VECTOR_LEET[0]}', '{t.VECTOR_LEET[1]}')"
    leet = [f"CASE WHEN contains({undone}, '{w}') AND NOT contains({low}, '{w}') THEN 0.7 ELSE 0.0 END" for w in t.VECTOR_LEET_WORDS]

    def array(k):
        cells = [f"CASE WHEN {d.rx('text', p)} THEN {w} ELSE 0.0 END" for v, p, w in table if v == k]
        return d.arr(*cells, *(leet if k == "encoding_evasion" else ()))

    arrays = ", ".join(f"{array(k)} AS h_{k}" for k in names)
    score = lambda k: f"CASE WHEN {d.lmax(f'h_{k}')} > 0 THEN least(1.0, {d.lmax(f'h_{k}')} + least(0.15 * {d.size(d.filter(f'h_{k}', 'x', 'x > 0'))}, 0.4)) ELSE 0.0 END AS {k}"
    every = d.arr(*names)
    some = d.filter("v", "x", "x > 0")
    return f"""SELECT id, {', '.join(d.r4(k) + ' AS ' + k for k in names)}, overall, overall >= {threshold} AS injection, CASE WHEN overall >= 0.7 THEN 'high' WHEN overall >= 0.4 THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN overall > 0.7 THEN 'block' WHEN overall > {threshold} THEN 'review' ELSE 'allow' END AS recommendation, boundaries, encodings, greatest(2 * runs - open - 1, 0) AS language_switches FROM (
        SELECT *, CASE WHEN {d.size(some)} = 0 THEN 0.0 ELSE {d.r4(f"least(1.0, 0.6 * {d.lmax('v')} + 0.4 * {d.lsum('v')} / {d.size(some)})")} END AS overall FROM (
        SELECT *, {every} AS v FROM (SELECT id, boundaries, encodings, runs, open, {', '.join(map(score, names))} FROM (
        SELECT id, {arrays}, {d.rxn('text', t.BOUNDARY)} AS boundaries, {found(d, 'text', t.ENCODINGS)} AS encodings, {d.rxn('text', t.FOREIGN + '+')} AS runs,
        CASE WHEN {d.rx('text', t.FOREIGN + chr(92) + 'z')} THEN 1 ELSE 0 END AS open FROM {d.t('texts')} a) b) c) e) f"""


@op
def sc41_bias(d, table=t.BIAS, threshold=0.3):
    """SC41: a row for each pattern found whose severity reaches the threshold, and the text's worst severity."""
    table = [r for r in table if r[2] >= threshold]
    facts = d.values([(k, c, s) for k, (c, _, s) in enumerate(table, 1)], "r", "i", "category", "severity")
    return f"""SELECT id, x.i, category, severity, max(severity) OVER (PARTITION BY id) AS overall, count(*) OVER (PARTITION BY id) AS biases
        FROM {rows_of(d, d.t('texts') + ' a', 'id', 'text', [r[1] for r in table])} x JOIN {facts} ON x.i = r.i"""


@op
def sc42_content_filter(d, table=t.CONTENT, threshold=0.5, thresholds=None):
    """SC42: each category's score is the most of weight + 0.1 for every further match of a pattern; a row for each
    category that is found. thresholds: those of single categories."""
    facts = d.values([(k, c, w, (thresholds or {}).get(c, threshold)) for k, (c, _, w) in enumerate(table, 1)], "r", "i", "category", "weight", "threshold")
    return f"""SELECT id, category, {d.r4('max(score)')} AS score, max(score) >= max(threshold) AS blocked, CAST(sum(n) AS BIGINT) AS matches FROM (
        SELECT id, category, n, threshold, least(1.0, weight + 0.1 * (n - 1)) AS score FROM {rows_of(d, d.t('texts') + ' a', 'id', 'text', [r[1] for r in table], counted=True)} x JOIN {facts} ON x.i = r.i) y GROUP BY id, category"""


@op
def sc43_toxicity(d, table=t.TOXIC, threshold=0.5):
    """SC43: a category's worst severity and 0.02 for each further match (0.1 at most); of the categories the worst and
    0.05 for each further one (0.15 at most)."""
    facts = d.values([(k, c, w) for k, (c, _, w) in enumerate(table, 1)], "r", "i", "category", "severity")
    return f"""SELECT id, {d.r4('overall')} AS score, overall >= {threshold} AS toxic, categories FROM (SELECT id, least(1.0, max(score) + least(0.15, 0.05 * (count(*) - 1))) AS overall, count(*) AS categories FROM (
        SELECT id, category, least(1.0, max(severity) + least(0.1, 0.02 * (CAST(sum(n) AS BIGINT) - 1))) AS score FROM {rows_of(d, d.t('texts') + ' a', 'id', 'text', [r[1] for r in table], counted=True)} x JOIN {facts} ON x.i = r.i
        GROUP BY id, category) y GROUP BY id) z"""


@op
def sc44_sensitivity(d, table=t.SENSITIVE):
    """SC44: the most sensitive level found; 0.3 of confidence for each pattern found, 1 if none is."""
    levels = kinds(table)
    return f"""SELECT id, CASE {' '.join(f"WHEN {k} > 0 THEN '{k}'" for k in levels)} ELSE 'public' END AS level, CASE WHEN {' + '.join(levels)} > 0 THEN {d.r4(f"least(1.0, 0.3 * ({' + '.join(levels)}))")} ELSE 1.0 END AS confidence
        FROM (SELECT id, {', '.join(f"{found(d, 'text', of(table, k))} AS {k}" for k in levels)} FROM {d.t('texts')} a) b"""


@op
def sc45_response_class(d, table=t.RESPONSE, scores=t.RESPONSE_SCORES, least=0.5):
    """SC45: the class of a response with the most confidence, the first on ties; texts of fewer than two words are empty."""
    names = kinds(table)
    score = lambda k: f"CASE WHEN n_{k} > 0 THEN least({scores[k][2]}, {scores[k][0]} + {scores[k][1]} * n_{k}) ELSE 0.0 END"
    return f"""SELECT id, CASE WHEN words < 2 THEN 'empty' WHEN top >= {least} THEN {d.at(d.strings(names), d.pos('v', 'top'))} ELSE 'safe' END AS class,
        CASE WHEN words < 2 THEN 1.0 WHEN top >= {least} THEN {d.r4('top')} WHEN {d.lmax(d.arr(*[f'v{k}' for k in range(3)]))} > 0.0 THEN 0.6 ELSE 0.8 END AS confidence FROM (
        SELECT *, {d.lmax('v')} AS top FROM (SELECT *, {d.arr(*[f'v{k}' for k in range(len(names))])} AS v FROM (SELECT id, words, {', '.join(f'{score(k)} AS v{i}' for i, k in enumerate(names))} FROM (
        SELECT id, {d.size(d.all('text', '[^ \\t\\n\\r]+'))} AS words, {', '.join(f"{found(d, 'text', of(table, k))} AS n_{k}" for k in names)} FROM {d.t('texts')} a) b) c) e) f"""


@op
def sc46_response_safety(d, table=t.SAFETY, weights=t.SAFETY_WEIGHTS, least=0.6):
    """SC46: six signals, each 1 less 0.3 for every match; their weighted mean, pulled half way to the worst one hit."""
    n = {k: counts(d, "text", of(table, k)) for k in kinds(table)}
    signals = tuple(weights)
    score = lambda k: f"greatest(0.0, 1.0 - 0.3 * {k})"
    mean = f"({' + '.join(f'{w} * {score(k)}' for k, w in weights.items())}) / {float(sum(weights.values()))}"
    worst = f"least({', '.join(f'CASE WHEN {k} > 0 THEN {score(k)} ELSE 1.0 END' for k in signals)})"
    return f"""SELECT id, {d.r4('overall')} AS overall, overall >= {least} AS safe, CASE WHEN overall < 0.2 THEN 'critical' WHEN overall < 0.4 THEN 'high' WHEN overall < 0.6 THEN 'medium' WHEN overall < 0.8 THEN 'low' ELSE 'minimal' END AS risk_level,
        {', '.join(f'{d.r4(score(k))} AS {k}' for k in signals)} FROM (SELECT *, CASE WHEN {' + '.join(signals)} > 0 THEN least(mean, 0.5 * worst + 0.5 * mean) ELSE mean END AS overall FROM (
        SELECT *, {mean} AS mean, {worst} AS worst FROM (SELECT id, harmful, leakage, hedging + complying + CASE WHEN harmful > 0 AND complying > 0 THEN 2 ELSE 0 END AS compliance, toxicity, bias,
        CASE WHEN certain > 0 AND claim > 0 THEN certain + claim ELSE 0 END AS hallucination FROM (
        SELECT id, {n['harmful']} AS harmful, {n['leakage']} AS leakage, {n['hedging']} AS hedging, {n['compliance']} AS complying, {n['toxicity']} AS toxicity, {n['bias']} AS bias, {n['certain']} AS certain, {n['claim']} AS claim
        FROM {d.t('texts')} a) b) c) e) f"""


#: Intents, routes and topics are the caller's; these are examples. name: (keywords, patterns, risk or handler or weight).
INTENTS = {
    "question": (("how", "what", "why"), (r"\?",), "low"),
    "code": (("code", "function", "debug"), (r"(?i)\bdef \w+|\bclass \w+",), "medium"),
    "attack": (("hack", "exploit", "bypass"), (r"(?i)ignore (all|previous)", r"(?i)system prompt"), "critical"),
}
ROUTES = {"support": (("help", "error", "sorry"), (r"went wrong",), 1.0), "engineering": (("code", "api", "server", "debug"), (r"\bdeploy\b",), 1.5), "security": (("hack", "attack", "bomb"), (r"system prompt",), 2.0)}
TOPICS = {"computing": ("code algorithm server api debug", 1.0, True), "money": ("salary revenue budget market account", 1.0, True), "violence": ("kill bomb murder attack", 2.0, False)}


def _argmax(d, names, array, top, none):
    return f"CASE WHEN {top} > 0 THEN {d.at(d.strings(names), d.pos(array, top))} ELSE {d.lit(none)} END"


@op
def sc47_intent(d, intents=INTENTS, default="general"):
    """SC47: a point for each keyword within the text and two for each pattern; the first intent with the most points."""
    names, low = tuple(intents), "lower(text)"
    score = lambda k: " + ".join([f"CASE WHEN contains({low}, {d.lit(w.lower())}) THEN 1.0 ELSE 0.0 END" for w in intents[k][0]] + [f"CASE WHEN {d.rx('text', p)} THEN 2.0 ELSE 0.0 END" for p in intents[k][1]])
    most = [len(v[0]) + 2.0 * len(v[1]) for v in intents.values()]
    return f"""SELECT id, {_argmax(d, names, 'v', 'top', default)} AS intent, CASE WHEN top > 0 THEN least(1.0, {d.r4(f"top / {d.at(d.arr(*map(str, most)), d.pos('v', 'top'))}")}) ELSE 0.0 END AS confidence,
        {_argmax(d, [v[2] for v in intents.values()], 'v', 'top', 'low')} AS risk FROM (SELECT id, v, {d.lmax('v')} AS top FROM (SELECT id, {d.arr(*map(score, names))} AS v FROM {d.t('texts')} a) b) c"""


@op
def sc48_route(d, routes=ROUTES, default="general"):
    """SC48: a point for each keyword among the words and two for each pattern, times the route's weight, over its matchers."""
    names = tuple(routes)

    def score(k):
        words, patterns, weight = routes[k]
        n = f"{d.inter('ws', d.strings(sorted({w.lower() for w in words})))}" if words else "0"
        return d.r4(f"({n} * 1.0 + " + " + ".join([f"CASE WHEN {d.rx('text', '(?i)' + p)} THEN 2.0 ELSE 0.0 END" for p in patterns] or ["0.0"]) + f") * {weight} / {float(len(words) + len(patterns))}")

    return f"""SELECT id, {_argmax(d, names, 'v', 'top', default)} AS route, least(1.0, top) AS confidence FROM (SELECT id, v, {d.lmax('v')} AS top FROM (SELECT id, {d.arr(*map(score, names))} AS v
        FROM (SELECT id, text, {d.distinct(d.all('lower(text)', '[a-z0-9_]+'))} AS ws FROM {d.t('texts')} a) b) c) e"""


@op
def sc49_labels(d, labels=t.LABELS, least=0.1, most_labels=5, calibration=1.0, weight=1.0):
    """SC49: the labels whose keywords stand in a text, by confidence: keywords found over a tenth of the words."""
    names = tuple(labels)
    score = lambda k: f"least(1.0, {d.inter('ws', d.strings(labels[k].split()))} * {weight} / greatest(n * 0.1, 1.0) * {calibration})"
    return f"""SELECT id, label, {d.r4('confidence')} AS confidence, place, labels FROM (SELECT id, {d.at(d.strings(names), 'i')} AS label, confidence, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, i) AS place, count(*) OVER (PARTITION BY id) AS labels
        FROM (SELECT id, i, {d.at('v', 'i')} AS confidence FROM (SELECT id, v, {d.explode(d.seq('1', str(len(names))))} AS i FROM (SELECT id, {d.arr(*map(score, names))} AS v
        FROM (SELECT id, {d.distinct(d.all('lower(text)', '[a-z0-9_]+'))} AS ws, {d.size(d.all('text', '[^ \\t\\n\\r]+'))} AS n FROM {d.t('texts')} a) b) c) e) f WHERE confidence >= {least}) g WHERE place <= {most_labels}"""


@op
def sc50_topics(d, topics=TOPICS, threshold=0.1, required=False):
    """SC50: the share of a topic's keywords among the words (within the text, if none is a word); a blocked topic decides."""
    names = tuple(topics)

    def score(k):
        words, weight, _ = topics[k]
        words = words.split()
        exact = d.inter("ws", d.strings(words))
        within = " + ".join(f"CASE WHEN contains(low, {d.lit(w)}) THEN 1 ELSE 0 END" for w in words)
        return d.r4(f"least(1.0, CASE WHEN {exact} > 0 THEN {exact} ELSE {within} END * {weight} / {float(len(words))})")

    allowed = [f"v{i} >= {threshold} AND v{i} > 0" for i, k in enumerate(names) if topics[k][2]]
    blocked = [f"(v{i} >= {threshold} AND v{i} > 0)" for i, k in enumerate(names) if not topics[k][2]]
    on = f"NOT ({' OR '.join(blocked) or 'false'})" + (f" AND (({') OR ('.join(allowed) or 'false'}))" if required else "")
    return f"""SELECT id, {on} AS on_topic, {_argmax(d, names, 'v', 'top', '')} AS topic, top AS score FROM (SELECT *, CASE WHEN {d.lmax('v')} >= {threshold} THEN {d.lmax('v')} ELSE 0.0 END AS top FROM (SELECT *, {d.arr(*[f'v{i}' for i in range(len(names))])} AS v FROM (
        SELECT id, {', '.join(f'{score(k)} AS v{i}' for i, k in enumerate(names))} FROM (SELECT id, lower(text) AS low, {d.distinct(d.all('lower(text)', '[a-z0-9]+'))} AS ws FROM {d.t('texts')} a) b) c) e) f"""


@op
def sc51_language(d, scripts=t.SCRIPTS, words=t.LANGUAGE_WORDS):
    """SC51: shares of scripts among the characters of any, and of frequent words among all words, added up by language."""
    names = tuple(dict.fromkeys([s[0] for s in scripts] + list(words)))
    letters = lambda k: " + ".join(d.rxn("text", f"[{r}]") for c, r in scripts if c == k)
    chars = {k: f"c_{k}" for k in kinds(scripts)}
    script = lambda k: f"CASE WHEN of_scripts > 0 THEN {chars[k]} / CAST(of_scripts AS DOUBLE) ELSE 0.0 END" if k in chars else "0.0"
    word = lambda k: f"CASE WHEN n > 0 THEN {d.size(d.filter('ws', 'x', d.has(d.strings(sorted(set(words[k].split()))), 'x')))} / CAST(n AS DOUBLE) ELSE 0.0 END" if k in words else "0.0"
    return f"""SELECT id, {_argmax(d, names, 'v', 'top', 'und')} AS language, CASE WHEN top > 0 THEN {d.r4(f"least(1.0, top / {d.lsum('v')})")} ELSE 0.0 END AS confidence FROM (SELECT id, v, {d.lmax('v')} AS top FROM (
        SELECT id, {d.arr(*[f'{script(k)} + {word(k)}' for k in names])} AS v FROM (SELECT *, {' + '.join(chars.values())} AS of_scripts, {d.size('ws')} AS n FROM (
        SELECT id, {', '.join(f'{letters(k)} AS {c}' for k, c in chars.items())}, {d.all('lower(text)', '[a-zA-Z\\x{C0}-\\x{24F}]+')} AS ws FROM {d.t('texts')} a) b) c) e) f"""


@op
def sc52_fingerprint(d, table=t.MODELS, any_model=t.ANY_MODEL):
    """SC52: the model whose marks weigh most, unknown below 0.1; whether a model wrote the text at all."""
    names = kinds(table)
    score = lambda k: d.r4(f"least(1.0, {d.lsum(hits(d, 'low', of(table, k), of(table, k, value=2)))})")
    return f"""SELECT id, CASE WHEN top < 0.1 THEN 'unknown' ELSE {d.at(d.strings(names), d.pos('v', 'top'))} END AS model, top AS confidence, ai >= 0.1999 OR top >= 0.2 AS generated FROM (SELECT id, v, ai, {d.lmax('v')} AS top FROM (
        SELECT id, {d.arr(*map(score, names))} AS v, {d.lsum(hits(d, 'low', [r[0] for r in any_model], [r[1] for r in any_model]))} AS ai FROM (SELECT id, lower(text) AS low FROM {d.t('texts')} a) b) c) e"""


@op
def sc53_harm_words(d, words=t.HARM_WORDS):
    """SC53: texts with a word of harm, marks around it aside."""
    bare = d.map(d.all("lower(text)", "[^ \\t\\n\\r]+"), "w", d.rep(d.rep("w", r"^[.,!?;:\"'()\[\]]+", ""), r"[.,!?;:\"'()\[\]]+$", ""))
    return f"SELECT id, {d.inter(d.distinct(bare), d.strings(words))} AS words FROM {d.t('texts')} a WHERE {d.inter(d.distinct(bare), d.strings(words))} > 0"


@op
def sc26_data_classes(d, table=t.DATA, least=2):
    """SC26: each kind of sensitive data found, its risk, matches and regulations, and the text's highest risk."""
    table = [r for r in table if r[2] >= least]
    facts = d.values([(k, c, s, r, g) for k, (c, s, r, g, _) in enumerate(table, 1)], "r", "i", "category", "kind", "risk", "regulations")
    return f"""SELECT id, category, kind, risk, n, regulations, max(risk) OVER (PARTITION BY id) AS highest FROM {rows_of(d, d.t('texts') + ' a', 'id', 'text', [r[4] for r in table], counted=True)} x JOIN {facts} ON x.i = r.i"""


@op
def sc27_threat_feed(d, table=t.THREATS):
    """SC27: the indicators found in a text, the most severe first."""
    facts = d.values([(k, i, c, s) for k, (i, c, s, _, _) in enumerate(table, 1)], "r", "i", "indicator", "category", "severity")
    return f"""SELECT id, indicator, category, severity, row_number() OVER (PARTITION BY id ORDER BY severity DESC, x.i) AS place
        FROM {rows_of(d, d.t('texts') + ' a', 'id', 'lower(text)', [r[4] for r in table])} x JOIN {facts} ON x.i = r.i"""


@op
def sc28_threat_query(d, table=t.THREATS, category=None, severity=3, tags=("unicode", "encoding", "delimiter", "role")):
    """SC28: indicators by category, severity and any of some tags."""
    rows = d.values([(i, c, s, g) for i, c, s, g, _ in table], "r", "indicator", "category", "severity", "tags")
    some = [f"category = {d.lit(category)}"] if category else []
    some += [f"severity = {severity}"] if severity else []
    some += ["(" + " OR ".join(f"concat(' ', tags, ' ') LIKE '% {g} %'" for g in tags) + ")"] * bool(tags)
    return f"SELECT indicator, category, severity, tags FROM {rows} WHERE {' AND '.join(some) or 'true'}"


@op
def sc29_threat_scan(d, table=t.INDICATORS):
    """SC29: indicators in the case given count fully; those found in another case only, 0.8."""
    facts = d.values([(k, i, c, s) for k, (i, c, s, _) in enumerate(table, 1)], "r", "i", "indicator", "threat_type", "severity")
    other = rows_of(d, d.t("texts") + " a", "id", "text", ["(?i)" + r[3] for r in table], counted=True)
    same = rows_of(d, d.t("texts") + " a", "id", "text", [r[3] for r in table], counted=True)
    return f"""SELECT o.id, indicator, threat_type, severity, coalesce(s.n, o.n) AS matches, CASE WHEN s.n IS NULL THEN 0.8 ELSE 1.0 END AS confidence, max(severity) OVER (PARTITION BY o.id) AS threat_level
        FROM {other} o LEFT JOIN {same} s ON o.id = s.id AND o.i = s.i JOIN {facts} ON o.i = r.i"""
