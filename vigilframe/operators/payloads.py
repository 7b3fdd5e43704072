"""Payloads: JSON values however deep, canary marks in outputs."""

from vigilframe.operators import detectors  # noqa: F401  registers texts
from vigilframe.plans.sql import given, op

#: Kind of injection, pattern, risk (4 critical, 3 high).
INJECTIONS = (
    ("script tag", r"(?i)<script[^>]*>", 4),
    ("script address", r"(?i)javascript\s*:", 3),
    ("event handler", r"(?i)on(click|load|error|mouseover)\s*=", 3),
    ("sql statement", r"(?i)(;\s*(DROP|DELETE|INSERT|UPDATE|ALTER|CREATE)\s+)", 4),
    ("sql condition", r"(?i)('\s*(OR|AND)\s+'\w+'\s*=\s*'\w+)", 3),
    ("template", r"\{\{.*\}\}|\$\{.*\}|<%.*%>", 3),
    ("null byte", r"(?i)\\u0000|%00|\x00", 3),
    ("path traversal", r"\.\./\.\./|\.\.\\\.\.\\", 3),
)
#: Payloads by hand: id, text.
PAYLOADS = (
    (-1, '{"a": "<script>x</script>", "b": {"onclick=": ["../../etc", "fine"]}}'), (-2, '["x; DROP TABLE t", {"deep": [[["${x} and ${y}"]]]}]'), (-3, "not json but javascript: x"), (-4, "{}"),
    (-5, "[" * 21 + "1" + "]" * 21), (-6, "[" * 20 + "1" + "]" * 20), (-7, '{"long": "' + "y" * 10001 + '"}'), (-8, '{"name": 5, "extra": true}'), (-9, '{"name": "ok", "age": 300, "kind": "c"}'), (-10, '{"age": 5}'), (-11, "' OR 'a'='a"), (-12, ""),
)
#: field: (required, type, least, most, permitted values).
SCHEMA = {"name": (True, "string", None, None, None), "age": (False, "number", 0, 150, None), "kind": (False, "string", None, None, ("a", "b"))}


@given
def payloads(d):
    return f"SELECT event_id AS id, props AS payload FROM {d.t('events')} UNION ALL SELECT * FROM {d.values(PAYLOADS, 'p', 'id', 'payload')}"


@op
def sc20_structured_output(d, injections=INJECTIONS, longest=10000, deepest=20):
    """SC20: keys and string values of a JSON payload, however deep (the whole text, where it isn't JSON), held against
    patterns of injection: for each kind how many strings have it; strings that are too long; nesting that is too deep."""
    strings = d.map(d.all("payload", d.string), "s", "substr(s, 2, length(s) - 2)")
    where = f"CASE WHEN {d.valid_json('payload')} THEN {strings} ELSE {d.arr('payload')} END"
    bare = d.rep(d.rep("payload", d.string, ""), r"[^\[\]{}]+", " ")
    for _ in range(deepest):
        bare = d.rep(bare, r"[\[{][^\[\]{}]*[\]}]", "")
    cells = [f"CAST({k} AS BIGINT) * 1000000 + {d.size(d.filter('ss', 's', d.rx('s', p)))}" for k, (_, p, _) in enumerate(injections, 1)]
    long, deep = len(injections) + 1, len(injections) + 2
    cells += [f"CAST({long} AS BIGINT) * 1000000 + CASE WHEN json THEN {d.size(d.filter('ss', 's', f'length(s) > {longest}'))} ELSE 0 END", f"CAST({deep} AS BIGINT) * 1000000 + CASE WHEN json AND {d.rx('rest', r'[\[{]')} THEN 1 ELSE 0 END"]
    facts = d.values([(k, n, r) for k, (n, _, r) in enumerate(injections, 1)] + [(long, "oversized string", 2), (deep, "excessive depth", 2)], "f", "i", "issue", "risk")
    return f"""SELECT id, issue, risk, strings FROM (SELECT id, CAST(floor(c / 1000000) AS INT) AS i, CAST(c % 1000000 AS BIGINT) AS strings FROM (SELECT id, {d.explode(d.filter(d.arr(*cells), 'c', 'c % 1000000 > 0'))} AS c FROM (
        SELECT id, {d.valid_json('payload')} AS json, {where} AS ss, {bare} AS rest FROM {d.t('payloads')} p) a) b) x JOIN {facts} ON x.i = f.i"""


@op
def sc20_schema(d, schema=SCHEMA):
    """SC20: the fields of JSON objects against a schema: missing, of another type, out of range, not permitted."""
    tests = []
    for field, (required, kind, least, most, permitted) in schema.items():
        raw, there = d.json("payload", field), d.rx("top", f'"{field}"\\s*:')
        number = d.rx("top", f'"{field}"\\s*:\\s*-?[0-9]')
        text = d.rx("top", f'"{field}"\\s*:\\s*"')
        if required:
            tests.append((f"NOT {there}", field, "missing"))
        tests.append((f"{there} AND NOT {number if kind == 'number' else text}", field, "type mismatch"))
        bounds = [f"try_cast({raw} AS DOUBLE) < {least}"] * (least is not None) + [f"try_cast({raw} AS DOUBLE) > {most}"] * (most is not None)
        if bounds:
            tests.append((f"{number} AND ({' OR '.join(bounds)})", field, "out of range"))
        if permitted:
            tests.append((f"{there} AND coalesce({raw}, '') NOT IN ({', '.join(map(d.lit, permitted))})", field, "not permitted"))
    cells = d.filter(d.arr(*[f"CASE WHEN {c} THEN {k} ELSE 0 END" for k, (c, *_) in enumerate(tests, 1)]), "x", "x > 0")
    facts = d.values([(k, f, i) for k, (_, f, i) in enumerate(tests, 1)], "f", "i", "field", "issue")
    nested = r"(?:[\[{][^\[\]{}]*[\]}])"
    top = d.rep("substr(trim(payload), 2, length(trim(payload)) - 2)", nested, "0")
    return f"""SELECT id, field, issue FROM (SELECT id, {d.explode(cells)} AS i FROM (SELECT id, payload, {top} AS top FROM {d.t('payloads')} p WHERE {d.valid_json('payload')} AND substr(trim(payload), 1, 1) = '{'{{' if d.t('x') != 'x' else '{'}') a) b JOIN {facts} ON b.i = f.i"""


#: Canary tokens by hand: their ids and names. The marks are prefix:id in a comment, plain, or in zero-width characters.
CANARIES = (("00ff00ff00ff00ff", "billing"), ("0123456789abcdef", "support"))
ZERO_WIDTH = ("​", "‌", "‍", "﻿")


def invisible(payload: str) -> str:
    """A text as zero-width characters, two bits each."""
    return "".join(ZERO_WIDTH[(b >> k) & 3] for b in payload.encode() for k in (6, 4, 2, 0))


OUTPUTS = (
    (-301, "see <!-- CANARY:00ff00ff00ff00ff --> and CANARY:00ff00ff00ff00ff"), (-302, "plain CANARY:0123456789abcdef twice CANARY:0123456789abcdef"), (-303, "hidden " + invisible("CANARY:00ff00ff00ff00ff") + " mark"),
    (-304, "unknown CANARY:abc123"), (-305, "broken " + invisible("CANARY:00ff")[:-2] + invisible("x")), (-306, "nothing"),
)


@given
def outputs(d):
    return f"SELECT id, text FROM {d.t('texts')} a UNION ALL SELECT * FROM {d.values(OUTPUTS, 'o', 'id', 'text')}"


@op
def sc34_canaries(d, tokens=CANARIES, prefix="CANARY"):
    """SC34: canary marks in outputs: in a comment, plain (a token found in a comment is not plain as well), or decoded from
    zero-width characters; the token's name, or unknown."""
    digits = f"translate({d.rep('text', '[^' + ''.join(f'{chr(92)}x{{{ord(c):x}}}' for c in ZERO_WIDTH) + ']', '')}, '{''.join(ZERO_WIDTH)}', '0123')"
    byte = " + ".join(f"CAST(substr(z, CAST(4 * i + {k + 1} AS INT), 1) AS INT) * {4 ** (3 - k)}" for k in range(4))
    decoded = d.join(d.map(d.seq("0", "CAST(floor(length(z) / 4) AS INT) - 1"), "i", f"chr(CASE WHEN {byte} BETWEEN 32 AND 126 THEN {byte} ELSE 63 END)"), "")
    plain, comment = f"{prefix}:([a-f0-9]+)", rf"<!--\s*{prefix}:([a-f0-9]+)\s*-->"
    one = lambda x, p: d.map(d.all0(x, p), "m", d.get("m", plain, 1))
    kinds = {"comment": "cs", "plain": d.filter("ps", "x", f"NOT {d.has('cs', 'x')}"), "zero-width": f"CASE WHEN {d.rx('hidden', plain)} THEN {d.arr(d.get('hidden', plain, 1))} ELSE {d.filter('ps', 'x', 'false')} END"}
    each = " UNION ALL ".join(f"SELECT id, '{k}' AS style, {d.explode(v)} AS token FROM m" for k, v in kinds.items())
    return f"""WITH m AS (SELECT id, {one('text', comment)} AS cs, {d.distinct(one('text', plain))} AS ps, {decoded} AS hidden FROM (SELECT id, text, {digits} AS z FROM {d.t('outputs')} o) a)
        SELECT e.id, e.style, e.token, coalesce(t.name, 'unknown') AS name, count(*) AS n FROM ({each}) e LEFT JOIN {d.values(tokens, 't', 'token', 'name')} ON e.token = t.token GROUP BY e.id, e.style, e.token, coalesce(t.name, 'unknown')"""
