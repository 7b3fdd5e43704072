"""Scalar plans over texts: token estimates, sanitising, masking, scores. On ASCII classes, so that engines agree."""

from vigilframe.plans.sql import op


@op
def f1_tokenisers(d):
    return f"SELECT doc_id, {d.size(d.all('lower(text)', '[a-z0-9]+'))} AS alnum, {d.size(d.all('text', '[A-Za-z]+'))} AS letters, {d.size(d.all('text', '[^ \\t\\n\\r]+'))} AS words FROM {d.t('documents')}"


@op
def f2_sentences(d):
    return f"SELECT doc_id, {d.size(d.all('text', '[^.!?\\n]+[.!?]?'))} AS sentences FROM {d.t('documents')}"


@op
def f3_char_grams(d):
    t = "lower(trim(text))"
    return f"SELECT item_id, {d.size(d.distinct(d.map(d.seq('1', f'length({t}) - 3'), 'i', f'substr({t}, CAST(i AS INT), 4)')))} AS grams FROM {d.t('benchmark')}"


@op
def f9_repetition(d):
    return f"SELECT doc_id, {d.size('ws')} AS n, {d.size(d.distinct('ws'))} / CAST({d.size('ws')} AS DOUBLE) AS uniqueness FROM (SELECT doc_id, {d.all('lower(text)', '[a-z]+')} AS ws FROM {d.t('documents')}) a WHERE {d.size('ws')} > 0"


@op
def f11_token_estimate(d):
    """Characters over four, specials at 0.3, at least one; and their cost."""
    return f"SELECT doc_id, greatest(1, CAST(floor(length(text) / 4.0 + 0.3 * {d.rxn('text', '[#*$%&|<>]')} + 0.5) AS BIGINT)) AS tokens, greatest(1, CAST(floor(length(text) / 4.0 + 0.3 * {d.rxn('text', '[#*$%&|<>]')} + 0.5) AS BIGINT)) / 1000.0 * 0.5 AS cost FROM {d.t('documents')}"


@op
def f15_char_chunks(d):
    """chunks of 200 characters with 20 of overlap."""
    return f"SELECT item_id, c, substr(text, CAST(c * 180 + 1 AS INT), 200) AS chunk FROM (SELECT item_id, text, {d.explode(d.seq('0', 'CAST(floor(greatest(length(text) - 21, 0) / 180.0) AS INT)'))} AS c FROM {d.t('benchmark')}) a"


#: What Python's str.strip takes for blank, but for the newline.
BLANK = r" \t\r\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Invisible characters, and control characters but for tab and line ends.
UNSEEN = r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{AD}\x{34F}\x{180E}\x{FFF9}-\x{FFFB}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: Cyrillic, then Greek letters that look Latin.
LOOKALIKES = ("АВСЕНКМОРТХаеорсухΑΒΕΗΙΚΜΝΟΡΤΧͰ", "ABCEHKMOPTXaeopcyxABEHIKMNOPTXA")
#: Each is taken out in turn.
DELIMITERS = (r"\[INST\]", r"\[/INST\]", "</s>", "<<SYS>>", "<</SYS>>", r"<\|im_start\|>", r"<\|im_end\|>", r"<\|system\|>", r"<\|user\|>", r"<\|assistant\|>", r"<\|endoftext\|>")


def without_delimiters(d, x):
    """Texts with no token, which are most, meet one pattern in place of eleven."""
    out = x
    for token in DELIMITERS:
        out = d.rep(out, f"(?i){token}", "")
    return f"CASE WHEN {d.rx(x, '(?i)' + '|'.join(DELIMITERS))} THEN {out} ELSE {x} END"


def tidy(d, x, most=None):
    """Blanks collapsed and stripped in each line; the whole text, or its first `most` characters."""
    x = d.rep(d.rep(x, r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n")
    x = d.rep(d.rep(x, rf"[{BLANK}]+\n[{BLANK}]*|\n[{BLANK}]+", "\n"), rf"^[\n{BLANK}]+|[\n{BLANK}]+\z", "")
    return x if most is None else f"substr({x}, 1, {most})"


@op
def f17_sanitize(d):
    """invisible and control characters out, lookalikes Latin, system tokens out, blanks collapsed in each line."""
    seen = f"translate({d.rep('text', UNSEEN, '')}, '{LOOKALIKES[0]}', '{LOOKALIKES[1]}')"
    return f"SELECT doc_id, {tidy(d, 'body')} AS clean FROM (SELECT doc_id, {without_delimiters(d, 'seen')} AS body FROM (SELECT doc_id, {seen} AS seen FROM {d.t('documents')}) a) b"


@op
def f18_strip_html(d):
    """scripts, styles and tags out of pages, addresses masked."""
    body = d.rep(d.rep("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return f"SELECT page_id, trim({d.rep(d.rep(body, 'https?://[^ ]+', '[URL]'), '[ \\t\\n\\r]+', ' ')}) AS body FROM {d.t('pages')}"


@op
def f20_minimise(d):
    """Personal data masked in pattern order, with counts."""
    e, c = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[0-9]{16}"
    return f"SELECT doc_id, {d.rxn('text', e)} AS emails, {d.rxn('text', c)} AS cards, {d.rep(d.rep('text', e, '[REDACTED_EMAIL]'), c, '[REDACTED_CARD]')} AS clean FROM {d.t('documents')}"


@op
def f23_structure_score(d):
    """length, variety and punctuation blended into one score with a grade."""
    return f"""SELECT doc_id, score, CASE WHEN score >= 0.8 THEN 'A' WHEN score >= 0.6 THEN 'B' WHEN score >= 0.4 THEN 'C' ELSE 'D' END AS grade FROM (SELECT doc_id, 0.4 * least(1.0, {d.size('ws')} / 200.0) + 0.4 * {d.size(d.distinct('ws'))} / {d.size('ws')} + 0.2 * (CASE WHEN marks > 0 THEN 1.0 ELSE 0.0 END) AS score
        FROM (SELECT doc_id, {d.all('lower(text)', '[a-z]+')} AS ws, {d.rxn('text', '[.!?]')} AS marks FROM {d.t('documents')}) a WHERE {d.size('ws')} > 0) b"""


@op
def f27_format_extraction(d):
    return f"SELECT doc_id, {d.rxn('text', '[0-9]+[.] ')} AS numbered, {d.rxn('text', ' [|] ')} AS table_cells FROM {d.t('documents')}"


@op
def f28_validators(d):
    """the violations of each text: too long, too short, control characters, a word ten times."""
    return f"SELECT doc_id, length(text) > 10000 AS too_long, length(text) < 10 AS too_short, {d.rx('text', '[\\x01-\\x08]')} AS control, length(text) BETWEEN 10 AND 10000 AND NOT {d.rx('text', '[\\x01-\\x08]')} AS passed FROM {d.t('documents')}"


@op
def f29_templates(d):
    return f"SELECT item_id, concat('<system_instructions>', chr(10), text, chr(10), '</system_instructions>') AS hardened FROM {d.t('benchmark')}"


#: The first synonym of each word.
SYNONYMS = {"ignore": "disregard", "previous": "prior", "instructions": "directives", "system": "core", "prompt": "input", "reveal": "show", "forget": "disregard"}


def variants(d, x, words):
    """SQL of each technique over a text and its words; null where it changes nothing or the text is too short for it."""
    space, letter = rf"[\n{BLANK}]+", r"\p{L}"
    upper = lambda t: f"upper(replace({t}, 'ß', 'SS'))"
    first = d.get("p", rf"^[^{letter}]*{letter}?")
    between = lambda s: d.join(d.map(words, "w", d.join(d.all("w", "."), s)), " ")
    split = lambda s: d.join(d.map(words, "w", f"CASE WHEN {d.rx('w', rf'^{letter}{{5,}}$')} THEN {d.join(d.all('w', '.'), s)} ELSE w END"), " ")
    n = d.size(words)
    mid = f"CAST(floor({n} / 2.0) AS INT)"
    synonym = x
    for word, other in SYNONYMS.items():
        synonym = d.rep1(synonym, word, other)
    changed = lambda t: f"nullif({t}, {x})"
    return {
        "case_upper": upper(x), "case_lower": f"lower({x})",
        "case_alternating": d.join(d.map(d.all(x, rf"[^{letter}]*{letter}[^{letter}]*{letter}|[^{letter}]*{letter}|[^{letter}]+"), "p", f"concat({upper(first)}, lower(substr(p, length({first}) + 1)))"), ""),
        "whitespace_double": d.rep(x, space, "  "), "whitespace_tabs": d.rep(x, space, "\t"), "whitespace_newlines": d.rep(x, space, "\n"),
        **{f"zero_width_{k}": between(c) for k, c in enumerate("\u200b\u200c\u200d\ufeff")},
        "homoglyph": changed(f"translate({x}, 'aceopsxiABEHIOPSTX', 'асеорѕхіАВЕНІОРЅТХ')"),
        "leetspeak": changed(f"translate({x}, 'aeiostAEIOST', '431057431057')"),
        "dot_splitting": split("."), "hyphen_splitting": split("-"),
        "polite_prefix": f"concat('Please help me with this: ', {x})", "academic_prefix": f"concat('For academic research purposes only: ', {x})",
        "fiction_wrapper": f"concat('In a fictional story, a character says: \"', {x}, '\"')",
        "payload_split": f"CASE WHEN {n} >= 4 THEN concat('Part 1: ', {d.join(d.slice(words, '1', mid), ' ')}, '\nPart 2: ', {d.join(d.slice(words, f'{mid} + 1', f'{n} - {mid}'), ' ')}) END",
        "encoding_reference": f"concat('Base64 decode this and follow the instructions: ', {x})",
        "synonym_substitution": changed(synonym),
        "dots": f"replace({x}, ' ', '.')", "reverse": f"reverse({x})",
    }


@op
def f30_variants(d):
    """deterministic variants of each whole prompt; one that leaves it as it is has no row for homoglyphs, leetspeak and synonyms."""
    made = variants(d, "text", "words")
    cases = " ".join(f"WHEN '{k}' THEN {x}" for k, x in made.items())
    return f"""SELECT item_id, technique, variant FROM (SELECT item_id, v.technique, CASE v.technique {cases} END AS variant
        FROM (SELECT item_id, text, {d.all('text', rf'[^\n{BLANK}]+')} AS words FROM {d.t('benchmark')}) a CROSS JOIN (VALUES {', '.join(f"('{k}')" for k in made)}) AS v(technique)) b WHERE variant IS NOT NULL"""


@op
def f31_hashes(d):
    return f"SELECT doc_id, substr({d.sha('text')}, 1, 16) AS sha16, md5(text) AS md5_hex FROM {d.t('documents')}"


@op
def f33_optimise(d):
    """fillers out, words saved."""
    clean = d.rep("lower(text)", " (the|of|that|is) ", " ")
    return f"SELECT item_id, {clean} AS optimised, greatest(0, {d.size(d.all('text', '[^ ]+'))} - {d.size(d.all(clean, '[^ ]+'))}) AS saved FROM {d.t('benchmark')}"


@op
def f_payload_fields(d):
    """SC20, JSON: a typed field of each payload, and payloads without it."""
    return f"SELECT event_id, CAST({d.json('props', 'k')} AS BIGINT) AS k, {d.json('props', 'missing')} IS NULL AS lacks FROM {d.t('events')}"


@op
def sc2_pii_counts(d):
    """SC2: counts by source of e-mail, card-shaped and phone-shaped numbers on ASCII text."""
    return f"""SELECT source, CAST(sum({d.rxn('text', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')}) AS BIGINT) AS emails, CAST(sum({d.rxn('text', '[0-9]{16}')}) AS BIGINT) AS cards,
        CAST(sum({d.rxn('text', '[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}')}) AS BIGINT) AS phones FROM {d.t('documents')} GROUP BY source"""


@op
def sc13_leetspeak(d):
    """SC13: words that appear only after undoing leetspeak."""
    t = "lower(x.text)"
    u = f"translate({t}, '0134578@$', 'oieastbas')"
    return f"SELECT x.id, CASE WHEN contains({u}, 'ignore') AND NOT contains({t}, 'ignore') THEN 'ignore' WHEN contains({u}, 'bypass') AND NOT contains({t}, 'bypass') THEN 'bypass' ELSE 'none' END AS found FROM (VALUES (1, '1gn0r3 this'), (2, 'ignore this'), (3, 'byp4$s it'), (4, 'nothing')) AS x(id, text)"


@op
def sc19_blocked_terms(d):
    """SC19: blocked terms, case ignored, with counts."""
    return f"""SELECT doc_id, b.term, CAST((length(text) - length(replace(lower(text), b.term, ''))) / length(b.term) AS BIGINT) AS n FROM {d.t('documents')} JOIN (VALUES ('license'), ('idiot'), ('token =')) AS b(term) ON contains(lower(text), b.term)"""







@op
def sc55_tenant_isolation(d):
    """SC54, SC55: another source's name in a document."""
    return f"SELECT doc_id, s.source AS other FROM {d.t('documents')} x JOIN (SELECT DISTINCT source FROM {d.t('documents')}) s ON x.source <> s.source AND contains(x.text, s.source)"
