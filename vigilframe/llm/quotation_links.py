"""Chat formatting by quotation linking, in DataFrame functions only.

A line's quote level is the number of > marks (blanks may stand between) that it starts with. Lines of level 0 are a
message's own text; runs of lines of one level above 0 are quoted passages. Own text is cut into passages at blank lines;
own and quoted passages are compared after normalising (marks and case dropped, blanks collapsed) by hash. A quoted
passage of level 1 links its message to the message that it quotes: the first one of the same conversation that has
the passage, if it is earlier, else the first message of any other conversation that has it. Passages of deeper levels are quotes
within quotes and are linked the same way, but don't decide what a message answers.

Each message answers the message that it quotes; if it quotes none of its own conversation, it starts a thread. Threads
follow one another by turn, and a thread is in depth-first order: every message after the one that it answers, answers to
one message by turn. A message's place is its rank in an Euler tour of its thread: every message is entered and left once,
each step knows the next one, and pointer doubling sums the steps up to the tour's end. So a message is two rows of fixed
size however long its thread, and conversations are never collected: one that holds a third of all rows is ordered in
parallel. The result is range-partitioned and sorted by conversation, thread and place.

Defined results: null texts are empty messages; a text of quotes only has empty own text; passages without a letter or
digit link nothing; a passage that nothing earlier has stays unlinked. Repeated rows (same conv_id, turn, role and text)
are one message, returned once; different texts under one (conv_id, turn) are kept, in order of role and text, and share
their links and place. Rows with a null conv_id or turn are returned without links, first in their conversation. Extra columns are
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.util import materialize, shuffle_partitions

MARKS = r"^[ \t]*>(?:[ \t]*>)*[ \t]?"
ROUNDS = 64


def normalised(text: Column) -> Column:
    """Lower case, every run of characters other than letters, digits and non-ASCII ones one blank."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^0-9a-z\x{80}-\x{10FFFF}]+", " "))


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (own text), own (passage texts) and quotes (level, passage)."""
    line = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n", -1)
    rows = messages.select("conv_id", "turn", "role", "text").distinct().withColumn("lines", F.transform(line, lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("s"), x.alias("raw"))))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["raw"]), "\n")
    # Quoted lines with their level where a run begins; marks that part runs can't come from the text.
    mark = lambda x, i: F.when(F.coalesce(F.get("lines", i - 1)["level"] == x["level"], F.lit(False)), "\n").otherwise(F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02")))
    runs = F.array_join(F.transform("lines", lambda x, i: F.when(x["level"] == 0, "").otherwise(F.concat(mark(x, i), F.translate(x["s"], "\x01\x02", "")))), "")
    any_quote = F.exists("lines", lambda x: x["level"] > 0)
    quotes = F.when(any_quote, F.filter(F.split(runs, "\x01"), lambda x: x != ""))
    rows = rows.select("conv_id", "turn", "role", "text", F.btrim(own, F.lit("\n ")).alias("body"), F.coalesce(quotes, F.array().cast("array<string>")).alias("q"), any_quote.alias("quoting"))
    passages = F.flatten(F.transform("q", lambda x: F.transform(F.split(F.regexp_extract(x, "(?s)\x02(.*)", 1), r"\n[ \t]*\n"), lambda y: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("int").alias("level"), normalised(y).alias("passage")))))
    return rows.select(
        "conv_id", "turn", "role", "text", "body", "quoting", F.filter(F.array_distinct(F.transform(F.split("body", r"\n[ \t]*\n"), normalised)), lambda x: x != "").alias("own"),
        F.filter(F.array_distinct(passages), lambda x: x["passage"] != "").alias("quotes"),
    )


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, h (the passage's hash), to_conv, to_turn of each quoted passage; null where nothing has it."""
    known = parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = known.filter("quoting").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", F.col("q.level").alias("level"), F.xxhash64("q.passage").alias("h")).distinct()
    quotes = materialize(quotes, "quotes")
    # Only passages that someone quotes are looked up; each is counted once, so a hot passage is one row here.
    asked = quotes.select("h").distinct()
    has = known.select("conv_id", "turn", F.explode("own").alias("p")).select("conv_id", "turn", F.xxhash64("p").alias("h")).distinct().join(asked, "h", "left_semi")
    has = materialize(has, "quoted-originals")
    near = has.groupBy("conv_id", "h").agg(F.min("turn").alias("near"))
    # The first message of each of the two smallest conversations: one of them isn't the quoting one.
    first = near.groupBy("h").agg(F.min(F.struct("conv_id", F.col("near").alias("turn"))).alias("first"))
    second = near.join(first, "h").filter(F.col("conv_id") != F.col("first.conv_id")).groupBy("h").agg(F.min(F.struct("conv_id", F.col("near").alias("turn"))).alias("second"))
    out = quotes.join(near, ["conv_id", "h"], "left").join(first, "h", "left").join(second, "h", "left").withColumn("near", F.when(F.col("near") < F.col("turn"), F.col("near")))
    far = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    return out.select(
        "conv_id", "turn", "level", "h", F.when(F.col("near").isNotNull(), F.col("conv_id")).otherwise(far["conv_id"]).alias("to_conv"),
        F.coalesce("near", far["turn"]).alias("to_turn"),
    )


def places(answers: DataFrame) -> DataFrame:
    """conv_id, turn, thread (the turn of its first message), depth and place (from 0) of every message of a thread, for
    answers(conv_id, turn, to_turn). The number of rounds is the logarithm of the longest thread."""
    answers = answers.select("conv_id", "turn", "to_turn")
    nodes = answers.select("conv_id", "turn").unionByName(answers.select("conv_id", F.col("to_turn").alias("turn"))).distinct()
    # A message's first answer, and the next answer to the message that it answers.
    heir = answers.groupBy("conv_id", F.col("to_turn").alias("turn")).agg(F.min("turn").alias("heir"))
    sibling = answers.withColumn("next", F.lead("turn").over(Window.partitionBy("conv_id", "to_turn").orderBy("turn")))
    nodes = nodes.join(sibling, ["conv_id", "turn"], "left").join(heir, ["conv_id", "turn"], "left")
    step = lambda turn, leave: F.struct(turn.cast("long").alias("turn"), F.lit(leave).alias("leave"))
    enter = F.when(F.col("heir").isNotNull(), step(F.col("heir"), False)).otherwise(step(F.col("turn"), True))
    leave = F.when(F.col("next").isNotNull(), step(F.col("next"), False)).when(F.col("to_turn").isNotNull(), step(F.col("to_turn"), True))
    one = lambda leave, to, n, deep: F.struct(F.lit(leave).alias("leave"), to.alias("to"), F.lit(n).cast("long").alias("n"), F.lit(deep).cast("long").alias("deep"))
    now = nodes.select("conv_id", "turn", F.explode(F.array(one(False, enter, 1, 1), one(True, leave, 0, -1))).alias("x")).select("conv_id", "turn", "x.*")
    # root: the thread's first message, which the tour leaves last.
    now = now.withColumn("root", F.when(F.col("to").isNull(), F.col("turn")))
    for _ in range(ROUNDS):
        now = materialize(now, "thread-tour")
        if not now.filter("root IS NULL").head(1):
            break
        open_ = now.filter("root IS NULL").withColumn("by", F.col("to"))
        then = now.select("conv_id", step(F.col("turn"), False).withField("leave", F.col("leave")).alias("by"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("deep").alias("deep2"), F.col("root").alias("root2"))
        hop = open_.join(then, ["conv_id", "by"]).select("conv_id", "turn", "leave", F.col("to2").alias("to"), (F.col("n") + F.col("n2")).alias("n"), (F.col("deep") + F.col("deep2")).alias("deep"), F.col("root2").alias("root"))
        now = now.filter("root IS NOT NULL").unionByName(hop)
    else:
        raise RuntimeError("threads are longer than 2 ** ROUNDS")
    entered = now.filter("NOT leave")
    total = entered.filter("turn = root").select("conv_id", "root", F.col("n").alias("total"))
    # Steps that enter, from here to the end; the messages left after that are those above.
    return entered.join(total, ["conv_id", "root"]).select("conv_id", "turn", F.col("root").alias("thread"), (-F.col("deep")).alias("depth"), (F.col("total") - F.col("n")).alias("place"))


def format_chats(messages: DataFrame) -> DataFrame:
    """One row for each message, in reply order: conv_id, thread (the turn of its first message), depth (answers between
    that one and this), place (in the thread, from 0), turn, role, body, reply_turn, far_conv and far_turn (a message of
    another conversation that it quotes), n_quotes, n_linked, and chat, its turn in chat format."""
    parsed = materialize(parse(messages), "chat-parsed")
    linked = materialize(links(parsed), "chat-links")
    per = linked.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("to_turn").alias("n_linked"),
        F.max(F.when((F.col("level") == 1) & (F.col("to_conv") == F.col("conv_id")), F.col("to_turn"))).alias("reply_turn"),
        F.min(F.when((F.col("level") == 1) & (F.col("to_conv") != F.col("conv_id")), F.struct("to_conv", "to_turn"))).alias("far"),
    )
    per = materialize(per, "chat-answers")
    thread = places(per.filter("reply_turn IS NOT NULL").select("conv_id", "turn", F.col("reply_turn").alias("to_turn")))
    out = parsed.select("conv_id", "turn", "role", "text", "body").join(per, ["conv_id", "turn"], "left").join(thread, ["conv_id", "turn"], "left")
    none = F.lit(0).cast("long")
    out = out.select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", none).alias("depth"), F.coalesce("place", none).alias("place"), "turn", "role", "body", "reply_turn",
        F.col("far.to_conv").alias("far_conv"), F.col("far.to_turn").alias("far_turn"), F.coalesce("n_quotes", none).alias("n_quotes"), F.coalesce("n_linked", none).alias("n_linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>")).alias("chat"), "text",
    )
    order = ("conv_id", "thread", "place", "role", "text")
    return out.repartitionByRange(shuffle_partitions(messages.sparkSession), *order).sortWithinPartitions(*order).drop("text")


SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) a),
l0 AS (SELECT r, unnest(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)), 1) AS i FROM m),
l AS (SELECT r, i, raw, length(regexp_replace(regexp_extract(raw, '^[ \t]*>(?:[ \t]*>)*[ \t]?'), '[^>]', '', 'g')) AS level, regexp_replace(raw, '^[ \t]*>(?:[ \t]*>)*[ \t]?', '') AS s FROM l0),
g AS (SELECT *, sum(CASE WHEN before = level THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT *, lag(level) OVER (PARTITION BY r ORDER BY i) AS before FROM l) a),
body AS (SELECT m.r, m.conv_id, m.turn, m.role, trim(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (level = 0), ''), chr(10) || ' ') AS body FROM m JOIN l ON m.r = l.r GROUP BY m.r, m.conv_id, m.turn, m.role),
runs AS (SELECT r, level, string_agg(s, chr(10) ORDER BY i) AS t FROM g WHERE level > 0 GROUP BY r, run, level),
q AS (SELECT DISTINCT conv_id, turn, level, p FROM (SELECT m.conv_id, m.turn, level, trim(regexp_replace(lower(unnest(string_split_regex(t, '\n[ \t]*\n'))), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g')) AS p FROM runs JOIN m USING (r)) a WHERE p <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT DISTINCT conv_id, turn, p FROM (SELECT conv_id, turn, trim(regexp_replace(lower(unnest(string_split_regex(body, '\n[ \t]*\n'))), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g')) AS p FROM body) a WHERE p <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
near AS (SELECT conv_id, p, min(turn) AS t FROM o GROUP BY conv_id, p),
far AS (SELECT p, min({'c': conv_id, 't': t}) FILTER (k = 1) AS f, min({'c': conv_id, 't': t}) FILTER (k = 2) AS f2 FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY conv_id) AS k FROM near) a GROUP BY p),
k0 AS (SELECT q.conv_id, q.turn, q.level, near.t AS near_t, CASE WHEN far.f.c <> q.conv_id THEN far.f ELSE far.f2 END AS f FROM q LEFT JOIN near ON near.conv_id = q.conv_id AND near.p = q.p LEFT JOIN far ON far.p = q.p),
k AS (SELECT conv_id, turn, level, CASE WHEN near_t < turn THEN conv_id ELSE f.c END AS to_conv, CASE WHEN near_t < turn THEN near_t ELSE f.t END AS to_turn FROM k0),
per AS (SELECT conv_id, turn, count(*) AS n_quotes, count(to_turn) AS n_linked, max(to_turn) FILTER (level = 1 AND to_conv = conv_id) AS reply_turn, min({'c': to_conv, 't': to_turn}) FILTER (level = 1 AND to_conv <> conv_id) AS f FROM k GROUP BY conv_id, turn),
a AS (SELECT conv_id, turn, reply_turn FROM per WHERE reply_turn IS NOT NULL),
path(conv_id, turn, thread) AS (
  SELECT conv_id, turn, [reply_turn, turn] FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.conv_id = a.conv_id AND b.turn = a.reply_turn)
  UNION ALL SELECT a.conv_id, a.turn, list_append(path.thread, a.turn) FROM path JOIN a ON a.conv_id = path.conv_id AND a.reply_turn = path.turn)
SELECT body.conv_id, coalesce(path.thread[1], body.turn) AS thread, coalesce(len(path.thread) - 1, 0) AS depth, coalesce(path.place, 0) AS place, body.turn, body.role, body.body, per.reply_turn, per.f.c AS far_conv, per.f.t AS far_turn, coalesce(per.n_quotes, 0) AS n_quotes, coalesce(per.n_linked, 0) AS n_linked,
  '<|' || coalesce(body.role, 'user') || '|>' || chr(10) || body.body || chr(10) || '<|end|>' AS chat
FROM body LEFT JOIN per ON per.conv_id = body.conv_id AND per.turn = body.turn LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id, thread[1] ORDER BY thread) AS place FROM path) path ON path.conv_id = body.conv_id AND path.turn = body.turn
"""
