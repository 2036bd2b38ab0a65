"""Chat formatting from event logs, with DataFrame functions only.

A log row says what happened to one message of a conversation at one place of its sequence:
  start        the message begins, with its role;
  delta        text is added to its end;
  edit         its text so far is replaced by the row's;
  regenerate   its text so far is discarded, and deltas build it anew;
  delete       it and its text are discarded, until a later start.
Logs are folded message by message in the order of seq, then messages are put in the order of their start and rendered.

Template: each turn is START role NEWLINE text END NEWLINE. In roles and texts a backslash goes before every
backslash, and into every control string (also those of other templates), so that texts hold no control string and
taking the backslashes out gives them back. spans holds, for each turn, where its (escaped) text stands in the
conversation and in its turn, in code points, and whether it is under the loss mask, as assistant texts are.

Every step takes time in proportion to the size of a conversation: turns are measured by a window over them, texts are cut
by one pattern, and turns and their spans are read side by side.

Defined cases: null text and null role are empty. Very long roles, texts and conversations are taken whole; a conversation
is one row. Rows with equal seq are ordered by event and text, equal turns by the hashes of role and text. A conversation
whose messages are all deleted has no row. A null conv_id is a conversation of its own. Equal rows of a finished
conversation are turns of their own. An empty table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>"
#: How control strings of this and other templates begin.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_PATTERN = "(<|\\[)(?=\\||s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of each control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, F.lit(_PATTERN), F.lit("$1\\\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("(?s)\\\\(.)"), F.lit("$1"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, first_seq, role, text) of a log (conv_id, message_id, seq, event, role, text)."""
    log = events.select("conv_id", "message_id", "seq", "event", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = log.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event", "role", "text"))).alias("rows"))
    # The last row that discards what came before; deltas behind it are joined in one go.
    n = F.size("rows")
    resets = F.transform("rows", lambda r, i: F.when(r["event"].isin("edit", "regenerate", "delete"), i + 1).otherwise(0))
    deleted = F.transform("rows", lambda r, i: F.when(r["event"] == "delete", i + 1).otherwise(0))
    rows = rows.withColumn("reset", F.array_max(resets)).withColumn("deleted", F.array_max(deleted))
    tail = F.slice("rows", F.greatest(F.col("reset"), F.lit(1)), n)
    text = F.array_join(F.transform(F.filter(tail, lambda r: r["event"].isin("edit", "delta", "start")), lambda r: r["text"]), "")
    starts = F.filter(F.slice("rows", F.col("deleted") + 1, n), lambda r: r["event"] == "start")
    rows = rows.withColumn("text", text).withColumn("starts", starts)
    alive = rows.filter((F.col("deleted") == 0) | (F.size("starts") > 0))
    role = F.coalesce(F.get("starts", F.lit(0))["role"], F.lit(""))
    first = F.coalesce(F.get("starts", F.lit(0))["seq"], F.get("rows", F.lit(0))["seq"])
    return alive.select("conv_id", "message_id", first.alias("first_seq"), role.alias("role"), "text")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and spans (start, within, length, loss; one for each turn) of final messages."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "first_seq", "message_id", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    h, b, close = F.char_length("head").cast("long"), F.char_length("body").cast("long"), END + "\n"
    until = F.sum(h + b + len(close)).over(Window.partitionBy("conv_id").orderBy("first_seq", "message_id").rowsBetween(Window.unboundedPreceding, 0))
    span = F.struct((until - b - len(close)).alias("start"), h.alias("within"), b.alias("length"), (F.col("role") == "assistant").alias("loss"))
    placed = parts.select("conv_id", F.struct("first_seq", "message_id", F.concat("head", "body", F.lit(close)).alias("turn"), span.alias("span")).alias("t"))
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return turns.select("conv_id", F.array_join(F.col("turns")["turn"], "").alias("formatted"), F.col("turns")["span"].alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role and text) and loss_text, taken from the rendered text and its spans."""
    # Each piece lacks the START that it was cut at; roles and texts hold none.
    pieces = F.slice(F.split("formatted", "<\\|start\\|>", -1), 2, 1_000_000_000)
    role = lambda p: F.regexp_extract(p, "(?s)^((?:[^\\\\\\n]++|\\\\.)*+)\\n", 1)
    body = lambda p: F.substring(p, F.char_length(role(p)) + 2, F.char_length(p) - F.char_length(role(p)) - 2 - len(END))
    turns = F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))
    masked = F.zip_with(pieces, "spans", lambda p, s: F.when(s["loss"], unescape(F.substring(p, (s["within"] - len(START) + 1).cast("int"), s["length"].cast("int")))).otherwise(""))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def conversation_events(conversations: DataFrame, delta_chars: int = 1_000) -> DataFrame:
    """A log that leads to finished conversations (conv_id, turn, role, text): for each row a start, and its text in deltas.

    By a hash of their text, a third of the messages have a draft that is discarded by a regeneration before, and a third
    a draft that an edit replaces by the beginning of the text.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    # Equal turns are told apart by role and text; equal rows stay rows by number.
    key = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "text")
    numbered = rows.groupBy("conv_id", key.alias("key")).agg(F.count("*").alias("times")).select("conv_id", "key.*", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    way = F.pmod(F.xxhash64("text"), F.lit(3))
    event = lambda part, name, text: F.struct(F.lit(part).alias("part"), F.lit(name).alias("event"), text.alias("piece"))
    draft = F.array(event(0, "start", F.lit("")), event(1, "delta", F.concat(F.lit("draft: "), F.reverse("role"))))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    # The first piece is what an edit brings; of an empty text it is empty.
    told = F.when(F.size(pieces) == 0, F.array(F.lit(""))).otherwise(pieces)
    deltas = F.transform(told, lambda x, i: F.struct((i + 3).alias("part"), F.when((i == 0) & (way == 2), F.lit("edit")).otherwise(F.lit("delta")).alias("event"), x.alias("piece")))
    log = F.when(way == 0, F.concat(F.array(event(0, "start", F.lit(""))), deltas)).when(way == 1, F.concat(draft, F.array(event(2, "regenerate", F.lit(""))), deltas)).otherwise(F.concat(draft, deltas))
    message = F.struct("turn", F.sha2("role", 256).alias("role_sha256"), F.sha2("text", 256).alias("text_sha256"), "copy")
    each = numbered.select("conv_id", message.alias("message_id"), "role", F.coalesce("turn", F.lit(-1)).alias("turn"), F.explode(log).alias("e"))
    return each.select("conv_id", "message_id", F.struct("turn", "e.part").alias("seq"), "e.event", F.when(F.col("e.event") == "start", F.col("role")).alias("role"), F.col("e.piece").alias("text"))
