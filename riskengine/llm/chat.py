"""Chat formatting from an event log, native Spark only.

Events are (conversation, seq, slot, kind, role, text). Folding a conversation in
the order of ``seq``:

- ``delta`` appends its text to the message of its slot;
- ``edit`` replaces the text of its slot by its own; later deltas append to it;
- ``regenerate`` drops every message from its slot on and starts that slot anew
  with its own text.

No loop is needed: an event counts if no later ``regenerate`` names its slot or an
earlier one, and no later ``edit`` names its slot. The counting events of a slot,
joined by ``seq``, are the message.

The template: an assistant turn is ``<s>`` text ``</s>``, any other turn is
``[INST]`` role, newline, text ``[/INST]``. Control strings inside texts get one
backslash more behind their opening bracket, which reading takes away again.
The loss mask lists the assistant texts as byte ranges of the UTF-8 output, so that
reading cuts them out without scanning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ASSISTANT = "assistant"
#: Opening bracket, backslashes, rest of a control string. Fixed values of the template.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
QUOTED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
TURN_END = r"(?<=</s>)|(?<=\[/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, QUOTED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """Roles end at the first newline, so theirs are written as backslash n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # an odd backslash before n is a newline; pairs are backslashes
    plain = F.regexp_replace(unescape(role), r"\G((?:[^\\]|\\\\)*+)\\n", "$1\n")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def fold(events: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Final messages: conversation, slot, role, text.

    NULL texts are empty and NULL roles are the empty role; NULL conversations form
    one conversation. The role of a message is the one of its first counting event.
    Events of one conversation with equal ``seq`` are taken in the order kind, role, text.
    A slot left without a counting event is no message; one with empty texts is.
    """
    later = Window.partitionBy(conv).orderBy(F.desc("seq"), F.desc("kind"), F.desc("role"), F.desc("text")).rowsBetween(
        Window.unboundedPreceding, -1)
    same_slot = Window.partitionBy(conv, "slot").orderBy(
        F.desc("seq"), F.desc("kind"), F.desc("role"), F.desc("text")).rowsBetween(Window.unboundedPreceding, -1)
    e = events.select(conv, "seq", "slot", "kind", F.coalesce("role", F.lit("")).alias("role"),
                      F.coalesce("text", F.lit("")).alias("text")).repartition(conv)
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("slot"))).over(later)
    edits = F.max(F.when(F.col("kind") == "edit", 1)).over(same_slot)
    counts = (cut.isNull() | (cut > F.col("slot"))) & edits.isNull()
    part = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text")))
    # Both windows and the fold share the one exchange by conversation.
    return (e.withColumn("_counts", counts).where("_counts").groupBy(conv, "slot").agg(part.alias("_parts"))
            .select(conv, "slot", F.col("_parts")[0]["role"].alias("role"),
                    F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text")))


def render(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_mask``, byte ranges [start, end)."""
    turns = Window.partitionBy(conv).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ours = F.col("role") == ASSISTANT
    body = escape(F.col("text"))
    turn = F.when(ours, F.concat(F.lit("<s>"), body, F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), escape_role(F.col("role")), F.lit("\n"), body, F.lit("[/INST]")))
    m = (messages.withColumn("_turn", turn).withColumn("_bytes", F.octet_length("_turn").cast("long"))
         .withColumn("_from", F.coalesce(F.sum("_bytes").over(turns), F.lit(0)))
         .withColumn("_span", F.when(ours, F.struct((F.col("_from") + 3).alias("start"),
                                                     (F.col("_from") + F.col("_bytes") - 4).alias("end")))))
    ordered = F.sort_array(F.collect_list(F.struct("slot", "_turn", "_span")))
    return (m.groupBy(conv).agg(ordered.alias("_turns")).select(
        conv, F.array_join(F.transform("_turns", lambda t: t["_turn"]), "").alias("formatted"),
        F.filter(F.transform("_turns", lambda t: t["_span"]), lambda s: s.isNotNull()).alias("loss_mask")))


def parse(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Turns and loss texts as read back from the output of :func:`render`."""
    blocks = F.filter(F.split("formatted", TURN_END), lambda b: b != "")

    def read(b):
        head = F.substring_index(b, "\n", 1)
        other = F.struct(unescape_role(F.substring(head, 7, 2**31 - 1)).alias("role"),
                         unescape(b.substr(F.length(head) + 2, F.length(b) - F.length(head) - 8)).alias("text"))
        return F.when(b.startswith("<s>"), F.struct(
            F.lit(ASSISTANT).alias("role"), unescape(b.substr(F.lit(4), F.length(b) - 7)).alias("text"))).otherwise(other)
    raw = F.encode("formatted", "UTF-8")
    loss = F.transform("loss_mask", lambda s: unescape(F.decode(
        F.substring(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8")))
    return formatted.select(conv, F.transform(blocks, read).alias("turns"), loss.alias("loss_texts"),
                            F.length("formatted").cast("long").alias("formatted_chars"))


def as_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A stored conversation as the log that would have produced it.

    Rows become slots in the order of turn, role and text (repeated rows are turns of
    their own); each slot streams its text in two deltas. Seq numbers are unique.
    """
    w = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), "role", "text")
    slots = rows.select(conv, F.row_number().over(w).cast("long").alias("slot"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    pieces = F.array(F.struct(F.lit(0).alias("k"), F.expr("left(text, cast(floor(length(text) / 2) as int))").alias("text")),
                     F.struct(F.lit(1).alias("k"), F.col("text").substr(half + 1, F.length("text")).alias("text")))
    return slots.withColumn("_p", F.explode(pieces)).select(
        conv, (F.col("slot") * 2 + F.col("_p.k")).alias("seq"), "slot", F.lit("delta").alias("kind"), "role",
        F.col("_p.text").alias("text"))


def digests(parsed: DataFrame, conv: str = "conv_id") -> DataFrame:
    joined = F.array_join("loss_texts", "")
    return parsed.select(
        conv, F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.length(joined).cast("long").alias("loss_chars"), F.sha2(joined, 256).alias("loss_sha256"), "formatted_chars")
