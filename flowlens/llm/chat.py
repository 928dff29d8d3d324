"""Chat formatting: a finite-state machine over roles, a declarative template, and loss flags by segment. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What each role's turn looks like and whether its text is learned from. ``{role}`` stands for the role's name.
TEMPLATE = {
    "head": "<|im_start|>{role}\n",
    "tail": "<|im_end|>\n",
    "learn": ["assistant"],
    #: state -> role -> next state; a turn without an entry is out of order.
    "turns": {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    #: states in which a conversation may end.
    "ends": ["answered"],
}
#: Reversible escapes for control strings in texts, applied in order and undone in reverse order.
ESCAPES = [("&", "&amp;"), ("<|", "&lt;|")]


def escape(text: Column) -> Column:
    """``text`` without any ``<|``, from which :func:`unescape` gives it back."""
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def escape_role(role: Column) -> Column:
    """As :func:`escape`; a line feed, which ends the role in a head, is escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _step(template: dict):
    """The state machine as one CASE: the next state, or ``bad``, which no turn leaves."""

    def step(state, turn):
        out = F.lit("bad")
        for at, moves in template["turns"].items():
            for role, to in moves.items():
                out = F.when((state == at) & (turn["role"] == role), F.lit(to)).otherwise(out)
        return out

    return step


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: dict = TEMPLATE) -> DataFrame:
    """One row for each conversation: ``conv_id, segments, valid``.

    ``segments`` is the formatted conversation as an array of ``text, loss``, in order: for each turn a head, the
    escaped text and a tail out of ``template``. ``loss`` is true for the text of roles to learn from alone. Joined,
    the segments' texts are the formatted string. ``valid`` tells whether a finite-state machine over the roles
    accepts the order of turns; conversations that it doesn't accept are formatted too.

    Turns go by ``turn``, then role, then text; a null turn comes first, repeated rows are repeated turns. Null texts
    and roles are empty strings; an empty role is out of order. Rows with a null id are one conversation. Very long
    texts stay in one row each, since a conversation is one string. An empty table gives an empty result, and other
    columns are not read. The one shuffle is the grouping by conversation.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segments(t):
        head = F.replace(F.lit(template["head"]), F.lit("{role}"), escape_role(t["role"]))
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(seg(head, F.lit(False)), seg(escape(t["text"]), t["role"].isin(template["learn"])), seg(F.lit(template["tail"]), F.lit(False)))

    end = F.aggregate("turns", F.lit("start"), _step(template))
    return chats.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), end.isin(template["ends"]).alias("valid"))


def formatted(segments: Column) -> Column:
    """The formatted string of a conversation's segments."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def parse_chats(text: Column, template: dict = TEMPLATE) -> Column:
    """Read a formatted string back: an array of ``role, text``. Escaped texts hold no mark, so splitting at marks is exact."""
    start, stop = template["head"].split("{role}")
    quote = lambda s: f"\\Q{s}\\E"
    # Each turn ends in the tail, so the last piece is empty; nothing else is left out.
    turns = F.split(text, quote(template["tail"]))
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

    def turn(t):
        body = F.substr(t, F.lit(len(start) + 1))
        at = F.instr(body, F.lit(stop))
        role = F.substr(body, F.lit(1), at - 1)
        return F.struct(unescape(F.replace(role, F.lit("&nl;"), F.lit("\n"))).alias("role"), unescape(F.substr(body, at + len(stop))).alias("text"))

    return F.transform(turns, turn)
