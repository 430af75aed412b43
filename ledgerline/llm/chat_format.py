"""Chat formatting by a finite-state machine over roles (operator 8), JVM-side only.

A declarative template says how a turn is marked, which role may follow which, and which
roles' texts carry the loss. Turns of a conversation are gathered in order and folded into
segments (text, loss); their concatenation is the formatted conversation. Control strings
inside texts and roles are escaped: the escape character first, doubled, then each control
string by a code that holds none of its characters, so that reading back is exact.

A conversation is one output row, so its turns meet in one row: that is its size, not a
group's. Texts are kept whole, however long. Nulls: a null text or role is empty; a null turn sorts first; rows with a null
conv_id form one conversation. Ties in turn are ordered by role, then text; repeated rows
are repeated turns. An order the machine does not accept is flagged in valid, and the
conversation is still formatted. An empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is open_mark + role + role_end + text + close_mark."""

    open_mark: str = "### "
    role_end: str = ": "
    close_mark: str = "</turn>\n"
    #: Strings that no text or role may contain, and what stands for each.
    codes: tuple[tuple[str, str], ...] = (("###", "\\h\\h\\h"), ("</turn>", "\\l/turn>"))
    #: Also replaced in roles.
    role_codes: tuple[tuple[str, str], ...] = ((":", "\\c"),)
    #: What each code of the escape character stands for.
    letters: tuple[tuple[str, str], ...] = (("\\h", "#"), ("\\l", "<"), ("\\c", ":"))
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: (state, role) pairs that the machine accepts; the state after a turn is its role.
    moves: frozenset[tuple[str, str]] = field(default_factory=lambda: frozenset({("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}))
    final: frozenset[str] = frozenset({"assistant"})


def escape(text: Column, codes: tuple[tuple[str, str], ...]) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, letters: tuple[tuple[str, str], ...]) -> Column:
    """Doubled escape characters are found from the left first; between them a single one
    always begins a code."""
    def plain(piece: Column) -> Column:
        for code, letter in letters:
            piece = F.replace(piece, F.lit(code), F.lit(letter))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def format_conversations(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:  # noqa: B008
    """conv_id, formatted, segments (array of text, loss), valid, complete."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        def segment(c: Column, loss: Column) -> Column:
            return F.struct(c.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(template.open_mark), escape(t["role"], template.codes + template.role_codes), F.lit(template.role_end))
        return F.array(
            segment(head, F.lit(False)),
            segment(escape(t["text"], template.codes), t["role"].isin(sorted(template.loss_roles))),
            segment(F.lit(template.close_mark), F.lit(False)),
        )

    accepted = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(template.moves)))
    start = F.struct(F.lit("").alias("state"), F.lit(True).alias("valid"))

    def move(acc: Column, t: Column) -> Column:
        step = F.struct(acc["state"].alias("a"), t["role"].alias("b"))
        return F.struct(t["role"].alias("state"), (acc["valid"] & F.array_contains(accepted, step)).alias("valid"))

    walked = chats.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.aggregate("turns", start, move).alias("end"),
    )
    return walked.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.col("end.valid").alias("valid"),
        (F.col("end.valid") & F.col("end.state").isin(sorted(template.final))).alias("complete"),
    )


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:  # noqa: B008
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.split(formatted, "\\Q" + template.close_mark + "\\E")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(template.open_mark) + 1), F.length(piece))
        at = F.locate(template.role_end, body)
        return F.struct(
            unescape(F.substring(body, F.lit(1), at - 1), template.letters).alias("role"),
            unescape(F.substring(body, at + len(template.role_end), F.length(body)), template.letters).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss_text(segments: Column, template: ChatTemplate = ChatTemplate()) -> Column:  # noqa: B008
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template.letters)), "")
