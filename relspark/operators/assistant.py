"""The assistant's turns: which branch a session takes at each message, and dry runs of proposed actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.functions import text as T
from relspark.functions.canonical import json_text
from relspark.operators import automaton
from relspark.operators.policy import runtime_crisis

# Words that answer a proposal at run time, the least length of a text that says something, tools that may be simulated.
CONFIRMATIONS = {
    "yes": ["yes", "y", "sure", "ok", "okay", "proceed", "confirm"],
    "no": ["no", "n", "nope", "nah", "no thanks", "do not proceed"],
    "cancel": ["cancel", "stop", "never mind", "nevermind"],
}
LEAST_TEXT = 6
TOOL = "dry_run_schedule_adjustment"
TOOLS = [TOOL]

STATES = ["IDLE", "AWAITING", "REFINING", "CANCELLED", "ESCALATED", "ESCALATED_KNOWN"]
KINDS = ["crisis", "yes", "no", "cancel", "short", "text"]


def confirmation(t: Column) -> Column:
    """yes, no, cancel or null."""
    t = F.regexp_replace(T.squash(F.lower(t)), r"[.!?]+$", "")
    out = F.lit(None).cast("string")
    for kind, words in CONFIRMATIONS.items():
        out = F.when(t.isin(words), kind).otherwise(out)
    return out


def kind(t: Column) -> Column:
    """What a user's message is: the first of KINDS that holds. Null counts as empty."""
    t = F.coalesce(t, F.lit(""))
    said = F.char_length(F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.when(runtime_crisis(t), "crisis").otherwise(F.coalesce(confirmation(t), F.when(said < LEAST_TEXT, "short").otherwise("text")))


def reply(state: str, kind: str, stressed: bool) -> tuple[list[str], str]:
    """The steps of a turn and the state after it, in the order of the branches: crisis, answer awaited, refinement,
    proposal at hand, new concern, reply, exploration, nothing.

    A new concern of a stressed user is proposed for and presented within the turn, as is what a user has refined; an accepted
    dry run is simulated and the concern settled. After a cancel the concern stays without a new proposal. Crisis stays for
    the rest of the session: concerns are noted, but nothing is proposed.
    """
    if kind == "crisis":
        return ["crisis"], "ESCALATED"
    if state == "AWAITING":
        if kind == "yes":
            return ["confirm", "execute", "explore" if stressed else "none"], "IDLE"
        return (["confirm"], {"no": "REFINING", "cancel": "CANCELLED"}[kind]) if kind in ("no", "cancel") else (["ask_again"], state)
    answer = kind in CONFIRMATIONS
    if state == "REFINING":
        return (["none"], state) if answer else (["refine", "propose", "present"], "AWAITING")
    if state in ("CANCELLED", "ESCALATED_KNOWN"):
        return ["none"], state
    if kind == "text" and stressed:
        return (["concern", "propose", "present"], "AWAITING") if state == "IDLE" else (["concern"], "ESCALATED_KNOWN")
    if kind == "text":
        return ["reply"], state
    return ["explore" if stressed else "none"], state


def branches(df: DataFrame, conversation: str, turn: str, said: Column, stressed: Column, size: int = automaton.SIZE) -> DataFrame:
    """df with kind, state (before the turn), branch (its steps, joined by >) and next_state.

    said: the user's text, null where the row isn't a user's; such rows change nothing and have no branch.
    """
    replies = [[reply(s, k, bool(b)) for b in (0, 1) for k in KINDS] for s in STATES]
    table = [[STATES.index(after) for _, after in row] for row in replies]
    names = F.array(*[F.array(*[F.lit(">".join(steps)) for steps, _ in row]) for row in replies])
    after = F.array(*[F.array(*[F.lit(s) for _, s in row]) for row in replies])
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1 + F.when(F.coalesce(stressed, F.lit(False)), len(KINDS)).otherwise(0)
    df = df.withColumn("kind", F.when(said.isNotNull(), kind(said))).withColumn("_code", number)
    out = automaton.states_before(df, conversation, turn, "_code", table, size=size)
    state = F.get(F.array(*map(F.lit, STATES)), F.col("before"))
    return out.withColumns({"state": state, "branch": F.get(F.get(names, F.col("before")), F.col("_code")), "next_state": F.when(F.col("_code").isNull(), state).otherwise(F.get(F.get(after, F.col("before")), F.col("_code")))}).drop("_code", "before")


def dry_run(answer: Column, tool: Column, mode: Column, tool_input: Column, input_type) -> tuple[Column, Column]:
    """(outcome, output) of a proposed action: none, skipped without an explicit yes, blocked outside the list of tools, or simulated.

    The output of a simulated one is a JSON text with sorted keys after a mark; nothing is ever executed.
    """
    outcome = F.when(tool.isNull(), "none").when(~F.coalesce(answer == "yes", F.lit(False)), "skipped").when(~F.coalesce((mode == "dry_run") & tool.isin(TOOLS), F.lit(False)), "blocked").otherwise("simulated")
    parts = {"execution_mode": F.lit('"dry_run"'), "external_side_effects": F.lit("false"), "status": F.lit('"simulated"'), "tool_name": F.concat(F.lit('"'), tool, F.lit('"')), "would_apply": json_text(tool_input, input_type)}
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in parts.items()])
    return outcome, F.when(outcome == "simulated", F.concat(F.lit("[DRY-RUN] {"), body, F.lit("}")))
