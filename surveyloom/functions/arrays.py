"""Column expressions over token lists and score vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv


def ones_like(tokens: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(tokens))


def closed_tokens(tokens: Column, end_token, cutoff: int | None = None) -> Column:
    """The list with the end token, unless it ends so; with ``cutoff`` at most that many tokens."""
    cut = F.slice(tokens, 1, cutoff) if cutoff else tokens
    is_open = ~F.try_element_at(cut, F.lit(-1)).eqNullSafe(F.lit(end_token))
    if cutoff:
        is_open = is_open & (F.size(cut) < cutoff)
    return F.when(is_open, F.concat(cut, F.array(F.lit(end_token)))).otherwise(cut)


def supervised_pair(
    prompt: Column, answer: Column, end_token, ignored, cutoff: int | None = None,
    add_end: bool = True, train_on_inputs: bool = False,
) -> tuple[Column, Column, Column]:
    """Input ids, labels with the prompt masked out, and the attention mask."""
    head = F.slice(prompt, 1, cutoff) if cutoff else prompt
    tail = F.concat(answer, F.array(F.lit(end_token))) if add_end else answer
    ids = F.concat(head, tail)
    masked = F.concat(F.array_repeat(F.lit(ignored), F.size(head)), tail)
    return ids, (ids if train_on_inputs else masked), ones_like(ids)


def left_padded(ids: Column, length: Column, padding=fv.PADDING_ID) -> Column:
    return F.concat(F.array_repeat(F.lit(padding), (length - F.size(ids)).cast("int")), ids)


def argmax(scores: Column) -> Column:
    """Position of the largest score, counted from 0; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def squeezed(scores: Column) -> Column:
    """The only element of a one-element list."""
    return F.try_element_at(scores, F.lit(1))
