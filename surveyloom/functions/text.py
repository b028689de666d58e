"""Column expressions that write and read text.

All of them are built once on the driver from column names and dictionaries
and then run inside generated code; there is no per-row Python.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom import fixed_values as fv

# characters that count as white space at the ends of a response
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD_BREAKS = "[ \t\n\r\f]+"
ABSENT_VALUE = "nan"


def _phrase(label: str, column: str, skip_absent: bool) -> Column:
    value = F.col(column).cast("string")
    sentence = F.concat(F.lit(f"{label} is "), F.coalesce(value, F.lit(ABSENT_VALUE)), F.lit(". "))
    return F.when(value.isNull(), F.lit("")).otherwise(sentence) if skip_absent else sentence


def compile_prompt(
    columns: list[str],
    dictionary: dict[str, str],
    skip: list[str],
    prefix: str = fv.PROMPT_PREFIX,
    skip_absent: bool = False,
) -> Column:
    """Prefix and one phrase for each described, applicable, non-skipped column."""
    parts = [F.lit(prefix)]
    for name in columns:
        if name in skip or name not in dictionary:
            continue
        inapplicable = F.col(name).cast("string").eqNullSafe(F.lit(fv.INAPPLICABLE_LABEL))
        parts.append(
            F.when(inapplicable, F.lit("")).otherwise(_phrase(dictionary[name], name, skip_absent))
        )
    return F.concat(*parts)


def compile_suffix(
    targets: list[str],
    dictionary: dict[str, str],
    prefix: str = fv.SUFFIX_PREFIX,
    skip_absent: bool = False,
) -> Column:
    """Prefix and one phrase per described target; inapplicable ones are kept."""
    phrases = [_phrase(dictionary[t], t, skip_absent) for t in targets if t in dictionary]
    return F.concat(F.lit(prefix), *phrases)


def row_to_json(columns: list[str]) -> Column:
    return F.to_json(F.array(*[F.col(c) for c in columns]))


def json_to_ids(text: Column) -> Column:
    return F.from_json(text, "array<int>")


def fill_template(
    with_input: str,
    without_input: str,
    instruction: Column,
    input_text: Column,
    label: Column | None = None,
) -> Column:
    """Fill '{instruction}' / '{input}' place holders; append the label if any."""

    def filled(template: str) -> Column:
        fields = {"instruction": instruction, "input": input_text}
        parts = []
        for literal, name, _, _ in Formatter().parse(template):
            parts.append(F.lit(literal))
            if name is not None:
                parts.append(F.coalesce(fields[name].cast("string"), F.lit("None")))
        return F.concat(*parts)

    no_input = F.coalesce(input_text, F.lit("")) == ""
    text = F.when(no_input, filled(without_input)).otherwise(filled(with_input))
    return text if label is None else F.concat(text, F.coalesce(label, F.lit("")))


def extract_response(output: Column, marker: str) -> Column:
    """Trimmed text between the first and second marker; null without marker."""
    part = F.btrim(F.split_part(output, F.lit(marker), F.lit(2)), F.lit(WHITE_SPACE))
    return F.when(F.contains(output, F.lit(marker)), part)


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAKS), lambda w: w != "")
