"""Row-level junk predicates. All take rows whose eleven columns are cells (see ``functions.text``)."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlane import rules
from leadlane.functions.build import built_once


def _hits(conditions: list[Column]) -> Column:
    """How many of the conditions hold."""
    return reduce(add, [F.when(c, 1).otherwise(0) for c in conditions])


def is_blank_row() -> Column:
    return reduce(and_, [F.col(c).isNull() for c in rules.COLUMNS])


def is_header_echo_row() -> Column:
    """A header id, or at least half of the filled cells repeat their own column name."""
    lead_id = F.coalesce(F.lower("lead_id").isin(*rules.HEADER_IDS), F.lit(False))
    echoes = _hits([(F.octet_length(c) == len(c)) & (F.lower(c) == c) for c in rules.COLUMNS])
    filled = _hits([F.col(c).isNotNull() for c in rules.COLUMNS])
    return lead_id | ((echoes > 0) & (echoes * 2 >= filled))


def is_garbage_test_row() -> Column:
    """A test id, a test marker in the notes, or one short word repeated over several unrelated cells."""
    lead_id = F.coalesce(F.lower("lead_id").isin(*rules.TEST_IDS), F.lit(False))
    notes = F.coalesce(F.lower("notes"), F.lit(""))
    marked = reduce(or_, [notes.contains(marker) for marker in rules.TEST_NOTE_MARKERS])
    words = [F.lower(f) for f in rules.TEST_FIELDS]
    word = F.coalesce(*words)
    repeated = (
        (_hits([F.col(f).isNotNull() for f in rules.TEST_FIELDS]) >= 3)
        & reduce(and_, [F.coalesce(w == word, F.lit(True)) for w in words])
        & (F.length(word) <= rules.TEST_WORD_LENGTH)
        & word.rlike(r"^\p{L}+$")
    )
    return lead_id | marked | repeated


@built_once
def junk_reason() -> Column:
    """Reason code of a junk row, null for a lead. The first rule that applies wins."""
    return (
        F.when(is_blank_row(), rules.BLANK_ROW)
        .when(is_header_echo_row(), rules.HEADER_ROW)
        .when(is_garbage_test_row(), rules.TEST_ROW)
    )
