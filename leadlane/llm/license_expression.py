"""Licence expressions: a shunting-yard parser, and what an expression amounts to.

``MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)``: WITH binds closest and takes a licence on its left
and an exception on its right, then AND, then OR; all read from the left, in any case. Brackets around a single name do no harm.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from leadlane.llm.license_terms import DUTIES, IDENTIFIERS, LINKING_EXCEPTIONS

_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.:\-]*\+?))")
_BINDING = {"OR": 1, "AND": 2, "WITH": 3}
_STARTS = sorted(IDENTIFIERS, key=len, reverse=True)


class Terms(NamedTuple):
    """What an expression amounts to: its labels, the duty of the choice that asks least, and its postfix form."""

    labels: frozenset[str]
    duty: str
    postfix: tuple[str, ...]


def tokens(text: str) -> list[str]:
    """Identifiers, operators and brackets from the start of a text, up to the first character that is none."""
    out, at = [], 0
    while found := _TOKEN.match(text, at):
        out.append(found[1] or found[2])
        at = found.end()
    return out


def expression_tokens(text: str) -> list[str]:
    """The tokens at the start of a text that can belong to one expression; prose that follows it is left out."""
    out, depth, operand = [], 0, False
    for token in tokens(text):
        operator = token.upper() in _BINDING
        if token == ")":
            if not depth or not operand:
                break
            depth -= 1
        elif token == "(" or not operator:
            if operand:
                break
            depth += token == "("
            operand = token != "("
        else:
            if not operand:
                break
            operand = False
        out.append(token)
    # An operator with nothing behind it is a word of the prose.
    while out and out[-1].upper() in _BINDING:
        out.pop()
    return out


def postfix(infix: list[str]) -> list[str] | None:
    """Reverse Polish form by the shunting-yard method; None if the brackets or the operands do not fit."""
    out, stack, operand = [], [], False
    for token in infix:
        binding = _BINDING.get(token.upper())
        if token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif binding:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= binding:
                out.append(stack.pop())
            stack.append(token.upper())
            operand = False
        else:
            if operand:
                return None
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def licence(identifier: str) -> tuple[str, str]:
    """Label and duty of an identifier; one that is not known is its own label, in lower case."""
    name = identifier.lower().rstrip("+")
    start = next((s for s in _STARTS if name == s or s.endswith("-") and name.startswith(s)), None)
    return IDENTIFIERS[start] if start else (name, "unknown")


def evaluate(text: str) -> Terms | None:
    """Terms of the expression at the start of a text; None if there is none that can be read.

    AND asks for the heavier of two duties, OR leaves the lighter one as a choice, and a linking exception turns a
    strong duty into a weak one. Labels are those of all licences named. NONE and NOASSERTION name no licence.
    """
    order = postfix(expression_tokens(text))
    if not order or any(t.upper() in ("NONE", "NOASSERTION") for t in order):
        return None
    stack: list[tuple[frozenset[str], int, str | None]] = []
    for token in order:
        if token not in _BINDING:
            label, duty = licence(token)
            stack.append((frozenset([label]), DUTIES.index(duty), token.lower()))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "WITH":
            # Both sides are single names.
            if left[2] is None or right[2] is None:
                return None
            eased = right[2].startswith(LINKING_EXCEPTIONS) and left[1] == DUTIES.index("strong")
            stack.append((left[0], DUTIES.index("weak") if eased else left[1], None))
        else:
            choose = max if token == "AND" else min
            stack.append((left[0] | right[0], choose(left[1], right[1]), None))
    labels, duty, _ = stack[0]
    return Terms(labels, DUTIES[duty], tuple(order))
