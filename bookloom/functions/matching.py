"""Ordered rule matching with higher-order functions: narrow, no shuffle, no Python."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value, ddl: str) -> Column:
    """A constant of any nested type; folded to one literal before execution."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def let(value: Column, body) -> Column:
    """Bind ``value`` once, so a lambda that uses it per rule does not recompute it."""
    return F.get(F.transform(F.array(value), body), 0)


def any_of(conditions: list[Column]) -> Column:
    """OR as a balanced tree, which keeps plans with many words shallow."""
    while len(conditions) > 1:
        conditions = [reduce(lambda a, b: a | b, conditions[i:i + 2])
                      for i in range(0, len(conditions), 2)]
    return conditions[0]


def word_pattern(words: list[str]) -> str:
    """One regex for a word list, factored by common prefixes; longest word first.

    A scan then costs a few comparisons per character, however long the list.
    """
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        parts = [(ch if ch.isalnum() or ch == " " else "\\" + ch) + render(child)
                 for ch, child in node.items() if ch]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return body + "?" if "" in node else body

    return render(tree)


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike(word_pattern(words))


def _prefix_free(words: list[str]) -> list[list[str]]:
    """The words in groups, none of which holds a word and a longer one it starts."""
    groups, rest = [], list(dict.fromkeys(words))
    while rest:
        group = [w for w in rest if not any(o != w and o.startswith(w) for o in rest)]
        groups.append(group)
        rest = [w for w in rest if w not in group]
    return groups


def found_words(text: Column, words: list[str], longest_only: bool = False) -> Column:
    """The distinct words that occur in ``text``, overlapping ones included.

    A look-ahead reports at each position the longest word starting there; shorter words
    at the same position come from a second list, unless only the longest matter.
    """
    groups = [words] if longest_only else _prefix_free(words)
    scans = [F.regexp_extract_all(text, F.lit(f"(?=({word_pattern(g)}))"), F.lit(1))
             for g in groups]
    return F.array_distinct(F.concat(*scans)) if len(scans) > 1 else F.array_distinct(scans[0])


def first_word(text: Column, words: list[str]) -> Column:
    """1-based place of the first listed word that occurs in ``text``, else null."""
    by_length = all(len(a) >= len(b) for a, b in zip(words, words[1:]))
    table = literal(words, "array<string>")
    return F.array_min(F.transform(found_words(text, words, longest_only=by_length),
                                   lambda w: F.array_position(table, w)))


def pick(table: list[dict], ddl: str, place: Column) -> Column:
    """Row of a literal table by 1-based place; null for a null place."""
    return F.get(literal(table, f"array<struct<{ddl}>>"), (place - 1).cast("int"))


def any_regex(text: Column, patterns: list[str], flags: str = "(?id)") -> Column:
    """One alternation; the dot stops at newlines only, whatever the engine default."""
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def compact(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the values whose condition holds, in the order given."""
    return F.array_compact(F.array(*[
        F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in pairs]))
