"""Which of many patterns may match a text: one Aho-Corasick pass over it finds the strings that the patterns cannot do without."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Strings that a pattern may ask for one of; with more it counts as one that asks for nothing.
MOST = 64


def required(pattern: str) -> list[str] | None:
    """Strings in lower case (A-Z), one of which stands in each text in which the pattern is found, compared so; None if there are no such.

    The pattern's parts are read in sequence: runs of letters are one string, alternatives ask for one of theirs, what may be left out asks for
    nothing, and of all parts the one whose shortest string is longest is taken. Patterns that cannot be read ask for nothing.
    """
    from re import _constants as c
    from re import _parser as parser

    try:
        tree = parser.parse(pattern.replace(r"\z", r"\Z"))
    except (re.error, RecursionError, OverflowError):
        return None

    def best(options: list[list[str]]) -> list[str] | None:
        fit = [o for o in options if o and len(o) <= MOST and all(o)]
        return max(fit, key=lambda o: (min(map(len, o)), -len(o)), default=None)

    def of(sequence) -> list[str] | None:
        options, run = [], ""
        for op, value in sequence:
            if op is c.LITERAL:
                run += chr(value)
                continue
            if op is c.IN and len(value) == 1 and value[0][0] is c.LITERAL:
                run += chr(value[0][1])
                continue
            if op is c.AT:
                continue  # places take no characters
            found = None
            if op is c.SUBPATTERN:
                found = of(value[3])
            elif op is c.ATOMIC_GROUP:
                found = of(value)
            elif op is c.BRANCH:
                parts = [of(p) for p in value[1]]
                found = [x for p in parts for x in p] if all(parts) else None
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] >= 1:
                found = of(value[2])
            options += [[run]] if run else []
            run = ""
            options += [found] if found else []
        options += [[run]] if run else []
        return best(options)

    found = of(tree)
    folded = tree.state.flags & re.IGNORECASE or "(?i" in pattern
    if found and folded and not all(x.isascii() for x in found):
        return None
    return sorted({_lower(x) for x in found}) if found else None


def _lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def candidates(files: DataFrame, patterns: list[str], text: str = "text", name: str = "candidates") -> DataFrame:
    """files with an array of the indexes of the patterns that may match their text; files for which there is none are left out.

    The automaton of all strings is built once in a worker, and a text is read once, however many patterns there are. Patterns that ask
    for nothing may match every text. Null texts match nothing.
    """
    asked = [required(p) for p in patterns]
    always = [i for i, a in enumerate(asked) if a is None]
    by_string: dict[str, list[int]] = {}
    for i, strings in enumerate(asked):
        for s in strings or ():
            by_string.setdefault(s, []).append(i)
    schema = T.StructType([*files.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for s, rules in by_string.items():
            automaton.add_word(s, (s, rules))
        if by_string:
            automaton.make_automaton()
        # a few texts at a time, so that a batch of long ones is not held again as strings
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            lists = []
            for value in (x.as_py() for x in batch.column(text)):
                if value is None:
                    lists.append(None)
                    continue
                seen, rules = set(), set(always)
                for _, (s, own) in automaton.iter(_lower(value)) if by_string else ():
                    if s not in seen:
                        seen.add(s)
                        rules.update(own)
                        if len(seen) == len(by_string):
                            break
                lists.append(sorted(rules) or None)
            own = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=schema.names).filter(own.is_valid())

    return files.mapInArrow(run, schema)
