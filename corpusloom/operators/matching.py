"""Which of many patterns occur in texts: one automaton over all of them, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import saved

#: Characters of the patterns that one automaton holds.  A longer list is cut into parts by hash, each a pass of its own.
LIMIT = 8_000_000
_HELD = 50_000
_LIVE: dict = {}


def _automaton(key: int, patterns: list[str]):
    """The automaton of a broadcast list, kept by the worker until another one is asked for."""
    import ahocorasick

    if _LIVE.get("key") != key:
        made = ahocorasick.Automaton()
        for p in patterns:
            made.add_word(p, p)
        made.make_automaton()
        _LIVE.update(key=key, value=made)
    return _LIVE["value"]


def _whole(text: str, start: int, end: int) -> bool:
    """No ASCII digit of the pattern is cut off from one beside it."""
    digit = "0123456789"
    left = text[start] in digit and start > 0 and text[start - 1] in digit
    right = text[end] in digit and end + 1 < len(text) and text[end + 1] in digit
    return not left and not right


def occurring(texts: DataFrame, patterns: DataFrame, keep: list[str], text: str | Column = "text", whole_numbers: bool = False, limit: int = LIMIT) -> DataFrame:
    """``keep``, pattern: the different ``patterns(pattern)`` that occur in rows of ``texts`` with equal ``keep``.

    With ``whole_numbers`` a pattern that begins or ends with a digit must not cut a number.  Empty and null patterns occur
    nowhere.  A task gives each pair once, so texts of one key need not meet.
    """
    wanted = saved(patterns.select(F.col("pattern").cast("string").alias("pattern")).where("pattern <> ''").distinct(), "patterns")
    total = wanted.agg(F.coalesce(F.sum(F.length("pattern").cast("long")), F.lit(0)).alias("n")).first()["n"]
    parts = -(-total // limit) or 1
    rows = texts.select(*keep, (F.col(text) if isinstance(text, str) else text).alias("_text")).where("_text is not null")
    schema = rows.drop("_text").schema.add("pattern", "string")

    def part(number: int) -> DataFrame:
        listed = [r[0] for r in wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == number).collect()]
        sent = texts.sparkSession.sparkContext.broadcast(listed)
        key = sent._jbroadcast.id()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, seen, fresh = _automaton(key, sent.value) if sent.value else None, set(), {}
            width = len(keep)
            names = [*keep, "pattern"]

            def out(kinds: list) -> pa.RecordBatch:
                columns = [pa.array([k[i] for k in fresh], t) for i, t in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([*columns, pa.array([k[-1] for k in fresh], pa.string())], names=names)

            for batch in batches:
                if automaton is None:
                    continue
                kinds = batch.schema.types[:width]
                keys = list(zip(*(batch.column(i).to_pylist() for i in range(width)))) if width else [()] * batch.num_rows
                for k, t in zip(keys, batch.column(width)):
                    t = t.as_py()
                    for end, p in automaton.iter(t):
                        pair = (*k, p)
                        if pair not in seen and (not whole_numbers or _whole(t, end + 1 - len(p), end)):
                            seen.add(pair)
                            fresh[pair] = None
                if fresh:
                    yield out(kinds)
                    fresh = {}
                if len(seen) > _HELD:
                    seen.clear()

        return rows.mapInArrow(run, schema)

    found = part(0)
    for number in range(1, parts):
        found = found.unionByName(part(number))
    return found.distinct()
