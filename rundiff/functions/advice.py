"""Advice per hotspot, picked by words in the class and method name and by the delta."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Fires on any class word or method word (on both kinds if ``both``).

    ``above`` lists (delta limit in ms, advice) from the highest limit down. Without
    ``otherwise`` the rule fires only above its lowest limit.
    """

    class_words: tuple[str, ...] = ()
    method_words: tuple[str, ...] = ()
    both: bool = False
    above: tuple[tuple[float, str], ...] = ()
    otherwise: str | None = None


# The rules in their order of precedence, with their advice texts.
RULES = [
    Rule(
        ("eventqueue",),
        ("dispatch",),
        both=True,
        above=((50, "Blocked by synchronized section → refactor lock granularity or use concurrent collections"),),
        otherwise="Event processing overhead → batch events or optimize listener callbacks",
    ),
    Rule(
        ("awt", "toolkit"),
        ("eventloop", "run"),
        both=True,
        otherwise="IO-bound → replace with async channel read/write or use NIO selectors",
    ),
    Rule(
        ("awt", "toolkit"),
        ("paint", "draw"),
        both=True,
        otherwise="Rendering bottleneck → optimize graphics operations or use double buffering",
    ),
    Rule(("awt", "toolkit"), otherwise="UI thread blocking → move heavy operations to background threads"),
    Rule(
        ("io",),
        ("stream", "read", "write"),
        otherwise="I/O bottleneck → implement async I/O with NIO channels or increase buffer sizes",
    ),
    Rule(
        ("socket",),
        ("network", "connection"),
        otherwise="Network latency → implement connection pooling or use non-blocking sockets",
    ),
    Rule(
        ("activemq", "broker"),
        ("message",),
        above=((100, "Message processing bottleneck → tune broker configuration or implement message batching"),),
        otherwise="Messaging overhead → optimize serialization or reduce message size",
    ),
    Rule(
        ("nio",),
        ("selector", "channel"),
        otherwise="NIO selector blocking → optimize selector key handling or use multiple selector threads",
    ),
    Rule(
        ("thread",),
        ("executor", "pool"),
        otherwise="Thread contention → adjust pool size or reduce synchronization scope",
    ),
    Rule(
        (),
        ("gc", "memory", "heap"),
        otherwise="Memory pressure → tune GC parameters or reduce object allocations",
    ),
    Rule(
        (),
        ("run",),
        above=((10, "Algorithmic hotspot in inner loop → cache results or avoid object creation inside loop"),),
    ),
    Rule(
        ("sql",),
        ("database", "query"),
        otherwise="Database query performance → add indexes, optimize queries, or implement caching",
    ),
    Rule(
        (),
        ("serial", "marshal"),
        otherwise="Serialization overhead → use faster serialization libraries or reduce payload size",
    ),
]

# Advice by delta when no rule fires.
BY_DELTA = [
    (100, "Significant performance regression → profile with JProfiler to identify exact bottleneck"),
    (20, "Moderate regression → check for new synchronization blocks or algorithm changes"),
    (0, "Minor regression → review recent code changes for unintended side effects"),
]
NO_REGRESSION = "Performance improvement detected → validate correctness of optimizations"


def _has_word(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words)) if words else F.lit(False)


def recommendation(class_name: Column, method_name: Column, delta_ms: Column) -> Column:
    """Advice text for one hotspot: the first rule of ``RULES`` that fires."""
    cls, method = F.lower(class_name), F.lower(method_name)
    cases: list[tuple[Column, str]] = []
    for rule in RULES:
        in_class, in_method = _has_word(cls, rule.class_words), _has_word(method, rule.method_words)
        fires = (in_class & in_method) if rule.both else (in_class | in_method)
        cases += [(fires & (delta_ms > limit), text) for limit, text in rule.above]
        if rule.otherwise:
            cases.append((fires, rule.otherwise))
    cases += [(delta_ms > limit, text) for limit, text in BY_DELTA]
    advice = F
    for condition, text in cases:
        advice = advice.when(condition, F.lit(text))
    return advice.otherwise(F.lit(NO_REGRESSION))
