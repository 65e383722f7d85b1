"""Recognisers as table functions: the extension point that SQL can call, with a lateral join, a row a span."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SPAN = "start: int, end: int, label: string, text: string"


def registered(spark: SparkSession, name: str, make: Callable[[], Callable[[str], list[tuple[int, int, str]]]]) -> None:
    """Registers `name`(text): spans of a text by what make() gives, a function from a text to (start, end, label).

    make() runs once a worker and partition, so a model is loaded there and not for each row; rows travel as Arrow batches.
    select id, s.* from payloads, lateral name(payload) s. Null texts have no spans; spans come in order of start."""

    class Spans:
        def __init__(self) -> None:
            self.find = make()

        def eval(self, text: str) -> Iterator[tuple[int, int, str, str]]:
            for start, end, label in sorted(self.find(text)) if text is not None else ():
                yield start, end, label, text[start:end]

    spark.udtf.register(name, udtf(Spans, returnType=SPAN, useArrow=True))


def by_patterns(patterns: dict[str, str]) -> Callable[[], Callable[[str], list[tuple[int, int, str]]]]:
    """A recogniser of regular expressions by label."""

    def make() -> Callable[[str], list[tuple[int, int, str]]]:
        import re

        compiled = [(label, re.compile(p)) for label, p in patterns.items()]
        return lambda text: [(m.start(), m.end(), label) for label, p in compiled for m in p.finditer(text)]

    return make
