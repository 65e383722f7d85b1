"""A default entity recogniser: rules and word lists as column expressions, where no trained one is attached."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe import constants as c
from veilframe.functions.textfn import find_all

_NAME = r"\p{Lu}[\p{L}'’-]*"
_DAY = r"(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day"
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_PEOPLE = r"(?:American|Mexican|Canadian|Chinese|Japanese|Korean|Indian|Italian|French|German|Spanish|Catholic|Jewish|Muslim|Hindu|Buddhist)"

#: label, pattern
ENTITIES = (
    ("PERSON", rf"\b(?:Dr|Mr|Mrs|Ms|Prof)\.?\s{_NAME}(?:\s{_NAME})?"),
    ("FAC", rf"\b(?:{_NAME}\s){{1,3}}(?:Hospital|Airport|Hotel|Stadium|Hall|Museum|Library|Park|Station|Plaza)\b"),
    ("ORG", rf"\b(?:{_NAME}\s){{1,3}}(?:Clinic|Inc|LLC|Corp|Company|Bank|University|Group|Medical Center|Associates)\b"),
    ("GPE", rf"(?<=\b(?:in|near|from|around)\s)(?!{_DAY}\b|{_MONTH}\b){_NAME}(?:\s{_NAME})?(?:,\s[A-Z]{{2}}\b)?"),
    ("NORP", rf"\b{_PEOPLE}s?\b"),
    ("DATE", rf"\b(?:(?:[Nn]ext|[Tt]his|[Ll]ast)\s(?:week|weekend|month|year|{_DAY})|[Tt]omorrow|[Tt]oday|{_DAY})\b"),
    ("TIME", r"(?i)\b(?:noon|midnight|(?:this|tomorrow)\s(?:morning|afternoon|evening))\b"),
    ("MONEY", r"(?i)\b\d[\d,]*(?:\.\d+)?\s(?:dollars|euros|usd|eur)\b"),
)


#: Words that no chunk holds, besides the stop words.
OUTSIDE = (
    "a", "about", "after", "an", "and", "any", "are", "ask", "at", "before", "book", "by", "find", "for", "from", "get", "have", "i", "in", "is",
    "make", "my", "need", "of", "on", "or", "our", "please", "some", "the", "their", "to", "under", "want", "with", "your",
)


def _chunk() -> str:
    """One or two modifiers in lower case, then a word of the lexicons; the last such word that follows."""
    heads = "|".join(sorted({w for ws in c.LEXICONS.values() for w in ws}))
    stop = "|".join(sorted({*c.CLOUD_STOP, *OUTSIDE}))
    return rf"\b(?:(?!(?:{stop})\b)[\p{{Ll}}-]+\s){{1,2}}(?:{heads})\b(?!\s(?:{heads})\b)"


CHUNK = _chunk()


def default_recognizer(text: Column) -> Column:
    """array<struct<text, start, end, label, is_chunk>> of a text, entities before chunks. Null gives null."""

    def found(label: str, pattern: str, chunk: bool) -> Column:
        return F.transform(find_all(text, pattern), lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), F.lit(label).alias("label"), F.lit(chunk).alias("is_chunk")))

    return F.concat(*(found(label, p, False) for label, p in ENTITIES), found("", CHUNK, True))
