"""Personal data by rules with context: entities with offsets, and redaction."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import map_rows
from corpusmill.session import ship, spread


@dataclass(frozen=True)
class Rule:
    """``near``: one of these words must stand within the window; ``block``: none may; ``retag``: word to new tag."""

    tag: str
    pattern: str
    near: tuple[str, ...] = ()
    block: tuple[str, ...] = ()
    retag: tuple[tuple[str, str], ...] = ()


RULES = (
    Rule("EQUATION", r"\d+(?:\.\d+)?(?: ?[-+*/^] ?\d+(?:\.\d+)?)+ ?= ?\d+(?:\.\d+)?"),
    Rule("EMAIL", r"[A-Za-z0-9_\u00c0-\u024f.%+-]+@[A-Za-z0-9_\u00c0-\u024f-]+(?:\.[A-Za-z0-9_\u00c0-\u024f-]+)*\.[A-Za-z]{2,}"),
    Rule("URL", r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"),
    Rule("IP_ADDRESS", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    Rule("IP_ADDRESS", r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}|(?:[0-9a-fA-F]{1,4}:){1,7}:|::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}"),
    Rule("DATE", r"(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[./](?:0?[1-9]|1[0-2])[./](?:19|20)\d\d|(?:19|20)\d\d年\d{1,2}月(?:\d{1,2}日)?", retag=(("born", "AGE"),)),
    Rule("TIME", r"(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?"),
    Rule("AGE", r"\d{1,3}[ -]years?[ -]old|(?:19|20)\d\d", near=("born", "aged", "old")),
    Rule("AGE", r"\d{1,3} ?(?:岁|歲)"),
    Rule("PHONE", r"\+?\d{1,3}[ -]?\(?\d{3}\)?[ -]\d{3}[ -]?\d{4}|\+\d{8,14}|\(?\d{3}\)?[ -]\d{3}-\d{4}", block=("isbn", "pp")),
    Rule("PHONE", r"1[3-9]\d{9}", near=("电话", "手机", "電話", "tel", "phone")),
    Rule("USER", r"@[A-Za-z_][A-Za-z0-9_]{2,30}"),
    Rule("LICENSE_PLATE", r"[A-Z]{1,3}[ -]?\d{2,4}[ -]?[A-Z]{0,3}", near=("plate", "plates", "licence", "license", "registration", "vehicle", "car")),
    Rule("LICENSE_PLATE", r"[\u4e00-\u9fff][A-Z] ?·? ?[A-Z0-9]{5,6}", near=("车牌", "車牌", "牌照")),
    Rule("KEY", r"(?=[A-Za-z_-]*\d)(?=[\d_-]*[A-Za-z])[A-Za-z0-9_-]{32,64}"),
    Rule("ID", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|\d(?:[ -]?\d){5,49}", block=("pp", "page", "isbn")),
    Rule("ID", r"\d{17}[\dXx]", near=("身份证", "身份證")),
)
#: Tags that are looked for as well when one is asked for, so that what is the one is not taken for the other.
WIDER = {"ID": ("ADDRESS",), "DATE": ("ID",), "AGE": ("DATE",)}
#: Kinds of numbers that name goods, not people.
NO_PERSON = ("isbn",)
#: Years that a date may have.
YEARS = (1600, 2050)
WINDOW, LEAST_ID, MOST_ID, LONGEST_WORD = 20, 6, 50, 100
#: An earlier tag wins where two entities are the same characters.
ORDER = tuple(dict.fromkeys(r.tag for r in RULES))
_EDGE = frozenset(" \t\r\n.,;:!?()[]{}<>\"'“”‘’«»|=/-")


def luhn(number: str) -> bool:
    digits = [int(d) for d in number if d.isdigit()]
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return len(digits) >= 12 and total % 10 == 0


def iban(code: str) -> bool:
    code = re.sub(r"[ -]", "", code).upper()
    return bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", code)) and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def isbn(code: str) -> bool:
    code = re.sub(r"[ -]", "", code).upper()
    if re.fullmatch(r"97[89]\d{10}", code):
        return sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(code)) % 10 == 0
    return bool(re.fullmatch(r"\d{9}[\dX]", code)) and sum((10 - i) * (10 if d == "X" else int(d)) for i, d in enumerate(code)) % 11 == 0


def resident_id(code: str) -> bool:
    """A resident number of 18 places with its check sign."""
    if not re.fullmatch(r"\d{17}[\dXx]", code):
        return False
    return "10X98765432"[sum(int(d) * pow(2, 17 - i, 11) for i, d in enumerate(code[:17])) % 11] == code[17].upper()


def id_kind(found: str) -> str | None:
    """resident, iban, isbn, card or null: which check signs fit."""
    if resident_id(found):
        return "resident"
    return "iban" if iban(found) else "isbn" if isbn(found) else "card" if luhn(found) and 13 <= sum(map(str.isdigit, found)) <= 19 else None


def fast_date(found: str) -> bool:
    """Whether parts between marks are year and month, two years, or a year, a month and a day in some order."""
    parts = re.split(r"[-/. ]", found)
    if not all(p.isdigit() and len(p) <= 4 for p in parts) or not 2 <= len(parts) <= 3:
        return False
    years = [len(p) == 4 and YEARS[0] <= int(p) <= YEARS[1] for p in parts]
    rest = [int(p) for p, y in zip(parts, years, strict=True) if not y]
    if len(parts) == 2:
        return all(years) or (any(years) and 1 <= rest[0] <= 12)
    return sum(years) == 1 and not years[1] and min(rest) >= 1 and min(rest) <= 12 and max(rest) <= 31


_COMPILED: dict[str, re.Pattern] = {}


def _pattern(rule: Rule) -> re.Pattern:
    return _COMPILED.setdefault(rule.pattern, re.compile(rule.pattern))


def _has(words: tuple[str, ...], context: str) -> bool:
    return any(w in context if _CJK.search(w) else re.search(rf"(?<!\w){re.escape(w)}(?!\w)", context) for w in words)


_CJK = re.compile(r"[\u3000-\u30ff\uff00-\uffef\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3\u0e00-\u0e7f]")
_LONG = re.compile(rf"(?:(?!{_CJK.pattern})\w){{{LONGEST_WORD + 1},}}")


def _edge(text: str, at: int) -> bool:
    """Whether an entity may end beside the character at ``at``: an edge mark, a character of a script without spaces, or the text's end."""
    return not 0 <= at < len(text) or text[at] in _EDGE or bool(_CJK.match(text[at]))


def detect(text: str | None, rules: tuple[Rule, ...] = RULES, window: int = WINDOW, tags: tuple[str, ...] | None = None) -> list[tuple[str, int, int, str]]:
    """(entity, start, end, tag) without overlaps, in order; offsets are code points.

    An entity needs an edge (``_edge``) on both sides. Runs of over 100 letters, digits and underscores are
    blanked first. A number that reads as a date is one; identifiers of ``NO_PERSON`` are left out. Of overlapping entities the one that starts first stays, then the longer, then
    the earlier tag. With ``tags``, rules of these and of the tags in ``WIDER`` are used and only ``tags`` are given.
    """
    if not text:
        return []
    wanted = None if tags is None else {*tags, *(w for t in tags for w in WIDER.get(t, ()))}
    clean = _LONG.sub(lambda m: " " * len(m.group()), text)
    low, found = clean.lower(), []
    for rule in rules:
        if wanted is not None and rule.tag not in wanted and not any(new in wanted for _, new in rule.retag):
            continue
        if rule.near and not any(w in low for w in rule.near):  # quick test: a word of the rule stands somewhere
            continue
        for m in _pattern(rule).finditer(clean):
            start, end, tag = m.start(), m.end(), rule.tag
            if not (_edge(clean, start - 1) and _edge(clean, end)):
                continue
            context = f"{clean[max(0, start - window) : start]} {clean[end : end + window]}".lower()
            if (rule.near and not _has(rule.near, f"{context} {m.group().lower()}")) or _has(rule.block, context):
                continue
            if tag in ("ID", "PHONE") and fast_date(m.group()):
                tag = "DATE"
            if tag == "ID":
                kind = id_kind(m.group())
                if kind in NO_PERSON or not (LEAST_ID <= len(re.sub(r"[ .-]", "", m.group())) <= MOST_ID and (kind or "-" in m.group() or " " not in m.group())):
                    continue
            retag = rule.retag or next((r.retag for r in rules if r.tag == tag), ())
            tag = next((new for word, new in retag if _has((word,), context)), tag)
            found.append((start, -end, ORDER.index(tag) if tag in ORDER else len(ORDER), tag))
    kept, last = [], 0
    for start, end, _, tag in sorted(found):
        if start >= last:
            kept.append((text[start:-end], start, -end, tag))
            last = -end
    return kept if tags is None else [e for e in kept if e[3] in tags]


def entity_counts(docs: DataFrame, tags: tuple[str, ...] = ORDER) -> DataFrame:
    """doc_id and one column tag_cnt (lower case) for each tag: how many entities of it a text holds."""

    def count(text):
        found = [tag for _, _, _, tag in detect(text)]
        return tuple(found.count(tag) for tag in tags)

    return map_rows(docs, ["text"], [(f"{tag.lower()}_cnt", T.LongType()) for tag in tags], lambda: count, keep=["doc_id"])


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, ents: array of (ent, start, end, tag); null or empty text: an empty array."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("ent", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("tag", pa.string())]))

    def run(batches):
        for batch in batches:
            made = [[dict(zip(("ent", "start", "end", "tag"), e, strict=True)) for e in detect(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], names=["doc_id", "ents"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, ents array<struct<ent:string,start:int,end:int,tag:string>>")


def redact(text: Column, ents: Column) -> Column:
    """``text`` with each entity replaced by its tag in brackets."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s, e):
        gap = F.substring(text, s["at"] + 1, e["start"] - s["at"])
        return F.struct(F.concat(s["out"], gap, F.lit("["), e["tag"], F.lit("]")).alias("out"), e["end"].alias("at"))

    return F.aggregate(ents, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
