"""Documents cut into lines and spans, with positions and labels. Null texts have no line and no span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import explode_rows, map_rows

#: Lengths below which a line joins the next one, and at which spans are closed.
SHORT, SPAN = 20, 1000


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, pos, share, line: non-empty lines with their offset and place in the text.

    Offsets are summed inside the row, so no window or shuffle is needed.
    """

    def cut(text):
        out, pos = [], 0
        for i, line in enumerate(text.split("\n") if text else ()):
            if line:
                out.append((i, pos, pos / len(text), line))
            pos += len(line) + 1
        return out

    fields = [("line_no", T.LongType()), ("pos", T.LongType()), ("share", T.DoubleType()), ("line", T.StringType())]
    return explode_rows(docs, "doc_id", ["text"], fields, lambda: cut).withColumn("share", F.round("share", 6))


def prefix_labels(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, prefix: intro (first 5 %), conclusion (last 5 %), else section for headings.

    A heading is shorter than 50 characters and starts and ends with a capitalised word.
    """
    heading = (F.length("line") < 50) & F.col("line").rlike(r"^[A-Z]") & F.col("line").rlike(r"(^| )[A-Z][^ ]*$")
    label = F.when(F.col("share") < 0.05, "intro").when(F.col("share") >= 0.95, "conclusion").when(heading, "section")
    return rows.select("doc_id", "line_no", label.alias("prefix"))


def dated_prefix(prefix: Column, line: Column, date: Column) -> Column:
    """``prefix: date of D; line || ``, without the date where it is null; null without a prefix."""
    head = F.when(date.isNull(), F.concat(prefix, F.lit(": "))).otherwise(F.concat(prefix, F.lit(": date of "), date, F.lit("; ")))
    return F.concat(head, line, F.lit(" || "))


def merge_short(docs: DataFrame, short: int = SHORT) -> DataFrame:
    """doc_id, line_no, line: lines shorter than ``short`` joined to the next that is not; what is left at the end is a line."""

    def cut(text):
        out, held = [], []
        for i, line in enumerate(" ".join(x.split()) for x in (text or "").split("\n")):
            if line:
                held.append(line)
                if len(line) >= short:
                    out.append((i, " ".join(held)))
                    held = []
                last = i
        return [*out, (last, " ".join(held))] if held else out

    return explode_rows(docs, "doc_id", ["text"], [("line_no", T.LongType()), ("line", T.StringType())], lambda: cut)


def span_end(text: str, start: int, size: int) -> int:
    """Where the span from ``start`` on ends: at the first sentence end behind ``size`` characters, else at a space, else there.

    Neither is sought farther than ``size`` characters on, so no span is longer than twice that.
    """
    least = start + size
    if least >= len(text):
        return len(text)
    ends = [at for at in (text.find(mark, least, least + size + 1) for mark in (". ", "? ", "! ")) if at >= 0]
    if ends:
        return min(ends) + 1
    space = text.find(" ", least, least + size)
    return space if space >= 0 else min(len(text), least + size)


def consolidate(docs: DataFrame, size: int = SPAN) -> DataFrame:
    """doc_id, span_no, start, span: the text, its white space collapsed, in spans of ``size`` to twice as many characters."""

    def cut(text):
        flat, out, start = " ".join(text.split()) if text else "", [], 0
        while start < len(flat):
            end = span_end(flat, start, size)
            out.append((len(out), start, flat[start:end].strip()))
            start = end
        return out

    return explode_rows(docs, "doc_id", ["text"], [("span_no", T.LongType()), ("start", T.LongType()), ("span", T.StringType())], lambda: cut)


#: What stands for an entity of a kind.
GENERAL = {
    "ORG": "The Organization", "PERSON": "The Person", "FAC": "The Facility", "GPE": "The Location", "LOC": "The Location",
    "DATE": "The Date", "LAW": "The Law", "EVENT": "The Event", "MONEY": "The Amount",
}


def generalized(text: str, ents: list[tuple[str, int, int, str]], kinds: dict[str, str] = GENERAL) -> str:
    """``text`` with entities (entity, start, end, label) by their kinds' names, numbered where a label has several; other entities are joined by ``_``.

    Names that follow each other, or are joined by "and" or a comma, become one.
    """
    labels = [label for _, _, _, label in ents]
    numbers: dict[tuple[str, str], int] = {}
    out, at = [], 0
    for entity, start, end, label in ents:
        name = kinds.get(label)
        if name and labels.count(label) > 1:
            number = numbers.setdefault((label, entity), 1 + sum(k[0] == label for k in numbers))
            name = f"{name} {number}"
        out += [text[at:start], name or entity.replace(" ", "_")]
        at = end
    made = "".join([*out, text[at:]])
    for _ in range(3):
        for name in dict.fromkeys(kinds.values()):
            for joint in (" and ", " ", ", "):
                made = made.replace(f"{name}{joint}{name}", name)
    return made


def generalize(docs: DataFrame, kinds: dict[str, str] = GENERAL) -> DataFrame:
    """doc_id, text: ``generalized`` texts. docs: doc_id, text, ents (array of ent, start, end, tag, by start)."""

    def run(text, ents):
        return (None if text is None else generalized(text, [(e["ent"], e["start"], e["end"], e["tag"]) for e in ents or ()], kinds),)

    return map_rows(docs, ["text", "ents"], [("general", T.StringType())], lambda: run, keep=["doc_id"]).withColumnRenamed("general", "text")


def ocr_choice(boxes: DataFrame, least: float = 0.7, kept: float | None = None, length: int = 20, numbers: bool = False, far: float = 0.7) -> DataFrame:
    """image, reader, score, text: the text of the reader to be trusted for each image; images without one have no row.

    boxes: image, reader (a number, in the order they are tried), ord, x, y, text, prob. Boxes above
    ``kept`` (half of ``least`` by default) are joined in order, with a full stop behind one that is ``far`` from the last (by the
    largest x and y so far). A reader's text counts if it has ``length`` characters and is not mostly digits (unless ``numbers``). The first
    reader whose mean probability reaches ``least`` is taken, else the one with the best.
    """
    from pyspark.sql import Window

    kept = least / 2 if kept is None else kept
    order = Window.partitionBy("image", "reader").orderBy("ord")
    rows = boxes.withColumns({"max_x": F.max("x").over(order), "max_y": F.max("y").over(order)}).filter(F.col("prob") > kept)
    rows = rows.withColumns({"px": F.lag("x").over(order), "py": F.lag("y").over(order)})
    distance = F.sqrt(F.pow((F.col("px") - F.col("x")) / F.col("max_x"), 2) + F.pow((F.col("py") - F.col("y")) / F.col("max_y"), 2))
    stop = F.when((distance > far) & ~F.col("text").rlike(r"[\p{P}\s]$"), ".").otherwise("")
    rows = rows.select("image", "reader", "ord", "prob", F.concat("text", stop).alias("piece"))
    texts = rows.groupBy("image", "reader").agg(F.round(F.avg("prob"), 6).alias("score"), F.sort_array(F.collect_list(F.struct("ord", "piece"))).alias("pieces"))
    texts = texts.select("image", "reader", "score", F.trim(F.array_join(F.transform("pieces", lambda p: p["piece"]), " ")).alias("text")).filter(F.length("text") >= length)
    if not numbers:
        texts = texts.filter(F.regexp_count("text", F.lit(r"[0-9]")) <= F.length("text") / 3)
    first = F.when(F.col("score") >= least, F.struct(F.lit(0).alias("late"), F.col("reader").cast("double").alias("by"), "reader"))
    key = F.coalesce(first, F.struct(F.lit(1).alias("late"), (-F.col("score")).alias("by"), "reader"))
    best = texts.groupBy("image").agg(F.min_by(F.struct("reader", "score", "text"), key).alias("b"))
    mark = F.when(F.col("b.text").rlike(r"[\p{P}\s]$"), F.col("b.text")).otherwise(F.concat("b.text", F.lit(".")))
    return best.select("image", "b.reader", "b.score", mark.alias("text"))
