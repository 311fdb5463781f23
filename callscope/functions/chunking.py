"""Cutting texts into overlapping chunks, as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.functions.columns import bind

# Heading syntax, paragraph break, line breaks, white space, default sizes.
HEADING = r"(?U)^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"
PARAGRAPH = r"(?U)\n\s*\n"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
FIRST_SECTION = "Document"
MAX_CHARS, OVERLAP_CHARS, MIN_MAX_CHARS = 1800, 240, 200


def check_sizes(max_chars: int, overlap: int) -> None:
    if max_chars < MIN_MAX_CHARS:
        raise ValueError(f"max_chars must be at least {MIN_MAX_CHARS}")
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and below max_chars")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def _lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}", "")


def sections(text: Column) -> Column:
    """(section, body) per section; the lines between two headings belong to the first of them."""
    lines = F.split(text, LINE_BREAK)
    starts = lambda x: F.array_distinct(
        F.concat(F.array(F.lit(0)), F.array_compact(F.transform(x, lambda line, i: F.when(line.rlike(HEADING), i))))
    )

    def cut(x: Column, marks: Column) -> Column:
        def section(at: Column, k: Column) -> Column:
            body = F.slice(x, at + 1, F.coalesce(F.get(marks, k + 1), F.size(x)) - at)
            head = F.get(x, at)
            named = head.rlike(HEADING)
            opened = F.when(named, F.concat(F.array(_strip(head)), F.slice(body, 2, F.size(body)))).otherwise(body)
            name = F.when(named, _strip(F.regexp_extract(head, HEADING, 1))).otherwise(F.lit(FIRST_SECTION))
            return F.struct(name.alias("section"), _strip(F.array_join(opened, "\n")).alias("body"))

        return F.transform(marks, section)

    # Bind the lines and marks once: an array of one, mapped.
    bound = F.transform(F.array(lines), lambda x: F.struct(x.alias("x"), starts(x).alias("marks")))
    return F.flatten(F.transform(bound, lambda b: cut(b["x"], b["marks"])))


def pieces(paragraph: Column, max_chars: int) -> Column:
    """The paragraph in parts that fit: cut at the last space of the later half, else hard.

    A long paragraph is read in blocks, and what is not yet cut goes on into the next, so the work grows
    with its length and no more than a block is copied at a cut.
    """
    none = F.array().cast("array<string>")
    half = max_chars // 2

    def cut(state: Column, _: Column) -> Column:
        def at(x: Column) -> Column:
            first = F.substring(x["rest"], F.lit(1), x["end"])
            return F.struct(_lstrip(F.substring(x["rest"], x["end"] + 1, F.length(x["rest"]))).alias("rest"), F.array_append(x["out"], _strip(first)).alias("out"))

        def place(x: Column) -> Column:
            space = F.length(x["window"]) - F.instr(F.reverse(x["window"]), " ")
            found = (F.instr(x["window"], " ") > 0) & (space >= half)
            return F.struct(x["rest"].alias("rest"), x["out"].alias("out"), F.when(found, space).otherwise(max_chars).alias("end"))

        window = F.struct(state["rest"].alias("rest"), state["out"].alias("out"), F.substring(state["rest"], 1, max_chars + 1).alias("window"))
        return F.when(F.length(state["rest"]) <= max_chars, state).otherwise(bind(bind(window, place), at))

    def block(state: Column, text: Column) -> Column:
        joined = F.struct(_lstrip(F.concat(state["rest"], text)).alias("rest"), state["out"].alias("out"))
        rounds = lambda x: F.sequence(F.lit(0), F.floor(F.length(x["rest"]) / half).cast("int"))
        return bind(joined, lambda x: F.aggregate(rounds(x), x, cut))

    start = F.struct(F.lit("").alias("rest"), none.alias("out"))
    finish = lambda state: F.when(state["rest"] == "", state["out"]).otherwise(F.array_append(state["out"], state["rest"]))
    blocks = F.regexp_extract_all(paragraph, F.lit(f"(?s).{{1,{8 * max_chars}}}"), F.lit(0))
    return F.when(F.length(paragraph) <= max_chars, F.array(paragraph)).otherwise(F.aggregate(blocks, start, block, finish))


def packed(parts: Column, max_chars: int, overlap: int) -> Column:
    """Parts joined while they fit; a new chunk begins with the end of the one before it.

    The chunk being filled is kept apart from those that are done. Of the overlap only as much is taken as
    leaves room for the part itself.
    """
    none = F.array().cast("array<string>")

    def add(state: Column, part: Column) -> Column:
        last = state["last"]
        room = F.greatest(F.lit(0), max_chars - 2 - F.length(part))

        def opened(end: Column) -> Column:
            shared = F.when(F.length(end) > room, _lstrip(F.right(end, room))).otherwise(end)
            return bind(shared, lambda x: F.when(x == "", part).otherwise(F.concat(x, F.lit("\n\n"), part)))

        fits = F.length(last) + 2 + F.length(part) <= max_chars
        longer = F.struct(state["done"].alias("done"), F.concat(last, F.lit("\n\n"), part).alias("last"))
        next_ = F.struct(F.array_append(state["done"], last).alias("done"), bind(_strip(F.right(last, F.lit(overlap))), opened).alias("last"))
        first = F.struct(state["done"].alias("done"), part.alias("last"))
        return F.when(last.isNull(), first).when(fits, longer).otherwise(next_)

    start = F.struct(none.alias("done"), F.lit(None).cast("string").alias("last"))
    finish = lambda state: F.when(state["last"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["last"]))
    return F.aggregate(parts, start, add, finish)


def chunks(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """array<(section, content)> of every chunk in order."""
    check_sizes(max_chars, overlap)

    def of_section(s: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(s["body"], PARAGRAPH), _strip), lambda p: p != "")
        parts = F.flatten(F.transform(paragraphs, lambda p: pieces(p, max_chars)))
        return F.transform(
            packed(parts, max_chars, overlap), lambda c: F.struct(s["section"].alias("section"), c.alias("content"))
        )

    return F.flatten(F.transform(sections(text), of_section))
