"""Splitting documents into sections at header lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SECTION_KEYWORDS, SECTION_WEIGHTS
from .text import let, strip, word_count


def header_of(line: Column, keywords: list[tuple[str, list[str]]] = SECTION_KEYWORDS, strict: bool = False) -> Column:
    """The section that a line is a header of, or null: after trimming marks, 1 to 60 characters with a keyword in them.

    strict asks that the line be a keyword, instead of holding one."""
    clean = strip(F.regexp_replace(strip(F.lower(line)), r"^[\s\-\*\#\=\|\.\_\~\>\:\d]+", ""))
    clean = strip(F.regexp_replace(clean, r"[\s\-\*\#\=\|\.\_\~\>\:]+$", ""))
    def name(c: Column) -> Column:
        found = F.lit(None).cast("string")
        for section, words in reversed(keywords):
            hit = F.lit(False)
            for w in words:
                hit = hit | (c == w if strict else F.contains(c, F.lit(w)))
            found = F.when(hit, F.lit(section)).otherwise(found)
        return F.when((F.char_length(c) > 0) & (F.char_length(c) <= 60), found)

    return let(clean, name)  # the line is cleaned once, not once a keyword


def line_blocks(text: Column, keywords=SECTION_KEYWORDS, strict: bool = False) -> Column:
    """A text as struct (lines, heads, blocks): its lines, how many are headers, and blocks (block, name, first, last) of
    line numbers, each from a header on (block 0: before the first, without a name). Null and empty texts have no lines.

    It is one pass over the row's lines: headers are found, and blocks are the stretches between them."""
    lines = F.when(F.coalesce(text, F.lit("")) != "", F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))

    def headers(ls: Column) -> Column:
        at = F.transform(ls, lambda line, i: F.struct(i.alias("at"), header_of(line, keywords, strict).alias("name")))
        return F.struct(ls.alias("lines"), F.filter(at, lambda h: h["name"].isNotNull()).alias("heads"))

    def stretches(t: Column) -> Column:
        def stretch(b: Column) -> Column:
            head, after = F.get(t["heads"], b - 1), F.get(t["heads"], b)
            first, last = F.coalesce(head["at"], F.lit(0)), F.coalesce(after["at"], F.size(t["lines"])) - 1
            return F.struct(b.alias("block"), head["name"].alias("name"), first.alias("first"), last.alias("last"))

        blocks = F.filter(F.transform(F.sequence(F.lit(0), F.size(t["heads"])), stretch), lambda b: b["first"] <= b["last"])
        return F.struct(t["lines"].alias("lines"), F.size(t["heads"]).alias("heads"), blocks.alias("blocks"))

    return let(let(lines, headers), stretches)


def section_lines(docs: DataFrame, id_col: str, text_col: str, keywords=SECTION_KEYWORDS, strict: bool = False) -> DataFrame:
    """Rows (id, line_no, line, header, block): block counts the headers so far. Null and empty texts have no lines.

    All of it is made inside a document's row: nothing is shuffled."""
    def rows(t: Column) -> Column:
        def line(b: Column, i: Column) -> Column:
            return F.struct(i.alias("line_no"), F.get(t["lines"], i).alias("line"), F.when(i == b["first"], b["name"]).alias("header"), b["block"].alias("block"))

        return F.flatten(F.transform(t["blocks"], lambda b: F.transform(F.sequence(b["first"], b["last"]), lambda i: line(b, i))))

    return docs.select(id_col, F.explode(let(line_blocks(F.col(text_col), keywords, strict), rows)).alias("__line")).select(id_col, "__line.*")


def sections_of(text: Column, keywords=SECTION_KEYWORDS, strict: bool = False) -> Column:
    """The sections of a text as an array of structs (section, content, start_line, end_line, word_count, ord), in order of
    first appearance.

    Lines before the first header are `header` if not blank; without any header the whole text is `other`. Header lines
    are left out; later sections of a name are joined to the first with a line feed, which keeps its start."""
    def named(t: Column) -> Column:
        def block(b: Column) -> Column:
            headed = b["name"].isNotNull().cast("int")
            content = F.array_join(F.slice(t["lines"], b["first"] + 1 + headed, b["last"] - b["first"] + 1 - headed), "\n")
            section = F.coalesce(b["name"], F.when(t["heads"] == 0, F.lit("other")).otherwise(F.lit("header")))
            return F.struct(b["block"].alias("block"), section.alias("section"), b["first"].alias("first"), b["last"].alias("last"), content.alias("content"))

        return F.filter(F.transform(t["blocks"], block), lambda b: (b["section"] != "header") | (strip(b["content"]) != ""))

    def merged(blocks: Column) -> Column:
        def section(name: Column) -> Column:
            return let(F.filter(blocks, lambda b: b["section"] == name), lambda mine: let(F.aggregate(mine, F.lit(""), lambda acc, b: strip(F.concat(acc, F.lit("\n"), b["content"]))), lambda content: F.struct(name.alias("section"), content.alias("content"), F.array_min(F.transform(mine, lambda b: b["first"])).alias("start_line"), F.array_max(F.transform(mine, lambda b: b["last"])).alias("end_line"), word_count(content).alias("word_count"), F.array_min(F.transform(mine, lambda b: b["block"])).alias("ord"))))

        return F.transform(F.array_distinct(F.transform(blocks, lambda b: b["section"])), section)

    return let(let(line_blocks(text, keywords, strict), named), merged)


def sections(docs: DataFrame, id_col: str, text_col: str, keywords=SECTION_KEYWORDS, strict: bool = False) -> DataFrame:
    """Rows (id, section, content, start_line, end_line, word_count, ord), a row of sections_of() each; no shuffle."""
    return docs.select(id_col, F.explode(sections_of(F.col(text_col), keywords, strict)).alias("__section")).select(id_col, "__section.*")


def weighted_text(docs: DataFrame, id_col: str, text_col: str, weights: dict[str, float] = SECTION_WEIGHTS, keywords=SECTION_KEYWORDS) -> DataFrame:
    """Rows (id, weighted): each non-empty section as often as the whole part of its weight, once at least.

    A section without a weight has that of `other`; a text without sections is given as it is, null as ''."""
    times = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, max(1, int(w)))])
    rest = F.lit(max(1, int(weights.get("other", 1.0))))

    def repeated(found: Column) -> Column:
        copies = F.flatten(F.transform(found, lambda x: F.array_repeat(x["content"], F.coalesce(F.element_at(times, x["section"]), rest))))
        return F.when(F.size(found) > 0, F.array_join(copies, "\n\n")).otherwise(F.coalesce(F.col(text_col), F.lit("")))

    full = F.filter(sections_of(F.col(text_col), keywords), lambda x: x["content"] != "")
    return docs.select(id_col, let(full, repeated).alias("weighted"))


def parsed(docs: DataFrame, id_col: str, text_col: str, keywords=SECTION_KEYWORDS) -> DataFrame:
    """Rows (id, sections): the non-empty sections of a document as an array of structs, in order."""
    full = F.filter(sections_of(F.col(text_col), keywords), lambda x: x["content"] != "")
    item = lambda x: F.struct(x["ord"].alias("ord"), x["section"].alias("section"), x["content"].alias("content"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), x["word_count"].alias("word_count"), F.concat_ws("-", x["start_line"].cast("string"), x["end_line"].cast("string")).alias("lines"))
    return docs.select(id_col, F.transform(full, item).alias("sections")).filter(F.size("sections") > 0)
