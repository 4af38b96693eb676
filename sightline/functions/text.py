"""Text cleaning, validation and rendering expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFE_ID = "^[A-Za-z0-9_-]{1,128}$"
PLACEHOLDER = r"\{([A-Za-z0-9_]+)\}"


def is_safe_id(x: Column) -> Column:
    return F.coalesce(x.rlike(SAFE_ID), F.lit(False))


def non_blank(x: Column) -> Column:
    """The text trimmed, null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def content_hash(prefix: Column, suffix: Column) -> Column:
    """First 16 hex digits of the SHA-256 of prefix, record separator, suffix."""
    return F.substring(F.sha2(F.concat(prefix, F.lit("\x1e"), suffix), 256), 1, 16)


def severity_rank(x: Column) -> Column:
    return F.when(x == "low", 0).when(x == "medium", 1).when(x == "high", 2).when(x == "critical", 3).otherwise(1)


# How a level's names begin. Reports have three levels, so a critical one counts as high.
HIGH = ("yüks", "yuks", "high", "krit", "critical")
LOW = ("düş", "dus", "low")


def severity_of(x: Column) -> Column:
    """A level (low, medium, high) from free text by its lower-case beginning, medium if unknown."""
    low = F.lower(F.trim(x))
    begins = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: low.startswith(n))
    return F.when(begins(HIGH), "high").when(begins(LOW), "low").otherwise("medium")


# What is put behind a text that was cut and before a line that looks like a delimiter, and the delimiters of
# outside text in a prompt.
CUT_OFF = " … (kırpıldı)"
DOUBTFUL = "[?] "
DELIMITERS = ("--- GÜVENİLMEZ BAĞLAM (başka bir modelin çıktısı) ---", "--- GÜVENİLMEZ BAĞLAM SONU ---")


def untrusted(x: Column, most: int = 2000, suffix: str = CUT_OFF, prefix: str = DOUBTFUL) -> Column:
    """Outside text made harmless for a template: cut to `most` characters first; then lines that begin with --- (behind any
    white space) get a prefix, and each --- in them is set apart. Lines end with a line feed, with or without a carriage
    return before it; a last empty line goes."""
    short = F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(suffix))).otherwise(x)
    lines = F.split(F.regexp_replace(short, r"\r?\n\z", ""), r"\r?\n")
    line = lambda s: F.when(s.rlike(r"(?U)^\s*---"), F.concat(F.lit(prefix), F.replace(s, F.lit("---"), F.lit("- - -")))).otherwise(s)
    return F.array_join(F.transform(lines, line), "\n")


def placeholders(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(PLACEHOLDER), 1))


def fill(x: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        x = F.replace(x, F.lit("{" + name + "}"), value)
    return x


def json_body(x: Column) -> Column:
    """From the first { to the last }, null if there is none."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


def without_code_fence(x: Column) -> Column:
    """An answer without its code fence. As characters of the set `json are taken off the front one by one, an answer that
    begins with one of them loses it too; the callers look for JSON, which doesn't."""
    bare = F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), "^[`json]+", "")
    return F.regexp_replace(F.regexp_replace(bare, "`+$", ""), r"^\s+|\s+$", "")


def trimmed(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


# Fixed value: what stands before a tool call in an answer.
TOOL_MARKER = "[TOOL_CALL]"


def tool_call(x: Column, marker: str = TOOL_MARKER) -> Column:
    """(said, call): the trimmed text before the first marker, and the JSON behind it up to the last }, null if that is none
    or there is no marker."""
    at = F.instr(x, marker)
    behind = F.regexp_extract(F.substring(x, at + len(marker), F.length(x)), r"(?s)^\s*(.*\})", 1)
    call = F.when((at > 0) & F.try_parse_json(F.nullif(behind, F.lit(""))).isNotNull(), behind)
    return F.struct(trimmed(F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x)).alias("said"), call.alias("call"))


def listed(parts: Column) -> Column:
    """Lines of a list: "- name (title): text" for structs (name, title, text), without what is null."""
    line = lambda p: F.concat(F.lit("- "), p["name"], F.coalesce(F.concat(F.lit(" ("), p["title"], F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(": "), p["text"]), F.lit("")))
    return F.array_join(F.transform(parts, line), "\n")


def safe_file_name(x: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(x, "/"), -1), "[^A-Za-z0-9._-]", "_")


def frame_key(video: Column, ms: Column) -> Column:
    return F.concat(F.lit("frames/"), video.cast("string"), F.lit("/"), F.lpad(ms.cast("string"), 9, "0"), F.lit(".jpg"))


def edit_error(text: Column, known: Column, editable: Column, allowed: Column, most: int = 8192, delimiters: tuple[str, ...] = DELIMITERS) -> Column:
    """The first thing wrong with an edit of a prompt fragment, null if nothing is. A text may hold dashes, but none of the
    delimiters."""
    return (
        F.when(~known, "unknown")
        .when(~editable, "not_editable")
        .when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty")
        .when(F.length(text) > most, "too_long")
        .when(F.size(F.array_except(placeholders(text), allowed)) > 0, "placeholder")
        .when(F.exists(F.array(*map(F.lit, delimiters)), lambda d: text.contains(d)), "delimiter")
    )


def block_level(x: Column, top: float = 1.0, blocks: str = "▁▂▃▄▅▆▇█") -> Column:
    """One character of a sparkline."""
    level = F.least(F.greatest(F.floor(x / F.lit(top) * (len(blocks) - 1)), F.lit(0)), F.lit(len(blocks) - 1))
    return F.substring(F.lit(blocks), (level + 1).cast("int"), F.lit(1))
